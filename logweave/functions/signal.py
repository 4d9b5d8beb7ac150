"""Message cleaning, masks, entropy and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave import constants as C
from logweave.functions.parsing import let

#: The characters that Unicode counts as white space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def clean(message: Column) -> Column:
    """White space runs as one space, quotes dropped."""
    return F.translate(F.regexp_replace(F.btrim(message, F.lit(SPACES)), f"[{SPACES}]+", " "), "\"'", "")


def hide_attributes(message: Column, attributes: Column) -> Column:
    """Values of seven attributes are replaced by the attribute's name."""
    for name in C.MASKED_ATTRIBUTES:
        value = F.try_element_at(attributes, F.lit(name))
        message = F.when(value.isNotNull() & (value != ""), F.replace(message, value, F.lit(f"<{name.upper()}>"))).otherwise(message)
    return message


def protect(message: Column) -> Column:
    for word in C.PROTECTED:
        message = F.regexp_replace(message, rf"(?i)\b{word}\b", f"FIX_{word}")
    return message


def unprotect(template: Column) -> Column:
    return F.replace(template, F.lit("FIX_"), F.lit(""))


def mask(message: Column) -> Column:
    for name, pattern in C.MASKS:
        message = F.regexp_replace(message, pattern, name)
    return message


def prepared(message: Column, attributes: Column | None = None) -> Column:
    """What template mining gets. Texts without a protected word, or without anything that masks look for, are not searched word by word; each step looks at a value that was made once."""
    text = clean(F.coalesce(message, F.lit("")))
    if attributes is not None:
        text = hide_attributes(text, attributes)
    words = r"(?i)\b(?:" + "|".join(C.PROTECTED) + r")\b"
    guarded = let(text, lambda t: F.when(t.rlike(words), protect(t)).otherwise(t))
    return let(guarded, lambda t: F.when(t.rlike(r"[0-9/]|(?:\b[0-9a-fA-F]{8}-)"), mask(t)).otherwise(t))


def template_id(template: Column) -> Column:
    return F.concat(F.lit("E_"), F.substring(F.sha1(template.cast("binary")), 1, 8))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits, not rounded; empty text 0."""
    size = F.length(text).cast("double")
    chars = F.split(text, "")
    counts = F.transform(F.array_distinct(chars), lambda c: size - F.length(F.replace(text, c, F.lit(""))))
    bits = F.aggregate(counts, F.lit(0.0), lambda acc, n: acc - (n / size) * F.log2(n / size))
    return F.when(F.length(text) > 0, bits).otherwise(F.lit(0.0))


def confidence(template: Column, cluster_size: Column) -> Column:
    """Size term times the share of words that are no wildcard, not rounded."""
    times = lambda word: (F.length(template) - F.length(F.replace(template, F.lit(word), F.lit("")))) / len(word)
    wild = times("<*>") + times("<NUM>") + times("<IP>")
    words = F.size(F.filter(F.split(F.trim(template), r"\s+"), lambda w: w != ""))
    quality = F.when(words > 0, 1.0 - wild / words).otherwise(F.lit(1.0))
    size = F.when(cluster_size > 0, F.least(F.lit(1.0), 0.5 + F.log10(cluster_size.cast("double")) / 4)).otherwise(F.lit(0.5))
    return size * quality


def seconds(value: Column) -> Column:
    """Epoch seconds of a number that may be milliseconds."""
    return F.when(value > 1e12, value / 1000).otherwise(value)
