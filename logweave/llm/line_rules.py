"""Quality rules by the frequency of lines across documents, in DataFrame functions only.

Lines are normalised (A-Z in lower case, digits as 0, white space as one space, ends trimmed) and hashed with their host, 128 bits. For each host, the different documents
that hold a line are counted; documents of one host with the same text are one. A line is common if it stands in more than `most` documents of a host and in more than `share` of
them all. Common lines go, and a document of which less than `rest` of the words stays is depleted and rejected.

Counting: every task sums a line's occurrences in a text before the shuffle, and a line's documents are counted by partial sums, so that neither a line that stands everywhere nor a host with a third of all
documents meets in one task. What is shuffled are hashes, not texts.

Base rules of a text: words, characters in them, symbols, repeated lines, and words in windows of three words that the text holds twice or more. A text fails them with under 50 words,
or if more than half of its words are in such windows. Windows are found by sorting 40 bits of their hash with their place; neighbours are compared word by word, and
where two different windows share the 40 bits, or a text has more words than places, the windows themselves are sorted instead.

Cases: a null text has no words and fails; a null host is a host of its own. Empty and blank lines are no lines. Repeated rows and null ids pass, each row is
judged. An empty table gives no rows. All columns of the table are kept by `clean`, also those with names that are used here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.session import Scratch

MOST, SHARE, REST = 20, 0.01, 0.5
FEWEST_WORDS, REPEATED = 50, 50
WINDOW = 3
PLACE_BITS = 24

# White space between words, and the characters that count as symbols.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789\t\x0b\x0c\r"
FOLDED = "abcdefghijklmnopqrstuvwxyz000000000    "


def lines_of(text: Column) -> Column:
    """The normalised lines of a text that hold a word, in order."""
    folded = F.regexp_replace(F.translate(text, UPPER, FOLDED), " {2,}", " ")
    return F.array_remove(F.transform(F.split(folded, "\n", -1), lambda line: F.trim(line)), "")


def key_of(host: Column, line: Column) -> Column:
    return F.struct(F.xxhash64(host, line).alias("a"), F.xxhash64(F.lit("line"), line, host).alias("b"))


def repeated_words(words: str) -> Callable[[DataFrame], DataFrame]:
    """Adds n_repeat_words: words of the array column `words` inside a window of WINDOW words that the array holds twice or more."""
    mask = (1 << PLACE_BITS) - 1
    w = F.col(words)
    window = lambda i: [F.get(w, i + k) for k in range(WINDOW)]
    number = F.size(w) - WINDOW + 1
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    high = lambda x: F.shiftright(x, PLACE_BITS)

    def same(a: Column, b: Column) -> Column:
        out = F.get(w, a) == F.get(w, b)
        for k in range(1, WINDOW):
            out = out & (F.get(w, a + k) == F.get(w, b + k))
        return out

    none = F.array().cast("array<int>")

    def add(rows: DataFrame) -> DataFrame:
        packed = F.transform(F.sequence(F.lit(0), number - 1), lambda i: F.xxhash64(*window(i)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))
        rows = rows.withColumn("_sorted", F.when((number > 1) & (number <= mask), F.sort_array(packed)).otherwise(F.array().cast("array<long>")))
        met = lambda x, k: (high(x) == high(F.get("_sorted", k - 1))) | (high(x) == high(F.get("_sorted", k + 1)))
        rows = rows.withColumn("_met", F.filter("_sorted", lambda x, k: F.coalesce(met(x, k), F.lit(False)))).drop("_sorted")
        # Neighbours with the same 40 bits whose words differ
        clash = F.exists(F.sequence(F.lit(1), F.size("_met") - 1), lambda k: (high(F.get("_met", k)) == high(F.get("_met", k - 1))) & ~same(place(F.get("_met", k)), place(F.get("_met", k - 1))))
        rows = rows.withColumn("_whole", (number > mask) | F.when(F.size("_met") > 1, clash).otherwise(F.lit(False)))
        strings = F.when(F.col("_whole"), F.array_sort(F.transform(F.sequence(F.lit(0), number - 1), lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("s"), i.alias("i"))))).otherwise(F.array().cast("array<struct<s:string,i:int>>"))
        rows = rows.withColumn("_strings", strings)
        twin = lambda x, k: (x["s"] == F.get("_strings", k - 1)["s"]) | (x["s"] == F.get("_strings", k + 1)["s"])
        by_string = F.transform(F.filter("_strings", lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"])
        rows = rows.withColumn("_at", F.sort_array(F.when(F.col("_whole"), by_string).when(F.size("_met") > 0, F.transform("_met", place)).otherwise(none)))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        covered = F.aggregate("_at", start, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])
        return rows.withColumn("n_repeat_words", covered).drop("_met", "_whole", "_strings", "_at")

    return add


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc_id, host, base measures, base_failed, name, lines) of each row: name stands for host and text, lines are hashes and numbers of words."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    host = F.coalesce(F.concat(F.lit("="), F.col(f"`{host_col}`").cast("string")), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("_text"), host.alias("_host"), F.array_remove(F.split(text, BLANK), "").alias("_words"))
    full = F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("_full", full).withColumn("_lines", lines_of(F.col("_text")))
    counted = rows.select(
        "doc_id", "_words",
        F.struct(F.xxhash64("_host", "_text").alias("a"), F.xxhash64(F.lit("text"), "_text", "_host").alias("b")).alias("name"),
        F.xxhash64("_host").alias("host"),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        F.transform("_lines", lambda line: F.struct(key_of(F.col("_host"), line).alias("key"), (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("words"))).alias("lines"),
    )
    found = repeated_words("_words")(counted).drop("_words")
    return found.withColumn("base_failed", (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words")))


def occurrences(rows: DataFrame) -> DataFrame:
    """(key, host, name, words): the words that a line has in all its occurrences in a text, once for each text of a host."""
    copies = rows.groupBy("name").agg(F.count(F.lit(1)).alias("copies"))
    lines = rows.select("name", "host", F.explode("lines").alias("line"))
    # Copies of a text have the same lines, so the sum over them is a multiple of their number.
    summed = lines.groupBy(F.col("line.key").alias("key"), "name").agg(F.sum("line.words").alias("words"), F.first("host").alias("host"))
    return summed.join(copies, "name").select("key", "host", "name", (F.col("words") / F.col("copies")).cast("long").alias("words"))


def common(lines: DataFrame, rows: DataFrame, most: int, share: float) -> DataFrame:
    """(key): the lines above both limits."""
    often = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("host").alias("host")).where(F.col("n") > most)
    hosts = rows.select("host", "name").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    return often.join(hosts, "host").where(F.col("n") > share * F.col("documents")).select("key")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most: int = MOST, share: float = SHARE, rest: float = REST, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, base measures, base_failed, n_common_words, kept) of each row."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    rows = scratch.keep(measured(docs, id_col, text_col, host_col), "rows")
    lines = scratch.keep(occurrences(rows), "lines")
    gone = lines.join(common(lines, rows, most, share), "key").groupBy("name").agg(F.sum("words").alias("n_common_words"))
    out = rows.drop("lines", "host").join(gone, "name", "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0)).cast("long"))
    depleted = F.col("n_words") - F.col("n_common_words") < rest * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("name")


def clean(docs: DataFrame, text_col: str = "text", host_col: str = "source", most: int = MOST, share: float = SHARE, rest: float = REST) -> DataFrame:
    """The rows of docs that are kept, with their common lines removed from the text; what is left of a text keeps its line ends. All columns stay."""
    scratch, own = Scratch(docs.sparkSession, "lines-clean"), docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]).alias("_row"), F.monotonically_increasing_id().alias("_at"), F.col(f"`{text_col}`").cast("string").alias("_text"), F.col(f"`{host_col}`").cast("string").alias("_host"))
    whole = scratch.keep(whole, "whole")  # row numbers are settled
    rows = scratch.keep(measured(whole, "_at", "_text", "_host"), "rows")
    lines = scratch.keep(occurrences(rows), "lines")
    gone = lines.join(common(lines, rows, most, share), "key").groupBy("name").agg(F.sum("words").alias("words"), F.collect_set("key").alias("keys"))
    found = rows.where("not base_failed").select("doc_id", "name", "n_words").join(gone, "name", "left")
    kept = found.where(F.col("n_words") - F.coalesce("words", F.lit(0)) >= rest * F.col("n_words")).select(F.col("doc_id").alias("_at"), "keys")
    out = whole.join(kept, "_at")
    host = F.coalesce(F.concat(F.lit("="), F.col("_host")), F.lit(""))
    folded = lambda line: F.trim(F.regexp_replace(F.translate(line, UPPER, FOLDED), " {2,}", " "))
    left = F.array_join(F.filter(F.split("_text", "\n", -1), lambda line: ~F.array_contains("keys", key_of(host, folded(line)))), "\n")
    text = F.when(F.col("keys").isNull(), F.col("_text")).otherwise(left)
    return out.select(*[(text if c == text_col else F.col(f"_row.c{i}")).alias(c) for i, c in enumerate(own)])
