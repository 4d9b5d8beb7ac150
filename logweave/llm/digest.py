"""Document fingerprints: canonical exact digest, in DataFrame functions only.

Canonical text: Unicode normalisation (NFKC), full case folding, normalisation again, white space runs as one space, ends
trimmed. Fingerprint: two chained XXH64 of the canonical text, 128 bits as 32 hex digits. Texts with equal
canonical text have equal fingerprints.

Groups: rows are counted by fingerprint, without their texts. Only where a fingerprint has several rows are their canonical texts grouped by bytes, so a
bucket falls into as many groups as it has different texts, equal fingerprints or not. A group is known to its rows by fingerprint and
SHA-512, of which it is checked that no two groups share them. Every aggregation is partial before the shuffle, so a group with a third of all rows
is one row a task. `likeness` compares the canonical bytes of two texts with equal fingerprints.

The normalisation and folding are static methods of ICU, which Spark carries for its collations, called by the SQL
function `reflect`; they run in the JVM, row by row, like any built-in function.

Cases: a null text counts as empty. Empty and blank texts share the fingerprint of the empty text. Very long texts are hashed whole.
Null ids, repeated rows and extra columns pass. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.session import Scratch

BUCKET_ROWS = 2048
MOST_BUCKETS = 1 << 16
SAMPLED = 16
SIEVE = 1 << 20


def canonical(text: Column) -> Column:
    """The canonical text of a column; null counts as empty."""
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(compose(fold(compose(whole))), r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def fingerprint(canonical_text: Column) -> Column:
    """32 hex digits: XXH64 of the text, and XXH64 of the text seeded by a first hash."""
    part = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(part(F.xxhash64(canonical_text)), part(F.xxhash64(F.lit("logweave"), canonical_text)))


def buckets(prints: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fingerprint, name, copies, first_id) of the groups of equal canonical text in buckets of several rows.

    prints: a row with the fingerprint of each row of docs. The texts of such buckets are grouped by their bytes."""
    several = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), canonical(F.col(f"`{text_col}`")).alias("_canon"))
    # Most texts have no copy; they are held back by a hash of the fingerprint before texts are shuffled: at most SIEVE integers go to every task.
    slot = F.pmod(F.hash("fingerprint"), F.lit(SIEVE)).alias("slot")
    sieve = several.select(slot).distinct()
    likely = texts.withColumn("fingerprint", fingerprint(F.col("_canon"))).withColumn("slot", slot).join(F.broadcast(sieve), "slot", "left_semi").drop("slot")
    inside = likely.join(several, "fingerprint", "left_semi")
    same = inside.groupBy("fingerprint", "_canon").agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("first_id"))
    named = same.select("fingerprint", digest(F.col("_canon")).alias("name"), "copies", "first_id")
    clash = F.assert_true(F.count(F.lit(1)) == 1, F.lit("two texts share fingerprint and SHA-512"))
    return named.groupBy("fingerprint", "name").agg(F.sum("copies").alias("copies"), F.min("first_id").alias("first_id"), clash.alias("clash")).drop("clash")


def digest(canonical_text: Column) -> Column:
    return F.unhex(F.sha2(canonical_text, 512))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with fingerprint, copies (rows with the same canonical text) and first_id (the smallest id among them)."""
    own = docs.columns
    canon = canonical(F.col(f"`{text_col}`"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), canon.alias("_canon"))
    keyed = keyed.select("_row", "_id", fingerprint(F.col("_canon")).alias("fingerprint"), digest(F.col("_canon")).alias("name"))
    found = joined(keyed, buckets(keyed.select("fingerprint"), docs, id_col, text_col), "_id")
    return found.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(own) if c not in ("fingerprint", "copies", "first_id")], "fingerprint", "copies", "first_id")


def joined(rows: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """rows (fingerprint, name, ...) with copies and first_id; a row in no bucket of several is its own group."""
    return rows.join(found, ["fingerprint", "name"], "left").withColumn("first_id", F.when(F.col("copies").isNull(), F.col(id_col)).otherwise(F.col("first_id"))).withColumn("copies", F.coalesce("copies", F.lit(1)).cast("long"))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text): the text of the next row in descending order of the id; after the last comes the first.

    Ties in the id are ordered by the hash of the text, then the text; null ids come last. Rows are dealt, in this order, into buckets of about BUCKET_ROWS rows (of more, where there
    would be over MOST_BUCKETS: a bucket is sorted on disk if need be). The bounds are pairs of id and hash, taken from ids and hashes alone, so rows that share an id, or have none,
    are split as well; only rows alike in id and text stay together. Texts are shuffled once, by bucket; the head of
    each bucket goes to the bucket before it as well, so that every row finds the next one in its own bucket.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # Larger keys come first: ids present before null ones, larger ids, smaller hashes.
    keyed = rows.withColumn("key", F.struct(F.col("doc_id").isNotNull().alias("p"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.bitwise_not(F.xxhash64("text")).alias("h")))
    bucketed = keyed.withColumn("bucket", bucket_of(F.col("key"), bounds_of(keyed.select("key"))))
    # Heads: at most a row for each bucket.
    tops = bucketed.groupBy("bucket").agg(F.max("key").alias("top")).orderBy(F.col("bucket").desc()).collect()
    if not tops:
        return rows.withColumn("next_text", F.lit(None).cast("string"))
    filled = [r["bucket"] for r in tops]
    giver = [(r["bucket"], r["top"], filled[k - 1]) for k, r in enumerate(tops)]  # the head of the k-th follows the (k-1)-th; that of the first, the last
    given = spark.createDataFrame(giver, "bucket int, top struct<p:boolean,i:long,h:long>, to int")
    heads = bucketed.join(F.broadcast(given), (bucketed["bucket"] == given["bucket"]) & (F.col("key") == F.col("top")))
    heads = heads.groupBy("to").agg(F.min("text").alias("text")).select(F.col("to").alias("bucket"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("struct<p:boolean,i:long,h:long>").alias("key"))
    both = bucketed.select("bucket", "doc_id", "text", "key").unionByName(heads)
    following = F.lead("text").over(Window.partitionBy("bucket").orderBy(F.col("key").desc_nulls_last(), "text"))  # heads of other buckets, without a key, are last
    return both.withColumn("next_text", following).where(F.col("key").isNotNull()).select("doc_id", "text", "next_text")


def bounds_of(keys: DataFrame) -> list[tuple[bool, int, int]]:
    """Ascending keys that cut the rows into buckets: every SAMPLED-th of a sample. They decide where rows go, not what comes out."""
    number = keys.count()
    wanted = min(MOST_BUCKETS, number // BUCKET_ROWS)
    if wanted < 2:
        return []
    share = min(1.0, SAMPLED * wanted / number)
    hashed = F.pmod(F.xxhash64(F.col("key.i"), F.col("key.h"), F.lit("deal")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    # SAMPLED * MOST_BUCKETS keys at most, three numbers each
    nth = keys.where(hashed).distinct().withColumn("part", F.ntile(wanted).over(Window.orderBy("key")))
    found = nth.groupBy("part").agg(F.min("key").alias("key")).where("part > 1").orderBy("part").collect()
    return [(r["key"]["p"], r["key"]["i"], r["key"]["h"]) for r in found]


def literal(bound: tuple[bool, int, int]) -> Column:
    return F.struct(F.lit(bound[0]).alias("p"), F.lit(bound[1]).cast("long").alias("i"), F.lit(bound[2]).cast("long").alias("h"))


def bucket_of(value: Column, bounds: list[tuple[bool, int, int]]) -> Column:
    """How many bounds are not above the value, by binary search in nested conditions."""
    if not bounds:
        return F.lit(0)
    if len(bounds) <= 256:
        return _search(value, bounds, 0, len(bounds))
    step = -(-len(bounds) // 256)
    coarse = bounds[step - 1 :: step]
    inner = F.array(*[F.array(*map(literal, bounds[k : k + step])) for k in range(0, len(bounds), step)])
    part = bucket_of(value, coarse)
    empty = F.array().cast("array<struct<p:boolean,i:long,h:long>>")
    return part * step + F.size(F.filter(F.coalesce(F.get(inner, part), empty), lambda b: b <= value))


def _search(v: Column, bounds: list[tuple[bool, int, int]], low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(v >= literal(bounds[middle]), _search(v, bounds, middle + 1, high)).otherwise(_search(v, bounds, low, middle))


def likeness(a: Column, b: Column, canon_a: Column, canon_b: Column) -> Column:
    """An exact digest is like another or not: 1 for equal fingerprints of equal canonical bytes, else 0."""
    return F.when((a == b) & (canon_a == canon_b), F.lit(1.0)).otherwise(F.lit(0.0))


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint against that of its edited text and of the next row's text; and its group: copies and first_id."""
    scratch = Scratch(docs.sparkSession, "digest")
    rows = neighbours(docs, id_col, text_col)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("next_text").substr(F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("c"), canonical(F.col("edited")).alias("ce"), canonical(F.col("next_text")).alias("cn"))
    rows = rows.select("*", fingerprint(F.col("c")).alias("fingerprint"), fingerprint(F.col("ce")).alias("edited_fingerprint"), fingerprint(F.col("cn")).alias("fn"))
    rows = scratch.keep(rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), F.col("c"), F.col("ce")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("fn"), F.col("c"), F.col("cn")).alias("near_next"),
        digest(F.col("c")).alias("name"),
    ), "edits")
    return joined(rows, buckets(rows.select("fingerprint"), docs.withColumn("_long", F.col(f"`{id_col}`").cast("long")), "_long", text_col), "doc_id").drop("name")
