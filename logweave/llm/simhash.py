"""SimHash near-duplicates by multi-index hashing, and near duplicates by shingle sets.

Fingerprint: 64 bits over the XXH64 (seed 42) of every word shingle, repeats included. Links: fingerprints that
differ in at most `distance` (0 to 2) bits.

Index (Norouzi, Punjani and Fleet 2012): a fingerprint is cut into two segments of 32 bits, and each segment has a table from its value to the
fingerprints that have it. If two fingerprints are within 2 bits, then they are within 1 bit in the first segment or alike in the
second (within 1 bit: alike in one of the two). So each fingerprint enumerates a ball of 1 bit around its first segment and of 0 bits
around its second, fetches what the tables hold there, and is verified against each by the complete distance. Of two values a bit
apart only the one with the bit set looks for the other.

Hot entries: a table entry of more than HOT fingerprints is not fetched, since pairs within it would be a square. All fingerprints that ask for such
an entry, or are in it, instead meet under every value that is at most 1 bit away from them, whole: two within 2 bits meet at the value between them. Such an entry holds
at most 65 fingerprints, all within two bits of each other, so it is enough to link each to the least. Both ways are exact; nothing is capped.

Cases: a null or blank text has no words and gets fingerprint zero, linked like any other. Fewer words than a
shingle: the whole sequence is one shingle. Copies share a fingerprint and so a component. A null id is kept as a
row; it takes part in links but never names a component unless all ids in it are null. Repeated rows give repeated rows.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.shared import slices, utf8
from logweave.operators.graph import connected_components
from logweave.session import Scratch

PIECE = 1 << 18
COMMON = 100_000
HOT = 64
SIEVE = 23
MET = 1 << 16


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text; A-Z are lower-cased, words are split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(seed))
    ones = np.zeros(64, np.int64)
    left = n
    while left:
        step = min(left, PIECE)
        h = np.fromiter(hashes, np.uint64, step)
        ones += np.unpackbits(h.view(np.uint8).reshape(step, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        left -= step
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.large_binary())
            found = np.fromiter((fingerprint(b"" if (t := x.as_py()) is None else t, width) for x in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def tables(reps: DataFrame) -> DataFrame:
    """(place, fp): the entry of each fingerprint in the table of each of its two segments."""
    return reps.select("fp", F.explode(F.expr("array(struct(0 as segment, shiftrightunsigned(fp, 32) as value), struct(1 as segment, fp & 4294967295L as value))")).alias("place"))


def balls(reps: DataFrame, distance: int) -> DataFrame:
    """(place, fp): where each fingerprint looks for others: within 1 bit of its first segment (at distance 2) and at its second.

    Of neighbouring values, the one with the bit set asks."""
    first = "shiftrightunsigned(fp, 32)"
    ball = f"transform(filter(sequence(0, 31), i -> {first} & shiftleft(1L, i) != 0), i -> struct(0 as segment, {first} ^ shiftleft(1L, i) as value))" if distance == 2 else "cast(array() as array<struct<segment:int,value:bigint>>)"
    return reps.select("fp", F.explode(F.expr(f"concat(array(struct(0 as segment, {first} as value), struct(1 as segment, fp & 4294967295L as value)), {ball})")).alias("place"))


def fetched(reps: DataFrame, distance: int, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """((fp, members): what each fingerprint fetches from entries of up to `hot` members; (fp): those that meet larger entries)."""
    entries, asked = tables(reps), balls(reps, distance)
    large = entries.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("place")
    small = entries.join(large, "place", "left_anti").groupBy("place").agg(F.collect_list("fp").alias("members"))
    return asked.join(small, "place").select("fp", "members"), asked.join(large, "place", "left_semi").select("fp").distinct()


def links(reps: DataFrame, distance: int = 2, hot: int = HOT) -> DataFrame:
    """(src, dst): fingerprints of `reps` (column fp, distinct) in the same component are joined by these links."""
    if distance not in (0, 1, 2):
        raise ValueError("distance is 0, 1 or 2")
    if not distance:
        return reps.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0)
    fetch, meet = fetched(reps, distance, hot)
    pairs = fetch.select(F.col("fp").alias("src"), F.explode(F.expr(f"filter(members, m -> m != fp and bit_count(m ^ fp) <= {distance})")).alias("dst"))
    around = "transform(sequence({0}, {1}), i -> fp ^ shiftleft(1L, i))"
    entries = meet.select("fp", F.explode(F.expr(f"concat(array(fp), {around.format(0, 31)}, {around.format(32, 63)})")).alias("entry"))
    if distance == 1:  # an entry's members may be two bits apart: the entry itself must be a member
        near = entries.join(meet.select(F.col("fp").alias("dst")), F.col("entry") == F.col("dst")).select(F.col("fp").alias("src"), "dst")
    else:
        near = entries.select(F.col("fp").alias("src"), F.expr("min(fp) over (partition by entry)").alias("dst"))
    return pairs.unionByName(near.where((F.col("src") != F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= distance)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the smallest id that links lead to, its own included."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, id_col, text_col, width), "prints")
    reps = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    labels = connected_components(links(reps, distance), scratch)
    rooted = reps.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = scratch.keep(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = scratch.keep(rooted.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def rooted(prints: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, fp, root) for each row of prints: root is the fingerprint that stands for the component."""
    labels = connected_components(edges, scratch)
    return prints.select("doc_id", "fp").join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))


def one_of_each(docs: DataFrame, found: DataFrame, prints_of: Callable[[DataFrame, str], DataFrame], scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs of which one stays for each component of `found` (doc_id, fp, root): that with the smallest id, then the least fingerprint.

    A row is known by its id where no other row has it. Rows whose id is null or repeated are known by id and fingerprint,
    which `prints_of(rows, id column)` makes again for these rows alone.
    """
    own = docs.columns
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "fp")).alias("m")
    stay = scratch.keep(found.groupBy("root").agg(first).select("m.doc_id", "m.fp"), "stay")
    rows = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_times"))
    named = scratch.keep(rows.join(stay.where("doc_id is not null").select("doc_id").distinct(), "doc_id").withColumnRenamed("doc_id", "_key"), "named")
    # One plan at every size: rows go to their id's partition once, whether or not the ids would fit a broadcast today. A row's own columns stay apart under numbers.
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"))
    whole = [F.col(f"_row.c{i}").alias(c) for i, c in enumerate(own)]
    kept = packed.join(named.hint("shuffle_hash"), F.col("_id") == F.col("_key")).drop("_key")
    out = kept.where("_times = 1").select(whole)
    if named.where("_times > 1").isEmpty() and stay.where("doc_id is null").isEmpty():
        return out
    shared = kept.where("_times > 1").select("_row", "_id").unionByName(packed.where("_id is null"))
    shared = scratch.keep(shared.select("_row", "_id", F.col(f"_row.c{own.index(text_col)}").alias("_text"), F.monotonically_increasing_id().alias("_at")), "shared")
    made = prints_of(shared.select("_at", F.col("_text").alias(text_col)), "_at").select(F.col("doc_id").alias("_at"), "fp")
    marked = shared.join(made, "_at").join(stay.withColumnRenamed("fp", "_fp"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("fp") == F.col("_fp")))
    chosen = marked.groupBy("_id", "fp").agg(F.min_by("_row", F.struct(F.xxhash64("_text"), "_at")).alias("_row"))
    return out.unionByName(chosen.select(whole))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """The rows of docs of which one stays for each component of fingerprints within `distance` bits. All columns are kept."""
    scratch = Scratch(docs.sparkSession, "simhash-drop")
    prints_of = lambda rows, key: fingerprints(rows, key, text_col, width)
    prints = scratch.keep(prints_of(docs, id_col), "prints")
    found = scratch.keep(rooted(prints, links(prints.select("fp").distinct(), distance), scratch), "rooted")
    return one_of_each(docs, found, prints_of, scratch, id_col, text_col)


def shingles(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """The different XXH64 of a text's word shingles, ascending; words as for `fingerprint`."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64))


def shingle_prints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, fp): fp is a hash of the set of shingles; one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20, lean=True):
            prints = np.fromiter((print_of(shingles(t, width)) for t in utf8(batch.column("text"))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, fp long")


def both_prints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, fp, sim): `shingle_prints` with each text's SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20, lean=True):
            made = [(print_of(shingles(t, width)), fingerprint(t)) for t in utf8(batch.column("text"))]
            fps, sims = (np.array([m[0] for m in made], np.int64), np.array([m[1] for m in made], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), pa.array(sims)], ["doc_id", "fp", "sim"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, fp long, sim long")


def simhash_links(prints: DataFrame, distance: int, scratch: Scratch) -> DataFrame:
    """(src, dst): set fingerprints `fp` of texts whose SimHashes `sim` are in one component, each linked to the least of them."""
    sims = scratch.keep(prints.select("fp", "sim").distinct(), "sims")
    labels = connected_components(links(sims.select(F.col("sim").alias("fp")).distinct(), distance), scratch)
    named = scratch.keep(sims.join(labels.withColumnRenamed("node", "sim"), "sim", "left").select("fp", F.coalesce("root", "sim").alias("root")).distinct(), "sim-rooted")
    least = named.groupBy("root").agg(F.min("fp").alias("dst"))
    return scratch.keep(named.join(least, "root").where("fp != dst").select(F.col("fp").alias("src"), "dst").distinct(), "sim-links")


def print_of(shingle_set: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingle_set.tobytes())).view(np.int64))


def sets_of(texts: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """(fp, set) of the texts whose fp is among `wanted` (fp), once for each fp. Sets are made anew in a pass over the texts, which costs less than to keep and move them all:
    only those whose hash is in a sieve of 2^SIEVE bits leave the tasks."""
    slot = F.pmod(F.xxhash64("fp"), F.lit(1 << SIEVE))
    marks = np.zeros(1 << SIEVE, bool)
    marks[wanted.select(slot.alias("slot")).distinct().toArrow().column(0).to_numpy()] = True  # at most 2^SIEVE numbers
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, met = np.unpackbits(shared.value).view(bool), set()
        for batch in slices(batches, "text", 2 << 20, lean=True):
            fps, sets = [], []
            for t in utf8(batch.column("text")):
                s = shingles(t, width)
                fp = print_of(s)
                if bits[slot_of(fp)] and fp not in met:
                    if len(met) < MET:
                        met.add(fp)
                    fps.append(fp)
                    sets.append(s)
            if fps:
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["fp", "set"])

    found = texts.mapInArrow(run, "fp long, set array<long>")
    return found.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.first("set").alias("set"))


def slot_of(fp: int) -> int:
    """What `sets_of` makes of a fingerprint in SQL: its XXH64 with seed 42, modulo the size of the sieve."""
    return xxhash.xxh64_intdigest(fp.to_bytes(8, "little", signed=True), 42) & ((1 << SIEVE) - 1)


def prefixes(texts: DataFrame, width: int, similarity: float, common: np.ndarray, some: bool = False) -> DataFrame:
    """(shingle, fp, n, pos): the first shingles of each set in the order `common` last, then by hash, of which two sets of at least `similarity` share one; pos: how many of the set come before.
    some: whole sets, of a sixteenth of them only; copies may come more than once."""
    shared = texts.sparkSession.sparkContext.broadcast(np.sort(common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = shared.value, set()
        for batch in slices(batches, "text", 2 << 20, lean=True):
            taken, parts = [], []
            for t in utf8(batch.column("text")):
                s = shingles(t, width)
                fp = print_of(s)
                if fp in met or (some and slot_of(fp) % 16):  # a copy: its entries are there
                    continue
                if len(met) < MET:
                    met.add(fp)
                size = len(s)
                s = s.view(np.int64)
                n = size if some else min(size, size - math.ceil(similarity * size - 1e-9) + 1)
                if len(last):
                    at = np.searchsorted(last, s)
                    late = last[np.minimum(at, len(last) - 1)] == s
                    s = np.concatenate([s[~late], s[late]])
                if size:
                    taken.append((fp, size, n))
                    parts.append(s[:n])
            if taken:
                fps, sizes, n = (np.array(x) for x in zip(*taken, strict=True))
                columns = [pa.array(np.concatenate(parts), pa.int64()), pa.array(np.repeat(fps, n), pa.int64()), pa.array(np.repeat(sizes, n).astype(np.int32), pa.int32())]
                columns.append(pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n]), pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, ["shingle", "fp", "n", "pos"])

    found = texts.mapInArrow(run, "shingle long, fp long, n int, pos int")
    return found if some else found.dropDuplicates(["shingle", "fp"])


def common_shingles(texts: DataFrame, width: int, similarity: float) -> np.ndarray:
    """Shingles that stand in many sets, counted on a sixteenth of them, whole: what comes first in a set when its common shingles go last must not be common as well. They only set the
    order of shingles, so any choice gives the same pairs."""
    counted = prefixes(texts, width, similarity, np.zeros(0, np.int64), some=True).groupBy("shingle").agg(F.count(F.lit(1)).alias("times"))
    return counted.where("times >= 8").orderBy(F.col("times").desc(), "shingle").limit(COMMON).select("shingle").toArrow().column(0).to_numpy()


def similar_links(texts: DataFrame, width: int, similarity: float, scratch: Scratch, known: DataFrame | None = None) -> DataFrame:
    """(src, dst): all pairs of fingerprints of sets with a Jaccard similarity of at least `similarity`, but for pairs in the same component already.

    Prefix filter: in any fixed order of all shingles, two such sets share one of their first n - ceil(similarity * n) + 1. Pairs meet at shared
    prefix shingles, pass bounds from their sizes and the number of those, and are verified by their whole sets. Each set is verified
    against those that it meets most in its size band first, one of them with the fewest shingles of its own: such a one is in the middle of a group of near copies. Then only pairs whose components still differ are made,
    so that a large group of near copies is no square.

    What two sets share before a shingle that both prefixes have stands in both prefixes, so it is live there (in more than one prefix): they share at most the fewer of their live shingles before it, itself, and the fewer
    of all after it. A set in which too many are not live before a shingle is too far from all sets of its size there, so that most members of a group that are like none of the others go before pairs are made.
    known: links that are found already; they are among the result.
    """
    share = similarity / (1 + similarity)
    met = prefixes(texts, width, similarity, common_shingles(texts, width, similarity)).select("*", F.expr("min(fp) over (partition by shingle)").alias("lo"), F.expr("max(fp) over (partition by shingle)").alias("hi"))
    # ahead: live shingles before this one; rest: all after it; own: those of the prefix that are not live.
    own = f"n - ceil({similarity!r}D * n - 1e-9) + 1 - count(*) over (partition by fp)"
    live = met.where("lo != hi").selectExpr("shingle", "fp", "n", "row_number() over (partition by fp order by pos) - 1 as ahead", "n - pos - 1 as rest", f"{own} as own")
    live = scratch.keep(live, "live")

    def likely(rows: DataFrame) -> DataFrame:
        """Pairs that can be alike: what is shared lies in both prefixes, or behind the prefix that ends first."""
        rows = rows.where(f"least(n, m) >= {similarity!r} * greatest(n, m) - 1e-6").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), F.first("m").alias("m"))
        return rows.where(f"times + ceil({similarity!r}D * greatest(n, m) - 1e-9) - 1 >= {share!r} * (n + m) - 1e-6")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.keep(pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), name)
        ends = pairs.select(F.col("src").alias("fp")).unionByName(pairs.select(F.col("dst").alias("fp"))).distinct()
        needed = scratch.keep(sets_of(texts, width, scratch.keep(ends, "ends")), "needed")
        both = pairs.join(needed.select(F.col("fp").alias("src"), F.col("set").alias("a")), "src").join(needed.select(F.col("fp").alias("dst"), F.col("set").alias("b")), "dst")
        both = both.withColumn("inside", F.size(F.array_intersect("a", "b")))
        return scratch.keep(both.where(F.col("inside") >= similarity * (F.size("a") + F.size("b") - F.col("inside")) - 1e-9).select("src", "dst"), "links")

    # Bands of sizes that may be alike, and the same shifted by half a band, so that members beside a bound share one of the two.
    step = math.log(1 / similarity) if similarity < 1 else 1e-9
    bands = live.withColumn("band", F.explode(F.array(F.floor(F.log("n") / step) * 2, F.floor(F.log("n") / step + 0.5) * 2 + 1)))

    def star(first: str) -> DataFrame:
        """(src, dst): each set with the one that it meets most among the least of each shingle and band, in the order of these columns."""
        found = bands.select("shingle", F.col("fp").alias("src"), "n", F.expr(f"min(struct({first})) over (partition by shingle, band)").alias("c"))
        found = found.select("shingle", "src", "n", F.col("c.fp").alias("dst"), F.col("c.n").alias("m")).where("src != dst").distinct()
        return likely(found).groupBy("src").agg(F.max(F.struct("times", "dst")).alias("c")).select("src", F.col("c.dst").alias("dst"))

    near = verified(star("fp, n").unionByName(star("own, fp, n")), "star")
    if known is not None:
        near = near.unionByName(known)
    roots = connected_components(near, scratch)
    live = live.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # most: the size of the largest set that one with so many shared shingles at most can be like; only rows whose shingle a set up to that size has as well can meet.
    live = live.withColumn("most", F.expr(f"(ahead + 1 + rest + 1e-6) / {share!r}D - n")).where(f"most >= {similarity!r}D * n - 1e-6")
    live = live.withColumn("least", F.expr("min(n) over (partition by shingle)")).where("least <= most")
    live = live.withColumns({"lo": F.expr("min(root) over (partition by shingle)"), "hi": F.expr("max(root) over (partition by shingle)")}).where("lo != hi").drop("least", "lo", "hi", "own")
    live = scratch.keep(live, "live-rooted")
    one = live.select("shingle", F.col("fp").alias("src"), "n", "root", "ahead", "rest", "most")
    two = live.select("shingle", F.col("fp").alias("dst"), F.col("n").alias("m"), F.col("root").alias("far"), F.col("ahead").alias("ahead_"), F.col("rest").alias("rest_"), F.col("most").alias("most_"))
    bound = f"least(ahead, ahead_) + 1 + least(rest, rest_) >= {share!r}D * (n + m) - 1e-6"
    return near.unionByName(verified(likely(one.join(two, "shingle").where(f"root < far and m <= most and n <= most_ and {bound}")), "cross"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, distance: int | None = None) -> DataFrame:
    """The rows of docs of which one stays for each component of texts whose shingle sets have a Jaccard similarity of at least `similarity`.

    All such pairs are found (see `similar_links`). distance: texts whose SimHashes (three words) differ in at most that many bits are linked as well, by the segment tables
    of `links`, and what they link is not met again. Texts without words are alike. All columns are kept.
    """
    scratch, work = Scratch(docs.sparkSession, "similar-drop"), Scratch(docs.sparkSession, "similar-work")
    prints = scratch.keep((shingle_prints if distance is None else both_prints)(docs, id_col, text_col, width), "prints")
    known = None if distance is None else simhash_links(prints, distance, work)
    found = similar_links(docs.select(F.col(f"`{text_col}`").alias("text")), width, similarity, work, known)
    edges = scratch.keep(found, "links")
    work.drop()
    found = scratch.keep(rooted(prints, edges, scratch), "rooted")
    return one_of_each(docs, found, lambda rows, key: shingle_prints(rows, key, text_col, width), scratch, id_col, text_col)
