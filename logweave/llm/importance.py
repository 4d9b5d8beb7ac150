"""Importance resampling towards a target distribution, by a dictionary of distinct features.

Words: runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case. Features: all runs of one to three consecutive
words, joined by one space, repeats counted. A feature's bucket is the CRC-32 of its bytes modulo `buckets`.

Dictionary: every block of texts (BLOCK bytes, one text at least) counts its distinct feature strings. The strings are dealt, packed and compressed, into shards of a
size that a task can hold, where the counts of equal strings meet; so each string of the whole table is hashed once, and its count goes to its
bucket. A shard depends on a string's first two words, so a frequent word spreads over all of them, and a string that stands everywhere is one entry a block.

Gains: floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))), from the bucket's count s of S in all documents and t of T in the target.
They are joined to each document's features through the distinct strings of its block. The weight is the sum over all features. The score adds Gumbel noise that is fixed by
seed and id. Of the N documents with at least `least` words the share * N highest scores are drawn; ranks come from a range partitioning and the sizes of its parts.

Cases: a null text has no words. A document without words has weight 0 and is never drawn. A null id counts as an empty text in the
noise, and comes after all others among equal scores. Repeated rows are drawn one by one; rows alike in id and score follow in the order in which they
were written. Very long texts are cut into words piece by piece. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.shared import slices, utf8
from logweave.session import Scratch

BUCKETS = 10_000
BLOCK, PIECE = 12 << 20, 4 << 20
FINER = 2
LONGEST = 3

#: Every byte as it counts in words: A-Z in lower case, separators as a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end between words."""
    start = 0
    while len(text) - start > PIECE:
        end = text.find(b" ", start + PIECE)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


class Block:
    """The words of some texts as numbers, and their runs."""

    def __init__(self, texts: list[bytes]):
        numbers, found, sizes = defaultdict(count().__next__), [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            for piece in pieces(text.translate(LETTERS)):
                ids = np.fromiter(map(numbers.__getitem__, piece.split()), np.int64)
                sizes[i] += len(ids)
                found.append(ids)
        self.ids, self.sizes = np.concatenate([np.zeros(0, np.int64), *found]), sizes
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        self.words = list(numbers)

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, text) of every run of so many words: equal runs have equal keys."""
        n = len(self.ids) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = self.owner[:n] == self.owner[length - 1 :]
        base, key = max(1, len(self.words)), self.ids[:n]
        for k in range(1, length):
            if k == 2 and base >= 1 << 21:  # three numbers of more bits don't fit one
                self.pairs, key = np.unique(key, return_inverse=True)
            key = key * base + self.ids[k : n + k]
        return key[inside], self.owner[:n][inside]

    def numbers(self, keys: np.ndarray, length: int) -> list[np.ndarray]:
        """The words of runs, as a list of arrays."""
        base, out = max(1, len(self.words)), []
        for k in range(length - 1, 0, -1):
            keys, last = np.divmod(keys, base)
            out.append(last)
            if k == 2 and base >= 1 << 21:
                keys = self.pairs[keys]
        return [keys, *out[::-1]]

    def heads(self, keys: np.ndarray) -> np.ndarray:
        """The keys of the first two words of runs of three."""
        base = max(1, len(self.words))
        return self.pairs[keys // base] if base >= 1 << 21 and len(keys) else keys // base


class Hashes:
    """CRC-32 of words, and of words joined by a space: the CRC of a whole follows from those of its parts and their lengths, so the bytes of a word are read once."""

    #: What a CRC becomes when so many zero bytes follow: by number of bytes (up to LONG), place and value of a byte of the CRC.
    LONG = 255

    def __init__(self, words: list[bytes]):
        one = np.array([zlib.crc32(bytes([v])) for v in range(256)], np.uint32) ^ np.uint32(zlib.crc32(b"\0"))  # linear in the byte
        after = lambda c: (c >> np.uint32(8)) ^ one[c & np.uint32(255)]
        table = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
        for _ in range(self.LONG):
            table.append(after(table[-1]))
        self.table = np.stack(table)
        self.words = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        self.sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        space = np.full(len(words), zlib.crc32(b" "), np.uint32)
        self.spaced = self.shifted(space, self.sizes - 1) ^ self.words

    def shifted(self, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        n = np.minimum(size, self.LONG)
        out = self.table[n, 0, crc & 255] ^ self.table[n, 1, crc >> 8 & 255] ^ self.table[n, 2, crc >> 16 & 255] ^ self.table[n, 3, crc >> 24]
        more = size > self.LONG
        if more.any():
            out[more] = self.shifted(out[more], size[more] - self.LONG)
        return out

    def of(self, numbers: list[np.ndarray]) -> np.ndarray:
        """The CRC of strings, given as the numbers of their words."""
        crc = self.words[numbers[0]]
        for n in numbers[1:]:
            crc = self.shifted(crc, self.sizes[n]) ^ self.spaced[n]
        return crc


def packed(words: list[bytes], columns: list[np.ndarray]) -> tuple[bytes, bytes, list[int]]:
    """Words, and columns of small numbers, as compressed bytes."""
    numbers = np.concatenate(columns).astype(np.uint32)
    return zstandard.compress(b" ".join(words), 3), zstandard.compress(numbers.tobytes(), 3), [len(c) for c in columns]


def unpacked(words: bytes, numbers: bytes, sizes: list[int]) -> tuple[list[bytes], list[np.ndarray]]:
    flat = np.frombuffer(zstandard.decompress(numbers), np.uint32).astype(np.int64)
    return zstandard.decompress(words).split(b" "), np.split(flat, np.cumsum(sizes)[:-1])


def by_shard(shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shard, its places), ascending both."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-2)) if len(shard) else np.zeros(1, np.int64)
    return [(int(shard[order[i]]), order[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def dictionary(texts: DataFrame, shards: int) -> DataFrame:
    """(shard, words, numbers, sizes): the distinct features of each block of texts (column text) with their counts.

    A run of three words goes with its first two. A shard of a block holds its different words once, single words with counts, pairs as two words with counts, and
    triples as a pair and a word with counts; firsts of pairs and pairs of triples ascend and are kept as differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK):
            block = Block(utf8(batch.column("text")))
            if not len(block.ids):
                continue
            hashes = Hashes(block.words)
            found = [np.unique(block.runs(k)[0], return_counts=True) for k in range(1, LONGEST + 1)]
            one, (a, b), (_, _, third) = (block.numbers(keys, k + 1) for k, (keys, _) in enumerate(found))
            pair_of = np.searchsorted(found[1][0], block.heads(found[2][0]))
            deal = lambda crc: (crc * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % shards
            pair_shard = deal(hashes.of([a, b]).astype(np.uint64))
            parts = [dict(by_shard(x)) for x in (deal(hashes.words.astype(np.uint64)[one[0]]), pair_shard, pair_shard[pair_of])]
            none, place, rank = np.zeros(0, np.int64), np.zeros(len(block.words), np.int64), np.zeros(len(found[1][0]), np.int64)
            rows = []
            for shard in sorted(set().union(*parts)):
                singles, pairs, triples = (x.get(shard, none) for x in parts)
                ids = [one[0][singles], a[pairs], b[pairs], third[triples]]
                seen = np.unique(np.concatenate(ids))
                place[seen] = np.arange(len(seen))
                rank[pairs] = np.arange(len(pairs))
                ids = [place[x] for x in ids]
                columns = [ids[0], found[0][1][singles], np.diff(ids[1], prepend=0), ids[2], found[1][1][pairs], np.diff(rank[pair_of[triples]], prepend=0), ids[3], found[2][1][triples]]
                rows.append((shard, *packed([block.words[i] for i in seen.tolist()], columns)))
            shard, words, numbers, sizes = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(words, pa.binary()), pa.array(numbers, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))], ["shard", "words", "numbers", "sizes"])

    return texts.select("text").mapInArrow(run, "shard int, words binary, numbers binary, sizes array<int>")


class Shard:
    """Merges the parts of a shard: equal strings meet, each is hashed once, and its count goes to its bucket."""

    def __init__(self) -> None:
        self.numbers, self.rows = defaultdict(count().__next__), ([], [], [])

    def add(self, words: bytes, numbers: bytes, sizes: list[int]) -> None:
        own, (one, one_n, first, second, pair_n, pair, third, triple_n) = unpacked(words, numbers, sizes)
        ids = np.fromiter(map(self.numbers.__getitem__, own), np.int64, len(own))
        a, b, at = ids[np.cumsum(first)], ids[second], np.cumsum(pair)
        for rows, columns in zip(self.rows, ((ids[one], one_n), (a, b, pair_n), (a[at], b[at], ids[third], triple_n)), strict=True):
            rows.append(columns)

    def close(self, total: np.ndarray) -> None:
        hashes, base = Hashes(list(self.numbers)), max(1, len(self.numbers))
        for rows in self.rows:
            *words, n = (np.concatenate(c) for c in zip(*rows, strict=True))
            rows.clear()
            order = np.lexsort(words[::-1]) if base >= 1 << 21 else np.argsort(sum(w * base ** (len(words) - 1 - k) for k, w in enumerate(words)))
            words = [w[order] for w in words]
            cuts = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([w[1:] != w[:-1] for w in words])])) if len(n) else np.zeros(0, np.int64)
            if len(cuts):
                crc = hashes.of([w[cuts] for w in words])
                np.add.at(total, crc.astype(np.int64) % len(total), np.add.reduceat(n[order], cuts))


def totals(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (column text) each bucket holds."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a partition come by shard; one shard is held at a time."""
        total, held, at = np.zeros(buckets, np.int64), Shard(), None
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != at and at is not None:
                    held.close(total)
                    held = Shard()
                at = row["shard"]
                held.add(row["words"], row["numbers"], row["sizes"])
        if at is not None:
            held.close(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], ["bucket", "n"])

    dealt = dictionary(texts, parts * FINER).repartition(parts, "shard").sortWithinPartitions("shard")
    summed = dealt.mapInArrow(merge, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The gain of each bucket, rounded down."""
    buckets, big_t, big_s = len(raw), float(target.sum()), float(raw.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (big_s + buckets) / ((s + 1.0) * (big_t + buckets)))) for t, s in zip(map(float, target), map(float, raw), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, buckets = shared.value.astype(np.float64), len(shared.value)
        for batch in slices(batches, "text", BLOCK):
            block = Block(utf8(batch.column("text")))
            hashes, number, weight = Hashes(block.words), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for length in range(1, LONGEST + 1):
                keys, owner = block.runs(length)
                if not len(keys):
                    continue
                different, which = np.unique(keys, return_inverse=True)
                worth = gain[hashes.of(block.numbers(different, length)).astype(np.int64) % buckets]
                number += np.bincount(owner, minlength=batch.num_rows)
                weight += np.bincount(owner, weights=worth[which], minlength=batch.num_rows)  # whole numbers: exact
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(block.sizes), pa.array(number), pa.array(weight.astype(np.int64))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(doc_id, seed: int):
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of the SHA-256 of seed and id."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (doc_id, score, at, ...) with place: 1 for the highest score, ties to the smaller doc_id. No task holds more than its range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("at").asc()]
    dealt = scratch.keep(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each range
    before = np.cumsum([0, *(n for _, n in sizes)])
    offsets = rows.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before, strict=False)], "part int, before long")
    return dealt.join(F.broadcast(offsets), "part").withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")).drop("part", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of docs; rank is null where a document is not drawn."""
    scratch = Scratch(docs.sparkSession, "importance")
    raw = totals(docs.select(F.col(f"`{text_col}`").alias("text")), buckets)
    wanted = totals(target.select(F.col(f"`{target_col}`").alias("text")), buckets)
    rows = weigh(docs, gains(wanted, raw), id_col, text_col)
    rows = scratch.keep(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("at", F.monotonically_increasing_id()), "weights")
    may = rows.where(F.col("n_words") >= least)
    k = percent * may.count() // 100
    drawn = ranked(may, scratch).withColumn("rank", F.when(F.col("place") <= k, F.col("place")))
    return drawn.drop("place", "at").unionByName(rows.where(F.col("n_words") < least).drop("at").withColumn("rank", F.lit(None).cast("long")))
