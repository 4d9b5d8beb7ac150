"""Benchmark decontamination with suffix arrays over the training text.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. The training text is cut into shards (a
bounded piece of an input partition, whole documents). Each shard gets a suffix array over its words, sorted as deep
as the longest benchmark item; every suffix of every benchmark item is binary-searched in it, which gives its
longest verbatim match in the shard, and, where that reaches a window's length, the range of all places that hold the
window. Words that no benchmark item has cannot be in a match: they are left out of the array, as are runs
of other words too short for a window.

The benchmark is read one partition at a time and made into blocks of at most BLOCK_WORDS words, or one item. One block is a broadcast, and the texts are searched in one pass, without any
join, so passages that many documents share cost their places only. Where there are more blocks, the rows are written once with a key and searched for one block after the other, each broadcast
gone before the next is made: driver and tasks never hold more than one. What the blocks find in a row is then put together by the key.

Cases: a null text has no words; such a document is clean, such an item has no windows. Items of fewer words than a
window are one window; items without words none. Rows of one item_id count as one item; a null item_id counts as the
empty string. Repeated documents give repeated rows; null ids are kept. Empty tables: no rows, or all clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.shared import slices, utf8
from logweave.session import Scratch

BLOCK_WORDS = 2_000_000
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))



def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Block:
    """A block of the benchmark: word ids, all suffixes, and the windows among them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        texts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64) for _, ws in items]
        self.names = [name for name, _ in items]
        self.longest = max((len(t) for t in texts), default=0)
        self.least = min((min(window, len(t)) for t in texts), default=0)
        self.flat = np.concatenate([*texts, np.zeros(self.longest + 1, np.int64)]) if texts else np.zeros(1, np.int64)
        starts = np.cumsum([0, *map(len, texts)])
        self.item = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        self.at = np.arange(len(self.item))
        self.left = starts[self.item + 1] - self.at if len(self.item) else self.at  # words from here to the item's end
        size = np.minimum(window, [len(t) for t in texts])[self.item] if len(self.item) else self.at
        self.window = np.where(self.left >= size, size, 0)  # 0: no window begins here


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark's rows, read one partition at a time, in blocks of bounded size."""
    held, size = [], 0
    for row in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        found = words((row["text"] or "").encode())
        if not found:
            continue
        if held and size + len(found) > block_words:
            yield Block(held, window)
            held, size = [], 0
        held.append((row["id"], found))
        size += len(found)
    if held:
        yield Block(held, window)


def suffix_array(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """`starts`, sorted by the `depth` words from each; word 0 ends a run. Prefix doubling: ranks of 1, 2, 4, ... words."""
    rank = np.zeros(len(text) + 1, np.int64)
    rank[: len(text)] = text
    order, reach = starts[np.argsort(rank[starts], kind="stable")], 1
    while reach < depth:
        second = np.minimum(order + reach, len(text))
        second = np.where(rank[order] > 0, rank[second], 0)
        key = rank[order] * (int(rank.max()) + 1) + second
        turn = np.argsort(key, kind="stable")
        order, key = order[turn], key[turn]
        fresh = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]])) if len(key) else key
        wider = np.zeros_like(rank)
        wider[order] = fresh
        rank, reach = wider, reach * 2
        if len(fresh) and fresh[-1] == len(fresh):
            break
    return order


def compare(text: np.ndarray, places: np.ndarray, block: Block, which: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair: sign of (text at place) - (suffix cut to its length), and how many words agree."""
    sign, agree = np.zeros(len(which), np.int8), np.zeros(len(which), np.int64)
    live = np.arange(len(which))
    end = len(text) - 1  # text ends with a 0
    while len(live):
        done = agree[live] >= lengths[live]
        live = live[~done]
        a = text[np.minimum(places[live] + agree[live], end)]
        b = block.flat[block.at[which[live]] + agree[live]]
        differ = a != b
        sign[live[differ]] = np.where(a[differ] < b[differ], -1, 1)
        live = live[~differ]
        agree[live] += 1
    return sign, agree


def search(text: np.ndarray, order: np.ndarray, block: Block, which: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of every suffix (cut to its length) at once: the first place not below it, or (upper) above it."""
    low, high = np.zeros(len(which), np.int64), np.full(len(which), len(order), np.int64)
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        middle = (low[live] + high[live]) // 2
        sign, _ = compare(text, order[middle], block, which[live], lengths[live])
        right = (sign < 0) | (sign == 0) if upper else sign < 0
        low[live[right]] = middle[right] + 1
        high[live[~right]] = middle[~right]


def scan(texts: list[list[bytes]], block: Block) -> tuple[np.ndarray, ...]:
    """One shard against one block: (hit spans: start, end), (place, item) of windows, and longest match by place."""
    get = block.vocabulary.get
    flat = np.fromiter((get(w, 0) for ws in texts for w in [*ws, b""]), np.int64, sum(map(len, texts)) + len(texts))
    flat = np.concatenate([flat, [0]])
    ends = np.flatnonzero(flat == 0)
    begins = np.concatenate([[0], ends[:-1] + 1])
    runs = ends - begins
    keep = runs >= max(1, block.least)
    count = runs[keep]
    starts = np.repeat(begins[keep] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if keep.any() else np.zeros(0, np.int64)
    none = np.zeros(0, np.int64)
    if not len(starts) or not len(block.at):
        return none, none, none, none, none, none, none
    order = suffix_array(flat, starts, block.longest)
    every = np.arange(len(block.at))
    first = search(flat, order, block, every, block.left, upper=False)
    longest, where = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    for near in (first - 1, first):
        inside = np.flatnonzero((near >= 0) & (near < len(order)))
        _, agree = compare(flat, order[near[inside]], block, every[inside], block.left[inside])
        better = agree > longest[inside]
        longest[inside[better]], where[inside[better]] = agree[better], order[near[inside[better]]]
    which = np.flatnonzero((block.window > 0) & (longest >= block.window))
    low = search(flat, order, block, which, block.window[which], upper=False)
    high = search(flat, order, block, which, block.window[which], upper=True)
    times = high - low
    index = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(which) else none
    place, window = order[index], np.repeat(which, times)
    _, agree = compare(flat, place, block, window, block.left[window])
    return place, place + block.window[window], block.item[window], agree, block.at[window], longest, where


Found = tuple[list[tuple[int, int]], set[str], tuple[int, str | None, int | None]]


def searched(texts: list[list[bytes]], block: Block) -> dict[int, Found]:
    """By text that has any: hit spans, items, and the longest match (words, item, place)."""
    base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])  # each document ends with a 0
    out: dict[int, Found] = {}
    start, end, item, agree, _, _, _ = scan(texts, block)
    if not len(start):
        return out
    doc = np.searchsorted(base, start, side="right") - 1
    rank = np.lexsort((start, -agree, doc))
    for k in rank[np.concatenate([[True], doc[rank][1:] != doc[rank][:-1]])].tolist():
        d = int(doc[k])
        out[d] = ([], set(), (int(agree[k]), block.names[int(item[k])], int(start[k] - base[d])))
    for d, i in map(divmod, np.unique(doc * len(block.names) + item).tolist(), repeat(len(block.names))):
        out[d][1].add(block.names[i])
    for d, a, b in np.unique(np.stack([doc, start - base[doc], end - base[doc]]), axis=1).T.tolist():
        out[d][0].append((a, b))
    return out


def columns(found: list[Found | None]) -> list[pa.Array]:
    """n_hit, spans, items and the longest match as columns."""
    merged = [union(f[0]) if f else [] for f in found]
    best = [f[2] if f else (0, None, None) for f in found]
    return [
        pa.array([sum(b - a for a, b in m) for m in merged], pa.int64()),
        pa.array([[{"start": a, "end": b} for a, b in m] for m in merged], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        pa.array([sorted(f[1]) if f else [] for f in found], pa.list_(pa.string())),
        pa.array([b[0] for b in best], pa.int32()),
        pa.array([b[1] for b in best], pa.string()),
        pa.array([b[2] for b in best], pa.int32()),
    ]


PART = "n_hit long, spans array<struct<start:int,end:int>>, items array<string>, longest int, longest_item string, longest_at int"
PARTS = ["n_hit", "spans", "items", "longest", "longest_item", "longest_at"]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (and the columns of `carry`), n_words, n_hit, the hit spans [start, end) in words, the ids of the items that
    have a window there, and the longest verbatim match: its words, its item and its place."""
    spark = docs.sparkSession
    stream = blocks(benchmark, item_col, item_text, window)
    first, second = next(stream, None), next(stream, None)
    chosen = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`") for c in carry])
    if second is not None:
        return find_by_blocks(chosen, chain([first, second], stream), carry)
    shared = spark.sparkContext.broadcast(first)
    schema = ", ".join([f"`{n}` {chosen.schema[c].dataType.simpleString()}" for n, c in (("doc_id", "_id"), *((c, c) for c in carry))] + ["n_words long", PART])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 6 << 20, 4096, lean=True):
            texts = [words(t) for t in utf8(batch.column("_text"))]
            found = searched(texts, shared.value) if shared.value else {}
            cells = [batch.column("_id"), *[batch.column(c) for c in carry], pa.array(map(len, texts), pa.int64()), *columns([found.get(k) for k in range(len(texts))])]
            yield pa.RecordBatch.from_arrays(cells, ["doc_id", *carry, "n_words", *PARTS])

    return chosen.mapInArrow(run, schema)


def find_by_blocks(chosen: DataFrame, stream: Iterator[Block], carry: tuple[str, ...]) -> DataFrame:
    """The same for a benchmark of several blocks: one pass over the written rows for each."""
    scratch = Scratch(chosen.sparkSession, "decontaminate")
    rows = scratch.keep(chosen.withColumn("_key", F.monotonically_increasing_id()), "rows")
    parts = []
    for number, block in enumerate(stream):
        shared = chosen.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "_text", 6 << 20, 4096, lean=True):
                found = searched([words(t) for t in utf8(batch.column("_text"))], shared.value)
                which = sorted(found)
                yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(which, pa.int64())), *columns([found[k] for k in which])], ["_key", *PARTS])

        part = scratch.keep(rows.select("_key", "_text").mapInArrow(run, f"_key long, {PART}"), "part")
        parts.append(part.withColumn("_block", F.lit(number)))
        shared.destroy()
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_block", *PARTS))).alias("_parts"))  # at most one for each block
    joined = rows.join(found, "_key", "left").select("_id", "_text", *[F.col(f"`{c}`") for c in carry], "_parts")
    schema = ", ".join([f"`{n}` {joined.schema[c].dataType.simpleString()}" for n, c in (("doc_id", "_id"), *((c, c) for c in carry))] + ["n_words long", PART])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 6 << 20, 4096, lean=True):
            sizes = [len(words(t)) for t in utf8(batch.column("_text"))]
            made: list[Found | None] = []
            for several in batch.column("_parts").to_pylist():
                spans = [(s["start"], s["end"]) for p in several or [] for s in p["spans"]]
                best = max(several, key=lambda p: (p["longest"], -p["_block"])) if several else None
                made.append((spans, {i for p in several for i in p["items"]}, (best["longest"], best["longest_item"], best["longest_at"])) if several else None)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *[batch.column(c) for c in carry], pa.array(sizes, pa.int64()), *columns(made)], ["doc_id", *carry, "n_words", *PARTS])

    return joined.mapInArrow(together, schema)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """docs without the rows that hold a benchmark window; the columns are those of docs. The rows pass through the search, so nothing is joined."""
    own = docs.columns
    packed = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]).alias("_row"))
    found = find(packed, benchmark, id_col, text_col, item_col, item_text, window, carry=("_row",))
    return found.where("n_hit = 0").select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(own)])
