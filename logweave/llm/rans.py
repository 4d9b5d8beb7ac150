"""Token ids in static rANS files: shared frequency table, independent interleaved blocks, checkpoints and checksums.

The format. A file set is a folder of Parquet files with one row for each block, in ascending order of (shard, block);
Parquet is the container only, so that any store which Spark reaches can hold the files. A block has:

* its directory: the ids of its documents and the number of tokens of each (end id included),
* `payload`: for each segment of SEGMENT tokens (the last may be shorter) a stream of 32-bit words. Token k of a segment belongs
  to lane k mod LANES; the lanes are rANS coders of 64-bit state that share the segment's stream, each
  taking its next word when its state falls under 2^31, in the order of the lanes,
* `checkpoints`: for each segment the place of its first word and the states of its lanes, little-endian; decoding can
  start at any segment, and all segments of many blocks are decoded at once, as one numpy array,
* `crc`: crc32 of the payload, and `ids_crc`: crc32 of the decoded ids as little-endian 32-bit integers.

All blocks share one table of symbol frequencies, counted over all tokens and scaled to 2^BITS with at least 1 for each id that
occurs. Documents keep whole: a block ends with the document that fills it.

Order: documents are dealt by ranges of (id, hash of the text), and sorted in each range; `start` of a shard is the sum of those before
it (one small row a shard). Cases: a null text counts as empty and has the end id only. Null ids come first. Repeated ids
follow each other in the order of their texts' hashes. An empty table makes no blocks.
"""

from __future__ import annotations

import gc
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.shared import slices
from logweave.session import Scratch

BITS = 22
LOW = np.uint64(1 << 31)
LANES = 32
SEGMENT = 4096
BLOCK = 1 << 17
KNOWN_CHUNKS, KNOWN_WORDS = 600_000, 1 << 17
STEPS = SEGMENT // LANES

FRAMES = "shard int, block int, doc_ids array<bigint>, n_tokens array<bigint>, total long, payload binary, checkpoints binary, crc long, ids_crc long"


class Table:
    """Scaled frequencies: every symbol that occurs gets at least 1, the sum is 2^BITS."""

    def __init__(self, counts: np.ndarray):
        total, size = int(counts.sum()), 1 << BITS
        scaled = np.where(counts > 0, np.maximum(1, counts * (size / max(1, total))).astype(np.int64), 0)
        if total:
            over = int(scaled.sum()) - size
            for k in np.argsort(-scaled, kind="stable"):  # the most frequent ones take the difference
                if not over:
                    break
                step = min(over, int(scaled[k]) - 1 - int(scaled[k]) // 2) if over > 0 else over
                scaled[k] -= step
                over -= step
        self.freq = scaled.astype(np.uint64)
        self.base = (np.cumsum(scaled) - scaled).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(scaled)), scaled).astype(np.uint16 if len(scaled) <= 1 << 16 else np.uint32)


def encode(ids: np.ndarray, table: Table) -> tuple[bytes, bytes]:
    """(payload, checkpoints) of one block's ids; all its segments are encoded at once, from their ends."""
    rows = -(-len(ids) // SEGMENT)
    grid = np.zeros(rows * SEGMENT, np.int64)
    grid[: len(ids)] = ids
    grid = grid.reshape(rows, STEPS, LANES)
    here = (np.arange(rows * SEGMENT) < len(ids)).reshape(rows, STEPS, LANES)
    state = np.full((rows, LANES), LOW, np.uint64)
    words, owners = [], []
    shift = np.uint64(63 - BITS)
    for step in range(STEPS - 1, -1, -1):
        s, live = grid[:, step], here[:, step]
        f = np.where(live, table.freq[s], np.uint64(1))
        spill = live & (state >= (f << shift))
        if spill.any():
            r, lane = np.nonzero(spill)
            words.append((state[r, lane] & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1])
            owners.append(r[::-1])
            state = np.where(spill, state >> np.uint64(32), state)
        whole = state // f
        state = np.where(live, (whole << np.uint64(BITS)) + (state - whole * f) + table.base[s], state)
    if words:
        word, owner = np.concatenate(words)[::-1], np.concatenate(owners)[::-1]
        turn = np.argsort(owner, kind="stable")
        word, count = word[turn], np.bincount(owner, minlength=rows)
    else:
        word, count = np.zeros(0, "<u4"), np.zeros(rows, np.int64)
    first = (np.cumsum(count) - count).astype("<u8")
    return word.tobytes(), np.concatenate([first[:, None], state.astype("<u8")], axis=1).tobytes()


def decode(frames: list[tuple[bytes, bytes, int]], table: Table) -> list[np.ndarray]:
    """The ids (uint32) of each (payload, checkpoints, total); the segments of all frames are decoded side by side."""
    if not frames:
        return []
    marks = [np.frombuffer(c, "<u8").reshape(-1, 1 + LANES) for _, c, _ in frames]
    words = np.concatenate([*(np.frombuffer(p, "<u4") for p, _, _ in frames), np.zeros(LANES, np.uint32)]).astype(np.uint64)
    base = np.cumsum([0, *(len(p) // 4 for p, _, _ in frames)])
    at = np.concatenate([m[:, 0].astype(np.int64) + b for m, b in zip(marks, base, strict=False)])
    state = np.concatenate([m[:, 1:] for m in marks]).astype(np.uint64)
    left = np.concatenate([np.minimum(SEGMENT, t - SEGMENT * np.arange(len(m))) for m, (_, _, t) in zip(marks, frames, strict=True)])
    out = np.zeros((len(left), STEPS, LANES), np.uint32)
    mask, bits = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    lane = np.arange(LANES)
    for step in range(STEPS):
        live = left[:, None] > step * LANES + lane
        slot = state & mask
        s = table.symbol[slot.astype(np.int64)]
        out[:, step] = s
        state = np.where(live, table.freq[s] * (state >> bits) + slot - table.base[s], state)
        need = live & (state < LOW)
        place = at[:, None] + np.cumsum(need, axis=1) - need
        state = np.where(need, (state << np.uint64(32)) | words[np.where(need, place, 0)], state)
        at = at + need.sum(axis=1)
    flat, found, k = out.reshape(len(left), SEGMENT), [], 0
    for m, (_, _, total) in zip(marks, frames, strict=True):
        found.append(flat[k : k + len(m)].reshape(-1)[:total])
        k += len(m)
    return found


# What a tokenizer file must be for `Words` to cut texts at white space and to make the steps for plain words itself.
FILE_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Words:
    """Encodes texts with the tokenizers library, chunk by chunk: the file's steps are looked at when it is loaded, and where they are FILE_STEPS, with
    no added token that has or takes white space, no token spans white space, so each
    different chunk between ASCII white space is encoded once and its ids are gathered. Any other file's texts go through the library whole.

    A chunk of letters in normal form, with at most a full stop or comma behind, is what the library's own steps make of it: the word in
    lower case, as byte letters, and the sign; both go to the library's model directly. Any other chunk goes through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        spec = json.loads(self.library.to_str())
        self.by_chunks = {k: spec[k] for k in FILE_STEPS} == FILE_STEPS and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or t["content"].split() != [t["content"]] for t in spec["added_tokens"])
        self.model = self.library.model
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.letters = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}
        self.words: dict[str, tuple[int, ...]] = {}
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.offset = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word of the pattern, in lower case."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) > KNOWN_WORDS:
                self.words.clear()
            found = self.words[word] = tuple(t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)))
        return found

    def learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the chunks, number of each)."""
        ids: list[tuple[int, ...] | list[int] | None] = []
        odd: list[int] = []
        for k, c in enumerate(chunks):
            sign = c[-1:] if c[-1:] in (".", ",") else ""
            body = c[:-1] if sign else c
            if body.isascii() and body.isalpha() or body.isalpha() and "\u03a3" not in body and "\u0130" not in body and is_normalized("NFC", body):
                ids.append(self.word(body.lower()) + self.word(sign) if sign else self.word(body.lower()))
            else:
                ids.append(None)
                odd.append(k)
        for k in range(0, len(odd), 1 << 12):
            part = odd[k : k + (1 << 12)]
            for i, e in zip(part, self.library.encode_batch_fast([chunks[i] for i in part], add_special_tokens=False), strict=True):
                ids[i] = e.ids
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def chunks(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the different chunks, their bounds, number of each chunk of the texts in order, how many chunks each text has).

        The first KNOWN_CHUNKS chunks that a worker meets stay known; later ones are encoded once for each batch.
        """
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        parts = pc.ascii_split_whitespace(column)
        coded = parts.flatten().dictionary_encode()
        unique = coded.dictionary.to_pylist()
        index, flat, offset = self.index, self.flat, self.offset
        number = np.fromiter((-1 if k is None else k for k in map(index.get, unique)), np.int64, len(unique))
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            words = [unique[k] for k in fresh.tolist()]
            ids, sizes = self.learn(words)
            number[fresh] = len(offset) - 1 + np.arange(len(fresh))
            flat, offset = np.concatenate([flat, ids]), np.concatenate([offset, offset[-1] + np.cumsum(sizes)])
            if len(index) < KNOWN_CHUNKS:
                index.update(zip(words, number[fresh].tolist(), strict=True))
                self.flat, self.offset = flat, offset
        return flat, offset, number[coded.indices.to_numpy()], pc.list_value_length(parts).to_numpy().astype(np.int64)

    def ids(self, texts: pa.Array | list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by `end`, and the number of each."""
        if not self.by_chunks:
            whole = [e.ids for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts) for e in self.library.encode_batch_fast([t or ""], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable((*w, end) for w in whole), np.int32), np.fromiter((len(w) + 1 for w in whole), np.int64, len(whole))
        flat, offset, place, counts = self.chunks(texts)
        size = (offset[1:] - offset[:-1])[place]
        run = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(counts)
        lengths = run[ends] - run[ends - counts] + 1
        out = np.full(int(lengths.sum()), end, np.int32)
        body = np.ones(len(out), bool)
        body[np.cumsum(lengths) - 1] = False
        out[body] = flat[np.arange(run[-1]) + np.repeat(offset[place] - run[:-1], size)]
        return out, lengths


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Words:
    return Words(path)


def raw_blocks(docs: DataFrame, path: str, end: int, id_col: str, text_col: str, shards: int | None) -> DataFrame:
    """Texts in order, as ids in blocks: (shard, block, doc_ids, n_tokens, total, ids), ids as little-endian integers of 2 bytes where they fit, else 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, block = tokenizer(path), TaskContext.get().partitionId(), 0
        kind = "<u2" if max(words.size, end + 1) <= 1 << 16 else "<u4"
        ids, sizes, here, held = [], [], [], 0

        def cut() -> pa.RecordBatch:
            values = [[shard], [block], [here], [np.concatenate(sizes)], [held], [np.concatenate(ids).astype(kind).tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["shard", "block", "doc_ids", "n_tokens", "total", "ids"])

        gc.disable()  # the tables of known words are millions of objects without cycles
        try:
            for batch in slices(batches, "text", 16 << 20, 1 << 14):
                got, lengths = words.ids(batch.column("text"), end)
                names, ends, first = batch.column("doc_id").to_pylist(), np.cumsum(lengths), 0
                while first < len(names):  # documents up to the one that fills the block
                    done = int(ends[first - 1]) if first else 0
                    last = min(len(names), int(np.searchsorted(ends, done + BLOCK - held)) + 1)
                    ids.append(got[done : ends[last - 1]])
                    sizes.append(lengths[first:last])
                    here += names[first:last]
                    held += len(ids[-1])
                    first = last
                    if held >= BLOCK:
                        yield cut()
                        ids, sizes, here, held, block = [], [], [], 0, block + 1
            if ids:
                yield cut()
        finally:
            gc.enable()

    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = chosen.repartitionByRange(shards, "doc_id", "tie") if shards else chosen.repartitionByRange("doc_id", "tie")
    return dealt.sortWithinPartitions("doc_id", "tie").select("doc_id", "text").mapInArrow(run, "shard int, block int, doc_ids array<bigint>, n_tokens array<bigint>, total long, ids binary")


def ids_of(block: bytes, total: int) -> np.ndarray:
    return np.frombuffer(block, "<u2" if len(block) == 2 * total else "<u4")


def token_counts(blocks: DataFrame) -> dict[int, int]:
    """How often each id occurs over all blocks: one entry an id, so the vocabulary bounds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for block, n in zip(batch.column("ids"), batch.column("total").to_pylist(), strict=True):
                found = np.bincount(ids_of(block.as_buffer(), n), minlength=len(total))
                found[: len(total)] += total
                total = found
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), pa.array(total[here])], ["id", "n"])

    rows = blocks.select("total", "ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in rows}


def write(docs: DataFrame, folder: str, path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> Table:
    """Write the ids of all texts in ascending order of their ids as a file set at `folder`; gives the frequency table, which
    `folder`/table holds too. Texts are encoded once: their raw blocks are written to the shared folder, counted, and coded from there."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "rans-raw")
    raw_blocks(docs, path, end, id_col, text_col, shards).write.option("compression", "zstd").parquet(raw_path := scratch.path("raw"))
    raw = spark.read.parquet(raw_path)
    found = token_counts(raw)
    counts = np.zeros(max([*found, end]) + 1, np.int64)
    for k, n in found.items():
        counts[k] = n
    table = Table(counts)
    spark.createDataFrame([(int(k), int(counts[k])) for k in np.flatnonzero(counts)], "id int, n long").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = ids_of(row.column("ids")[0].as_buffer(), row.column("total")[0].as_py())
                payload, marks = encode(ids, table)
                sums = [zlib.crc32(payload), zlib.crc32(ids.astype("<u4").tobytes())]
                yield pa.RecordBatch.from_arrays([*[row.column(c) for c in ("shard", "block", "doc_ids", "n_tokens", "total")], pa.array([payload], pa.binary()), pa.array([marks], pa.binary()), *[pa.array([x], pa.int64()) for x in sums]], ["shard", "block", "doc_ids", "n_tokens", "total", "payload", "checkpoints", "crc", "ids_crc"])

    raw.select("shard", "block", "doc_ids", "n_tokens", "total", "ids").mapInArrow(run, FRAMES).write.parquet(f"{folder}/blocks")
    scratch.drop()
    return table


def read(spark, folder: str, keep_ids: bool = False) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, and with keep_ids the ids. A wrong checksum is an error."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    found = {r["id"]: r["n"] for r in spark.read.parquet(f"{folder}/table").collect()}  # one row an id
    counts = np.zeros(max(found, default=0) + 1, np.int64)
    for k, n in found.items():
        counts[k] = n
    shared = spark.sparkContext.broadcast(Table(counts))
    sums = blocks.groupBy("shard", "block").agg(F.sum("total").alias("total"))  # directory only: a row a block
    per_shard = [(r["shard"], r["total"]) for r in sums.groupBy("shard").agg(F.sum("total").alias("total")).orderBy("shard").collect()]  # a row a shard
    starts, run_total = {}, 0
    for shard, total in per_shard:
        starts[shard] = run_total
        run_total += total
    in_shard = sums.select("shard", "block", (F.sum("total").over(_before()) - F.col("total")).alias("ahead"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 8):
                rows = batch.slice(k, 8).to_pylist()
                for r in rows:
                    if zlib.crc32(r["payload"]) != r["crc"]:
                        raise ValueError(f"damaged block {r['block']} of shard {r['shard']}")
                for r, ids in zip(rows, decode([(r["payload"], r["checkpoints"], r["total"]) for r in rows], table), strict=True):
                    whole = ids.astype("<u4")
                    if zlib.crc32(whole.tobytes()) != r["ids_crc"]:
                        raise ValueError(f"block {r['block']} of shard {r['shard']} decodes to other ids")
                    sizes = np.array(r["n_tokens"], np.int64)
                    ends = np.cumsum(sizes)
                    view = memoryview(whole.tobytes())
                    crc = [zlib.crc32(view[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    start = starts[r["shard"]] + r["ahead"] + ends - sizes
                    cells = [pa.array(r["doc_ids"], pa.int64()), pa.array(start), pa.array(sizes), pa.array(crc, pa.int64())]
                    if keep_ids:
                        cells.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cells, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cells)])

    wanted = blocks.select("shard", "block", "doc_ids", "n_tokens", "total", "payload", "checkpoints", "crc", "ids_crc")
    return wanted.join(in_shard, ["shard", "block"]).mapInArrow(run, schema)  # Spark sends the offsets, some bytes a block, to all tasks where they are small


def _before():
    from pyspark.sql import Window

    return Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)


def round_trip(docs: DataFrame, path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs to a file set in the shared folder and read it back."""
    scratch = Scratch(docs.sparkSession, "rans")
    write(docs, scratch.root, path, end, id_col, text_col)
    return read(docs.sparkSession, scratch.root)
