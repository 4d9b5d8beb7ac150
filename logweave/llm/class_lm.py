"""Class-based bigram language model with exchange clustering (Brown et al. 1992, Martin et al. 1998, Uszkoreit and Brants 2008).

Tokens: A-Z lower-cased words between ASCII white space, then one end token for each text. The model's probability of a token is
P(class | class before) * P(kind | class) * P(token | class, kind), with

    P(class | before) = (pairs + MU * share of the class) / (pairs from before + MU),
    P(kind | class) = (tokens of the kind in the class + 1) / (tokens of the class + 2),
    P(token | class, kind) = (count + 0.1) / (tokens of the kind in the class + 0.1 * (its distinct words + 1)),

all counted over all training texts. The end token is a class of its own, in which it is certain. A word that training has not seen counts 0.

Vocabulary: the HEAD most frequent words (about the size of the vocabulary that Brown et al. clustered) are words of the first kind and are clustered one by
one. Every other word, seen or not, is of the second kind and is clustered together with all words of the same shape (ending, length, digits,
signs; SHAPES hash buckets): shapes stand in the text as words do and are exchanged as words are. So every word has a class that
the exchange chose, and that depends on the word alone.

Exchange: the CORE most frequent words are first exchanged one after the other, in the driver, until none moves. Then ROUNDS rounds
over all texts, for all words and shapes: tasks count how often each word stands before and after each class; the counts are summed by word and every word is
moved to the class that raises the likelihood most. In the first round only the core has classes to be counted; in later rounds
all words have, and every second one may move, since all moves of a round are made at once. A round that lowers the likelihood is taken back, and is the last.

Scale: counts of words are aggregated partially and stay distributed. Words are made short (over LONGEST bytes: a prefix and a 128-bit digest), so the broadcast head is
bounded, and no frequent word is outside it; all rarer words of a text are joined to their counts by a shuffle of (row, word, times).
The split changes no count. Texts are read twice: to count words, and to write word numbers, which every later pass reads. What tasks send in a round is at
most a number for each word and class beside it. Sums by row meet again by a row key made in the tasks and written with the rows, so
that a lost executor cannot change it.

Cases: a null text counts as empty: one end token. Very long texts and words are taken whole. Null ids are held out (crc32 of an
empty text is 0). Repeated rows score alike. An empty table gives no rows; with nothing to train on, N = V = 0.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.shared import Numbers, held_out, slices, utf8
from logweave.session import Scratch

CORE = 1000
CLASSES = 24
HEAD = 1 << 18
SHAPES = 1 << 12
LONGEST = 64
ROUNDS = 4
CHUNK = 1 << 10
MU = 10.0
ADD = 0.1
KNOWN = 100_000


def short(word: bytes) -> bytes:
    return word if len(word) <= LONGEST else word[:40] + b"\0" + hashlib.blake2b(word, digest_size=16).digest()


def shape(word: bytes) -> int:
    """The hash bucket of a word's ending, length, and whether it has digits, signs or other bytes."""
    signs = word.translate(None, b"abcdefghijklmnopqrstuvwxyz0123456789")
    return zlib.crc32(b"%d %d %d %d " % (min(len(word), 16) // 2, any(48 <= b < 58 for b in word[:16]), any(b < 128 for b in signs), any(b > 127 for b in signs)) + word[-2:]) & (SHAPES - 1)


def entropy(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(table: np.ndarray) -> float:
    """Of the class pairs, but for a constant."""
    t = table.astype(float)
    return float(entropy(t).sum() - entropy(t.sum(axis=0)).sum() - entropy(t.sum(axis=1)).sum())


def gains(table: np.ndarray, own: np.ndarray, to: np.ndarray, since: np.ndarray, both: np.ndarray) -> np.ndarray:
    """For each word (row) and class: the likelihood with the word in that class, less that without the word.

    own: the words' classes; to, since: how often they stand before and after each class, next to themselves left out; both: how often next to themselves.
    """
    n, size = to.shape
    rows, columns = np.broadcast_to(table.sum(axis=1), (n, size)).copy(), np.broadcast_to(table.sum(axis=0), (n, size)).copy()
    at = np.arange(n)
    rows[at, own] -= to.sum(axis=1) + both
    columns[at, own] -= since.sum(axis=1) + both
    rest = np.broadcast_to(table, (n, size, size)).copy()
    rest[at, own, :] -= to
    rest[at, :, own] -= since
    rest[at, own, own] -= both
    old = entropy(rest)
    ahead = entropy(rest + to[:, None, :]) - old
    behind = entropy(rest + since[:, :, None]) - old
    k = np.arange(size)
    middle = rest[:, k, k]
    gain = ahead.sum(axis=2) + behind.sum(axis=1) - ahead[:, k, k] - behind[:, k, k]
    gain += entropy(middle + to + since + both[:, None]) - entropy(middle)
    out, in_ = (to.sum(axis=1) + both)[:, None], (since.sum(axis=1) + both)[:, None]
    return gain - entropy(rows + out) + entropy(rows) - entropy(columns + in_) + entropy(columns)


def exchange(pairs: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Classes of the words whose bigram counts are `pairs`, one word after the other; the last row and column stand for all other words and keep a class of their own."""
    n = len(pairs) - 1
    pairs = pairs.astype(float)
    own = np.append(np.arange(n) % classes, classes)
    hot = np.zeros((n + 1, classes + 1))
    hot[np.arange(n + 1), own] = 1
    table = hot.T @ pairs @ hot
    to, since = pairs @ hot, (hot.T @ pairs).T
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            a, twice = own[w], pairs[w, w]
            r, s = to[w].copy(), since[w].copy()
            r[a] -= twice
            s[a] -= twice
            gain = gains(table, own[w : w + 1], r[None], s[None], np.array([twice]))[0]
            gain[classes] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                continue
            moved += 1
            for k, sign in ((a, -1), (b, 1)):
                table[k, :] += sign * r
                table[:, k] += sign * s
                table[k, k] += sign * twice
                to[:, k] += sign * pairs[:, w]
                since[:, k] += sign * pairs[w, :]
            own[w] = b
        if not moved:
            break
    return own[:n]


class Head:
    """The frequent words by number, with their counts; and the numbers of the words that a worker has met."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.words, self.counts = words, counts
        self.index: Numbers | None = None

    def __getstate__(self):
        return {"words": self.words, "counts": self.counts, "index": None}

    def forget(self) -> None:
        """Know the words of the head only: their place is their number."""
        self.index, self.others, self.ids = Numbers(zip(self.words, range(len(self.words)), strict=True)), [], np.arange(len(self.words), dtype=np.int32)

    def word(self, place: int) -> bytes:
        return self.words[place] if place < len(self.words) else self.others[place - len(self.words)]

    def take(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each word among those met, number of each, sizes of the documents): a word's number is its rank in the head, or `len(words)` and its shape."""
        first = len(self.words)
        if self.index is None or len(self.index) > first + KNOWN:
            self.forget()
        index, known = self.index, len(self.index)
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        place = np.fromiter((k for d in docs for k in map(index.__getitem__, d)), np.int64, int(sizes.sum()))
        if len(index) > known:
            fresh = list(map(short, islice(index, known, None)))
            self.others += fresh
            found = (k if len(w) > LONGEST - 8 and (k := index.get(w, first)) < first else first + shape(w) for w in fresh)  # long words of the head are there by their short form
            self.ids = np.concatenate([self.ids, np.fromiter(found, np.int32, len(fresh))])
        return place, self.ids[place], sizes


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, made short, n) over all texts (column text), without the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(map(short, held)), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches, "text", 8 << 20, 4096):
            for t in utf8(batch.column("text")):
                held.update(t.lower().split())
            if len(held) > KNOWN:
                yield out()
                held = Counter()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def level(n: str):
    return F.floor(F.log2(n) * 16).cast("int")


def head_of(vocabulary: DataFrame, most: int) -> tuple[Head, int]:
    """The most frequent words: all above the least level of counts at which at most `most` words lie; and that level."""
    total, cut = 0, 1 << 30
    for r in vocabulary.groupBy(level("n").alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("level").desc()).collect():  # some hundred levels
        total += r["words"]
        if total > most:
            break
        cut = r["level"]
    found = vocabulary.where(level("n") >= cut).select("word", "n").toArrow()
    pairs = sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True), key=lambda p: (-p[1], p[0]))
    return Head([w for w, _ in pairs], np.array([n for _, n in pairs], np.int64)), cut


def shapes_of(rare: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, distinct words) of each shape over the words that are not in the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        for batch in batches:
            k = np.fromiter(map(shape, batch.column("word").to_pylist()), np.int64, batch.num_rows)
            tokens += np.bincount(k, weights=batch.column("n").to_numpy(), minlength=SHAPES).astype(np.int64)
            words += np.bincount(k, minlength=SHAPES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES, dtype=np.int32)), pa.array(tokens), pa.array(words)], ["shape", "tokens", "words"])

    tokens, words = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for r in rare.select("word", "n").mapInArrow(run, "shape int, tokens long, words long").groupBy("shape").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect():
        tokens[r["shape"]], words[r["shape"]] = r["tokens"], r["words"]
    return tokens, words


def few(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most about `most` word numbers (one row at least), to bound memory."""
    for batch in batches:
        bounds, start = batch.column("ids").offsets.to_numpy(), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word numbers, whether each begins a text, whether each ends one) of batches with the column ids."""
    for batch in batches:
        column = batch.column("ids")
        ids, bounds = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        full = np.diff(bounds) > 0
        first, last = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        first[bounds[:-1][full]] = True
        last[bounds[1:][full] - 1] = True
        yield ids, first, last


def core_pairs(coded: DataFrame, core: int) -> np.ndarray:
    """Bigram counts among the `core` first words; the last index stands for every other word. Ends of texts are no words."""
    n = core + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for ids, first, _ in numbered(few(batches)):
            k = np.minimum(ids, core).astype(np.int64)
            total += np.bincount((k[:-1] * n + k[1:])[~first[1:]], minlength=n * n)
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(total[here])], ["pair", "n"])

    found = coded.select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most n * n rows
    out = np.zeros(n * n, np.int64)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(n, n)


def neighbours(coded: DataFrame, cls: np.ndarray, number: int) -> DataFrame:
    """(chunk, counts): for CHUNK words at a time, how often each stands before (0) and after (1) each of the `number` classes, and (in the last column) itself."""
    shared = coded.sparkSession.sparkContext.broadcast(cls)
    words, width = len(cls), number + 1
    chunks = -(-words // CHUNK)
    cells = CHUNK * width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, chunks * cells), np.int32)
        of = shared.value
        for ids, first, last in numbered(few(batches)):
            if not len(ids):
                continue
            c = of[ids].astype(np.int64)
            for side, step, edge in ((0, -1, last), (1, 1, first)):
                near = np.where(edge, number - 1, np.roll(c, step))  # beside the ends of a text stands the end token, of the last class
                near[(np.roll(ids, step) == ids) & ~edge] = number
                np.add.at(total[side], ids * width + near, np.int32(1))
        for k in range(chunks):
            part = total[:, k * cells : (k + 1) * cells].reshape(-1)
            here = np.flatnonzero(part)
            if len(here):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([here.astype(np.uint32).tobytes()], pa.binary()), pa.array([part[here].astype(np.uint32).tobytes()], pa.binary())], ["chunk", "cells", "times"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cell, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k not in sums:
                    sums[k] = np.zeros(2 * cells, np.int64)
                sums[k][np.frombuffer(cell, np.uint32)] += np.frombuffer(times, np.uint32)
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s.tobytes()], pa.binary())], ["chunk", "counts"])

    parts = coded.select("ids").mapInArrow(count, "chunk int, cells binary, times binary")
    return parts.repartition(min(chunks, 64), "chunk").mapInArrow(total, "chunk int, counts binary")  # a row for each task and chunk


def chunked(batches: Iterator[pa.RecordBatch], words: int, number: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, to, since, both) of the chunks of `neighbours`; words that never occur are left out."""
    for batch in batches:
        for k, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            to, since = np.frombuffer(counts, np.int64).reshape(2, CHUNK, number + 1).astype(float)
            here = np.flatnonzero(to.sum(axis=1) > 0)
            yield k * CHUNK + here, to[here, :number], since[here, :number], to[here, number]


def class_table(counts: DataFrame, cls: np.ndarray, number: int) -> np.ndarray:
    """Pairs of classes, from the counts of all words; pairs of two end tokens (empty texts) are not among them."""
    shared = counts.sparkSession.sparkContext.broadcast(cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, of = np.zeros((number, number)), shared.value
        for words, to, since, both in chunked(batches, len(of), number):
            own = of[words]
            np.add.at(table, own, to)
            np.add.at(table, (own, own), both)
            table[number - 1, :] += np.bincount(own, weights=since[:, number - 1], minlength=number)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(number * number)), pa.array(table.reshape(-1).astype(np.int64))], ["pair", "n"])

    out = np.zeros(number * number, np.int64)
    for r in counts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # number * number rows
        out[r["pair"]] = r["n"]
    return out.reshape(number, number)


def moves(counts: DataFrame, cls: np.ndarray, table: np.ndarray, classes: int, half: int | None) -> np.ndarray:
    """The classes after all words (or those of one half) have gone to their best class, all at once."""
    number = len(table)
    shared = counts.sparkSession.sparkContext.broadcast((cls, table.astype(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, t = shared.value
        for words, to, since, both in chunked(batches, len(of), number):
            if half is not None:
                mine = (words * 2654435761 >> 7) % 2 == half
                words, to, since, both = words[mine], to[mine], since[mine], both[mine]
            for k in range(0, len(words), 128):
                w = words[k : k + 128]
                gain = gains(t, of[w].astype(np.int64), to[k : k + 128], since[k : k + 128], both[k : k + 128])
                stays = np.where(of[w] < classes, np.take_along_axis(gain, of[w].astype(np.int64)[:, None], 1)[:, 0], -np.inf)
                best = gain[:, :classes].argmax(axis=1)
                better = np.take_along_axis(gain, best[:, None], 1)[:, 0] > stays + 1e-9
                if better.any():
                    yield pa.RecordBatch.from_arrays([pa.array(w[better].astype(np.int32)), pa.array(best[better].astype(np.int32))], ["word", "cls"])

    found = counts.mapInArrow(run, "word int, cls int").toArrow()  # at most a row for each word of the head and each shape
    after = cls.copy()
    after[found.column("word").to_numpy()] = found.column("cls").to_numpy().astype(cls.dtype)
    return after


def cluster(coded: DataFrame, words: int, core: int, classes: int, rounds: int, scratch: Scratch) -> np.ndarray:
    """The class of every word number below `words`: 0 to classes - 1; `classes` for numbers that never occur."""
    first = exchange(core_pairs(coded, core), classes) if core else np.zeros(0, int)
    cls = np.full(words, classes, np.int8)  # this class, the last but one, stands for words that have none yet
    cls[: len(first)] = first
    number, best, before = classes + 2, -math.inf, cls
    for k in range(rounds + 1):
        counts = scratch.keep(neighbours(coded, cls, number), "neighbours")
        table = class_table(counts, cls, number)
        if k > 1:  # the first round's table has words without a class
            now = likelihood(table)
            if now < best:
                return before
            best = now
        elif k == 1:
            best = likelihood(table)
        if k == rounds:
            break
        before, cls = cls, moves(counts, cls, table, classes, None if not k else k % 2)
    return cls


class Model:
    """What scores a text: classes of word numbers, steps between classes, and the constant part of each class and kind."""

    def __init__(self, cls: np.ndarray, head: int, pairs: np.ndarray, tokens: np.ndarray, words: np.ndarray):
        """pairs: of classes, the end token's last; tokens, words: by kind (0 head, 1 others) and class."""
        self.cls, self.head, self.end = cls, head, len(pairs) - 1
        share = (pairs.sum(axis=0) + 1.0) / (pairs.sum() + len(pairs))
        self.steps = np.log10((pairs + MU * share[None, :]) / (pairs.sum(axis=1, keepdims=True) + MU))
        self.parts = np.log10((tokens + 1.0) / (tokens.sum(axis=0) + 2.0)) - np.log10(tokens + ADD * (words + 1))

    def of(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """By text: all of the logarithm but the words' own log10(count + ADD)."""
        c = self.cls[ids].astype(np.int64)
        before = np.where(first, self.end, np.roll(c, 1)) if len(c) else c
        each = self.steps[before, c] + self.parts[(ids >= self.head).astype(np.int8), c]
        out = np.bincount(owner, weights=each, minlength=texts)
        close = np.full(texts, self.steps[self.end, self.end])
        close[owner[last]] = self.steps[c[last], self.end]
        return out + close


def class_pairs(coded: DataFrame, cls: np.ndarray, number: int) -> np.ndarray:
    """Pairs of classes over whole texts, end tokens included; `number` - 1 is theirs."""
    shared = coded.sparkSession.sparkContext.broadcast(cls)
    end = number - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(number * number, np.int64)
        for batch in few(batches):
            total[end * number + end] += int((pa.compute.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False) == 0).sum())
            for ids, first, last in numbered(iter([batch])):
                c = shared.value[ids].astype(np.int64)
                before = np.where(first, end, np.roll(c, 1)) if len(c) else c
                total += np.bincount(np.concatenate([before * number + c, c[last] * number + end]), minlength=number * number)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(number * number)), pa.array(total)], ["pair", "n"])

    out = np.zeros(number * number, np.int64)
    for r in coded.select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # number * number rows
        out[r["pair"]] = r["n"]
    return out.reshape(number, number)


def encode(rows: DataFrame, head: Head) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, met, logs, ids, rare) of rows (doc_id, text, held_out): met and logs are of the words in the head, rare has the others with their times."""
    shared = rows.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, row = shared.value, TaskContext.get().partitionId() << 36
        logs, first = np.log10(head.counts + ADD), len(head.words)
        for batch in slices(batches, "text", 6 << 20, 4096):
            place, ids, sizes = head.take([t.lower().split() for t in utf8(batch.column("text"))])
            n = batch.num_rows
            doc = np.repeat(np.arange(n), sizes)
            common = ids < first
            sums = np.bincount(doc[common], weights=logs[ids[common]], minlength=n)
            met = np.bincount(doc[common], minlength=n)
            key, times = np.unique(doc[~common] * len(head.ids) + place[~common], return_counts=True)
            whose, word = np.divmod(key, max(1, len(head.ids)))
            lists = lambda bounds, values: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
            rare = lists(np.searchsorted(whose, np.arange(n + 1)), pa.StructArray.from_arrays([pa.array(map(head.word, word.tolist()), pa.binary()), pa.array(times)], ["word", "times"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(n)), batch.column("doc_id"), batch.column("held_out"), pa.array(sizes + 1), pa.array(met.astype(np.int64)), pa.array(sums), lists(np.concatenate([[0], np.cumsum(sizes)]), pa.array(ids)), rare],
                ["row", "doc_id", "held_out", "n_tokens", "met", "logs", "ids", "rare"],
            )
            row += n

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, met long, logs double, ids array<int>, rare array<struct<word:binary,times:long>>")


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, core: int = CORE, classes: int = CLASSES, head: int = HEAD, rounds: int = ROUNDS, fitted: list | None = None
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row, learnt from the rows that are not held out.

    fitted: a list that gets the head and the model.
    """
    scratch = Scratch(docs.sparkSession, "class-lm")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out(F.col(f"`{id_col}`"), folds).alias("held_out"))
    vocabulary = scratch.keep(word_counts(rows.where(~F.col("held_out"))), "words")
    known, cut = head_of(vocabulary, head)
    coded = scratch.keep(encode(rows, known), "coded")
    training = coded.where(~F.col("held_out"))
    sums = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    texts = training.count()
    total, distinct = sums["n"] + texts, sums["v"] + (texts > 0)

    first = len(known.words)
    cls = cluster(training, first + SHAPES, min(core, first), classes, rounds, scratch)
    cls[cls >= classes] = 0  # shapes that training has not seen
    tokens, words = np.zeros((2, classes + 1)), np.zeros((2, classes + 1))
    for kind, (own, n, different) in enumerate(((cls[:first], known.counts, np.ones(first)), (cls[first:], *shapes_of(vocabulary.where(level("n") < cut))))):
        tokens[kind] = np.bincount(own, weights=n, minlength=classes + 1)
        words[kind] = np.bincount(own, weights=different, minlength=classes + 1)
    model = Model(cls, first, class_pairs(training, cls, classes + 1), tokens, words)
    if fitted is not None:
        fitted += [known, model]
    log_all, log_end = math.log10(total + ADD * (distinct + 1)), math.log10(texts + ADD)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            sizes = batch.column("n_tokens").to_numpy() - 1
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            for ids, begins, ends in numbered(iter([batch])):
                found = shared.value.of(ids, begins, ends, owner, batch.num_rows)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found)], [*kept, "model"])

    kept = ["row", "doc_id", "held_out", "n_tokens", "met", "logs"]
    kind = dict(rows.dtypes)["doc_id"]
    parts = coded.select(*kept, "ids").mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, met long, logs double, model double")
    asked = coded.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.times").alias("times"))
    count = F.coalesce(F.col("n"), F.lit(0))
    answered = asked.join(vocabulary.where(level("n") < cut), "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(count + ADD)).alias("rare_logs"), F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("rare_met"))
    joined = parts.join(answered, "row", "left")
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("met") + F.coalesce("rare_met", F.lit(0)) + F.lit(int(texts > 0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (logs + F.lit(log_end) - F.col("n_tokens") * log_all).alias("base_score"), (logs + F.col("model")).alias("score"),  # given its class, the end token is certain
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
