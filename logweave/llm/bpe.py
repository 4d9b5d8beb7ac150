"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

Texts are cut at the special strings and into words by the byte-level word pattern. Words not met before are encoded
together: their symbols lie in one flat array, and in each round every word's lowest-ranked pair, found by binary search over
the sorted pair keys, is merged at all its places, until no word has a pair left. A document's ids are
gathered from its words' ids. The vocabulary file is a parameter and is read where the tasks run; it has a fixed size.

Words of over LONG bytes (runs of signs without white space) would need a round over all their symbols for each different rank. Their symbols are chained
instead, and a round looks only at the places of its rank, which are known, and at their neighbours: the work is in proportion to the word.

Cases: a null text counts as empty: no ids, empty text. Special strings of the vocabulary in a text give their own ids. Very long words are taken whole. Null ids, repeated rows and extra columns pass through as they are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.shared import Numbers, slices

# The byte-level word pattern; White_Space is written out, since \s of this regex library also takes U+001C to U+001F.
SPACE = r"\t-\r\x20\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

NO_RANK = np.iinfo(np.int64).max
LONG = 256
KNOWN_WORDS = 200_000


def byte_letters() -> dict[str, int]:
    """The letter that the vocabulary file uses for each byte: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """One vocabulary: encodes and decodes batches of texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocabulary = byte_letters(), spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocabulary.values(), *self.special.values()]) + 1
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        keys = left * self.size + right
        turn = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[turn], turn.astype(np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)  # by rank
        self.byte_id = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_id[byte] = vocabulary[letter]
        pieces = [b""] * self.size
        for token, i in vocabulary.items():
            pieces[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.pieces = pieces
        self.word = regex.compile(WORD)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        """Empty the table of known words."""
        self.index = Numbers({t: k for k, t in enumerate(self.special)})
        self.flat = np.array(list(self.special.values()), np.int32)
        self.offset = np.arange(len(self.special) + 1, dtype=np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbol, done_owner = [], []
        while len(symbol):
            same = owner[:-1] == owner[1:]
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == key), self.rank[at], NO_RANK)
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            lowest = np.minimum.reduceat(np.append(rank, NO_RANK), first)
            span = np.diff(np.append(first, len(symbol)))
            live = lowest < NO_RANK
            stays = np.repeat(live, span)
            if not live.all():
                done_symbol.append(symbol[~stays])
                done_owner.append(owner[~stays])
            if not live.any():
                break
            hit = np.append((rank < NO_RANK) & (rank == np.repeat(lowest, span)[:-1]), False)
            where = np.flatnonzero(hit)
            begin = np.concatenate([[True], np.diff(where) > 1])  # of overlapping places in a row, every other one, from the left
            hit[where] = (np.arange(len(where)) - np.maximum.accumulate(np.where(begin, np.arange(len(where)), 0))) % 2 == 0
            symbol = np.where(hit, self.merged[np.where(hit, np.append(rank, 0), 0)], symbol)
            stays &= ~np.concatenate([[False], hit[:-1]])
            symbol, owner = symbol[stays], owner[stays]
        if not done_symbol:
            return symbol, sizes
        symbol, owner = np.concatenate(done_symbol), np.concatenate(done_owner)
        turn = np.argsort(owner, kind="stable")
        return symbol[turn], np.bincount(owner, minlength=len(words))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of pairs of symbols; a negative right symbol is none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((right >= 0) & (self.keys[at] == key), self.rank[at], NO_RANK)

    def merge_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same as `merge`, for long words: the places of each rank are kept, and only those beside a merge are ranked again."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = int(sizes.sum())
        symbol = np.append(self.byte_id[np.frombuffer(b"".join(words), np.uint8)], -1).astype(np.int32)  # the last place is no symbol
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        ends = np.cumsum(sizes)
        after[ends - 1], before[ends - sizes] = n, n
        after[n] = n
        rank = np.append(self.ranks(symbol[:n], symbol[after[:n]]), NO_RANK)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] < NO_RANK]
            if not len(places):
                return
            order = np.argsort(rank[places], kind="stable")
            places = places[order]
            found, first = np.unique(rank[places], return_index=True)
            for r, part in zip(found.tolist(), np.split(places, first[1:]), strict=True):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(part)

        if n:
            wait(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[rank[places] == r]
            if not len(places):
                continue
            at = np.arange(len(places))
            begin = np.concatenate([[True], after[places[:-1]] != places[1:]])  # of overlapping places in a row, every other one, from the left
            places = places[(at - np.maximum.accumulate(np.where(begin, at, 0))) % 2 == 0]
            gone = after[places]
            symbol[places] = self.merged[r]
            symbol[gone], rank[gone] = -1, NO_RANK
            after[places] = after[gone]
            before[after[places]] = places
            near = np.unique(np.concatenate([places, before[places]]))
            near = near[near < n]
            rank[near] = self.ranks(symbol[near], symbol[after[near]])
            wait(near)
        stays = symbol[:n] >= 0
        return symbol[:n][stays].astype(np.int64), np.bincount(np.repeat(np.arange(len(words)), sizes)[stays], minlength=len(words))

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet, a bounded number of bytes at a time."""
        part, size = [], 0
        for k, w in enumerate(words):
            part.append(w.encode())
            size += len(part[-1])
            if size >= 1 << 22 or k == len(words) - 1 or (len(part[-1]) > LONG) != (len(words[k + 1].encode()) > LONG):
                ids, counts = (self.merge_long if len(part[-1]) > LONG else self.merge)(part)
                self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
                self.offset = np.concatenate([self.offset, self.offset[-1] + np.cumsum(counts)])
                part, size = [], 0

    def split(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.word.findall(text)
        out: list[str] = []
        for k, piece in enumerate(self.cut.split(text)):
            out += [piece] if k % 2 else self.word.findall(piece)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32) of the texts in one array, and the texts' bounds in it."""
        if len(self.index) > KNOWN_WORDS:
            self.forget()
        index, known = self.index, len(self.index)
        places, bounds = [], [0]
        for text in texts:
            found = self.split(text)
            places.append(np.fromiter(map(index.__getitem__, found), np.int64, len(found)))
            bounds.append(bounds[-1] + len(found))
        if len(index) > known:
            self.learn(list(index)[known:])
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        size = self.offset[place + 1] - self.offset[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        source = np.arange(ends[-1]) + np.repeat(self.offset[place] - ends[:-1], size)
        return self.flat[source], ends[np.array(bounds)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One for each worker process and file."""
    return Coder(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", same_col: str | None = None) -> DataFrame:
    """docs with the column `ids_col`, array<int>, the ids of each text, and with `same_col` whether they decode to the text again. Columns of
    these names are replaced."""
    made = [ids_col, *([same_col] if same_col else [])]
    own = [c for c in docs.columns if c not in made]
    fields = [docs.schema[c] for c in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in slices(batches, "_text", 4 << 20, 2048, lean=True):
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            ids, bounds = c.encode(texts)
            cells = [*[batch.column(f"c{i}") for i in range(len(own))], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))]
            if same_col:
                cells.append(pa.array([c.decode(ids[a:b]) == t for a, b, t in zip(bounds[:-1], bounds[1:], texts, strict=True)]))
            yield pa.RecordBatch.from_arrays(cells, [*own, *made])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{ids_col}` array<int>"] + [f"`{same_col}` boolean"] * bool(same_col))
    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with the column `text_col`, the text of each array of ids (null: empty)."""
    own = [c for c in rows.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            texts = [c.decode(np.asarray(x or [], np.int64)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in own], pa.array(texts, pa.string())], [*own, text_col])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text_col] + [f"`{text_col}` string"])
    return rows.select(*[f"`{c}`" for c in dict.fromkeys([*own, ids_col])]).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: texts are encoded, and their ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in slices(batches, "text", 4 << 20, 2048, lean=True):
            ids, bounds = c.encode([t or "" for t in batch.column("text").to_pylist()])
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts], pa.string()),
                    pa.array([hashlib.sha256(c.decode(p).encode()).hexdigest() for p in parts], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    chosen = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
