"""Toxicity by a linear-chain conditional random field over words.

Labels are given for documents; labelled tokens are derived from them. Over the training documents, a word is evidence of toxicity when it
occurs in many different surroundings in toxic documents and hardly in others: its surroundings (words before and after)
are counted once each, so that groups of copies count as one text. Tokens of such words in toxic documents are tagged
toxic, all others clean. On these the field is trained: two tags, the four potentials of tag transitions (before the first token stands the clean tag), and
for each token the hashed features word, word before, word after, prefix and suffix of the word; all of them by L-BFGS on the L2-regularised exact
log-likelihood of whole chains (forward-backward).

Scoring: forward-backward over every whole text gives each token's marginal of being toxic. The document's evidence
is the sum of -log(1 - marginal) over its tokens, that is, of the chance that no token is toxic; a logistic curve fitted on
the training documents turns this and its share of the words into the score. Offending offsets are the runs of tokens
with a marginal of at least 1/2, in code points of the text.

Bounds of the classifier's sample: at most SAMPLE labelled documents, up to a third of them toxic ones (of each
kind those with the least hash of their id), and of these, in the same order, whole texts of at most SAMPLE_BYTES together (a text that does not fit is left out); the curve weighs
both kinds by their numbers among all labelled training documents. The model has 2^BUCKETS weights, so its broadcast has a fixed size. Scoring covers all
rows and whole texts.

Cases: a null or wordless text has no tokens: evidence 0, and the score that the curve gives it. Labels that are null, or whose ids
have no document, are not used; several labels of one id count as toxic if any is. Without any toxic label no word is evidence
and every score is 0. Null ids score like others. Repeated rows score alike. Empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.shared import Numbers, held_out, slices
from logweave.session import Scratch

SAMPLE = 3_000
SAMPLE_BYTES = 12 << 20
BUCKETS = 18
STEP = 64
KNOWN = 150_000
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
NOTHING = "\0"


def tokens(text: str | None) -> list[str]:
    return list(map(intern, TOKEN.findall(text.lower()))) if text else []


def bucket(kind: str, word: str) -> int:
    return zlib.crc32(f"{kind}\0{word}".encode()) & ((1 << BUCKETS) - 1)


def features(word: str) -> tuple[int, int, int, int, int]:
    """Buckets of a word as itself (word, prefix, suffix), as the one before and as the one after."""
    return bucket("w", word), bucket("p", word[:4]), bucket("s", word[-4:]), bucket("b", word), bucket("a", word)


class Field:
    """Weights: `w` by bucket, added to the toxic tag's potential; `move` 2 x 2 transitions; `curve` of the document score."""

    def __init__(self, w: np.ndarray, move: np.ndarray, curve: np.ndarray):
        self.w, self.move, self.curve = w.astype(np.float32), move, curve
        self._start()

    def _start(self) -> None:
        self.index = Numbers()
        self.potential = np.zeros((0, 3))

    def __getstate__(self):
        return {"w": self.w, "move": self.move, "curve": self.curve}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def scores(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Potentials of all tokens of all documents in one array, and the documents' sizes."""
        if len(self.index) > KNOWN:
            self._start()
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        known, index = len(self.index), self.index
        place = np.fromiter((k for d in docs for k in map(index.__getitem__, d)), np.int64, int(sizes.sum()))
        if len(index) > known:
            found = np.array([features(w) for w in list(index)[known:]], np.int64)
            self.potential = np.concatenate([self.potential, np.stack([self.w[found[:, :3]].sum(axis=1), self.w[found[:, 3]], self.w[found[:, 4]]], axis=1)])
        first = np.zeros(len(place), bool)
        ends = np.cumsum(sizes)
        first[(ends - sizes)[sizes > 0]] = True
        own, before, after = (self.potential[place, k] for k in range(3))
        left = np.where(first, self.w[bucket("b", NOTHING)], np.roll(before, 1))
        right = np.where(np.roll(first, -1), self.w[bucket("a", NOTHING)], np.roll(after, -1))
        return own + left + right, sizes

    def marginals(self, potential: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each token's chance of the toxic tag."""
        return forward_backward(potential, sizes, self.move)[0]

    def evidence(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(evidence by document, sizes, marginals)."""
        potential, sizes = self.scores(docs)
        marginal = self.marginals(potential, sizes)
        return by_document(marginal, sizes), sizes, marginal

    def score(self, evidence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(shape(evidence, sizes) @ self.curve, -40, 40)))


def by_document(marginal: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    run = np.concatenate([[0.0], np.cumsum(-np.log1p(-np.minimum(marginal, 1 - 1e-9)))])
    return np.maximum(0.0, run[ends] - run[ends - sizes])


def shape(evidence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    strength = -np.expm1(-evidence)
    return np.stack([np.ones(len(evidence)), strength, np.log1p(evidence), np.log1p(100 * evidence / np.maximum(1, sizes))], axis=1)


def forward_backward(potential: np.ndarray, sizes: np.ndarray, move: np.ndarray, expect: bool = False) -> tuple[np.ndarray, float, np.ndarray]:
    """(chance of the toxic tag by token, sum of the log partition functions, expected transitions if asked for) of all chains.

    Chains are cut into pieces of STEP tokens; the pieces' transfer matrices are multiplied along each chain, from the clean tag before its
    first token, and all pieces then run forward and backward side by side. Nothing is lost at the cuts."""
    total, expected = int(sizes.sum()), np.zeros((2, 2))
    if not total:
        return np.zeros(0), 0.0, expected
    pieces = -(-sizes // STEP)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    size = np.minimum(STEP, sizes[doc] - nth * STEP)
    order = np.argsort(-size, kind="stable")  # longest first: at each step the live pieces are the first ones
    rank = np.argsort(order)
    begin, size = ((np.cumsum(sizes) - sizes)[doc] + nth * STEP)[order], size[order]
    live = np.searchsorted(-size, -np.arange(STEP), side="left")
    steps = int(size[0])
    toxic = np.exp(np.clip(potential, -30, 30))
    m = np.exp(np.clip(move, -30, 30))

    def forth(a: np.ndarray, b: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One step of the live pieces: weights of both tags, and their sum."""
        c, d = a * m[0, 0] + b * m[1, 0], (a * m[0, 1] + b * m[1, 1]) * toxic[begin[: live[t]] + t]
        s = c + d
        return c / s, d / s, s

    ahead, behind = np.tile([1.0, 0.0], (len(size), 1)), np.ones((len(size), 2))
    if pieces.max() > 1:
        whole = np.zeros((len(size), 2, 2))
        scale = np.ones((len(size), 2))
        for start in (0, 1):
            a, b, log = np.full(len(size), 1.0 - start), np.full(len(size), float(start)), np.zeros(len(size))
            for t in range(steps):
                k = live[t]
                a[:k], b[:k], s = forth(a[:k], b[:k], t)
                log[:k] += np.log(s)
            whole[:, start, 0], whole[:, start, 1], scale[:, start] = a, b, log
        whole *= np.exp(scale - scale.max(axis=1, keepdims=True))[:, :, None]
        starts = np.cumsum(pieces) - pieces
        for k in range(1, int(pieces.max())):
            long = np.flatnonzero(pieces > k)
            i, j = starts[long] + k, starts[long] + pieces[long] - 1 - k
            v = np.einsum("na,nab->nb", ahead[rank[i - 1]], whole[rank[i - 1]])
            ahead[rank[i]] = v / v.sum(axis=1, keepdims=True)
            v = np.einsum("nab,nb->na", whole[rank[j + 1]], behind[rank[j + 1]])
            behind[rank[j]] = v / v.sum(axis=1, keepdims=True)
    forward, log_z = [(ahead[:, 0].copy(), ahead[:, 1].copy())], 0.0
    for t in range(steps):
        k = live[t]
        a, b, s = forth(forward[t][0][:k], forward[t][1][:k], t)
        log_z += float(np.log(s).sum())
        forward.append((a, b))
    found = np.zeros(total)
    x, y = behind[:, 0].copy(), behind[:, 1].copy()
    for t in range(steps - 1, -1, -1):
        k = live[t]
        (a, b), u, v = forward[t + 1], x[:k], y[:k]
        found[begin[:k] + t] = b * v / (a * u + b * v)
        v = v * toxic[begin[:k] + t]
        if expect:
            p, q = forward[t][0][:k], forward[t][1][:k]
            four = [[p * m[0, 0] * u, p * m[0, 1] * v], [q * m[1, 0] * u, q * m[1, 1] * v]]
            s = four[0][0] + four[0][1] + four[1][0] + four[1][1]
            expected += [[(z / s).sum() for z in row] for row in four]
        c, d = u * m[0, 0] + v * m[0, 1], u * m[1, 0] + v * m[1, 1]
        s = c + d
        x[:k], y[:k] = c / s, d / s
    return found, log_z, expected


def evident(place: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, words: int, least: int = 4, share: float = 0.8, nats: float = 12.0) -> np.ndarray:
    """Whether each word (numbers below `words`, document after document) is evidence: at least `share` of its different surroundings are in toxic
    documents, more than the documents' sizes explain by `nats` of log-likelihood, with `least` different words before, after, and toxic documents."""
    label = np.repeat(toxic.astype(bool), sizes)
    if not label.any():
        return np.zeros(words, bool)
    ends = np.cumsum(sizes)[sizes > 0]
    first = np.zeros(len(place), bool)
    first[ends - sizes[sizes > 0]] = True
    before, after = np.where(first, words, np.roll(place, 1)), np.where(np.roll(first, -1), words, np.roll(place, -1))

    def different(which: np.ndarray, *near: np.ndarray) -> np.ndarray:
        """By word: how many different values of `near` its tokens have, among those of `which`."""
        key, of = place[which], np.arange(words)
        for x in near:
            pairs, key = np.unique(key * (int(x.max()) + 1) + x[which], return_inverse=True)
            of = of[pairs // (int(x.max()) + 1)]
        return np.bincount(of, minlength=words)

    n, other = (different(which, before, after) for which in (label, ~label))
    wide = np.minimum(np.minimum(different(label, before), different(label, after)), different(label, np.repeat(np.arange(len(sizes)), sizes)))
    expected = min(label.mean(), 1 - 1e-6)
    part = n / np.maximum(1, n + other)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = n * np.log(part / expected) + np.where(other > 0, other * np.log((1 - part) / (1 - expected)), 0.0)
    return (wide >= least) & (part >= share) & (gain >= nats)


def train(texts: list[str | None], toxic: list[int], rate: float | None = None, l2: float = 0.05, rounds: int = 30) -> Field:
    """Fit the field and the document curve. rate: share of toxic ones among the documents that the texts stand for."""
    index = Numbers()
    docs = [np.fromiter(map(index.__getitem__, tokens(t)), np.int32) for t in texts]
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    place = np.concatenate([*docs, np.zeros(0, np.int32)])
    del docs
    y = np.array(toxic, float)
    marked = evident(place.astype(np.int64), sizes, y, len(index))
    if not marked.any():
        return Field(np.zeros(1 << BUCKETS), np.zeros((2, 2)), np.array([-40.0, 0, 0, 0]))
    table = np.array([features(w) for w in index], np.int32)
    del index
    chains = chain_features(place, sizes, table)
    tag = marked[place] & np.repeat(y > 0, sizes)
    best = lbfgs(lambda v: loss(v, chains, sizes, tag, l2), np.zeros((1 << BUCKETS) + 4), rounds)
    field = Field(best[:-4], best[-4:].reshape(2, 2), np.zeros(4))
    weights = best[:-4]
    chance = forward_backward(sum(weights[f] for f in chains), sizes, field.move)[0]
    evidence = by_document(chance, sizes)
    rate = y.mean() if rate is None else rate
    share = np.where(y > 0, rate / max(1e-9, y.mean()), (1 - rate) / max(1e-9, 1 - y.mean()))
    field.curve = logistic(shape(evidence, sizes), y, share)
    return field


def chain_features(place: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    """The five feature buckets of every token; table: the buckets of each word, as `features` gives them."""
    first = np.zeros(len(place), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    before = np.where(first, np.int32(bucket("b", NOTHING)), np.roll(table[place, 3], 1))
    after = np.where(np.roll(first, -1), np.int32(bucket("a", NOTHING)), np.roll(table[place, 4], -1))
    return [*(table[place, k] for k in range(3)), before, after]


def loss(v: np.ndarray, chains: list[np.ndarray], sizes: np.ndarray, tag: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the tags, regularised, and its gradient; v: the weights of the buckets, then the transitions."""
    w, move = v[:-4], v[-4:].reshape(2, 2)
    weight = 1.0 / max(1, len(tag))
    potential = sum(w[f] for f in chains)
    chance, log_z, expected = forward_backward(potential, sizes, move, expect=True)
    first = np.zeros(len(tag), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    before = np.where(first, False, np.roll(tag, 1))
    seen = np.bincount(2 * before + tag, minlength=4).reshape(2, 2)
    value = weight * (log_z - potential[tag].sum() - (seen * move).sum() + l2 * float(v @ v))
    gap = chance - tag
    slope = sum(np.bincount(f, weights=gap, minlength=len(w)) for f in chains)
    return value, weight * (np.concatenate([slope, (expected - seen).reshape(-1)]) + 2 * l2 * v)


def lbfgs(value, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Plain limited-memory BFGS with backtracking."""
    f, g = value(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(rounds):
        q, alphas = g.copy(), []
        for s, y in reversed(steps):
            alphas.append(s @ q / (y @ s))
            q -= alphas[-1] * y
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), alpha in zip(steps, reversed(alphas), strict=True):
            q += s * (alpha - (y @ q) / (y @ s))
        rate = 1.0 if steps else 1.0 / max(1e-12, np.abs(g).max())
        for _ in range(25):
            new = x - rate * q
            f_new, g_new = value(new)
            if f_new <= f - 1e-4 * rate * (g @ q):
                break
            rate /= 2
        else:
            return x
        s, y = new - x, g_new - g
        if s @ y > 1e-15:
            steps = [*steps[-memory + 1 :], (s, y)]
        done = abs(f - f_new) < 1e-9 * max(1.0, abs(f))
        x, f, g = new, f_new, g_new
        if done:
            break
    return x


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, l2: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(b)), x.T @ (weights * (p - y)) + l2 * b)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, sample: int = SAMPLE) -> Field:
    """Train on labelled documents that are not held out: at most `sample`, those whose ids have the least hash."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), folds)).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).alias("_y"))
    numbers = {r["_y"] > 0: r["n"] for r in marked.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each value of the label
    of = lambda which, most: marked.where(which).orderBy(F.xxhash64("_id"), "_id").limit(most)
    chosen = of("_y > 0", sample // 3).unionByName(of("_y <= 0", sample - sample // 3))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    joined = texts.join(F.broadcast(chosen), "_id")  # at most `sample` rows of two numbers
    rows = Scratch(docs.sparkSession, "toxicity").keep(joined.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y")), "sample")
    fit_in, left = [], SAMPLE_BYTES
    for r in rows.select("_id", F.coalesce(F.octet_length("_text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("_id"), "_id").collect():  # at most `sample` rows of two numbers
        if r["n"] <= left:
            fit_in.append(r["_id"])
            left -= r["n"]
    rows = rows.where(F.col("_id").isin(fit_in)).collect() if fit_in else []  # at most SAMPLE_BYTES of text
    rows.sort(key=lambda r: str(r["_id"]))
    rate = numbers.get(True, 0) / max(1, sum(numbers.values()))
    return train([r["_text"] for r in rows], [int(r["_y"] > 0) for r in rows], rate)


SPANS = "array<struct<start:int,end:int,chance:double>>"


def tag(docs: DataFrame, field: Field, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns of `carry`, n_words, evidence, score, and spans: the offending offsets [start, end) with their highest marginal."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    chosen = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").alias("_text"))
    schema = ", ".join([f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in carry] + [f"n_words long, evidence double, score double, spans {SPANS}"])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in slices(batches, "_text", 3 << 20, 2048, lean=True):
            texts = batch.column("_text").to_pylist()
            evidence, sizes, marginal = field.evidence([tokens(t) for t in texts])
            spans: list[list[dict]] = [[] for _ in texts]
            ends = np.cumsum(sizes)
            high = np.flatnonzero(marginal >= 0.5)
            owner = np.searchsorted(ends, high, side="right")
            for d in np.unique(owner).tolist():
                picked = set((high[owner == d] - (ends[d] - sizes[d])).tolist())
                before, low = -2, texts[d].lower()
                # Some characters are several in lower case; offsets are those of the text as it is.
                place = None if len(low) == len(texts[d]) else np.repeat(np.arange(len(texts[d])), [len(c.lower()) for c in texts[d]])
                for k, m in enumerate(TOKEN.finditer(low)):
                    if k in picked:
                        chance = float(marginal[ends[d] - sizes[d] + k])
                        start, end = m.span() if place is None else (int(place[m.start()]), int(place[m.end() - 1]) + 1)
                        if before == k - 1:
                            spans[d][-1]["end"] = end
                            spans[d][-1]["chance"] = max(chance, spans[d][-1]["chance"])
                        else:
                            spans[d].append({"start": start, "end": end, "chance": chance})
                        before = k
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carry], pa.array(sizes), pa.array(evidence), pa.array(field.score(evidence, sizes)), pa.array(spans, kind)],
                [*carry, "n_words", "evidence", "score", "spans"],
            )

    return chosen.mapInArrow(run, schema)


def remove_toxic(docs: DataFrame, field: Field, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score `threshold` or more; the columns are those of docs."""
    own = docs.columns
    packed = docs.select(F.col(f"`{text_col}`"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]).alias("_row"))
    return tag(packed, field, text_col, ("_row",)).where(F.col("score") < threshold).select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(own)])
