"""Columns that clash with an operator's own, offsets in the text as it is, and scores against brute force."""

import math
import random
import re
import zlib

import numpy as np
import xxhash
from llm_helpers import sentence

from logweave.llm import resample, simhash, toxicity

CLASH = "doc_id long, text string, _times string, _key string, _row string, _id string, _text string, _at string, fp string, root string, rep string"


def test_near_duplicates_keep_columns_with_any_name(spark):
    rng = random.Random(4)
    texts = [sentence(rng, 40) for _ in range(6)]
    rows = [(k, t, *["own"] * 9) for k, t in enumerate([*texts, texts[0], texts[1] + " end", None, "", None])] + [(3, texts[2], *["own"] * 9), (None, texts[4], *["own"] * 9)]
    frame = spark.createDataFrame(rows, CLASH)
    for got in (simhash.drop_similar(frame), simhash.drop_near_duplicates(frame)):
        assert got.columns == frame.columns
        kept = got.collect()
        assert {tuple(r)[2:] for r in kept} == {("own",) * 9}
        assert len({r["text"] for r in kept}) == len(kept) and {r["doc_id"] for r in kept} >= {0, 2, 4, 5}


def test_offsets_are_those_of_the_text(spark):
    from llm_helpers import documents

    rng = random.Random(2)
    rows = []
    for k in range(300):
        ws = sentence(rng, 30).split()
        toxic = k % 3 == 0
        for _ in range(4 if toxic else 0):
            ws.insert(rng.randrange(len(ws)), "dreck")
        rows.append((k, " ".join(ws), int(toxic)))
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    field = toxicity.fit(documents(spark, [t for _, t, _ in rows]), labels)
    texts = ["İİİ dreck dreck dreck the ship", "Dreck! İx dreck, dreck İ dreck", "ǅ dreck ẞ dreck dreck"]
    for text, r in zip(texts, toxicity.tag(documents(spark, texts), field, carry=("doc_id",)).orderBy("doc_id").collect(), strict=True):
        assert r["spans"], text
        for s in r["spans"]:
            part = text[s["start"] : s["end"]]
            assert "dreck" in part.lower() and part == part.strip()


def brute_features(text):
    words = re.findall(r"[^\W_]+(?:['’][^\W_]+)*|[^\w\s]|_", (text or "").lower())
    one = [zlib.crc32(w.encode()) for w in words]
    two = [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64 >> 20) % 10_000 for a, b in zip(one, one[1:], strict=False)]
    return [h % 10_000 for h in one] + two


def test_weights_and_selection_against_brute_force(spark):
    from llm_helpers import documents

    rng = random.Random(6)
    texts = [None, "", "_ x_y don’t", *(sentence(rng, rng.randrange(1, 40)) for _ in range(60))]
    ids = list(range(len(texts)))
    good = {i for i in ids if i % 3 == 0}
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in ids], "doc_id long, quality int, toxic int")
    raw, target = np.zeros(10_000), np.zeros(10_000)
    for i, t in zip(ids, texts, strict=True):
        for b in brute_features(t):
            raw[b] += 1
            target[b] += i in good
    ratio = np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())
    got = {r["doc_id"]: r for r in resample.resample(documents(spark, texts, ids), labels, k=20).collect()}
    for i, t in zip(ids, texts, strict=True):
        fs = brute_features(t)
        weight = sum(ratio[b] for b in fs)
        assert got[i]["n_features"] == len(fs) and math.isclose(got[i]["log_weight"], weight, abs_tol=1e-6) and math.isclose(got[i]["score"], weight / max(1, len(fs)), abs_tol=1e-6)
        if t is not None:
            h = seeded(7, i, t)
            assert math.isclose(got[i]["key"], weight - math.log(-math.log(((h >> 11) + 0.5) / 2**53)), abs_tol=1e-6)
    keys = sorted((r["key"] for r in got.values()), reverse=True)
    assert {i for i, r in got.items() if r["selected"]} == {i for i, r in got.items() if r["key"] >= keys[19]}


def seeded(seed, doc_id, text):
    """Spark's xxhash64 of an int, a long and a string: each value's hash is the seed of the next."""
    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    h = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little"), h)
    return xxhash.xxh64_intdigest(text.encode(), h)
