"""Near duplicates of the pipeline's stage against brute-force Jaccard, and rows that repeat an id."""

import random
from collections import Counter

import corpus_pipeline
from llm_helpers import ODD, documents
import corpus_pipeline
from logweave.llm import simhash


def brute_shingles(text, width=5):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def brute_kept(texts, pair=alike):
    sets = [brute_shingles(t) for t in texts]
    left, kept = set(range(len(texts))), []
    while left:
        group, edge = set(), [left.pop()]
        while edge:
            k = edge.pop()
            group.add(k)
            near = {j for j in left if pair(sets[k], sets[j])}
            left -= near
            edge += near
        kept.append(min(group))
    return sorted(kept)


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    licence = [rng.choice(vocabulary) for _ in range(80)]
    texts = []
    for k in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 40, 120, 400]))] + licence * (k % 3 == 0)
        for _ in range(8):
            near = list(base)
            for _ in range(rng.randrange(1 + len(base) // 30)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near[: len(near) - rng.randrange(1 + len(near) // 8)]))
    rng.shuffle(texts)
    return texts + ODD


def test_slots_are_those_of_sql(spark):
    values = [0, 1, -1, 1 << 62, -(1 << 63), 123456789]
    rows = spark.createDataFrame([(v,) for v in values], "fp long").selectExpr("fp", f"pmod(xxhash64(fp), {1 << simhash.SIEVE}) as slot").collect()
    assert {r["fp"]: r["slot"] for r in rows} == {v: simhash.slot_of(v) for v in values}


def test_stage_against_brute_force_jaccard(spark, monkeypatch):
    texts = near_copies(5)
    want = brute_kept(texts)
    assert len({t for t in texts if t}) > len(want) + 30
    kept = corpus_pipeline.clean_duplicates(spark, documents(spark, texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == want and kept.columns == documents(spark, []).columns
    # The order of shingles changes no result.
    monkeypatch.setattr(simhash, "common_shingles", lambda texts, width, similarity: simhash.prefixes(texts, width, 0.0, simhash.np.zeros(0, simhash.np.int64)).where("pmod(shingle, 3) = 0").select("shingle").distinct().toArrow().column(0).to_numpy())
    assert sorted(r["doc_id"] for r in simhash.drop_similar(documents(spark, texts)).collect()) == want


def test_chains_and_links_are_verified(spark):
    rng = random.Random(6)
    words = [f"v{k}" for k in range(260)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, 160, 7)]
    rng.shuffle(texts)
    assert [r["doc_id"] for r in simhash.drop_similar(documents(spark, texts)).collect()] == brute_kept(texts)
    texts = [" ".join(words[k : k + 100]) for k in range(0, 160, 30)]
    assert sorted(r["doc_id"] for r in simhash.drop_similar(documents(spark, texts)).collect()) == brute_kept(texts) == list(range(len(texts)))


def test_repeated_ids_keep_a_row_of_each_component(spark):
    texts = ["one two three four five six", "quite another text with no word shared", "one two three four five six", "a third text that only id nine holds", "one two three four five six", "quite another text with no word shared"]
    ids = [7, 7, 7, 9, 8, 3]
    want = Counter([(7, texts[0]), (9, texts[3]), (3, texts[1])])
    for drop in (simhash.drop_near_duplicates, simhash.drop_similar):
        assert Counter((r["doc_id"], r["text"]) for r in drop(documents(spark, texts, ids)).collect()) == want
        assert Counter((r["doc_id"], r["text"]) for r in drop(documents(spark, texts[:2], [7, 7])).collect()) == Counter([(7, texts[0]), (7, texts[1])])
        assert Counter((r["doc_id"], r["text"]) for r in drop(documents(spark, texts[:4], [None, None, None, 9])).collect()) == Counter([(None, texts[0]), (None, texts[1]), (9, texts[3])])


def test_simhash_links_and_alike_sets_are_one_component(spark):
    """Each text but the first is linked to the one before: by SimHash alone (the same three-word shingles by majority), or by its set."""
    base = " ".join(f"w{k}" for k in range(40))
    twice = " ".join([base] * 3 + ["odd"])  # repeats: a set of other shingles, counts of much the same
    texts = [base + " end", "nothing of it is here at all", "a b a b a b a b a b a b a b a b", "a b a b a b a b a b a b a b a b a", twice]
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    near = {(i, j) for i in range(5) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2}
    root = list(range(5))
    for i, j in sorted(near | {(i, j) for i in range(5) for j in range(i) if len(brute_kept([texts[j], texts[i]])) == 1}):
        root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    kept = sorted(r["doc_id"] for r in simhash.drop_similar(documents(spark, texts), distance=2).collect())
    assert kept == sorted(set(root))
    alone = [documents(spark, ["x y z", "X  y z"]), documents(spark, [None, ""])]
    assert all(simhash.drop_similar(docs, distance=2).count() == 1 for docs in alone)


def test_the_pipeline_takes_simhash(spark, monkeypatch):
    seen, own = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda reps, distance=2, hot=simhash.HOT: seen.append(distance) or own(reps, distance, hot))
    corpus_pipeline.clean_duplicates(spark, documents(spark, ["a b c d e f", "a b c d e f", "g h"]), "").count()
    assert seen == [2]


def test_a_large_group_of_near_copies_is_no_square(spark, monkeypatch):
    """Copies of one text with few or many words changed: most are like the middle of the group, or like nothing; only few pairs are met beside those."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(400):
        words = list(base)
        for at in rng.sample(range(150), k % 9):
            words[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    made, keep = {}, simhash.Scratch.keep

    def kept_too(self, df, name="t"):
        out = keep(self, df, name)
        made[name] = [tuple(r) for r in out.collect()] if name in ("cross", "live-rooted") else None
        return out

    monkeypatch.setattr(simhash.Scratch, "keep", kept_too)
    kept = simhash.drop_similar(documents(spark, texts))
    want = brute_kept(texts)
    assert sorted(r["doc_id"] for r in kept.collect()) == want and 50 < len(want) < 350
    groups = Counter(r[0] for r in made["live-rooted"])
    assert len(made["cross"]) < 2 * len(texts) and sum(n * n for n in groups.values()) < 20 * len(texts)
