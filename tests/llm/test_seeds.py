"""Words that label toxic tokens are chosen by their surroundings, which copies do not multiply."""

import random

import numpy as np

from llm_helpers import toxic_corpus
from logweave.llm import toxicity
from logweave.llm.shared import Numbers


def evident(texts, labels):
    index = Numbers()
    place = np.array([index[w] for t in texts for w in t], np.int64)
    found = toxicity.evident(place, np.array([len(t) for t in texts]), np.array(labels), len(index))
    return {w for w, k in index.items() if found[k]}


def brute_force(texts, labels, least=4, share=0.8, nats=12.0):
    total = sum(map(len, texts))
    expected = sum(len(t) for t, y in zip(texts, labels, strict=True) if y) / total
    around, spread = {}, {}
    for k, (t, y) in enumerate(zip(texts, labels, strict=True)):
        padded = ["", *t, ""]
        for i, w in enumerate(t):
            around.setdefault(w, (set(), set()))[y].add((padded[i], padded[i + 2]))
            if y:
                spread.setdefault(w, set()).add(k)
    out = set()
    for w, (clean, toxic) in around.items():
        n, other = len(toxic), len(clean)
        if n and n / (n + other) >= share:
            gain = n * np.log(n / (n + other) / expected) + (other * np.log(other / (n + other) / (1 - expected)) if other else 0)
            if gain >= nats and min(len({a for a, _ in toxic}), len({b for _, b in toxic}), len(spread[w])) >= least:
                out.add(w)
    return out


def test_clean_copies_cannot_outvote():
    corpus = toxic_corpus(random.Random(4), 300)
    texts, labels = [toxicity.tokens(t) for _, t, _ in corpus] + [[]], [y for _, _, y in corpus] + [1]
    marks = evident(texts, labels)
    assert marks and marks == brute_force(texts, labels)
    copy = ["a", *(w for m in sorted(marks) for w in (m, "so")), "b"]
    assert evident(texts + [copy] * 400, labels + [0] * 400) == marks
    assert evident(texts, [0] * len(labels)) == set()
