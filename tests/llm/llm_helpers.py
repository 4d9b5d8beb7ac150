"""Small corpora and brute-force versions that the tests share."""

import re
from collections import Counter

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, _row string"
WORDS = "the of and to in ship tree river stone light cloud paper glass table chair lamp".split()


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, "clash", "clash") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [None, "", "   ", "a", "x " * 30_000, "é ﬁ ẞ", "same text", "same text"]
SECRET = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"


def brute_hits(text, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    ws, hit, names = split(text), set(), set()
    for name, t in items:
        iw = split(t)
        n = min(window, len(iw))
        for k in range(len(iw) - n + 1 if n else 0):
            for p in range(len(ws) - n + 1):
                if ws[p : p + n] == iw[k : k + n]:
                    hit |= set(range(p, p + n))
                    names.add(name)
    return len(ws), len(hit), sorted(names)


def brute_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(shingles))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def toxic_corpus(rng, n):
    rows = []
    for k in range(n):
        y = k % 5 == 0
        ws = [rng.choice(WORDS) for _ in range(60)]
        for _ in range(3 if y else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(["dreck", "vile", "rotten"]))
        rows.append((k, " ".join(ws), int(y)))
    return rows
