"""Importance resampling, line rules and the repair of conversations against brute-force versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from llm_helpers import ODD, WORDS, documents, sentence

from logweave.llm import conversations, importance, line_rules

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text):
    w = SPLIT.findall(lowered(text))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_importance(docs, target, percent=5, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))
    rows = []
    for i, text in docs:
        n, fs = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        rows.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = may[: percent * len(may) // 100]
    return rows, drawn


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_importance(spark, monkeypatch):
    rng = random.Random(7)
    texts = [*ODD, "Äpfel ÄPFEL A1b2 x_y", "z" * 700 + " " + "y" * 300 + " q", "a" * 5000, *(sentence(rng, rng.randrange(60)) for _ in range(80))]
    docs = list(enumerate(texts)) + [(None, texts[20]), (5, texts[30]), (5, texts[30])]
    target = [sentence(rng, 30), None, "", "table chair lamp"]
    frame = documents(spark, [t for _, t in docs], [i for i, _ in docs])
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    rows, drawn = brute_importance(docs, target)
    for block, piece in ((importance.BLOCK, importance.PIECE), (3000, 500)):
        monkeypatch.setattr(importance, "BLOCK", block)
        monkeypatch.setattr(importance, "PIECE", piece)
        got = importance.resample(frame, goal).collect()
        assert sorted_rows(r[:5] for r in got) == sorted_rows(rows)
        assert [r["score"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [r[4] for r in drawn]
        assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_importance_empty(spark):
    none = documents(spark, [])
    assert importance.resample(none, none).count() == 0
    assert [r["rank"] for r in importance.resample(documents(spark, [None, ""]), none).collect()] == [None, None]


def test_hashes_of_runs():
    words = [b"a", b"", "é".encode(), b"x" * 254, b"y" * 255, b"z" * 256, b"w" * 1000]
    numbers = [list(x) for x in zip(*itertools.product(range(len(words)), repeat=3), strict=True)]
    import numpy as np

    got = importance.Hashes(words).of([np.array(n) for n in numbers])
    assert got.tolist() == [zlib.crc32(b" ".join(words[k] for k in ks)) for ks in zip(*numbers, strict=True)]


def test_large_vocabularies():
    """Keys of three words by way of pairs."""
    block = importance.Block([b"a b c a b d", b"", b"b c"])
    plain = [block.numbers(block.runs(k)[0], k) for k in (1, 2, 3)]
    block.words = [*block.words, *[b""] * (1 << 21)]
    for k, want in enumerate(plain, 1):
        keys = block.runs(k)[0]
        assert [x.tolist() for x in block.numbers(keys, k)] == [x.tolist() for x in want]
        if k == 3:
            assert set(block.heads(keys).tolist()) <= set(block.runs(2)[0].tolist())


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {p for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
    full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(hit), failed


def brute_lines(text):
    out = []
    for x in (text or "").split("\n"):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[0-9]", "0", lowered(x)))
        if w:
            out.append((" ".join(w), len(w)))
    return out


def brute_common(rows, most, share):
    """(host, text) -> words in lines above the limits."""
    texts = {(h, t or "") for h, t in rows}
    count = Counter((h, line) for h, t in texts for line in {x for x, _ in brute_lines(t)})
    hosts = Counter(h for h, _ in texts)
    common = {k for k, n in count.items() if n > most and n > share * hosts[k[0]]}
    return {(h, t): sum(n for line, n in brute_lines(t) if (h, line) in common) for h, t in texts}


LINED = "doc_id long, text string, source string, name string, lines string, key int, words string, _at string, _words int"


def corpus(rng):
    bars = ["Share this   page 12", "all rights reserved", "\tshare THIS page 99 "]
    rows = [(None, None), ("h", ""), ("h", "  \n\t\n"), ("h", "x " * 20_000), ("h", "# $ <b> | * & % >\n" * 3)]
    for k in range(60):
        lines = [sentence(rng, rng.randrange(12)) for _ in range(rng.randrange(12))] + rng.sample(bars, rng.randrange(4)) * rng.randrange(1, 4)
        rng.shuffle(lines)
        rows.append((rng.choice(["h", "g", None, ""]), rng.choice(["\n", "\r\n", "\n\n"]).join(lines)))
    return rows + rows[10:20] * 3


@pytest.mark.parametrize("bits", [24, 58, 2])
def test_base_measures_and_common_lines(spark, monkeypatch, bits):
    """bits: 58 leave six bits of hash, so most texts hold windows that share them; 2 leave no places for long texts."""
    monkeypatch.setattr(line_rules, "PLACE_BITS", bits)
    rng = random.Random(bits)
    rows = corpus(rng)
    frame = spark.createDataFrame([(i if i % 9 else None, t, h, "clash", "clash", 1, "clash", "clash", 2) for i, (h, t) in enumerate(rows)], LINED)
    got = line_rules.judged(frame, most=3, share=0.1)
    common = brute_common(rows, 3, 0.1)
    want = []
    for i, (h, t) in enumerate(rows):
        *base, failed = brute_measures(t)
        gone = common[h, t or ""]
        want.append((i if i % 9 else None, *base, failed, gone, not failed and not base[0] - gone < 0.5 * base[0]))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_common_words", "kept"]
    assert sorted_rows(got.select(columns).collect()) == sorted_rows(want)
    assert any(r[-2] for r in want) and any(r[-1] for r in want)


def test_clean_lines(spark):
    rng = random.Random(3)
    bar = "share this page"
    rows = [(k, "\n".join([" ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) + "abcdef"[k % 6] for _ in range(60)).translate(str.maketrans("0123456789", "qwrtzpsdfg")), bar, "", bar.upper() + "  "]), "h") for k in range(30)]
    rows += [(99, "\n".join([bar] * 20 + ["one two"]), "h"), (None, None, None)]
    frame = spark.createDataFrame([(*r, "n", "l", 1, "w", "a", 2) for r in rows], LINED)
    got = line_rules.clean(frame, most=20, share=0.01)
    assert got.columns == frame.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted((k, t.split("\n")[0] + "\n") for k, t, _ in rows[:30])
    assert line_rules.clean(frame.limit(0)).count() == 0


COST = {"K": 0, "R": 1, "D": 2, "I": 5}


def brute_repair(turns):
    """turns: (role, text) in order. The least (cost, audit) over all edits with at most two insertions in each gap, and the repaired turns."""
    seen, flags, faults = set(), [], Counter()
    for role, text in turns:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        duplicate = not blank and (role, text) in seen
        cut = not blank and not duplicate and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
        faults["blank"] += blank
        faults["duplicate"] += duplicate
        faults["truncated"] += cut
        seen.add((role, text))
        flags.append((blank or duplicate, cut))
    best = {("", ""): (0, "", ())}  # what was last kept, whether anything was

    def better(into, key, value):
        if key not in into or value[:2] < into[key][:2]:
            into[key] = value

    def inserted(states):
        for _ in range(2):
            out = dict(states)
            for (last, _), (cost, audit, made) in states.items():
                new = "assistant" if last == "u" else "user"
                better(out, (new[0], "x"), (cost + 5, audit + "I", (*made, (new, ""))))
            states = out
        return states

    for (role, text), (must, cut) in zip(turns, flags, strict=True):
        out = {}
        for (last, some), (cost, audit, made) in inserted(best).items():
            better(out, (last, some), (cost + 2, audit + "D", made))
            if must:
                continue
            for letter, new in (("K", role), ("R", "user"), ("R", "assistant")):
                initial = new[:1]
                if (initial == "s" and not some) or (initial == "u" and last in ("", "s", "a")) or (initial == "a" and last == "u"):
                    better(out, (initial, "x"), (cost + COST[letter] + 5 * cut, audit + letter, (*made, (new, text))))
        best = out
    cost, audit, made = min((v for (last, _), v in inserted(best).items() if last in ("", "a")), key=lambda v: v[:2])
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    return dict(faults, illegal=illegal, cost=cost, audit=audit, repaired_sha256=hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def brute_damage(rows):
    out = []
    for c, turn, role, text in rows:
        name = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def brute_digest(rows, damaged):
    out = []
    for c in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in damaged if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in mine if t is not None]
        found = brute_repair([r[1:] for r in mine])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *[found.get(k, 0) for k in ("blank", "duplicate", "truncated", "illegal", "cost")], found["audit"], found["repaired_sha256"]))
    return sorted(out, key=repr)


TALK = "conv_id long, turn long, role string, text string, c string, o int, n string"


def talks(rng, n, longest):
    says = ["Yes.", "No", "", " \t", "Why? ", "Well, ok!\n", "same.", "x" * 200 + "."]
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "ui"])
            rows.append((c if c else None, rng.choice([turn, turn, turn, None, turn // 2, turn * 3]), role, rng.choice([*says, f"say {rng.randrange(50)}.", f"say {rng.randrange(50)}", None])))
    return rows + rng.sample(rows, len(rows) // 10)


@pytest.mark.parametrize(("segment", "fan", "longest"), [(256, 8, 9), (3, 1, 30), (4, 2, 60)])
def test_repair(spark, monkeypatch, segment, fan, longest):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    monkeypatch.setattr(conversations, "FAN", fan)
    rows = talks(random.Random(longest), 40 if longest < 10 else 12, longest)
    frame = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], TALK)
    damaged = conversations.damage(frame)
    assert sorted_rows(damaged.collect()) == sorted_rows(brute_damage(rows))
    got = conversations.digests(frame, damaged)
    assert sorted_rows(got.collect()) == brute_digest(rows, brute_damage(rows))


def test_repair_of_equal_rows_and_empty_tables(spark):
    rows = [(1, 4, "user", "Hello.")] * 500 + [(1, 5, "assistant", "Hi.")] + [(2, None, None, None)] * 3
    frame = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], TALK)
    assert sorted_rows(conversations.digests(frame, frame.select("conv_id", "turn", "role", "text")).collect()) == brute_digest(rows, [(c, t, r or " ", x or " ") for c, t, r, x in rows])
    assert conversations.digests(frame.limit(0), conversations.damage(frame.limit(0))).count() == 0
    gone = conversations.digests(frame, frame.select("conv_id", "turn", "role", "text").where("conv_id = 9")).collect()
    assert {(r["audit"], r["cost"], r["repaired_sha256"]) for r in gone} == {("", 0, hashlib.sha256(b"").hexdigest())}
