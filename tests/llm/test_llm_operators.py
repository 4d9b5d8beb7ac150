"""The operators against brute-force versions, and on odd input."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_helpers import ODD, SECRET, WORDS, brute_components, brute_fingerprint, brute_hits, documents, sentence, toxic_corpus
from logweave.llm import bpe, class_lm, decontaminate, digest, html_text, rans, resample, secrets, simhash, toxicity



# ------------------------------------------------------------------ 1


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>one<p>two", "one\n\ntwo"), ("<script>x<p>y", ""), ("<p>a < b", "a < b"),
        ("<body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div><article><h1>T</h1><p><b>T &eacute;.<br><p>Long \n text&nbsp;here.</p></article><footer>&copy;</footer></body>", "T\n\nT é.\n\nLong text here."),
        ("<main><article><header><h1>T</h1>by me</header><section><p>One two three four five.</p></section><section><p>Six.</p></section><div id='comments'><p>Nice and very long reader comment indeed, so dense.</p></div></article></main><aside>s</aside><form>f</form>", "T\n\nOne two three four five.\n\nSix."),
        ("<body><div class=cookie-notice>We use cookies</div><div><p>First long paragraph of the page.</p><p>Second long paragraph of it.</p></div><div><a href=a>l</a> <a href=b>m</a></div></body>", "First long paragraph of the page.\n\nSecond long paragraph of it."),
    ],
)
def test_html(page, want):
    assert html_text.main_text(page) == want


LONG = "A rather long paragraph of plain words stands here, so that it is dense."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><p title=it's>One is here.</p><p>{LONG}</p><p>Two isn't it.</p></body>", f"One is here.\n\n{LONG}\n\nTwo isn't it."),
        (f'<article><p title="the hidden valley">Valley.</p><p data-id="comment">Data.</p><p>{LONG}</p></article>', f"Valley.\n\nData.\n\n{LONG}"),
        (f'<div class="no-ad side-by-side"><h1 class="article-header">Head</h1><p>{LONG}</p></div>', f"Head\n\n{LONG}"),
        (f'<body><form id=f action=/><input name=q><label>Search</label><div><h1>T</h1><p>{LONG}</p></div></form></body>', f"T\n\n{LONG}"),
        (f'<body><div><p>{LONG}</p></div><form><p>Your name <input></p></form></body>', LONG),
        (f"<article><p>{LONG} So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", f"{LONG} So x=2 holds."),
        (f"<article><!--><p>{LONG}</p><!---><p>B.</p><!-- c --><p>C.</p></article>", f"{LONG}\n\nB.\n\nC."),
        (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><p>One line.</p><ul><li><a href=x>other page</a></li></ul></body>", f"{LONG}\n\n{LONG}\n\nOne line."),
        (f'<main><p>{LONG}</p><div class="cookie-notice">We use them.</div><div class="post-comments">x</div><section id="sidebar-left">y</section><div hidden>z</div></main>', LONG),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\n\nb\n\nc\n\nd"), ("<p>x</ >y<i>z</b></i></p>", "xyz"), ("<form><p>only a form</p></form>", "only a form"), ("<form><input>only a form</form>", ""),
    ],
)
def test_html_attributes_forms_and_comments(page, want):
    assert html_text.main_text(page) == want


def test_html_densities_by_brute_force():
    rng = random.Random(21)

    def grow(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"<a href=x>{sentence(rng, rng.randrange(1, 4))}</a>" if rng.random() < 0.3 else sentence(rng, rng.randrange(1, 30))
        return f"<{(n := rng.choice(['div', 'section', 'span']))}>" + "".join(grow(depth - 1) for _ in range(rng.randrange(1, 5))) + f"</{n}>"

    def facts(node, link):
        """Characters, tags, link characters, link tags: counted again for every node, by walking all below it."""
        c = t = lc = lt = 0
        for k in node.kids:
            if isinstance(k, str):
                n = len(k.strip()) - k.strip().count(" ")
                c, lc = c + n, lc + n * link
            else:
                inner = facts(k, link or k.name == "a")
                c, t, lc, lt = c + inner[0], t + inner[1] + 1, lc + inner[2], lt + inner[3]
        return c, t, lc, lt + link

    for _ in range(40):
        body = html_text.parse("<body>" + grow(5) + "</body>").kids[0]
        html_text.measure(body)
        C, _, LC, _ = facts(body, False)

        def density(node, link, C=C, LC=LC):
            c, t, lc, lt = facts(node, link)
            if not c:
                return 0.0
            t, lt = max(1, t), max(1, lt)
            base = math.log(c / max(1, c - lc) * lc + LC / max(1, C) * c + math.e)
            ratio = math.log(c / max(1, lc) * t / lt)
            return c / t * max(0.0, ratio) / math.log(base) if base > 1 + 1e-9 else c / t * max(0.0, ratio + 1)

        nodes, stack = [], [(body, False)]
        while stack:
            node, link = stack.pop()
            nodes.append((node, link))
            stack += [(k, link or k.name == "a") for k in node.kids if not isinstance(k, str)]
        sums = {}
        for node, link in nodes:
            text = sum(len(k.strip()) - k.strip().count(" ") for k in node.kids if isinstance(k, str))
            sums[id(node)] = (0 if link else text) + sum(density(k, link or k.name == "a") for k in node.kids if not isinstance(k, str))
            assert abs(node.density - density(node, link)) < 1e-6 and abs(node.total - sums[id(node)]) < 1e-6
        assert abs(body.best.total - max(sums.values())) < 1e-6


def test_html_takes_time_in_proportion():
    import time

    for page in ("<i><div>" + "<b>" * 40_000 + "</i>" * 40_000, "<svg>" * 20_000 + "x" * 100_000, "<p>" + "<b>" * 20_000 + "<div></div>" * 20_000, "<a b='" * 3000 + "x" * 100_000):
        began = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - began < 5


def test_html_deep_and_broken(spark):
    assert html_text.main_text("<div>" * 50_000 + "x") == "x"
    rows = spark.createDataFrame([(1, "u", "<p>a</p>", 5), (1, "u", "<p>a</p>", 5), (None, None, None, None)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, html_text.extract(rows).collect()), key=str) == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert html_text.extract(rows.limit(0)).count() == 0


# ------------------------------------------------------------------ 2


@pytest.mark.parametrize("block_words", [7, 2_000_000])
def test_decontamination_against_brute_force(spark, monkeypatch, block_words):
    rng = random.Random(1)
    items = [(f"i{k}", sentence(rng, rng.choice([0, 3, 9, 10, 11, 25]))) for k in range(12)] + [("i3", "The River, stone!"), ("n", None), ("é", "über Éa ß")]
    texts = [sentence(rng, 40) for _ in range(10)] + [f"{sentence(rng, 5)} {rng.choice(items[:12])[1].upper()} {sentence(rng, 5)}" for _ in range(20)] + ODD + ["x über Éa ß"]
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (block_words,))
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = documents(spark, texts)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find(docs, bench).collect()}
    want = {k: brute_hits(t, items) for k, t in enumerate(texts)}
    assert got == want
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, w in want.items() if not w[1]}


def test_decontamination_of_null_and_repeated_ids(spark, monkeypatch):
    items = [("a", "one two three four five six seven eight nine ten eleven"), (None, "short item")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [(None, "x " + items[0][1]), (4, "a short item here"), (4, "nothing"), (4, None), (None, "nothing")]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    for size in (1, 1000):
        monkeypatch.setattr(decontaminate.blocks, "__defaults__", (size,))
        got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.find(docs, bench).collect())
        assert got == Counter([(None, 12, 11, ("a",)), (4, 4, 2, ("",)), (4, 1, 0, ()), (4, 0, 0, ()), (None, 1, 0, ())])


def test_longest_match_and_empty_benchmark(spark):
    bench = spark.createDataFrame([("a", " ".join(f"w{k}" for k in range(30)))], "item_id string, text string")
    row = decontaminate.find(documents(spark, ["x y " + " ".join(f"w{k}" for k in range(5, 20)) + " z"]), bench).first()
    assert (row["longest"], row["longest_item"], row["longest_at"], row["n_hit"]) == (15, "a", 2, 15)
    none = decontaminate.find(documents(spark, ODD), bench.limit(0)).collect()
    assert len(none) == len(ODD) and all(r["n_hit"] == 0 for r in none)


# ------------------------------------------------------------------ 3


def test_simhash_against_brute_force(spark):
    rng = random.Random(2)
    base = [sentence(rng, 300) for _ in range(8)]
    texts = base + [t.replace(" the ", f" {w} ", 1) for t in base for w in ("river", "lamp", "of")] + ODD
    prints = {k: brute_fingerprint(t) for k, t in enumerate(texts)}
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    components = brute_components(prints)
    assert got == {k: (prints[k], components[k]) for k in prints}
    kept = simhash.drop_near_duplicates(documents(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(components.values())) and kept.columns == documents(spark, []).columns


@pytest.mark.parametrize("hot", [0, 3, 64])
@pytest.mark.parametrize("distance", [0, 1, 2])
def test_links_by_distance(spark, distance, hot):
    rng = random.Random(3)
    prints = {0}
    for _ in range(60):
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64) if rng.random() < 0.5 else 0))
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    from logweave.operators.graph import connected_components
    from logweave.session import Scratch

    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), distance, hot)
    assert all((r["src"] ^ r["dst"]) % (1 << 64) and ((r["src"] ^ r["dst"]) % (1 << 64)).bit_count() <= distance for r in links.collect())
    got = {}
    for r in connected_components(links, Scratch(spark)).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    left, want = set(signed), []
    while left:
        group, edge = set(), [left.pop()]
        while edge:
            p = edge.pop()
            group.add(p)
            near = {q for q in left if ((p ^ q) % (1 << 64)).bit_count() <= distance}
            left -= near
            edge += near
        want.append(group)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want if len(g) > 1)


def test_fetched_candidates_are_verified(spark):
    prints = [0x0000000F_00000001, 0x0000F00F_00000001, 0x0000000F_00000F01, 0x0000000E_00000F01, 0x0000000E_00000001, 0x00F0000F_00000003]
    reps = spark.createDataFrame([(p,) for p in prints], "fp long")
    fetch, meet = simhash.fetched(reps, 2)
    candidates = {frozenset((r["fp"], m)) for r in fetch.collect() for m in r["members"] if m != r["fp"]}
    true = {frozenset((a, b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 2}
    assert true < candidates and meet.count() == 0
    assert {frozenset((r["src"], r["dst"])) for r in simhash.links(reps, 2).collect()} == true
    assert {r["fp"] for r in simhash.fetched(reps, 2, hot=1)[1].collect()} == set(prints[:5])  # the last one is alone wherever it looks


def test_drop_with_null_and_repeated_ids(spark):
    texts = ["alpha beta gamma delta"] * 3 + ["only here with no id at all"] * 2 + ["alpha beta gamma delta"]
    kept = simhash.drop_near_duplicates(documents(spark, texts, [7, 7, 9, None, None, None])).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(7, texts[0]), (None, texts[3])])
    assert simhash.drop_near_duplicates(documents(spark, [])).count() == 0


# ------------------------------------------------------------------ 4 and 9

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("word_bpe_49k.json")
TEXT = st.text(st.one_of(st.sampled_from(list(" \n\t'aAeEsStT.,09é́ßΣσ日　 ")), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(TEXT, st.sampled_from(["<|endoftext|>", "a<|endoftext|> b", "aaaa aaaaaaa", "don't we'LL"])), max_size=6))
def test_bpe_is_the_library(texts):
    library, coder = Tokenizer.from_file(BPE), bpe.coder(BPE)
    ids, bounds = coder.encode(texts)
    for k, t in enumerate(texts):
        own, want = ids[bounds[k] : bounds[k + 1]], library.encode(t, add_special_tokens=False).ids
        assert own.tolist() == want and coder.decode(own) == library.decode(want, skip_special_tokens=False)


def test_bpe_of_long_words(spark, monkeypatch):
    library, coder = Tokenizer.from_file(BPE), bpe.coder(BPE)
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC") for _ in range(n)) for n in (300, 5000, 60_000)] + ["a" * 1001, "ab" * 700, "é" * 500, "thethe" * 300, "x"]
    for w in (*words, " ".join(words)):
        ids, _ = coder.encode([w])
        assert ids.tolist() == library.encode(w, add_special_tokens=False).ids
    short = [w.encode() for w in ("the", "aaaa", "aaaaa", "international", "é", "zzzzzzzzz", "unbelievable")]
    assert [x.tolist() for x in coder.merge_long(short)] == [x.tolist() for x in coder.merge(short)]
    docs = documents(spark, ["same text", None, "same text"], [None, 3, 3])
    assert Counter((r["doc_id"], r["n_tokens"]) for r in bpe.digests(docs, BPE).collect()) == Counter([(None, 2), (3, 0), (3, 2)])


def test_bpe_on_rows(spark):
    library = Tokenizer.from_file(BPE)
    got = {r["doc_id"]: r for r in bpe.digests(documents(spark, ODD), BPE).collect()}
    for k, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[k]["n_tokens"], got[k]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    coded = bpe.encode(documents(spark, ODD), BPE, same_col="decodes")
    assert all(r["decodes"] for r in coded.collect())
    assert [r["text"] for r in bpe.decode(coded.drop("text"), BPE).orderBy("doc_id").collect()] == [t or "" for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(TEXT, st.sampled_from(["<|startoftext|> a<|endoftext|>b", "ΑΣ. İ, ﬁ."])), max_size=6))
def test_words_are_the_library(texts):
    library, words = Tokenizer.from_file(PIECES), rans.tokenizer(PIECES)
    ids, sizes = words.ids(texts, 2)
    ends = np.cumsum(sizes)
    for k, t in enumerate(texts):
        assert ids[ends[k] - sizes[k] : ends[k]].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20_000), min_size=1, max_size=4), st.integers(1, 50_000), st.integers(0, 1000))
def test_rans_round_trip(sizes, symbols, seed):
    rng = np.random.default_rng(seed)
    parts = [np.minimum(rng.geometric(0.01, n), symbols) - 1 for n in sizes]
    table = rans.Table(np.bincount(np.concatenate(parts), minlength=symbols))
    assert int(table.freq.sum()) == 1 << rans.BITS
    frames = [(*rans.encode(p, table), len(p)) for p in parts]
    assert all(np.array_equal(a, b) for a, b in zip(rans.decode(frames, table), parts, strict=True))


def test_rans_files(spark, tmp_path):
    rng = random.Random(4)
    texts = [sentence(rng, rng.randrange(400)) for _ in range(300)] + ODD
    ids = [5 * k - 40 for k in range(len(texts))]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = documents(spark, [texts[k] for k in order], [ids[k] for k in order])
    rans.write(docs, str(tmp_path / "set"), PIECES, shards=5)
    rows = rans.read(spark, str(tmp_path / "set"), keep_ids=True).orderBy("start").collect()
    library, start = Tokenizer.from_file(PIECES), 0
    for r, i, t in zip(rows, ids, texts, strict=True):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, start, len(want), want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    assert rans.round_trip(documents(spark, []), PIECES).count() == 0


def test_another_vocabulary_goes_through_the_library(spark):
    library, words = Tokenizer.from_file(BPE), rans.tokenizer(BPE)
    assert not words.by_chunks and rans.tokenizer(PIECES).by_chunks
    texts = ["Two  words, here\n", "", "<|endoftext|> x"]
    ids, sizes = words.ids(texts, 2)
    assert ids.tolist() == [i for t in texts for i in [*library.encode(t, add_special_tokens=False).ids, 2]] and sizes.sum() == len(ids)
    docs = documents(spark, ["b", "a", None, "a"], [None, 7, 7, None])
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rans.round_trip(docs, PIECES).collect()) == Counter([(None, 2), (7, 2), (7, 1), (None, 2)])


def test_damage_is_found(spark, tmp_path):
    rans.write(documents(spark, ["some words here"] * 3), str(tmp_path / "set"), PIECES)
    bad = spark.read.parquet(str(tmp_path / "set" / "blocks")).withColumn("payload", F.concat("payload", F.lit(b"\0")))
    bad.write.parquet(str(tmp_path / "bad" / "blocks"))
    spark.read.parquet(str(tmp_path / "set" / "table")).write.parquet(str(tmp_path / "bad" / "table"))
    with pytest.raises(Exception, match="damaged block"):
        rans.read(spark, str(tmp_path / "bad")).collect()


# ------------------------------------------------------------------ 5


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.fit(secrets.labelled_findings(spark))


def test_forest_separates_unseen_findings(spark, forest):
    unseen = secrets.labelled_findings(spark, 1500, first=secrets.FINDINGS)
    seen = secrets.labelled_findings(spark)
    again = unseen.join(seen, ["before", "candidate", "after", "path"], "left_semi").where("label = 1")
    assert again.count() == 0
    rows = unseen.select("label", F.struct(*secrets.features(F.col("path"), F.col("before"), F.col("candidate"), F.col("after"))).alias("f"))
    rows = rows.select("label", F.expr(forest.sql("f")).alias("chance"), "f").collect()
    assert np.mean([(r["chance"] >= 0.5) == bool(r["label"]) for r in rows]) > 0.97
    assert all(abs(forest.chance(r["f"].asDict()) - r["chance"]) < 1e-9 for r in rows[:100])


def test_scan_and_redact(spark, forest):
    texts = [f'x é token = "{SECRET}" y', f"commit {SECRET[::-1]} done", 'password = "your_password_here"', f'a="1" secret: {SECRET[:32]} and token="{SECRET}"', *ODD]
    docs = documents(spark, texts)
    found = secrets.scan(docs, forest).collect()
    for r in found:
        assert texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["candidate"]
    assert {r["doc_id"] for r in found if r["secret"]} == {0, 3}
    out = {r["doc_id"]: r for r in secrets.redact(docs, forest, size_col="n_chars").collect()}
    assert out[0]["text"] == 'x é token = "[SECRET]" y' and out[0]["n_chars"] == len(out[0]["text"])
    assert out[3]["text"] == 'a="1" secret: [SECRET] and token="[SECRET]"'
    assert all(out[k]["text"] == texts[k] for k in range(len(texts)) if k not in (0, 3))
    assert secrets.scan(docs.limit(0), forest).count() == 0


def test_candidates_against_brute_force(spark, forest):
    rng = random.Random(12)
    names = ["token", "Secret", "PASSWORD", "passwd", "pwd", "api_key", "apikey", "ACCESS-KEY", "auth_key", "credential", "Bearer", "monkey"]
    run = lambda n: "".join(rng.choice("abcXYZ019_-+/") for _ in range(n))
    shapes = [lambda: f"{rng.choice(names)}{rng.choice([' = ', ':', '=>', ' '])}{rng.choice(['', chr(34)])}{run(rng.randrange(3, 300))}", lambda: run(rng.choice([31, 32, 33, 400])), lambda: "AKIA" + "Q1" * 8, lambda: "ghp_" + "a1" * 18, lambda: "xoxb-" + "1a" * 6, lambda: "sk_live_" + "Zz9" * 6]
    shapes += [lambda: f"https://me:{run(9)}@host/x", lambda: "eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 5, lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + "QUJD" * 9 + "\n-----END RSA PRIVATE KEY-----", lambda: sentence(rng, 3), lambda: "\ufdd0", lambda: "é日 🙂"]
    texts = [rng.choice([" ", "\n", ", "]).join(rng.choice(shapes)() for _ in range(rng.randrange(8))) for _ in range(150)] + [" ".join(f"token={k:06d}" for k in range(700))] + ODD
    pattern = re.compile(secrets.PATTERN, re.A)
    bare = re.compile(secrets.ASSIGNED, re.A)
    want = Counter()
    for k, t in enumerate(texts):
        for m in pattern.finditer(t or ""):
            name = bare.match(m[0])
            start = m.start() + (name.end() if name else 0)
            want[k, start, m[0][name.end() if name else 0 :]] += 1
    docs = documents(spark, texts)
    found = secrets.scan(docs, forest).collect()
    assert Counter((r["doc_id"], r["start"], r["candidate"]) for r in found) == want and len(want) > 900
    judged = {}
    for r in found:
        judged.setdefault(r["doc_id"], []).append(r)
    for r in secrets.redact(docs, forest).collect():
        t = texts[r["doc_id"]]
        for f in sorted(judged.get(r["doc_id"], []), key=lambda f: -f["start"]):
            if f["secret"]:
                t = t[: f["start"]] + "[SECRET]" + t[f["start"] + f["length"] :]
        assert r["text"] == t
    twice = documents(spark, ["token=abcdef1234XYZ987"] * 3, [None, 5, 5])
    assert secrets.scan(twice, forest).count() == 3 and secrets.redact(twice, forest).count() == 3


# ------------------------------------------------------------------ 6


def test_toxicity(spark):
    rows = toxic_corpus(random.Random(6), 500)
    docs = documents(spark, [t for _, t, _ in rows] + ODD, [*range(500), 1000, 1001, 1002, 1003, 1004, 1005, None, None])
    labels = spark.createDataFrame([(k, y, 1) for k, _, y in rows] + [(None, 1, 1), (99_999, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    field = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.tag(docs, field, carry=("doc_id",)).collect()}
    test = [(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(found[k]["score"] >= 0.5) == bool(y) for k, y in test]) > 0.97
    for k, t, y in rows[:50]:
        marked = [t[s["start"] : s["end"]] for s in found[k]["spans"]]
        assert all(set(m.split()) <= {"dreck", "vile", "rotten"} for m in marked) and bool(marked) == bool(y)
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[1001]["score"] < 0.5
    kept = toxicity.remove_toxic(docs, field)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    blank = toxicity.fit(docs, labels.limit(0))
    assert all(r["score"] < 1e-9 for r in toxicity.tag(docs, blank).collect())


def test_marginals_are_exact():
    rng = np.random.default_rng(7)
    move = rng.normal(size=(2, 2))
    sizes = np.array([0, 1, 5, 63, 64, 65, 200, 0, 300])
    p = rng.normal(size=sizes.sum())
    got, log_z, expected = toxicity.forward_backward(p, sizes, move, expect=True)
    at, m, want_z, want_pairs = 0, np.exp(move), 0.0, np.zeros((2, 2))
    for n in sizes:
        forward = [np.array([1.0, 0.0])]  # the clean tag stands before the first token, in training and in scoring
        for t in range(n):
            a = (forward[-1] @ m) * [1, math.exp(p[at + t])]
            want_z += math.log(a.sum())
            forward.append(a / a.sum())
        b = np.ones(2)
        for t in range(n - 1, -1, -1):
            both = forward[t + 1] * b
            assert abs(both[1] / both.sum() - got[at + t]) < 1e-9
            pair = forward[t][:, None] * m * (b * [1, math.exp(p[at + t])])[None, :]
            want_pairs += pair / pair.sum()
            b = m @ (b * [1, math.exp(p[at + t])])
            b /= b.sum()
        at += n
    assert abs(log_z - want_z) < 1e-6 and np.allclose(expected, want_pairs)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(8)
    p, move = rng.normal(size=6), rng.normal(size=(2, 2))
    weights = {}
    for code in range(64):
        tags = [code >> k & 1 for k in range(6)]
        weights[code] = math.exp(sum(move[a, b] for a, b in zip([0, *tags], tags, strict=False)) + sum(x for x, y in zip(p, tags, strict=True) if y))
    found, log_z, _ = toxicity.forward_backward(p, np.array([6]), move)
    assert abs(math.log(sum(weights.values())) - log_z) < 1e-9
    for k in range(6):
        assert abs(sum(w for code, w in weights.items() if code >> k & 1) / sum(weights.values()) - found[k]) < 1e-9


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(9)
    sizes, buckets = np.array([3, 0, 70, 1]), 12
    chains = [rng.integers(0, buckets, sizes.sum()) for _ in range(5)]
    tag, v = rng.random(sizes.sum()) < 0.3, rng.normal(size=buckets + 4) / 2
    _, slope = toxicity.loss(v, chains, sizes, tag, 0.05)
    for k in range(len(v)):
        step = np.zeros(len(v))
        step[k] = 1e-5
        ahead, behind = (toxicity.loss(v + x, chains, sizes, tag, 0.05)[0] for x in (step, -step))
        assert abs((ahead - behind) / 2e-5 - slope[k]) < 1e-7


# ------------------------------------------------------------------ 7


@pytest.mark.parametrize("head", [5, 1 << 18])
def test_class_lm(spark, head):
    rng = random.Random(8)
    left, right = WORDS[:8], WORDS[8:]
    texts = [" ".join(rng.choice(left if k % 2 else right) for k in range(rng.randrange(60))) for _ in range(200)] + [" ".join(["y" * 500, "Z9!", "q" * 64] * 3)] * 9 + ODD
    ids = [*range(len(texts) - 2), None, 7]
    train = [t for i, t in zip(ids, texts, strict=True) if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    split = lambda t: (t or "").encode().lower().split()
    count = Counter(w for t in train for w in split(t))
    total, distinct = sum(count.values()) + len(train), len(count) + 1
    fitted = []
    rows = class_lm.score(documents(spark, texts, ids), head=head, core=4, classes=2, fitted=fitted).collect()
    known, model = fitted
    number = {w: k for k, w in enumerate(known.words)}
    assert (len(number) == len(count)) == (head > 5)

    def place(w):
        k = number.get(class_lm.short(w))
        return (0, int(model.cls[k])) if k is not None else (1, int(model.cls[len(number) + class_lm.shape(class_lm.short(w))]))

    pairs, tokens, different = Counter(), Counter(), Counter()
    for t in train:
        cs = [2, *(place(w)[1] for w in split(t)), 2]
        pairs.update(zip(cs[:-1], cs[1:], strict=True))
    for w, n in count.items():
        tokens[place(w)] += n
        different[place(w)] += 1
    after, before = Counter(), Counter()
    for (a, b), n in pairs.items():
        before[a] += n
        after[b] += n
    step = lambda a, b: math.log10((pairs[a, b] + 10 * (after[b] + 1) / (sum(after.values()) + 3)) / (before[a] + 10))
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        ws = split(t)
        base = sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in [*(count[w] for w in ws), len(train)])
        own, c = 0.0, 2
        for w in ws:
            kind, k = place(w)
            own += step(c, k) + math.log10((tokens[kind, k] + 1) / (tokens[0, k] + tokens[1, k] + 2)) + math.log10((count[w] + 0.1) / (tokens[kind, k] + 0.1 * (different[kind, k] + 1)))
            c = k
        want[i, len(ws) + 1, sum(count[w] > 0 for w in ws) + 1, total, round(base, 5), round(own + step(c, 2), 5)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in rows) == want
    held = [r for r in rows if r["held_out"] and 2 < r["n_tokens"] < 100]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert class_lm.score(documents(spark, [])).count() == 0


def test_exchange_finds_the_two_classes():
    pairs = np.zeros((9, 9))
    for a in range(8):
        for b in range(8):
            pairs[a, b] = 10 if (a < 4) != (b < 4) else 0
    own = class_lm.exchange(pairs, 2)
    assert len(set(own[:4])) == 1 and len(set(own[4:])) == 1 and own[0] != own[7]


def test_gains_are_differences_of_the_likelihood():
    rng = np.random.default_rng(5)
    pairs, own = rng.integers(0, 9, (12, 12)), rng.integers(0, 4, 12)

    def table(own):
        hot = np.zeros((12, 4))
        hot[np.arange(12), own] = 1
        return hot.T @ pairs @ hot, pairs @ hot, pairs.T @ hot

    t, to, since = table(own)
    both = np.diagonal(pairs).astype(float)
    to[np.arange(12), own] -= both
    since[np.arange(12), own] -= both
    gain = class_lm.gains(t, own, to, since, both)
    for w in range(12):
        for k in range(4):
            moved = own.copy()
            moved[w] = k
            assert abs(class_lm.likelihood(table(moved)[0]) - class_lm.likelihood(t) - (gain[w, k] - gain[w, own[w]])) < 1e-6


def test_rounds_over_all_words_raise_the_likelihood(spark):
    rng = random.Random(13)
    groups = [[f"{c}{k}" for k in range(12)] for c in "abcd"]
    texts = [[rng.randrange(12) + 12 * (k % 4) for k in range(40)] for _ in range(150)]
    assert len(groups) == 4
    coded = spark.createDataFrame([(t,) for t in texts] + [([],)], "ids array<int>")
    from logweave.session import Scratch

    def level(rounds):
        cls = class_lm.cluster(coded, 48, 6, 4, rounds, Scratch(spark))
        return class_lm.likelihood(class_lm.class_pairs(coded, np.minimum(cls, 4), 6)), cls

    scores = [level(k)[0] for k in (1, 2, 5)]
    assert scores == sorted(scores)
    cls = level(5)[1]
    assert sum(len(set(cls[12 * g : 12 * g + 12].tolist())) for g in range(4)) <= 6


# ------------------------------------------------------------------ 8


def test_resampling(spark):
    rng = random.Random(9)
    good = [sentence(rng, 50) for _ in range(150)]
    junk = [" ".join(rng.choice(["zz", "qq%%", "###"]) for _ in range(50)) for _ in range(50)]
    docs = documents(spark, good + junk + ODD)
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(0, 200, 2)] + [(None, 1), (1, None)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in resample.resample(docs, labels, k=150).collect()}
    assert sum(r["selected"] for r in rows.values()) == 150
    assert sum(rows[k]["selected"] for k in range(150, 200)) == 0
    again = {r["doc_id"]: r["key"] for r in resample.resample(docs.repartition(3), labels, k=150).collect()}
    assert all(abs(again[k] - r["key"]) < 1e-9 for k, r in rows.items())
    assert resample.resample(docs.limit(0), labels).count() == 0
    assert all(r["log_weight"] == 0 for r in resample.resample(docs, labels.limit(0)).collect())


@pytest.mark.parametrize("k", [1, 2, 17, 99, 100])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([rng.gauss(0, 1000), 3.0, 7.5]) for _ in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    assert resample.kth_largest(df, "key", k, parts=8) == sorted(values, reverse=True)[k - 1]


# ------------------------------------------------------------------ 10


def canon(t):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub(r"\s+", " ", folded).strip(" ")


def printed(t):
    b = canon(t).encode()
    return f"{xxhash.xxh64_intdigest(b, 42):016x}{xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(b'logweave', 42)):016x}"


@pytest.mark.parametrize("rows_a_bucket", [3, 2048])
def test_digest_against_brute_force(spark, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(digest, "BUCKET_ROWS", rows_a_bucket)
    rng = random.Random(10)
    texts = [sentence(rng, rng.randrange(1, 20)) for _ in range(30)] + ODD + ["SAME  text", "STRASSE", "straße"]
    ids = sorted(rng.sample(range(-1000, 100_000), len(texts)), reverse=True)
    got = {r["doc_id"]: r for r in digest.edits(documents(spark, texts, ids)).collect()}
    assert len(got) == len(texts)
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        t, after = t or "", texts[(k + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), printed(t), printed(edited))
        assert (r["near_edited"], r["near_next"]) == (float(canon(t) == canon(edited)), float(canon(t) == canon(after)))


def test_digest_groups(spark):
    texts = ["Same  Text", "same text", "STRASSE", "straße", "other", None, ""]
    want = {0: (2, 0), 1: (2, 0), 2: (2, 2), 3: (2, 2), 4: (1, 4), 5: (2, 5), 6: (2, 5)}
    assert {r["doc_id"]: (r["copies"], r["first_id"]) for r in digest.groups(documents(spark, texts)).collect()} == want
    assert {r["doc_id"]: (r["copies"], r["first_id"]) for r in digest.edits(documents(spark, texts)).collect()} == want
    assert digest.edits(documents(spark, [])).count() == 0 and digest.groups(documents(spark, [])).count() == 0


def test_bytes_part_texts_of_one_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(digest, "fingerprint", lambda c: F.lpad(F.substring(c, 1, 1), 32, "0"))  # all texts of one first letter collide
    rows = digest.groups(documents(spark, ["ab", "AB", "ac", "b", "ab", "ad"])).collect()
    assert {r["doc_id"]: (r["copies"], r["first_id"]) for r in rows} == {0: (3, 0), 1: (3, 0), 2: (1, 2), 3: (1, 3), 4: (3, 0), 5: (1, 5)}


@pytest.mark.parametrize("rows_a_bucket", [2, 2048])
def test_digest_of_null_and_repeated_ids(spark, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(digest, "BUCKET_ROWS", rows_a_bucket)
    rng = random.Random(14)
    rows = [(rng.choice([None, None, 4, 4, 9, -3, 0]), sentence(rng, rng.randrange(1, 6))) for _ in range(60)] + [(4, "twice"), (4, "twice"), (None, None)]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    number = lambda t: (h := xxhash.xxh64_intdigest((t or "").encode(), 42)) - (1 << 64 if h >> 63 else 0)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), number(r[1]), r[1] or ""))
    want = Counter()
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        want[i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest(), sum(canon(x) == canon(t) for _, x in rows)] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["copies"]) for r in digest.edits(docs).collect()) == want


def test_bucket_bounds(spark):
    for n in (3, 300, 700):
        bounds = [(k > 0, 10 * k, -k) for k in range(n)]
        rows = spark.range(-5, 10 * n + 5, 7).select("id", F.struct((F.col("id") > 0).alias("p"), F.col("id").alias("i"), F.lit(-3).cast("long").alias("h")).alias("key"))
        for r in rows.select("id", digest.bucket_of(F.col("key"), bounds).alias("b")).collect():
            assert r["b"] == sum(x <= (r["id"] > 0, r["id"], -3) for x in bounds)
