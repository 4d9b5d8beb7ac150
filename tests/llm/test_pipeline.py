"""The pipeline against a plain version of its stages."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from llm_helpers import SECRET, brute_components, brute_fingerprint, brute_hits, sentence, toxic_corpus
from logweave.llm import toxicity


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_pipeline_against_plain_stages(spark, tmp_path):
    rng = random.Random(11)
    corpus = toxic_corpus(rng, 300)
    items = [(k, sentence(rng, 15)) for k in range(4)]
    texts = [t for _, t, _ in corpus] + [f"{sentence(rng, 20)} {items[k % 4][1]} {sentence(rng, 20)}" for k in range(8)]
    texts += [f'{sentence(rng, 20)} token = "{SECRET}" {sentence(rng, 5)}', "", None, "copy of one", "copy of one", corpus[1][1], "x " * 20_000]
    docs = [(k, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    write(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, tmp_path, "labels", [(k, 1, y) for k, _, y in corpus], "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "benchmark", items, "item_id long, text string")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    field = toxicity.fit(read("documents"), read("labels"))
    kept = {}
    for k, t in enumerate(texts):
        evidence, sizes, _ = field.evidence([toxicity.tokens(t)])
        if field.score(evidence, sizes)[0] < 0.5:
            kept[k] = t
    assert len(kept) < len(texts) - 40
    components = brute_components({k: brute_fingerprint(t) for k, t in kept.items()})
    kept = {k: t for k, t in kept.items() if components[k] == k}
    kept = {k: t for k, t in kept.items() if not brute_hits(t, items)[1]}
    kept = {k: t.replace(SECRET, "[SECRET]") if t else t for k, t in kept.items()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {k: r["ids"] for k, r in got.items()} == {k: library.encode(t or "", add_special_tokens=False).ids for k, t in kept.items()}
    assert all(r["decodes"] and r["n_tokens"] == len(r["ids"]) for r in got.values())
    assert all(r["n_chars"] == (None if texts[k] is None else len(kept[k])) for k, r in got.items())


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    write(spark, tmp_path, "documents", [], schema)
    write(spark, tmp_path, "labels", [], "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "benchmark", [], "item_id long, text string")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_null_and_repeated_ids_and_clashing_columns(spark, tmp_path):
    rng = random.Random(15)
    extra = "fp string, _row string, _text string, n_words long, score double, spans string, ids string, _id long, _cut string, bucket int, root long"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    items = [(1, sentence(rng, 12)), (None, None)]
    plain = [sentence(rng, 30) for _ in range(4)]
    rows = [(None, plain[0]), (None, plain[0]), (7, plain[1]), (7, plain[2]), (7, plain[1]), (8, f"x {items[0][1]} y"), (9, None), (None, None), (10, f'token = "{SECRET}"'), (11, plain[3])]
    docs = [(i, t, None, None, None, *(["clash"] * 3), 1, 0.5, "clash", "clash", 2, "clash", 3, 4) for i, t in rows]
    write(spark, tmp_path, "documents", docs, schema)
    write(spark, tmp_path, "labels", [(1, 1, 0)], "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "benchmark", items, "item_id long, text string")
    table, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == [f.split()[0] for f in schema.split(", ")] and all(r["fp"] == "clash" and r["root"] == 4 for r in table.collect())
        kept.append(sorted((str(r["doc_id"]), r["text"]) for r in table.collect() if r["text"] is not None))
    one = lambda *rows: sorted((str(i), t) for i, t in rows)
    assert kept[0] == one(*[r for r in rows if r[1] is not None])
    assert kept[1] == one((None, plain[0]), (7, plain[1]), (7, plain[2]), rows[5], rows[8], rows[9])
    assert kept[2] == one((None, plain[0]), (7, plain[1]), (7, plain[2]), rows[8], rows[9])
    assert kept[3] == one((None, plain[0]), (7, plain[1]), (7, plain[2]), (10, 'token = "[SECRET]"'), rows[9])
    assert table.where("text is null").count() == 1
