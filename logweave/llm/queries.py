"""The opN queries: thin projections of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import bpe, class_lm, conversations, decontaminate, digest, html_text, importance, line_rules, rans, resample, secrets, simhash, toxicity
from logweave.llm.shared import held_out, table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lowered, sizes WHERE len(w) >= n)
), hits AS (
  SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.gram = x.gram AND p.n = x.n
), counted AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN counted c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; it is installed on every machine, and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.fit(secrets.labelled_findings(spark))
    return secrets.scan(table(spark, sf_dir, "documents"), forest)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.tag(docs, field, carry=("doc_id",))
    return found.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "evidence", "spans")


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents"))


def op8_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end=2)


def op10_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edits(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least=20, seed=42)
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def crc_sql(text: str) -> str:
    """The CRC-32 of a column's UTF-8 bytes, beside table `crc`. Every byte stands as two hex digits in hex(); DuckDB has no such function."""
    low = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: CAST(('0x' || substr(hex({text}), 2 * i - 1, 2)) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {low}), lambda a, b: xor(a >> 8, crc_table[CAST(xor(a & 255, b) AS BIGINT) + 1])))"


CRC_TABLE = "crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) ORDER BY i) AS crc_table FROM range(256) r(i))"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH {CRC_TABLE},
texts AS (
  SELECT 0 AS side, doc_id, row_number() OVER () AS r, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, NULL, row_number() OVER (), regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), features AS (
  SELECT side, r, array_to_string(w[i : i + k - 1], ' ') AS f, count(*) AS n
  FROM (SELECT side, r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM texts, range(1, 4) s(k) WHERE len(w) >= k) GROUP BY ALL
), hashed AS (
  SELECT f, {crc_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features), crc
), counted AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM features JOIN hashed USING (f) GROUP BY bucket
), totals AS (SELECT sum(s) AS bs, sum(t) AS bt FROM counted),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (bs + 10000)::DOUBLE / ((s + 1)::DOUBLE * (bt + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counted, totals
), weights AS (
  SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (r) WHERE side = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank, CAST(n_words AS BIGINT) AS n_words
FROM placed
"""


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversations.digests(turns, conversations.damage(turns))


OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(2) x(copy) WHERE k != 0 AND (copy = 0 OR k = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), faults AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS r, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), flags AS (
  SELECT *, blank OR seen AS must, CASE WHEN blank OR seen OR NOT cut THEN 0 ELSE 1 END AS short FROM faults
), measures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate,
         sum(short) AS truncated, count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM flags GROUP BY conv_id
), steps AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'p': ''}} AS t, {{'c': 1000000000000::BIGINT, 'p': ''}} AS s, {{'c': 1000000000000::BIGINT, 'p': ''}} AS u, {{'c': 1000000000000::BIGINT, 'p': ''}} AS a FROM measures
  UNION ALL
  SELECT conv_id, i,
    {{'c': t.c + 2, 'p': t.p || 'D'}},
    CASE WHEN NOT must AND r = 's' THEN list_min([{{'c': s.c + 2, 'p': s.p || 'D'}}, {{'c': t.c + 5 * short, 'p': t.p || 'K'}}]) ELSE {{'c': s.c + 2, 'p': s.p || 'D'}} END,
    CASE WHEN NOT must THEN list_min([{{'c': u.c + 2, 'p': u.p || 'D'}}, {{'c': o.c + 5 * short + (r != 'u')::INT, 'p': o.p || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END}}]) ELSE {{'c': u.c + 2, 'p': u.p || 'D'}} END,
    CASE WHEN NOT must THEN list_min([{{'c': a.c + 2, 'p': a.p || 'D'}}, {{'c': u.c + 5 * short + (r != 'a')::INT, 'p': u.p || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END}}]) ELSE {{'c': a.c + 2, 'p': a.p || 'D'}} END
  FROM (
    SELECT f.conv_id, f.i, must, r, short, t, s, u, list_min([t, s, a]) AS o, list_min([a, {{'c': u.c + 5, 'p': u.p || 'I'}}]) AS a
    FROM (
      SELECT g.conv_id, g.i, t, s, a, list_min([u, {{'c': t.c + 5, 'p': t.p || 'I'}}, {{'c': s.c + 5, 'p': s.p || 'I'}}, {{'c': a.c + 5, 'p': a.p || 'I'}}]) AS u FROM steps g
    ) g JOIN flags f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i + 1
  )
), ends AS (
  SELECT g.conv_id, list_min([t, a, {{'c': u.c + 5, 'p': u.p || 'I'}}, {{'c': s.c + 10, 'p': s.p || 'II'}}]) AS e FROM steps g JOIN measures m ON m.conv_id IS NOT DISTINCT FROM g.conv_id AND m.n = g.i
), tokens AS (
  SELECT conv_id, e.p AS audit, regexp_extract_all(e.p, 'I*[DKR]|I+$') AS ws FROM ends
), items AS (
  SELECT conv_id, i, unnest(range(1, len(tok) + 1)) AS j, tok FROM (SELECT conv_id, unnest(ws) AS tok, unnest(range(1, len(ws) + 1)) AS i FROM tokens)
), emitted AS (
  SELECT x.conv_id, x.i, x.j, substr(tok, j, 1) AS op, f.role, f.text, row_number() OVER (PARTITION BY x.conv_id ORDER BY x.i, x.j) AS e
  FROM items x LEFT JOIN flags f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i WHERE substr(tok, j, 1) != 'D'
), led AS (
  SELECT *, bool_or(e = 1 AND op = 'K' AND left(role, 1) = 's') OVER (PARTITION BY conv_id) AS sys FROM emitted
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (e - sys::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY e) AS whole FROM led GROUP BY conv_id
)
SELECT o.conv_id, coalesce(m.gaps, 0) AS gaps, coalesce(m.blank, 0) AS blank, coalesce(m.duplicate, 0) AS duplicate, CAST(coalesce(m.truncated, 0) AS BIGINT) AS truncated, coalesce(m.illegal, 0) AS illegal,
       coalesce(x.e.c, 0) AS cost, coalesce(x.e.p, '') AS audit, sha256(coalesce(w.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN measures m ON m.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends x ON x.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judged(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '<none>') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)
), repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1) GROUP BY r
), raw AS (
  SELECT r, host, text, unnest(string_split(text, chr(10))) AS l FROM docs
), full_lines AS (
  SELECT r, count(*) - count(DISTINCT l) AS n FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), lines AS (
  SELECT r, host, text, trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS l,
         len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n
  FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), common AS (
  SELECT host, l FROM (SELECT host, l, count(DISTINCT text) AS n FROM lines GROUP BY host, l) JOIN (SELECT host, count(DISTINCT text) AS d FROM docs GROUP BY host) USING (host) WHERE n > 20 AND n > 0.01::DOUBLE * d
), gone AS (
  SELECT r, sum(n) AS n FROM lines JOIN common USING (host, l) GROUP BY r
), measures AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(f.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, coalesce(g.n, 0) AS n_common_words
  FROM docs LEFT JOIN full_lines f USING (r) LEFT JOIN repeated p USING (r) LEFT JOIN gone g USING (r)
), failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measures)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       base_failed, CAST(n_common_words AS BIGINT) AS n_common_words, NOT base_failed AND NOT (n_words - n_common_words < 0.5::DOUBLE * n_words) AS kept
FROM failed
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_decontaminate": op2_decontaminate,
        "op3_simhash": op3_simhash,
        "op4_bpe": op4_bpe,
        "op5_secrets": op5_secrets,
        "op6_toxicity": op6_toxicity,
        "op7_class_lm": op7_class_lm,
        "op8_resample": op8_resample,
        "op9_rans": op9_rans,
        "op10_digest": op10_digest,
        "op11_importance": op11_importance,
        "op12_conversations": op12_conversations,
        "op13_lines": op13_lines,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": OP2_SQL,
        "op11_importance": OP11_SQL,
        "op12_conversations": OP12_SQL,
        "op13_lines": OP13_SQL,
    }
