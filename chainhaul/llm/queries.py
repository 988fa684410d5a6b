"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, jaccard_join, langid, lm_score, mixing, secrets, substring_dedup, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count(table(spark, sf_dir, "documents"))
    return out.withColumn("section_tokens", F.array_join(F.transform("section_tokens", lambda x: x.cast("long").cast("string")), ","))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


_WORDS = r"[^\x20\x09-\x0D]+"

_OP3 = rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(regexp_extract_all(text, '{_WORDS}'), []) ws FROM documents),
w AS (SELECT rid, j, ws[j] w, CASE WHEN j + 34 <= len(ws) THEN array_to_string(ws[j:j + 34], ' ') END win FROM d, unnest(range(1, len(ws) + 1)) t(j)),
c AS (SELECT win FROM w WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
m AS (SELECT rid, j, w, max(CASE WHEN c.win IS NOT NULL THEN j END) OVER (PARTITION BY rid ORDER BY j ROWS 34 PRECEDING) hit FROM w LEFT JOIN c ON w.win = c.win),
k AS (SELECT rid, count(hit) n_removed, string_agg(w, ' ' ORDER BY j) FILTER (hit IS NULL) kept FROM m GROUP BY rid)
SELECT doc_id, len(ws) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN k USING (rid)"""

_OP8 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0) size, substr(md5(concat_ws(' ', CAST(doc_id AS VARCHAR), text)), 1, 12) place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 nth FROM d GROUP BY source),
g AS (SELECT *, CAST([1, 2, 3][nth % 3 + 1] AS DOUBLE) weight, CAST(source_size * 3 AS DOUBLE) cap, CAST(sum(source_size) OVER () AS DOUBLE) total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) level FROM g),
t AS (SELECT *, least(cap, max(level) OVER () * weight) target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END reps FROM t),
b AS (SELECT source, place, sum(size) words FROM d GROUP BY 1, 2),
u AS (SELECT source, place, words, sum(words) OVER (PARTITION BY source ORDER BY place) upto FROM b),
e AS (SELECT u.source, min(place) edge FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source WHERE upto - words / 2.0 > target - reps * source_size GROUP BY 1)
SELECT doc_id, CAST(size AS BIGINT) size, source_size, target, CAST(size * least(3, reps + CASE WHEN edge IS NULL OR place < edge THEN 1 ELSE 0 END) AS BIGINT) taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source"""

_OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}'), []) ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[j:j + 4], ' ') END g FROM d, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) t(j) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) n FROM g GROUP BY 1),
l AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id a, y.doc_id b, count(*) shared FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * shared >= 80 * (m.n + o.n - shared)),
r AS (SELECT doc_id id, doc_id low FROM documents UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id AND r.low < l.b)
SELECT doc_id, coalesce(n, 0) n_shingles, low component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(low) low FROM r GROUP BY 1) c ON c.id = doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """Of the other operators: models are fitted, spans located or tokens encoded by means that SQL lacks."""
    return {"op3_substring_dedup": _OP3, "op8_mixing": _OP8, "op10_jaccard_join": _OP10}
