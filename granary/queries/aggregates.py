"""Queries of aggregations, statistics, diagnostics and validation over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import statistics as S
from granary.queries.relations import RUNS_SQL, _latest_runs
from granary.sources.tables import table


def e1_item_counts(spark: SparkSession, d: str) -> DataFrame:
    norm = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("none")).alias(c)
    b = table(spark, d, "documents", "lang", "source", "collection_id").select(norm("lang"), norm("source"), norm("collection_id"))
    g = b.groupingSets([["lang"], ["source"], ["collection_id"], []], "lang", "source", "collection_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("collection_id", F.lit("*")).alias("collection_id"), "n")


E1_SQL = """
SELECT coalesce(c, '*') AS lang, coalesce(f, '*') AS source, coalesce(s, '*') AS collection_id, count(*) AS n
FROM (SELECT coalesce(lower(trim(lang)), 'none') AS c, coalesce(lower(trim(source)), 'none') AS f, coalesce(lower(trim(collection_id)), 'none') AS s FROM documents) GROUP BY GROUPING SETS ((c), (f), (s), ())"""


def e2_paper_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "expanded_evidence", "pdf_filename", "section", "page").filter("pdf_filename IS NOT NULL")
    return c.groupBy("pdf_filename").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct(F.nullif(F.trim("section"), F.lit(""))).alias("sections"), F.count_distinct("page").alias("pages"), F.coalesce(F.max("page"), F.lit(-1)).alias("last_page"))


E2_SQL = "SELECT pdf_filename, count(*) AS chunks, count(DISTINCT nullif(trim(section), '')) AS sections, count(DISTINCT page) AS pages, coalesce(max(page), -1) AS last_page FROM expanded_evidence WHERE pdf_filename IS NOT NULL GROUP BY 1"


def e3_metric_means(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metrics")
    r = table(spark, d, "run_results", "run_name", "metrics").filter("run_name IS NOT NULL AND metrics IS NOT NULL")
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), m[k].alias("value")) for k in ("semantic_similarity", "grounding_score_percent", "concept_coverage_percent", "latency")])
    x = r.select("run_name", F.explode(pairs).alias("p")).select("run_name", "p.*").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return x.groupBy("run_name", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


_UNPIVOT = " UNION ALL ".join(f"SELECT run_name, question_id, '{k}' AS metric, metrics.{k} AS value FROM run_results WHERE run_name IS NOT NULL AND metrics IS NOT NULL" for k in ("semantic_similarity", "grounding_score_percent", "concept_coverage_percent", "latency"))
E3_SQL = f"SELECT run_name, metric, count(*) AS n, round(avg(value), 6) AS mean FROM ({_UNPIVOT}) WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2"


def e4_across_runs(spark: SparkSession, d: str) -> DataFrame:
    per_run = e3_metric_means(spark, d)
    return per_run.groupBy("metric").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("mean"), 5).alias("mean"), F.round(F.stddev_pop("mean"), 5).alias("std"))


E4_SQL = f"SELECT metric, count(*) AS runs, round(avg(mean), 5) AS mean, round(stddev_pop(mean), 5) AS std FROM ({E3_SQL}) GROUP BY metric"


def e5_latency(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "run_results", "run_name", "metrics").select(F.coalesce("run_name", F.lit("none")).alias("run_name"), F.col("metrics.latency").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return r.groupBy("run_name").agg(*S.latency_summary(F.col("v")))


E5_SQL = f"""
SELECT coalesce(run_name, 'none') AS run_name, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max,
    {', '.join(f'round(quantile_cont(v, {p / 100}), 4) AS p{p}' for p in (50, 75, 90, 95, 99))}
FROM (SELECT run_name, metrics.latency AS v FROM run_results) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1"""


def e5_event_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_type", "value").groupBy("event_type").agg(*S.latency_summary(F.col("value")))


E5E_SQL = f"""
SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max,
    {', '.join(f'round(quantile_cont(value, {p / 100}), 4) AS p{p}' for p in (50, 75, 90, 95, 99))} FROM events GROUP BY 1"""


def e7_score_bands(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("metrics.grounding_score_percent")
    r = table(spark, d, "run_results", "metrics").select(s.alias("s")).filter(F.col("s").isNotNull() & ~F.isnan("s"))
    band = F.when(F.col("s") >= 90, "90-100").when(F.col("s") >= 80, "80-90").when(F.col("s") >= 70, "70-80").when(F.col("s") >= 60, "60-70").otherwise("under 60")
    g = r.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    every = F.sum("n").over(Window.partitionBy())  # of at most five bands
    return g.withColumn("percent", F.round(100 * F.col("n") / every, 4))


E7_SQL = """
SELECT CASE WHEN s >= 90 THEN '90-100' WHEN s >= 80 THEN '80-90' WHEN s >= 70 THEN '70-80' WHEN s >= 60 THEN '60-70' ELSE 'under 60' END AS band, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS percent
FROM (SELECT metrics.grounding_score_percent AS s FROM run_results) WHERE s IS NOT NULL AND NOT isnan(s) GROUP BY 1"""


def e10_correlation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "expanded_evidence", "evidence_source", "similarity", "cross_encoder_score").filter("evidence_source IS NOT NULL")
    e = e.filter(~F.isnan("cross_encoder_score") & ~F.isnan("similarity"))
    return S.rank_correlation(e, ["evidence_source"], "similarity", "cross_encoder_score")


E10_SQL = """
WITH e AS (SELECT evidence_source AS g, similarity AS x, cross_encoder_score AS y FROM expanded_evidence WHERE evidence_source IS NOT NULL AND similarity IS NOT NULL AND cross_encoder_score IS NOT NULL AND NOT isnan(similarity) AND NOT isnan(cross_encoder_score)),
r AS (SELECT g, x, y, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2 AS ry FROM e)
SELECT g AS evidence_source, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY g"""


def e12_difficulty(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metrics")
    r = table(spark, d, "run_results", "question_id", "metrics").filter("question_id IS NOT NULL AND metrics.semantic_similarity IS NOT NULL")
    g = r.groupBy("question_id").agg(F.count(F.lit(1)).alias("runs"), F.avg(m["semantic_similarity"]).alias("s"))
    return g.select("question_id", "runs", F.round("s", 6).alias("mean"), F.when(F.col("s") > 0.6, "easy").when(F.col("s") > 0.2, "medium").otherwise("hard").alias("difficulty"))


E12_SQL = """
SELECT question_id, count(*) AS runs, round(avg(metrics.semantic_similarity), 6) AS mean, CASE WHEN avg(metrics.semantic_similarity) > 0.6 THEN 'easy' WHEN avg(metrics.semantic_similarity) > 0.2 THEN 'medium' ELSE 'hard' END AS difficulty
FROM run_results WHERE question_id IS NOT NULL AND metrics.semantic_similarity IS NOT NULL GROUP BY 1"""


#: Frequent words that say nothing of a text. Fixed values.
STOP = ["about", "after", "their", "there", "these", "those", "which", "while", "where", "would", "could", "should", "other", "under", "until", "before", "because", "through", "between", "against"]


def e13_top_words(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents", "lang", "text").select(F.lower("lang").alias("lang"), F.explode(X.words(F.col("text"))).alias("word")).filter("lang IS NOT NULL AND length(word) > 4").filter(~F.col("word").isin(STOP))
    n = w.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    from granary.operators.relations import top_k

    return top_k(n, "lang", [F.desc("n"), F.asc("word")], 10).select("lang", "rank", "word", "n")


E13_SQL = rf"""
WITH w AS (SELECT lower(lang) AS lang, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM documents),
n AS (SELECT lang, word, count(*) AS n FROM w WHERE lang IS NOT NULL AND length(word) > 4 AND word NOT IN ({', '.join(repr(w) for w in STOP)}) GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank, word, n FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 10"""


def e15_duplicate_share(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "retrieved_chunks", "question_id", "chunk_hash").filter("question_id IS NOT NULL AND chunk_hash IS NOT NULL")
    g = c.groupBy("question_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("chunk_hash").alias("distinct_chunks"))
    return g.withColumn("duplicate_percent", F.round((1 - F.col("distinct_chunks") / F.col("chunks")) * 100, 4))


E15_SQL = """
SELECT question_id, count(*) AS chunks, count(DISTINCT chunk_hash) AS distinct_chunks, round((1 - count(DISTINCT chunk_hash) / count(*)) * 100, 4) AS duplicate_percent
FROM retrieved_chunks WHERE question_id IS NOT NULL AND chunk_hash IS NOT NULL GROUP BY 1"""


def st1_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "run_results", "result_id", "run_name", "metrics").select("result_id", "run_name", F.col("metrics.semantic_similarity").alias("v")).filter("run_name IS NOT NULL")
    return S.bootstrap_intervals(r, ["run_name"], "v").select("run_name", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def st2_signed_rank(spark: SparkSession, d: str) -> DataFrame:
    a, b = _latest_runs(spark, d)
    pairs = a.select("question_id", F.col("semantic").alias("x")).join(b.select("question_id", F.col("semantic").alias("y")), "question_id").select(F.lit("semantic").alias("metric"), F.round(F.col("x") - F.col("y"), 9).alias("diff"))
    return S.signed_rank(pairs, ["metric"], "diff")


ST2_SQL = f"""WITH {RUNS_SQL},
p AS (SELECT round(a.semantic - b.semantic, 9) AS diff FROM (SELECT * FROM s WHERE side = 0) a JOIN (SELECT * FROM s WHERE side = 1) b USING (question_id)),
r AS (SELECT diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2 AS r FROM p WHERE diff <> 0),
w AS (SELECT count(*) AS n, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN diff < 0 THEN r ELSE 0 END) AS w_minus FROM r),
z AS (SELECT 'semantic' AS metric, n, w_plus, w_minus, round((least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM w WHERE n > 0)
SELECT metric, n, w_plus, w_minus, z, round(least(1.0, ({' + '.join(f"{c} * pow(1 / (1 + {S.ERF_SCALE} * x), {i + 1})" for i, c in enumerate(S.ERF))}) * exp(-x * x)), 6) AS p FROM (SELECT *, abs(z) / sqrt(2) AS x FROM z)"""


def st4_effect_size(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "expanded_evidence", "section", "similarity", "verification_confidence").filter("section IS NOT NULL AND verification_confidence IS NOT NULL")
    return S.effect_size(e, ["section"], F.col("verification_confidence") >= 0.5, "similarity")


ST4_SQL = """
WITH e AS (SELECT section, similarity AS v, verification_confidence >= 0.5 AS s FROM expanded_evidence WHERE section IS NOT NULL AND verification_confidence IS NOT NULL),
g AS (SELECT section, count(v) FILTER (s) AS n1, count(v) FILTER (NOT s) AS n2, avg(v) FILTER (s) AS m1, avg(v) FILTER (NOT s) AS m2, var_samp(v) FILTER (s) AS v1, var_samp(v) FILTER (NOT s) AS v2 FROM e GROUP BY 1),
x AS (SELECT section, n1, n2, round(CASE WHEN sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) > 0 THEN (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) ELSE 0 END, 6) AS d FROM g)
SELECT section, n1, n2, d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS size FROM x"""


def st8_calibration(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "expanded_evidence", "verification_confidence", "similarity").filter("verification_confidence BETWEEN 0 AND 1")
    return S.calibration_error(e, F.col("verification_confidence"), F.coalesce("similarity", F.lit(0.0)) >= 0.3)


ST8_SQL = """
WITH b AS (SELECT least(4, CAST(floor(verification_confidence * 5) AS INTEGER)) AS bin, verification_confidence AS c, CASE WHEN coalesce(similarity, 0) >= 0.3 THEN 1.0 ELSE 0.0 END AS y FROM expanded_evidence WHERE verification_confidence BETWEEN 0 AND 1),
g AS (SELECT bin, count(*) AS n, round(avg(c), 6) AS mean_confidence, round(avg(y), 6) AS accuracy FROM b GROUP BY 1)
SELECT *, round(abs(accuracy - mean_confidence), 6) AS gap FROM g"""


def r6_regressions(spark: SparkSession, d: str) -> DataFrame:
    from granary.operators.relations import compare_runs

    out = compare_runs(*_latest_runs(spark, d), "question_id", ["semantic", "grounding", "coverage"]).filter("diff IS NOT NULL")
    return out.select("question_id", "metric", F.when(F.col("diff") < -5, "critical").when(F.col("diff") < -1, "acceptable").when(F.col("diff") > 1, "improved").otherwise("unchanged").alias("severity"))


R6_SQL = f"""WITH {RUNS_SQL}
SELECT question_id, metric, CASE WHEN current - baseline < -5 THEN 'critical' WHEN current - baseline < -1 THEN 'acceptable' WHEN current - baseline > 1 THEN 'improved' ELSE 'unchanged' END AS severity
FROM u WHERE current - baseline IS NOT NULL"""


def r10_hash_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Stored digests against digests computed anew, and hashes that stand for different texts."""
    c = table(spark, d, "chunker", "content_hash", "content").filter("content_hash IS NOT NULL AND content IS NOT NULL")
    g = c.groupBy("content_hash").agg(F.count(F.lit(1)).alias("rows_with_hash"), F.count_distinct("content").alias("texts"), F.max((F.sha2("content", 256) == F.col("content_hash")).cast("int")).alias("recomputes"))
    return g


R10_SQL = "SELECT content_hash, count(*) AS rows_with_hash, count(DISTINCT content) AS texts, max(CASE WHEN sha256(content) = content_hash THEN 1 ELSE 0 END) AS recomputes FROM chunker WHERE content_hash IS NOT NULL AND content IS NOT NULL GROUP BY 1"


def r11_dataset_checks(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "run_results", "result_id", "question_id", "question", "answer", "expected", "paper", "saved_at", "run_at")
    flag = lambda c, name: F.when(c, F.lit(name))
    checks = [flag(F.coalesce(F.trim("question"), F.lit("")) == "", "empty question"), flag(F.coalesce(F.trim("answer"), F.lit("")) == "", "empty answer"), flag(F.col("expected").isNull(), "no expected answer"), flag(F.col("saved_at") < F.col("run_at"), "saved before run")]
    own = b.select("result_id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))
    known = table(spark, d, "papers", F.col("pdf_filename").alias("paper"))
    orphan = b.join(known, "paper", "left_anti").select("result_id", F.lit("unknown paper").alias("problem"))
    return own.unionByName(orphan)


R11_SQL = """
SELECT result_id, 'empty question' AS problem FROM run_results WHERE coalesce(trim(question), '') = '' UNION ALL SELECT result_id, 'empty answer' FROM run_results WHERE coalesce(trim(answer), '') = ''
UNION ALL SELECT result_id, 'no expected answer' FROM run_results WHERE expected IS NULL UNION ALL SELECT result_id, 'saved before run' FROM run_results WHERE saved_at < run_at
UNION ALL SELECT result_id, 'unknown paper' FROM run_results b WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.pdf_filename = b.paper)"""


def r12_score_spread(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "expanded_evidence", "question_id", "cross_encoder_score").filter(F.col("question_id").isNotNull() & F.col("cross_encoder_score").isNotNull() & ~F.isnan("cross_encoder_score"))
    g = e.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cross_encoder_score").alias("distinct_scores"), F.round(F.var_pop("cross_encoder_score"), 12).alias("variance"))
    return g.withColumn("degenerate", (F.col("n") > 1) & (F.col("distinct_scores") == 1))


R12_SQL = """
SELECT question_id, count(*) AS n, count(DISTINCT cross_encoder_score) AS distinct_scores, round(var_pop(cross_encoder_score), 12) AS variance, count(*) > 1 AND count(DISTINCT cross_encoder_score) = 1 AS degenerate
FROM expanded_evidence WHERE question_id IS NOT NULL AND cross_encoder_score IS NOT NULL AND NOT isnan(cross_encoder_score) GROUP BY 1"""

QUERIES = {
    "e1_item_counts": (e1_item_counts, E1_SQL),
    "e2_paper_rollup": (e2_paper_rollup, E2_SQL),
    "e3_metric_means": (e3_metric_means, E3_SQL),
    "e4_across_runs": (e4_across_runs, E4_SQL),
    "e5_latency": (e5_latency, E5_SQL),
    "e5_event_values": (e5_event_values, E5E_SQL),
    "e7_score_bands": (e7_score_bands, E7_SQL),
    "e10_correlation": (e10_correlation, E10_SQL),
    "e12_difficulty": (e12_difficulty, E12_SQL),
    "e13_top_words": (e13_top_words, E13_SQL),
    "e15_duplicate_share": (e15_duplicate_share, E15_SQL),
    "st1_bootstrap": (st1_bootstrap, None),
    "st2_signed_rank": (st2_signed_rank, ST2_SQL),
    "st4_effect_size": (st4_effect_size, ST4_SQL),
    "st8_calibration": (st8_calibration, ST8_SQL),
    "r6_regressions": (r6_regressions, R6_SQL),
    "r10_hash_integrity": (r10_hash_integrity, R10_SQL),
    "r11_dataset_checks": (r11_dataset_checks, R11_SQL),
    "r12_score_spread": (r12_score_spread, R12_SQL),
}
