"""Queries of retrieval metrics, answer metrics, aggregations and diagnostics over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import answer_metrics as A
from granary.operators import ir_metrics as M
from granary.sources.tables import table


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Chunks ranked by similarity within their question; relevant is the same section as the question's verified evidence."""
    c = table(spark, d, "retrieved_chunks", "rc_id", "question_id", "section", "similarity").filter("question_id IS NOT NULL AND section IS NOT NULL")
    w = Window.partitionBy("question_id").orderBy(F.desc_nulls_last("similarity"), "rc_id")
    ranked = c.select("question_id", F.row_number().over(w).alias("rank"), F.col("section").alias("doc"))
    e = table(spark, d, "expanded_evidence", "question_id", "section", "verification_confidence").filter("question_id IS NOT NULL AND section IS NOT NULL AND verification_confidence >= 0.5")
    return M.judged_ranking(ranked, e.select("question_id", F.col("section").alias("doc")))


JUDGED_SQL = """
c AS (SELECT question_id, section AS doc, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC NULLS LAST, rc_id) AS rank FROM retrieved_chunks WHERE question_id IS NOT NULL AND section IS NOT NULL),
g AS (SELECT DISTINCT question_id, section AS doc FROM expanded_evidence WHERE question_id IS NOT NULL AND section IS NOT NULL AND verification_confidence >= 0.5),
j AS (SELECT c.question_id, rank, c.doc, CASE WHEN g.doc IS NULL THEN 0 ELSE 1 END AS hit, coalesce((SELECT count(*) FROM g x WHERE x.question_id = c.question_id), 0) AS n
    FROM c LEFT JOIN g ON g.question_id = c.question_id AND g.doc = c.doc)"""


def n6_ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.ranking_metrics(_judged(spark, d))


def _cut_sql(k: int) -> str:
    hits = f"sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END)"
    ideal = " + ".join(f"CASE WHEN max(n) >= {i} THEN 1.0 / log2({i} + 1) ELSE 0 END" for i in range(1, k + 1))
    return f"""round(CASE WHEN max(n) > 0 THEN {hits} / max(n) ELSE 0 END, 6) AS recall_{k}, round({hits} / {k}, 6) AS precision_{k},
    round(CASE WHEN max(n) > 0 THEN sum(CASE WHEN rank <= {k} THEN hit / log2(rank + 1) ELSE 0 END) / ({ideal}) ELSE 0 END, 6) AS ndcg_{k}"""


N6_SQL = f"""WITH {JUDGED_SQL},
h AS (SELECT *, sum(hit) OVER (PARTITION BY question_id ORDER BY rank) AS so_far FROM j)
SELECT question_id, {', '.join(_cut_sql(k) for k in M.CUTOFFS)}, round(coalesce(1 / min(CASE WHEN hit = 1 THEN rank END), 0), 6) AS reciprocal_rank,
    round(CASE WHEN max(n) > 0 THEN sum(hit * so_far / rank) / max(n) ELSE 0 END, 6) AS average_precision FROM h GROUP BY question_id"""


def n7_distinct_recall(spark: SparkSession, d: str) -> DataFrame:
    return M.distinct_recall(_judged(spark, d), 5)


N7_SQL = f"WITH {JUDGED_SQL} SELECT question_id, round(CASE WHEN max(n) > 0 THEN count(DISTINCT CASE WHEN rank <= 5 AND hit = 1 THEN doc END) / max(n) ELSE 1 END, 6) AS recall FROM j GROUP BY question_id"


def n9_context_precision(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "expanded_evidence", "question_id", "pdf_filename", "cross_encoder_score").filter("question_id IS NOT NULL")
    r = table(spark, d, "run_results", "question_id", "paper").filter("question_id IS NOT NULL AND paper IS NOT NULL").distinct()
    hits = e.join(r.select("question_id", F.col("paper").alias("pdf_filename"), F.lit(1).alias("hit")), ["question_id", "pdf_filename"], "left")
    g = hits.groupBy("question_id").agg(F.count(F.lit(1)).alias("retrieved"), F.sum(F.coalesce("hit", F.lit(0))).alias("relevant"))
    return g.select("question_id", "retrieved", "relevant", F.round(F.col("relevant") / F.col("retrieved") * 100, 4).alias("precision"), F.round(F.least(F.lit(100.0), F.col("relevant") / F.least("retrieved", F.lit(10)) * 100), 4).alias("coverage"))


N9_SQL = """
WITH r AS (SELECT DISTINCT question_id, paper FROM run_results WHERE question_id IS NOT NULL AND paper IS NOT NULL),
g AS (SELECT e.question_id, count(*) AS retrieved, count(r.paper) AS relevant FROM expanded_evidence e LEFT JOIN r ON r.question_id = e.question_id AND r.paper = e.pdf_filename WHERE e.question_id IS NOT NULL GROUP BY 1)
SELECT question_id, retrieved, relevant, round(relevant / retrieved * 100, 4) AS precision, round(least(100.0, relevant / least(retrieved, 10) * 100), 4) AS coverage FROM g"""


def n10_keyword_quality(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "run_results", "question_id", "question").filter("question_id IS NOT NULL").groupBy("question_id").agg(F.min("question").alias("question"))
    q = q.select("question_id", X.long_words(F.col("question")).alias("qw"))
    c = table(spark, d, "retrieved_chunks", "question_id", "rc_id", "chunk_index", "chunk_text").filter("question_id IS NOT NULL")
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("question_id").orderBy(F.asc_nulls_last("chunk_index"), "rc_id"))).filter("r <= 10")
    hit = F.arrays_overlap(X.long_words(F.coalesce("chunk_text", F.lit(""))), "qw").cast("int")
    return c.join(q, "question_id").groupBy("question_id").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(hit) * 100, 4).alias("quality"))


N10_SQL = r"""
WITH q AS (SELECT question_id, list_distinct(list_filter(regexp_extract_all(lower(min(question)), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 4)) AS qw FROM run_results WHERE question_id IS NOT NULL GROUP BY 1),
c AS (SELECT question_id, chunk_text FROM retrieved_chunks WHERE question_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY chunk_index NULLS LAST, rc_id) <= 10)
SELECT question_id, count(*) AS chunks, round(avg(CASE WHEN len(list_intersect(list_filter(regexp_extract_all(lower(coalesce(chunk_text, '')), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 4), qw)) > 0 THEN 1 ELSE 0 END) * 100, 4) AS quality
FROM c JOIN q USING (question_id) GROUP BY question_id"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_results", "result_id", "question", "answer", "expected").filter("answer IS NOT NULL AND expected IS NOT NULL")


def o1_exact_match(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.array_join(A.normal_tokens(F.col(c)), " ")
    return _answers(spark, d).select("result_id", (n("answer") == n("expected")).alias("exact"), (F.lower(F.trim("answer")) == F.lower(F.trim("expected"))).alias("light"))


_NT = r"list_filter(string_split_regex(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '[\s\x0b]+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"
_PAIRS = f"a AS (SELECT result_id, answer, expected, {_NT.format('answer')} AS p, {_NT.format('expected')} AS g FROM run_results WHERE answer IS NOT NULL AND expected IS NOT NULL)"
O1_SQL = f"WITH {_PAIRS} SELECT result_id, array_to_string(p, ' ') = array_to_string(g, ' ') AS exact, lower(trim(answer)) = lower(trim(expected)) AS light FROM a"


def o2_token_f1(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d).select("result_id", A.normal_tokens(F.col("answer")).alias("p"), A.normal_tokens(F.col("expected")).alias("g"))
    return a.select("result_id", F.round(A.token_f1(F.col("p"), F.col("g")), 6).alias("f1"))


O2_SQL = f"""WITH {_PAIRS},
c AS (SELECT result_id, p, g, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) AS common FROM a)
SELECT result_id, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN len(p) = 0 OR len(g) = 0 OR common = 0 THEN 0.0
    ELSE 2 * (common / len(p)) * (common / len(g)) / (common / len(p) + common / len(g)) END, 6) AS f1 FROM c"""


def o4_rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("result_id", F.round(A.rouge_l(A.normal_tokens(F.col("answer")), A.normal_tokens(F.col("expected"))), 6).alias("rouge_l"))


def o5_bleu(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d).select("result_id", A.normal_tokens(F.col("answer")).alias("p"), A.normal_tokens(F.col("expected")).alias("g"))
    return a.select("result_id", F.round(A.bleu(F.col("p"), F.col("g")), 6).alias("bleu"))


def _gram_sql(x: str, n: int) -> str:
    return f"list_transform(range(1, len({x}) - {n} + 2), lambda i: array_to_string({x}[i:i + {n - 1}], ' '))"


_B = " + ".join(f"ln((coalesce(list_sum(list_transform(list_distinct(p{n}), lambda w: least(len(list_filter(p{n}, lambda x: x = w)), len(list_filter(g{n}, lambda x: x = w))))), 0) + 1) / (len(p{n}) + 1)) / 4" for n in range(1, 5))
O5_SQL = f"""WITH {_PAIRS}, n AS (SELECT result_id, p, g, {', '.join(f'{_gram_sql(x, n)} AS {x}{n}' for n in range(1, 5) for x in 'pg')} FROM a)
SELECT result_id, round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN 0.0 ELSE exp({_B} + least(0.0, 1 - len(g) / len(p))) END, 6) AS bleu FROM n"""


def o7_sequence_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("result_id", F.round(A.sequence_ratio(F.col("answer"), F.col("expected")), 6).alias("ratio"))


def o8_keyword_overlap(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d).select("result_id", X.long_words(F.col("expected")).alias("e"), X.long_words(F.col("answer")).alias("g"))
    both = F.size(F.array_intersect("e", "g"))
    share = lambda n: F.when((F.size("e") > 0) & (n > 0), F.round(both / n * 100, 4)).otherwise(0.0)
    return a.select("result_id", share(F.size("e")).alias("recall"), share(F.size("g")).alias("precision"))


O8_SQL = r"""
WITH a AS (SELECT result_id, list_distinct(list_filter(regexp_extract_all(lower(expected), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 4)) AS e,
    list_distinct(list_filter(regexp_extract_all(lower(answer), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 4)) AS g FROM run_results WHERE answer IS NOT NULL AND expected IS NOT NULL)
SELECT result_id, CASE WHEN len(e) > 0 THEN round(len(list_intersect(e, g)) / len(e) * 100, 4) ELSE 0 END AS recall,
    CASE WHEN len(e) > 0 AND len(g) > 0 THEN round(len(list_intersect(e, g)) / len(g) * 100, 4) ELSE 0 END AS precision FROM a"""


def o9_numerical_accuracy(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.regexp_extract_all(c, F.lit(X.NUMBER), F.lit(0))
    a = _answers(spark, d).select("result_id", n("expected").alias("e"), n("answer").alias("g"))
    hits = F.size(F.filter("e", lambda x: F.array_contains("g", x)))
    return a.select("result_id", F.when(F.size("e") == 0, 100.0).otherwise(F.round(hits / F.size("e") * 100, 4)).alias("accuracy"))


O9_SQL = r"""
WITH a AS (SELECT result_id, regexp_extract_all(expected, '[0-9]+\.?[0-9]*') AS e, regexp_extract_all(answer, '[0-9]+\.?[0-9]*') AS g FROM run_results WHERE answer IS NOT NULL AND expected IS NOT NULL)
SELECT result_id, CASE WHEN len(e) = 0 THEN 100.0 ELSE round(len(list_filter(e, lambda x: list_contains(g, x))) / len(e) * 100, 4) END AS accuracy FROM a"""


def o11_token_grounding(spark: SparkSession, d: str) -> DataFrame:
    g = A.token_grounding(F.col("answer"), F.col("expected"))
    a = _answers(spark, d).select("result_id", g.alias("grounding"), A.conciseness(F.col("answer"), F.col("expected")).alias("conciseness"))
    return a.withColumn("label", F.when(F.col("grounding") >= 70, "Grounded").when(F.col("grounding") >= 30, "Partially Grounded").otherwise("Hallucinated"))


O11_SQL = r"""
WITH a AS (SELECT result_id, lower(answer) AS a, list_filter(string_split_regex(lower(expected), '[\s\x0b]+'), lambda w: length(w) > 3) AS t,
    len(list_filter(string_split_regex(answer, '[\s\x0b]+'), lambda w: w <> '')) AS na, len(list_filter(string_split_regex(expected, '[\s\x0b]+'), lambda w: w <> '')) AS ne
    FROM run_results WHERE answer IS NOT NULL AND expected IS NOT NULL),
g AS (SELECT *, CASE WHEN len(t) > 0 THEN round(len(list_filter(t, lambda w: contains(a, w))) / len(t) * 100, 2) ELSE 0.0 END AS grounding FROM a)
SELECT result_id, grounding, CASE WHEN na > 2 * ne THEN 50.0 WHEN na > 1.5 * ne THEN 75.0 ELSE 100.0 END AS conciseness,
    CASE WHEN grounding >= 70 THEN 'Grounded' WHEN grounding >= 30 THEN 'Partially Grounded' ELSE 'Hallucinated' END AS label FROM g"""


def o14_overall_score(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metrics")
    r = table(spark, d, "run_results", "result_id", "metrics").filter("metrics IS NOT NULL")
    zero = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    parts = {"grounding": zero(m["grounding_score_percent"]), "semantic": zero(m["semantic_similarity"]) * 100, "completeness": zero(m["concept_coverage_percent"])}
    parts["hallucination"] = F.when(m["grounding_label"] == "Hallucinated", 100.0).otherwise(0.0)
    return r.select("result_id", F.round(A.overall_score(parts), 4).alias("score"))


O14_SQL = """
WITH m AS (SELECT result_id, metrics.grounding_score_percent AS g, metrics.semantic_similarity AS s, metrics.concept_coverage_percent AS c, metrics.grounding_label AS l FROM run_results WHERE metrics IS NOT NULL),
z AS (SELECT result_id, coalesce(CASE WHEN isnan(g) THEN 0 ELSE g END, 0) AS g, coalesce(CASE WHEN isnan(s) THEN 0 ELSE s END, 0) AS s, coalesce(CASE WHEN isnan(c) THEN 0 ELSE c END, 0) AS c, l FROM m)
SELECT result_id, round(greatest(0.0, least(100.0, g * 0.30 + s * 100 * 0.30 + c * 0.10 + CASE WHEN l = 'Hallucinated' THEN 100.0 ELSE 0.0 END * -0.10)), 4) AS score FROM z"""

QUERIES = {
    "n6_ranking_metrics": (n6_ranking_metrics, N6_SQL),
    "n7_distinct_recall": (n7_distinct_recall, N7_SQL),
    "n9_context_precision": (n9_context_precision, N9_SQL),
    "n10_keyword_quality": (n10_keyword_quality, N10_SQL),
    "o1_exact_match": (o1_exact_match, O1_SQL),
    "o2_token_f1": (o2_token_f1, O2_SQL),
    "o4_rouge_l": (o4_rouge_l, None),
    "o5_bleu": (o5_bleu, O5_SQL),
    "o7_sequence_ratio": (o7_sequence_ratio, None),
    "o8_keyword_overlap": (o8_keyword_overlap, O8_SQL),
    "o9_numerical_accuracy": (o9_numerical_accuracy, O9_SQL),
    "o11_token_grounding": (o11_token_grounding, O11_SQL),
    "o14_overall_score": (o14_overall_score, O14_SQL),
}
