"""Queries of failure analysis, score tables, symbol lookups and composed pipelines over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import questions as Q
from granary.functions import text as X
from granary.operators.relations import first_per_hash, keep_unless_empty, top_k
from granary.queries.relations import RUNS_SQL, _latest_runs
from granary.sources.tables import table


def b10_score_table(spark: SparkSession, d: str) -> DataFrame:
    """Mean metrics by grounding label, one column a metric, with a mark at the best label of each."""
    m = F.col("metrics")
    r = table(spark, d, "run_results", "metrics").filter("metrics.grounding_label IS NOT NULL")
    names = ["semantic_similarity", "grounding_score_percent", "concept_coverage_percent"]
    g = r.groupBy(m["grounding_label"].alias("label")).agg(*[F.avg(F.nanvl(m[n], F.lit(None).cast("double"))).alias(n) for n in names])
    best = g.agg(*[F.max(n).alias(f"best_{n}") for n in names])
    cell = lambda n: F.concat(F.format_string("%.2f", F.col(n) + 1e-9), F.when(F.col(n) == F.col(f"best_{n}"), F.lit("*")).otherwise("")).alias(n)
    return g.crossJoin(F.broadcast(best)).select("label", *[cell(n) for n in names])  # best is one row


_M = ["semantic_similarity", "grounding_score_percent", "concept_coverage_percent"]
B10_SQL = f"""
WITH g AS (SELECT metrics.grounding_label AS label, {', '.join(f'avg(CASE WHEN isnan(metrics.{n}) THEN NULL ELSE metrics.{n} END) AS {n}' for n in _M)} FROM run_results WHERE metrics.grounding_label IS NOT NULL GROUP BY 1)
SELECT label, {', '.join(f"format('{{:.2f}}', {n} + 1e-9) || CASE WHEN {n} = (SELECT max({n}) FROM g) THEN '*' ELSE '' END AS {n}" for n in _M)} FROM g"""


def c10_chunk_projection(spark: SparkSession, d: str) -> DataFrame:
    none = lambda c: F.nullif(F.trim(c), F.lit(""))
    file = F.coalesce(none("pdf_filename"), none("paper_title"), none("repository"), F.lit(""))
    return table(spark, d, "retrieved_chunks").select("rc_id", file.alias("file"), F.coalesce("section", F.lit("")).alias("section"), F.coalesce(F.round("similarity", 6), F.lit(0.0)).alias("score"))


C10_SQL = "SELECT rc_id, coalesce(nullif(trim(pdf_filename), ''), nullif(trim(paper_title), ''), nullif(trim(repository), ''), '') AS file, coalesce(section, '') AS section, coalesce(round(similarity, 6), 0.0) AS score FROM retrieved_chunks"


def e8_failures(spark: SparkSession, d: str) -> DataFrame:
    """Wrong answers by run, with their rate; verdicts are counted as they are stored."""
    v = F.col("metrics.verdict")
    r = table(spark, d, "run_results", "run_name", "metrics").filter("run_name IS NOT NULL AND metrics.verdict IS NOT NULL")
    g = r.groupBy("run_name").agg(F.count(F.lit(1)).alias("answers"), F.count_if(v == "Incorrect").alias("incorrect"), F.count_if(v == "Partial").alias("partial"))
    return g.withColumn("failure_rate", F.round(F.col("incorrect") / F.col("answers"), 4))


E8_SQL = """
SELECT run_name, count(*) AS answers, count(*) FILTER (metrics.verdict = 'Incorrect') AS incorrect, count(*) FILTER (metrics.verdict = 'Partial') AS "partial", round(count(*) FILTER (metrics.verdict = 'Incorrect') / count(*), 4) AS failure_rate
FROM run_results WHERE run_name IS NOT NULL AND metrics.verdict IS NOT NULL GROUP BY 1"""


#: What is cut from the begin and end of a symbol, and what divides its words. Fixed values.
PREFIXES = ["base", "abstract", "default", "generic", "simple"]
SUFFIXES = ["base", "impl", "manager", "handler", "factory"]
DIVIDERS = ["_", "-", ".", " "]


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunker", "function_name", "class_name").select(F.explode(F.array("function_name", "class_name")).alias("symbol")).filter("symbol IS NOT NULL").distinct()


def h6_symbol_variants(spark: SparkSession, d: str) -> DataFrame:
    """The ways to look for a symbol: in lower case, without dividers, without what begins or ends many names, and in the other number."""
    s = F.col("symbol")
    low, n = F.lower(s), F.length(s)
    cut = lambda a, b: F.lower(F.substr(s, F.lit(a), n - b))
    ways = [low]
    for x in DIVIDERS:
        ways += [F.when(F.contains(s, F.lit(x)), F.replace(low, F.lit(x), F.lit(y))) for y in ("", " ")]
    ways += [F.when(F.startswith(low, F.lit(x)), cut(len(x) + 1, len(x))) for x in PREFIXES] + [F.when(F.endswith(low, F.lit(x)), cut(1, len(x))) for x in SUFFIXES]
    ways += [F.when(F.endswith(s, F.lit("s")), cut(1, 1)), F.when(F.endswith(s, F.lit("es")), cut(1, 2)), F.when(F.endswith(s, F.lit("ies")), F.concat(F.substr(s, F.lit(1), n - 3), F.lit("y"))), F.when(~F.endswith(s, F.lit("s")), F.concat(s, F.lit("s")))]
    return _symbols(spark, d).select("symbol", F.explode(F.array_distinct(F.array_compact(F.array(*ways)))).alias("variant")).filter("variant <> ''")


H6_SQL = f"""
WITH n AS (SELECT DISTINCT symbol, lower(symbol) AS l FROM (SELECT function_name AS symbol FROM chunker UNION ALL SELECT class_name FROM chunker) WHERE symbol IS NOT NULL),
v AS (SELECT DISTINCT symbol, unnest([l, {', '.join(f"CASE WHEN contains(symbol, '{x}') THEN replace(l, '{x}', '{y}') END" for x in DIVIDERS for y in ('', ' '))},
    {', '.join(f"CASE WHEN starts_with(l, '{x}') THEN substring(l, {len(x) + 1}) END" for x in PREFIXES)}, {', '.join(f"CASE WHEN ends_with(l, '{x}') THEN substring(l, 1, length(l) - {len(x)}) END" for x in SUFFIXES)},
    CASE WHEN ends_with(symbol, 's') THEN substring(l, 1, length(l) - 1) END, CASE WHEN ends_with(symbol, 'es') THEN substring(l, 1, length(l) - 2) END, CASE WHEN ends_with(symbol, 'ies') THEN substring(symbol, 1, length(symbol) - 3) || 'y' END, CASE WHEN NOT ends_with(symbol, 's') THEN symbol || 's' END]) AS variant FROM n)
SELECT symbol, variant FROM v WHERE variant <> ''"""


def l7_repositories(spark: SparkSession, d: str) -> DataFrame:
    """Where a symbol occurs: its repositories by name, the first twelve of them, and how many there are."""
    units = table(spark, d, "chunker", "repository", "file_path", "class_name", "function_name").filter("repository IS NOT NULL")
    base = F.regexp_extract("file_path", r"([^/\\]*)$", 1)
    named = units.select("repository", F.explode(F.array_compact(F.array(F.lower(base), F.lower("class_name"), F.lower("function_name")))).alias("variant")).distinct()
    hits = h6_symbol_variants(spark, d).join(named, "variant").select("symbol", "repository").distinct()
    first = top_k(hits, "symbol", [F.asc("repository")], 12, "r").groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_list("repository")), ", ").alias("repositories"))  # twelve
    return hits.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).join(first, "symbol")


L7_SQL = rf"""
WITH sv AS ({H6_SQL.strip()}),
u AS (SELECT DISTINCT repository, unnest([lower(regexp_extract(file_path, '([^/\\]*)$', 1)), lower(class_name), lower(function_name)]) AS variant FROM chunker WHERE repository IS NOT NULL),
h AS (SELECT DISTINCT symbol, repository FROM sv JOIN u USING (variant)), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY repository) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM h)
SELECT symbol, max(n) AS n, string_agg(repository, ', ' ORDER BY repository) AS repositories FROM r WHERE r <= 12 GROUP BY 1"""


def h25_norms(spark: SparkSession, d: str) -> DataFrame:
    """The length of every vector and its cosine with the vector of the next id."""
    e = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    n = e.withColumn("l", F.sqrt(dot("e", "e")))
    nxt = n.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("e2"), F.col("l").alias("l2"))
    return n.join(nxt, "vec_id").select("vec_id", F.round("l", 6).alias("norm"), F.round(dot("e", "e2") / (F.col("l") * F.col("l2")), 6).alias("cosine"))


H25_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM e)
SELECT a.vec_id, round(a.l, 6) AS norm, round(list_dot_product(a.e, b.e) / (a.l * b.l), 6) AS cosine FROM n a JOIN n b ON b.vec_id = a.vec_id + 1"""


def h32_missing_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every metric of a stored result that is null or NaN, with its path."""
    names = ["semantic_similarity", "grounding_score_percent", "concept_coverage_percent", "latency"]
    m = F.col("metrics")
    bad = F.array_compact(F.array(*[F.when(m[n].isNull(), F.lit(f"metrics.{n}: null")).when(F.isnan(m[n]), F.lit(f"metrics.{n}: NaN")) for n in names]))
    return table(spark, d, "run_results", "result_id", "metrics").select("result_id", F.explode(F.when(m.isNull(), F.array(F.lit("metrics: null"))).otherwise(bad)).alias("problem"))


H32_SQL = "SELECT result_id, 'metrics: null' AS problem FROM run_results WHERE metrics IS NULL" + "".join(
    f" UNION ALL SELECT result_id, 'metrics.{n}: ' || CASE WHEN metrics.{n} IS NULL THEN 'null' ELSE 'NaN' END FROM run_results WHERE metrics IS NOT NULL AND (metrics.{n} IS NULL OR isnan(metrics.{n}))"
    for n in ("semantic_similarity", "grounding_score_percent", "concept_coverage_percent", "latency")
)


def k7_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The evidence pipeline: 100 most similar, distinct texts, no low-value sections, 40 by similarity, 20 by cross-encoder score."""
    e = table(spark, d, "expanded_evidence", "ev_id", "question_id", "section", "similarity", "cross_encoder_score", "chunk_text").filter("question_id IS NOT NULL AND chunk_text IS NOT NULL")
    e = e.withColumn("h", F.md5("chunk_text")).drop("chunk_text")
    order = [F.desc_nulls_last("similarity"), F.asc("ev_id")]
    e = top_k(e, "question_id", order, 100, "r1")
    e = first_per_hash(e, "question_id", "h", order)
    e = keep_unless_empty(e, "question_id", ~F.lower(F.coalesce("section", F.lit(""))).rlike(X.LOW_VALUE))
    e = top_k(e, "question_id", order, 40, "r2")
    s = F.when(F.isnan("cross_encoder_score"), None).otherwise(F.col("cross_encoder_score"))
    return top_k(e.withColumn("s", s), "question_id", [F.desc_nulls_last("s"), F.asc("r2")], 20).select("question_id", "rank", "ev_id")


K7_SQL = f"""
WITH a AS (SELECT ev_id, question_id, section, similarity, CASE WHEN isnan(cross_encoder_score) THEN NULL ELSE cross_encoder_score END AS s, md5(chunk_text) AS h FROM expanded_evidence WHERE question_id IS NOT NULL AND chunk_text IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC NULLS LAST, ev_id) <= 100),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY question_id, h ORDER BY similarity DESC NULLS LAST, ev_id) = 1),
k AS (SELECT *, NOT regexp_matches(lower(coalesce(section, '')), '{X.LOW_VALUE}') AS keep FROM b),
c AS (SELECT * FROM k QUALIFY keep OR NOT bool_or(keep) OVER (PARTITION BY question_id)),
e AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC NULLS LAST, ev_id) AS r2 FROM c QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC NULLS LAST, ev_id) <= 40)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY s DESC NULLS LAST, r2) AS rank, ev_id FROM e QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY s DESC NULLS LAST, r2) <= 20"""


def k13_repeated_questions(spark: SparkSession, d: str) -> DataFrame:
    """Items whose question repeats an earlier item's, apart from case, marks and blanks."""
    key = F.trim(F.regexp_replace(F.lower("question"), r"[^\p{L}\p{N}]+", " "))
    b = table(spark, d, "run_results", "result_id", "question").filter("question IS NOT NULL").select("result_id", key.alias("k"))
    first = b.groupBy("k").agg(F.min("result_id").alias("first_id"))
    return b.join(first, "k").filter("result_id > first_id").select("result_id", "first_id")


K13_SQL = r"""
WITH b AS (SELECT result_id, trim(regexp_replace(lower(question), '[^\p{L}\p{N}]+', ' ', 'g')) AS k FROM run_results WHERE question IS NOT NULL)
SELECT result_id, first_id FROM (SELECT result_id, min(result_id) OVER (PARTITION BY k) AS first_id FROM b) WHERE result_id > first_id"""


def l6_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Where each symbol variant is defined: at most eight units, by name of function, class or file."""
    units = table(spark, d, "chunker", "item_id", "file_path", "class_name", "function_name")
    base = F.regexp_replace(F.regexp_extract("file_path", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    named = units.select("item_id", F.explode(F.array_compact(F.array_distinct(F.array(F.lower("function_name"), F.lower("class_name"), F.lower(base))))).alias("variant"))
    hits = h6_symbol_variants(spark, d).join(named, "variant").select("symbol", "item_id").distinct()
    return top_k(hits, "symbol", [F.asc("item_id")], 8, "position")


L6_SQL = rf"""
WITH sv AS ({H6_SQL.strip()}),
u AS (SELECT DISTINCT item_id, unnest([lower(function_name), lower(class_name), lower(regexp_replace(regexp_extract(file_path, '([^/\\]*)$', 1), '\.[^.]*$', ''))]) AS variant FROM chunker),
h AS (SELECT DISTINCT symbol, item_id FROM sv JOIN u USING (variant))
SELECT symbol, item_id, row_number() OVER (PARTITION BY symbol ORDER BY item_id) AS position FROM h QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY item_id) <= 8"""


def l9_kinds_of_question(spark: SparkSession, d: str) -> DataFrame:
    q = F.lower(F.coalesce("question", F.lit("")))
    kind = F.coalesce(*[F.when(q.rlike(p), v) for p, v in Q.KINDS], F.lit("Definition"))
    return table(spark, d, "run_results", "result_id", "question").select("result_id", kind.alias("kind"))


L9_SQL = """
SELECT result_id, CASE WHEN regexp_matches(q, 'table|figure|chart') THEN 'Table' WHEN regexp_matches(q, 'equation|formula|mathematical') THEN 'Equation' WHEN regexp_matches(q, 'how many|what is the|number|count|percentage') THEN 'Numerical'
    WHEN regexp_matches(q, 'compare|difference|versus|vs') THEN 'Comparison' WHEN regexp_matches(q, 'why|how|explain|describe') THEN 'Reasoning' ELSE 'Definition' END AS kind
FROM (SELECT result_id, lower(coalesce(question, '')) AS q FROM run_results)"""


def m3_citation_lists(spark: SparkSession, d: str) -> DataFrame:
    """Distinct citations of each question in order of first use, at most 20."""
    c = table(spark, d, "retrieved_chunks", "question_id", "paper_title", "pdf_filename", "page", "chunk_index", "rc_id").filter("question_id IS NOT NULL")
    c = c.select("question_id", X.citation(F.col("paper_title"), F.col("pdf_filename"), F.col("page")).alias("citation"), F.coalesce("chunk_index", F.lit(9999)).alias("i"))
    g = c.groupBy("question_id", "citation").agg(F.min("i").alias("i"))
    return top_k(g, "question_id", [F.asc("i"), F.asc("citation")], 20, "position").select("question_id", "position", "citation")


M3_SQL = """
WITH c AS (SELECT question_id, coalesce(nullif(paper_title, ''), nullif(pdf_filename, ''), 'Unknown Paper') || ', ' || CASE WHEN page IS NULL THEN 'Page unknown' ELSE 'Page ' || CAST(page AS VARCHAR) END AS citation, min(coalesce(chunk_index, 9999)) AS i
    FROM retrieved_chunks WHERE question_id IS NOT NULL GROUP BY 1, 2)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY i, citation) AS position, citation FROM c QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY i, citation) <= 20"""


def q4_grounding_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The tier that settles each question: one strong piece of evidence, else several fair ones, else none."""
    e = table(spark, d, "expanded_evidence", "question_id", "verification_confidence", "similarity").filter("question_id IS NOT NULL")
    s = F.greatest(F.coalesce("verification_confidence", F.lit(0.0)), F.lit(0.0))
    g = e.groupBy("question_id").agg(F.max(s).alias("best"), F.count_if(s >= 0.5).alias("fair"))
    return g.select("question_id", F.round("best", 6).alias("best"), "fair", F.when(F.col("best") >= 0.7, "single evidence").when(F.col("fair") >= 2, "cross evidence").when(F.col("best") > 0, "weak").otherwise("not found").alias("tier"))


Q4_SQL = """
WITH g AS (SELECT question_id, max(greatest(coalesce(verification_confidence, 0.0), 0.0)) AS best, count(*) FILTER (coalesce(verification_confidence, 0.0) >= 0.5) AS fair FROM expanded_evidence WHERE question_id IS NOT NULL GROUP BY 1)
SELECT question_id, round(best, 6) AS best, fair, CASE WHEN best >= 0.7 THEN 'single evidence' WHEN fair >= 2 THEN 'cross evidence' WHEN best > 0 THEN 'weak' ELSE 'not found' END AS tier FROM g"""


def r1_failure_classes(spark: SparkSession, d: str) -> DataFrame:
    """What went wrong with each answer: retrieval (little coverage), generation (little similarity), both or nothing."""
    m = F.col("metrics")
    zero = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    cov, sim = zero(m["concept_coverage_percent"]) < 30, zero(m["semantic_similarity"]) < 0.4
    kind = F.when(cov & sim, "both").when(cov, "retrieval").when(sim, "generation").otherwise("none")
    return table(spark, d, "run_results", "result_id", "metrics").filter("metrics IS NOT NULL").select("result_id", kind.alias("failure"))


R1_SQL = """
WITH m AS (SELECT result_id, coalesce(CASE WHEN isnan(metrics.concept_coverage_percent) THEN 0 ELSE metrics.concept_coverage_percent END, 0) < 30 AS c, coalesce(CASE WHEN isnan(metrics.semantic_similarity) THEN 0 ELSE metrics.semantic_similarity END, 0) < 0.4 AS s FROM run_results WHERE metrics IS NOT NULL)
SELECT result_id, CASE WHEN c AND s THEN 'both' WHEN c THEN 'retrieval' WHEN s THEN 'generation' ELSE 'none' END AS failure FROM m"""


def r7_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Runs against gates on their mean metrics, with the gates they fail."""
    m = F.col("metrics")
    r = table(spark, d, "run_results", "run_name", "metrics").filter("run_name IS NOT NULL AND metrics IS NOT NULL")
    g = r.groupBy("run_name").agg(F.avg(m["grounding_score_percent"]).alias("g"), F.avg(m["latency"]).alias("l"), F.avg((m["grounding_label"] == "Hallucinated").cast("double")).alias("h"))
    gates = F.array_compact(F.array(F.when(F.coalesce("g", F.lit(0.0)) < 50, "grounding"), F.when(F.coalesce("l", F.lit(0.0)) > 10, "latency"), F.when(F.coalesce("h", F.lit(0.0)) > 0.4, "hallucination")))
    return g.select("run_name", F.array_join(gates, ",").alias("failed_gates"), (F.size(gates) == 0).alias("accepted"))


R7_SQL = """
WITH g AS (SELECT run_name, coalesce(avg(metrics.grounding_score_percent), 0) < 50 AS g, coalesce(avg(metrics.latency), 0) > 10 AS l, coalesce(avg(CASE WHEN metrics.grounding_label IS NULL THEN NULL WHEN metrics.grounding_label = 'Hallucinated' THEN 1.0 ELSE 0.0 END), 0) > 0.4 AS h
    FROM run_results WHERE run_name IS NOT NULL AND metrics IS NOT NULL GROUP BY 1)
SELECT run_name, concat_ws(',', CASE WHEN g THEN 'grounding' END, CASE WHEN l THEN 'latency' END, CASE WHEN h THEN 'hallucination' END) AS failed_gates, NOT g AND NOT l AND NOT h AS accepted FROM g"""


def st5_paired_effect(spark: SparkSession, d: str) -> DataFrame:
    """Mean paired difference of two halves of the runs with its normal interval and effect size."""
    a, b = _latest_runs(spark, d)
    p = a.select("question_id", F.col("semantic").alias("x")).join(b.select("question_id", F.col("semantic").alias("y")), "question_id").select((F.col("x") - F.col("y")).alias("v"))
    g = p.agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    half = 1.96 * F.col("s") / F.sqrt("n")
    return g.select("n", F.round("m", 6).alias("mean"), F.round(F.col("m") - half, 6).alias("low"), F.round(F.col("m") + half, 6).alias("high"), F.round(F.col("m") / F.col("s"), 6).alias("effect"))


ST5_SQL = f"""WITH {RUNS_SQL},
p AS (SELECT a.semantic - b.semantic AS v FROM (SELECT * FROM s WHERE side = 0) a JOIN (SELECT * FROM s WHERE side = 1) b USING (question_id)),
g AS (SELECT count(v) AS n, avg(v) AS m, stddev_samp(v) AS sd FROM p)
SELECT n, round(m, 6) AS mean, round(m - 1.96 * sd / sqrt(n), 6) AS low, round(m + 1.96 * sd / sqrt(n), 6) AS high, round(m / sd, 6) AS effect FROM g"""


def u2_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that arrived more than a day after they were collected, by month and source."""
    e = table(spark, d, "expanded_evidence", "collected_at", "ingested_at", "evidence_source").filter("collected_at IS NOT NULL AND ingested_at IS NOT NULL")
    late = F.col("ingested_at") > F.col("collected_at") + F.expr("INTERVAL 1 DAY")
    return e.groupBy(F.date_format("collected_at", "yyyy-MM").alias("month"), F.coalesce("evidence_source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("late"))


U2_SQL = """
SELECT strftime(collected_at, '%Y-%m') AS month, coalesce(evidence_source, 'none') AS source, count(*) AS n, count(*) FILTER (ingested_at > collected_at + INTERVAL 1 DAY) AS late
FROM expanded_evidence WHERE collected_at IS NOT NULL AND ingested_at IS NOT NULL GROUP BY 1, 2"""

QUERIES = {
    "b10_score_table": (b10_score_table, B10_SQL),
    "c10_chunk_projection": (c10_chunk_projection, C10_SQL),
    "e8_failures": (e8_failures, E8_SQL),
    "h6_symbol_variants": (h6_symbol_variants, H6_SQL),
    "l7_repositories": (l7_repositories, L7_SQL),
    "h25_norms": (h25_norms, H25_SQL),
    "h32_missing_metrics": (h32_missing_metrics, H32_SQL),
    "k7_pipeline": (k7_pipeline, K7_SQL),
    "k13_repeated_questions": (k13_repeated_questions, K13_SQL),
    "l6_definitions": (l6_definitions, L6_SQL),
    "l9_kinds_of_question": (l9_kinds_of_question, L9_SQL),
    "m3_citation_lists": (m3_citation_lists, M3_SQL),
    "q4_grounding_tiers": (q4_grounding_tiers, Q4_SQL),
    "r1_failure_classes": (r1_failure_classes, R1_SQL),
    "r7_acceptance": (r7_acceptance, R7_SQL),
    "st5_paired_effect": (st5_paired_effect, ST5_SQL),
    "u2_late_rows": (u2_late_rows, U2_SQL),
}
