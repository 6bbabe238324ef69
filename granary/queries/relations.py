"""Queries of filters, joins, windows and set operations over the retrieval tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import relations as R
from granary.operators import statistics as S
from granary.sources.tables import table


def c1_equality_filter(spark: SparkSession, d: str) -> DataFrame:
    return R.equals_all(table(spark, d, "chunker", "item_id", "language", "branch", "file_path"), {"language": "python", "branch": "main"}).select("item_id", "file_path")


C1_SQL = "SELECT item_id, file_path FROM chunker WHERE language = 'python' AND branch = 'main'"


def c3_base_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunker", "item_id", "repository", "file_path").withColumn("base", F.regexp_extract("file_path", r"([^/\\]*)$", 1))
    w = Window.partitionBy("base").orderBy("repository", "item_id")
    return c.filter("base <> ''").withColumn("r", F.row_number().over(w)).filter("r = 1").select("base", "repository", "item_id")


C3_SQL = r"""
SELECT base, repository, item_id FROM (SELECT regexp_extract(file_path, '([^/\\]*)$', 1) AS base, repository, item_id FROM chunker) WHERE base <> ''
QUALIFY row_number() OVER (PARTITION BY base ORDER BY repository NULLS FIRST, item_id) = 1"""


def c4_section_filter(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "retrieved_chunks", "rc_id", "question_id", "section").filter("question_id IS NOT NULL")
    return R.keep_unless_empty(c, "question_id", ~F.lower(F.coalesce("section", F.lit(""))).rlike(X.LOW_VALUE)).select("question_id", "rc_id")


C4_SQL = f"""
SELECT question_id, rc_id FROM (SELECT question_id, rc_id, NOT regexp_matches(lower(coalesce(section, '')), '{X.LOW_VALUE}') AS keep FROM retrieved_chunks WHERE question_id IS NOT NULL)
QUALIFY keep OR NOT bool_or(keep) OVER (PARTITION BY question_id)"""


def c6_noise_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.trim(F.coalesce("chunk_text", F.lit("")))
    refs = F.lower(t).contains("references")
    noise = (F.length(t) < 50) | (refs & (F.size(F.split(t, "\n")) > 10) & F.substring(F.lower(t), 1, 30).contains("references"))
    c = table(spark, d, "expanded_evidence", "ev_id", "chunk_text", "similarity", "cross_encoder_score")
    score = F.col("cross_encoder_score")
    relevant = ~noise & ((F.coalesce("similarity", F.lit(0.0)) >= 0.3) | F.coalesce((score >= -1.0) & ~F.isnan(score), F.lit(False)))
    return c.select("ev_id", noise.alias("noise"), relevant.alias("relevant"))


C6_SQL = """
WITH c AS (SELECT ev_id, trim(coalesce(chunk_text, '')) AS t, coalesce(similarity, 0.0) AS s, cross_encoder_score AS x FROM expanded_evidence),
n AS (SELECT ev_id, length(t) < 50 OR (contains(lower(t), 'references') AND len(string_split(t, chr(10))) > 10 AND contains(substring(lower(t), 1, 30), 'references')) AS noise, s, x FROM c)
SELECT ev_id, noise, NOT noise AND (s >= 0.3 OR coalesce(x >= -1.0 AND NOT isnan(x), false)) AS relevant FROM n"""


def c8_paper_match(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.lower(F.replace(F.regexp_replace(c, r"(?i)\.pdf$", ""), F.lit("_"), F.lit(" ")))
    r = table(spark, d, "run_results", "question_id", "paper").filter("paper IS NOT NULL AND question_id IS NOT NULL").select("question_id", key("paper").alias("asked")).distinct()
    c = table(spark, d, "retrieved_chunks", "rc_id", "question_id", "pdf_filename").filter("pdf_filename IS NOT NULL").select("rc_id", "question_id", key("pdf_filename").alias("found"))
    # names are matched once for each question, not once for each of its chunks
    named = c.select("question_id", "found").distinct().join(r, "question_id").filter(F.col("found").contains(F.col("asked")) | F.col("asked").contains(F.col("found")))
    return c.join(named.select("question_id", "found").distinct(), ["question_id", "found"]).select("rc_id", "question_id").distinct()


C8_SQL = r"""
WITH r AS (SELECT DISTINCT question_id, lower(replace(regexp_replace(paper, '(?i)\.pdf$', ''), '_', ' ')) AS asked FROM run_results WHERE paper IS NOT NULL AND question_id IS NOT NULL),
c AS (SELECT rc_id, question_id, lower(replace(regexp_replace(pdf_filename, '(?i)\.pdf$', ''), '_', ' ')) AS found FROM retrieved_chunks WHERE pdf_filename IS NOT NULL)
SELECT DISTINCT rc_id, question_id FROM c JOIN r USING (question_id) WHERE contains(found, asked) OR contains(asked, found)"""


def c9_split_selector(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "documents", "doc_id", "lang", "source", "collection_id").filter((F.lower("lang") == "en") & F.lower(F.trim("source")).isin("paper_fulltext", "eval_reports"))
    return b.join(table(spark, d, "papers", "collection_id"), "collection_id", "left_semi").select("doc_id", "source")


C9_SQL = "SELECT doc_id, source FROM documents b WHERE lower(lang) = 'en' AND lower(trim(source)) IN ('paper_fulltext', 'eval_reports') AND EXISTS (SELECT 1 FROM papers p WHERE p.collection_id = b.collection_id)"


def d1_expected_answers(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "run_results", "result_id", "question_id", "paper", "question", "expected")
    known = r.filter("expected IS NOT NULL")
    by_id = known.groupBy("question_id").agg(F.min("expected").alias("by_id"))
    by_text = known.filter("paper IS NOT NULL").groupBy("paper", "question").agg(F.min("expected").alias("by_text"))
    out = r.select("result_id", "question_id", "paper", "question").join(by_id, "question_id", "left").join(by_text, ["paper", "question"], "left")
    return out.select("result_id", F.coalesce("by_id", "by_text").alias("expected"))


D1_SQL = """
WITH a AS (SELECT question_id, min(expected) AS by_id FROM run_results WHERE expected IS NOT NULL GROUP BY 1),
b AS (SELECT paper, question, min(expected) AS by_text FROM run_results WHERE expected IS NOT NULL AND paper IS NOT NULL GROUP BY 1, 2)
SELECT result_id, coalesce(by_id, by_text) AS expected FROM run_results r LEFT JOIN a USING (question_id) LEFT JOIN b ON b.paper = r.paper AND b.question = r.question"""


def d2_first_collection(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers", "paper_id", "pdf_filename", "collection_id").groupBy(F.lower("pdf_filename").alias("file")).agg(F.min_by("collection_id", "paper_id").alias("collection_id"))
    c = table(spark, d, "retrieved_chunks", "rc_id", "pdf_filename").select("rc_id", F.lower("pdf_filename").alias("file"))
    return c.join(p, "file").select("rc_id", "collection_id")


D2_SQL = """
WITH p AS (SELECT lower(pdf_filename) AS file, arg_min(collection_id, paper_id) AS collection_id FROM papers GROUP BY 1)
SELECT rc_id, collection_id FROM retrieved_chunks c JOIN p ON p.file = lower(c.pdf_filename)"""


def _latest_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The runs with even and those with odd numbers, one row a question each: its mean metrics."""
    r = table(spark, d, "run_results", "run_name", "question_id", "metrics").filter("run_name IS NOT NULL AND question_id IS NOT NULL")
    m = r.groupBy("run_name", "question_id").agg(F.avg("metrics.semantic_similarity").alias("semantic"), F.avg("metrics.grounding_score_percent").alias("grounding"), F.avg("metrics.concept_coverage_percent").alias("coverage"))
    half = F.pmod(F.regexp_extract("run_name", r"([0-9]+)$", 1).cast("int"), F.lit(2))
    side = lambda v: m.filter(half == v).groupBy("question_id").agg(*[F.avg(c).alias(c) for c in ("semantic", "grounding", "coverage")])
    return side(0), side(1)


def d3_run_comparison(spark: SparkSession, d: str) -> DataFrame:
    out = R.compare_runs(*_latest_runs(spark, d), "question_id", ["semantic", "grounding", "coverage"])
    return out.select("question_id", "metric", *[F.round(c, 6).alias(c) for c in ("baseline", "current", "diff")])


RUNS_SQL = r"""
m AS (SELECT run_name, question_id, CAST(regexp_extract(run_name, '([0-9]+)$', 1) AS INTEGER) % 2 AS side, avg(metrics.semantic_similarity) AS semantic, avg(metrics.grounding_score_percent) AS grounding,
    avg(metrics.concept_coverage_percent) AS coverage FROM run_results WHERE run_name IS NOT NULL AND question_id IS NOT NULL GROUP BY ALL),
s AS (SELECT side, question_id, avg(semantic) AS semantic, avg(grounding) AS grounding, avg(coverage) AS coverage FROM m GROUP BY ALL),
j AS (SELECT question_id, c.semantic AS cs, b.semantic AS bs, c.grounding AS cg, b.grounding AS bg, c.coverage AS cc, b.coverage AS bc
    FROM (SELECT * FROM s WHERE side = 0) c FULL JOIN (SELECT * FROM s WHERE side = 1) b USING (question_id)),
u AS (SELECT question_id, 'semantic' AS metric, bs AS baseline, cs AS current FROM j UNION ALL SELECT question_id, 'grounding', bg, cg FROM j UNION ALL SELECT question_id, 'coverage', bc, cc FROM j)"""
D3_SQL = f"WITH {RUNS_SQL} SELECT question_id, metric, round(baseline, 6) AS baseline, round(current, 6) AS current, round(current - baseline, 6) AS diff FROM u"


def d4_missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "retrieved_chunks", "chunk_hash").filter("chunk_hash IS NOT NULL").distinct()
    return c.join(table(spark, d, "emb_cache", "chunk_hash", "model_name").filter("model_name = 'minilm-64'"), "chunk_hash", "left_anti")


D4_SQL = "SELECT DISTINCT chunk_hash FROM retrieved_chunks c WHERE chunk_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM emb_cache e WHERE e.chunk_hash = c.chunk_hash AND e.model_name = 'minilm-64')"


def d7_neighbour_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "expanded_evidence", "pdf_filename", "page").filter("pdf_filename IS NOT NULL AND page IS NOT NULL").distinct()
    w = Window.partitionBy("pdf_filename").orderBy("page")
    near = lambda c: F.coalesce(F.when(F.abs(c - F.col("page")) <= 1, c), F.lit(-1))
    return p.select("pdf_filename", "page", near(F.lag("page").over(w)).alias("previous"), near(F.lead("page").over(w)).alias("next"))


D7_SQL = """
WITH p AS (SELECT DISTINCT pdf_filename, page FROM expanded_evidence WHERE pdf_filename IS NOT NULL AND page IS NOT NULL)
SELECT pdf_filename, page, coalesce((SELECT a.page FROM p a WHERE a.pdf_filename = p.pdf_filename AND a.page = p.page - 1), -1) AS previous,
    coalesce((SELECT a.page FROM p a WHERE a.pdf_filename = p.pdf_filename AND a.page = p.page + 1), -1) AS next FROM p"""


def d8_concept_coverage(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "run_results", "result_id", "expected", "answer").filter("expected IS NOT NULL AND answer IS NOT NULL")
    concepts = X.long_words(F.col("expected"), 6)
    r = r.select("result_id", concepts.alias("c"), F.lower("answer").alias("a"))
    hit = F.size(F.filter("c", lambda w: F.contains(F.col("a"), w)))
    cov = F.when(F.size("c") == 0, 0.0).otherwise(F.round(hit / F.size("c") * 100, 4))
    return r.select("result_id", F.size("c").alias("concepts"), cov.alias("coverage"), F.when(cov >= 70, "Correct").when(cov >= 40, "Partial").otherwise("Incorrect").alias("verdict"))


D8_SQL = r"""
WITH r AS (SELECT result_id, list_distinct(list_filter(regexp_extract_all(lower(expected), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 6)) AS c, lower(answer) AS a
    FROM run_results WHERE expected IS NOT NULL AND answer IS NOT NULL),
x AS (SELECT result_id, len(c) AS concepts, CASE WHEN len(c) = 0 THEN 0.0 ELSE round(len(list_filter(c, lambda w: contains(a, w))) / len(c) * 100, 4) END AS coverage FROM r)
SELECT result_id, concepts, coverage, CASE WHEN coverage >= 70 THEN 'Correct' WHEN coverage >= 40 THEN 'Partial' ELSE 'Incorrect' END AS verdict FROM x"""


def d11_last_answers(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "run_results", "question_id", "result_id", "run_name", "saved_at").filter("question_id IS NOT NULL AND saved_at IS NOT NULL")
    return R.last_per_key(r, "question_id", [F.col("saved_at").alias("o1"), F.col("result_id").alias("o2")], ["result_id", "run_name"])


D11_SQL = "SELECT question_id, result_id, run_name FROM run_results WHERE question_id IS NOT NULL AND saved_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY saved_at DESC, result_id DESC) = 1"


def d12_paired_differences(spark: SparkSession, d: str) -> DataFrame:
    a, b = _latest_runs(spark, d)
    j = a.select("question_id", F.col("semantic").alias("x")).join(b.select("question_id", F.col("semantic").alias("y")), "question_id", "left")
    return j.select("question_id", F.round(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)), 6).alias("difference"))


D12_SQL = f"""WITH {RUNS_SQL}
SELECT question_id, round(coalesce(a.semantic, 0) - coalesce(b.semantic, 0), 6) AS difference FROM (SELECT * FROM s WHERE side = 0) a LEFT JOIN (SELECT * FROM s WHERE side = 1) b USING (question_id)"""


def f1_top_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "retrieved_chunks", "question_id", "rc_id", "similarity", "chunk_index").filter("question_id IS NOT NULL AND similarity IS NOT NULL")
    return R.top_k(c, "question_id", [F.desc("similarity"), F.asc_nulls_last("chunk_index"), F.asc("rc_id")], 5).select("question_id", "rank", "rc_id", F.round("similarity", 6).alias("similarity"))


F1_SQL = """
SELECT question_id, row_number() OVER w AS rank, rc_id, round(similarity, 6) AS similarity FROM retrieved_chunks WHERE question_id IS NOT NULL AND similarity IS NOT NULL
WINDOW w AS (PARTITION BY question_id ORDER BY similarity DESC, chunk_index NULLS LAST, rc_id) QUALIFY row_number() OVER w <= 5"""


def f3_section_leaders(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "retrieved_chunks", "question_id", "rc_id", "section", "page", "similarity").filter("question_id IS NOT NULL").withColumn("section", F.coalesce("section", F.lit("Unknown")))
    c = c.withColumn("first_page", F.min(F.coalesce("page", F.lit(9999))).over(Window.partitionBy("question_id", "section")))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("question_id", "section").orderBy(F.desc_nulls_last("similarity"), "rc_id"))).filter("r <= 3")
    return c.withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy("first_page", "section", F.coalesce("page", F.lit(0)), "r"))).select("question_id", "position", "section", "rc_id")


F3_SQL = """
WITH c AS (SELECT question_id, rc_id, coalesce(section, 'Unknown') AS section, page, similarity FROM retrieved_chunks WHERE question_id IS NOT NULL),
t AS (SELECT *, min(coalesce(page, 9999)) OVER (PARTITION BY question_id, section) AS first_page, row_number() OVER (PARTITION BY question_id, section ORDER BY similarity DESC NULLS LAST, rc_id) AS r FROM c)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY first_page, section, coalesce(page, 0), r) AS position, section, rc_id FROM t WHERE r <= 3"""


def f6_dominant_source(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "expanded_evidence", "question_id", "evidence_source").filter("question_id IS NOT NULL AND evidence_source IS NOT NULL")
    n = e.groupBy("question_id", "evidence_source").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("question_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "evidence_source")).alias("s"))
    return best.select("question_id", F.col("s.evidence_source").alias("evidence_source"), (-F.col("s.m")).alias("n"))


F6_SQL = """
SELECT question_id, evidence_source, n FROM (SELECT question_id, evidence_source, count(*) AS n FROM expanded_evidence WHERE question_id IS NOT NULL AND evidence_source IS NOT NULL GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY n DESC, evidence_source) = 1"""


def f7_seeded_order(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "run_results", "result_id", "run_name").filter("run_name IS NOT NULL")
    b = b.withColumn("h", F.md5(F.concat(F.col("result_id").cast("string"), F.lit("/42"))))
    return S.running_total(b, ["run_name"], ["h", "result_id"], F.lit(1), "n").select("run_name", "result_id", (F.col("n") + 1).alias("position"))


F7_SQL = "SELECT run_name, result_id, row_number() OVER (PARTITION BY run_name ORDER BY md5(CAST(result_id AS VARCHAR) || '/42')) AS position FROM run_results WHERE run_name IS NOT NULL"


def f8_sorted_names(spark: SparkSession, d: str) -> DataFrame:
    # at most 12 names a file are kept by rank, so no set of a file's names is gathered
    c = table(spark, d, "chunker", "file_path", "function_name").filter("file_path IS NOT NULL AND function_name IS NOT NULL").distinct()
    c = R.top_k(c, "file_path", [F.asc("function_name")], 12)
    return c.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_list("function_name")), ", ").alias("functions"))


F8_SQL = """
SELECT file_path, string_agg(function_name, ', ' ORDER BY function_name) AS functions FROM (SELECT DISTINCT file_path, function_name FROM chunker WHERE file_path IS NOT NULL AND function_name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY function_name) <= 12) GROUP BY file_path"""


def g1_corpus_union(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name, key: table(spark, d, name).select(F.lit(name).alias("origin"), F.col(key).alias("row_id"), "repository", "similarity")
    u = part("retrieved_chunks", "rc_id").unionByName(part("expanded_evidence", "ev_id")).filter("repository IS NOT NULL AND similarity IS NOT NULL")
    return R.top_k(u, "repository", [F.desc("similarity"), F.asc("origin"), F.asc("row_id")], 10).select("repository", "rank", "origin", "row_id")


G1_SQL = """
WITH u AS (SELECT 'retrieved_chunks' AS origin, rc_id AS row_id, repository, similarity FROM retrieved_chunks UNION ALL SELECT 'expanded_evidence', ev_id, repository, similarity FROM expanded_evidence)
SELECT repository, row_number() OVER w AS rank, origin, row_id FROM u WHERE repository IS NOT NULL AND similarity IS NOT NULL
WINDOW w AS (PARTITION BY repository ORDER BY similarity DESC, origin, row_id) QUALIFY row_number() OVER w <= 10"""


def g2_distinct_hashes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "retrieved_chunks", "question_id", "chunk_hash", "chunk_index", "rc_id").filter("question_id IS NOT NULL")
    return R.first_per_hash(c, "question_id", "chunk_hash", [F.asc_nulls_last("chunk_index"), F.asc("rc_id")]).select("question_id", "chunk_hash", "rc_id")


G2_SQL = """
SELECT question_id, chunk_hash, rc_id FROM retrieved_chunks WHERE question_id IS NOT NULL AND chunk_hash <> ''
QUALIFY row_number() OVER (PARTITION BY question_id, chunk_hash ORDER BY chunk_index NULLS LAST, rc_id) = 1"""


def g3_hash_differences(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "retrieved_chunks", "chunk_hash").filter("chunk_hash IS NOT NULL").distinct()
    b = table(spark, d, "emb_cache", "chunk_hash").filter("chunk_hash IS NOT NULL").distinct()
    j = a.withColumn("in_chunks", F.lit(True)).join(b.withColumn("in_cache", F.lit(True)), "chunk_hash", "full")
    return j.select("chunk_hash", F.when(F.col("in_cache").isNull(), "added").when(F.col("in_chunks").isNull(), "removed").otherwise("kept").alias("status"))


G3_SQL = """
SELECT coalesce(a.h, b.h) AS chunk_hash, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'removed' ELSE 'kept' END AS status
FROM (SELECT DISTINCT chunk_hash AS h FROM retrieved_chunks WHERE chunk_hash IS NOT NULL) a FULL JOIN (SELECT DISTINCT chunk_hash AS h FROM emb_cache WHERE chunk_hash IS NOT NULL) b ON a.h = b.h"""


def g5_no_overlap(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "run_results", "question_id", "paper").filter("question_id IS NOT NULL AND paper IS NOT NULL").distinct()
    c = table(spark, d, "retrieved_chunks", "question_id", "pdf_filename", "chunk_index").filter("chunk_index < 10").select("question_id", F.col("pdf_filename").alias("paper"))
    asked = gold.select("question_id").distinct()
    return asked.join(gold.join(c, ["question_id", "paper"], "left_semi"), "question_id", "left_anti")


G5_SQL = """
SELECT DISTINCT question_id FROM run_results q WHERE question_id IS NOT NULL AND paper IS NOT NULL AND question_id NOT IN (
    SELECT r.question_id FROM run_results r JOIN retrieved_chunks c ON c.question_id = r.question_id AND c.pdf_filename = r.paper WHERE chunk_index < 10)"""


def g6_first_seen_files(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "retrieved_chunks", "question_id", "pdf_filename", "chunk_index").filter("question_id IS NOT NULL AND pdf_filename IS NOT NULL")
    first = c.groupBy("question_id", "pdf_filename").agg(F.min(F.coalesce("chunk_index", F.lit(9999))).alias("first_seen"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy("first_seen", "pdf_filename")))


G6_SQL = """
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY first_seen, pdf_filename) AS position FROM (
    SELECT question_id, pdf_filename, min(coalesce(chunk_index, 9999)) AS first_seen FROM retrieved_chunks WHERE question_id IS NOT NULL AND pdf_filename IS NOT NULL GROUP BY 1, 2)"""

QUERIES = {
    "c1_equality_filter": (c1_equality_filter, C1_SQL),
    "c3_base_names": (c3_base_names, C3_SQL),
    "c4_section_filter": (c4_section_filter, C4_SQL),
    "c6_noise_flags": (c6_noise_flags, C6_SQL),
    "c8_paper_match": (c8_paper_match, C8_SQL),
    "c9_split_selector": (c9_split_selector, C9_SQL),
    "d1_expected_answers": (d1_expected_answers, D1_SQL),
    "d2_first_collection": (d2_first_collection, D2_SQL),
    "d3_run_comparison": (d3_run_comparison, D3_SQL),
    "d4_missing_embeddings": (d4_missing_embeddings, D4_SQL),
    "d7_neighbour_pages": (d7_neighbour_pages, D7_SQL),
    "d8_concept_coverage": (d8_concept_coverage, D8_SQL),
    "d11_last_answers": (d11_last_answers, D11_SQL),
    "d12_paired_differences": (d12_paired_differences, D12_SQL),
    "f1_top_chunks": (f1_top_chunks, F1_SQL),
    "f3_section_leaders": (f3_section_leaders, F3_SQL),
    "f6_dominant_source": (f6_dominant_source, F6_SQL),
    "f7_seeded_order": (f7_seeded_order, F7_SQL),
    "f8_sorted_names": (f8_sorted_names, F8_SQL),
    "g1_corpus_union": (g1_corpus_union, G1_SQL),
    "g2_distinct_hashes": (g2_distinct_hashes, G2_SQL),
    "g3_hash_differences": (g3_hash_differences, G3_SQL),
    "g5_no_overlap": (g5_no_overlap, G5_SQL),
    "g6_first_seen_files": (g6_first_seen_files, G6_SQL),
}
