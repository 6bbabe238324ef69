"""Queries of the scalar text functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.sources.tables import table

_TOKEN_SQL = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def sql_lines(x: str) -> str:
    """SQL for the lines of a text."""
    return rf"string_split_regex(regexp_replace({x}, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n')"


def a5_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunker", "item_id", "file_path").select("item_id", X.language_of(F.col("file_path")).alias("detected"))


_A5 = " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in exts)}) THEN '{lang}'" for lang, exts in X.LANGUAGES.items())
A5_SQL = rf"SELECT item_id, CASE {_A5} ELSE 'unknown' END AS detected FROM (SELECT item_id, regexp_extract(lower(file_path), '\.([^./\\]*)$', 1) AS ext FROM chunker)"


def h1_token_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.coalesce(X.token_count(F.col("text")), F.lit(0)).alias("tokens"))


def h2_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(X.blank_tokens(F.col("text")))
    return table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.floor(n * 133 / 100).cast("long").alias("estimate"))


H2_SQL = r"SELECT doc_id, CAST(floor(len(list_filter(string_split_regex(lower(text), '[\s\x0b]+'), lambda w: w <> '')) * 133 / 100) AS BIGINT) AS estimate FROM documents WHERE text IS NOT NULL"


def h3_term_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "retrieved_chunks", "chunk_text").select(F.explode(X.blank_tokens(F.col("chunk_text"))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


H3_SQL = r"SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(lower(chunk_text), '[\s\x0b]+'), lambda w: w <> '')) AS term FROM retrieved_chunks) GROUP BY term"


def h4_normalised_answer(spark: SparkSession, d: str) -> DataFrame:
    a = F.lower(F.col("answer"))
    a = F.regexp_replace(a, r"(^|[^\p{L}\p{N}_])(a|an|the)([^\p{L}\p{N}_]|$)", "$1 $3")
    a = F.regexp_replace(a, r"[!-/:-@\[-`{-~]", "")
    a = F.trim(F.regexp_replace(a, r"\s+", " "))
    return table(spark, d, "run_results", "result_id", "answer").filter("answer IS NOT NULL").select("result_id", a.alias("normalised"))


H4_SQL = r"""
SELECT result_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(answer), '(^|[^\p{L}\p{N}_])(a|an|the)([^\p{L}\p{N}_]|$)', '\1 \3', 'g'),
    '[!-/:-@\[-`{-~]', '', 'g'), '[\s\x0b]+', ' ', 'g')) AS normalised
FROM run_results WHERE answer IS NOT NULL"""


def h5_normalised_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunker", "item_id", "file_path").select("item_id", F.lower(F.trim(F.replace(F.col("file_path"), F.lit("\\"), F.lit("/")))).alias("path"))


H5_SQL = r"SELECT item_id, lower(trim(replace(file_path, '\', '/'))) AS path FROM chunker"


def h8_file_names(spark: SparkSession, d: str) -> DataFrame:
    s = F.trim(F.regexp_replace(F.translate(F.col("paper_title"), '<>:"/\\|?*', ""), r"\s+", " "))
    return table(spark, d, "expanded_evidence", "ev_id", "paper_title").select("ev_id", F.when(F.length(s) > 120, F.concat(F.substring(s, 1, 117), F.lit("..."))).otherwise(s).alias("file_name"))


H8_SQL = r"""
SELECT ev_id, CASE WHEN length(s) > 120 THEN substring(s, 1, 117) || '...' ELSE s END AS file_name
FROM (SELECT ev_id, trim(regexp_replace(translate(paper_title, '<>:"/\|?*', ''), '\s+', ' ', 'g')) AS s FROM expanded_evidence)"""


def h9_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "run_results", "result_id", "answer").select("result_id", F.posexplode(X.sentences(F.col("answer"))).alias("position", "sentence"))
    return s.filter(F.trim("sentence") != "")


H9_SQL = r"""
WITH s AS (SELECT result_id, string_split(regexp_replace(answer, '([.!?])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM run_results WHERE answer IS NOT NULL),
p AS (SELECT result_id, unnest(range(len(parts))) AS position, unnest(parts) AS sentence FROM s)
SELECT result_id, position, sentence FROM p WHERE trim(sentence) <> ''"""


def h10_excerpts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("content")
    return table(spark, d, "chunker", "item_id", "content").filter("content IS NOT NULL").select("item_id", F.when(F.length(t) > 1000, F.concat(F.substring(t, 1, 1000), F.lit(" [truncated]"))).otherwise(t).alias("excerpt"))


H10_SQL = "SELECT item_id, CASE WHEN length(content) > 1000 THEN substring(content, 1, 1000) || ' [truncated]' ELSE content END AS excerpt FROM chunker WHERE content IS NOT NULL"


def h11_citations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "retrieved_chunks").select("rc_id", X.citation(F.col("paper_title"), F.col("pdf_filename"), F.col("page")).alias("citation"))


H11_SQL = """
SELECT rc_id, coalesce(nullif(paper_title, ''), nullif(pdf_filename, ''), 'Unknown Paper') || ', ' ||
    CASE WHEN page IS NULL THEN 'Page unknown' ELSE 'Page ' || CAST(page AS VARCHAR) END AS citation FROM retrieved_chunks"""


def h12_sources_json(spark: SparkSession, d: str) -> DataFrame:
    """The number of sources of each cached answer and how it was read: as it stands, after repair (fences, comments, trailing commas), or by its quoted strings alone."""
    raw = F.trim(F.coalesce("sources", F.lit("")))
    fixed = F.regexp_replace(raw, r"^```[a-z]*\s*|\s*```$", "")
    fixed = F.regexp_replace(F.regexp_replace(fixed, r"//[^\n\"]*(\n|$)", "$1"), r",\s*([\]}])", "$1")
    size = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.startswith(F.trim(c), F.lit("[")), F.json_array_length(c))
    quoted = F.size(F.regexp_extract_all(raw, F.lit(r'"([^"]+)"'), F.lit(1)))
    n = F.coalesce(size(raw), size(fixed), quoted)
    how = F.when(size(raw).isNotNull(), "parsed").when(size(fixed).isNotNull(), "repaired").when(quoted > 0, "salvaged").otherwise("none")
    return table(spark, d, "semantic_cache", "cache_id", "sources").select("cache_id", n.alias("n_sources"), how.alias("how"))


H12_SQL = r"""
WITH r AS (SELECT cache_id, trim(coalesce(sources, '')) AS r FROM semantic_cache),
f AS (SELECT cache_id, r, regexp_replace(regexp_replace(regexp_replace(r, '^```[a-z]*\s*|\s*```$', '', 'g'), '//[^\n"]*(\n|$)', '\1', 'g'), ',\s*([\]}])', '\1', 'g') AS f FROM r),
n AS (SELECT cache_id, CASE WHEN json_valid(r) AND json_type(r) = 'ARRAY' THEN json_array_length(r) END AS a, CASE WHEN json_valid(f) AND json_type(f) = 'ARRAY' THEN json_array_length(f) END AS b, len(regexp_extract_all(r, '"([^"]+)"', 1)) AS c FROM f)
SELECT cache_id, CAST(coalesce(a, b, c) AS BIGINT) AS n_sources, CASE WHEN a IS NOT NULL THEN 'parsed' WHEN b IS NOT NULL THEN 'repaired' WHEN c > 0 THEN 'salvaged' ELSE 'none' END AS how FROM n"""


def h13_references(spark: SparkSession, d: str) -> DataFrame:
    m = F.regexp_extract_all(F.lower("chunk_text"), F.lit(r"\b(?:table|figure)\s*[0-9]+\b"), F.lit(0))
    t = table(spark, d, "expanded_evidence", "ev_id", "chunk_text").select("ev_id", F.explode(F.array_distinct(m)).alias("reference"))
    return t


H13_SQL = r"SELECT ev_id, unnest(list_distinct(regexp_extract_all(lower(chunk_text), '\b(?:table|figure)\s*[0-9]+\b'))) AS reference FROM expanded_evidence"


def h14_markdown_rows(spark: SparkSession, d: str) -> DataFrame:
    cells = F.transform(F.array("question_id", "paper_title", "section"), lambda c: F.replace(F.coalesce(F.trim(c), F.lit("")), F.lit("\n"), F.lit(" ")))
    return table(spark, d, "retrieved_chunks").select("rc_id", F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("row"))


H14_SQL = r"""
SELECT rc_id, '| ' || array_to_string([replace(coalesce(trim(x), ''), chr(10), ' ') FOR x IN [question_id, paper_title, section]], ' | ') || ' |' AS "row" FROM retrieved_chunks"""


def h15_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = F.transform(F.regexp_extract_all("answer", F.lit(X.NUMBER), F.lit(0)), lambda x: x.cast("double"))
    a = table(spark, d, "run_results", "result_id", "answer").filter("answer IS NOT NULL").select("result_id", n.alias("n"))
    return a.select("result_id", F.size("n").alias("numbers"), F.round(F.aggregate("n", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.array_max("n").alias("largest"))


H15_SQL = r"""
WITH a AS (SELECT result_id, list_transform(regexp_extract_all(answer, '[0-9]+\.?[0-9]*'), lambda x: CAST(x AS DOUBLE)) AS n FROM run_results WHERE answer IS NOT NULL)
SELECT result_id, len(n) AS numbers, round(coalesce(list_sum(n), 0), 4) AS total, list_max(n) AS largest FROM a"""


def h16_line_classes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "retrieved_chunks", "rc_id", "chunk_text").filter("chunk_text IS NOT NULL").select("rc_id", F.explode(X.lines(F.col("chunk_text"))).alias("line"))
    flag = lambda p: F.sum(F.col("line").rlike(p).cast("long"))
    return t.groupBy("rc_id").agg(
        F.count(F.lit(1)).alias("lines"), flag(X.TABLE_ROW).alias("table_rows"), flag(X.EQUATION).alias("equations"), flag(X.VARIABLE).alias("variables"), flag(X.BULLET).alias("bullets"),
        F.sum(X.is_heading(F.col("line")).cast("long")).alias("headings"),
    )


H16_SQL = rf"""
WITH t AS (SELECT rc_id, unnest({sql_lines('chunk_text')}) AS line FROM retrieved_chunks WHERE chunk_text IS NOT NULL)
SELECT rc_id, count(*) AS lines, count(*) FILTER (regexp_matches(line, '{X.TABLE_ROW}')) AS table_rows, count(*) FILTER (regexp_matches(line, '{X.EQUATION}')) AS equations,
    count(*) FILTER (regexp_matches(line, '{X.VARIABLE}')) AS variables, count(*) FILTER (regexp_matches(line, '{X.BULLET}')) AS bullets,
    count(*) FILTER (length(trim(line)) BETWEEN 1 AND 200 AND NOT regexp_matches(trim(line), '{X.NOT_HEADING}') AND regexp_matches(trim(line), '{X.HEADING}')) AS headings
FROM t GROUP BY rc_id"""


def h21_chunk_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "retrieved_chunks", "rc_id", "chunk_text").select("rc_id", X.chunk_type(F.col("chunk_text")).alias("chunk_type"))


def sql_chunk_type(x: str) -> str:
    """SQL for the chunk type of a text."""
    n = f"len({sql_lines(x)})"
    count = lambda p: f"len(list_filter({sql_lines(x)}, lambda l: regexp_matches(l, '{p}')))"
    table_rows, eq, var, bullet = count(X.TABLE_ROW), count(X.EQUATION), count(X.VARIABLE), count(X.BULLET)
    return f"""CASE WHEN coalesce(length({x}), 0) = 0 THEN 'TEXT' WHEN {table_rows} > {n} * 0.4 THEN 'TABLE' WHEN {eq} > {n} * 0.3 THEN 'EQUATION' WHEN {var} > {n} * 0.2 THEN 'HYPERPARAMETERS'
        WHEN {bullet} > {n} * 0.4 THEN 'ALGORITHM' WHEN {table_rows} > 0 OR {eq} > 0 OR {var} > 0 THEN 'MIXED' ELSE 'TEXT' END"""


H21_SQL = f"SELECT rc_id, {sql_chunk_type('chunk_text')} AS chunk_type FROM retrieved_chunks"


def h22_content_hashes(spark: SparkSession, d: str) -> DataFrame:
    c = F.coalesce("content", F.lit(""))
    return table(spark, d, "chunker").select("item_id", F.sha2(c, 256).alias("sha"), F.sha2(F.concat(c, F.coalesce("file_path", F.lit("")), F.coalesce("repository", F.lit(""))), 256).alias("scoped_sha"), F.md5(c).alias("md5"))


H22_SQL = "SELECT item_id, sha256(coalesce(content, '')) AS sha, sha256(coalesce(content, '') || coalesce(file_path, '') || coalesce(repository, '')) AS scoped_sha, md5(coalesce(content, '')) AS md5 FROM chunker"


def h23_point_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "retrieved_chunks", "chunk_hash").filter("chunk_hash IS NOT NULL").distinct().select("chunk_hash", X.uuid5_dns(F.col("chunk_hash")).alias("point_id"))


H23_SQL = """
WITH h AS (SELECT DISTINCT chunk_hash, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_hash)) AS h FROM retrieved_chunks WHERE chunk_hash IS NOT NULL)
SELECT chunk_hash, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substring('89ab', CAST(('0x' || h[17:17]) AS INTEGER) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM h"""


def h26_scores(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("cross_encoder_score")
    t = table(spark, d, "expanded_evidence", "ev_id", "cross_encoder_score", "similarity").filter(s.isNotNull() & ~F.isnan(s))
    return t.select("ev_id", F.round(1 / (1 + F.exp(-s)), 6).alias("sigmoid"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("similarity", F.lit(0.0)))) * 100, 4).alias("percent"))


H26_SQL = """
SELECT ev_id, round(1 / (1 + exp(-cross_encoder_score)), 6) AS sigmoid, round(greatest(0.0, least(1.0, coalesce(similarity, 0.0))) * 100, 4) AS percent
FROM expanded_evidence WHERE cross_encoder_score IS NOT NULL AND NOT isnan(cross_encoder_score)"""


def h28_matching_numbers(spark: SparkSession, d: str) -> DataFrame:
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(X.NUMBER), F.lit(0)), lambda x: x.cast("double"))
    r = table(spark, d, "run_results", "result_id", "answer", "expected").filter("answer IS NOT NULL AND expected IS NOT NULL").select("result_id", numbers("expected").alias("e"), numbers("answer").alias("a"))
    close = lambda x: F.exists("a", lambda y: F.abs(x - y) <= F.greatest(F.abs(x) * 0.01, F.lit(1e-4)))
    return r.select("result_id", F.size("e").alias("expected_numbers"), F.size(F.filter("e", close)).alias("matched"))


H28_SQL = r"""
WITH n AS (SELECT result_id, list_transform(regexp_extract_all(expected, '[0-9]+\.?[0-9]*'), lambda x: CAST(x AS DOUBLE)) AS e,
    list_transform(regexp_extract_all(answer, '[0-9]+\.?[0-9]*'), lambda x: CAST(x AS DOUBLE)) AS a FROM run_results WHERE answer IS NOT NULL AND expected IS NOT NULL)
SELECT result_id, len(e) AS expected_numbers, len(list_filter(e, lambda x: len(list_filter(a, lambda y: abs(x - y) <= greatest(abs(x) * 0.01, 1e-4))) > 0)) AS matched FROM n"""


def h30_years(spark: SparkSession, d: str) -> DataFrame:
    y = F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), r"\b((?:19|20)[0-9]{2})\b", 1), F.lit(""))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.coalesce(y, F.lit("unknown")).alias("published"))


H30_SQL = r"SELECT doc_id, coalesce(nullif(regexp_extract(coalesce(text, ''), '\b((?:19|20)[0-9]{2})\b', 1), ''), 'unknown') AS published FROM documents"


def h33_row_digests(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("result_id", "question", "expected", "answer")]
    return table(spark, d, "run_results").select("result_id", F.sha2(F.concat_ws("\x1f", *parts), 256).alias("digest"))


H33_SQL = "SELECT result_id, sha256(CAST(result_id AS VARCHAR) || chr(31) || coalesce(question, '') || chr(31) || coalesce(expected, '') || chr(31) || coalesce(answer, '')) AS digest FROM run_results"

QUERIES = {
    "a5_language": (a5_language, A5_SQL),
    "h1_token_count": (h1_token_count, rf"SELECT doc_id, coalesce(len(regexp_extract_all(text, '{_TOKEN_SQL}')), 0) AS tokens FROM documents"),
    "h2_token_estimate": (h2_token_estimate, H2_SQL),
    "h3_term_counts": (h3_term_counts, H3_SQL),
    "h4_normalised_answer": (h4_normalised_answer, H4_SQL),
    "h5_normalised_path": (h5_normalised_path, H5_SQL),
    "h8_file_names": (h8_file_names, H8_SQL),
    "h9_sentences": (h9_sentences, H9_SQL),
    "h10_excerpts": (h10_excerpts, H10_SQL),
    "h11_citations": (h11_citations, H11_SQL),
    "h12_sources_json": (h12_sources_json, H12_SQL),
    "h13_references": (h13_references, H13_SQL),
    "h14_markdown_rows": (h14_markdown_rows, H14_SQL),
    "h15_numbers": (h15_numbers, H15_SQL),
    "h16_line_classes": (h16_line_classes, H16_SQL),
    "h21_chunk_types": (h21_chunk_types, H21_SQL),
    "h22_content_hashes": (h22_content_hashes, H22_SQL),
    "h23_point_ids": (h23_point_ids, H23_SQL),
    "h26_scores": (h26_scores, H26_SQL),
    "h28_matching_numbers": (h28_matching_numbers, H28_SQL),
    "h30_years": (h30_years, H30_SQL),
    "h33_row_digests": (h33_row_digests, H33_SQL),
}
