"""Queries of claims, grounding, incremental upkeep and streams over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import answer_metrics as A
from granary.operators import incremental as N
from granary.sources.tables import table
from granary.streaming import windows as W

#: Phrases that introduce claims without being one. Fixed values.
GENERIC = ["the main contributions include", "the key points are", "here are the results", "as follows", "including", "such as", "these contributions aim to"]
#: Words of a comparison. Fixed values.
COMPARING = ["compared", "versus", "vs", "higher", "lower", "more", "less", "better", "worse"]


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of answers that claim something, long ones cut at semicolons or before a last clause, with their type."""
    r = table(spark, d, "run_results", "result_id", "answer").filter("answer IS NOT NULL")
    s = r.select("result_id", F.posexplode(X.sentences(F.regexp_replace("answer", r"(?m)^[0-9]+\.[ \t]+", ""))).alias("n", "s")).withColumn("s", F.trim("s"))
    short = (F.length("s") < 60) & X.any_of([F.contains(F.lower("s"), F.lit(g)) for g in GENERIC])
    s = s.filter((F.length("s") >= 15) & ~short & ~F.col("s").endswith(":") & F.col("s").rlike("[a-zA-Z]{3,}") & (F.col("s") != F.upper("s")))
    parts = F.when((F.length("s") > 100) & F.contains("s", F.lit(";")), F.filter(F.transform(F.split("s", ";"), F.trim), lambda p: F.length(p) >= 20))
    ands = F.transform(F.split("s", ", and "), F.trim)
    parts = parts.when((F.length("s") > 120) & F.contains("s", F.lit(", and ")) & F.forall(ands, lambda p: F.length(p) >= 20), ands).otherwise(F.array("s"))
    c = s.select("result_id", "n", F.posexplode(parts).alias("m", "claim"))
    compares = X.any_of([F.contains(F.lower("claim"), F.lit(w)) for w in COMPARING])
    kind = F.when(F.col("claim").rlike("[0-9]") & (F.length("claim") > 20), "numerical").when(compares, "comparative").otherwise("factual")
    i = F.row_number().over(Window.partitionBy("result_id").orderBy("n", "m"))
    return c.select("result_id", i.alias("position"), "claim", kind.alias("claim_type"))


_GEN = " OR ".join(f"contains(lower(s), '{g}')" for g in GENERIC)
_CMP = " OR ".join(f"contains(lower(claim), '{w}')" for w in COMPARING)
_CLAIMS = rf"""
r AS (SELECT result_id, string_split(regexp_replace(regexp_replace(answer, '(?m)^[0-9]+\.[ \t]+', '', 'g'), '([.!?])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM run_results WHERE answer IS NOT NULL),
s AS (SELECT result_id, unnest(range(len(p))) AS n, trim(unnest(p)) AS s FROM r),
f AS (SELECT result_id, n, CASE WHEN length(s) > 100 AND contains(s, ';') THEN list_filter(list_transform(string_split(s, ';'), lambda x: trim(x)), lambda x: length(x) >= 20)
        WHEN length(s) > 120 AND contains(s, ', and ') AND len(list_filter(string_split(s, ', and '), lambda x: length(trim(x)) < 20)) = 0 THEN list_transform(string_split(s, ', and '), lambda x: trim(x)) ELSE [s] END AS parts
    FROM s WHERE length(s) >= 15 AND NOT (length(s) < 60 AND ({_GEN})) AND NOT s LIKE '%:' AND regexp_matches(s, '[a-zA-Z]{{3,}}') AND s <> upper(s)),
e AS (SELECT result_id, n, unnest(range(len(parts))) AS m, unnest(parts) AS claim FROM f),
claims AS (SELECT result_id, row_number() OVER (PARTITION BY result_id ORDER BY n, m) AS position, claim,
    CASE WHEN regexp_matches(claim, '[0-9]') AND length(claim) > 20 THEN 'numerical' WHEN {_CMP} THEN 'comparative' ELSE 'factual' END AS claim_type FROM e)"""


def q1_claims(spark: SparkSession, d: str) -> DataFrame:
    return _claims(spark, d)


def q2_claim_ids(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d)
    return c.select("result_id", F.format_string("claim_%03d_%s", F.col("position"), F.substring(F.sha2("claim", 256), 1, 6)).alias("claim_id"))


def _fidelity(overlap: Column, bigrams: Column) -> Column:
    return F.when(bigrams == 0, "LLM Interpretation").when(overlap >= 0.75, "Direct Paper Claim").when(overlap >= 0.45, "Reasonable Inference").when(overlap >= 0.2, "LLM Interpretation").otherwise("Hallucinated Claim")


def _fidelities(spark: SparkSession, d: str) -> DataFrame:
    """Claims against the expected answer of their row, by shared word bigrams."""
    pairs = lambda c: A.bigrams(F.filter(X.words(c), lambda w: F.length(w) > 2))
    e = table(spark, d, "run_results", "result_id", "expected").select("result_id", pairs(F.coalesce("expected", F.lit(""))).alias("e"))
    c = _claims(spark, d).select("result_id", "position", pairs(F.col("claim")).alias("c")).join(e, "result_id")
    overlap = F.when(F.size("c") > 0, F.size(F.array_intersect("c", "e")) / F.size("c")).otherwise(0.0)
    return c.select("result_id", "position", F.round(overlap, 6).alias("overlap"), _fidelity(overlap, F.size("c")).alias("fidelity"))


def q5_fidelity(spark: SparkSession, d: str) -> DataFrame:
    return _fidelities(spark, d)


def _pairs_sql(x: str) -> str:
    w = rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 2)"
    return f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"


_FID = f"""
b AS (SELECT c.result_id, position, {_pairs_sql('claim')} AS c, {_pairs_sql("coalesce(expected, '')")} AS e FROM claims c JOIN run_results r ON r.result_id = c.result_id),
o AS (SELECT result_id, position, len(c) AS n, CASE WHEN len(c) > 0 THEN len(list_intersect(c, e)) / len(c) ELSE 0.0 END AS overlap FROM b),
fid AS (SELECT result_id, position, round(overlap, 6) AS overlap, CASE WHEN n = 0 THEN 'LLM Interpretation' WHEN overlap >= 0.75 THEN 'Direct Paper Claim' WHEN overlap >= 0.45 THEN 'Reasonable Inference' WHEN overlap >= 0.2 THEN 'LLM Interpretation' ELSE 'Hallucinated Claim' END AS fidelity FROM o)"""


def q6_grounding(spark: SparkSession, d: str) -> DataFrame:
    f = _fidelities(spark, d)
    n = lambda v: F.sum((F.col("fidelity") == v).cast("long"))
    g = f.groupBy("result_id").agg(F.count(F.lit(1)).alias("claims"), n("Direct Paper Claim").alias("s"), n("Reasonable Inference").alias("p"), n("Hallucinated Claim").alias("h"))
    return g.select("result_id", "claims", F.round((F.col("s") + 0.5 * F.col("p")) / F.col("claims") * 100, 4).alias("grounding"), F.round(F.col("h") / F.col("claims") * 100, 4).alias("hallucination"))


Q6_SQL = f"""WITH {_CLAIMS}, {_FID}
SELECT result_id, count(*) AS claims, round((count(*) FILTER (fidelity = 'Direct Paper Claim') + 0.5 * count(*) FILTER (fidelity = 'Reasonable Inference')) / count(*) * 100, 4) AS grounding,
    round(count(*) FILTER (fidelity = 'Hallucinated Claim') / count(*) * 100, 4) AS hallucination FROM fid GROUP BY 1"""


def q8_support(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk of the same question that holds a number of the expected answer."""
    r = table(spark, d, "run_results", "question_id", "expected").filter("question_id IS NOT NULL AND expected IS NOT NULL").select("question_id", F.explode(F.regexp_extract_all("expected", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0))).alias("number")).distinct()
    e = table(spark, d, "expanded_evidence", "question_id", "ev_id", "chunk_text").filter("question_id IS NOT NULL AND chunk_text IS NOT NULL")
    e = e.select("question_id", "ev_id", F.explode(F.array_distinct(F.regexp_extract_all("chunk_text", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0)))).alias("number"))
    return e.join(r, ["question_id", "number"]).groupBy("question_id", "number").agg(F.min("ev_id").alias("first_ev_id"), F.count(F.lit(1)).alias("n"))


Q8_SQL = r"""
WITH r AS (SELECT DISTINCT question_id, unnest(regexp_extract_all(expected, '[0-9]+\.[0-9]+')) AS number FROM run_results WHERE question_id IS NOT NULL),
e AS (SELECT question_id, ev_id, unnest(list_distinct(regexp_extract_all(chunk_text, '[0-9]+\.[0-9]+'))) AS number FROM expanded_evidence WHERE question_id IS NOT NULL)
SELECT question_id, number, min(ev_id) AS first_ev_id, count(*) AS n FROM e JOIN r USING (question_id, number) GROUP BY 1, 2"""

def s1_file_changes(spark: SparkSession, d: str) -> DataFrame:
    """Files of the first half of commits against those of all commits, by the digest of their last unit."""
    c = table(spark, d, "chunker", "item_id", "repository", "file_path", "content_hash", "committed_at").filter("repository IS NOT NULL AND file_path IS NOT NULL AND committed_at IS NOT NULL")
    mid = c.select(F.timestamp_micros(F.round(F.avg(F.unix_micros("committed_at")) / 1e9).cast("long") * 1_000_000_000).alias("mid"))
    c = c.crossJoin(F.broadcast(mid))  # one row
    last = lambda df: N.latest(df, ["repository", "file_path"], [F.desc("committed_at"), F.desc("item_id")])
    return N.difference(last(c.filter(F.col("committed_at") < F.col("mid"))), last(c), ["repository", "file_path"], "content_hash")


S1_SQL = """
WITH c AS (SELECT item_id, repository, file_path, content_hash, committed_at FROM chunker WHERE repository IS NOT NULL AND file_path IS NOT NULL AND committed_at IS NOT NULL),
m AS (SELECT make_timestamptz(CAST(round(avg(epoch_us(committed_at)) / 1e9) AS BIGINT) * 1000000000) AS mid FROM c),
o AS (SELECT * FROM c, m WHERE committed_at < mid QUALIFY row_number() OVER (PARTITION BY repository, file_path ORDER BY committed_at DESC, item_id DESC) = 1),
n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repository, file_path ORDER BY committed_at DESC, item_id DESC) = 1)
SELECT coalesce(o.repository, n.repository) AS repository, coalesce(o.file_path, n.file_path) AS file_path,
    CASE WHEN o.item_id IS NULL THEN 'added' WHEN n.item_id IS NULL THEN 'deleted' WHEN o.content_hash IS DISTINCT FROM n.content_hash THEN 'modified' ELSE 'unchanged' END AS status
FROM o FULL JOIN n ON o.repository = n.repository AND o.file_path = n.file_path"""


def s2_pending_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunk digests to embed: those without an entry of either model, with the models that are missing."""
    models = F.explode(F.array(F.lit("minilm-64"), F.lit("sect-96"))).alias("model_name")
    c = table(spark, d, "retrieved_chunks", "chunk_hash").filter("chunk_hash IS NOT NULL").distinct().select("chunk_hash", models)
    return c.join(table(spark, d, "emb_cache", "chunk_hash", "model_name"), ["chunk_hash", "model_name"], "left_anti")


S2_SQL = """
SELECT chunk_hash, model_name FROM (SELECT DISTINCT chunk_hash FROM retrieved_chunks WHERE chunk_hash IS NOT NULL), (SELECT unnest(['minilm-64', 'sect-96']) AS model_name)
EXCEPT SELECT chunk_hash, model_name FROM emb_cache"""


def b1_upserted_cache(spark: SparkSession, d: str) -> DataFrame:
    """The embedding cache after its rows were put in order of time: the last row of each (chunk, model)."""
    e = table(spark, d, "emb_cache", "emb_id", "chunk_hash", "model_name", "cached_at")
    return N.latest(e, ["chunk_hash", "model_name"], [F.desc_nulls_last("cached_at"), F.desc("emb_id")]).select("chunk_hash", "model_name", "emb_id")


B1_SQL = "SELECT chunk_hash, model_name, emb_id FROM emb_cache WHERE chunk_hash IS NOT NULL AND model_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_hash, model_name ORDER BY cached_at DESC NULLS LAST, emb_id DESC) = 1"


def b2_after_delete(spark: SparkSession, d: str) -> DataFrame:
    """Evidence without the chunks of papers that another table no longer lists."""
    gone = table(spark, d, "papers", "pdf_filename", "year").filter("year IS NULL").select("pdf_filename")
    return table(spark, d, "retrieved_chunks", "rc_id", "pdf_filename").join(gone, "pdf_filename", "left_anti").select("rc_id")


B2_SQL = "SELECT rc_id FROM retrieved_chunks c WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.pdf_filename = c.pdf_filename AND p.year IS NULL)"


def s5_sessions(spark: SparkSession, d: str) -> DataFrame:
    return N.sessions(table(spark, d, "events", "user_id", "ts"), "user_id", "ts", "6 hours")


S5_SQL = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, count(*) AS events FROM s GROUP BY user_id, s"""


def s6_latest_event(spark: SparkSession, d: str) -> DataFrame:
    """The last event of every user, folded batch by batch from a stream."""
    e = W.table_stream(spark, d, "events").filter("user_id IS NOT NULL").select("user_id", F.struct("ts", "event_id").alias("o"), "event_type")
    return W.latest_per_key(e, "user_id", "o", ["event_type"]).select("user_id", F.col("o.event_id").alias("event_id"), "event_type")


S6_SQL = "SELECT user_id, event_id, event_type FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def s7_remaining(spark: SparkSession, d: str) -> DataFrame:
    """Questions with evidence that have no result yet."""
    e = table(spark, d, "expanded_evidence", "question_id").filter("question_id IS NOT NULL").distinct()
    return e.join(table(spark, d, "run_results", "question_id"), "question_id", "left_anti")


S7_SQL = "SELECT DISTINCT question_id FROM expanded_evidence e WHERE question_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM run_results r WHERE r.question_id = e.question_id)"


def u1_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by type in windows of a day, from a stream with a watermark of ten minutes; windows that the watermark hasn't passed are left out."""
    e = W.table_stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = W.run_to_table(W.tumbling_counts(e, "ts", ["event_type"], "value", "1 day", "10 minutes"))
    return out.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


U1_SQL = """
SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events) GROUP BY 1, 2"""

QUERIES = {
    "q1_claims": (q1_claims, f"WITH {_CLAIMS} SELECT * FROM claims"),
    "q2_claim_ids": (q2_claim_ids, f"WITH {_CLAIMS} SELECT result_id, 'claim_' || lpad(CAST(position AS VARCHAR), 3, '0') || '_' || substring(sha256(claim), 1, 6) AS claim_id FROM claims"),
    "q5_fidelity": (q5_fidelity, f"WITH {_CLAIMS}, {_FID} SELECT * FROM fid"),
    "q6_grounding": (q6_grounding, Q6_SQL),
    "q8_support": (q8_support, Q8_SQL),
    "s1_file_changes": (s1_file_changes, S1_SQL),
    "s2_pending_chunks": (s2_pending_chunks, S2_SQL),
    "b1_upserted_cache": (b1_upserted_cache, B1_SQL),
    "b2_after_delete": (b2_after_delete, B2_SQL),
    "s5_sessions": (s5_sessions, S5_SQL),
    "s6_latest_event": (s6_latest_event, S6_SQL),
    "s7_remaining": (s7_remaining, S7_SQL),
    "u1_stream_windows": (u1_stream_windows, U1_SQL),
}
