"""Queries that class failures, score runs and follow progress, by rules whose thresholds are fixed values."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import statistics as S
from granary.sources.tables import table

_ZERO = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
#: Words of sections that hold no evidence. Fixed values.
INVALID_SECTIONS = ["references", "bibliography", "appendix", "supplementary", "code", "github"]


def c5_valid_sections(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of sections that are named and hold content."""
    bad = "|".join(INVALID_SECTIONS)
    return table(spark, d, "expanded_evidence", "ev_id", "section").filter((F.col("section") != "") & ~F.lower("section").rlike(bad)).select("ev_id", "section")


C5_SQL = "SELECT ev_id, section FROM expanded_evidence WHERE section <> '' AND NOT regexp_matches(lower(section), 'references|bibliography|appendix|supplementary|code|github')"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metrics")
    r = table(spark, d, "run_results", "result_id", "question_id", "expected", "answer", "metrics").filter("metrics IS NOT NULL")
    sim, ground, cover = 100 * _ZERO(m["semantic_similarity"]), _ZERO(m["grounding_score_percent"]), _ZERO(m["concept_coverage_percent"])
    e, a = X.long_words(F.coalesce("expected", F.lit(""))), X.long_words(F.coalesce("answer", F.lit("")))
    recall = F.when(F.size(e) == 0, 100.0).otherwise(100.0 * F.size(F.array_intersect(e, a)) / F.size(e))
    number = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(X.NUMBER), F.lit(0)))
    ne = number(F.col("expected"))
    right = F.when(F.size(ne) == 0, 100.0).otherwise(100.0 * F.size(F.array_intersect(ne, number(F.col("answer")))) / F.size(ne))
    return r.select("result_id", "question_id", sim.alias("sim"), ground.alias("ground"), cover.alias("cover"), recall.alias("recall"), right.alias("numbers"))


_SCORES_SQL = r"""
m AS (SELECT result_id, question_id, expected, answer, 100 * coalesce(CASE WHEN isnan(metrics.semantic_similarity) THEN 0 ELSE metrics.semantic_similarity END, 0) AS sim,
    coalesce(CASE WHEN isnan(metrics.grounding_score_percent) THEN 0 ELSE metrics.grounding_score_percent END, 0) AS ground, coalesce(CASE WHEN isnan(metrics.concept_coverage_percent) THEN 0 ELSE metrics.concept_coverage_percent END, 0) AS cover,
    list_distinct(list_filter(regexp_extract_all(lower(coalesce(expected, '')), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 4)) AS e, list_distinct(list_filter(regexp_extract_all(lower(coalesce(answer, '')), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 4)) AS a,
    list_distinct(regexp_extract_all(coalesce(expected, ''), '[0-9]+\.?[0-9]*')) AS ne, list_distinct(regexp_extract_all(coalesce(answer, ''), '[0-9]+\.?[0-9]*')) AS na FROM run_results WHERE metrics IS NOT NULL),
s AS (SELECT result_id, question_id, sim, ground, cover, CASE WHEN len(e) = 0 THEN 100.0 ELSE 100.0 * len(list_intersect(e, a)) / len(e) END AS recall, CASE WHEN len(ne) = 0 THEN 100.0 ELSE 100.0 * len(list_intersect(ne, na)) / len(ne) END AS numbers FROM m)"""


def r2_root_causes(spark: SparkSession, d: str) -> DataFrame:
    """Little covered by what was retrieved is a failure of retrieval, a poor answer from good evidence one of reasoning."""
    s = _scores(spark, d)
    return s.select("result_id", F.when(F.col("cover") < 30, "Retrieval").when(F.col("recall") < 40, "LLM Reasoning").otherwise("Unknown").alias("cause"))


R2_SQL = f"WITH {_SCORES_SQL} SELECT result_id, CASE WHEN cover < 30 THEN 'Retrieval' WHEN recall < 40 THEN 'LLM Reasoning' ELSE 'Unknown' END AS cause FROM s"


def _context(spark: SparkSession, d: str) -> DataFrame:
    """(question_id, quality, packed): of each question the share of chunks with a fair similarity, and of distinct texts, in percent."""
    c = table(spark, d, "retrieved_chunks", "question_id", "similarity", "chunk_hash").filter("question_id IS NOT NULL")
    fair = (F.coalesce("similarity", F.lit(0.0)) >= 0.3).cast("double")
    return c.groupBy("question_id").agg((100 * F.avg(fair)).alias("quality"), (100.0 * F.count_distinct("chunk_hash") / F.count(F.lit(1))).alias("packed"))


_CONTEXT_SQL = "c AS (SELECT question_id, 100 * avg(CASE WHEN coalesce(similarity, 0.0) >= 0.3 THEN 1.0 ELSE 0.0 END) AS quality, 100.0 * count(DISTINCT chunk_hash) / count(*) AS packed FROM retrieved_chunks WHERE question_id IS NOT NULL GROUP BY 1)"


def r3_failure_rules(spark: SparkSession, d: str) -> DataFrame:
    """Ten rules in order: the first that holds classes an answer and says how surely."""
    s = _scores(spark, d).join(_context(spark, d), "question_id", "left")
    s = s.withColumns({"quality": F.coalesce("quality", F.lit(0.0)), "packed": F.coalesce("packed", F.lit(0.0))})
    s = s.withColumn("overall", (F.col("sim") + F.col("ground") + F.col("recall") + F.col("numbers")) / 4)
    rules = [
        (F.col("overall") >= 80, "None", "High"), (F.col("ground") < 30, "LLM Reasoning", "High"), (F.col("ground") < 50, "LLM Reasoning", "Medium"), (F.col("sim") < 20, "LLM Reasoning", "High"), (F.col("sim") < 40, "LLM Extraction", "Medium"),
        (F.col("recall") < 30, "LLM Extraction", "Medium"), (F.col("quality") < 50, "Retrieval Issue", "High"), (F.col("packed") < 50, "Context Packing", "High"), (F.col("numbers") < 50, "LLM Extraction", "Medium"), (F.col("overall") < 50, "LLM Reasoning", "Medium"),
    ]
    first = F.coalesce(*[F.when(c, F.struct(F.lit(k).alias("failure"), F.lit(v).alias("confidence"))) for c, k, v in rules], F.struct(F.lit("LLM Reasoning").alias("failure"), F.lit("Low").alias("confidence")))
    return s.select("result_id", first.alias("f")).select("result_id", "f.*")


R3_SQL = f"""WITH {_SCORES_SQL}, {_CONTEXT_SQL},
t AS (SELECT s.*, coalesce(quality, 0.0) AS quality, coalesce(packed, 0.0) AS packed, (sim + ground + recall + numbers) / 4 AS overall FROM s LEFT JOIN c USING (question_id)),
f AS (SELECT result_id, CASE WHEN overall >= 80 THEN 'None|High' WHEN ground < 30 THEN 'LLM Reasoning|High' WHEN ground < 50 THEN 'LLM Reasoning|Medium' WHEN sim < 20 THEN 'LLM Reasoning|High' WHEN sim < 40 THEN 'LLM Extraction|Medium' WHEN recall < 30 THEN 'LLM Extraction|Medium'
    WHEN quality < 50 THEN 'Retrieval Issue|High' WHEN packed < 50 THEN 'Context Packing|High' WHEN numbers < 50 THEN 'LLM Extraction|Medium' WHEN overall < 50 THEN 'LLM Reasoning|Medium' ELSE 'LLM Reasoning|Low' END AS x FROM t)
SELECT result_id, split_part(x, '|', 1) AS failure, split_part(x, '|', 2) AS confidence FROM f"""


def r4_lost_where(spark: SparkSession, d: str) -> DataFrame:
    """Where an expected answer was lost: it stands in a retrieved chunk, only in the evidence of some question, or nowhere; or nothing was retrieved at all."""
    q = table(spark, d, "run_results", "question_id", "expected").filter("question_id IS NOT NULL AND length(trim(expected)) >= 4").groupBy("question_id").agg(F.lower(F.trim(F.min("expected"))).alias("core"))
    # the rarest way to look for a text in all chunks: by its sentences' digests
    parts = lambda c: F.explode(F.array_distinct(F.transform(X.sentences(F.lower(F.trim(c))), lambda x: F.md5(F.trim(x)))))
    asked = q.select("question_id", parts(F.col("core")).alias("h"))
    own = table(spark, d, "retrieved_chunks", "question_id", "chunk_text").filter("question_id IS NOT NULL")
    got = own.filter("chunk_text IS NOT NULL").select("question_id", parts(F.col("chunk_text")).alias("h")).distinct()
    held = asked.join(got, ["question_id", "h"]).select("question_id").distinct().withColumn("held", F.lit(True))
    every = table(spark, d, "expanded_evidence", "chunk_text").filter("chunk_text IS NOT NULL").select(parts(F.col("chunk_text")).alias("h")).distinct()
    known = asked.join(every, "h").select("question_id").distinct().withColumn("known", F.lit(True))
    some = own.select("question_id").distinct().withColumn("some", F.lit(True))
    out = q.join(held, "question_id", "left").join(known, "question_id", "left").join(some, "question_id", "left")
    cause = F.when(F.col("held"), "found").when(F.col("some").isNull(), "routing").when(F.col("known"), "ranking or packing").otherwise("parsing or chunking")
    return out.select("question_id", cause.alias("lost"))


R4_SQL = r"""
WITH q AS (SELECT question_id, lower(trim(min(expected))) AS core FROM run_results WHERE question_id IS NOT NULL AND length(trim(expected)) >= 4 GROUP BY 1),
a AS (SELECT DISTINCT question_id, trim(unnest(string_split(regexp_replace(core, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))) AS s FROM q),
own AS (SELECT DISTINCT question_id, trim(unnest(string_split(regexp_replace(lower(trim(chunk_text)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))) AS s FROM retrieved_chunks WHERE question_id IS NOT NULL AND chunk_text IS NOT NULL),
ev AS (SELECT DISTINCT trim(unnest(string_split(regexp_replace(lower(trim(chunk_text)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))) AS s FROM expanded_evidence WHERE chunk_text IS NOT NULL),
h AS (SELECT DISTINCT question_id FROM a JOIN own USING (question_id, s)), k AS (SELECT DISTINCT question_id FROM a JOIN ev USING (s)), o AS (SELECT DISTINCT question_id FROM retrieved_chunks WHERE question_id IS NOT NULL)
SELECT question_id, CASE WHEN question_id IN (FROM h) THEN 'found' WHEN question_id NOT IN (FROM o) THEN 'routing' WHEN question_id IN (FROM k) THEN 'ranking or packing' ELSE 'parsing or chunking' END AS lost FROM q"""


def r5_zero_scores(spark: SparkSession, d: str) -> DataFrame:
    """Answers without a word in common with the expected one: nothing was covered by retrieval, or it was not used."""
    s = _scores(spark, d).filter("recall = 0")
    return s.select("result_id", F.when(F.col("cover") == 0, "Retrieval Failure").otherwise("LLM Generation Failure / Hallucination").alias("category"))


R5_SQL = f"WITH {_SCORES_SQL} SELECT result_id, CASE WHEN cover = 0 THEN 'Retrieval Failure' ELSE 'LLM Generation Failure / Hallucination' END AS category FROM s WHERE recall = 0"


def r13_latency_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Of each user's day the values by kind of event, what no kind accounts for, and whether accounts and total agree within 2 %."""
    e = table(spark, d, "events", "user_id", "ts", "event_type", "value").withColumn("day", F.to_date("ts"))
    kinds = ["click", "error", "purchase", "view"]
    part = {k: F.sum(F.when(F.col("event_type") == k, F.col("value")).otherwise(0.0)) for k in kinds}
    g = e.groupBy("user_id", "day").agg(F.sum("value").alias("total"), *[c.alias(k) for k, c in part.items()])
    known = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    rest = F.greatest(F.lit(0.0), F.col("total") - known)
    off = F.abs(F.col("total") - (known + rest)) / F.greatest(F.lit(1.0), F.col("total")) * 100
    return g.select("user_id", "day", F.round("total", 4).alias("total"), *[F.round(k, 4).alias(f"{k}_value") for k in kinds], F.round(rest + 1e-9, 4).alias("uncategorised"), (F.round(off, 6) < 2.0).alias("sound"))


_KINDS = ("click", "error", "purchase", "view")
R13_SQL = f"""
WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS total, {', '.join(f"sum(CASE WHEN event_type = '{k}' THEN value ELSE 0.0 END) AS {k}" for k in _KINDS)} FROM events GROUP BY 1, 2),
r AS (SELECT *, {' + '.join(_KINDS)} AS known, greatest(0.0, total - ({' + '.join(_KINDS)})) AS rest FROM g)
SELECT user_id, day, round(total, 4) AS total, {', '.join(f'round({k}, 4) AS {k}_value' for k in _KINDS)}, round(rest + 1e-9, 4) AS uncategorised, round(abs(total - (known + rest)) / greatest(1.0, total) * 100, 6) < 2.0 AS sound FROM r"""


def s4_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far each collection is: chunks with a vector of the small model among its distinct chunks, percent of the first stage, and vectors an hour."""
    c = table(spark, d, "retrieved_chunks", "repository", "chunk_hash").filter("repository IS NOT NULL AND chunk_hash IS NOT NULL").distinct()
    v = table(spark, d, "emb_cache", "chunk_hash", "model_name", "cached_at").filter("model_name = 'minilm-64' AND chunk_hash IS NOT NULL").groupBy("chunk_hash").agg(F.min("cached_at").alias("at"))
    g = c.join(v, "chunk_hash", "left").groupBy("repository").agg(F.count(F.lit(1)).alias("chunks"), F.count("at").alias("done"), F.min("at").alias("a"), F.max("at").alias("b"))
    hours = (F.unix_micros("b") - F.unix_micros("a")) / 3.6e9
    rate = F.when(hours > 0, F.col("done") / hours)
    pct = F.when(F.col("done") == F.col("chunks"), 100.0).otherwise(F.least(F.lit(99.0), 55.0 + 20.0 * F.col("done") / F.col("chunks")))
    eta = F.when(F.col("done") == F.col("chunks"), 0.0).otherwise(F.coalesce((F.col("chunks") - F.col("done")) / rate, F.lit(-1.0)))
    return g.select("repository", "chunks", "done", F.round(pct, 4).alias("percent"), F.round(rate, 6).alias("rate"), F.round(eta, 4).alias("eta_hours"))


S4_SQL = """
WITH c AS (SELECT DISTINCT repository, chunk_hash FROM retrieved_chunks WHERE repository IS NOT NULL AND chunk_hash IS NOT NULL),
v AS (SELECT chunk_hash, min(cached_at) AS t FROM emb_cache WHERE model_name = 'minilm-64' AND chunk_hash IS NOT NULL GROUP BY 1),
g AS (SELECT repository, count(*) AS chunks, count(t) AS done, (epoch_us(max(t)) - epoch_us(min(t))) / 3.6e9 AS hours FROM c LEFT JOIN v USING (chunk_hash) GROUP BY 1),
r AS (SELECT *, CASE WHEN hours > 0 THEN done / hours END AS rate FROM g)
SELECT repository, chunks, done, round(CASE WHEN done = chunks THEN 100.0 ELSE least(99.0, 55.0 + 20.0 * done / chunks) END, 4) AS percent, round(rate, 6) AS rate,
    round(CASE WHEN done = chunks THEN 0.0 ELSE coalesce((chunks - done) / rate, -1.0) END, 4) AS eta_hours FROM r"""


def _against(spark: SparkSession, d: str) -> DataFrame:
    """(run_name, n, m, s, z): mean paired difference of each run with the mean over all runs of the same question, and its z."""
    m = F.nanvl(F.col("metrics.semantic_similarity"), F.lit(None).cast("double"))
    r = table(spark, d, "run_results", "question_id", "run_name", "metrics").select("question_id", "run_name", m.alias("x")).filter("question_id IS NOT NULL AND run_name IS NOT NULL AND x IS NOT NULL")
    base = r.groupBy("question_id").agg(F.avg("x").alias("b"))
    g = r.join(base, "question_id").groupBy("run_name").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x") - F.col("b")).alias("m"), F.stddev_samp(F.col("x") - F.col("b")).alias("s"))
    return g.filter("n > 2 AND s > 1e-9").select("run_name", "n", "m", "s", (F.col("m") / (F.col("s") / F.sqrt("n"))).alias("z"))


_AGAINST_SQL = """
r AS (SELECT question_id, run_name, metrics.semantic_similarity AS x FROM run_results WHERE question_id IS NOT NULL AND run_name IS NOT NULL AND metrics.semantic_similarity IS NOT NULL AND NOT isnan(metrics.semantic_similarity)),
b AS (SELECT question_id, avg(x) AS b FROM r GROUP BY 1),
a AS (SELECT run_name, count(*) AS n, avg(x - b) AS m, stddev_samp(x - b) AS s FROM r JOIN b USING (question_id) GROUP BY 1),
z AS (SELECT run_name, n, m, s, m / (s / sqrt(n)) AS z FROM a WHERE n > 2 AND s > 1e-9)"""
_P_SQL = "least(1.0, ({}) * exp(-x * x))".format(" + ".join(f"{c} * pow(1 / (1 + 0.3275911 * x), {i + 1})" for i, c in enumerate(S.ERF)))


def st3_corrected_p(spark: SparkSession, d: str) -> DataFrame:
    """Runs against the mean of all: p, p corrected for their number, and a mark at 0.05."""
    z = _against(spark, d).withColumn("p", S.two_sided_p(F.col("z")))
    n = z.agg(F.count(F.lit(1)).alias("runs"))
    z = z.crossJoin(F.broadcast(n)).withColumn("corrected", F.least(F.lit(1.0), F.col("p") * F.col("runs")))  # one row
    return z.select("run_name", F.round("p", 6).alias("p"), F.round("corrected", 6).alias("corrected"), (F.round("corrected", 6) < 0.05).alias("significant"))


ST3_SQL = f"""WITH {_AGAINST_SQL}, p AS (SELECT run_name, {_P_SQL} AS p FROM (SELECT *, abs(z) / sqrt(2) AS x FROM z)), c AS (SELECT *, least(1.0, p * (SELECT count(*) FROM p)) AS c FROM p)
SELECT run_name, round(p, 6) AS p, round(c, 6) AS corrected, round(c, 6) < 0.05 AS significant FROM c"""


def st6_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of each run against the mean of all: answers, mean difference with its normal interval, effect size and corrected significance."""
    half = 1.96 * F.col("s") / F.sqrt("n")
    s = _against(spark, d).select("run_name", "n", F.round("m", 6).alias("mean"), F.round(F.col("m") - half, 6).alias("low"), F.round(F.col("m") + half, 6).alias("high"), F.round(F.col("m") / F.col("s"), 6).alias("effect"))
    return s.join(st3_corrected_p(spark, d).select("run_name", "significant"), "run_name")


ST6_SQL = f"""WITH {_AGAINST_SQL}, p AS (SELECT run_name, {_P_SQL} AS p FROM (SELECT *, abs(z) / sqrt(2) AS x FROM z)), c AS (SELECT run_name, least(1.0, p * (SELECT count(*) FROM p)) AS c FROM p)
SELECT run_name, n, round(m, 6) AS mean, round(m - 1.96 * s / sqrt(n), 6) AS low, round(m + 1.96 * s / sqrt(n), 6) AS high, round(m / s, 6) AS effect, round(c, 6) < 0.05 AS significant FROM z JOIN c USING (run_name)"""
#: The level of a test of seven comparisons, and its two-sided normal quantile.
_ALPHA = 0.0071
_QUANTILE = NormalDist().inv_cdf(1 - _ALPHA / 2)


def st7_power(spark: SparkSession, d: str) -> DataFrame:
    """The power of each run's comparison by its effect size: the normal probability of d sqrt(n / 2) less the quantile of the level."""
    z = _against(spark, d).withColumn("d", F.abs("m") / F.col("s"))
    beta = F.col("d") * F.sqrt(F.col("n") / 2) - _QUANTILE
    tail = S.two_sided_p(beta) / 2
    power = F.when(beta > 0, 1 - tail).otherwise(tail)
    return z.select("run_name", "n", F.round("d", 6).alias("effect"), F.round(power, 5).alias("power"), (F.round(power, 5) < 0.8).alias("underpowered"))


ST7_SQL = f"""WITH {_AGAINST_SQL}, e AS (SELECT run_name, n, abs(m) / s AS d, abs(m) / s * sqrt(n / 2) - {_QUANTILE!r} AS beta FROM z),
t AS (SELECT *, {_P_SQL} / 2 AS tail FROM (SELECT *, abs(beta) / sqrt(2) AS x FROM e)), w AS (SELECT *, CASE WHEN beta > 0 THEN 1 - tail ELSE tail END AS w FROM t)
SELECT run_name, n, round(d, 6) AS effect, round(w, 5) AS power, round(w, 5) < 0.8 AS underpowered FROM w"""


def o15_context_use(spark: SparkSession, d: str) -> DataFrame:
    """The share of a question's chunks that its answers cite by number, as ``[3]`` or ``Excerpt 3``."""
    n = table(spark, d, "retrieved_chunks", "question_id").filter("question_id IS NOT NULL").groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    r = table(spark, d, "run_results", "result_id", "question_id", "answer").filter("question_id IS NOT NULL AND answer IS NOT NULL").join(n, "question_id")
    cited = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"(?:\[|Excerpt )([0-9]{1,6})"), F.lit(1)), lambda x: x.cast("int")))
    used = F.size(F.filter(cited, lambda x: (x >= 1) & (x <= F.col("n"))))
    return r.select("result_id", used.alias("cited"), F.round(used / F.col("n"), 6).alias("use"))


O15_SQL = r"""
WITH n AS (SELECT question_id, count(*) AS n FROM retrieved_chunks WHERE question_id IS NOT NULL GROUP BY 1),
r AS (SELECT result_id, n, list_distinct(list_transform(regexp_extract_all(answer, '(?:\[|Excerpt )([0-9]{1,6})', 1), lambda x: CAST(x AS INTEGER))) AS c FROM run_results JOIN n USING (question_id) WHERE answer IS NOT NULL)
SELECT result_id, len(list_filter(c, lambda x: x >= 1 AND x <= n)) AS cited, round(len(list_filter(c, lambda x: x >= 1 AND x <= n)) / n, 6) AS use FROM r"""

QUERIES = {
    "c5_valid_sections": (c5_valid_sections, C5_SQL),
    "r2_root_causes": (r2_root_causes, R2_SQL),
    "r3_failure_rules": (r3_failure_rules, R3_SQL),
    "r4_lost_where": (r4_lost_where, R4_SQL),
    "r5_zero_scores": (r5_zero_scores, R5_SQL),
    "r13_latency_accounts": (r13_latency_accounts, R13_SQL),
    "s4_progress": (s4_progress, S4_SQL),
    "st3_corrected_p": (st3_corrected_p, ST3_SQL),
    "st6_run_summary": (st6_run_summary, ST6_SQL),
    "st7_power": (st7_power, ST7_SQL),
    "o15_context_use": (o15_context_use, O15_SQL),
}
