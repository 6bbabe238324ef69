"""Further summaries: throughput, status counts, means by kind of question, event properties, first failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.tables import table


def e6_throughput(spark: SparkSession, d: str) -> DataFrame:
    """Events an hour of each day and type, with the busiest hour."""
    e = table(spark, d, "events", "ts", "event_type").filter("ts IS NOT NULL")
    h = e.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy("event_type").agg(F.count(F.lit(1)).alias("hours"), F.round(F.avg("n"), 4).alias("mean"), F.max("n").alias("peak"), F.round(F.stddev_pop("n"), 4).alias("std"))


E6_SQL = """
SELECT event_type, count(*) AS hours, round(avg(n), 4) AS mean, max(n) AS peak, round(stddev_pop(n), 4) AS std
FROM (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""


def e9_status_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "expanded_evidence", "section", "verification_status")
    g = e.groupBy(F.coalesce("section", F.lit("none")).alias("section"), F.coalesce("verification_status", F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    total = g.groupBy("section").agg(F.sum("n").alias("total"))
    return g.join(total, "section").select("section", "status", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


E9_SQL = """
SELECT section, status, n, round(n / sum(n) OVER (PARTITION BY section), 6) AS share
FROM (SELECT coalesce(section, 'none') AS section, coalesce(verification_status, 'none') AS status, count(*) AS n FROM expanded_evidence GROUP BY 1, 2)"""


def e11_hop_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores of questions whose evidence comes from one paper, a few, or many."""
    e = table(spark, d, "expanded_evidence", "question_id", "pdf_filename", "similarity").filter("question_id IS NOT NULL")
    q = e.groupBy("question_id").agg(F.count_distinct("pdf_filename").alias("papers"), F.avg("similarity").alias("s"))
    kind = F.when(F.col("papers") <= 1, "single").when(F.col("papers") <= 5, "few").otherwise("many")
    return q.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("s"), 6).alias("mean"))


E11_SQL = """
SELECT CASE WHEN papers <= 1 THEN 'single' WHEN papers <= 5 THEN 'few' ELSE 'many' END AS kind, count(*) AS questions, round(avg(s), 6) AS mean
FROM (SELECT question_id, count(DISTINCT pdf_filename) AS papers, avg(similarity) AS s FROM expanded_evidence WHERE question_id IS NOT NULL GROUP BY 1) GROUP BY 1"""


def h31_event_properties(spark: SparkSession, d: str) -> DataFrame:
    """The sum of the numeric properties of events, by type; properties are JSON objects."""
    p = F.from_json("props", "map<string,double>")
    e = table(spark, d, "events", "event_type", "props").select("event_type", F.aggregate(F.map_values(p), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("s"))
    return e.groupBy("event_type").agg(F.count("s").alias("n"), F.round(F.sum("s"), 4).alias("total"))


H31_SQL = "SELECT event_type, count(props) AS n, round(sum(CAST(json_extract(props, '$.k') AS DOUBLE)), 4) AS total FROM events GROUP BY 1"


def r9_first_failure(spark: SparkSession, d: str) -> DataFrame:
    """The worst evidence of each question: unverified first, then by confidence."""
    e = table(spark, d, "expanded_evidence", "question_id", "ev_id", "verification_status", "verification_confidence").filter("question_id IS NOT NULL")
    s = F.struct(F.coalesce("verification_confidence", F.lit(-1.0)).alias("c"), F.col("ev_id"))
    return e.groupBy("question_id").agg(F.min(s).alias("s")).select("question_id", "s.ev_id", F.round("s.c", 6).alias("confidence"))


R9_SQL = """
SELECT question_id, ev_id, round(c, 6) AS confidence FROM (SELECT question_id, ev_id, coalesce(verification_confidence, -1.0) AS c FROM expanded_evidence WHERE question_id IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY c, ev_id) = 1"""

QUERIES = {
    "e6_throughput": (e6_throughput, E6_SQL),
    "e9_status_counts": (e9_status_counts, E9_SQL),
    "e11_hop_means": (e11_hop_means, E11_SQL),
    "h31_event_properties": (h31_event_properties, H31_SQL),
    "r9_first_failure": (r9_first_failure, R9_SQL),
}
