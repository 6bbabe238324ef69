"""Queries of sectioning, chunking, code facts and the code graph over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import chunking as C
from granary.operators import code_lines as L
from granary.operators import graph as G
from granary.queries.text_functions import sql_lines
from granary.sources.tables import table


def i1_sections(spark: SparkSession, d: str) -> DataFrame:
    return C.sections(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").withColumnRenamed("key", "doc_id")


I1_SQL = rf"""
WITH l AS (SELECT doc_id, {sql_lines('text')} AS ls FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS line FROM l),
h AS (SELECT *, length(trim(line)) BETWEEN 1 AND 200 AND NOT regexp_matches(trim(line), '{X.NOT_HEADING}') AND regexp_matches(trim(line), '{X.HEADING}') AS h FROM n),
s AS (SELECT *, CAST(sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS section FROM h)
SELECT doc_id, section, coalesce(max(CASE WHEN h THEN trim(line) END), 'Body') AS heading, min(n) + 1 AS first_line, max(n) + 1 AS last_line, CAST(sum(length(line)) AS BIGINT) AS chars
FROM s GROUP BY 1, 2 HAVING sum(length(line)) > 0"""


def i3_block_windows(spark: SparkSession, d: str) -> DataFrame:
    return C.windows(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", 256, 32, by_blocks=True).withColumnRenamed("key", "doc_id")


def i4_line_windows(spark: SparkSession, d: str) -> DataFrame:
    return C.windows(table(spark, d, "chunker", "item_id", "content"), "item_id", "content", 128, 16, by_blocks=False).withColumnRenamed("key", "item_id")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return L.line_facts(table(spark, d, "chunker", "item_id", "content", "language"), "item_id", "content", "language")


def i7_code_facts(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).withColumnRenamed("key", "item_id")


_Q = lambda p: "'" + p.replace("'", "''") + "'"
_NAMES = lambda e: rf"list_filter(list_transform(string_split({e}, ','), lambda x: regexp_replace(trim(x), '\s+as\s+.*$', '')), lambda x: x <> '')"
_G = lambda p: f"regexp_extract(s, {_Q(p)}, 1)"
_FACTS = rf"""
fl AS (SELECT item_id, lower(language) = 'python' AS py, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS s FROM (SELECT item_id, language, {sql_lines('content')} AS ls FROM chunker WHERE content IS NOT NULL AND lower(language) IN ('python', 'javascript', 'typescript'))),
facts AS (
  SELECT item_id, line, 'import' AS fact, x AS name, x AS target FROM (SELECT item_id, line, unnest(CASE WHEN py AND regexp_matches(s, {_Q(L.FROM)}) THEN list_transform({_NAMES(_G(L.FROM_NAMES))}, lambda x: {_G(L.FROM)} || '.' || x)
      WHEN py AND regexp_matches(s, {_Q(L.IMPORT)}) THEN {_NAMES(_G(L.IMPORT))} WHEN NOT py THEN list_filter([{_G(L.JS_IMPORT)}, {_G(L.JS_REQUIRE)}], lambda x: x <> '') ELSE [] END) AS x FROM fl)
  UNION ALL SELECT item_id, line, 'class', {_G(L.CLASS)}, NULL FROM fl WHERE {_G(L.CLASS)} <> ''
  UNION ALL SELECT item_id, line, 'inherits', name, x FROM (SELECT item_id, line, {_G(L.CLASS)} AS name, unnest(CASE WHEN py THEN list_filter({_NAMES(_G(L.BASES))}, lambda x: NOT contains(x, '=')) ELSE list_filter([{_G(L.JS_BASE)}], lambda x: x <> '') END) AS x FROM fl)
  UNION ALL SELECT item_id, line, 'function', {_G(L.FUNCTION)}, NULL FROM fl WHERE {_G(L.FUNCTION)} <> ''
  UNION ALL SELECT item_id, line, 'call', NULL, x FROM (SELECT DISTINCT item_id, line, unnest(regexp_extract_all(s, {_Q(L.CALL)}, 1)) AS x FROM fl WHERE NOT regexp_matches(s, {_Q(L.DEFINES)})) WHERE x NOT IN ({', '.join(map(_Q, L.NO_CALLS))}))"""
I7_SQL = f"WITH {_FACTS} SELECT item_id, line, fact, name, target FROM facts"


def i8_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """What each window of 64 lines of a unit depends on."""
    c = table(spark, d, "chunker", "item_id", "content").filter("content IS NOT NULL").select(F.col("item_id").alias("key"), F.size(X.lines(F.col("content"))).alias("n"))
    w = c.select("key", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(56))).alias("piece")).select("key", "piece", (F.col("piece") + 1).alias("first_line"), (F.col("piece") + 64).alias("last_line"))
    return L.dependencies(_facts(spark, d), w).withColumnRenamed("key", "item_id")


I8_SQL = rf"""WITH {_FACTS}, w AS (SELECT item_id, unnest(range(0, len({sql_lines('content')}), 56)) AS piece FROM chunker WHERE content IS NOT NULL),
r AS (SELECT item_id, piece, target, CASE fact WHEN 'import' THEN 1 WHEN 'inherits' THEN 2 ELSE 3 END AS r FROM w JOIN facts USING (item_id) WHERE line BETWEEN piece + 1 AND piece + 64 AND fact IN ('import', 'inherits', 'call'))
SELECT item_id, piece, target, CASE min(r) WHEN 1 THEN 'imports' WHEN 2 THEN 'inherits' ELSE 'calls' END AS type FROM r GROUP BY 1, 2, 3"""


def i9_headers(spark: SparkSession, d: str) -> DataFrame:
    """The first lines of each unit that together hold at most 50 tokens."""
    ls = table(spark, d, "chunker", "item_id", "content").select("item_id", F.posexplode(X.lines(F.col("content"))).alias("n", "line"))
    run = F.sum(X.token_count(F.col("line"))).over(Window.partitionBy("item_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ls.withColumn("run", run).filter("run <= 50").groupBy("item_id").agg(F.count(F.lit(1)).alias("header_lines"), F.max("run").alias("header_tokens"))


I9_SQL = rf"""
WITH l AS (SELECT item_id, {sql_lines('content')} AS ls FROM chunker WHERE content IS NOT NULL),
n AS (SELECT item_id, unnest(range(len(ls))) AS n, unnest(ls) AS line FROM l),
r AS (SELECT item_id, sum(len(regexp_extract_all(line, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]'))) OVER (PARTITION BY item_id ORDER BY n) AS run FROM n)
SELECT item_id, count(*) AS header_lines, CAST(max(run) AS BIGINT) AS header_tokens FROM r WHERE run <= 50 GROUP BY 1"""


def i10_fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 64 lines, 56 apart; blank ones are skipped."""
    c = table(spark, d, "chunker", "item_id", "content").filter("content IS NOT NULL").select("item_id", X.lines(F.col("content")).alias("ls"))
    w = c.select("item_id", F.explode(F.sequence(F.lit(0), F.size("ls") - 1, F.lit(56))).alias("start"), "ls")
    w = w.select("item_id", "start", F.array_join(F.slice("ls", F.col("start") + 1, 64), "\n").alias("body")).filter(F.trim(F.regexp_replace("body", r"\s+", "")) != "")
    return w.select("item_id", "start", F.md5(F.concat_ws(":", F.col("item_id").cast("string"), F.col("start").cast("string"), "body")).alias("digest"))


I10_SQL = rf"""
WITH l AS (SELECT item_id, {sql_lines('content')} AS ls FROM chunker WHERE content IS NOT NULL),
w AS (SELECT item_id, unnest(range(0, len(ls), 56)) AS start, ls FROM l),
b AS (SELECT item_id, start, array_to_string(ls[start + 1:start + 64], chr(10)) AS body FROM w)
SELECT item_id, start, md5(CAST(item_id AS VARCHAR) || ':' || CAST(start AS VARCHAR) || ':' || body) AS digest FROM b WHERE regexp_replace(body, '[\s\x0b]+', '', 'g') <> ''"""


def i12_section_picks(spark: SparkSession, d: str) -> DataFrame:
    """For each paper and key word the first section on the earliest page whose name holds it."""
    keys = F.explode(F.array(*map(F.lit, ["introduction", "method", "result", "discussion"]))).alias("pick")
    c = table(spark, d, "retrieved_chunks", "rc_id", "pdf_filename", "section", "page").filter("pdf_filename IS NOT NULL AND section IS NOT NULL").select("*", keys)
    c = c.filter(F.contains(F.lower("section"), F.col("pick")))
    g = c.groupBy("pdf_filename", "pick").agg(F.min(F.struct(F.coalesce("page", F.lit(9999)).alias("page"), "section", "rc_id")).alias("s"))
    return g.select("pdf_filename", "pick", "s.section", "s.rc_id")


I12_SQL = """
WITH c AS (SELECT *, unnest(['introduction', 'method', 'result', 'discussion']) AS pick FROM retrieved_chunks WHERE pdf_filename IS NOT NULL AND section IS NOT NULL)
SELECT pdf_filename, pick, section, rc_id FROM c WHERE contains(lower(section), pick) QUALIFY row_number() OVER (PARTITION BY pdf_filename, pick ORDER BY coalesce(page, 9999), section, rc_id) = 1"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    units = table(spark, d, "chunker", "item_id", "file_path", "class_name", "function_name", "language")
    facts = _facts(spark, d)
    # a unit inherits what its own class does
    own = units.select(F.col("item_id").alias("key"), "class_name")
    facts = facts.join(own, "key").filter((F.col("fact") != "inherits") | (F.col("name") == F.col("class_name"))).drop("class_name")
    whole = units.select(F.col("item_id").alias("key"), F.lit(0).alias("piece"), F.lit(1).alias("first_line"), F.lit(2**30).alias("last_line"))
    needs = L.dependencies(facts, whole).select(F.col("key").alias("item_id"), "target", "type")
    return G.nodes_and_edges(units, "item_id", needs)


_GRAPH = f"""{_FACTS},
u AS (SELECT item_id AS o, file_path AS f, class_name AS c, CASE WHEN function_name IS NULL THEN NULL WHEN class_name IS NULL THEN function_name ELSE class_name || '.' || function_name END AS fn, coalesce(language, 'unknown') AS language FROM chunker WHERE file_path IS NOT NULL),
a AS (SELECT f AS id, 'File' AS type, language, o FROM u UNION ALL SELECT c, 'Class', language, o FROM u WHERE c IS NOT NULL UNION ALL SELECT fn, 'Function', language, o FROM u WHERE fn IS NOT NULL),
units AS (SELECT id, type, language FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY o DESC, type DESC, language DESC) = 1),
needs AS (SELECT o, coalesce(fn, c, f) AS src, target AS dst, CASE min(CASE fact WHEN 'import' THEN 1 WHEN 'inherits' THEN 2 ELSE 3 END) WHEN 1 THEN 'Imports' WHEN 2 THEN 'Inherits' ELSE 'Calls' END AS type
    FROM u JOIN facts ON o = item_id WHERE fact IN ('import', 'call') OR fact = 'inherits' AND name = c GROUP BY 1, 2, 3),
nodes AS (SELECT * FROM units UNION ALL SELECT dst, CASE type WHEN 'Imports' THEN 'Module' WHEN 'Inherits' THEN 'Class' ELSE 'Function' END, 'unknown' FROM needs WHERE dst <> '' AND dst NOT IN (SELECT id FROM units) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY o, type) = 1),
links AS (SELECT c AS src, f AS dst, 'Uses' AS type, o, 0 AS r FROM u WHERE c IS NOT NULL UNION ALL SELECT fn, f, 'Uses', o, 0 FROM u WHERE fn IS NOT NULL UNION ALL SELECT fn, c, 'Uses', o, 0 FROM u WHERE c IS NOT NULL AND fn IS NOT NULL
    UNION ALL SELECT src, dst, type, o, 1 FROM needs WHERE dst <> ''),
edges AS (SELECT src, dst, type FROM links QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY o DESC, r DESC, type DESC) = 1)"""


def j1_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[0]


def j2_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1]


def j3_expansion(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of every twentieth unit's file."""
    seeds = table(spark, d, "chunker", "item_id", "file_path").filter("item_id % 20 = 0 AND file_path IS NOT NULL").select("item_id", F.col("file_path").alias("id"))
    return G.neighbours(_graph(spark, d)[1], seeds, "item_id")


J3_SQL = f"""WITH {_GRAPH}, s AS (SELECT item_id, file_path AS id FROM chunker WHERE item_id % 20 = 0 AND file_path IS NOT NULL),
b AS (SELECT src AS id, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges)
SELECT DISTINCT s.item_id, b.other AS id FROM s JOIN b USING (id) WHERE (s.item_id, b.other) NOT IN (SELECT item_id, id FROM s)"""


def j4_pruned_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return G.pruned(nodes, edges, (F.col("type") == "File") & (F.col("language") == "python"))[1]


J4_SQL = f"WITH {_GRAPH}, g AS (SELECT id FROM nodes WHERE type = 'File' AND language = 'python') SELECT src, dst, type FROM edges WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)"


def j5_users(spark: SparkSession, d: str) -> DataFrame:
    """Who calls, imports, inherits or uses each node: their number and the first twelve, by type of edge."""
    return G.first_callers(_graph(spark, d)[1], by_type=True)


J5_SQL = f"""WITH {_GRAPH}, r AS (SELECT dst, type, src, row_number() OVER (PARTITION BY dst, type ORDER BY src) AS r, count(*) OVER (PARTITION BY dst, type) AS n FROM edges)
SELECT dst, type, max(n) AS n, string_agg(src, ', ' ORDER BY src) AS callers FROM r WHERE r <= 12 GROUP BY dst, type"""


def j6_graph_counts(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    n = nodes.groupBy(F.concat(F.lit("node "), "type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(edges.groupBy(F.concat(F.lit("edge "), "type").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


J6_SQL = f"WITH {_GRAPH} SELECT 'node ' || type AS kind, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT 'edge ' || type, count(*) FROM edges GROUP BY 1"

QUERIES = {
    "i1_sections": (i1_sections, I1_SQL),
    "i3_block_windows": (i3_block_windows, None),
    "i4_line_windows": (i4_line_windows, None),
    "i7_code_facts": (i7_code_facts, I7_SQL),
    "i8_dependencies": (i8_dependencies, I8_SQL),
    "i9_headers": (i9_headers, I9_SQL),
    "i10_fixed_windows": (i10_fixed_windows, I10_SQL),
    "i12_section_picks": (i12_section_picks, I12_SQL),
    "j1_nodes": (j1_nodes, f"WITH {_GRAPH} SELECT id, type, language FROM nodes"),
    "j2_edges": (j2_edges, f"WITH {_GRAPH} SELECT src, dst, type FROM edges"),
    "j3_expansion": (j3_expansion, J3_SQL),
    "j4_pruned_edges": (j4_pruned_edges, J4_SQL),
    "j5_users": (j5_users, J5_SQL),
    "j6_graph_counts": (j6_graph_counts, J6_SQL),
}
