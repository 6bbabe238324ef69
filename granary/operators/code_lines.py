"""Facts of source code read from its lines: imports, classes with their bases, functions and calls.

A line is matched by a few patterns that Java's and RE2's dialects read alike, so facts are plain columns and their SQL says the same. What
spans several lines (a call's arguments, a bracketed import list) is read as far as its first line goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as X

#: Line patterns by language, with what is named in the first group. Fixed values.
IMPORT = r"^\s*import\s+([A-Za-z_][A-Za-z0-9_.]*(?:\s+as\s+[A-Za-z_][A-Za-z0-9_]*)?(?:\s*,\s*[A-Za-z_][A-Za-z0-9_.]*(?:\s+as\s+[A-Za-z_][A-Za-z0-9_]*)?)*)\s*;?\s*(?:#.*)?$"
FROM = r"^\s*from\s+([A-Za-z0-9_.]+)\s+import\s+"
FROM_NAMES = r"^\s*from\s+[A-Za-z0-9_.]+\s+import\s+\(?([^()#]+)"
JS_IMPORT = r"^\s*(?:import|export)\b.*\bfrom\s*['\"]([^'\"]+)['\"]"
JS_REQUIRE = r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)"
CLASS = r"^\s*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)"
BASES = r"^\s*class\s+[A-Za-z_][A-Za-z0-9_]*\s*\(([^)]*)\)"
JS_BASE = r"^\s*(?:export\s+)?(?:default\s+)?class\s+[A-Za-z_][A-Za-z0-9_]*\s+extends\s+([A-Za-z_][A-Za-z0-9_.]*)"
FUNCTION = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:def|function\*?)\s+([A-Za-z_][A-Za-z0-9_]*)"
CALL = r"([A-Za-z_][A-Za-z0-9_.]*)\("
DEFINES = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:def|class|function)\b|^\s*(?:#|//|\*|/\*)"
NO_CALLS = ["if", "for", "while", "return", "elif", "switch", "catch", "function", "and", "or", "not", "in", "with", "assert", "yield", "await", "print", "super"]
LANGUAGES = ["python", "javascript", "typescript"]


def _names(listed: Column) -> Column:
    """The names of a list between commas, without what they are called afterwards."""
    return F.filter(F.transform(F.split(listed, ","), lambda x: F.regexp_replace(F.trim(x), r"\s+as\s+.*$", "")), lambda x: x != "")


def line_facts(units: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """(key, line, fact, name, target): the facts of each unit's lines, counted from 1.

    ``fact`` is import (name and target are what is imported), class, inherits (of class ``name``, from ``target``), function or call (of ``target``); a name is null where a
    fact has none. Units in other languages than ``LANGUAGES`` and null texts give no row, a line as many as it has facts.
    """
    ls = units.filter(F.lower(F.col(language)).isin(LANGUAGES) & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(F.col(language)).alias("lang"), F.posexplode(X.lines(F.col(text))).alias("n", "s"))
    s, python = F.col("s"), F.col("lang") == "python"
    group = lambda p: F.regexp_extract(s, p, 1)
    none = F.array().cast("array<string>")
    fact = lambda kind, name, target: F.struct(F.lit(kind).alias("fact"), name.cast("string").alias("name"), target.cast("string").alias("target"))
    one = lambda c: F.when(c != "", F.array(c)).otherwise(none)
    module = F.concat(group(FROM), F.lit("."))
    imports = F.when(python & s.rlike(FROM), F.transform(_names(group(FROM_NAMES)), lambda x: F.concat(module, x))).when(python & s.rlike(IMPORT), _names(group(IMPORT)))
    imports = imports.when(~python, F.concat(one(group(JS_IMPORT)), one(group(JS_REQUIRE)))).otherwise(none)
    bases = F.when(python, F.filter(_names(group(BASES)), lambda x: ~x.contains("="))).otherwise(one(group(JS_BASE)))
    calls = F.when(s.rlike(DEFINES), none).otherwise(F.filter(F.array_distinct(F.regexp_extract_all(s, F.lit(CALL), F.lit(1))), lambda x: ~x.isin(NO_CALLS)))
    facts = F.concat(
        F.transform(imports, lambda x: fact("import", x, x)),
        F.transform(one(group(CLASS)), lambda x: fact("class", x, F.lit(None))),
        F.transform(bases, lambda x: fact("inherits", group(CLASS), x)),
        F.transform(one(group(FUNCTION)), lambda x: fact("function", x, F.lit(None))),
        F.transform(calls, lambda x: fact("call", F.lit(None), x)),
    )
    return ls.select("key", (F.col("n") + 1).alias("line"), F.explode(facts).alias("f")).select("key", "line", "f.*")


def dependencies(facts: DataFrame, pieces: DataFrame) -> DataFrame:
    """(key, piece, target, type): what each piece (key, piece, first_line, last_line) of a unit depends on.

    Facts are joined by unit and line range; each target counts once, as import before base class before call.
    """
    kinds = F.create_map(*[F.lit(x) for x in ("import", "imports", "inherits", "inherits", "call", "calls")])
    rank = F.when(F.col("fact") == "import", 1).when(F.col("fact") == "inherits", 2).otherwise(3)
    f = facts.filter(F.col("fact").isin("import", "inherits", "call")).select("key", "line", "target", rank.alias("r"), kinds[F.col("fact")].alias("type"))
    met = pieces.join(f, "key").filter((F.col("line") >= F.col("first_line")) & (F.col("line") <= F.col("last_line")))
    return met.groupBy("key", "piece", "target").agg(F.min_by("type", "r").alias("type"))
