"""Column expressions on text: normalising, counting, classifying lines.

Patterns are written in the common part of Java's and RE2's dialects, so that the same text serves queries and their SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.tokens import token_count

#: Line patterns. Fixed values.
TABLE_ROW = r"\t|[ \t\r\f]{3,}|^\s*\|"
EQUATION = r"\\[a-zA-Z]+\{|\$.*\$|^\s*[a-zA-Z_]\s*[=+\-*/]\s*[a-zA-Z0-9_]|^\s*\(?[0-9]+\)?\s*$|[Ee][Qq][Uu][Aa][Tt][Ii][Oo][Nn]\s*\([0-9]+\)|^\s*[∑∏∫]"
VARIABLE = r"^\s*[a-zA-Z_][a-zA-Z0-9_]*\s*[=:]\s*[-+]?[0-9]*\.?[0-9]+"
BULLET = r"^\s*[-*•0-9+.)]\s"
NUMBER = r"[0-9]+\.?[0-9]*"
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"([.!?])\s+"
#: Headings: keywords that begin one, what rules one out. Fixed values.
HEADING = r"(?i)^(abstract|introduction|related work|background|methodology|methods?|experimental? (setup|results?)?|results? (and discussion)?|discussion|conclusion|future work|acknowledgments?|references?|appendix|evaluation|approach|system (overview|design)?|implementation|dataset|training|analysis|limitations?|[0-9]+\.\s+[A-Z][a-z]+|[0-9]+\.[0-9]+\.?\s+[A-Z][a-z]+)"
NOT_HEADING = r"(?i)^(\[|\(|[0-9]+\.\s+[a-z]|[0-9]{4}|http|\|)|university|laboratory|department|school|college|institute|email|http|@|proceedings|ieee|acm|vol\.|no\.|tandon|key lab"
#: Sections of little value for answers. Fixed values.
LOW_VALUE = r"reference|bibliography|acknowledg"
#: Languages by file extension. Fixed values.
LANGUAGES = {
    "python": ["py", "pyw"], "javascript": ["js", "jsx", "mjs", "cjs"], "typescript": ["ts", "tsx", "mts", "cts"], "json": ["json"], "markdown": ["md"], "html": ["html", "htm"], "css": ["css"],
    "yaml": ["yaml", "yml"], "bash": ["sh", "bash"], "c": ["c", "h"], "cpp": ["cpp", "hpp", "cc"], "java": ["java"], "go": ["go"], "rust": ["rs"],
}


def lines(text: Column) -> Column:
    """The lines of a text, as Python's ``splitlines`` has them for the usual line ends; a last empty line isn't one."""
    return F.split(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n", -1)


def words(text: Column) -> Column:
    """Runs of Unicode letters, digits and underscores in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def long_words(text: Column, least: int = 4) -> Column:
    """The distinct words of at least ``least`` characters."""
    return F.array_distinct(F.filter(words(text), lambda w: F.length(w) >= least))


def blank_tokens(text: Column) -> Column:
    """Lower-cased tokens between blanks."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Sentences: cut after ``.``, ``!`` or ``?`` followed by blanks."""
    return F.split(F.regexp_replace(text, SENTENCE_END, "$1\x01"), "\x01")


def language_of(path: Column) -> Column:
    """The language of a file by its extension, ``unknown`` for others."""
    ext = F.regexp_extract(F.lower(path), r"\.([^./\\]*)$", 1)
    return F.coalesce(*[F.when(ext.isin(exts), F.lit(lang)) for lang, exts in LANGUAGES.items()], F.lit("unknown"))


def _matching(ls: Column, pattern: str) -> Column:
    return F.filter(ls, lambda x: x.rlike(pattern))


def chunk_type(text: Column) -> Column:
    """TABLE, EQUATION, HYPERPARAMETERS, ALGORITHM, MIXED or TEXT by the shares of the lines that look so."""
    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  # computes ``value`` once
    patterns = {"table": TABLE_ROW, "eq": EQUATION, "var": VARIABLE, "bullet": BULLET}

    def counts(ls: Column) -> Column:
        return F.struct(F.size(ls).alias("n"), *[F.size(_matching(ls, p)).alias(k) for k, p in patterns.items()])

    def kind(c: Column) -> Column:
        return (
            F.when(c["table"] > c["n"] * 0.4, "TABLE")
            .when(c["eq"] > c["n"] * 0.3, "EQUATION")
            .when(c["var"] > c["n"] * 0.2, "HYPERPARAMETERS")
            .when(c["bullet"] > c["n"] * 0.4, "ALGORITHM")
            .when((c["table"] > 0) | (c["eq"] > 0) | (c["var"] > 0), "MIXED")
            .otherwise("TEXT")
        )

    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "TEXT").otherwise(bind(bind(lines(text), counts), kind))


def is_heading(line: Column) -> Column:
    """Whether a line looks like a section heading by its words."""
    s = F.trim(line)
    return (F.length(s) > 0) & (F.length(s) <= 200) & ~s.rlike(NOT_HEADING) & s.rlike(HEADING)


def uuid5_dns(name: Column) -> Column:
    """The version 5 UUID of a name in the DNS namespace, built from its SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def citation(title: Column, file: Column, page: Column, page_end: Column | None = None) -> Column:
    """Title, else file, else a fixed name, with its page or pages."""
    name = F.coalesce(F.nullif(title, F.lit("")), F.nullif(file, F.lit("")), F.lit("Unknown Paper"))
    if page_end is not None:
        pages = F.when(page.isNull(), F.lit("Page unknown")).when(page_end.isNotNull() & (page_end != page), F.concat(F.lit("Pages "), page.cast("string"), F.lit("–"), page_end.cast("string")))
        return F.concat(name, F.lit(", "), pages.otherwise(F.concat(F.lit("Page "), page.cast("string"))))
    return F.concat(name, F.lit(", "), F.when(page.isNull(), F.lit("Page unknown")).otherwise(F.concat(F.lit("Page "), page.cast("string"))))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


__all__ = ["any_of", "blank_tokens", "chunk_type", "citation", "is_heading", "language_of", "lines", "long_words", "sentences", "token_count", "uuid5_dns", "words"]
