"""Metrics of a generated answer against an expected one, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import text as X


def normal_tokens(text: Column) -> Column:
    """Tokens without articles, case and ASCII punctuation."""
    clean = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(clean, r"\s+"), lambda w: ~w.isin("", "a", "an", "the"))


def token_f1(answer: Column, expected: Column) -> Column:
    """F1 of the token multisets; 1 if both are empty, 0 if one is."""
    common = F.aggregate(F.array_distinct(answer), F.lit(0), lambda s, w: s + F.least(F.size(F.filter(answer, lambda x: x == w)), F.size(F.filter(expected, lambda x: x == w))))
    p, r = common / F.size(answer), common / F.size(expected)
    both_empty = (F.size(answer) == 0) & (F.size(expected) == 0)
    return F.when(both_empty, 1.0).when((F.size(answer) == 0) | (F.size(expected) == 0) | (common == 0), 0.0).otherwise(2 * p * r / (p + r))


def token_grounding(answer: Column, expected: Column) -> Column:
    """Percent of the expected blank-separated tokens of over 3 characters that occur in the answer."""
    tokens = F.filter(X.blank_tokens(expected), lambda w: F.length(w) > 3)
    hits = F.size(F.filter(tokens, lambda w: F.contains(F.lower(answer), w)))
    return F.when(F.size(tokens) > 0, F.round(hits / F.size(tokens) * 100, 2)).otherwise(0.0)


def conciseness(answer: Column, expected: Column) -> Column:
    """100, 75 beyond one and a half times, 50 beyond twice the expected words."""
    a, e = F.size(X.blank_tokens(answer)), F.size(X.blank_tokens(expected))
    return F.when(a > 2 * e, 50.0).when(a > 1.5 * e, 75.0).otherwise(100.0)


def bigrams(ws: Column) -> Column:
    """The distinct pairs of neighbouring words, joined by a blank."""
    return F.array_distinct(F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))


def overall_score(m: dict[str, Column]) -> Column:
    """The weighted sum of metrics in percent less a tenth of hallucination, between 0 and 100."""
    #: Fixed values.
    weights = {"retrieval": 0.05, "context": 0.05, "grounding": 0.30, "semantic": 0.30, "numerical": 0.15, "completeness": 0.10, "conciseness": 0.05, "hallucination": -0.10}
    total = sum((m[k] * w for k, w in weights.items() if k in m), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


@F.pandas_udf(T.DoubleType())
def rouge_l(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """F1 of the longest common subsequence of two token arrays."""

    def lcs(a: list[str], b: list[str]) -> int:
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for answers, expected in batches:
        out = []
        for a, e in zip(answers, expected):
            a, e = ([] if a is None else list(a)), ([] if e is None else list(e))
            n = lcs(a, e)
            out.append(0.0 if not n else 2 * n / (len(a) + len(e)))
        yield pd.Series(out)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The share of characters in matching blocks of two texts in lower case."""
    from difflib import SequenceMatcher

    for a, b in batches:
        yield pd.Series([0.0 if x is None or y is None else SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b)])


def bleu(answer: Column, expected: Column, most: int = 4) -> Column:
    """BLEU up to ``most``-grams with one added to every count, of two token arrays; 0 of an empty one."""

    def grams(ws: Column, n: int) -> Column:
        return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(F.array().cast("array<string>"))

    def clipped(a: Column, e: Column) -> Column:
        return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, g: s + F.least(F.size(F.filter(a, lambda x: x == g)), F.size(F.filter(e, lambda x: x == g))))

    logs = F.lit(0.0)
    for n in range(1, most + 1):
        a = grams(answer, n)
        logs = logs + F.log((clipped(a, grams(expected, n)) + 1) / (F.size(a) + 1)) / most
    brevity = F.least(F.lit(0.0), 1 - F.size(expected) / F.size(answer))
    return F.when((F.size(answer) == 0) | (F.size(expected) == 0), 0.0).otherwise(F.exp(logs + brevity))
