"""Cutting files and documents into sections, blocks and token-budget windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.functions.tokens import TOKEN

_LINE_END = re.compile(r"\r\n|\r|\n")
_CLASSES = [re.compile(p) for p in (X.TABLE_ROW, X.EQUATION, X.VARIABLE, X.BULLET)]


def text_lines(text: str) -> list[str]:
    """The lines of a text; a last empty line isn't one."""
    out = _LINE_END.split(text)
    return out[:-1] if out and out[-1] == "" and len(out) > 1 else out


def pack(sizes: list[int], budget: int, overlap: int) -> list[tuple[int, int]]:
    """Windows [start, end) of units whose sizes add up to at most ``budget``, each beginning within ``overlap`` of the last one's end.

    A unit over the budget is a window of its own; every window begins after the last one. Two pointers, so linear in windows and units.
    """
    out, start, n = [], 0, len(sizes)
    while start < n:
        end, total = start, 0
        while end < n and (end == start or total + sizes[end] <= budget):
            total += sizes[end]
            end += 1
        out.append((start, end))
        if end >= n:
            break
        back, shared = end, 0
        while back - 1 > start and shared + sizes[back - 1] <= overlap:
            back -= 1
            shared += sizes[back]
        start = back
    return out


def structural_blocks(ls: list[str]) -> list[tuple[int, int]]:
    """Runs [start, end) of lines of one class (table, equation, setting, bullet, in this order); any other line is alone."""
    out, i, n = [], 0, len(ls)
    while i < n:
        kind = next((p for p in _CLASSES if p.search(ls[i])), None)
        j = i + 1
        while kind is not None and j < n and kind.search(ls[j]):
            j += 1
        out.append((i, j))
        i = j
    return out


def windows(df: DataFrame, key: str, text: str, budget: int, overlap: int, by_blocks: bool) -> DataFrame:
    """(key, window, first_line, last_line, tokens): token-budget windows over lines, or over structural blocks, of every text.

    Lines are numbered from 1. Null texts give no row, an empty one a single window of no tokens; other columns aren't read.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"]):
                ls = text_lines(t)
                units = structural_blocks(ls) if by_blocks else [(i, i + 1) for i in range(len(ls))]
                sizes = [sum(len(TOKEN.findall(x)) for x in ls[s:e]) for s, e in units]
                rows += [(k, w, units[s][0] + 1, units[e - 1][1], sum(sizes[s:e])) for w, (s, e) in enumerate(pack(sizes, budget, overlap))]
            yield pd.DataFrame(rows, columns=["key", "window", "first_line", "last_line", "tokens"])

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter("t IS NOT NULL")
    return rows.mapInPandas(cut, f"key {df.schema[key].dataType.simpleString()}, window int, first_line int, last_line int, tokens int")


def sections(df: DataFrame, key: str, text: str, heading: Column | None = None) -> DataFrame:
    """(key, section, heading, first_line, last_line, chars): sections by heading lines, the lines before the first being ``Body``.

    A running count of headings numbers the sections; a text is one row's lines, so a window partition is no larger than a text.
    """
    ls = df.select(F.col(key).alias("key"), F.posexplode(X.lines(F.col(text))).alias("n", "line"))
    is_head = X.is_heading(F.col("line")) if heading is None else heading
    w = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ls = ls.withColumn("h", is_head.cast("int")).withColumn("section", F.sum("h").over(w))
    head = F.coalesce(F.max(F.when(F.col("h") == 1, F.trim("line"))), F.lit("Body"))
    return ls.groupBy("key", "section").agg(head.alias("heading"), (F.min("n") + 1).alias("first_line"), (F.max("n") + 1).alias("last_line"), F.sum(F.length("line")).alias("chars")).filter("chars > 0")
