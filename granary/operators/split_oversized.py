"""Cutting texts above a token limit into overlapping pieces at natural boundaries.

Recursive bisection: a run of tokens that is too long is cut at the strongest boundary near its
middle (blank line, heading or definition, line end, sentence end, clause end, blank, any token), the
halves are cut again while they exceed the limit less the overlap, and at
last each piece but the first is extended backwards by up to the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.tokens import TOKEN, token_count

#: The gap before a token is a boundary of the first kind, from strongest to weakest, that matches the text around it.
_BREAK = re.compile(r"(?:\r\n?|\n)[ \t]*(?:\r\n?|\n)")
_LINE = re.compile("[\\r\\n\\x0b\\x0c\\x85\\u2028\\u2029]")
_START = re.compile(r"#{1,6}\s|(?:async\s+)?def\s|class\s|function\s|func\s|fn\s|public\s|private\s|@\w|\d+(?:\.\d+)*\s+[^\W\d_]|[-*•]\s|```")
_SENTENCE = ".!?…。！？।؟"
_CLOSE = "\"'”’»)]}"
_CLAUSE = ",;:，；：、—–"
#: A boundary may lie this share of the run away from its middle.
NEAR = 0.25


def boundary_strengths(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each token the strength of the gap before it, 0 where tokens touch; the first token's is 0."""
    out = np.zeros(len(starts), dtype=np.int8)
    for i in range(1, len(starts)):
        a, b = ends[i - 1], starts[i]
        before = text[a - 1]
        if before in _CLOSE and a > 1 and text[a - 2] in _SENTENCE:
            before = text[a - 2]
        if a == b:
            out[i] = 2 if before in "。！？" else 0
            continue
        gap = text[a:b]
        if _LINE.search(gap):
            strong = _START.match(text, b)
            out[i] = 7 if _BREAK.search(gap) else 6 if strong else 5 if before in _SENTENCE else 4
        else:
            out[i] = 3 if before in _SENTENCE else 2 if before in _CLAUSE else 1
    return out


def cut_points(strength: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Token positions at which pieces begin, the first being 0; no run exceeds ``limit`` less ``overlap``."""
    size, n = limit - overlap, len(strength)
    out, todo = [0], [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= size:
            continue
        mid, reach = (a + b) // 2, max(1, int((b - a) * NEAR))
        lo, hi = max(a + 1, mid - reach), min(b - 1, mid + reach) + 1
        own = strength[lo:hi]
        best = np.nonzero(own == own.max())[0] + lo
        at = int(best[np.argmin(np.abs(best - mid))])
        out.append(at)
        todo += [(a, at), (at, b)]
    return sorted(out)


def overlap_start(strength: np.ndarray, at: int, overlap: int, least: int) -> int:
    """Where the piece that begins at ``at`` begins with its overlap: the strongest boundary among the ``overlap`` tokens before it."""
    lo = max(least, at - overlap)
    if lo >= at:
        return at
    own = strength[lo:at]
    return lo if own.max() <= 1 else lo + int(np.argmax(own >= min(own.max(), 3)))


def split_text(text: str, limit: int = 512, overlap: int = 64) -> list[tuple[int, int, int, int, int]]:
    """(start, own_start, end, tokens, shared tokens) of each piece in characters; own_start..end of all pieces rebuild the text."""
    spans = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    if len(spans) <= limit:
        return [(0, 0, len(text), len(spans), 0)]
    starts, ends = np.array([s for s, _ in spans]), np.array([e for _, e in spans])
    strength = boundary_strengths(text, starts, ends)
    at = cut_points(strength, limit, overlap)
    out = []
    for i, p in enumerate(at):
        until = at[i + 1] if i + 1 < len(at) else len(spans)
        begin = p if i == 0 else overlap_start(strength, p, overlap, at[i - 1])
        own = 0 if i == 0 else int(starts[p])
        end = len(text) if until == len(spans) else int(starts[until])
        out.append((0 if i == 0 else int(starts[begin]), own, end, until - begin, p - begin))
    return out


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 512, overlap: int = 64) -> DataFrame:
    """(key, piece, start, own_start, end, tokens, shared, content) of every text above ``limit`` tokens.

    Pieces are numbered from 0 and hold at most ``limit`` tokens; consecutive ones share up to ``overlap`` tokens. Offsets count
    characters; ``own_start`` is where the piece goes on after its overlap, so [own_start, end) of all pieces rebuild the text. Texts at or under
    the limit, null and blank ones give no row, repeated rows give repeated pieces, an empty table an empty one; other columns aren't read. Tokens are
    counted in the JVM, and only oversized texts go to Python workers.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be under the limit")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, *p, t[p[0] : p[2]]) for k, t in zip(b["key"], b["text"]) for i, p in enumerate(split_text(t, limit, overlap))]
            yield pd.DataFrame(rows, columns=["key", "piece", "start", "own_start", "end", "tokens", "shared", "content"])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    large = rows.filter((F.length("text") > limit) & (token_count(F.col("text")) > limit))
    kind = df.schema[key].dataType.simpleString()
    return large.mapInPandas(pieces, f"key {kind}, piece int, start int, own_start int, end int, tokens int, shared int, content string")
