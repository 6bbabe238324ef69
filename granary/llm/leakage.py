"""Held-out evaluation passages inside training documents.

The word trigrams of all passages, normalised, form a broadcast hash table; each document's
trigrams are looked up in it, and where as many of a passage lie near each other as a leak can't do without, all that it shares with the
document are chained in order and, if that leaves doubt, the words aligned. A passage leaks if ``min_words`` of its words or more are kept, in order, in a span
with at most about one word in six changed, added or dropped. Rare and common trigrams count alike, so neither the size of the
test set nor its slicing changes the result; every span is reported.

The table holds at most ``GRAMS`` trigrams. A larger test set is scanned in slices of that
size, one pass over the documents for each, so what is broadcast is bounded and nothing is left out; test sets are thought to be of one or a few slices.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAMS = 2_000_000
N = 3
_DIVIDED = re.compile(r"(?<=[^\W\d_])[-‐¬\xad]\s*[\r\n]+\s*(?=[^\W\d_])|\xad[ \t]*")
_WORD = re.compile(r"[^\W_]+")
_LIGATURE = re.compile("[ﬀ-ﬆ]")


def normal_words(text: str | None) -> tuple[list[str], np.ndarray]:
    """Words without case, marks and line ends, divided ones rejoined, and where each starts and ends in ``text`` as given."""
    if not text:
        return [], np.zeros((0, 2), dtype=np.int64)
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    last = -1
    cuts = {m.start(): m.end() for m in _DIVIDED.finditer(text)} if ("\xad" in text or "\n" in text or "\r" in text) else {}
    for m in _WORD.finditer(text):
        w = m.group().lower()
        if last in cuts and cuts[last] == m.start():
            out[-1] += w
            spans[-1] = (spans[-1][0], m.end())
        else:
            out.append(w)
            spans.append((m.start(), m.end()))
        last = m.end()
    return _without_marks(text, out), np.array(spans, dtype=np.int64).reshape(-1, 2)


def words_alone(text: str) -> list[str]:
    """The words that :func:`normal_words` gives, without their places, in a fraction of its time."""
    if "\xad" in text or "\n" in text or "\r" in text:
        text = _DIVIDED.sub("", text)
    ws = _WORD.findall(text)
    return _without_marks(text, " ".join(ws).lower().split(" ")) if ws else []


def _without_marks(text: str, ws: list[str]) -> list[str]:
    if text.isascii():
        return ws
    return [w if w.isascii() else "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)) for w in ws]


def align(passage: list[str], doc: list[str]) -> list[tuple[int, int, int]]:
    """The best local alignment, as (matched passage words, passage words, document words) of each step; also (0, before in passage, before in doc) first.

    A match scores 1, a changed, added or dropped word -0.3, so that it goes on over errors; two passage words run together in the document,
    or one divided there, match at no cost.
    """
    n, m = len(passage), len(doc)
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    step: list[list[tuple[int, int, int] | None]] = [[None] * (m + 1) for _ in range(n + 1)]
    top, at = 0.0, (0, 0)
    for i in range(1, n + 1):
        p, p2 = passage[i - 1], passage[i - 2] + passage[i - 1] if i > 1 else None
        above, row, steps = score[i - 1], score[i], step[i]
        for j in range(1, m + 1):
            d = doc[j - 1]
            s, t = 0.0, None
            if p == d:
                s, t = above[j - 1] + 1, (1, 1, 1)
            elif above[j - 1] > 0.3:
                s, t = above[j - 1] - 0.3, (0, 1, 1)
            if j > 1 and len(d) < len(p) and doc[j - 2] + d == p and above[j - 2] + 1 > s:
                s, t = above[j - 2] + 1, (1, 1, 2)
            if p2 == d and score[i - 2][j - 1] + 2 > s:
                s, t = score[i - 2][j - 1] + 2, (2, 2, 1)
            if above[j] - 0.3 > s:
                s, t = above[j] - 0.3, (0, 1, 0)
            if row[j - 1] - 0.3 > s:
                s, t = row[j - 1] - 0.3, (0, 0, 1)
            row[j], steps[j] = s, t
            if s > top:
                top, at = s, (i, j)
    out = []
    i, j = at
    while (t := step[i][j]) is not None:
        out.append(t)
        i, j = i - t[1], j - t[2]
    return [(0, i, j), *reversed(out)]


class PassageIndex:
    """The trigrams of passages, as arrays: every trigram's places in every distinct passage, common and rare ones alike."""

    def __init__(self, passages: list[tuple[int, str]], min_words: int) -> None:
        known: dict[tuple[str, ...], int] = {}
        #: the items of each distinct passage
        self.items: list[list[int]] = []
        self.words: list[tuple[str, ...]] = []
        for item, text in passages:
            ws = tuple(normal_words(text)[0])
            if len(ws) < min_words:
                continue
            k = known.setdefault(ws, len(self.words))
            if k == len(self.words):
                self.words.append(ws)
                self.items.append([])
            if item not in self.items[k]:
                self.items[k].append(item)
        self.vocabulary: dict[str, int] = {}
        codes, passage, place = [np.array([], dtype=np.int64)], [], []
        for k, ws in enumerate(self.words):
            c = self._codes(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws], dtype=np.int64))
            codes.append(c), passage.append(np.full(len(c), k)), place.append(np.arange(len(c)))
        every = np.concatenate(codes)
        order = np.argsort(every, kind="stable")
        self.codes, self.first, self.times = np.unique(every[order], return_index=True, return_counts=True)
        self.passage = np.concatenate([np.array([], dtype=np.int64), *passage])[order].astype(np.int32)
        self.place = np.concatenate([np.array([], dtype=np.int64), *place])[order].astype(np.int32)

    @staticmethod
    def _codes(ids: np.ndarray) -> np.ndarray:
        """One number for each three consecutive word ids, -1 where one of them is unknown."""
        if len(ids) < N:
            return np.array([], dtype=np.int64)
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        return np.where((a < 0) | (b < 0) | (c < 0), -1, (a << 42) | (b << 21) | c)

    def hits(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, place in the document, place in the passage) of every shared trigram."""
        none = np.array([], dtype=np.int64)
        get = self.vocabulary.get
        codes = self._codes(np.fromiter((get(w, -1) for w in ws), dtype=np.int64, count=len(ws)))
        j = np.nonzero(codes >= 0)[0]
        if not len(j) or not len(self.codes):
            return none, none, none
        at = np.minimum(np.searchsorted(self.codes, codes[j]), len(self.codes) - 1)
        same = self.codes[at] == codes[j]
        j, at = j[same], at[same]
        n = self.times[at]
        rows = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.passage[rows], np.repeat(j, n), self.place[rows]

    def leaks(self, text: str | None, min_words: int, errors: float) -> list[tuple[int, int, int, int]]:
        """(item, matched words, start, end) of every span of ``text`` that leaks a passage of the item, in characters."""
        ws = words_alone(text) if text else []
        if len(ws) < least_trigrams(min_words, errors) + N - 1:
            return []
        k, j, i = self.hits(ws)
        need, reach = least_trigrams(min_words, errors), 2 * min_words
        if len(k) < need:
            return []
        order = np.lexsort((i, j, k))
        k, j, i = k[order], j[order], i[order]
        # places of a passage in the document, each once; enough of them near each other open a search
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (j[1:] != j[:-1])])
        pk, pj = k[new], j[new]
        if len(pk) < need:
            return []
        dense = (pk[need - 1 :] == pk[: len(pk) - need + 1]) & (pj[need - 1 :] - pj[: len(pj) - need + 1] <= reach)
        if not dense.any():
            return []
        out, spans = [], normal_words(text)[1]
        for p in np.unique(pk[: len(dense)][dense]).tolist():
            a, b = np.searchsorted(k, p, "left"), np.searchsorted(k, p, "right")
            for matched, start, end in self._spans(p, ws, j[a:b].tolist(), i[a:b].tolist(), min_words, errors):
                out += [(item, matched, int(spans[start][0]), int(spans[end - 1][1])) for item in self.items[p]]
        return out

    def _spans(self, p: int, ws: list[str], js: list[int], is_: list[int], min_words: int, errors: float) -> list[tuple[int, int, int]]:
        """(matched, start, end) in words of every span that leaks passage ``p``: the best chain, then what is left on both sides of it."""
        out, todo = [], [(js, is_, 0, len(ws))]
        need = least_trigrams(min_words, errors)
        while todo:
            js, is_, lo, hi = todo.pop()
            if len(js) < need:
                continue
            runs = _runs(js, is_)
            chain = _best_chain(runs)
            got = self._judge(p, ws, [runs[r] for r in chain], js, lo, hi, min_words, errors)
            if got:
                out.append(got)
                start, end = got[1], got[2]
            else:
                start, end = runs[chain[0]][1], runs[chain[-1]][1] + runs[chain[-1]][2]
            cut = bisect_right(js, start - N), bisect_left(js, end)
            todo.append((js[: cut[0]], is_[: cut[0]], lo, start))
            todo.append((js[cut[1] :], is_[cut[1] :], end, hi))
        return out

    def _judge(self, p: int, ws: list[str], chain: list[tuple[int, int, int]], js: list[int], lo: int, hi: int, min_words: int, errors: float) -> tuple[int, int, int] | None:
        """(matched, start, end) if a chain of runs holds enough of the passage; where runs leave doubt, the words around are aligned."""
        kept, wrong = [chain[0][2]], [0]
        for (pi, pj, pl), (i, j, length) in zip(chain, chain[1:]):
            gi, gj = i - pi - pl, j - pj - pl
            kept.append(length - max(0, -gi, -gj)), wrong.append(max(gi, gj, 0))
        best = None
        for a in range(len(chain)):
            m, e = 0, 0
            for b in range(a, len(chain)):
                m, e = m + kept[b], e + (wrong[b] if b > a else 0)
                if m >= min_words and e <= errors * (m + e) + 1e-9 and (best is None or m > best[0]):
                    best = (m, chain[a][1], chain[b][1] + chain[b][2])
        if best:
            return best
        (i, j, _), (pi, pj, pl) = chain[0], chain[-1]
        a, b = max(lo, j - min_words), min(hi, pj + pl + min_words)
        if bisect_left(js, b) - bisect_left(js, a) < least_trigrams(min_words, errors):
            return None
        pa, pb = max(0, i - min_words), min(len(self.words[p]), pi + pl + min_words)
        steps = align(list(self.words[p][pa:pb]), ws[a:b])
        at = a + steps[0][2]
        for x in range(1, len(steps)):
            m, e, own, there = 0, 0, 0, 0
            for y in range(x, len(steps) if steps[x][0] else x):
                m, e, own, there = m + steps[y][0], e + (steps[y][0] == 0), own + steps[y][1], there + steps[y][2]
                long = max(own, there)
                if steps[y][0] and m >= min_words and e <= errors * long + 1e-9 and (best is None or m > best[0]):
                    best = (m, at, at + there)
            at += steps[x][2]
        return best


def least_trigrams(min_words: int, errors: float) -> int:
    """So many trigrams at least are shared by a passage and a document that leaks it.

    m words kept, with e errors among them, stand in at most e + 1 runs, each of which holds all but two trigrams of its words.
    """
    most = errors / (1 - errors)  # errors for each word kept
    return max(1, min(m - (N - 1) * (int(most * m + 1e-9) + 1) for m in range(min_words, 2 * min_words)))


def _runs(js: list[int], is_: list[int]) -> list[tuple[int, int, int]]:
    """(start in the passage, start in the document, words) of shared trigrams that follow each other, by their start in the document."""
    runs: list[list[int]] = []
    last: dict[int, int] = {}  # diagonal -> its last run
    for j, i in zip(js, is_):
        at = last.get(j - i)
        if at is not None and runs[at][1] + runs[at][2] >= j + N - 1:
            runs[at][2] = j + N - runs[at][1]
        else:
            last[j - i] = len(runs)
            runs.append([i, j, N])
    return [(i, j, n) for i, j, n in runs]


def _best_chain(runs: list[tuple[int, int, int]]) -> list[int]:
    """The runs of the best chain in order on both sides: a word kept scores 1, one changed, added or dropped -2."""
    score, before = [], []
    most = 0.0
    for n, (i, j, length) in enumerate(runs):
        best, link = float(length), -1
        for m in range(n - 1, -1, -1):
            pi, pj, pl = runs[m]
            gi, gj = i - pi - pl, j - pj - pl
            if gi < -(N - 1) or gj < -(N - 1) or i <= pi or j <= pj:
                continue
            if 2 * max(gi, gj) >= score[m]:  # dearer than starting anew
                continue
            s = score[m] + length - max(0, -gi, -gj) - 2 * max(gi, gj, 0)
            if s > best:
                best, link = s, m
        score.append(best), before.append(link)
        most = max(most, best)
    at = score.index(most)
    chain = [at]
    while before[chain[-1]] >= 0:
        chain.append(before[chain[-1]])
    return chain[::-1]


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passages: list[str], min_words: int = 14, errors: float = 1 / 6) -> DataFrame:
    """(doc_id, item_id, matched, start, end): one row for every span of a document that holds a passage of an item, in characters.

    Null and short texts leak nothing, nor do null passages and passages under ``min_words`` words; repeated documents give repeated rows;
    empty tables give an empty one. Columns besides those named aren't read.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(f"`{item_id}`").alias("i"), *[F.col(f"`{p}`").alias(f"p{n}") for n, p in enumerate(passages)])
    kind = docs.schema[doc_id].dataType.simpleString()
    item_kind = items.schema[item_id].dataType.simpleString()
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")

    def scanned(part: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(PassageIndex(part, min_words))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = shared.value
            for b in batches:
                got = [(i, *x) for i, t in zip(b["id"], b["text"]) for x in index.leaks(t, min_words, errors)]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "matched", "start", "end"])

        return texts.mapInPandas(scan, f"doc_id {kind}, item_id {item_kind}, matched int, start int, end int")

    out, part, size = None, [], 0
    for r in rows.toLocalIterator():
        for t in r[1:]:
            if t:
                grams = t.count(" ") + t.count("\n") + 1
                if size + grams > GRAMS and part:
                    out, part, size = scanned(part) if out is None else out.unionByName(scanned(part)), [], 0
                part.append((r[0], t))
                size += grams
    return scanned(part) if out is None else out.unionByName(scanned(part))


def without_leaks(docs: DataFrame, doc_id: str, text: str, leaks: DataFrame) -> DataFrame:
    """(doc_id, leaked_items, removed_chars, clean_text) of every leaking document: its text without the leaked spans.

    ``doc_id`` must be unique in ``docs``. Spans that overlap are removed once; what is left on both sides is joined by a blank.
    """
    spans = leaks.groupBy("doc_id").agg(F.countDistinct("item_id").alias("leaked_items"), F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(spans, "doc_id")
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))

    def step(acc: F.Column, s: F.Column) -> F.Column:
        more = F.when(s["start"] > acc["at"], F.concat(acc["kept"], F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(" "))).otherwise(acc["kept"])
        return F.struct(more.alias("kept"), F.greatest(acc["at"], s["end"]).alias("at"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["kept"], F.substr(F.col("text"), acc["at"] + 1)))
    return rows.select("doc_id", "leaked_items", clean.alias("clean_text"), (F.length("text") - F.length(clean)).alias("removed_chars"))
