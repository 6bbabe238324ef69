"""Pages made of repeated keywords, links or product tags instead of sentences.

Every text is read as a sequence of terms. Four measures are taken in windows of terms:

* recurrence gaps: the gaps from a term to its last and next occurrence. Sentences hardly repeat a content word within a few words, stuffed text does;
* spread of gaps: a term whose gaps hardly differ, anywhere in the text, recurs unnaturally regularly (gaps of words in prose spread like their mean);
* positional autocorrelation: the share of positions at which the text repeats itself at one common lag, of any length, so that long keyword phrases are found, too;
* function words: lists of nouns have distinct terms but no function words at all. In languages without a word list (and before the language is known) a
  window that is formed into sentences is none, so prose in any language passes; unspaced scripts are cut into runs, of which those of kana or grammatical characters are function words.

Repetition of whole sentences isn't that of keywords. A word is spam if its window is regular in one of these senses, or it stands in a link line, a tag line or a noun list;
a page is spam if over half of its words are.

Many texts are judged at once, one after another in the same arrays: tokens are numbered by a memory, and every measure is taken over all terms together. Windows, gaps and lags end
where their text ends, so a text is labelled alike in any company.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.function_words import EVERY, FUNCTION_WORDS

#: Terms repeat closely if they do within so many positions.
REACH = 8
#: Lags over which a doubtful list is compared with itself.
LAGS = range(2, 9)
#: Half the window around a term.
HALF = 12
#: Texts of fewer words are near-empty, not spam, unless they hold so many links.
LEAST_WORDS = 20
LEAST_LINKS = 5

#: A term recurs regularly if its gaps, at least so many, spread by at most this share of their mean, which spans at most so many terms.
STEADY_GAPS = 3
STEADY_SPREAD = 0.35
STEADY_MEAN = 6 * HALF
#: A text is in a language with a word list if so many of its terms are function words of that one language.
KNOWN_SHARE = 0.12
#: Sentences have at most so many terms.
LONGEST = 60

#: Texts are judged together up to so many characters; a longer one is judged alone.
TOGETHER = 1 << 17
REASONS = ["", "repetition", "links", "tags", "nouns"]

_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
_KANA = re.compile("[\u3041-\u309f]")
#: Grammatical characters of Chinese. Fixed values.
_GRAMMATICAL = "的了是在不和有这這中为為以与與及或但就都也而之其被把对對从從到于於"
_RUNS = re.compile("[\u3041-\u309f]+|[\u30a0-\u30ff]+|[\u3400-\u9fff々]+|[^\\W\u3040-\u30ff\u3400-\u9fff]+")
_CHINESE = re.compile(f"[{_GRAMMATICAL}]|(?:(?![{_GRAMMATICAL}])[\u3400-\u9fff])+|[^\\W\u3400-\u9fff]+")

_LINK = re.compile(r"(?:https?|ftp)://|^www\.|^[^\W_][\w-]*(?:\.[^\W_][\w-]*)*\.[a-z]{2,}(?:[/:?)\],;]|$)", re.IGNORECASE)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_HTML = re.compile(r"</?[a-z][a-z0-9]*\b|(?<=[\"'])>", re.IGNORECASE)
_FENCE = re.compile(r"^\s*(?:```|~~~)")
#: An entry of a reference list: its year stands apart.
_REFERENCE = re.compile(r"[.,]\s(?:19|20)\d\d\.(?:\s|$)|\((?:19|20)\d\d\)[.,]")
_TAG_LINE = re.compile(r"^\s*[^\W\d_][\w -]{0,24}:\s")
_MARK = re.compile(r"[•·»›|#✓★]|[=\-–]>|→|⇒")
_NUMBER = re.compile(r"^[\d.,:%/+-]+$")


class _Span:
    """Where every position's text and window begin and end."""

    def __init__(self, start: np.ndarray, end: np.ndarray) -> None:
        self.texts, self.n = len(start), int(end[-1])
        self.text = np.repeat(np.arange(self.texts), end - start)
        self.i = np.arange(self.n)
        self.start, self.end = start[self.text], end[self.text]
        self.lo, self.hi = np.maximum(self.start, self.i - HALF), np.minimum(self.end, self.i + HALF + 1)
        self.size = self.hi - self.lo

    def total(self, x: np.ndarray) -> np.ndarray:
        """The sum of x in each position's window."""
        c = _running(x)
        return c[self.hi] - c[self.lo]


def _running(x: np.ndarray) -> np.ndarray:
    """Sums of all before each position, and of all."""
    c = np.zeros(len(x) + 1, dtype=np.int64)
    np.cumsum(x, out=c[1:])
    return c


def _distinct(counted: np.ndarray, gap: np.ndarray, span: _Span) -> np.ndarray:
    """The number of distinct counted terms within HALF of each position: a term counts where its last occurrence is out of the window."""
    i = np.nonzero(counted)[0]
    start, end = np.maximum(span.lo[i], i - gap[i] + HALF + 1), span.hi[i]
    some = start < span.end[i]
    steps = np.bincount(start[some], minlength=span.n + 1) - np.bincount(end[some], minlength=span.n + 1)
    return np.cumsum(steps)[: span.n]


def _autocorrelated(kind: np.ndarray, gap: np.ndarray, ahead: np.ndarray, stopped: np.ndarray, span: _Span) -> np.ndarray:
    """Positions in whose window the text comes for the third time or more at one common lag, of any length, at half of the positions, and what comes again isn't a sentence.

    A sentence has many function words in one period, or at least a few of them and a full stop.
    """
    i, n = span.i, span.n
    back, on = np.maximum(i - gap, 0), np.minimum(i + ahead, n - 1)
    lag = np.where((gap < n) & ((gap == ahead) | (gap[back] == gap)), gap, np.where((ahead < n) & (ahead[on] == ahead), ahead, 0))
    out = np.zeros(n, dtype=bool)
    some = np.nonzero((lag > REACH) & (kind != 3))[0]
    of = span.start[some] + lag[some]  # a lag of a text is shorter than it, so that this tells both
    often = np.bincount(of, minlength=1)[of] >= HALF // 2  # half a window never has one lag
    some, of = some[often], of[often]
    if not len(some):
        return out
    key = np.sort(of * (n + 1) + some)
    at = of * (n + 1)
    alike = np.searchsorted(key, at + span.hi[some] - 1, "right") - np.searchsorted(key, at + span.lo[some], "left")
    lag = lag[some]
    first = np.maximum(span.start[some], np.minimum(some - lag // 2, span.end[some] - lag))
    share = lambda x: ((c := _running(x))[first + lag] - c[first]) / lag
    words, numbers = share(kind == 1), share(kind == 3)
    out[some] = (alike >= 0.5 * span.size[some]) & (words <= np.where(share(stopped) > 0, 0.12, 0.3)) & (numbers <= 0.15)
    return span.total(out) >= 0.5 * span.size


def _steady(order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of terms whose gaps hardly spread: the standard deviation of all gaps of a term against their mean. Terms begin in ``order`` at ``first``."""
    n = len(order)
    out = np.zeros(n, dtype=bool)
    length = np.diff(first, append=n)
    first, length = first[length > STEADY_GAPS], length[length > STEADY_GAPS]
    if not len(first):
        return out
    count = length - 1
    at = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    position = order[at]
    step = np.diff(position, prepend=0)
    starts = np.cumsum(length) - length
    step[starts] = 0
    mean = np.add.reduceat(step, starts) / count
    spread = np.sqrt(np.maximum(0, np.add.reduceat(step * step, starts) / count - mean * mean))
    out[position] = np.repeat((spread <= STEADY_SPREAD * mean) & (mean <= STEADY_MEAN), length)
    return out


_LANGUAGES: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        _LANGUAGES.setdefault(_w, []).append(_lang)
#: The sets of languages that share a function word, the last for words of none (contractions, unspaced scripts), and their members.
_SETS = [*sorted({tuple(v) for v in _LANGUAGES.values()}), ("unspaced",)]
_SET_OF = {w: _SETS.index(tuple(v)) for w, v in _LANGUAGES.items()}
_MEMBERS = np.array([[lang in of for lang in (*FUNCTION_WORDS, "unspaced")] for of in _SETS], dtype=np.int64)


def _known_language(sets: np.ndarray, text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether enough terms of each text are function words of one language; ``sets`` has those of the function words, ``text`` their texts."""
    counts = np.bincount(text * len(_SETS) + sets, minlength=len(lengths) * len(_SETS)).reshape(-1, len(_SETS)) @ _MEMBERS
    return counts.max(axis=1) >= KNOWN_SHARE * lengths


def _in_sentences(stopped: np.ndarray, span: _Span) -> np.ndarray:
    """Positions inside sentences: 4 to LONGEST terms up to a stop."""
    stops = np.nonzero(stopped)[0]
    last = np.maximum(np.concatenate([[-1], stops[:-1]])[: len(stops)], span.start[stops] - 1)
    some = (stops - last >= 4) & (stops - last <= LONGEST)
    steps = np.bincount(last[some] + 1, minlength=span.n + 1) - np.bincount(stops[some] + 1, minlength=span.n + 1)
    return np.cumsum(steps)[: span.n] > 0


def _classify(tok: str) -> tuple[tuple[str, int], ...]:
    """The terms of a token with their kinds: 0 term, 1 function word, 2 link, 3 number."""
    core = _EDGE.sub("", tok).lower()
    if not core:
        return ()
    if _LINK.search(tok if "://" in tok else core):
        inner = [w for w in (_EDGE.sub("", x).lower() for x in tok.split("](", 1)[0].split()) if w] if "](" in tok else []
        return (*((w, 0) for w in inner), ("\x00link", 2))
    if _NUMBER.match(core):
        return ((core, 3),)
    if _UNSPACED.search(core):
        return tuple((r, int(bool(_KANA.match(r)) or r in _GRAMMATICAL)) for r in (_RUNS if _KANA.search(core) else _CHINESE).findall(core))
    return ((core, int(core in EVERY or ("'" in core or "’" in core) and re.split("['’]", core)[0] in EVERY)),)


class _Tokens(dict):
    """Numbers of tokens, remembered, with their terms, kinds and whether they end a sentence; a full memory is emptied before the next texts."""

    def __init__(self, limit: int = 200_000) -> None:
        super().__init__()
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.numbers: dict[str, int] = {}
        self.first, self.count, self.stop = array("q"), array("q"), array("b")  # of tokens
        self.term, self.kind = array("q"), array("b")  # of their terms, one after another
        self.sets = array("h")  # of distinct terms

    def __missing__(self, tok: str) -> int:
        items = _classify(tok)
        self.first.append(len(self.term))
        self.count.append(len(items))
        self.stop.append(tok[-1] in ".!?…。！？。")
        for term, kind in items:
            number = self.numbers.setdefault(term, len(self.numbers))
            if number == len(self.sets):
                self.sets.append(_SET_OF.get(term, len(_SETS) - 1))
            self.term.append(number)
            self.kind.append(kind)
        self[tok] = number = len(self)
        return number


_TOKENS = _Tokens()


def _read(text: str) -> tuple[list[str], list[bool], list[list[str]]]:
    """The lines of a text, whether they belong to a table or to code, and their tokens."""
    lines = text.splitlines()
    if not any(x in text for x in ("|", "<", "```", "~~~")):
        return lines, [False] * len(lines), list(map(str.split, lines))
    table: list[bool] = []
    tokens: list[list[str]] = []
    fenced = False
    for line in lines:
        if ("```" in line or "~~~" in line) and _FENCE.match(line):
            fenced = not fenced
            table.append(True)
            tokens.append([])
            continue
        table.append(fenced or (line.count("|") > 1 and line.lstrip().startswith("|")))
        tokens.append((_HTML.sub(" ", line) if "<" in line else line).split())
    return lines, table, tokens


def _lines(lines: list[str], table: np.ndarray, n: np.ndarray, links: np.ndarray, fw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(reasons, references) of lines by their numbers of terms, links and function words: links, tags, and entries of reference lists."""
    live = (n > 0) & ~table
    reference = np.zeros(len(lines), dtype=bool)
    for k in np.nonzero(live & (n >= 5))[0].tolist():
        line = lines[k]
        if ("19" in line or "20" in line) and _REFERENCE.search(line):
            reference[k] = True
    live &= ~reference
    linked = live & (links > 0) & ((fw <= 0.12 * n) | (n - links <= 3 * links) & (fw <= 0.2 * n))
    reason = np.where(linked, 2, 0).astype(np.int8)
    for k in np.nonzero(live & ~linked & (fw <= 0.04 * n))[0].tolist():
        marks = len(_MARK.findall(lines[k]))
        if marks >= 2 and marks >= 0.12 * n[k] or 3 <= n[k] <= 16 and _TAG_LINE.match(lines[k]):
            reason[k] = 3
    return reason, reference


def _labels(texts: list[str]) -> np.ndarray:
    """The number of words of every text by reason, in the order of REASONS."""
    if len(_TOKENS) > _TOKENS.limit:
        _TOKENS.forget()
    lines: list[str] = []
    tables: list[bool] = []
    split: list[list[str]] = []
    per_text = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        own, table, tokens = _read(text)
        lines += own
        tables += table
        split += tokens
        per_text[k] = len(own)
    tokens = np.fromiter(map(_TOKENS.__getitem__, chain.from_iterable(split)), dtype=np.int64)

    # terms of tokens, and the ends of lines and texts among them
    count = np.asarray(_TOKENS.count)[tokens]
    upto = _running(count)
    n = int(upto[-1])
    if n == 0:
        return np.zeros((len(texts), len(REASONS)), dtype=np.int64)
    items = np.repeat(np.asarray(_TOKENS.first)[tokens] - upto[:-1], count) + np.arange(n)
    codes, kind = np.asarray(_TOKENS.term)[items], np.asarray(_TOKENS.kind)[items]
    token_line = _running(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))
    line_edge, token_text = upto[token_line], token_line[_running(per_text)]
    edge = upto[token_text]
    span = _Span(edge[:-1], edge[1:])
    total, size = span.total, span.size
    ending = np.nonzero(np.asarray(_TOKENS.stop)[tokens])[0]
    at = upto[ending + 1] - 1
    stopped = np.zeros(n, dtype=bool)
    stopped[at[at >= edge[np.searchsorted(token_text, ending, "right") - 1]]] = True
    content, is_fw, number = kind == 0, kind == 1, kind == 3

    # recurrence gaps
    order = np.sort(codes << 32 | span.i)
    same = order[1:] >> 32 == order[:-1] >> 32
    order &= (1 << 32) - 1
    same &= span.text[order[1:]] == span.text[order[:-1]]
    step = np.diff(order)[same]
    gap = np.full(n, 2 * n + 4 * HALF)
    gap[order[1:][same]] = step
    ahead = np.full(n, 2 * n + 4 * HALF)
    ahead[order[:-1][same]] = step
    near = (np.minimum(gap, ahead) <= REACH) & content

    n_content, n_number = total(content), total(number)
    repeated = total(near) / np.maximum(1, n_content)
    fw_share = total(is_fw) / size
    distinct_fw = _distinct(is_fw, gap, span)
    listed = (size > HALF) & (distinct_fw <= 3) & (n_number <= 0.3 * size) & (fw_share <= 0.35)
    steady = _steady(order, np.concatenate([[0], np.nonzero(~same)[0] + 1])) & content
    steady = (total(steady) >= 0.62 * n_content) & (n_content >= 6) & (fw_share <= np.where(total(stopped) > 0, 0.12, 0.2)) & (n_number <= 0.15 * size)
    doubtable = np.bincount(span.text[listed | steady], minlength=span.texts) > 0
    words = np.nonzero(is_fw)[0]
    doubtable &= ~_known_language(np.asarray(_TOKENS.sets)[codes[words]], span.text[words], np.diff(edge))
    spoken = _in_sentences(stopped, span) & doubtable[span.text]
    listed, steady = listed & ~spoken, steady & ~spoken
    regular = (repeated >= 0.62) & (n_content >= 6) | steady | _autocorrelated(kind, gap, ahead, stopped, span) & ~spoken
    doubtful = np.nonzero(listed & (fw_share > 0.12) & (distinct_fw > 2))[0]
    if len(doubtful):
        # positional autocorrelation: the best single lag at which terms come again
        auto = np.zeros(len(doubtful), dtype=np.int64)
        for lag in LAGS:
            hit = np.zeros(n, dtype=bool)
            hit[lag:] = (codes[lag:] == codes[:-lag]) & (span.text[lag:] == span.text[:-lag]) & ~number[lag:]
            c = _running(hit)
            np.maximum(auto, c[span.hi[doubtful]] - c[span.lo[doubtful]], out=auto)
        listed[doubtful] = auto / size[doubtful] >= 0.2

    # lines: links, tags, and long lists of distinct nouns
    per_line = np.diff(line_edge)
    table = np.array(tables, dtype=bool)
    within = lambda x: np.diff(_running(x)[line_edge])
    of_line, reference = _lines(lines, table, per_line, within(kind == 2), within(is_fw))
    reason = np.repeat(of_line, per_line)
    free = ~np.repeat(table | reference, per_line)
    reason[(reason == 0) & listed & free] = 4
    reason[(reason == 0) & regular & free] = 1
    return np.bincount(span.text * len(REASONS) + reason, minlength=span.texts * len(REASONS)).reshape(-1, len(REASONS))


def word_labels(text: str) -> tuple[int, int, dict[str, int]]:
    """(words, spam words, spam words by reason) of a text."""
    counts = _labels([text])[0].tolist()
    return sum(counts), sum(counts[1:]), {r: c for r, c in zip(REASONS[1:], counts[1:]) if c}


def _together(texts: list[str]) -> Iterator[slice]:
    """Slices of the texts of up to TOGETHER characters, or of one text."""
    first, chars = 0, 0
    for k, text in enumerate(texts):
        if k > first and chars + len(text) > TOGETHER:
            yield slice(first, k)
            first, chars = k, 0
        chars += len(text)
    if texts:
        yield slice(first, len(texts))


def keyword_spam(df: DataFrame, doc_id: str, text: str, share: float = 0.5) -> DataFrame:
    """(doc_id, words, spam_words, reason): every document over ``share`` of whose words are keywords, links or tags.

    ``reason`` is the kind of most of its spam words. Null texts and texts under 20 words (and five links) give no row; repeated rows give
    repeated rows, an empty table an empty one; other columns aren't read. Whole texts are read, whatever their length.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            ids, texts = list(b["id"]), list(b["text"])
            for part in _together(texts):
                counts = _labels(texts[part])
                n, spam = counts.sum(axis=1), counts[:, 1:].sum(axis=1)
                found = (spam > share * n) & ((n >= LEAST_WORDS) | (counts[:, REASONS.index("links")] >= LEAST_LINKS))
                for k in np.nonzero(found)[0].tolist():
                    out.append((ids[part.start + k], int(n[k]), int(spam[k]), max(zip(counts[k, 1:].tolist(), REASONS[1:]))[1]))
            yield pd.DataFrame(out, columns=["doc_id", "words", "spam_words", "reason"])

    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    return rows.mapInPandas(judge, f"doc_id {kind}, words int, spam_words int, reason string")
