"""Noise in text from scanned pages: found, named and repaired.

Two passes over the corpus. The first gathers its statistics: the texts that each word and hyphenated
compound occurs in; the lines at page edges, by paper, as skeletons in which letters that a recogniser confuses are one, so that fuzzy repetitions
agree; and how far the numbers at page edges are from the page. A page edge is one of the first or last two lines of a text, or a line
inside that breaks off a sentence. The second pass judges every text:

* running_header: a line at a page edge that repeats, but for misread letters and cut ends, the paper's title or authors, or a line at the edges of several pages
  of the paper or of several papers, or that is worded as a venue or draft notice;
* page_number: a line at a page edge, or the end of a header, that is a page number in one of the usual forms; a bare
  number must continue the paper's sequence of page numbers and stand outside a table;
* hyphenation: a word divided at a line end whose parts join to a corpus word, or don't both exist,
  while the compound with a hyphen isn't a corpus word;
* misread: at least three words that aren't corpus words but become one by undoing typical
  recognition errors (rn for m, 0 for o, cl for d, c for e and the like), which slips of a typist don't.

A corpus word stands in ``LEAST_TEXTS`` texts, however large the corpus is. The ``MAX_WORDS`` most frequent words are broadcast; if there are more,
each text's other words are looked up by joins, with the same result. Header lines are broadcast only after a check of their size.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.text import HEADING
from granary.plans.lineage import materialize
from granary.plans.skew import skew_join

#: A corpus word occurs in so many texts.
LEAST_TEXTS = 4
#: So many words are broadcast at most.
MAX_WORDS = 400_000
#: A line heads pages if it stands at the edges of so many pages of a paper, or of pages of so many papers.
HEADED_PAGES = 3
HEADED_PAPERS = 3
#: Page numbers may be off by a number that so many pages of a paper share, if most of its numbered pages do.
NUMBERED_PAGES = 3
#: Misread words that make a text misread.
MISREAD_WORDS = 3
#: A rare variant of a word that is so many times as frequent is a misreading of it.
FAR = 40
#: A word that is always capitalised is a corpus word, not a name, if it stands in so many texts.
CAPITALISED = 80
_FLUSH = 300_000
_BROADCAST_BYTES = 32 << 20

_HYPHENS = "-‐‑¬\xad"
_DIVIDED = re.compile(rf"([^\W\d_]+)([{_HYPHENS}])(\s*[\r\n]\s*|[ \t]+)([^\W\d_]+)")
_MAYBE_DIVIDED = re.compile(rf"[{_HYPHENS}]\s|[¬\xad]")
_SOFT = re.compile("[^\\W\\d_]\xad[^\\W\\d_]")
#: A word in lower case or with a capital, which counts apart, as names have no place in the vocabulary.
_LOWER = re.compile(r"(?<![\w-])[a-zß-öø-ÿA-Z][a-zß-öø-ÿ]*(?:-[a-zß-öø-ÿ]+)*(?![\w-])")
_SUSPENDED = frozenset("and or to und oder bis et ou à y o e u a ed".split())

_BARE = re.compile(r"^\d{1,4}$")
_NUMBERED = re.compile(r"^(?:[\[(]?\s*(?:page|pag\.?|pg\.?|p\.|seite|página|pagina)\s*(\d{1,4})(?:\s*(?:of|/|von|de|sur)\s*\d{1,4})?\s*[\])]?|[-–—~]\s*(\d{1,4})\s*[-–—~]|[|]\s*(\d{1,4})|(\d{1,4})\s*[|]|(\d{1,4})\s*/\s*\d{1,4})$", re.IGNORECASE)
_ROMAN = re.compile(r"^(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$", re.IGNORECASE)
_TAIL = re.compile(r"^(.*?\S)(?:\s{2,}|\t|\s+[|·•–—-]\s+)(\d{1,4})$|^(\d{1,4})(?:\s{2,}|\t|\s+[|·•–—-]\s+)(\S.*)$")
_CELL = re.compile(r"^[\d.,:%/+\s-]+$")
_ET_AL = re.compile(r"^[^\W\d_][\w.’'-]+(?:,? (?:and|&) [^\W\d_][\w.’'-]+)? ?et a[l1i]\.?,?$", re.IGNORECASE)
_TERMINAL = re.compile(r"[.!?:;…][\"'”’)\]]*$")
_HEADING = re.compile(r"^(?:#{1,6}\s|\d{1,2}(?:\.\d{1,2})*\.?\s+[^\W\d_]|[A-Z]\.\s+[A-Z])")
_LIST = re.compile(r"^\s*(?:[-*•+–—]\s|\(?\d{1,3}[.)]\s|\|)")
_VENUE = frozenset("proc proceedings workshop conference conf journal transactions trans symposium vol volume annals".split())
_DRAFT = frozenset("draft preprint manuscript report working submission".split())
_CAPTION = frozenset("table tab figure fig algorithm equation eq listing box scheme chart plate appendix".split())
_STATUS = frozenset("review reviewed version confidential distribute press circulation submitted revision".split())

#: What a recogniser reads, and what stands on the page. Fixed values.
CONFUSIONS: tuple[tuple[str, str], ...] = (
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("li", "h"), ("h", "li"), ("vv", "w"), ("nn", "m"), ("ri", "n"), ("lc", "k"), ("ﬁ", "ti"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬂ", "tl"),
    ("0", "o"), ("1", "l"), ("1", "i"), ("1", "t"), ("5", "s"), ("9", "g"), ("6", "b"), ("6", "g"), ("8", "b"), ("8", "s"), ("3", "e"), ("4", "a"), ("7", "t"), ("|", "l"), ("!", "l"), ("!", "i"), ("(", "c"), ("$", "s"), ("@", "a"),
    ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("u", "n"), ("n", "u"), ("o", "a"), ("a", "o"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("l", "t"), ("g", "q"), ("q", "g"), ("y", "v"), ("v", "y"), ("o", "c"), ("s", "5"),
    ("é", "e"), ("è", "e"), ("ê", "e"), ("á", "a"), ("à", "a"), ("ó", "o"), ("ò", "o"), ("í", "i"), ("ì", "i"), ("ú", "u"), ("ù", "u"), ("ö", "o"), ("ä", "a"), ("ü", "u"),
)
_RAW = re.compile(r"\S+")
#: A word set apart letter by letter.
_SPACED = re.compile(r"(?<![\w.])(?:[^\W\d_]\s){3,}[^\W\d_](?!\w)")
_TRIM = re.compile(r"^[\"'“‘\[{«*_]+|[\"'”’\]}»*_.,;:?…]+$")
_DIGIT_INSIDE = re.compile(r"[^\W\d_][01569|!($@][a-z]")
_CODE = re.compile(r"[/_.:#=<>]")
_AS_LETTERS = str.maketrans("01569|!($@", "olsbgllcsa")
_PUNCTUATION = "\"'“”‘’.,;:?…«»*"
_ODD = re.compile(r"[^\W\d_]+[0-9|!($@][^\W\d_]+|^[0-9|!($@][^\W\d_]{3,}|[^\W\d_]{3,}[01569]$")


def _undone(word: str) -> list[str]:
    """Every way to undo one recognition error in ``word``."""
    out = []
    for read, real in CONFUSIONS:
        at = word.find(read)
        while at >= 0:
            out.append(word[:at] + real + word[at + len(read) :])
            at = word.find(read, at + 1)
    return out


def candidates(word: str, times: int) -> Iterator[str]:
    """What ``word`` may have been misread from by one error, then by two."""
    once = _undone(word)
    yield from once
    if times > 1 and len(word) >= 6:
        for w in once:
            yield from _undone(w)


def letters(line: str) -> str:
    """The letters of a line in lower case: its key for fuzzy comparison."""
    return "".join(c for c in line.lower() if c.isalpha())


_SAME = [(("rn", "nn"), "m"), (("cl",), "d"), (("vv",), "w"), (("ii",), "u"), (("li",), "h"), (("ri",), "n"), (("lc",), "k")]
_CLASS = str.maketrans({c: group[0] for group in ("oceaq0346", "lift1!|7", "unv", "hbk", "gq9y", "s58z", "mw") for c in group})


def skeleton(line: str) -> str:
    """A line's key for fuzzy comparison: letters that are read for each other become one, and page numbers, marks and blanks go."""
    out = []
    for w in unicodedata.normalize("NFKD", line.lower()).split():
        if any(c.isalpha() for c in w):
            for many, one in _SAME:
                for x in many:
                    w = w.replace(x, one)
            out.append("".join(c for c in w.translate(_CLASS) if c.isalnum()))
    return "".join(out)


def numeral(s: str) -> int:
    """The value of a Roman numeral."""
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    v = [values[c] for c in s.lower()]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def _near(a: str, b: str, least: float) -> bool:
    if not a or not b or abs(len(a) - len(b)) > (1 - least) * (len(a) + len(b)):
        return a == b
    m = SequenceMatcher(None, a, b, False)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def _keyword(words: list[str], keys: frozenset[str]) -> int:
    return sum(any(w == k or len(k) > 4 and _near(w, k, 0.75) for k in keys) for w in words)


class Paper:
    """What headers of one paper may look like."""

    def __init__(self, title: str | None, authors: str | None, repeated: frozenset[str] = frozenset(), offsets: frozenset[int] = frozenset()) -> None:
        t = title or ""
        self.titles = [x for x in {letters(t), letters(t.split(":", 1)[-1])} if len(x) >= 8]
        names = [a.strip() for a in (authors or "").split(";") if a.strip()]
        self.authors = [letters(x) for x in (", ".join(names), " and ".join(names), *names) if len(letters(x)) >= 5]
        self.repeated = repeated
        #: what page numbers may be away from the page
        self.offsets = offsets | {0}

    def heads(self, line: str) -> int:
        """2 if a line, without its page number, is a header wherever it stands, 1 if it is one at a page edge, 0 if it is none.

        A page may end with a sentence, so that nothing but the line itself shows its edge; names and lines that are merely repeated need the edge.
        """
        if not 4 <= len(line) <= 120 or line[0].islower():
            return 0
        if _ET_AL.match(line):
            return 2
        split = line.split()
        caps = sum(w[0].isupper() for w in split) / len(split)
        if caps < 0.3 and len(split) > 8:
            return 0  # prose
        key = letters(line)
        words = [letters(w) for w in split]
        if caps >= 0.5 and (_near(words[0], "proc", 0.75) or _keyword(words[:1], _VENUE)) and _keyword(words, _VENUE) >= 2:
            return 2
        if len(words) <= 8 and _keyword(words[:3], _DRAFT) and _keyword(words, _STATUS):
            return 2
        if len(split) <= 16:
            # the title, whole or cut short, perhaps behind a name and a colon
            for own in {key, letters(line.split(":", 1)[-1])}:
                if len(own) >= 8 and any(t.startswith(own) and caps >= 0.3 or caps >= 0.4 and len(own) >= min(len(t), 12) and _near(own, t[: len(own)], 0.8) for t in self.titles):
                    return 2
            if len(key) >= 5 and caps >= 0.5 and any(_near(key, a, 0.85) for a in self.authors):
                return 1
        return int(bool(self.repeated) and may_repeat(line) and skeleton(line) in self.repeated)


def _lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def at_edge(lines: list[str], filled: list[int], k: int) -> bool:
    """Whether the ``k``-th filled line is one of the first or last two of its text or breaks off a sentence."""
    if k < 2 or k >= len(filled) - 2:
        return True
    before, after = lines[filled[k - 1]].strip(), lines[filled[k + 1]].strip()
    return not _TERMINAL.search(before) or after[0].islower()


def heading_words(line: str) -> bool:
    """Whether a line is a section heading by its number or words."""
    return bool(_HEADING.match(line) or line.startswith("#") or re.match(HEADING, line))


def may_repeat(line: str) -> bool:
    """Whether a line is formed like a header: capitalised, no sentence's end, section heading or caption."""
    caps = [w for w in line.split() if w[0].isalpha()]
    if not (len(line) >= 6 and line[0].isupper() and 2 <= len(caps) <= 13 and sum(w[0].isupper() for w in caps) >= 0.6 * len(caps)):
        return False
    return line[-1] not in ",;-.!?:" and letters(line.split()[0]) not in _CAPTION and not heading_words(line)


def bare_number(lines: list[str], filled: list[int], k: int, page: int | None, offsets: frozenset[int] | None) -> int | None:
    """The number on the ``k``-th filled line if it stands alone outside a table and, unless ``offsets`` is None, fits the page."""
    s = lines[filled[k]].strip()
    roman = _ROMAN.match(s)
    if not (_BARE.match(s) or roman):
        return None
    value = numeral(s) if roman else int(s)
    beside = [lines[filled[j]].strip() for j in (k - 1, k + 1) if 0 <= j < len(filled)]
    prose = [b for b in beside if len(b) > 30 or not _CELL.match(b) and (_TERMINAL.search(b) or len(b.split()) > 3)]
    cells = [b for b in beside if _CELL.match(b)]
    if page is None:
        return value if len(prose) == len(beside) == 2 and not _TERMINAL.search(beside[0]) else None
    if offsets is not None and value - page not in offsets:
        return None
    return value if not (cells and len(prose) < len(beside)) and prose or roman and offsets is not None else None


def margin_lines(lines: list[str], paper: Paper, page: int | None) -> dict[int, set[str]]:
    """The lines at page edges that are headers or page numbers, by number."""
    out: dict[int, set[str]] = {}
    filled = [i for i, x in enumerate(lines) if x.strip()]
    for k, i in enumerate(filled):
        s = lines[i].strip()
        if len(s) > 130:
            continue
        if len(s) <= 24 and any(c.isalnum() for c in s):
            m = _NUMBERED.match(s)
            if m:
                bar = m.group(3) or m.group(4) or m.group(5)
                if not bar or page is None or int(bar) - page in paper.offsets:
                    out[i] = {"page_number"}
                    continue
            if bare_number(lines, filled, k, page, paper.offsets) is not None:
                out[i] = {"page_number"}
                continue
        tail = _TAIL.match(s)
        body = s
        number = None
        if tail:
            body, number = (tail.group(1), tail.group(2)) if tail.group(1) else (tail.group(4), tail.group(3))
        if s.startswith("#") or _HEADING.match(s) and not number:
            continue
        weight = paper.heads(body)
        if weight == 2 or weight and (at_edge(lines, filled, k) or k and filled[k - 1] in out):
            out[i] = {"running_header"}
            if number and (page is None or int(number) - page in paper.offsets):
                out[i].add("page_number")
    return out


def edge_lines(text: str, page: int | None) -> tuple[list[str], list[int]]:
    """The lines at the page edges of a text that are formed like headers, without page numbers; and how far bare numbers there are from the page."""
    lines = _lines(text)
    filled = [i for i, x in enumerate(lines) if x.strip()]
    heads, numbers = [], []
    for k, i in enumerate(filled):
        x = lines[i].strip()
        if len(x) <= 4:
            value = None if page is None or x[0].isalpha() and not _ROMAN.match(x) or not at_edge(lines, filled, k) else bare_number(lines, filled, k, page, None)
            if value is not None:
                numbers.append(value - page)
        elif 6 <= len(x) <= 100 and (x[0].isupper() or x[0].isdigit()):
            tail = _TAIL.match(x)
            x = (tail.group(1) or tail.group(4)) if tail else x
            if may_repeat(x) and at_edge(lines, filled, k):
                heads.append(x)
    return heads, numbers


class _Words:
    """The broadcast words, and those that were looked up for the texts at hand."""

    def __init__(self, common: frozenset[str]) -> None:
        self.common = common
        self.more: set[str] = set()

    def __contains__(self, word: str) -> bool:
        return word in self.common or word in self.more


class Judge:
    """Judges and repairs texts with the corpus vocabulary."""

    def __init__(self, vocabulary: frozenset[str] | _Words) -> None:
        self.vocabulary = vocabulary
        self.remembered: dict[str, str | None] = {}
        self.tokens: dict[str, int] = {}

    def told(self, facts: list) -> None:
        """Learn (word, whether it is a corpus word, what it is by one error, by up to two) of words that weren't broadcast."""
        if len(self.vocabulary.more) + len(self.remembered) > 400_000:
            self.vocabulary.more.clear(), self.remembered.clear(), self.tokens.clear()
        for f in facts:
            if f["known"]:
                self.vocabulary.more.add(f["word"])
            else:
                self.remembered["1" + f["word"]], self.remembered[f["word"]] = f["one"], f["two"]

    def meant(self, word: str, times: int = 2) -> str | None:
        """The corpus word that ``word`` was misread from by up to ``times`` errors, if it isn't one itself."""
        if word in self.vocabulary:
            return None
        key = word if times > 1 else "1" + word
        if key in self.remembered:
            return self.remembered[key]
        if len(self.remembered) > 200_000:
            self.remembered.clear()
        found = next((w for w in candidates(word, times) if w in self.vocabulary), None)
        self.remembered[key] = found
        return found

    def suspicion(self, token: str) -> int:
        """1 if a token may be misread: it isn't a corpus word, number or plain name. Remembered by token."""
        known = self.tokens.get(token)
        if known is None:
            if len(self.tokens) > 200_000:
                self.tokens.clear()
            w = token.strip(_PUNCTUATION)
            if not w or w in self.vocabulary or not any(c.isalpha() for c in w):
                known = 0
            elif w[0].isupper() and w.isalpha() and w.isascii():
                known = int(w.lower() not in self.vocabulary and not w.isupper() and self.meant(w.lower(), 1) is not None)
            else:
                known = int(w.lower() not in self.vocabulary)
            self.tokens[token] = known
        return known

    def misread(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, meant) of misread words."""
        out = []
        vocabulary = self.vocabulary
        for m in _RAW.finditer(text):
            raw = m.group()
            if raw in vocabulary:
                continue
            w = _TRIM.sub("", raw)
            if w.count("(") != w.count(")") and w.endswith(")"):
                w = w[:-1]
            if w.startswith("(") and w[1:2].isalpha() and w[1:].lower() in vocabulary or len(w) < 3:
                continue
            low = w.lower()
            if low in vocabulary or not any(c.isalpha() for c in w):
                continue
            odd = bool(_ODD.search(w)) or not w.isascii()
            times = 2
            if w[0].isupper() and not odd:
                if w.isupper() or not _starts_sentence(text, m.start()):
                    continue  # a name
                times = 1
            if "-" in w and all(p in vocabulary for p in low.split("-") if p):
                continue
            meant = self.meant(low, times)
            if meant is None and odd and _DIGIT_INSIDE.search(w) and len(w) >= 6 and w[0].isalpha() and not _CODE.search(w):
                meant = low.translate(_AS_LETTERS)
            if meant is not None and meant != low:
                at = m.start() + raw.find(w)
                out.append((at, at + len(w), meant))
        for m in _SPACED.finditer(text):
            word = "".join(m.group().split()).lower()
            out.append((m.start(), m.end(), self.meant(word) or word))
        return sorted(out)

    def divided(self, a: str, hyphen: str, gap: str, b: str) -> bool:
        """Whether ``a``, hyphen, line end (or blank) and ``b`` are one word."""
        low, more = a.lower(), b.lower()
        if "\n" not in gap and "\r" not in gap and more in _SUSPENDED:
            return False
        if hyphen in "¬\xad":
            return True
        v = self.vocabulary
        if low + "-" + more in v:
            return False
        if low + more in v or self.meant(low + more):
            return True
        if hyphen == "-" and (low in v and more in v or b[0].isupper() and len(b) > 1):
            return False
        if more in _SUSPENDED:
            return False
        return more not in v or low not in v

    def rejoined(self, text: str) -> str:
        """The text with its divided words in one piece."""
        if "\xad" in text:
            text = _SOFT.sub(lambda m: m.group()[0] + m.group()[2], text)
        return _DIVIDED.sub(lambda m: m.group(1) + m.group(4) if self.divided(*m.groups()) else m.group(), text)

    def noise(self, text: str | None, paper: Paper, page: int | None) -> set[str]:
        """The kinds of noise in a text."""
        if not text or not text.strip():
            return set()
        out: set[str] = set()
        body = text
        if "\n" in text or "\r" in text:
            lines = _lines(text)
            margins = margin_lines(lines, paper, page)
            for kinds in margins.values():
                out |= kinds
            if margins:
                body = "\n".join(x for i, x in enumerate(lines) if i not in margins)
        if _MAYBE_DIVIDED.search(body):
            joined = self.rejoined(body)
            if joined != body:
                out.add("hyphenation")
                body = joined
        if sum(map(self.suspicion, body.split())) >= MISREAD_WORDS and len(self.misread(body)) >= MISREAD_WORDS:
            out.add("misread")
        return out

    def repair(self, text: str | None, paper: Paper, page: int | None) -> str | None:
        """The text as continuous paragraphs of the same wording; a clean text unchanged."""
        kinds = self.noise(text, paper, page)
        if not kinds or text is None:
            return text
        lines = _lines(text)
        margins = margin_lines(lines, paper, page)
        lines = [x.rstrip() for i, x in enumerate(lines) if i not in margins]
        gaps = sum(not x for x in lines)
        spaced = gaps >= 0.4 * max(1, len(lines)) and len(lines) > 4
        body = ""
        for x in lines:
            s = x.strip()
            if not s:
                if not spaced and body and not body.endswith("\n\n"):
                    body += "\n\n"
                continue
            if not body or body.endswith("\n\n"):
                body += s
            elif body[-1] in _HYPHENS and len(body) > 1 and body[-2].isalpha() and s[0].isalpha():
                body += "\n" + s
            elif _HEADING.match(s) or _LIST.match(s) or _CELL.match(s):
                body += "\n" + s
            else:
                last = body.rsplit("\n", 1)[-1]
                body += ("\n" if _HEADING.match(last) and not _TERMINAL.search(last) or _CELL.match(last) else " ") + s
        body = self.rejoined(body)
        body = _DIVIDED.sub(lambda m: m.group(1) + m.group(2) + ("" if "\n" in m.group(3) else m.group(3)) + m.group(4), body)
        if "misread" in kinds:
            wrong = self.misread(body)
            for a, b, meant in reversed(wrong):
                old = body[a:b]
                body = body[:a] + (meant.upper() if old.isupper() and len(old) > 1 else meant.capitalize() if old[0].isupper() else meant) + body[b:]
        return body.replace("ﬁ", "fi").replace("ﬂ", "fl").strip()


def _starts_sentence(text: str, at: int) -> bool:
    before = text[:at].rstrip()
    return not before or before[-1] in ".!?:"


def corpus_statistics(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The vocabulary (word, n), (paper, line) of lines that are repeated in the paper or in several papers, and (paper, offset) of page numbers.

    ``texts`` has paper, page and text, and section if sections are known: their names aren't headers. Counts are made in every task first, then summed by a shuffle.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()
        for b in batches:
            heads: set[tuple[str, str, str, int]] = set()
            for paper, page, t in zip(b["paper"], b["page"], b["text"]):
                words.update(set(_LOWER.findall(_DIVIDED.sub(" ", t) if _MAYBE_DIVIDED.search(t) else t)))
                if paper is not None and ("\n" in t or "\r" in t):
                    at = -1 if page is None or page != page else int(page)
                    own, numbers = edge_lines(t, at if at >= 0 else None)
                    heads.update(("h", paper, skeleton(x), at) for x in own)
                    heads.update(("p", paper, str(x), at) for x in numbers)
            if heads:
                yield pd.DataFrame(sorted(heads), columns=["kind", "paper", "key", "n"])
            if len(words) > _FLUSH:
                yield pd.DataFrame({"kind": "w", "paper": None, "key": list(words), "n": list(words.values())})
                words = Counter()
        yield pd.DataFrame({"kind": "w", "paper": None, "key": ["", *words], "n": [0, *words.values()]})

    counted = materialize(texts.select("paper", "page", "text").mapInPandas(count, "kind string, paper string, key string, n long"))
    known = counted.filter("kind = 'w' AND key <> ''").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TEXTS)
    capital = F.col("key") != F.lower("key")
    words = known.groupBy(F.lower("key").alias("word")).agg(F.sum("n").alias("n"), F.max(~capital | (F.col("n") >= CAPITALISED)).alias("corpus_word"))
    words = materialize(words.filter("corpus_word").select("word", "n"))

    def one_error(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(w, n, v) for w, n in zip(b["word"], b["n"]) for v in set(_undone(w))]
            yield pd.DataFrame(got, columns=["word", "n", "other"])

    # a frequent word is misread often enough to look like a word: drop what is one error away from a far more frequent one
    far = words.mapInPandas(one_error, "word string, n long, other string")
    far = far.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other").filter(F.col("m") >= FAR * F.col("n")).select("word").distinct()
    edge = counted.filter("kind = 'h'").groupBy(F.col("key").alias("line"), "paper").agg(F.countDistinct("n").alias("pages"))
    if "section" in texts.columns:
        names = texts.select("section").filter("section IS NOT NULL").distinct().select(F.pandas_udf(lambda c: c.map(skeleton), "string")("section").alias("line"))
        edge = edge.join(names, "line", "left_anti")
    edge = materialize(edge)
    wide = edge.groupBy("line").agg(F.count(F.lit(1)).alias("papers")).filter(F.col("papers") >= HEADED_PAPERS).select("line")
    # of the lines of several papers each paper gets those that it has itself
    heads = edge.filter(F.col("pages") >= HEADED_PAGES).select("paper", "line").unionByName(edge.join(wide, "line", "left_semi").select("paper", "line")).distinct()
    number = counted.filter("kind = 'p'").groupBy("paper", F.col("key").cast("int").alias("offset")).agg(F.countDistinct("n").alias("pages"))
    every = counted.filter("kind = 'p'").groupBy("paper").agg(F.countDistinct("n").alias("all_pages"))
    number = number.join(every, "paper").filter((F.col("pages") >= NUMBERED_PAGES) & (2 * F.col("pages") > F.col("all_pages"))).select("paper", "offset")
    return materialize(words.join(far, "word", "left_anti")), materialize(heads), number


def _asked(text: str, common: frozenset[str]) -> set[str]:
    """What may be looked up for a text among the words that aren't broadcast."""
    if _MAYBE_DIVIDED.search(text):
        parts = [(m.group(1).lower(), m.group(4).lower()) for m in _DIVIDED.finditer(text)]
        text += " " + " ".join(f"{a}-{b} {a}{b} {a} {b}" for a, b in parts) + " " + _SOFT.sub(lambda m: m.group()[0] + m.group()[2], text)
    out = {"".join(m.group().split()).lower() for m in _SPACED.finditer(text)}
    for raw in set(text.split()):
        w, trimmed = raw.strip(_PUNCTUATION), _TRIM.sub("", raw)
        out |= {w.lower(), trimmed.lower(), trimmed.rstrip(")").lower(), trimmed[1:].lower(), *trimmed.lower().split("-")}
    return {w for w in out if w not in common and any(c.isalpha() for c in w)}


def _facts(rows: DataFrame, vocabulary: DataFrame, shared: Broadcast) -> DataFrame:
    """(table_name, row_key, facts): of each text's words that aren't broadcast, whether they are corpus words, or what they were misread from."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(t, k, w) for t, k, x in zip(b["table_name"], b["row_key"], b["text"]) for w in _asked(x, shared.value)]
            yield pd.DataFrame(got, columns=["table_name", "row_key", "word"])

    def variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for w in b["word"]:
                once = len(_undone(w))
                got = list(candidates(w, 2))
                yield pd.DataFrame({"word": w, "two": [n >= once for n in range(len(got))], "place": range(len(got)), "variant": got})

    asked = materialize(rows.select("table_name", "row_key", "text").mapInPandas(ask, "table_name string, row_key long, word string").distinct())
    words = asked.select("word").distinct()
    known = words.join(vocabulary.select("word"), "word", "left_semi").select("word", F.lit(True).alias("known"), *[F.lit(None).cast("string").alias(c) for c in ("one", "two")])
    other = words.join(vocabulary.select("word"), "word", "left_anti")
    met = other.mapInPandas(variants, "word string, two boolean, place int, variant string").join(vocabulary.select(F.col("word").alias("variant")), "variant")
    met = met.groupBy("word").agg(F.min_by("variant", F.when(~F.col("two"), F.col("place"))).alias("one"), F.min_by("variant", "place").alias("two"))
    facts = known.unionByName(other.join(met, "word", "left").select("word", F.lit(False).alias("known"), "one", "two"))
    each = asked.join(facts, "word").groupBy("table_name", "row_key")
    return each.agg(F.collect_list(F.struct("word", "known", "one", "two")).alias("facts"))  # one text's words


def _judged(texts: DataFrame, papers: DataFrame, repair: bool) -> DataFrame:
    spark = texts.sparkSession
    rows = texts.select("table_name", "row_key", "paper", "page", "text").filter("text IS NOT NULL")
    vocabulary, heads, numbers = corpus_statistics(texts.filter("text IS NOT NULL"))
    whole = vocabulary.count() <= MAX_WORDS
    shared = spark.sparkContext.broadcast(frozenset(r["word"] for r in (vocabulary if whole else vocabulary.orderBy(F.desc("n"), "word").limit(MAX_WORDS)).select("word").collect()))
    info = papers.select(F.col("paper_title").alias("paper"), "authors").filter("paper IS NOT NULL").groupBy("paper").agg(F.max("authors").alias("authors"))
    info = info.join(heads.groupBy("paper").agg(F.collect_set("line").alias("lines")), "paper", "full")
    info = materialize(info.join(numbers.groupBy("paper").agg(F.collect_set("offset").alias("offsets")), "paper", "full"))
    size = info.agg(F.sum(F.length("paper") + F.coalesce(F.length("authors"), F.lit(0)) + F.coalesce(F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x)), F.lit(0)))).first()[0] or 0
    # only texts of several lines have headers
    lined = F.col("text").contains("\n") | F.col("text").contains("\r")
    several = rows.filter(lined)
    if size < _BROADCAST_BYTES:
        several = several.join(F.broadcast(info), "paper", "left")
    else:
        titles = several.select("paper").filter("paper IS NOT NULL").distinct().join(info, "paper", "left")
        named = skew_join(several.filter("paper IS NOT NULL"), titles, ["paper"], counted=materialize(several.select("paper").filter("paper IS NOT NULL")))
        several = named.unionByName(several.filter("paper IS NULL"), allowMissingColumns=True)
    none = {"authors": "string", "lines": "array<string>", "offsets": "array<int>"}
    fields = ["table_name", "row_key", "paper", "page", "text", *none]
    every = several.select(fields).unionByName(rows.filter(~lined).withColumns({c: F.lit(None).cast(t) for c, t in none.items()}).select(fields))
    if not whole:
        fields = [*fields, "facts"]
        every = every.join(_facts(rows, vocabulary, shared), ["table_name", "row_key"], "left").select(fields)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        j = Judge(shared.value if whole else _Words(shared.value))
        known: dict[tuple, Paper] = {}
        for b in batches:
            out = []
            for t, k, paper, page, text, authors, lines, offsets, *facts in b[fields].itertuples(index=False, name=None):
                key = (paper, authors)
                p = known.get(key)
                if p is None:
                    if len(known) > 50_000:
                        known.clear()
                    p = known[key] = Paper(paper, authors, frozenset(lines if lines is not None else ()), frozenset(offsets if offsets is not None else ()))
                at = None if page is None or page != page else int(page)
                if facts and facts[0] is not None:
                    j.told(facts[0])
                if repair:
                    fixed = j.repair(text, p, at)
                    out.append((t, k, fixed != text, fixed))
                else:
                    out += [(t, k, kind) for kind in sorted(j.noise(text, p, at))]
            yield pd.DataFrame(out, columns=["table_name", "row_key", "repaired", "text"] if repair else ["table_name", "row_key", "noise"])

    schema = "table_name string, row_key long, " + ("repaired boolean, text string" if repair else "noise string")
    return every.mapInPandas(judge, schema)


def scan_noise(texts: DataFrame, papers: DataFrame) -> DataFrame:
    """(table_name, row_key, noise): one row for every text and kind of noise found in it.

    ``texts`` has table_name, row_key, paper (its title, may be null), page (may be null), text and perhaps section; ``papers`` has paper_title and
    authors. Null and blank texts give no row, repeated rows repeated ones, empty tables an empty one.
    """
    return _judged(texts, papers, repair=False)


def repaired_texts(texts: DataFrame, papers: DataFrame) -> DataFrame:
    """(table_name, row_key, repaired, text): every text that isn't null, noisy ones as continuous paragraphs, clean ones unchanged."""
    return _judged(texts, papers, repair=True)
