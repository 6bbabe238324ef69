"""Defective question and answer pairs.

An answer is checked, in this order, for being empty, giving back the question, refusing, breaking off and being in another
language; the first that holds is its defect type.

* copied_question: greedy string tiling of answer on question, again and again as long as the question repeats, covers both but for framing words.
* refusal: a grammar of declining clauses, made of who speaks, what can't be done or is lacking, and what was asked for, in several languages; a sentence of
  the answer must be one, and but for courtesies and the question itself little else may stand beside it.
* truncated: a pushdown parser reads fences, code, brackets, quotations, emphasis, tags, list items and sentences to the end of the answer; what it leaves open is a
  truncation, an open sentence or item only if it isn't formed like a short complete answer or like the other items.
* other_language: scripts and function words of question and answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.function_words import EVERY, FUNCTION_WORDS

_WORD = re.compile(r"[^\W_]+(?:[-'’.,][^\W_]+)*")
_TAG = re.compile(r"<[^<>]{0,80}>")
_INVISIBLE = re.compile("[​-‏﻿⁠\xad]")
_LABEL = re.compile(r"^\W*(?:a|answer|the answer(?: is)?|final answer|response|reply|result|output|antwort|réponse|reponse|respuesta|risposta|resposta|assistant|ответ)\W*$", re.IGNORECASE)
_PLACEHOLDER = frozenset("null none nil nan na n/a n.a undefined tbd tba todo empty blank unknown placeholder missing keine nada vide vacío rien leer".split()) - {"unknown"}

#: Frames that may stand around a repeated question.
_FRAME = frozenset("q a question asked you the is user wants want to know your here asks asking was original query restated repeat answer answering frage die lautet gefragt pregunta la es usuario pregunta demande utilisateur est vous avez demandé".split())

#: The refusal grammar: for each language its terminals (word patterns) and its clauses, sequences of terminals with up to so many words between two of them
#: ("..3"), or none. Terminals that no list names are words themselves. Fixed values.
_GRAMMAR: dict[str, tuple[dict[str, str], list[str]]] = {
    "en": (
        {
            "SELF": r"(?:i|we|this assistant|the assistant)", "ME": r"(?:me|us|i|we)", "MY": r"(?:my|our|what (?:i|we)|i (?:am|can)|we (?:are|can)|(?:the|this) (?:scope|limits?))",
            "CANNOT": r"(?:can ?not|can['’]?t|could ?n[o'’]t|couldn['’]t|could not|won['’]t|will not|would not|wouldn['’]t|must decline|have to decline|decline|refuse|am declining|do not feel|don['’]t feel|would rather not|must pass)",
            "UNABLE": r"(?:unable|not able|not in a position|not comfortable|not allowed|not permitted|not willing|not certain enough|not equipped|not qualified)", "BE": r"(?:am|are|was|were|'m|’m|'re|’re)", "SORRY": r"(?:sorry|afraid)",
            "LACK": r"(?:lack|(?:have|had) (?:no|not)|haven['’]t|(?:do not|don['’]t|did not|didn['’]t) have)", "UNSEEN": r"(?:do not|don['’]t|did not|didn['’]t) (?:know|see|find|possess)",
            "NEED": r"(?:access|information|answer|way|context|knowledge|data|idea|evidence|means|details?|capability|ability|expertise)", "ACT": r"(?:answer|say|respond|tell|reply|help|assist|determine|provide|comply)",
            "NONE": r"(?:nothing|no|not)", "FEW": r"(?:not enough|no|insufficient|in ?sufficient|isn['’]t enough|too little)", "SOURCE": r"(?:excerpts?|passages?|context|documents?|material|sources?|pages?)",
            "ASKED": r"(?:this|the|your|that) (?:question|request)", "BEYOND": r"(?:beyond|outside|exceeds?|out of|not within)", "REPLY": r"(?:answer|response|reply)", "DONE": r"(?:given|provided|offered|found|made)", "LET": r"(?:do not|does not|don['’]t|doesn['’]t|did not) (?:let|allow|permit|enable)",
        },
        ["SELF CANNOT", "SELF BE ..2 UNABLE", "SELF UNABLE", "SELF BE ..1 SORRY", "SELF really|simply|just|honestly CANNOT", "SELF LACK ..4 NEED", "SELF UNSEEN", "no REPLY can|could|may be DONE", "FEW ..4 NEED ..6 for ME", "FEW ..4 NEED ..4 to ACT", "impossible|possible for ME to",
         "SOURCE ..4 ME BE ..6 NONE", "SOURCE LET ..2 ME", "ASKED can|could ..1 not|never be answered|fulfilled", "ASKED cannot|can't|can’t|couldn't be answered|fulfilled", "BEYOND ..2 MY", "sorry but ..4 CANNOT", "UNABLE to ACT ..3 question|request"],
    ),
    "de": (
        {"SELF": r"(?:ich|wir)", "MODAL": r"(?:kann|können|konnte|möchte|darf|werde|habe|weiß)", "NOT": r"(?:nicht|keine?n?|leider)", "ME": r"(?:mir|uns)", "ASKED": r"(?:diese|die|ihre|deine) (?:frage|anfrage)", "CAN": r"(?:kann|lässt|konnte|ließ)", "ANSWER": r"(?:beantworten|beantwortet|beantwortbar|antworten|auskunft|antwort|sagen|helfen)", "SOURCE": r"(?:auszüge|texte?|quellen?|unterlagen|kontext|angaben)"},
        ["MODAL SELF ..8 NOT", "SELF MODAL ..8 NOT", "tut ME leid", "ME ist es nicht möglich", "ME fehlen", "ME ..4 NOT möglich", "leider kann|können|ist", "ASKED CAN ..9 nicht ..2 ANSWER", "SOURCE ..5 ME ..3 NOT ..3 ANSWER", "SOURCE erlauben|ermöglichen|reichen ..4 NOT"],
    ),
    "fr": (
        {"SORRY": r"(?:désolée?s?|regrette|regrettons)", "CAN": r"(?:peux|puis|suis pas|dispose|sais|trouve|pouvons|sommes pas|disposons)", "ANSWER": r"(?:répondre|réponse|dire|aider)", "ASKED": r"(?:cette|la|votre) (?:question|demande)", "SOURCE": r"(?:extraits?|documents?|textes?|contexte|passages?)", "ME": r"(?:me|nous)"},
        ["SORRY ..6 ne|n", "je|nous ne CAN", "je n ai pas|aucune", "je n['’]ai pas|aucune", "impossible ..4 ANSWER", "SOURCE ..2 ne ME permettent|permet|suffisent pas", "ne ME permettent|permet pas ..2 ANSWER", "ASKED ne peut ..4 ANSWER", "ne peut ..2 ANSWER à ASKED", "pas possible ..3 ANSWER"],
    ),
    "es": (
        {"SORRY": r"(?:lo siento|perdón|disculpa|disculpe|lamento|lamentablemente)", "ANSWER": r"(?:responder|respuesta|contestar|ayudar|decir)", "ASKED": r"(?:esta|la|esa|su|tu) pregunta"},
        ["SORRY ..6 no", "no puedo|podemos|sabemos", "no me es posible", "no soy|somos capaz|capaces", "no dispongo|tengo|tenemos ..3 información|contexto|respuesta|acceso|datos", "no me|nos permiten|permite ..1 ANSWER", "ASKED no ..3 ANSWER", "imposible ..2 ANSWER"],
    ),
    "it": ({"ANSWER": r"(?:rispondere|risposta|aiutare|dire)"}, ["mi dispiace|spiace ..6 non", "non posso|possiamo", "non sono in grado", "non ho accesso|abbastanza|informazioni", "non mi|ci permettono|permette|consentono ..1 ANSWER", "domanda non può ..3 ANSWER"]),
    "pt": ({"ANSWER": r"(?:responder|resposta|ajudar|dizer)"}, ["sinto muito|desculpe ..6 não", "não posso|consigo|tenho|sei|podemos", "não me|nos permitem|permite ..1 ANSWER", "pergunta não pode ..3 ANSWER"]),
    "nl": ({}, ["ik|we|wij kan|kunnen|weet|heb|hebben ..5 niet|geen", "kan|kunnen ik|we|wij ..5 niet|geen", "het spijt me|ons", "helaas kan|kunnen", "vraag kan ..5 niet beantwoord|beantwoorden|worden"]),
    "ru": ({}, ["к сожалению ..6 не|нет", "извините|простите ..6 не|нет", "я|мы не могу|можем|знаю|знаем|имею|имеем", "не могу|можем ответить|помочь|сказать|предоставить", "у меня|нас нет|недостаточно"]),
}
#: The same for scripts without blanks, as patterns of a sentence. Fixed values.
_UNSPACED = [
    r"(?:申し訳|すみません|ごめん|恐れ入り|残念ながら|あいにく).*(?:ません|ない|ぬ|かねます)", r"(?:お答え|回答|返答|お手伝い|対応|提供|お話し|お伝え).{0,8}(?:でき(?:ません|ない)|出来ません|いたしかね|しかね)", r"(?:わかり|分かり|存じ|持っており)ません|情報が(?:ありません|不足|足りません)",
    r"(?:抱歉|对不起|對不起|很遗憾|很遺憾).*(?:无法|無法|不能|不便|没有|沒有|不)", r"(?:我|我们|我們)(?:无法|無法|不能|不知道|没有足够|沒有足夠)", r"(?:无法|無法|不能)(?:回答|提供|帮助|幫助|协助)", r"(?:죄송|유감|아쉽).*(?:없|못|않|어렵)", r"(?:답변|대답|도와|제공).{0,10}(?:수 없|못|어렵)",
]


def _clause(terminals: dict[str, str], clause: str) -> str:
    """A clause of the grammar as a pattern."""
    out, gap = "", ""
    for part in clause.split():
        if part.startswith(".."):
            gap = rf"(?:[^\w'’]+[\w'’-]+){{0,{part[2:]}}}?"
            continue
        word = "(?:" + "|".join(terminals.get(p, p) for p in part.split("|")) + ")"
        out += (gap + (r"(?:[^\w'’]+|(?=['’]))" if out else "")) + word
        gap = ""
    return r"\b" + out + r"\b"


_REFUSAL = re.compile("|".join([_clause(t, c) for t, cs in _GRAMMAR.values() for c in cs] + _UNSPACED), re.IGNORECASE)
_AS_MODEL = re.compile(r"^\W*(?:as|being) an? (?:ai|large|language|artificial)\b.{0,40}\b(?:model|assistant|intelligence)\b", re.IGNORECASE)
_ABSENT = re.compile(r"\b(?:not|n['’]t|no|nowhere|never|without|keine?n?|nicht|pas|ningun\w*)\b", re.IGNORECASE)
_REPORTS = re.compile(r"\b(?:report|mention|state|give|provide|contain|describe|discuss|specif|includ|list|cover|name|offer)\w*|\b(?:figure|value|number) for\b", re.IGNORECASE)
_COURTESY = re.compile(
    r"^(?:thanks?|thank you|(?:that['’]s|this is|what) an? \w+ question|(?:good|great|interesting) question|i (?:appreciate|understand|see)|hello|hi|dear|unfortunately|merci|danke|gracias|is there anything|feel free|please|let me know|you (?:may|might|could|can)|try |perhaps|kindly|happy to|gern|bitte|n['’]hésitez|por favor|puede|vous pouvez|if you|would you|can i help|do you want|sorry|i apologi[sz]e|i hope|thank)", re.IGNORECASE
)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|(?<=[。！？])[”’」）]*\s*")
_END = re.compile(r"(?:[.!?…。！？؟।]|\.{3})[\"'”’»)\]*_`]*(?:\s*\[\d+(?:[,–-]\s*\d+)*\])*[\"'”’»)*_`]*$")
_ITEM = re.compile(r"^\s*(?:[-*•+–]|\d{1,3}[.)]|[a-z][.)])(?:\s+|$)")
_FENCE = re.compile(r"^\s*(```|~~~)")
_OPEN, _SHUT = "([{", ")]}"
_WIDE = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_SCRIPTS = {
    "cyrillic": re.compile(r"[Ѐ-ӿ]"),
    "greek": re.compile(r"[Ͱ-Ͽ]"),
    "arabic": re.compile(r"[؀-ۿ]"),
    "hebrew": re.compile(r"[֐-׿]"),
    "devanagari": re.compile(r"[ऀ-ॿ]"),
    "thai": re.compile(r"[฀-๿]"),
    "hangul": re.compile(r"[가-힯]"),
    "kana": re.compile(r"[぀-ヿ]"),
    "han": re.compile(r"[一-鿿]"),
}


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    s = _TAG.sub(" ", _INVISIBLE.sub("", answer)).strip().strip("`\"'*_ \t\n")
    core = re.sub(r"^[\W_]+|[\W_]+$", "", s).lower()
    return not core or core in _PLACEHOLDER or bool(_LABEL.match(s))


def _same(a: str, b: str) -> bool:
    return len(a) > 3 and len(b) > 3 and abs(len(a) - len(b)) <= 2 and SequenceMatcher(None, a, b, False).ratio() >= 0.8


def tile(question: list[str], answer: list[str], least: int = 2) -> tuple[set[int], set[int]]:
    """Greedy string tiling: the longest common runs of words first, each word in one tile; covered positions of both.

    As long as more of the answer can be tiled by the question anew, it is, so that a question given back twice is covered whole.
    """
    n, m = len(question), len(answer)
    ids: dict[str, int] = {}
    q, a = np.array([ids.setdefault(w, len(ids)) for w in question]), np.array([ids.setdefault(w, len(ids)) for w in answer])
    same = q[:, None] == a[None, :]
    for w in {w for w, hit in zip(question, same.any(axis=1)) if not hit}:  # only words that occur nowhere as they are may be respelt
        near = [x for x in set(answer) - set(question) if _same(w, x)]
        if near:
            same |= (q == ids[w])[:, None] & np.isin(a, [ids[x] for x in near])[None, :]
    q_every, a_done = np.zeros(n, dtype=bool), np.zeros(m, dtype=bool)
    while True:
        q_done, tiles = np.zeros(n, dtype=bool), 0
        while True:
            best, length = (0, 0, 0), np.zeros(m + 1, dtype=np.int64)
            for i in range(n - 1, -1, -1):
                row = np.zeros(m + 1, dtype=np.int64)
                if not q_done[i]:
                    row[:m] = np.where(same[i] & ~a_done, length[1:] + 1, 0)
                length = row
                j = int(row.argmax())
                if row[j] > best[0]:
                    best = (int(row[j]), i, j)
            if best[0] < least:
                break
            tiles += 1
            q_done[best[1] : best[1] + best[0]] = True
            a_done[best[2] : best[2] + best[0]] = True
        q_every |= q_done
        if not tiles:
            return set(np.nonzero(q_every)[0].tolist()), set(np.nonzero(a_done)[0].tolist())


def is_copied(question: str | None, answer: str) -> bool:
    if not question:
        return False
    q, a = [w.lower() for w in _WORD.findall(question)], [w.lower() for w in _WORD.findall(answer)]
    own = set(q)
    if len(q) < 3 or len(a) < 0.6 * len(q) or len(set(a) & own) < 0.4 * len(own) or sum(w not in own and w not in _FRAME for w in a) > 0.4 * len(a) + 10:
        return False
    colon = answer.find(":")
    lead = _WORD.findall(answer[:colon]) if colon > 0 else []
    if 0 < len(lead) <= 9 and len(a) - len(lead) >= 0.8 * len(q) and not any(c.isdigit() for w in lead for c in w):
        a = a[len(lead) :]  # an introduction such as "You asked:"
    q_done, a_done = tile(q, a)
    rest = [a[j] for j in range(len(a)) if j not in a_done]
    alien = [w for w in rest if w not in _FRAME]
    return len(q_done) >= 0.8 * len(q) and len(alien) <= 1 + len(q) // 14 and not any(c.isdigit() for w in alien for c in w)


#: Every clause of the grammar holds one of these words (or stands in an unspaced script), so most sentences needn't be parsed. Fixed values.
_CUES = frozenset(
    "not no t cannot cant unable sorry afraid decline declining refuse pass lack insufficient beyond outside exceed exceeds out never nothing impossible possible too little nicht keine keinen kein leider leid fehlen désolé désolée désolés désolées regrette regrettons ne n pas aucune"
    " imposible non não niet geen spijt helaas не нет к недостаточно".split()
)


def _declines(s: str) -> bool:
    if s.isascii() or not _WIDE.search(s):
        if _CUES.isdisjoint(re.findall(r"[^\W\d_]+", s.lower())):
            return False
    return bool(_REFUSAL.search(s) or _AS_MODEL.match(s) and _ABSENT.search(s))


def is_refusal(question: str | None, answer: str, expected: str | None) -> bool:
    sentences = [s.strip() for s in _SENTENCE.split(answer.strip()) if s and s.strip()]
    declining = [s for s in sentences if _declines(s)]
    if not declining:
        return False
    asked = {w.lower() for w in _WORD.findall(question or "")}
    rest = [[w.lower() for w in _WORD.findall(s)] for s in sentences if not _declines(s) and not _COURTESY.match(s)]
    if sum(len(ws) for ws in rest if sum(w in asked for w in ws) < 0.8 * len(ws)) > 12:
        return False
    # that the source says nothing is an answer where the expected one says so too
    if expected and _ABSENT.search(expected) and _REPORTS.search(expected):
        return not all(_ABSENT.search(s) and _REPORTS.search(s) and not re.search(r"\b(?:i|we|me|ich|je)\b", s, re.IGNORECASE) for s in declining)
    return True


#: Tags that are closed again; of others the end may be left out. Fixed values.
_CLOSED_TAGS = frozenset("b i u em strong div span code pre table ul ol h1 h2 h3 h4 h5 h6 a sub sup blockquote section article details summary script style font center small mark kbd".split())
_ONE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?(/?)>")
_STOP = re.compile(r"(?:[.!?…؟।。！？]|\.{3})[\"'”’»)\]*_`]*(?:\s*\[\d+(?:[,–-]\s*\d+)*\])*[\"'”’»)*_`]*(?=\s|$|<)")


_MARK = re.compile(r"[^\W_]+|\*\*|[`<()\[\]{}“”«»\".!?…؟।。！？]")


def open_structures(text: str) -> list[str]:
    """What a pushdown parser leaves open at the end, outermost first.

    ``` for a fence, ` for code, ** for emphasis, an opening bracket or quotation mark, <name> for a tag and < for half of one, ``item`` for a list item and ``sentence``
    for a sentence without its stop. A line of a list ends the item before, an empty line any item and sentence.
    """
    stack: list[str] = []

    def shut(mark: str) -> bool:
        if mark not in stack:
            return False
        del stack[len(stack) - 1 - stack[::-1].index(mark)]
        return True

    for line in text.splitlines():
        if _FENCE.match(line):
            if "```" in stack:
                del stack[stack.index("```") :]
            else:
                shut("sentence"), shut("item")
                stack.append("```")
            continue
        if "```" in stack:
            continue
        item = _ITEM.match(line)
        if item or not line.strip():
            shut("sentence"), shut("item")
        if item:
            stack.append("item")
            line = line[item.end() :]
        skip = 0
        for token in _MARK.finditer(line):
            c, i = token.group(), token.start()
            if i < skip:
                continue
            if c == "`" or c == "**":
                if not shut(c) and (c == "`" or i + 2 < len(line) and not line[i + 2].isspace()):
                    stack.append(c)
            elif "`" in stack:
                pass
            elif c == "<":
                tag = _ONE_TAG.match(line, i)
                if tag:
                    name = tag.group(2).lower()
                    if tag.group(1):
                        shut(f"<{name}>")
                    elif not tag.group(3) and name in _CLOSED_TAGS:
                        stack.append(f"<{name}>")
                    skip = tag.end()
                elif re.match(r"<[a-zA-Z/][^<>]{0,60}$", line[i:]):
                    stack.append("<")
            elif c in _OPEN or c in "“«":
                stack.append(c)
            elif c in _SHUT:
                shut(_OPEN[_SHUT.index(c)])
            elif c in "”»":
                shut("“" if c == "”" else "«")
            elif c == '"':
                if not shut('"') and (i == 0 or line[i - 1].isspace() or line[i - 1] in "([{"):
                    stack.append('"')
            elif c[0].isalnum():
                if "sentence" not in stack:
                    stack.append("sentence")
            elif _STOP.match(line, i):
                shut("sentence"), shut("item")
    return stack


def is_truncated(answer: str) -> bool:
    s = _INVISIBLE.sub("", answer).rstrip()
    lines = [x for x in s.splitlines() if x.strip()]
    if not lines:
        return False
    left = open_structures(s)
    if set(left) - {"item", "sentence"}:
        return True
    last = lines[-1].strip()
    if len(lines) > 1 and (marker := _ITEM.match(last)) and marker.end() == len(last):
        return True  # an item without anything in it
    if _FENCE.match(last):
        return False
    if last.startswith("|"):
        return not last.endswith("|")
    if not left or _END.search(last):
        return False
    # an item or sentence is open; is it formed like one that ends so?
    if last[-1] in ",;–—-=+&/\\(:":
        return True
    words = _WORD.findall(last)
    final = words[-1].lower() if words else ""
    closing = last[-1] in ")]}\"'”’»*_`"
    item = _ITEM.match(last)
    if item:
        body = _ITEM.sub("", last)
        if not _WORD.search(body):
            return True
        others = [_ITEM.sub("", x.strip()) for x in lines[:-1] if _ITEM.match(x)]
        ended = [x for x in others if _END.search(x)]
        if others and len(ended) == len(others) or len(words) > 7 and not closing:
            return True
        if len(words) == 1 and len(others) > 1 and all(len(_WORD.findall(x)) > 1 for x in others) and not closing:
            return True
        return final in EVERY and not closing and len(words) > 1 and final not in {"it", "this", "that", "one", "all", "both", "in", "on", "off"} | _NAMES
    # prose: a fragment after a finished sentence, or a long one without an end
    pieces = [p for p in _SENTENCE.split(last) if p.strip()]
    if len(pieces) > 1 and re.search(r"\?[\"'”’»)]*$", pieces[-2]):
        pieces = pieces[-1:]  # the question, repeated, and an answer that may be short
    fragment = pieces[-1]
    own = _WORD.findall(fragment)
    if re.match(r"^(?:[^\W\d_][\w ’'-]{0,40}): ", fragment):  # a label such as "Regarding the margin:"
        own = _WORD.findall(fragment.split(": ", 1)[1])
    if final in EVERY - _NAMES and not closing and len(own) > 1:
        return True
    if len(pieces) > 1:
        return not closing or len(own) > 6
    return len(own) > (9 if closing else 6)


#: Single letters and abbreviations that may end a complete answer.
_NAMES = frozenset("a b c d e g i k l m n o s t u v y z so yes no on off".split())


def language_scores(text: str) -> dict[str, float]:
    """Function words of each language in the text; a word of several languages counts in part for each."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    out = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in words:
        langs = [k for k, ws in FUNCTION_WORDS.items() if w in ws]
        for k in langs:
            out[k] += 1.0 if len(langs) == 1 else 0.6 if len(langs) == 2 else 0.35
    return out


def script_of(text: str) -> str:
    """The script of most letters; Latin of a text without letters."""
    if text.isascii():
        return "latin"
    counts = {k: len(p.findall(text)) for k, p in _SCRIPTS.items()}
    counts["latin"] = len(_LATIN.findall(text))
    return max(counts, key=lambda k: (counts[k], k == "latin"))


def is_other_language(question: str | None, answer: str) -> bool:
    if not question or len(re.findall(r"[^\W\d_]", answer)) < 12:
        return False
    if script_of(question) != script_of(answer):
        return True
    if script_of(answer) != "latin":
        return False
    q, a = language_scores(question), language_scores(answer)
    asked = max(q, key=lambda k: q[k])
    if q[asked] < 1:
        return False
    best = max(a, key=lambda k: a[k])
    n = len(_WORD.findall(answer))
    if best == asked:
        return False
    return a[best] >= max(2.0, 0.12 * n) and a[best] >= 1.7 * a[asked] + 0.5 or a[asked] == 0 and a[best] >= 1.2 and n >= 5


def defect(question: str | None, answer: str | None, expected: str | None) -> str | None:
    """The defect type of one answer, or None."""
    if is_empty(answer):
        return "empty"
    if is_copied(question, answer):
        return "copied_question"
    if is_refusal(question, answer, expected):
        return "refusal"
    if is_other_language(question, answer):
        return "other_language"
    if is_truncated(answer):
        return "truncated"
    return None


def defective_pairs(df: DataFrame, row_id: str, question: str, answer: str, expected: str) -> DataFrame:
    """(row_id, defect_type): every row whose answer is defective, with its first defect type.

    A null answer is empty; a null question rules out copied_question and other_language, a null expected answer only matters
    to refusals. Repeated rows give repeated rows, an empty table an empty one; other columns aren't read.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            none = lambda x: None if x is None or x != x else x
            types = [defect(none(q), none(a), none(e)) for q, a, e in zip(b["q"], b["a"], b["e"])]
            yield pd.DataFrame({"row_id": b["id"], "defect_type": types})[[t is not None for t in types]]

    rows = df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{question}`").alias("q"), F.col(f"`{answer}`").alias("a"), F.col(f"`{expected}`").alias("e"))
    return rows.mapInPandas(judge, f"row_id {df.schema[row_id].dataType.simpleString()}, defect_type string")
