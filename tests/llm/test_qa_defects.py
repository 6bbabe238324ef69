"""Defects of answers, one by one and over a table."""

import pytest

from granary.llm.qa_defects import defect, defective_pairs, open_structures, tile

Q = "What recall does Alpha reach on the Beta set?"
E = "Alpha reaches 12.3 points."


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (None, "empty"), ("", "empty"), ("  \n\t", "empty"), ("null", "empty"), ("A: ", "empty"), ("Answer:", "empty"), ("...", "empty"), ("<br>", "empty"), ("[]", "empty"), ("​", "empty"), ("N/A", "empty"), ("Antwort:\n", "empty"),
        ("12.3 points", None), ("Alpha", None), ("No.", None), ("12.3 points, as Table 2 shows.", None),
        ("Alpha relies on:\n- dense index\n- sparse vector", None),
        ("1. First we index every page.\n2. Then we rank the pages.", None),
        ("```\nx = 1\n```", None),
        ("1. First we index every page.\n2. Then we rank the", "truncated"),
        ("Alpha reaches 12.3 points. The second setting", "truncated"),
        ("Alpha reaches 12.3 points. It beats Beta (see Table", "truncated"),
        ("Use this:\n\n```\nx = 1\ny =", "truncated"),
        ("Alpha relies on:\n- dense index\n- ", "truncated"),
        ("Alpha reaches 12.3 points, and,", "truncated"),
        ("What recall does Alpha reach on the Beta set?", "copied_question"), ("what recall does alpha reach on the beta set", "copied_question"), ('You asked: "What recall does Alpha reach on the Beta set?"', "copied_question"),
        ("What recall does Alpha actually reach on the Beta set?", "copied_question"), ("What recal does Alpha reach on the Beta set?", "copied_question"), (f"{Q} {Q}", "copied_question"),
        (f"{Q} 12.3 points", None),
        ("I'm sorry, but I can't help with that request.", "refusal"), ("As a language model, I am unable to answer this question. Is there anything else you need?", "refusal"), ("Lo siento, no puedo responder a esa pregunta.", "refusal"),
        ("Dazu kann ich leider keine Auskunft geben.", "refusal"), ("Je suis désolé, je ne peux pas répondre à cette question.", "refusal"), ("No answer can be given from the context provided", "refusal"),
        ("The baseline cannot hold more than 9 runs, and Alpha does not provide a decoder.", None),
        ("Die Autoren nennen dafür keinen Grund, doch Alpha bestimmt das Ergebnis nicht.", "other_language"), ("Авторы пишут, что модель почти всегда медленная.", "other_language"), ("Il calcolo di Alpha limita ogni filtro di 3 per cento.", "other_language"),
        ("La segunda página indica que el registro supera 28.0.", "other_language"),
    ],
)
def test_defects(answer, want):
    assert defect(Q, answer, E) == want


def test_absence_is_an_answer_where_expected():
    q, e = "Does the Beta paper report a recall for Alpha?", "The Beta paper does not report a recall for that system."
    assert defect(q, "A recall is not reported in the paper.", e) is None
    assert defect(q, "No, the paper does not report a recall.", e) is None


def test_pushdown_parser():
    assert open_structures("f(a[1], {b}).") == []
    assert open_structures("see (Table 2 and [3") == ["sentence", "(", "["]
    assert open_structures("1) one\n2) two") == ["item", "sentence"]
    assert open_structures("1) One.\n2) Two.") == []
    assert open_structures("```\n(\n```") == []
    assert open_structures("(as here\n```\nx\n```") == ["("]
    assert open_structures("don't say “this") == ["sentence", "“"]
    assert open_structures("<div><b>hello") == ["<div>", "<b>", "sentence"]
    assert open_structures("<div>a <b>word</b><br>.</div>") == []


@pytest.mark.parametrize(
    "answer",
    ["Unfortunately that falls outside what I am able to help with.", "That's beyond my capabilities.", "I lack the information needed.", "申し訳ありませんが、その質問にはお答えできません。", "抱歉，我无法回答这个问题。",
     "Thank you so much for this very interesting question about the recall of Alpha on the Beta set. I am unable to answer it.", "Les extraits fournis ne me permettent pas de répondre.", "Diese Frage lässt sich mit den vorliegenden Auszügen nicht beantworten.",
     "The provided passages do not allow me to say.", "Helaas kan ik deze vraag niet beantwoorden.", "К сожалению, я не могу ответить на этот вопрос.", "Questa domanda non può ricevere una risposta.", "We do not have enough information."],
)
def test_refusals(answer):
    assert defect(Q, answer, E) == "refusal"


def test_bare_markers_and_long_copies():
    assert defect(Q, "1. First we index every page.\n2.", E) == "truncated" and defect(Q, "9.", E) is None
    assert defect(Q, " ".join([Q] * 300), E) == "copied_question"


def test_tiles_use_every_word_once():
    q, a = tile("a b c d e".split(), "a b c x d e a b".split())
    assert q == {0, 1, 2, 3, 4} and a == {0, 1, 2, 4, 5, 6, 7}
    assert tile("a b c".split(), "c b a".split()) == (set(), set())


def test_table(spark):
    rows = [(1, Q, "", E, "x"), (2, Q, "12.3 points", E, "x"), (3, None, None, None, "x"), (4, Q, "word " * 20000 + "end.", E, "x"), (1, Q, "", E, "x")]
    df = spark.createDataFrame(rows, "rid long, question string, answer string, expected string, defect_type string")
    got = sorted(map(tuple, defective_pairs(df, "rid", "question", "answer", "expected").collect()))
    assert got == [(1, "empty"), (1, "empty"), (3, "empty")]
    assert defective_pairs(df.limit(0), "rid", "question", "answer", "expected").count() == 0
