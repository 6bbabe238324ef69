"""Noise of scanned pages: found, named and repaired; clean texts unchanged."""

import random

from granary.llm.scan_noise import Judge, Paper, letters, margin_lines, numeral, repaired_texts, scan_noise, skeleton

VOCABULARY = frozenset("the quick brown fox jumps over a lazy dog because hyphenation is hard to repair in long documents with many words section-aware low-rank system removes noise from pages before reading every line moment corner dinner number and or of".split())
PAPER = Paper("On the Noise of Scanned Pages", "Ada Smith;Bo Jones")
J = Judge(VOCABULARY)


def kinds(text, page=7):
    return J.noise(text, PAPER, page)


def test_hyphenation():
    assert kinds("the docu-\nments are long") == {"hyphenation"}
    assert kinds("the docu\xadments are long") == {"hyphenation"}
    assert kinds("hyphe¬\nnation is hard") == {"hyphenation"}
    assert kinds("the docu- ments are long") == {"hyphenation"}
    assert kinds("a section-\naware system") == set()
    assert kinds("pre- and post reading") == set()
    assert kinds("the dog -\nlazy and brown -\njumps") == set()


def test_page_numbers_and_headers():
    assert kinds("the quick brown fox jumps over the\n7\nlazy dog because hyphenation is hard") == {"page_number"}
    assert kinds("the quick brown fox jumps over the\nvii\nlazy dog") == {"page_number"}
    for s in ("Page 7", "[page 7]", "- 7 -", "— 7 —", "p. 7", "page 7 of 9", "7 |"):
        assert kinds(f"the quick brown fox jumps over\n{s}\nthe lazy dog") == {"page_number"}, s
    assert kinds("Table 3\nwords per page\n7\n12\n31") == set()
    assert kinds("the quick brown fox\nOn the Noise of Scanned Pages\njumps over") == {"running_header"}
    assert kinds("ON THE NOISE OF SCANNED PAGES   7\nthe quick brown fox jumps") == {"running_header", "page_number"}
    assert kinds("the fox\nSmith et al.\njumps") == {"running_header"}
    assert kinds("the fox\nProc. 5th Scan Workshop, Vol. 9\njumps") == {"running_header"}
    assert kinds("the fox\nPreprint, under review\njumps") == {"running_header"}
    assert kinds("3.2 Data Setup\nthe quick brown fox jumps over a lazy dog.") == set()


def test_misread():
    assert kinds("tbe qnick brovvn fox") == {"misread"}
    assert kinds("the qiuck brwon fox jmups oevr a lazy dog") == set()  # slips of a typist
    assert kinds("Nalorix and Veb0ran jumps over tbe dog") == set()  # two are too few


def test_repair():
    text = "ON THE NOISE OF SCANNED PAGES   7\nthe quick brovvn fox jurnps over tbe lazy dog be-\n7\ncause hyphenation is hard.\n\n2.1 System\nIt removes noise."
    got = J.repair(text, PAPER, 7)
    assert got == "the quick brown fox jumps over the lazy dog because hyphenation is hard.\n\n2.1 System\nIt removes noise."
    clean = "the quick brown fox\njumps over the lazy dog.\n\n- one\n- two"
    assert J.repair(clean, PAPER, 7) == clean and J.repair(None, PAPER, 7) is None


def test_parts():
    assert [numeral(x) for x in ("iv", "ix", "xii", "xl")] == [4, 9, 12, 40]
    assert letters("Proc. 5th A-B!") == "procthab"
    assert margin_lines(["a long line of text that goes on and", "12", "and ends here."], PAPER, 12) == {1: {"page_number"}}


def test_tables(spark):
    rnd = random.Random(0)
    words = sorted(w for w in VOCABULARY if "-" not in w and len(w) > 2)
    sentence = lambda: " ".join(rnd.choice(words) for _ in range(12))
    rows = [("t", i, "T", 1, sentence() + " " + sentence()) for i in range(300)]
    rows += [("t", 1000 + i, "T", i, f"{sentence()}\nAnnals Of Careful Reading\n{sentence()}") for i in range(8)]
    rows += [("t", 2000, "T", 3, "tbe qnick brovvn fox docu-\nments"), ("t", 2001, None, None, None), ("t", 2002, "T", 3, " "), ("t", 2000, "T", 3, "tbe qnick brovvn fox docu-\nments")]
    rows.append(("t", 2003, None, None, " ".join(sentence() for _ in range(3000))))
    texts = spark.createDataFrame(rows, "table_name string, row_key long, paper string, page int, text string")
    papers = spark.createDataFrame([("T", "Ada Smith"), (None, "x")], "paper_title string, authors string")
    got = sorted((r.row_key, r.noise) for r in scan_noise(texts, papers).collect())
    assert got == sorted([(1000 + i, "running_header") for i in range(8)] + [(2000, "hyphenation"), (2000, "misread")] * 2)
    fixed = {r.row_key: (r.repaired, r.text) for r in repaired_texts(texts, papers).collect()}
    assert len(fixed) == 311 - 0 and fixed[2000] == (True, "the quick brown fox documents")
    assert all(not fixed[i][0] and fixed[i][1] == rows[i][4] for i in range(300))
    assert scan_noise(texts.limit(0), papers).count() == 0


def test_page_edges():
    assert kinds("the quick brown fox jumps.\nThe dog is lazy.\nAda Smith\nThe fox jumps.\nThe dog is lazy.") == set()  # a name in mid-page
    assert kinds("the quick brown fox jumps.\nThe dog\nAda Smith\nis lazy because the\nfox jumps.") == {"running_header"}
    assert kinds("Ada Smith\nThe quick brown fox jumps.\nThe dog is lazy.\nThe fox jumps.") == {"running_header"}


def test_skeletons_and_sequences():
    assert skeleton("Annals of Modern Reading  12") == skeleton("Anna1s 0f Moclern Reacling  14") != skeleton("Annals of Ancient Reading")
    off = Paper("T", None, frozenset(), frozenset({100}))
    lines = ["a long line of text that goes on and", "112", "and ends here."]
    assert margin_lines(lines, off, 12) == {1: {"page_number"}} and margin_lines(lines, PAPER, 12) == {}


def scans(spark, copies):
    rnd = random.Random(1)
    words = sorted(w for w in VOCABULARY if "-" not in w and len(w) > 2)
    sentence = lambda: " ".join(rnd.choice(words) for _ in range(12))
    rows = [("t", i, f"P{i % 7}", 1, sentence() + ".\n" + sentence()) for i in range(150 * copies)]
    own = random.Random(2)
    pages = [(f"{own.choice(words)} tbe qnick brovvn {own.choice(words)}-\n{own.choice(words)} docu-\nments", 4), (f"the dog\nAnna1s Of Careful Reading\n{own.choice(words)} fox", 5)]
    pages += [(f"the dog and {own.choice(words)}\nAnnals Of Careful Reading\n{own.choice(words)} fox", p) for p in (6, 7, 8)]
    pages += [(f"the quick brown fox {own.choice(words)} over the\n{p + 30}\nlazy dog and {own.choice(words)} the fox", p) for p in (10, 11, 12)]
    rows += [("u", i, "Q", p, t) for i, (t, p) in enumerate(pages)]
    texts = spark.createDataFrame(rows, "table_name string, row_key long, paper string, page int, text string")
    return texts, spark.createDataFrame([("Q", "Ada Smith")], "paper_title string, authors string")


def test_same_result_in_a_larger_corpus_and_by_joins(spark, monkeypatch):
    import granary.llm.scan_noise as m

    got = lambda copies: sorted((r.row_key, r.noise) for r in scan_noise(*scans(spark, copies)).filter("table_name = 'u'").collect())
    few = got(1)
    assert few == [(0, "hyphenation"), (0, "misread"), (1, "running_header"), (2, "running_header"), (3, "running_header"), (4, "running_header"), (5, "page_number"), (6, "page_number"), (7, "page_number")]
    assert got(10) == few
    monkeypatch.setattr(m, "MAX_WORDS", 3)
    monkeypatch.setattr(m, "_BROADCAST_BYTES", 40)
    assert got(1) == few
