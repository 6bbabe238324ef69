"""Leaked passages: planted with edits, against decoys."""

import random

from granary.llm.leakage import PassageIndex, leaked_items, normal_words, without_leaks, words_alone

WORDS = [f"w{i}x" for i in range(3000)]


def passages(n=30, seed=0):
    rnd = random.Random(seed)
    return [(i, "The system that we call " + " ".join(rnd.choice(WORDS) for _ in range(60)) + " and so on.") for i in range(n)]


def test_planted_excerpts_are_found():
    rnd = random.Random(1)
    ps = passages()
    index = PassageIndex(ps, 14)
    for trial in range(60):
        item, text = rnd.choice(ps)
        ws = text.split()
        size = rnd.choice([18, 24, 40])
        at = rnd.randrange(0, len(ws) - size)
        cut = ws[at : at + size]
        for k in range(3, size - 3, 7):  # one word in seven changed, added or dropped
            kind = rnd.randrange(3)
            cut[k] = ["zzz", cut[k] + " zzz", ""][kind]
        body = " ".join(cut).upper() if trial % 3 == 0 else "\n".join(" ".join(cut[i : i + 5]) for i in range(0, size, 5))
        doc = " ".join(rnd.choice(WORDS) for _ in range(200)) + " " + body + " " + " ".join(rnd.choice(WORDS) for _ in range(50))
        assert item in {x[0] for x in index.leaks(doc, 14, 1 / 6)}, (trial, cut)


def test_short_phrases_are_not_leaks():
    ps = passages()
    index = PassageIndex(ps, 14)
    rnd = random.Random(2)
    for item, text in ps:
        ws = text.split()
        doc = " ".join(rnd.choice(WORDS) for _ in range(50)) + " " + " ".join(ws[10:19]) + " " + " ".join(rnd.choice(WORDS) for _ in range(50))
        assert not index.leaks(doc, 14, 1 / 6)
        assert not index.leaks("The system that we call something else and so on. " * 5, 14, 1 / 6)


def test_divided_words_and_marks():
    assert normal_words("Foot-\nball, na\xadive Café\r\nDON'T")[0] == ["football", "naive", "cafe", "don", "t"]
    for t in ("Foot-\nball, na\xadive Café\r\nDON'T", "a-\n\n b\xad c \xad d İstanbul-\nX 3-\n4 - \n", "", "—"):
        assert words_alone(t) == normal_words(t)[0]
    ps = passages(5)
    text = ps[2][1].replace("w", "W")
    broken = "".join(c if i % 37 or not c.isalpha() else c + "-\n" for i, c in enumerate(text))
    assert 2 in {x[0] for x in PassageIndex(ps, 14).leaks(broken, 14, 1 / 6)}


def test_table_and_removal(spark, monkeypatch):
    import granary.llm.leakage as m

    ps = passages(6)
    items = spark.createDataFrame([(i, t, None) for i, t in ps] + [(77, None, "short one")], "item_id long, gold string, answer string")
    doc = f"before it {ps[3][1]} after it {ps[4][1]} end"
    docs = spark.createDataFrame([(1, doc, 5), (1, doc, 5), (2, "nothing here", 5), (3, None, 5), (4, "", 5)], "doc_id long, text string, item_id int")
    whole = sorted((r.doc_id, r.item_id) for r in leaked_items(docs, "doc_id", "text", items, "item_id", ["gold", "answer"]).collect())
    assert whole == [(1, 3), (1, 3), (1, 4), (1, 4)]
    monkeypatch.setattr(m, "GRAMS", 70)  # slices of the test set, one scan each
    assert sorted((r.doc_id, r.item_id) for r in leaked_items(docs, "doc_id", "text", items, "item_id", ["gold", "answer"]).collect()) == whole
    clean = without_leaks(docs.dropDuplicates(["doc_id"]), "doc_id", "text", leaked_items(docs, "doc_id", "text", items, "item_id", ["gold"])).collect()
    assert len(clean) == 1 and clean[0].leaked_items == 2 and "w" not in clean[0].clean_text.replace("before it", "")
    assert leaked_items(docs, "doc_id", "text", items.limit(0), "item_id", ["gold"]).count() == 0
    assert leaked_items(docs.limit(0), "doc_id", "text", items, "item_id", ["gold"]).count() == 0


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def test_a_passage_of_many_items_leaks_them_all():
    rnd = random.Random(4)
    common = prose(rnd, 30)
    for items in (200, 1000):
        ps = [(i, prose(rnd, 40) + " " + common if i < 10 else prose(rnd, 40)) for i in range(items)]
        assert {x[0] for x in PassageIndex(ps, 14).leaks(common, 14, 1 / 6)} == set(range(10))
    ps = [(i, common) for i in range(50)]
    assert {x[0] for x in PassageIndex(ps, 14).leaks("so " + common, 14, 1 / 6)} == set(range(50))


def test_every_span_is_reported_and_removed(spark):
    rnd = random.Random(5)
    gold, answer = prose(rnd, 40), prose(rnd, 30)
    doc = f"first {gold} then {answer} and again {gold} end"
    got = PassageIndex([(1, gold), (1, answer)], 14).leaks(doc, 14, 1 / 6)
    assert [x[0] for x in got] == [1, 1, 1]
    items = spark.createDataFrame([(1, gold, answer)], "item_id long, gold string, answer string")
    docs = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    leaks = leaked_items(docs, "doc_id", "text", items, "item_id", ["gold", "answer"])
    assert without_leaks(docs, "doc_id", "text", leaks).first().clean_text.split() == "first then and again end".split()


def test_edits_anywhere_within_one_in_six():
    rnd = random.Random(6)
    ps = [(i, prose(rnd, 50)) for i in range(5)]
    index = PassageIndex(ps, 14)
    for size, wrong in ((14, 0), (16, 2), (18, 3), (24, 4)):
        for _ in range(200):
            cut = ps[2][1].split()[10 : 10 + size]
            for k in rnd.sample(range(size), wrong):
                cut[k] = "zzz"
            first, last = next(k for k in range(size) if cut[k] != "zzz"), max(k for k in range(size) if cut[k] != "zzz")
            if last - first + 1 == size:
                assert 2 in {x[0] for x in index.leaks(prose(rnd, 30) + " " + " ".join(cut) + " " + prose(rnd, 30), 14, 1 / 6)}
