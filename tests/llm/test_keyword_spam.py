"""Keyword lists, links and tags against prose in several languages."""

import cProfile
import pstats
import random

import pytest

from granary.llm.keyword_spam import keyword_spam, word_labels

PROSE = "The committee met twice in the spring and agreed that the old bridge should be kept, although the cost of its repair was far above what the town had set aside for it. "
GERMAN = "Obwohl das Verfahren langsam ist, haben die Autoren es für alle Texte benutzt und jedes Ergebnis zweimal geprüft, weil der erste Versuch nicht genau genug war. "
RND = random.Random(0)
KEYS = "cheap buy online best price deal free download coupon review".split()
NOUNS = [a + b for a in ("stone", "river", "cloud", "table", "window", "engine", "garden", "paper") for b in ("s", "ware", "side", "top", "line", "work")]


def share(t):
    n, spam, _ = word_labels(t)
    return spam / max(1, n)


@pytest.mark.parametrize(
    "text",
    [
        " ".join(RND.choice(KEYS) for _ in range(120)),
        ", ".join(RND.choice(KEYS) for _ in range(80)),
        "Buy cheap blue shoes with cheap blue shoes. Get cheap blue shoes for the cheap blue shoes! " * 12,
        "\n".join(f"- [{RND.choice(NOUNS)} {RND.choice(NOUNS)}](https://www.site{i}.test/a/b-{i}.html)" for i in range(20)),
        "\n".join(f"Category: {RND.choice(NOUNS)} > {RND.choice(KEYS)} {RND.choice(NOUNS)} {i}" for i in range(25)),
        " ".join(f"#{a}" for a in NOUNS),
        "\n".join(f"{RND.choice(KEYS)} {RND.choice(NOUNS)} in Springfield" for _ in range(30)),
        "Home » " + " » ".join(RND.choice(NOUNS) for _ in range(60)),
        " ".join(RND.sample(NOUNS, 45)),
        '<a href="https://x.test/a">cheap stones</a> | <a href="https://x.test/b">cheap tables</a>\n' * 12,
    ],
)
def test_spam(text):
    assert share(text) > 0.5
    assert share(text.upper()) > 0.5


@pytest.mark.parametrize(
    "text",
    [
        PROSE * 4,
        GERMAN * 4,
        PROSE * 5 + "\n\nKeywords: " + ", ".join(NOUNS[:20]),
        PROSE * 5 + "\n" + "\n".join(f"[{i}] Smith, J. On the {NOUNS[i]} of {NOUNS[i + 1]}. {2000 + i}. https://x.test/{i}.pdf" for i in range(9)),
        "# Run 7\n\n" + PROSE + "\n\n| system | recall |\n| --- | --- |\n" + "\n".join(f"| {n} | {i}.5 |" for i, n in enumerate(NOUNS)),
        "```\n" + "\n".join(f"{n} = load({i})" for i, n in enumerate(NOUNS)) + "\n```\n" + PROSE,
        "The session counts here: a small session shapes any other session. " * 3 + PROSE,
        "",
        "cheap",
    ],
)
def test_not_spam(text):
    assert share(text) <= 0.5


def test_table(spark):
    spam = " ".join(RND.choice(KEYS) for _ in range(200))
    rows = [(1, spam, 1), (1, spam, 1), (2, PROSE * 3, 1), (3, None, 1), (4, "", 1), (5, "buy buy buy", 1), (6, (PROSE + " ") * 3000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words int")
    assert sorted(r.doc_id for r in keyword_spam(df, "doc_id", "text").collect()) == [1, 1]
    assert keyword_spam(df.limit(0), "doc_id", "text").count() == 0


PHRASE = "cheap wooden garden furniture and outdoor sofa sets for sale with free delivery in london"
SENTENCE = "Several researchers trained deep networks on large image collections and measured accuracy with great care. "


@pytest.mark.parametrize("text", [(PHRASE + " ") * 50, (PHRASE + ", ") * 6, PHRASE.join(["\n"] * 20), PROSE + (PHRASE + " ") * 12])
def test_long_phrases_repeated(text):
    n, spam, why = word_labels(text)
    assert spam > 0.5 * n and max(why, key=why.get) == "repetition"


@pytest.mark.parametrize("text", [PROSE * 30, GERMAN * 30, SENTENCE * 30, PHRASE + " " + PROSE * 3 + PHRASE + " " + PROSE * 3, "\n".join(f"{i} worker {i * 7} ended step {i * 3} of job {i * 5} after {i * 11} ms and {i * 13} rows" for i in range(40))])
def test_repeated_sentences_are_not_spam(text):
    assert share(text) <= 0.5


FINNISH = "Kaupunginhallitus päätti maanantaina, että vanhan sillan korjaus alkaa keväällä. Työt kestävät arviolta kaksi vuotta ja maksavat miljoonia euroja. Asukkaat toivovat kevyen liikenteen väylää, mutta rahoitus puuttuu vielä. Liikenne ohjataan kiertotielle koko rakennustyön ajaksi. Päätöksestä voi valittaa hallinto-oikeuteen. "
TURKISH = "Belediye meclisi pazartesi günü eski köprünün onarımına ilkbaharda başlanmasına karar verdi. Çalışmalar yaklaşık iki yıl sürecek ve milyonlarca liraya mal olacak. Mahalle sakinleri bisiklet yolu istiyor, ancak bütçe henüz yeterli değil. Trafik inşaat boyunca çevre yoluna yönlendirilecek. Karara itiraz etmek isteyenler mahkemeye başvurabilir. "
JAPANESE = "市議会は月曜日に古い橋の修理を春に始めることを決めました。工事には約二年かかり、数億円の費用が必要になる見込みです。住民は自転車道を求めていますが、予算はまだ足りません。工事中の交通は迂回路に誘導されます。 "
CHINESE = "市议会在星期一决定春天开始修理旧桥。工程大约需要两年，并且要花费数百万元。居民希望有自行车道，但是目前的预算还不够。施工期间的交通将被引导到绕行的道路上。 "


@pytest.mark.parametrize("text", [FINNISH, FINNISH * 4, TURKISH, TURKISH * 4, JAPANESE * 2, CHINESE * 2])
def test_prose_of_languages_without_word_lists(text):
    assert share(text) <= 0.5


@pytest.mark.parametrize(
    "text",
    [
        " ".join(RND.choice("halvat kengät laukut alennus ilmainen toimitus osta netistä kellot".split()) for _ in range(90)),
        ", ".join("saapas kenkä laukku kello sormus huivi hattu paita housu takki hame mekko sukka vyö reppu lompakko sateenvarjo käsine pipo neule".split()),
        " ".join(RND.choice("ucuz ayakkabı çanta indirim ücretsiz kargo saat online satın fiyat".split()) for _ in range(90)),
        " ".join(RND.choice("激安 バッグ 通販 財布 送料無料 ブランド 時計 人気".split()) for _ in range(60)),
        " ".join(RND.choice("便宜 鞋子 包包 打折 免费 手表 正品 网购".split()) for _ in range(60)),
    ],
)
def test_spam_of_languages_without_word_lists(text):
    assert share(text) > 0.5


def test_regular_gaps_over_long_spans():
    rnd = random.Random(3)
    keys = [f"key{i}word" for i in range(9)]
    text = " ".join(" ".join(k if rnd.random() < 0.9 else f"filler{rnd.randint(0, 10**6)}" for k in keys) + " " + " ".join(f"x{rnd.randint(0, 10**6)}y" for _ in range(rnd.randint(3, 5))) for _ in range(30))
    n, spam, why = word_labels(text)
    assert spam > 0.5 * n


def test_words_take_no_calls_of_their_own():
    text = "\n".join([PROSE * 3, " ".join(KEYS * 5), GERMAN, ", ".join(NOUNS)] * 20)
    words, _, _ = word_labels(text)
    profile = cProfile.Profile()
    profile.runcall(word_labels, text)
    assert pstats.Stats(profile).total_calls < words / 4  # 5.2 a word where each was looked up and counted by itself


def test_texts_in_company_are_judged_as_alone(spark):
    rnd = random.Random(5)
    parts = [PROSE, GERMAN, FINNISH, JAPANESE, PHRASE, "", "...", "!", " ".join(KEYS), ", ".join(NOUNS), "```\ncode here\n", "| a | b |\n", "#x #y #z", "https://x.test/a www.y.test", "Smith, J. On stones. 2004. https://x.test/4.pdf"]
    texts = ["\n".join(rnd.choices(parts, k=rnd.choice([0, 1, 2, 3]))) * rnd.choice([1, 1, 2, 6]) for _ in range(900)]
    alone = [(i, *word_labels(t)) for i, t in enumerate(texts)]
    expected = {(i, n, spam, max(why, key=lambda k: (why[k], k))) for i, n, spam, why in alone if spam > 0.5 * n and (n >= 20 or why.get("links", 0) >= 5)}
    got = keyword_spam(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "doc_id", "text").collect()
    assert len(expected) > 50 and len(got) == len(expected) and {tuple(r) for r in got} == expected
