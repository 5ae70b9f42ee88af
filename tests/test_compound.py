import random

import pytest
from model import N, Model

from lexifix.operators.compound import lookup_compound
from lexifix.operators.dictionary import Dictionary
from lexifix.plans.config import Config

WORDS = {"where": 500, "is": 1000, "the": 5000, "love": 300, "he": 900, "had": 400, "a": 9000, "dated": 50, "for": 3000, "house": 100, "can": 700, "you": 800, "read": 200, "this": 900, "there": 70}
BIGRAMS = {"where is": 40, "the love": 30, "he had": 20, "read this": 15, "can you": 60}


def build(spark, bigrams):
    words = spark.createDataFrame([(t, c * 1_000_000) for t, c in WORDS.items()], "term string, count long")
    pairs = spark.createDataFrame(list(BIGRAMS.items()), "bigram string, count long") if bigrams else None
    return Dictionary.build(words, Config(2), pairs), Model({t: c * 1_000_000 for t, c in WORDS.items()}, BIGRAMS if bigrams else None)


@pytest.mark.parametrize("bigrams", [False, True])
def test_same_as_brute_force(spark, bigrams):
    d, model = build(spark, bigrams)
    rnd, names = random.Random(5), list(WORDS)
    texts = ["whereis th elove", "hehad readthis", "xqzw", "a", "q", "th ere", "", "!?", "can yu, readthis?"]
    for _ in range(25):
        text = " ".join(rnd.choice(names) for _ in range(rnd.randint(1, 5)))
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(text) + 1)
            text = rnd.choice([text[:i] + text[i + 1 :], text[:i] + " " + text[i:], text[:i] + rnd.choice("xaeh") + text[i:]])
        texts.append(text)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, input string")
    got = lookup_compound(df, d, 2).orderBy("id").collect()
    assert [(r.term, r.distance, r["count"]) for r in got] == [model.compound(t, 2) for t in texts]


def test_shape(spark):
    d, _ = build(spark, True)
    df = spark.createDataFrame([(1, "WHEREIS TH ELOVE"), (1, "WHEREIS TH ELOVE"), (2, None), (3, ""), (4, "..")], "id long, input string")
    got = sorted(map(tuple, lookup_compound(df, d, 2, preserve_case=True).collect()), key=str)
    assert [g[2] for g in got] == ["WHERE IS THE LOVE", "WHERE IS THE LOVE", None, "", ""]
    assert got[3][3:] == (0, N) and got[4][3:] == (2, N)


def test_long_text(spark):
    """A text of 20,000 words, and a word longer than a power of ten has digits for."""
    d, _ = build(spark, True)
    rnd, names = random.Random(3), list(WORDS)
    text = " ".join(w + "x" if k % 50 == 0 else w for k, w in enumerate(rnd.choices(names, k=20_000)))
    df = spark.createDataFrame([(1, text), (2, "q" * 700)], "id long, input string")
    got = {r.id: r for r in lookup_compound(df, d, 2).collect()}
    assert 380 <= got[1].distance <= 420 and len(got[1].term.split()) >= 19_900
    assert (got[2].term, got[2].distance) == ("q" * 700, 0)
