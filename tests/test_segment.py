import random

import pytest
from model import Model

from lexifix.operators.dictionary import Dictionary
from lexifix.operators.segment import word_segmentation
from lexifix.plans.config import Config

WORDS = {w: 1000 + 37 * i for i, w in enumerate("the quick brown fox jumps over lazy dog it was best of times age a i glasses contents".split())}


def run(spark, texts, k, words=WORDS):
    d = Dictionary.build(spark.createDataFrame(list(words.items()), "term string, count long"), Config(1))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, input string")
    return word_segmentation(df, d, k).orderBy("id").collect()


@pytest.mark.parametrize("k", [0, 1])
def test_same_as_brute_force(spark, k):
    rnd, names = random.Random(k), list(WORDS)
    texts = ["thequickbrownfoxjumpsoverthelazydog", "it was-thebest", "glasses’contents,which", "scientiﬁc", "a", "?", "  the  dog"]
    for _ in range(12):
        text = "".join(rnd.choice(names) for _ in range(rnd.randint(1, 5)))
        i = rnd.randrange(len(text))
        texts.append(rnd.choice([text, text[:i] + text[i + 1 :], text[:i] + " " + text[i:]]) or "a")
    model = Model(WORDS)
    for text, r in zip(texts, run(spark, texts, k)):
        want = model.segment(text, k)
        got = r.segmented_string.lower() if k else r.segmented_string
        assert (got, r.distance_sum) == (want[0].lower() if k else want[0], want[1]), text
        assert r.prob_log_sum == pytest.approx(want[2])


def test_goldens(spark):
    texts = ["thequickbrownfoxjumpsoverthelazydog", "THEQUICKBROWNFOXJUMPSOVERTHELAZYDOG", "THFQUICKBROWNFOXJUMPSOVERTHELAZYDOG"]
    assert [r.segmented_string for r in run(spark, texts, 1)] == ["the quick brown fox jumps over the lazy dog"] + ["THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG"] * 2
    zh = {"部分": 50, "居民": 40, "生活": 60, "水平": 30}
    assert run(spark, ["部分居民生活水平"], 0, zh)[0].segmented_string == "部分 居民 生活 水平"


def test_empty(spark):
    got = run(spark, ["", "-", None], 1)
    assert [tuple(r)[2:] for r in got] == [("", 0, 0.0), ("", 0, 0.0), (None, None, None)]
    assert Dictionary.build(spark.createDataFrame([], "term string, count long"), Config(1)).max_term_length == 0


def test_long_text_and_long_unknown_parts(spark):
    words = {**WORDS, "x" * 310: 5}
    got = run(spark, ["q" * 321, "thedog" * 400], 0, words)
    assert got[0].distance_sum == 322 and got[0].prob_log_sum < -300
    assert got[1].segmented_string == " ".join(["the dog"] * 400)
