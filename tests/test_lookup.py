import random

import pytest
from model import Model

from lexifix.operators.dictionary import Dictionary, merge, stats
from lexifix.operators.lookup import lookup, unknown
from lexifix.plans.config import Config


def words_df(spark, words):
    return spark.createDataFrame(list(words.items()), "term string, count long")


def inputs_df(spark, inputs):
    return spark.createDataFrame(list(enumerate(inputs)), "id long, input string")


def random_words(rnd, n, letters, longest):
    return {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, longest))): rnd.randint(1, 50) for _ in range(n)}


@pytest.mark.parametrize(("k", "prefix", "letters"), [(1, 5, "abc"), (2, 7, "ab"), (3, 7, "abcd")])
def test_same_as_brute_force(spark, k, prefix, letters):
    rnd = random.Random(k)
    words = random_words(rnd, 120, letters, 12)
    inputs = [*random_words(rnd, 40, letters, 14), "", "A", "xyz"]
    d, model = Dictionary.build(words_df(spark, words), Config(k, prefix_length=prefix)), Model(words)
    for verbosity in ("top", "closest", "all"):
        want = [(i, t, n, c) for i, x in enumerate(inputs) for t, n, c in model.lookup(x, verbosity, k)]
        got = lookup(inputs_df(spark, inputs), d, verbosity, k).orderBy("id", "rank").collect()
        assert [(r.id, r.term, r.distance, r["count"]) for r in got] == want
    few = lookup(inputs_df(spark, inputs), d, "all", k, max_results=2).collect()
    assert len(few) == sum(min(2, len(model.lookup(x, "all", k))) for x in inputs)
    assert lookup(inputs_df(spark, inputs), d, "all", k, max_results=0).count() == 0
    lost = {r.input for r in unknown(inputs_df(spark, inputs), d, k).collect()}
    assert lost == {x for x in inputs if not model.lookup(x, "top", k)}


def test_thresholds_and_stubs(spark):
    rnd = random.Random(9)
    words = random_words(rnd, 150, "abc", 11)
    inputs = list(random_words(rnd, 50, "abc", 12))
    config = Config(1, thresholds=(3, 8), count_threshold=10)
    d, model = Dictionary.build(words_df(spark, words), config), Model(words, count_threshold=10, thresholds=(3, 8))
    for thresholds in (None, (4, 9)):
        got = lookup(inputs_df(spark, inputs), d, "all", 1, thresholds).orderBy("id", "rank").collect()
        want = [(i, *f) for i, x in enumerate(inputs) for f in model.lookup(x, "all", 1, thresholds)]
        assert [(r.id, r.term, r.distance, r["count"]) for r in got] == want


def test_below_threshold_terms_match_exactly_only(spark):
    d = Dictionary.build(words_df(spark, {"rare": 1, "common": 9}), Config(1, count_threshold=5))
    got = lookup(inputs_df(spark, ["rare", "rara", "comon"]), d, "all", 1).orderBy("id").collect()
    assert [(r.input, r.term) for r in got] == [("rare", "rare"), ("comon", "common")]
    assert d.size() == 2


def test_case_and_ties(spark):
    d = Dictionary.build(words_df(spark, {"house": 5, "mouse": 5, "Paris": 3}), Config(2))
    got = lookup(inputs_df(spark, ["HOUSE", "Xouse", None, "paris"]), d, "closest", 2, preserve_case=True).orderBy("id", "rank").collect()
    want = [("HOUSE", "HOUSE", 0), ("Xouse", "House", 1), ("Xouse", "Mouse", 1), ("paris", "paris", 1)]
    assert [(r.input, r.term, r.distance) for r in got] == want


def test_errors(spark):
    d = Dictionary.build(words_df(spark, {"a": 1}), Config(1))
    for k, thresholds in ((2, None), (1, (2, 4)), (1, ()), (-1, None)):
        with pytest.raises(ValueError):
            lookup(inputs_df(spark, ["a"]), d, "all", k, thresholds)
    for bad in ({"thresholds": ()}, {"thresholds": (5, 2)}, {"max_edit_distance": 7}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_empty_dictionary(spark):
    d = Dictionary.build(spark.createDataFrame([], "term string, count long"), Config(2))
    assert lookup(inputs_df(spark, ["a", ""]), d).count() == 0


def test_merge_saturates(spark):
    top = 9223372036854775807
    got = merge(words_df(spark, {"a": top, "b": 1}), words_df(spark, {"a": 5, "c": 2}))
    assert {r.term: r["count"] for r in got.collect()} == {"a": top, "b": 1, "c": 2}


def test_stats_and_saving(spark, tmp_path):
    words = words_df(spark, {"house": 5, "a": 1, "longestterm": 1})
    assert tuple(stats(words, Config(1, count_threshold=2)).first()) == (3, 7, 5)
    bigrams = spark.createDataFrame([("a b", 4)], "bigram string, count long")
    Dictionary.build(words, Config(2), bigrams).save(str(tmp_path))
    d = Dictionary.load(spark, str(tmp_path))
    assert (d.config, d.max_term_length, d.bigram_min_count, d.size()) == (Config(2), 11, 4, 3)
    assert lookup(inputs_df(spark, ["hose"]), d).first().term == "house"
