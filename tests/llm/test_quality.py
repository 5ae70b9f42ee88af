import itertools

import numpy as np
import pytest
from helpers import no_docs, odd_docs, odd_rows, prose

from lexifix.llm import line_rules
from lexifix.llm.line_crf import LineCrf, N_FEATURES, fit, good_documents, line_features, train, with_score
from lexifix.llm.line_rules import clean_documents, quality_rules

FURNITURE = "Home | About | Contact"


def hosts():
    rows = [(i, f"{FURNITURE}\n{prose(60, i)}", "en", "big", 0) for i in range(30)]
    rows += [(100 + i, "\n".join([FURNITURE] * 40) + "\n" + prose(55, 100 + i)[:250], "en", "big", 0) for i in range(3)]
    rows += [(200 + i, f"{FURNITURE}\n{prose(60, 200 + i)}", "en", "small", 0) for i in range(3)]
    rows += [(300 + i, prose(90, 300), "en", "copies", 0) for i in range(50)]
    return rows


def test_frequent_lines(spark):
    df = spark.createDataFrame(hosts(), "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r.doc_id: r for r in quality_rules(df).select("_row.doc_id", "kept", "base_failed", "_kept_text").collect()}
    assert rows[0]._kept_text.startswith(FURNITURE)  # the first document keeps the line
    assert all(FURNITURE not in rows[i]._kept_text and rows[i].kept for i in range(1, 30))
    assert all(not rows[100 + i].kept for i in range(3))
    assert all(FURNITURE in rows[200 + i]._kept_text for i in range(3))  # too few documents to tell
    assert all(rows[300 + i].kept for i in range(50))  # equal texts are one document
    few = quality_rules(df, min_docs=2, max_share=0.01, min_left=0.99)
    assert few.where("kept").count() < 60
    kept = clean_documents(df)
    assert kept.columns == df.columns
    assert {r.n_chars for r in kept.where("doc_id = 1").collect()} == {len(prose(60, 1))}


def test_frequent_lines_beyond_the_broadcast_limit(spark, monkeypatch):
    df = spark.createDataFrame(hosts(), "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda d: sorted((r.doc_id, r.kept, r._kept_text) for r in d.select("_row.doc_id", "kept", "_kept_text").collect())
    want = key(quality_rules(df))
    for limit in ("BROADCAST_HOSTS", "HOST_LINES"):
        with monkeypatch.context() as m:
            m.setattr(line_rules, limit, 0)
            assert key(quality_rules(df)) == want


def test_odd_documents(spark):
    for extra in (False, True):
        df = odd_docs(spark, extra)
        rows = quality_rules(df).select("_row", "n_words", "n_symbols", "n_dup_lines", "kept").collect()
        assert len(rows) == len(odd_rows())
        by_id = {r._row.doc_id: r for r in rows}
        assert (by_id[3].n_words, by_id[4].n_words, by_id[6].n_words, by_id[6].n_dup_lines) == (0, 0, 0, 0)
        assert by_id[1].kept and not by_id[3].kept and by_id[8].n_symbols == 4
        assert clean_documents(df).columns == df.columns
    assert clean_documents(no_docs(spark)).count() == 0


def plain_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(twice)


def test_repeated_windows(spark):
    texts = ["a b c a b c a", "a a a a", "a b", "x y z", "a b c d a b c", "q " * 60, " lead a b c\ta b c "]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules(df).select("_row.doc_id", "n_repeat_words").collect()}
    assert got == {i: plain_repeats(t.split()) for i, t in enumerate(texts)}


def brute_marginals(model, features):
    score = features @ model.weights
    total, good = 0.0, np.zeros(len(features))
    for labels in itertools.product((0, 1), repeat=len(features)):
        s = sum(score[i] for i, y in enumerate(labels) if y) + sum(model.transitions[a, b] for a, b in zip(labels, labels[1:]))
        total += np.exp(s)
        good += np.exp(s) * np.array(labels)
    return good / total


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    model = LineCrf(rng.normal(size=N_FEATURES), rng.normal(size=(2, 2)))
    for n in (1, 2, 6):
        features = rng.normal(size=(n, N_FEATURES))
        assert model.marginals(features) == pytest.approx(brute_marginals(model, features))


def labelled(n=60):
    rows = []
    for i in range(n):
        good = i % 2
        text = prose(50, i) + "\n" + prose(30, i + 1) + "." if good else "\n".join(["BUY!! NOW!! " * 10, prose(5, i).upper()])
        rows.append((i, text, "en", "s", 0, good))
    return rows


def test_training_and_bounds(spark):
    rows = labelled()
    df = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id long, quality int")
    model = train(df, labels)
    got = {r.doc_id: r.score for r in with_score(df, model).collect()}
    assert all((got[r[0]] >= 0.5) == bool(r[5]) for r in rows)
    kept = good_documents(odd_docs(spark, True), model)
    assert kept.columns == odd_docs(spark, True).columns
    scores = [r.score for r in with_score(odd_docs(spark), model).collect()]
    assert len(scores) == len(odd_rows()) and all(0 <= s <= 1 for s in scores)
    assert with_score(no_docs(spark), model).count() == 0


def test_mixed_documents_have_both_labels():
    """Trained on documents' labels only, the field tells good lines from bad ones inside a document."""
    good = lambda i: "\n".join(prose(12 + k, 7 * i + k) + "." for k in range(2 + i % 5))
    bad = lambda i: "\n".join(["BUY!! NOW!! $$$ " * (2 + k) for k in range(2 + i % 5)])
    model = fit([(*line_features(f(i)), y) for i in range(80) for y, f in ((0, bad), (1, good))])
    for i in range(100, 110):
        features, _ = line_features(good(i) + "\n" + bad(i))
        n = len(good(i).split("\n"))
        marginals = model.marginals(features)
        assert marginals[:n].mean() > 0.8 and marginals[n:].mean() < 0.2
        assert model.score(good(i)) > 0.9 > 0.1 > model.score(bad(i))


def test_training_sample_is_bounded(spark):
    rows = [(i % 40, f"{prose(20, i % 40)}.\n{prose(9, i % 40)}.") for i in range(400)] + [(50, "X X X\n" * 500), (51, "X! X! X!\n" * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i // 50) for i in range(60)] + [(1, 7), (None, 1)], "doc_id long, quality int")
    seen = []
    import lexifix.llm.line_crf as module

    original = module.fit
    module.fit = lambda docs: seen.append(docs) or original(docs)
    try:
        train(docs, labels, n_docs=10, folds=1000)
    finally:
        module.fit = original
    assert sorted(d[2] for d in seen[0]) == [0] + [1] * 10  # repeated rows once, the text of 500 lines not


def test_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = train(odd_docs(spark), labels)
    assert {r.score for r in with_score(odd_docs(spark), model).collect()} == {0.5}
    assert good_documents(odd_docs(spark), model).count() == len(odd_rows())
    assert fit([(*line_features("a b"), 1)]).score("x") > 0.5
