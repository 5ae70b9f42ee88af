import pytest

from lexifix.operators.dictionary import bigrams_from_corpus, from_corpus
from lexifix.sources.dictionary_files import load_bigrams, load_dictionary, save_dictionary


def test_dictionary_file(spark, tmp_path):
    path = tmp_path / "d.txt"
    path.write_text('the 10\r\nquick 5\n\nlonely\nthe 3 extra\n"quoted" 2\nbad x\nŁąka 1\n', encoding="utf-8")
    got = {r.term: r["count"] for r in load_dictionary(spark, str(path)).collect()}
    assert got == {"the": 13, "quick": 5, '"quoted"': 2, "Łąka": 1}
    with pytest.raises(Exception, match="bad dictionary line"):
        load_dictionary(spark, str(path), mode="failfast").collect()


def test_columns_and_separator(spark, tmp_path):
    path = tmp_path / "d.txt"
    path.write_text("7|the|x\n8|a.b|y\n9|z\n", encoding="utf-8")
    assert {r.term: r["count"] for r in load_dictionary(spark, str(path), 1, 0, "|").collect()} == {"the": 7, "a.b": 8, "z": 9}


def test_bigrams_keep_the_last(spark, tmp_path):
    path = tmp_path / "b.txt"
    path.write_text("of the 9\nin the 5\nof the 7\nof the\n", encoding="utf-8")
    got = {r.bigram: (r["count"], r.low) for r in load_bigrams(spark, str(path)).collect()}
    assert got == {"of the": (7, 7), "in the": (5, 5)}
    tabbed = tmp_path / "t.txt"
    tabbed.write_text("of the\t9\nof the\t2\n", encoding="utf-8")
    assert [tuple(r) for r in load_bigrams(spark, str(tabbed), 0, 1, "\t").collect()] == [("of the", 2, 2)]


def test_save_and_load(spark, tmp_path):
    words = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "term string, count long")
    save_dictionary(words, str(tmp_path / "out"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).split()
    assert lines == ["c", "9", "a", "2", "b", "2"]
    assert {tuple(r) for r in load_dictionary(spark, str(tmp_path / "out")).collect()} == {("a", 2), ("b", 2), ("c", 9)}


def test_corpus(spark):
    docs = spark.createDataFrame([("The cat, the CAT!",), (None,), ("",)], "text string")
    assert {tuple(r) for r in from_corpus(docs).collect()} == {("the", 2), ("cat", 2)}
    assert {tuple(r) for r in bigrams_from_corpus(docs).collect()} == {("the cat", 2), ("cat the", 1)}
