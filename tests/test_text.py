import random

import pytest
from model import osa as plain_osa
from pyspark.sql import functions as F

from lexifix.functions.text import deletes, nfkc, osa, register, tokens, transfer_case


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_osa_against_the_table(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7)))
    data = [(word(), word()) for _ in range(400)] + [("ca", "abc"), ("Łą", "Ła"), ("bank", "bnak")]
    for r in rows(spark, data, "a string, b string").select("a", "b", osa("a", "b").alias("d"), osa("a", "b", 2).alias("near")).collect():
        want = plain_osa(r.a, r.b)
        assert r.d == want
        assert r.near == (want if want <= 2 else None)


def test_osa_limits(spark):
    near, far = ("bank", ["bnak", "bink"]), ("bank", ["kanb", "xban", "baxn"])
    data = [(near[0], b, True) for b in near[1]] + [(far[0], b, False) for b in far[1]]
    for r in rows(spark, data, "a string, b string, ok boolean").select("ok", osa("a", "b", 1).alias("d")).collect():
        assert (r.d is not None) == r.ok


@pytest.mark.parametrize(
    ("source", "target", "result"),
    [
        ("LEG MOZE OZNACZAC LAKE W POBLIZU RZEKI", "Łęg może oznaczać łąkę w pobliżu rzeki (łąka łęgowa)", "ŁĘG MOŻE OZNACZAĆ ŁĄKĘ W POBLIŻU RZEKI (ŁĄKA ŁĘGOWA)"),
        ("LEG MOZE OZNACZAC LAKE W POBLIZU RZEKI (ŁĄKA ŁĘGOWA)", "Łęg może oznaczać łąkę w pobliżu rzeki (łąka łęgowa)", "ŁĘG MOŻE OZNACZAĆ ŁĄKĘ W POBLIŻU RZEKI (ŁĄKA ŁĘGOWA)"),
        ("HeLLo WoRLd!", "rustacean community!", "RuSTacEaN community!"),
        ("Hous", "house", "House"),
        ("HOUSE", "house", "HOUSE"),
        ("", "x", "x"),
        ("X", "", ""),
    ],
)
def test_transfer_case(spark, source, target, result):
    assert rows(spark, [(source, target)], "s string, t string").select(transfer_case("s", "t")).first()[0] == result


def test_tokens(spark):
    data = [("a 'b c",), ("_x y",), ("Don’t, STOP_it 4ever",), ("",), (None,)]
    got = [(r.t, r.c) for r in rows(spark, data, "x string").select(tokens(F.col("x")).alias("t"), tokens(F.col("x"), True).alias("c")).collect()]
    assert got[0] == (["a", "'b", "c"], ["a", "a 'b", "c"])
    assert got[1] == (["_x", "y"], ["_x", "y"])
    assert got[2] == (["don’t", "stop_it", "4ever"],) * 2
    assert got[3] == ([], [])
    assert got[4] == (None, None)


def plain_deletes(word, k, p):
    level, out = {word[:p]}, {word[:p]}
    for _ in range(k):
        level = {w[:i] + w[i + 1 :] for w in level if len(w) > 1 for i in range(len(w))}
        out |= level
    return out | ({""} if len(word) <= k else set())


def test_deletes(spark):
    words = ["house", "a", "", "aaa", "abcdefghij", "łąk"]
    df = rows(spark, [(w,) for w in words], "w string")
    for k in (0, 1, 2, 3):
        for w, got in zip(words, df.select(deletes("w", k, 7).alias("d")).collect()):
            assert sorted(got.d) == sorted(plain_deletes(w, k, 7))


def test_nfkc(spark):
    got = rows(spark, [("scientiﬁc",), (None,), ("ｆｕｌｌ",)], "x string").select(nfkc(F.col("x")).alias("x")).collect()
    assert [r.x for r in got] == ["scientific", None, "full"]


def test_sql_function(spark):
    register(spark)
    assert spark.sql("SELECT lexifix_osa('ca', 'abc')").first()[0] == 3
    assert spark.sql("SELECT lexifix_transfer_case('HeLLo WoRLd!', 'rustacean community!')").first()[0] == "RuSTacEaN community!"
