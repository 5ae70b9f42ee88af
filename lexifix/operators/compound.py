"""Correction of multi-word text with wrongly inserted or missing spaces."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import effective_distance, osa, tokens, transfer_case
from ..plans.config import Verbosity
from ..plans.shipping import ensure_shipped
from ..plans.storage import written
from .dictionary import Dictionary
from .lookup import suggest

#: Greatest count that a product of shares may give.
_MOST = 9.2e18


def _top(strings: DataFrame, d: Dictionary, k: int, thresholds: tuple[int, ...] | None, reach: int, *bound: str) -> DataFrame:
    """(w, hit) of the distinct strings (column ``w``) that have a best suggestion; hit: term, distance, count.

    ``bound``: a column of further limits on the distance, which is part of the key then.
    """
    allowed = effective_distance(F.length("w"), k, thresholds)
    q = strings.select("w", *bound).distinct().where(F.length("w") - allowed <= d.max_term_length)
    q = q.select("w", *bound, F.lower("w").alias("q"), F.least(allowed, *bound).alias("k") if bound else allowed.alias("k"))
    found = suggest(q.select("q", "k").distinct(), d, Verbosity.TOP, reach, checked=True)
    return q.join(found, ["q", "k"]).select("w", *bound, F.struct("term", "distance", "count").alias("hit"))


def _exact(strings: DataFrame, d: Dictionary, k: int, thresholds: tuple[int, ...] | None) -> DataFrame:
    """As ``_top``, of the strings that are terms themselves."""
    q = strings.select("w").distinct().where(F.length("w") - effective_distance(F.length("w"), k, thresholds) <= d.max_term_length)
    found = q.join(d.words, F.lower("w") == d.words["term"])
    return found.select("w", F.struct("term", F.lit(0).alias("distance"), "count").alias("hit"))


def whole(value: Column) -> Column:
    """A double to a 64-bit number: towards zero, at most the greatest."""
    return F.least(value, F.lit(_MOST)).cast("bigint")


def unknown_count(word: Column) -> Column:
    """What a word without suggestion counts for: ten over ten to its length."""
    return whole(F.lit(10.0) / F.pow(F.lit(10.0), F.length(word)))


def best_splits(words: DataFrame, d: Dictionary, k: int, thresholds: tuple[int, ...] | None, reach: int) -> DataFrame:
    """(w, part) for words (w, hit; hit may be null): the word's best suggestion, or the best pair of suggestions for
    two parts of it: smallest distance, then greatest count, then the earliest split, unsplit first."""
    cuts = words.where(F.length("w") > 1).select("w", "hit", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("j"))
    cuts = cuts.select("w", "hit", "j", F.expr("substr(w, 1, j)").alias("a"), F.expr("substr(w, j + 1)").alias("b"))
    # a pair has a space that the word lacks: against a suggestion at distance 1 only the word's own exact parts count
    one = F.coalesce(F.col("hit.distance") == 1, F.lit(False))
    sides = cuts.select(F.explode(F.array("a", "b")).alias("w"), one.alias("one"))
    near = _top(sides.where(~F.col("one")), d, k, thresholds, reach).select("w", F.lit(False).alias("one"), "hit")
    parts = near.unionByName(_exact(sides.where("one"), d, k, thresholds).select("w", F.lit(True).alias("one"), "hit"))
    parts = written(parts, "part-hits")
    cuts = cuts.withColumn("one", one)
    left = parts.select(F.col("w").alias("a"), "one", F.col("hit").alias("p1"))
    right = parts.select(F.col("w").alias("b"), "one", F.col("hit").alias("p2"))
    pairs = cuts.join(left, ["a", "one"]).join(right, ["b", "one"])
    pairs = pairs.withColumn("term", F.concat_ws(" ", "p1.term", "p2.term")).withColumn("distance", F.coalesce(osa("w", "term", k), F.lit(k + 1)))
    total = d.config.corpus_word_count
    estimate = whole(F.col("p1.count") / F.lit(float(total)) * F.col("p2.count"))
    estimate = F.least(F.lit(d.bigram_min_count), estimate)
    if d.bigrams is None:
        pairs = pairs.withColumn("count", estimate)
    else:
        known = d.bigrams.select(F.col("bigram").alias("term"), F.col("count").alias("pair"))
        pairs = pairs.join(known, "term", "left")
        c, single = F.col("hit.count"), F.col("hit.term")
        raised = (
            F.when(F.col("hit").isNull(), F.when(F.col("term") == F.col("w"), F.greatest("pair", F.greatest("p1.count", "p2.count") + 2)).otherwise(F.col("pair")))
            .when(F.col("term") == F.col("w"), F.greatest(F.col("pair"), c + 2))
            .when((F.col("p1.term") == single) | (F.col("p2.term") == single), F.greatest(F.col("pair"), c + 1))
            .otherwise(F.col("pair"))
        )
        pairs = pairs.withColumn("count", F.when(F.col("pair").isNull(), estimate).otherwise(raised))
    alone = words.where(F.col("hit").isNotNull()).select("w", "hit.*", F.lit(0).alias("j"))
    options = alone.unionByName(pairs.select("w", "term", "distance", "count", "j"))
    order = F.struct("distance", (-F.col("count")).alias("_c"), "j")
    return options.groupBy("w").agg(F.min_by(F.struct("term", "distance", "count"), order).alias("part"))


def fold_words(steps: list[tuple[dict, dict, dict | None]], total: float) -> tuple[str, int]:
    """(text, count) of a text's words (chosen part, own suggestion, suggestion for it joined to the word before): a
    joined one takes the place of the two where it is nearer, or as near and likelier."""
    parts: list[tuple[str, int, int]] = []
    merged = False
    for part, own, combined in steps:
        if parts and not merged and combined is not None:
            distance = parts[-1][1] + own["distance"]
            likely = int(min(parts[-1][2] / total * own["count"], _MOST))
            if combined["distance"] + 1 < distance or (combined["distance"] + 1 == distance and combined["count"] > likely):
                parts[-1], merged = (combined["term"], combined["distance"] + 1, combined["count"]), True
                continue
        parts.append((part["term"], part["distance"], part["count"]))
        merged = False
    count = total
    for p in parts:
        count *= p[2] / total
    return " ".join(p[0] for p in parts).strip(" "), int(min(count, _MOST))


def _fold(total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                fold_words([(x["part"], x["own"], x["combined"]) for x in steps.as_py()], total) for steps in batch.column(1)
            ]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "term", "count"])

    return run


def lookup_compound(
    inputs: DataFrame,
    d: Dictionary,
    k: int | None = None,
    thresholds: Sequence[int] | None = None,
    preserve_case: bool = False,
    id_col: str = "id",
    input_col: str = "input",
    compat: bool = False,
) -> DataFrame:
    """(id, input, term, distance, count): one row for every row of ``inputs``; a null input gives a null term.

    All strings to look up (words, neighbours joined, parts of words without an exact hit) are looked up once each, in
    two batches whose results are written to the shared folder; the choice between them is a fold over the text's words.
    Words carry the MD5 of their text, not the text.
    """
    k = d.config.max_edit_distance if k is None else k
    thresholds = None if thresholds is None else tuple(thresholds)
    reach = d.config.reach(k, thresholds)
    ensure_shipped(inputs.sparkSession)
    rows = inputs.select(F.col(id_col).alias("id"), F.col(input_col).alias("input"), F.unhex(F.md5(F.col(input_col))).alias("key"))
    distinct = rows.where("input IS NOT NULL").dropDuplicates(["key"]).select("key", "input")
    words = distinct.select("key", tokens(F.col("input"), compat).alias("t")).select(
        "key",
        F.posexplode(
            F.transform(
                F.when(F.size("t") > 0, F.sequence(F.lit(0), F.size("t") - 1)).otherwise(F.array().cast("array<int>")),
                lambda i: F.struct(F.get("t", i).alias("w"), F.when(i > 0, F.get("t", i - 1)).alias("p")),
            )
        ).alias("i", "x"),
    ).select("key", "i", "x.w", "x.p")
    every = words.select("w").distinct()
    single = written(every.join(_top(every, d, k, thresholds, reach), "w", "left"), "words")
    settled = F.col("hit").isNotNull() & ((F.col("hit.distance") == 0) | (F.length("w") == 1))
    settled = F.coalesce(settled, F.lit(False))
    split = best_splits(single.where(~settled), d, k, thresholds, reach)
    none = F.struct(F.col("w").alias("term"), F.lit(k + 1).alias("distance"), unknown_count(F.col("w")).alias("count"))
    chosen = single.join(split, "w", "left").select(
        "w",
        F.coalesce("hit", none).alias("own"),
        F.when(settled, F.col("hit")).otherwise(F.coalesce("part", none)).alias("part"),
    )
    # a word joined to the one before must be nearer than the two apart, so two exact ones are never looked up together
    far = single.select("w", F.coalesce("hit.distance", F.lit(k + 1)).alias("far"))
    pairs = words.where("p IS NOT NULL").select("p", "w").distinct()
    pairs = pairs.join(far.withColumnRenamed("far", "far_w"), "w").join(far.toDF("p", "far_p"), "p")
    pairs = pairs.where("far_p + far_w > 0").select("p", "w", F.concat("p", "w").alias("joined"), F.expr("far_p + far_w - 1").alias("most"))
    glued = _top(pairs.select(F.col("joined").alias("w"), "most"), d, k, thresholds, reach, "most")
    merged = pairs.join(glued.toDF("joined", "most", "combined"), ["joined", "most"]).select("p", "w", "combined")
    ready = words.join(chosen, "w").join(merged, ["p", "w"], "left")
    steps = ready.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "part", "own", "combined"))).alias("steps"))
    folded = steps.mapInArrow(_fold(float(d.config.corpus_word_count)), "key binary, term string, count long")
    out = distinct.join(folded, "key", "left").select(
        "key",
        "input",
        F.lower("input").alias("low"),
        F.coalesce("term", F.lit("")).alias("term"),
        F.coalesce("count", F.lit(d.config.corpus_word_count)).alias("count"),
    )
    out = out.withColumn("distance", osa("low", "term"))
    term = transfer_case("input", "term") if preserve_case else F.lower("term")
    return rows.join(out.select("key", term.alias("term"), "distance", "count"), "key", "left").select("id", "input", "term", "distance", "count")
