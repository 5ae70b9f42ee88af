"""Single-word lookup for a column of words: a similarity join on shared deletions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import deletes, effective_distance, osa_of, transfer_case
from ..plans.config import Verbosity
from ..plans.shipping import ensure_shipped
from ..plans.storage import written
from .dictionary import Dictionary, keyed


def _near(queries: DataFrame, d: Dictionary, reach: int, depth: str | int) -> DataFrame:
    """(q, k, term, distance, count) of indexed terms other than q within ``depth`` (a number, or the column k) of it.

    Strings within a distance have a string in common that as many deletions leave of either's prefix; so entries made
    by more deletions are skipped. Pairs that meet under several strings become one before their distance is taken.
    """
    prefix = d.config.prefix_length
    far = F.col(depth) if isinstance(depth, str) else F.lit(depth)
    probes = queries.select("q", "k", far.alias("r"), F.explode(deletes("q", depth, prefix)).alias("del"))
    probes = probes.withColumn("h", F.xxhash64("del")).drop("del")
    entries = keyed(d.index, prefix)
    pairs = probes.join(entries, "h").where(
        (F.col("n") <= F.col("r")) & (F.abs(F.length("q") - F.length("term")) <= F.col("r")) & (F.col("q") != F.col("term"))
    )
    pairs = pairs.select("q", "k", "r", "term", "count").withColumn("lev", F.levenshtein(F.col("q"), F.col("term"), 2 * reach))
    # at least lev - r of the edits are swaps, which leave 2 * r - lev for edits that change the length
    able = (F.col("lev") <= F.col("r")) | (F.abs(F.length("q") - F.length("term")) <= 2 * F.col("r") - F.col("lev"))
    pairs = pairs.where((F.col("lev") >= 0) & able).distinct()
    found = pairs.withColumn("distance", osa_of(F.col("q"), F.col("term"), F.col("lev"), reach))
    return found.where(F.col("distance") <= F.col("r")).select("q", "k", "term", "distance", "count")


def _closest(queries: DataFrame, d: Dictionary, reach: int, top: bool) -> DataFrame:
    """(q, k, term, distance, count) of the terms at the smallest distance (``top``: the first of them).

    Distances are tried from 0 upwards, each for the queries that have found nothing yet; what was found before the last
    one is written to the shared folder.
    """
    order = F.struct("distance", (-F.col("count")).alias("_c"), "term")
    hit = F.struct("term", "distance", "count")
    columns = ["q", "k", "s.term", "s.distance", "s.count"]
    if not reach:
        found = queries.join(d.words, queries["q"] == d.words["term"])
        return found.select("q", "k", "term", F.lit(0).alias("distance"), "count")
    exact = F.when(F.col("count").isNotNull(), F.array(F.struct("term", F.lit(0).alias("distance"), "count"))).alias("s")
    tried = queries.join(d.words, queries["q"] == d.words["term"], "left").select("q", "k", exact)
    found = []
    for r in range(1, reach + 1):
        tried = written(tried, "tried")  # both what is done and what is open come from it
        found.append(tried.where("s IS NOT NULL"))
        open_ = tried.where("s IS NULL").select("q", "k").where(F.col("k") >= r)
        near = _near(open_, d, r, r).groupBy("q", "k")
        best = near.agg(F.array(F.min_by(hit, order)).alias("s") if top else F.collect_list(hit).alias("s"))
        tried = best if r == reach else open_.join(best, ["q", "k"], "left")
    out = reduce(DataFrame.unionByName, [*found, tried])
    return out.select("q", "k", F.explode("s").alias("s")).select(*columns)


def suggest(
    queries: DataFrame,
    d: Dictionary,
    verbosity: Verbosity = Verbosity.TOP,
    reach: int | None = None,
    max_results: int | None = None,
    checked: bool = False,
) -> DataFrame:
    """Ranked matches (q, k, term, distance, count, rank) of distinct queries (q, k); ``checked``: none is too long."""
    ensure_shipped(queries.sparkSession)
    reach = d.config.depth if reach is None else reach
    if not checked:
        queries = queries.where(F.length("q") - F.col("k") <= d.max_term_length)
    if verbosity == Verbosity.TOP:  # partial aggregation instead of a sort of all matches
        out = _closest(queries, d, reach, True).withColumn("rank", F.lit(1))
    else:
        if verbosity == Verbosity.CLOSEST:
            found = _closest(queries, d, reach, False)
        else:
            found = queries.join(d.words, queries["q"] == d.words["term"]).select("q", "k", "term", F.lit(0).alias("distance"), "count")
            if reach:
                found = found.unionByName(_near(queries.where("k > 0"), d, reach, "k"))
        ranked = Window.partitionBy("q", "k").orderBy("distance", F.col("count").desc(), "term")
        out = found.withColumn("rank", F.row_number().over(ranked))
    return out if max_results is None else out.where(F.col("rank") <= max_results)


def lookup(
    inputs: DataFrame,
    d: Dictionary,
    verbosity: Verbosity | str = Verbosity.TOP,
    k: int | None = None,
    thresholds: Sequence[int] | None = None,
    max_results: int | None = None,
    preserve_case: bool = False,
    id_col: str = "id",
    input_col: str = "input",
) -> DataFrame:
    """(id, input, term, distance, count, rank): suggestions for every row of ``inputs``, none for unknown words.

    Equal words are looked up once. Distance is optimal string alignment; equal ranks go by term.
    """
    k = d.config.max_edit_distance if k is None else k
    thresholds = None if thresholds is None else tuple(thresholds)
    reach = d.config.reach(k, thresholds)
    rows = inputs.select(F.col(id_col).alias("id"), F.col(input_col).alias("input"))
    rows = rows.withColumn("q", F.lower("input")).withColumn("k", effective_distance(F.length("input"), k, thresholds))
    found = suggest(rows.select("q", "k").distinct(), d, Verbosity(verbosity), reach, max_results)
    out = rows.join(found, ["q", "k"])
    term = transfer_case("input", "term") if preserve_case else F.col("term")
    return out.select("id", "input", term.alias("term"), "distance", "count", "rank")


def unknown(inputs: DataFrame, d: Dictionary, k: int | None = None, **names: str) -> DataFrame:
    """Rows (id, input) without any suggestion."""
    rows = inputs.select(F.col(names.get("id_col", "id")).alias("id"), F.col(names.get("input_col", "input")).alias("input"))
    found = lookup(rows, d, Verbosity.TOP, k).select("input").distinct()
    return rows.join(found, "input", "left_anti").select("id", "input")
