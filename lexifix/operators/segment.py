"""Segmentation of text without spaces, with correction."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc, transfer_case
from ..plans.config import Verbosity
from ..plans.shipping import ensure_shipped
from .dictionary import Dictionary
from .lookup import suggest

_OUT = "key binary, segmented_string string, distance_sum int, prob_log_sum double"
PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def glued(part: str) -> bool:
    """Whether a part follows the text before it without a space: one ASCII mark, or a right quotation mark alone."""
    return part in PUNCTUATION or part == "’"


def best_path(text: str, longest: int, hits: dict[tuple[int, int], tuple[str, int, float]], log_total: float) -> tuple[str, int, float]:
    """Segmentation of a text from the suggestions (part, distance, log probability) by (end, start): fewest edits and
    spaces, then likeliest. The rules aren't a total order, so parts are tried in order of end and start. A part without
    suggestion costs its length. Places keep where their best path comes from, not its text."""
    n = len(text)
    edits, logs = [0] * (n + 1), [0.0] * (n + 1)
    back: list[tuple[int, str] | None] = [None] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            part, separator = text[start:end], 1
            if part[0].isspace():
                part, separator = part[1:], 0
            kept = part.replace(" ", "")
            distance = len(part) - len(kept)
            if hit := hits.get((end, start)):
                out, more, logp = hit
                distance += more
            else:
                out, distance, logp = kept, distance + len(kept), 1 - log_total - len(kept)
            if start == 0:
                edits[end], logs[end], back[end] = distance, logp, (0, out)
                continue
            d, p = edits[start] + distance, logs[start] + logp
            take = back[end] is None or end - start == longest
            if not take:
                same = d == edits[end] or d + separator == edits[end]
                take = (same and logs[end] < p) or d + separator < edits[end]
            if take:
                edits[end], logs[end], back[end] = (d if glued(out) else d + separator), p, (start, out)
    parts, at = [], n
    while at:
        at, out = back[at]  # every place has a part that ends there
        parts.append(out if not at or glued(out) else f" {out}")
    return "".join(reversed(parts)), edits[n], logs[n]


def _fold(longest: int, log_total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, cells in zip(batch.column(1).to_pylist(), batch.column(2)):
                hits = {(c["e"], c["j"]): (c["part"], c["distance"], c["lp"]) for c in cells.as_py() or []}
                found.append(best_path(text, longest, hits, log_total))
            kinds = (pa.string(), pa.int32(), pa.float64())
            columns = [batch.column(0), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _OUT.split(", ")])

    return run


def word_segmentation(
    inputs: DataFrame, d: Dictionary, k: int | None = None, id_col: str = "id", input_col: str = "input"
) -> DataFrame:
    """(id, input, segmented_string, distance_sum, prob_log_sum) for every row; nulls give nulls, empty texts ("", 0, 0).

    Every part of up to the longest term's length is looked up, equal parts once; the path over them is a fold for each
    distinct text. Parts carry the MD5 of their text, not the text. An empty dictionary gives ("", 0, 0).
    """
    ensure_shipped(inputs.sparkSession)
    k = d.config.max_edit_distance if k is None else k
    reach = d.config.reach(k, None)
    rows = inputs.select(F.col(id_col).alias("id"), F.col(input_col).alias("input"))
    rows = rows.withColumn("text", F.replace(nfkc(F.col("input")), F.lit("-"), F.lit(""))).withColumn("key", F.unhex(F.md5("text")))
    longest = d.max_term_length
    texts = rows.where((F.length("text") > 0) & F.lit(longest > 0)).dropDuplicates(["key"]).select("key", "text")
    ends = texts.select("key", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("e"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("e") - longest), F.col("e") - 1)
    # the stretch that ends at e is cut out of the text once
    ends = ends.select("key", "e", starts.alias("js"), F.expr(f"substr(text, greatest(1, e - {longest - 1}), least(e, {longest}))").alias("tail"))
    raw = ends.select("key", "e", "tail", F.explode("js").alias("j"))
    raw = raw.select("key", "e", "j", F.expr("substr(tail, length(tail) - (e - j) + 1)").alias("raw"))
    space = F.expr(r"substr(raw, 1, 1) rlike '^\\p{IsWhite_Space}$'")
    kept = F.when(space, F.expr("substr(raw, 2)")).otherwise(F.col("raw"))
    raw = raw.select("key", "e", "j", F.replace(kept, F.lit(" "), F.lit("")).alias("part"))
    queries = raw.select("part").distinct().select("part", F.lower("part").alias("q"), F.lit(k).alias("k"))
    hits = suggest(queries.select("q", "k").distinct(), d, Verbosity.TOP, reach)
    total = float(d.config.corpus_word_count)
    named = queries.join(hits, ["q", "k"]).select(
        F.col("part").alias("named"),
        F.struct(
            F.when(F.col("distance") > 0, transfer_case("part", "term")).otherwise(F.col("part")).alias("part"),
            "distance",
            F.log10(F.col("count") / F.lit(total)).alias("lp"),
        ).alias("hit"),
    )
    cells = raw.join(named, raw["part"] == named["named"]).select("key", F.struct("e", "j", "hit.*").alias("cell"))
    found = cells.groupBy("key").agg(F.collect_list("cell").alias("cells"))
    paths = texts.join(found, "key", "left").mapInArrow(_fold(longest, math.log10(total)), _OUT)
    out = rows.join(paths, "key", "left")
    empty = F.col("input").isNotNull()
    return out.select(
        "id",
        "input",
        F.coalesce("segmented_string", F.when(empty, F.lit(""))).alias("segmented_string"),
        F.coalesce("distance_sum", F.when(empty, F.lit(0))).alias("distance_sum"),
        F.coalesce("prob_log_sum", F.when(empty, F.lit(0.0))).alias("prob_log_sum"),
    )
