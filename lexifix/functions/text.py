"""Scalar string functions as Column expressions, which stay in the JVM (but for NFKC and some distances)."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shipping import ensure_shipped
from .distance import osa_pairs

ALNUM = r"\p{IsAlphabetic}\p{N}"
WORD_CHARS = ALNUM + "_'’"


def _sql(name: str) -> str:
    return f"`{name}`"


def tokens(text: Column, compat: bool = False) -> Column:
    """Words of the lower-cased text: runs of letters, numbers, underscores and apostrophes.

    ``compat``: a run that begins with an underscore or apostrophe starts where the last run did that began otherwise
    (at the text's start if there was none), as a scanner does that marks starts at letters and numbers only.
    """
    low = F.lower(text)
    if not compat:
        return F.regexp_extract_all(low, F.lit(f"[{WORD_CHARS}]+"), F.lit(0))
    segments = F.split(low, f"(?<![{WORD_CHARS}])(?=[{ALNUM}])")

    def in_segment(s: Column) -> Column:
        n = F.regexp_count(s, F.lit(f"[{WORD_CHARS}]+"))
        pattern = lambda i: F.concat(F.lit(f"^(?:[^{WORD_CHARS}]*[{WORD_CHARS}]+){{"), i.cast("string"), F.lit("}"))
        return F.when(
            n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.regexp_extract_all(s, pattern(i), F.lit(0))[0])
        ).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(segments, in_segment))


def effective_distance(length: Column, k: int, thresholds: Sequence[int] | None) -> Column:
    """k, or with length thresholds k + i for the last threshold i that the length reaches, 0 below the first."""
    if thresholds is None:
        return F.lit(k)
    out = F.lit(0)
    for i, t in enumerate(thresholds):
        out = F.when(length >= t, F.lit(k + i)).otherwise(out)
    return out


def deletes(word: str, depth: str | int, prefix_length: int) -> Column:
    """Distinct strings left after up to ``depth`` deletions from the word's prefix, the prefix included; also the empty
    string for words no longer than the depth. ``word`` and ``depth`` are column names (depth also a number)."""
    w, d = _sql(word), depth if isinstance(depth, int) else _sql(depth)
    shorter = (
        "array_distinct(flatten(transform(s.last, w -> CASE WHEN length(w) < 2 THEN cast(array() as array<string>) ELSE"
        " transform(sequence(1, length(w)), i -> concat(substr(w, 1, i - 1), substr(w, i + 1))) END)))"
    )
    level = f"transform(array({shorter}), n -> named_struct('all', array_union(s.all, n), 'last', n))[0]"
    start = f"substr({w}, 1, {prefix_length})"
    grown = (
        f"aggregate(sequence(1, greatest(1, {d})), named_struct('all', array({start}), 'last', array({start})),"
        f" (s, i) -> IF(i > {d}, s, {level}), s -> s.all)"
    )
    return F.expr(f"IF(length({w}) <= {d}, array_union({grown}, array('')), {grown})")


def _distance(limit: int | None):
    @F.arrow_udf(T.IntegerType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return osa_pairs(a, b, limit)

    return run


def osa_of(a: Column, b: Column, lev: Column, limit: int) -> Column:
    """Optimal string alignment distance, null above ``limit``, from the Levenshtein distance ``lev`` (negative: above
    2 * limit). Every swap of neighbours saves one, so where the lengths differ by more than lev - 2 they are equal, and
    only other pairs go to Python, a batch at a time."""
    open_ = (lev >= 2) & (F.abs(F.length(a) - F.length(b)) <= lev - 2)
    exact = _distance(limit)(F.when(open_, a), F.when(open_, b))
    return F.when(lev < 0, F.lit(None)).when(open_, exact).when(lev <= limit, lev).cast("int")


def osa(a: str, b: str, limit: int | None = None) -> Column:
    """Distance of two columns (by name) over code points; null above ``limit``."""
    ensure_shipped(SparkSession.getActiveSession())
    x, y = F.col(_sql(a)), F.col(_sql(b))
    if limit is None:
        return _distance(None)(x, y)
    return osa_of(x, y, F.levenshtein(x, y, 2 * limit), limit)


def transfer_case_expr(s: str, t: str) -> str:
    """SQL for ``transfer_case`` of two SQL strings."""
    ascii_lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = (
        f"transform(array(named_struct('c', substr({s}, i, 1), 't', substr({t}, i, 1))), x -> CASE"
        f" WHEN i > length({s}) THEN named_struct('out', concat(a.out, IF(a.up, upper(x.t), x.t)), 'up', a.up)"
        r" WHEN x.c rlike '^\\p{IsUppercase}$' THEN named_struct('out', concat(a.out, upper(x.t)), 'up', i > 1)"
        r" WHEN x.c rlike '^\\p{IsWhite_Space}$' AND NOT x.t rlike '^\\p{IsWhite_Space}$' AND a.up"
        " THEN named_struct('out', concat(a.out, upper(x.t)), 'up', true)"
        " ELSE named_struct('out', concat(a.out, x.t), 'up', false) END)[0]"
    )
    walk = f"aggregate(sequence(1, length({t})), named_struct('out', '', 'up', false), (a, i) -> {step}, a -> a.out)"
    return f"CASE WHEN {ascii_lower.format(s)} = {ascii_lower.format(t)} THEN {s} WHEN length({t}) = 0 THEN '' ELSE {walk} END"


def transfer_case(source: str, target: str) -> Column:
    """The target with the letter case of the source, place by place (columns by name).

    Equal but for ASCII case: the source. A capital in the source capitalises its place and, from the second place on,
    what follows a source shorter than the target; white space in the source keeps that up for a letter against it.
    """
    return F.expr(transfer_case_expr(_sql(source), _sql(target)))


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Unicode normalization form KC, for which Spark has no function."""
    ensure_shipped(SparkSession.getActiveSession())
    return _nfkc(text)


def register(spark: SparkSession) -> None:
    """``lexifix_osa(a, b)`` and ``lexifix_transfer_case(source, target)`` as temporary SQL functions."""
    ensure_shipped(spark)
    spark.udf.register("lexifix_osa", _distance(None))
    head = "lexifix_transfer_case(source STRING, target STRING) RETURNS STRING"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {transfer_case_expr('source', 'target')}")
