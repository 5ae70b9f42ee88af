"""Frequency dictionaries as text files and as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_COUNT = 9223372036854775807


def _fields(lines: DataFrame, column: str, separator: str) -> Column:
    line = F.regexp_replace(F.col(column), r"\r$", "")
    return F.split(line, re.escape(separator), -1)


def _count(field: Column) -> Column:
    return F.when(field.rlike(r"^\+?[0-9]+$"), field.try_cast("bigint"))


def parse_terms(
    lines: DataFrame, term_index: int = 0, count_index: int = 1, separator: str = " ", column: str = "value", mode: str = "permissive"
) -> DataFrame:
    """(term, count) of lines; those with fewer than two fields are skipped. Lines with a bad count or without the
    wanted fields are skipped too, or with ``mode="failfast"`` raise an error."""
    parts = _fields(lines, column, separator)
    rows = lines.select(parts.alias("_p")).where(F.size("_p") >= 2)
    rows = rows.select(F.get("_p", F.lit(term_index)).alias("term"), _count(F.get("_p", F.lit(count_index))).alias("count"))
    return _sound(rows, mode)


def _sound(rows: DataFrame, mode: str) -> DataFrame:
    good = F.col(rows.columns[0]).isNotNull() & F.col("count").isNotNull()
    if mode == "failfast":
        return rows.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("bad dictionary line")).cast("boolean")))
    return rows.where(good)


def parse_bigrams(
    lines: DataFrame, term_index: int = 0, count_index: int = 2, separator: str = " ", column: str = "value", mode: str = "permissive", order: str | None = None
) -> DataFrame:
    """(bigram, count, low) of lines; with a space as separator the bigram is two fields, else one.

    A bigram that occurs again takes the last count, by ``order`` (a column; without it the file's order). ``low`` is the
    smallest count of all lines, overwritten ones too.
    """
    least = 3 if separator == " " else 2
    parts = _fields(lines, column, separator)
    place = F.col(order) if order else F.monotonically_increasing_id()
    rows = lines.select(parts.alias("_p"), place.alias("_at")).where(F.size("_p") >= least)
    first = F.get("_p", F.lit(term_index))
    name = F.concat(first, F.lit(" "), F.get("_p", F.lit(term_index + 1))) if separator == " " else first
    rows = rows.select(name.alias("bigram"), _count(F.get("_p", F.lit(count_index))).alias("count"), "_at")
    rows = _sound(rows, mode)
    return rows.groupBy("bigram").agg(F.max_by("count", "_at").alias("count"), F.min("count").alias("low"))


def load_dictionary(spark: SparkSession, path: str, term_index: int = 0, count_index: int = 1, separator: str = " ", mode: str = "permissive") -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return sum_counts(parse_terms(lines, term_index, count_index, separator, mode=mode))


def load_bigrams(spark: SparkSession, path: str, term_index: int = 0, count_index: int = 2, separator: str = " ", mode: str = "permissive") -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return parse_bigrams(lines, term_index, count_index, separator, mode=mode)


def sum_counts(terms: DataFrame) -> DataFrame:
    """One row per term; sums stop at the greatest 64-bit number."""
    total = F.least(F.sum(F.col("count").cast("decimal(38,0)")), F.lit(MAX_COUNT).cast("decimal(38,0)"))
    return terms.groupBy("term").agg(total.cast("bigint").alias("count"))


def dictionary_lines(words: DataFrame, separator: str = " ") -> DataFrame:
    """Lines ``term<separator>count``, most frequent first, equal counts by term."""
    ordered = words.orderBy(F.col("count").desc(), "term")
    return ordered.select(F.concat_ws(separator, "term", F.col("count").cast("string")).alias("value"))


def save_dictionary(words: DataFrame, path: str, separator: str = " ") -> None:
    """Range-partitioned text files whose names follow the order, without a single writer."""
    dictionary_lines(words, separator).write.mode("overwrite").text(path)
