"""Dictionaries that grow from a stream, and correction of streamed words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import tokens
from ..operators.dictionary import Dictionary, merge
from ..operators.lookup import lookup
from ..plans.storage import scratch


def streaming_counts(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Running (term, count) of a stream of texts; write it in update or complete mode."""
    return stream.select(F.explode(tokens(F.col(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("count"))


def corrections(stream: DataFrame, dictionary: Dictionary, write: Callable[[DataFrame, int], None], **options) -> DataStreamWriter:
    """Look up each micro-batch (columns id and input) against the dictionary; ``write`` gets the result and the batch's
    number. What a lookup keeps in the shared folder goes after the batch."""

    def run(batch: DataFrame, n: int) -> None:
        with scratch(batch.sparkSession):
            write(lookup(batch, dictionary, **options), n)

    return stream.writeStream.foreachBatch(run)


def merge_into(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: add a batch's (term, count) to the newest dictionary version under ``path``.

    A batch writes the version of its own number from the one before, so that a repeated batch changes nothing.
    """

    def run(batch: DataFrame, n: int) -> None:
        old = [batch.sparkSession.read.parquet(f"{path}/version={n - 1}")] if n else []
        merge(*old, batch).write.mode("overwrite").parquet(f"{path}/version={n}")

    return run
