"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ensure_shipped
from ..plans.storage import drop_dir, scratch, shared_dir, written

__all__ = ["crc32_text", "drop_dir", "fold_of", "local_path", "lookup", "partitions", "read", "scratch", "shared_dir", "text_of", "written"]

#: White space of the word rule, as a Java or Python character class body.
WS = r"\x20\x09-\x0D"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: At most this many keys can each hold more than 1/HOT_PARTS of all rows.
HOT_PARTS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ensure_shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def local_path(uri: str) -> str:
    """Path that a Python worker opens; the shared folder must be mounted on every machine."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"workers need a mounted shared folder, not {uri}")
    return uri


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc32_text(name: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(name), F.lit("")).cast("binary"))


def fold_of(name: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo the folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def lookup(big: DataFrame, table: DataFrame, key: str, weight: str, spread: Column, keep_weight: bool = False) -> DataFrame:
    """Left join ``big`` with the materialised ``table`` on ``key`` so that no key fills a task.

    ``table`` has one row per key and in ``weight`` the number of rows of ``big`` with that key. Keys with more than
    1/HOT_PARTS of all rows are at most HOT_PARTS, so those are broadcast; rows that found a hot key are dealt out by
    ``spread`` in the shuffled join with the rest.
    """
    values = [c for c in table.columns if c != key and (keep_weight or c != weight)]
    total = table.agg(F.sum(weight)).first()[0] or 0
    limit = max(1, total // HOT_PARTS)
    hot = table.where(F.col(weight) > limit).select(F.col(key).alias("_hk"), F.struct(*values).alias("_hv"))
    cold = table.where(F.col(weight) <= limit).select(
        F.lit(False).alias("_cf"), F.col(key).alias("_ck"), F.struct(*values).alias("_cv")
    )
    kind = table.schema[key].dataType
    out = big.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    out = out.withColumn("_f", F.col("_hk").isNotNull())
    out = out.withColumn("_k", F.when(F.col("_f"), spread.cast(kind)).otherwise(F.col(key)))
    out = out.join(cold, (F.col("_f") == F.col("_cf")) & (F.col("_k") == F.col("_ck")), "left")
    return out.select(
        *[F.col(c) for c in big.columns],
        *[F.coalesce(F.col(f"_hv.{v}"), F.col(f"_cv.{v}")).alias(v) for v in values],
    )
