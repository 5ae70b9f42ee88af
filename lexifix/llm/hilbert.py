"""Sharding by a Hilbert curve over quantised metadata, with DataFrame functions only.

Every metadata dimension is quantised to ``bits`` bits in its own order (numbers by their size, other types at quantiles
of their values), which bounds the cells (2 ** 15 at most) and makes a dimension's range a range of cells, so that files
cut from the curve have narrow ranges in every dimension. A row's place in the global order is (curve index of its cell,
sub-bucket of a crowded cell, id); exact ranks come from two small tables of counts, so that no task sorts more than one
sub-bucket, and runs of the order are the shards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_text, partitions, read, shared_dir, written

#: Cells in all, as a power of two.
CELL_BITS = 15
#: Rows of a cell that one sub-bucket holds at most, about.
SUB_ROWS = 50_000


def edges(df: DataFrame, name: str, bits: int) -> list[str]:
    """Ascending values that part a dimension's rows evenly into 2 ** bits - 1 ranges at most, from the counts of all its
    whole values. A value with more rows than an even range has counts as one range, so it takes none from the others.

    The values are sorted and summed in parts; the driver gets one value for each range.
    """
    ranges = (1 << bits) - 1
    values = df.select(F.col(f"`{name}`").cast("string").alias("v")).where("v IS NOT NULL")
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    distinct, total = counts.agg(F.count("v"), F.sum("n")).first()
    if distinct <= ranges:
        level = F.col("v")
    else:
        weight = F.least(F.col("n"), F.lit(-(-total // ranges)))
        whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        parts = (  # one row per shuffle partition
            counts.groupBy("part")
            .agg(F.sum(weight).alias("w"))
            .select("part", (F.sum("w").over(Window.orderBy("part")) - F.col("w")).alias("skip"), F.sum("w").over(whole).alias("total"))
        )
        counts = counts.join(F.broadcast(parts), "part")
        seen = F.col("skip") + F.sum(weight).over(Window.partitionBy("part").orderBy("v")) - weight
        counts = counts.withColumn("seen", seen)
        level = F.expr(f"seen * {ranges} div total")
    firsts = counts.groupBy(level.alias("level")).agg(F.min("v").alias("v"))
    return sorted((r.v for r in firsts.collect()), key=str.encode)[1:]


def quantise(col: Column, kind: T.DataType, bits: int, bounds: list[str] | None = None) -> Column:
    """0 for null; numbers by their bit length; other types by the number of ``bounds`` up to the value, spread over all
    cells so that the curve's first turns part them. Either way the cells of a dimension are ranges."""
    top = (1 << bits) - 1
    if isinstance(kind, T.NumericType):
        whole = F.when(F.isnan(col.cast("double")), F.lit(0)).otherwise(col.cast("double"))
        bounded = F.greatest(F.lit(0.0), F.least(whole, F.lit(9.0e15))).cast("bigint")
        level = F.when(bounded <= 0, F.lit(0)).otherwise(F.length(F.bin(bounded)))
        return F.coalesce(F.least(level + 1, F.lit(top)), F.lit(0)).cast("int")
    bounds = bounds or []
    mark = uuid.uuid4().hex  # one literal, as thousands of them take the driver long
    found, value = F.split(F.lit(mark.join(bounds)), mark), col.cast("string")
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length())][::-1]).cast("array<int>")
    # binary search; beyond the last bound get is null
    below = F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get(found, n + s - 1) <= value, n + s).otherwise(n))
    return F.when(col.isNull(), F.lit(0)).otherwise(F.floor(below * top / (len(bounds) + 1)) + 1).cast("int")


def hilbert_index(cell: str, dims: int, bits: int) -> Column:
    """Curve index of a cell (its coordinates' bits side by side, the first dimension highest), after Skilling's
    transposed form: undo the rotations level by level, Gray encode, interleave the bits."""
    mask = (1 << bits) - 1
    axes = ", ".join(f"shiftright({cell}, {bits * (dims - 1 - d)}) & {mask}L" for d in range(dims))
    steps = ", ".join(f"struct({1 << q}L as q, {d} as i)" for q in range(bits - 1, 0, -1) for d in range(dims))
    swapped = (
        "transform(x, (v, j) -> CASE"
        " WHEN (x[s.i] & s.q) <> 0L THEN IF(j = 0, v ^ (s.q - 1L), v)"
        " WHEN s.i = 0 THEN v"
        " WHEN j = 0 OR j = s.i THEN v ^ ((x[0] ^ x[s.i]) & (s.q - 1L))"
        " ELSE v END)"
    )
    turned = f"aggregate(array({steps}), array({axes}), (x, s) -> {swapped})" if bits > 1 else f"array({axes})"
    gray = (
        f"transform(sequence(0, {dims - 1}), i -> aggregate(slice(t, 1, i + 1), 0L, (a, v) -> a ^ v))"
        if dims > 1
        else "t"
    )
    flip = f"aggregate(sequence(1, {bits - 1}), 0L, (a, b) -> a ^ IF((g[{dims - 1}] & shiftleft(1L, b)) <> 0L, shiftleft(1L, b) - 1L, 0L))"
    flip = flip if bits > 1 else "0L"
    bit_list = ", ".join(f"struct({q} as b, {d} as i)" for q in range(bits - 1, -1, -1) for d in range(dims))
    join_bits = f"aggregate(array({bit_list}), 0L, (a, s) -> shiftleft(a, 1) | (shiftright(g[s.i] ^ f, s.b) & 1L))"
    # transform over one-element arrays binds t, g and f, so each is computed once a row
    return F.expr(
        f"transform(array({turned}), t -> transform(array({gray}), g -> transform(array({flip}), f -> {join_bits})[0])[0])[0]"
    )


def hilbert_shards(
    df: DataFrame, id_col: str, dims: list[str], n_shards: int = 8, law: str = "rows", size_col: str | None = None
) -> DataFrame:
    """Add ``shard`` and ``slot`` (place in the shard, gapless from 0) to all rows of ``df``.

    ``law``: ``rows`` cuts runs whose counts are at most one apart, ``bytes`` runs of equal sums of ``size_col``.
    Nulls of a dimension form the lowest cell; null ids sort first; rows that are equal may take each other's places;
    an empty table gives an empty result. Other columns stay, whatever their names.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law: {law}")
    bits = max(1, CELL_BITS // len(dims))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cell = F.lit(0).cast("bigint")
    for d in dims:
        bounds = None if isinstance(kinds[d], T.NumericType) else edges(df, d, bits)
        cell = F.shiftleft(cell, bits).bitwiseOR(quantise(F.col(d), kinds[d], bits, bounds).cast("bigint"))
    whole_row = [F.col(f"`{c}`") for c in df.columns if "map<" not in kinds[c].simpleString()]
    size = F.lit(1).cast("bigint") if law == "rows" else F.coalesce(F.col(size_col).cast("bigint"), F.lit(0))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
        cell.alias("_cell"),
        size.alias("_size"),
        F.col(id_col).alias("_id"),
        F.xxhash64(*whole_row).alias("_mix"),  # rows that share id and dimensions are spread by what else they have
    )
    whole = Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = (
        rows.groupBy("_cell")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_b"))
        .withColumn("_h", hilbert_index("_cell", len(dims), bits))
        .withColumn("_all", F.sum("_n").over(whole))
        .withColumn("_all_b", F.sum("_b").over(whole))
        .withColumn("_base", F.sum("_n").over(Window.orderBy("_h")) - F.col("_n"))
        .withColumn("_base_b", F.sum("_b").over(Window.orderBy("_h")) - F.col("_b"))
    )
    fair = F.greatest(F.lit(1), F.least(F.lit(SUB_ROWS), F.expr(f"_all div {4 * partitions(df.sparkSession)}")))
    cells = cells.withColumn("_subs", F.ceil(F.col("_n") / fair)).drop("_n", "_b", "_h")
    # 2 ** CELL_BITS rows at most, whatever the data
    placed = rows.join(F.broadcast(cells), "_cell").withColumn("_sub", F.pmod("_mix", "_subs"))
    before = Window.partitionBy("_cell").orderBy("_sub")
    subs = (
        placed.groupBy("_cell", "_sub")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_b"))
        .withColumn("_skip", F.sum("_n").over(before) - F.col("_n"))
        .withColumn("_skip_b", F.sum("_b").over(before) - F.col("_b"))
        .drop("_n", "_b")
    )
    inside = Window.partitionBy("_cell", "_sub").orderBy("_id", "_mix")
    ranked = (
        placed.withColumn("_at", F.row_number().over(inside) - 1)
        .withColumn("_run", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
        .join(subs, ["_cell", "_sub"])
        .withColumn("_rank", F.col("_base") + F.col("_skip") + F.col("_at"))
    )
    if law == "rows":
        out = ranked.withColumn("_shard", F.expr(f"(_rank * {n_shards}) div _all")).withColumn(
            "_slot", F.col("_rank") - F.expr(f"(_shard * _all + {n_shards - 1}) div {n_shards}")
        )
    else:
        out = ranked.withColumn(
            "_shard",
            F.least(F.lit(n_shards - 1), F.expr(f"((_base_b + _skip_b + _run) * {n_shards}) div greatest(_all_b, 1)")),
        )
        firsts = out.groupBy("_shard").agg(F.min("_rank").alias("_first"))
        out = out.join(F.broadcast(firsts), "_shard").withColumn("_slot", F.col("_rank") - F.col("_first"))
    keep = [F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in ("shard", "slot")]
    return out.select(*keep, F.col("_shard").cast("int").alias("shard"), F.col("_slot").cast("long").alias("slot"))


def shard_ranges(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """For file pruning: least and greatest value of each dimension in each shard."""
    aggs = [f(F.col(d)).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *aggs)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order."""
    (
        sharded.repartitionByRange(F.col("shard"), F.col("slot"))
        .sortWithinPartitions("shard", "slot")
        .write.option("compression", "zstd")
        .partitionBy("shard")
        .parquet(path)
    )


def op1_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards along the curve over (lang, source, n_chars); equal counts; written, digests from that."""
    docs = read(spark, sf_dir, "documents")
    sharded = hilbert_shards(docs, "doc_id", ["lang", "source", "n_chars"], n_shards=8, law="rows")
    path = shared_dir(spark, "shards") + "/rows"
    write_shards(sharded, path)
    out = spark.read.schema(sharded.schema).parquet(path)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return out.select(
        "doc_id",
        size.alias("size"),
        crc32_text().alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
