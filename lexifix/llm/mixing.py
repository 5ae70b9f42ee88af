"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source of share s that should have weight w is repeated w / s times on average: each document's number of copies is
a Poisson variate with that mean, got by inverting the distribution function at a uniform number hashed from the
document's id. Copies are exploded and dealt out by a hash of (id, copy), which is a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, read, written

#: A mean above this is the sum of equal parts up to it, each with a uniform number of its own; exp(-mean) stays exact.
PART_MEAN = 16
#: Sources up to this many are broadcast (about 1 KB each); beyond, the join shuffles.
BROADCAST_SOURCES = 20_000


def _drawn(seed: int, part: str) -> str:
    """Poisson count by inversion: how many values of the distribution function are below a uniform number in (0, 1),
    taken from the first 52 bits of the MD5 of seed, id and part. The one-element array binds the number."""
    digest = f"md5(cast(concat_ws(':', '{seed}', _id, {part}) as binary))"
    number = f"(cast(conv(substring({digest}, 1, 13), 16, 10) as double) + 0.5) / 4503599627370496D"
    return f"transform(array({number}), u -> size(filter(_cdf, x -> x < u)))[0]"


def repetition_rates(
    df: DataFrame, source_col: str, weights: dict[str, float] | None = None, alpha: float = 0.5, size_factor: float = 1.0
) -> DataFrame:
    """One row per source: rows, mean target repetition rate, equal parts of it and a part's distribution function.

    ``weights`` are target weights by source (absent: 0), scaled to sum 1; without them the weight is rows ** alpha.
    ``size_factor``: rows wanted in all, as a multiple of the rows there are. Null is a source of its own, looked up
    as the empty text.
    """
    n = df.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("_src")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        weight = F.pow(F.col("_n").cast("double"), F.lit(alpha))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
        weight = F.coalesce(given[F.col("_src")], F.lit(0.0)).cast("double") if weights else F.lit(0.0)
    n = n.withColumn("_w", weight)
    total = n.agg(F.sum("_n").alias("_all"), F.sum("_w").alias("_all_w"))
    rate = F.when(F.col("_all_w") > 0, F.col("_w") / F.col("_all_w") * F.col("_all") * F.lit(size_factor) / F.col("_n"))
    return (
        n.crossJoin(F.broadcast(total))  # one row
        .withColumn("_rate", F.coalesce(rate, F.lit(0.0)))
        .withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_rate") / PART_MEAN)).cast("int"))
        .withColumn("_mu", F.col("_rate") / F.col("_parts"))
        .withColumn("_top", F.ceil(F.col("_mu") + 12 * F.sqrt("_mu") + 20).cast("int"))
        .withColumn(
            "_cdf",
            F.expr(
                "aggregate(sequence(1, _top), named_struct('p', exp(-_mu), 'c', array(exp(-_mu))),"
                " (s, k) -> named_struct('p', s.p * _mu / k, 'c', concat(s.c, array(element_at(s.c, -1) + s.p * _mu / k))),"
                " s -> s.c)"
            ),
        )
        .select("_src", "_n", "_rate", "_parts", "_cdf")
    )


def poisson_mix(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    size_factor: float = 1.0,
    seed: int = 42,
    info: bool = False,
) -> DataFrame:
    """Every row of ``df`` as many times as its Poisson count says, shuffled globally; the columns of ``df``.

    ``info`` adds ``n_copies``, ``copy`` (from 1), ``rate`` and ``shuffle_key``. Rows with equal ids get equal counts;
    a null id hashes as the empty text. A source with weight 0 goes entirely; an empty table stays empty.
    """
    rates = written(repetition_rates(df.select(source_col), source_col, weights, alpha, size_factor), "rates")
    small = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
        key.alias("_id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("_src"),
    )
    if small:
        joined = rows.join(F.broadcast(rates), "_src")
    else:
        joined = lookup(rows, rates, "_src", "_n", F.col("_id"))
    counted = joined.withColumn(
        "_count",
        F.when(F.col("_parts") == 1, F.expr(_drawn(seed, "'0'"))).otherwise(
            F.expr(f"aggregate(sequence(0, _parts - 1), 0, (a, j) -> a + {_drawn(seed, 'cast(j as string)')})")
        ),
    )
    copies = counted.where("_count > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    copies = copies.withColumn("_key", F.xxhash64(F.lit(seed), F.col("_id"), F.col("_copy"), F.col("_src")))
    extra = {"n_copies": "_count", "copy": "_copy", "rate": "_rate", "shuffle_key": "_key"}
    columns = [F.col(f"_row.`{c}`").alias(c) for c in df.columns if not info or c not in extra]
    added = [F.col(v).alias(k) for k, v in extra.items()] if info else []
    return copies.repartition(F.col("_key")).sortWithinPartitions("_key").select(*columns, *added)


def op2_poisson_mixing(spark, sf_dir: str) -> DataFrame:
    """Copies of documents for square-root weights of the sources: doc_id, source, n_copies, copy of the written copies."""
    # written whole, as Catalyst would drop the texts before the shuffle otherwise
    mixed = written(poisson_mix(read(spark, sf_dir, "documents"), info=True), "mixed")
    return mixed.select("doc_id", "source", F.col("n_copies").cast("long"), F.col("copy").cast("long"))


OP2_SQL = """
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS src, count(*) AS n FROM documents GROUP BY 1),
t AS (SELECT sum(n) AS total, sum(sqrt(n)) AS total_w FROM n),
r AS (SELECT src, sqrt(n) / total_w * total / n AS rate FROM n, t),
p AS (SELECT src, greatest(1, ceil(rate / 16))::INT AS parts, rate / greatest(1, ceil(rate / 16)) AS mu FROM r),
cdf AS (
  SELECT src, mu, 0 AS k, exp(-mu) AS p, exp(-mu) AS c FROM p
  UNION ALL
  SELECT src, mu, k + 1, p * mu / (k + 1), c + p * mu / (k + 1) FROM cdf WHERE k < ceil(mu + 12 * sqrt(mu) + 20)
),
u AS (
  SELECT doc_id, source, rn, coalesce(source, '') AS src, j,
    (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM (SELECT *, row_number() OVER () AS rn FROM documents) d JOIN p ON coalesce(d.source, '') = p.src, unnest(range(parts)) x(j)
),
counted AS (
  SELECT doc_id, source, rn, count(c) FILTER (c < u) AS n_copies FROM u JOIN cdf USING (src) GROUP BY ALL
)
SELECT doc_id, source, n_copies, unnest(range(1, n_copies + 1)) AS copy FROM counted WHERE n_copies > 0
"""
