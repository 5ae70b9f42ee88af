import math
from bisect import bisect_right
from collections import Counter
from hashlib import md5

import pytest
from helpers import no_docs, odd_docs, odd_rows
from pyspark.sql import functions as F

from lexifix.llm import hilbert, mixing
from lexifix.llm.hilbert import hilbert_index, hilbert_shards, shard_ranges, write_shards
from lexifix.llm.mixing import poisson_mix, repetition_rates

DIMS = ["lang", "source", "n_chars"]


@pytest.mark.parametrize(("dims", "bits"), [(3, 3), (2, 4), (1, 5), (4, 2), (2, 1)])
def test_curve_steps_to_neighbours(spark, dims, bits):
    rows = spark.range(1 << (dims * bits)).withColumn("h", hilbert_index("id", dims, bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(len(rows)))
    mask = (1 << bits) - 1
    points = [[(r.id >> (bits * (dims - 1 - d))) & mask for d in range(dims)] for r in rows]
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(points, points[1:]))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, law, tmp_path):
    df = odd_docs(spark, extra=True).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    out = hilbert_shards(df, "doc_id", DIMS, 4, law, "size")
    assert sorted(out.columns) == sorted({*df.columns, "slot"})
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows())
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    for part in shards.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    if law == "rows":
        sizes = [len(shards.get(s, [])) for s in range(4)]
        assert max(sizes) - min(sizes) <= 1
    assert shard_ranges(out, ["n_chars"]).count() == len(shards)
    write_shards(out.drop("_row"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)


def plain_index(point, bits):
    """Curve index of a point, walked down cell by cell: the state is the curve's orientation in each sub-cube."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ t) >> b & 1)
    return out


def many(spark, n=4000):
    rows = [(i, f"text {i}", "en de fr es".split()[i * 7 % 4], f"source-{i * i % 23:02d}", (i * 7919) % 30_000 + 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows


def test_order_against_brute_force(spark):
    df, rows = many(spark)
    langs, sources = sorted({r[2] for r in rows}), sorted({r[3] for r in rows})
    level = lambda v, values: values.index(v) * 31 // len(values) + 1
    point = {r[0]: (level(r[2], langs), level(r[3], sources), min(r[4].bit_length() + 1, 31)) for r in rows}
    got = sorted((r.shard, r.slot, r.doc_id) for r in hilbert_shards(df, "doc_id", DIMS, 8).collect())
    places = [plain_index(point[g[2]], 5) for g in got]
    assert places == sorted(places)
    assert [g[:2] for g in got] == [(s, k) for s in range(8) for k in range(500)]


def test_ranges_from_all_values(spark):
    """More distinct values than a driver should see, alike in their first 80 characters, one of them with many rows."""
    values = [f"{'x' * 80}{i * 7919 % 30011:05d}" for i in range(30_000)]
    values += [v for v in values if v[-5:] < "03000"] * 9 + ["y" * 90] * 40_000
    rng = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, source string")
    counts, ranges = sorted(Counter(values).items()), 31
    cap = -(-len(values) // ranges)
    total, seen, firsts = sum(min(n, cap) for _, n in counts), 0, {}
    for v, n in counts:
        firsts.setdefault(seen * ranges // total, v)
        seen += min(n, cap)
    bounds = hilbert.edges(rng, "source", 5)
    assert bounds == list(firsts.values())[1:] and len(bounds) > 28
    kind = rng.schema["source"].dataType
    got = rng.select("source", hilbert.quantise(F.col("source"), kind, 5, bounds).alias("c")).distinct().collect()
    assert all(r.c == bisect_right(bounds, r.source) * 31 // (len(bounds) + 1) + 1 for r in got)
    sizes = Counter(bisect_right(bounds, v) for v in values)
    assert max(n for b, n in sizes.items() if b < len(bounds)) <= cap + 10
    one = hilbert_shards(rng, "doc_id", ["source"], 8).groupBy("shard").agg(F.min("source").alias("a"), F.max("source").alias("b")).orderBy("shard").collect()
    assert len(one) == 8 and all(x.b <= y.b and x.a <= y.a for x, y in zip(one, one[1:]))


def test_ranges_prune(spark):
    df, rows = many(spark)
    ranges = shard_ranges(hilbert_shards(df, "doc_id", DIMS, 32), DIMS).collect()
    def read(d, v):
        return sum(r[f"min_{d}"] <= v <= r[f"max_{d}"] for r in ranges) / len(ranges)
    assert max(read("lang", v) for v in {r[2] for r in rows}) < 0.6
    assert sum(read("source", v) for v in {r[3] for r in rows}) / 23 < 0.5


def test_hot_null_ids_are_spread(spark):
    df = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("x").alias("source"), F.lit(5).alias("n_chars"))
    plan = hilbert_shards(df, "doc_id", DIMS, 8)
    assert {r.n for r in plan.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()} == {625}


def test_crowded_cell_and_empty(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("x").alias("source"), F.lit(5).alias("n_chars"))
    rows = hilbert_shards(df, "doc_id", DIMS, 8).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("m")).collect()
    assert {(r.n, r.m) for r in rows} == {(625, 624)}
    assert hilbert_shards(no_docs(spark), "doc_id", DIMS).count() == 0


def plain_count(doc_id, rate):
    parts = max(1, math.ceil(rate / 16))
    total = 0
    for j in range(parts):
        u = (int(md5(f"42:{'' if doc_id is None else doc_id}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        p = c = math.exp(-rate / parts)
        k = 0
        while c < u:
            k += 1
            p *= rate / parts / k
            c += p
            if k > 500:
                break
        total += k
    return total


def test_mixing_against_plain_inversion(spark):
    df = odd_docs(spark, extra=True)
    for weights in (None, {"a": 0.02, "b": 0.9, "": 0.08}, {"b": 1.0}):
        rates = {r._src: r._rate for r in repetition_rates(df, "source", weights, size_factor=20.0).collect()}
        assert sum(rates[r[3] or ""] for r in odd_rows()) == pytest.approx(20 * 11)
        out = poisson_mix(df, weights=weights, size_factor=20.0)
        assert out.columns == df.columns
        got = Counter((r.doc_id, r.text) for r in out.collect())
        want = Counter()
        for r in odd_rows():
            want[r[:2]] += plain_count(r[0], rates[r[3] or ""])
        assert got == +want


def test_mixing_info_and_empty(spark):
    rows = poisson_mix(odd_docs(spark, extra=True), size_factor=3.0, info=True).collect()
    for r in rows:
        assert 1 <= r["copy"] <= r.n_copies
    assert poisson_mix(no_docs(spark)).count() == 0


def test_queries_move_whole_documents(spark, monkeypatch, tmp_path):
    odd_docs(spark, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    texts = {(r[0], r[1]) for r in odd_rows()}
    seen = {}
    keep_written, keep_shards = mixing.written, hilbert.write_shards
    monkeypatch.setattr(mixing, "written", lambda df, label: seen.setdefault(label, keep_written(df, label)))
    monkeypatch.setattr(hilbert, "write_shards", lambda df, path: (keep_shards(df, path), seen.setdefault("shards", path)))
    narrow = mixing.op2_poisson_mixing(spark, str(tmp_path)).collect()
    mixed = seen["mixed"].collect()
    assert {(r.doc_id, r.text) for r in mixed} <= texts and len(mixed) == len(narrow) > 0
    assert Counter((str(r.doc_id), r["copy"]) for r in mixed) == Counter((str(r.doc_id), r["copy"]) for r in narrow)
    rows = hilbert.op1_hilbert_sharding(spark, str(tmp_path)).collect()
    shards = spark.read.parquet(seen["shards"]).collect()
    assert Counter((str(r.doc_id), str(r.text)) for r in shards) == Counter((str(r[0]), str(r[1])) for r in odd_rows())
    assert sorted(r.size for r in rows) == sorted(len((r[1] or "").encode()) + 1 for r in odd_rows())
    assert {(r.shard, r.slot) for r in rows} == {(r.shard, r.slot) for r in shards}
