import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexifix.llm import block_topk
from lexifix.llm.block_topk import Block, search_tile, top_k


def brute(rows, k):
    sound = [
        (n, i, [int(np.floor(64 * x)) for x in v])
        for n, (i, v) in enumerate(rows)
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for n, q, a in sound:
        if q % 20:
            continue
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, i, b in sound if m != n)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def run(spark, rows, k=20):
    return sorted(map(tuple, top_k(table(spark, rows), F.col("id") % 20 == 0, k=k).collect()))


@pytest.mark.parametrize("shard_rows", [8192, 64])
def test_against_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(block_topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(block_topk, "QUERY_ROWS", 5)
    rnd = random.Random(2)
    rows = [(i, [float(np.float32(rnd.gauss(0, 0.2))) for _ in range(8)]) for i in range(200)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [rows[20], rows[33], (20, rows[5][1])]
    rows += [(400, None), (420, [0.1, None] + [0.0] * 6), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (None, rows[1][1]), (480, []), (500, [0.5, -0.5])]
    assert run(spark, rows) == brute(rows, 20)


def test_few_rows_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [-2.0])]) == [(0, 1, 1, 64 * -128)]


def test_blocks_below_the_kth_score_are_skipped():
    rng = np.random.default_rng(0)
    blocks, scored = [], []
    for b in range(10):
        rows = rng.integers(0, 5, size=(32, 4)) + (100 if b == 3 else 0)
        blocks.append(Block.of(np.arange(b * 32, b * 32 + 32), np.arange(b * 32, b * 32 + 32), rows.astype(np.int64)))
    plain = block_topk._product
    try:
        block_topk._product = lambda a, b, *x: (scored.append(len(b)), plain(a, b, *x))[1]
        q, ids, _ = search_tile(np.ones((1, 4), np.int64), np.array([-1]), blocks, 5)
    finally:
        block_topk._product = plain
    assert set(ids.tolist()) <= set(range(96, 128)) and len(q) == 5
    assert scored.count(32) == 1


def test_exact_beyond_floating_point():
    a = np.array([[3 << 30, 1]], np.int64)
    b = np.array([[1 << 31, 1], [1 << 31, 0]], np.int64)
    assert block_topk._product(a, b).tolist() == [[(3 << 61) + 1, 3 << 61]]


def test_too_large_numbers_are_errors(spark):
    with pytest.raises(OverflowError):
        block_topk._product(np.array([[1 << 40]], np.int64), np.array([[1 << 40]], np.int64))
    assert block_topk._product(np.array([[1 << 40]], np.int64), np.array([[1 << 40]], np.int64), True).tolist() == [[(1 << 63) - 1]]
    for rows in ([(0, [1e30]), (1, [1.0])], [(0, [1e15]), (1, [1e15])]):
        with pytest.raises(Exception, match="64 bits"):
            top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()


def test_clashing_columns(spark):
    rows = [(i, [0.1 * i, -0.2]) for i in range(25)]
    df = table(spark, rows).withColumns({c: F.lit("x") for c in ("id", "rid", "v", "shard", "score", "floor", "rank", "query_id")})
    assert sorted(map(tuple, top_k(df, F.col("id") % 20 == 0).collect())) == brute(rows, 20)


def test_few_queries_leave_their_shard():
    """Vectors that lie apart: a query's other shards are pruned by its kth score."""
    queries = np.array([[5, 0], [0, 5]], np.int64)
    most, least = np.array([[9, 1], [1, 9]], np.int64), np.array([[5, 0], [0, 5]], np.int64)
    assert block_topk._bounds(queries, most, least).tolist() == [[45, 5], [5, 45]]


def test_large_group_of_equal_vectors(spark, monkeypatch):
    """Ties beyond the kth id are neither sent for nor sent back."""
    monkeypatch.setattr(block_topk, "SHARD_ROWS", 16)
    rows = [(i, [0.5, 0.25]) for i in range(300)] + [(400 + i, [0.01 * i, 0.0]) for i in range(60)]
    assert run(spark, rows) == brute(rows, 20)
