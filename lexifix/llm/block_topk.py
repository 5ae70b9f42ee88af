"""Exact top-k search by block-at-a-time pruning.

Vectors are integer term weights. Sorted by id they are cut into blocks of a few hundred; a block keeps a forward index
(its vectors as a matrix) and each term's greatest and least weight. For a query, a block's bound is the sum over terms
of the greatest product the block can have. Blocks are visited by falling bound and scored whole through the forward
index, until the bound is below the kth score found.

Runs of blocks (shards) are files in the shared folder, with one more file of the shards' own bounds; workers map them,
so no vector but the queries' is shuffled. A query goes to the shard of its greatest bound first. The kth score that it
finds there says which other shards it must go to: those whose bound reaches it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shipping import ensure_shipped
from .common import local_path, partitions, read, shared_dir, written

BLOCK_ROWS = 256
#: Rows of a shard at most, about.
SHARD_ROWS = 8192
#: Queries that are scored together.
QUERY_ROWS = 512
LOWEST = np.iinfo(np.int64).min


@dataclass
class Block:
    ids: np.ndarray
    rids: np.ndarray
    rows: np.ndarray  # forward index: a vector a row
    most: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, rids: np.ndarray, rows: np.ndarray) -> Block:
        return cls(ids, rids, rows, rows.max(axis=0), rows.min(axis=0))


def _matrix(lists: list[list[int]], width: int | None = None) -> np.ndarray:
    """Rows padded with zeros: an absent term has weight 0."""
    width = max(map(len, lists), default=0) if width is None else width
    out = np.zeros((len(lists), width), np.int64)
    for k, row in enumerate(lists):
        out[k, : len(row)] = row
    return out


def _wide(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, [(0, 0)] * (rows.ndim - 1) + [(0, width - rows.shape[-1])])


def _product(a: np.ndarray, b: np.ndarray, bound: bool = False) -> np.ndarray:
    """Exact a @ b.T: in floating point where every partial sum is a whole number below 2 ** 53, in whole numbers of any
    size where 64 bits might not do. A score beyond 64 bits is an error; a ``bound`` stops at the greatest number."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    top = np.iinfo(np.int64).max
    if bound:
        return np.clip(exact, LOWEST + 1, top).astype(np.int64)
    if (np.abs(exact) > top).any():
        raise OverflowError("an inner product needs more than 64 bits")
    return exact.astype(np.int64)


def _bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    width = max(queries.shape[1], most.shape[1])
    queries, most, least = (_wide(x, width) for x in (queries, most, least))
    up, down = _product(np.maximum(queries, 0), most, True), _product(np.minimum(queries, 0), least, True)
    sums = up.astype(float) + down.astype(float)
    return np.where(np.abs(sums) < 2**62, up + down, np.where(sums > 0, np.iinfo(np.int64).max, up + down))


def search_tile(queries: np.ndarray, own: np.ndarray, blocks: list[Block], k: int, floor: np.ndarray | None = None):
    """(query index, id, score) of each query's k best rows in the blocks; ``own``: row numbers that queries skip;
    ``floor``: scores below which a query needs no row.

    A block whose bound equals the kth score is still scored, since it may hold an equal score with a smaller id.
    """
    n, width = len(queries), max([queries.shape[1], *(b.rows.shape[1] for b in blocks)])
    queries = _wide(queries, width)
    for b in blocks:
        b.rows, b.most, b.least = (_wide(x, width) for x in (b.rows, b.most, b.least))
    bounds = _bounds(queries, np.stack([b.most for b in blocks]), np.stack([b.least for b in blocks]))
    order = np.argsort(-bounds, axis=1, kind="stable")
    kth = np.full(n, LOWEST) if floor is None else floor.copy()
    full = kth > LOWEST
    held_q = held_id = held_score = np.zeros(0, np.int64)
    live = np.arange(n)
    for visit in range(len(blocks)):
        at = order[live, visit]
        open_ = ~full[live] | (bounds[live, at] >= kth[live])
        live, at = live[open_], at[open_]  # bounds only fall from here on
        if not len(live):
            break
        new_q, new_id, new_score = [held_q], [held_id], [held_score]
        for b in np.unique(at).tolist():
            qs = live[at == b]
            scores = _product(queries[qs], blocks[b].rows)
            good = (scores >= kth[qs, None]) & (blocks[b].rids[None, :] != own[qs, None])
            i, j = np.nonzero(good)
            new_q.append(qs[i])
            new_id.append(blocks[b].ids[j])
            new_score.append(scores[i, j])
        q, ids, score = np.concatenate(new_q), np.concatenate(new_id), np.concatenate(new_score)
        best = np.lexsort((ids, -score, q))
        q, ids, score = q[best], ids[best], score[best]
        first = np.searchsorted(q, np.arange(n))
        rank = np.arange(len(q)) - first[q]
        keep = rank < k
        last = rank == k - 1
        kth[q[last]], full[q[last]] = score[last], True
        held_q, held_id, held_score = q[keep], ids[keep], score[keep]
    return held_q, held_id, held_score


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """(id, rid, v): floor(scale * x) of each component. Rows without an id, with a null vector or with a null or
    non-finite component take no part; a finite component beyond 64-bit numbers is an error."""
    sound = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()
    finite = F.forall(
        F.col(vec_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )
    rows = df.where(sound & F.coalesce(finite, F.lit(False)))
    able = lambda c: F.abs(c.cast("double") * scale) < F.lit(9.2e18)
    failed = F.raise_error(F.lit("a component needs more than 64 bits")).cast("bigint")
    x = F.transform(F.col(vec_col), lambda c: F.when(able(c), F.floor(c.cast("double") * scale)).otherwise(failed))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("rid"), x.alias("v"))


def _save(path: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after the other, renamed into place when whole."""
    passing = f"{path}.{os.getpid()}.{TaskContext.get().attemptNumber()}"
    with open(passing, "wb") as f:
        for a in arrays:
            np.lib.format.write_array(f, np.ascontiguousarray(a), allow_pickle=False)
    os.replace(passing, path)


def _load(path: str, count: int) -> list[np.ndarray]:
    with open(path, "rb") as f:
        return [np.lib.format.read_array(f, allow_pickle=False) for _ in range(count)]


def _write_shards(folder: str, shard_rows: int):
    """Rows sorted by id to a file of shards' blocks for each task: (shard, most, least, smallest id) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def shard(rows: list) -> pa.RecordBatch:
            nonlocal number
            name, matrix = f"{part}-{number}", _matrix([r[2] for r in rows])
            number += 1
            cuts = np.arange(0, len(rows), BLOCK_ROWS)
            ids, rids = (np.array([r[c] for r in rows], np.int64) for c in (0, 1))
            most, least = np.maximum.reduceat(matrix, cuts, axis=0), np.minimum.reduceat(matrix, cuts, axis=0)
            _save(f"{folder}/shard-{name}", [ids, rids, matrix, most, least])
            columns = [[name], [most.max(axis=0).tolist()], [least.min(axis=0).tolist()], [int(ids.min())]]
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "most", "least", "low"])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in range(3)))
            while len(held) >= shard_rows:
                yield shard(held[:shard_rows])
                held = held[shard_rows:]
        if held:
            yield shard(held)

    return run


def _write_bounds(folder: str):
    """The shards' names, smallest ids and bounds to one file, by smallest id; a shard costs two numbers a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in range(4)))]
        rows.sort(key=lambda r: (r[3], r[0]))
        width = max((len(r[1]) for r in rows), default=0)
        names = np.array([[*map(int, r[0].split("-")), r[3]] for r in rows], np.int64).reshape(-1, 3)
        _save(f"{folder}/bounds", [names, _matrix([r[1] for r in rows], width), _matrix([r[2] for r in rows], width)])
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["shards"])

    return run


_SENT = "shard int, id long, rid long, v array<long>, floor long, floor_id long"
_FOUND = _SENT + ", vec_id long, score long"


def _sent(shard, ids, rids, vectors, floor, floor_id, vec_id=None, score=None) -> pa.RecordBatch:
    columns = [pa.array(shard, pa.int32()), pa.array(ids, pa.int64()), pa.array(rids, pa.int64())]
    columns += [pa.array(vectors, pa.list_(pa.int64())), pa.array(floor, pa.int64()), pa.array(floor_id, pa.int64())]
    names = ["shard", "id", "rid", "v", "floor", "floor_id"]
    if vec_id is not None:
        columns += [pa.array(vec_id, pa.int64()), pa.array(score, pa.int64())]
        names += ["vec_id", "score"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _to_best(folder: str, query_rows: int):
    """Queries to the shard of their greatest bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, most, least = _load(f"{folder}/bounds", 3)
        for batch in batches:
            for at in range(0, batch.num_rows, query_rows):
                ids, rids, vectors = (batch.column(c).slice(at, query_rows).to_pylist() for c in range(3))
                best = _bounds(_matrix(vectors), most, least).argmax(axis=1)
                yield _sent(best, ids, rids, vectors, [LOWEST] * len(ids), [LOWEST] * len(ids))

    return run


def _search(folder: str, k: int, spread: bool, query_rows: int):
    """Queries sorted by shard to what they find there; ``spread``: also, as rows without a score, the queries for the
    other shards that may hold something before their kth row: a greater score, or an equal one with a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, most, least = _load(f"{folder}/bounds", 3)
        open_: tuple[int, list[Block]] = (-1, [])

        def solve(shard: int, rows: list) -> Iterator[pa.RecordBatch]:
            nonlocal open_
            if open_[0] != shard:
                ids, rids, matrix, top, low = _load(f"{folder}/shard-{names[shard][0]}-{names[shard][1]}", 5)
                cuts = [slice(b, b + BLOCK_ROWS) for b in range(0, len(ids), BLOCK_ROWS)]
                open_ = shard, [Block(ids[c], rids[c], matrix[c], top[n], low[n]) for n, c in enumerate(cuts)]
            ids, rids, vectors, floors, floor_ids = (list(x) for x in zip(*rows))
            queries, floor, floor_id = _matrix(vectors), np.array(floors, np.int64), np.array(floor_ids, np.int64)
            q, vec, score = search_tile(queries, np.array(rids, np.int64), open_[1], k, floor)
            better = (score > floor[q]) | ((score == floor[q]) & (vec < floor_id[q]))
            if better.any():
                own = q[better].tolist()
                nulls = [None] * len(own)
                yield _sent(nulls, [ids[i] for i in own], [rids[i] for i in own], nulls, nulls, nulls, vec[better], score[better])
            if not spread:
                return
            kth, kth_id = np.full(len(ids), LOWEST), np.full(len(ids), np.iinfo(np.int64).max)
            full = np.flatnonzero(np.bincount(q, minlength=len(ids)) == k)
            last = np.searchsorted(q, full, "right") - 1  # rows are sorted by query, score and id
            kth[full], kth_id[full] = score[last], vec[last]
            bounds = _bounds(queries, most, least)
            reach = (bounds > kth[:, None]) | ((bounds == kth[:, None]) & (names[:, 2] < kth_id[:, None]))
            reach[:, shard] = False
            i, s = np.nonzero(reach)
            for at in range(0, len(i), 4096):
                a = i[at : at + 4096]
                nulls = [None] * len(a)
                lists = [ids[x] for x in a], [rids[x] for x in a], [vectors[x] for x in a]
                yield _sent(s[at : at + 4096], *lists, kth[a], kth_id[a], nulls, nulls)

        shard, held = -1, []
        for batch in batches:
            for s, *row in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if held and (s != shard or len(held) >= query_rows):
                    yield from solve(shard, held)
                    held = []
                shard = s
                held.append(row)
        if held:
            yield from solve(shard, held)

    return run


def top_k(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of greatest inner product, ties to the smaller id.

    ``is_query``: condition on the column ``id``. A query never finds its own row, but may find another row with its
    id. Vectors of unequal lengths are padded with zeros. An empty table gives no rows. Other columns aren't read, so
    their names can't clash. Scores beyond 64-bit numbers are an error.
    """
    spark = df.sparkSession
    ensure_shipped(spark)
    rows = written(whole_vectors(df, id_col, vec_col, scale), "vectors")
    folder = local_path(shared_dir(spark, "vector-shards"))
    parts = max(partitions(spark), -(-rows.count() // (8 * SHARD_ROWS)))
    sorted_rows = rows.repartitionByRange(parts, "id", "rid").sortWithinPartitions("id", "rid")
    bounds = written(sorted_rows.mapInArrow(_write_shards(folder, SHARD_ROWS), "shard string, most array<long>, least array<long>, low long"), "bounds")
    n_shards = bounds.coalesce(1).mapInArrow(_write_bounds(folder), "shards long").first()
    if not n_shards or not n_shards.shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def by_shard(sent: DataFrame) -> DataFrame:
        """Dealt by shard and number, so the queries of one shard are many tasks' work."""
        dealt = sent.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.lit(64)))
        return dealt.repartition("shard", "chunk").sortWithinPartitions("shard", "chunk").drop("chunk")

    first = by_shard(rows.where(is_query).mapInArrow(_to_best(folder, QUERY_ROWS), _SENT))
    first = written(first.mapInArrow(_search(folder, k, True, QUERY_ROWS), _FOUND), "best-shards")
    rest = by_shard(first.where("score IS NULL").drop("vec_id", "score")).mapInArrow(_search(folder, k, False, QUERY_ROWS), _FOUND)
    found = first.where("score IS NOT NULL").unionByName(rest).select(F.col("id").alias("query_id"), "rid", "vec_id", "score")
    best = Window.partitionBy("query_id", "rid").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_block_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best rows for each vector whose id is divisible by 20."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
