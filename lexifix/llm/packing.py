"""Packing of token sequences with lexical neighbours.

Ids are encoded once and written. Documents are ordered by content, by four minimum hashes of their terms in which rare
terms weigh more, so that texts which share rare terms stand together; runs of that order are the shards, each with its
own BM25 index over token ids, weighted with the whole table's statistics. In a shard, the next unused document is the
seed of a sequence; the index returns its neighbours for all its terms, and unused ones fill the window best first. The
document that overruns the window is cut and its rest is the seed of the next sequence, so only a shard's last sequence
is padded. Neighbours in other shards aren't seen; ``neighbour_recall`` tells how many those are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ensure_shipped
from .common import crc32_text, partitions, read, written
from .tokens import encoder, token_bytes

LENGTH = 4096
END_ID = 2
#: Ids in a shard, about: 512 sequences, 6 MB of text.
SHARD_IDS = 1 << 21
#: Shards in a partition, about, and the greatest number of partitions unless the session has more.
PART_SHARDS, MAX_PARTS = 4, 10_000
#: Minimum hashes of a document's terms, by which documents are ordered.
HASHES = 4
K1, B = 1.2, 0.75
#: A term in over one in this many of a shard's documents is common.
COMMON = 16


@dataclass(frozen=True)
class Statistics:
    """Of all documents: their number, their ids without the end ids, and for each term the documents that have it."""

    docs: int
    ids: int
    df: np.ndarray

    @property
    def idf(self) -> np.ndarray:
        return np.log1p((self.docs - self.df + 0.5) / (self.df + 0.5))

    def ranks(self) -> np.ndarray:
        """Terms' places in HASHES random orders in which a term of weight w comes first with a chance in proportion."""
        draws = np.random.default_rng(42).random((HASHES, len(self.df)))
        order = np.argsort(-np.log1p(-draws) / self.idf, axis=1, kind="stable")
        out = np.empty(order.shape, np.int32)
        np.put_along_axis(out, order, np.arange(len(self.df), dtype=np.int32)[None], axis=1)
        return out


def _term_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
    return s[first], np.diff(np.r_[first, len(s)])


class Bm25Index:
    """Inverted index of a shard's documents; terms are token ids. Without ``whole`` the documents are all there are."""

    def __init__(self, docs: list[np.ndarray], whole: Statistics | None = None) -> None:
        self.n = len(docs)
        pairs = [_term_counts(ids) for ids in docs]
        terms, counts = [t for t, _ in pairs], [c for _, c in pairs]
        owners = [np.full(len(t), k) for k, t in enumerate(terms)]
        sizes = np.array([len(d) for d in docs], float)
        term, tf, owner = np.concatenate(terms), np.concatenate(counts).astype(float), np.concatenate(owners)
        self.bounds = np.cumsum([0, *map(len, terms)])
        known, self.slot, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = whole.idf[known] if whole else np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(whole.ids / whole.docs if whole else sizes.mean(), 1.0))
        self.weight = (idf[self.slot] * tf * (K1 + 1) / (tf + norm[owner])).astype(np.float32)
        self.df = df
        order = np.argsort(self.slot, kind="stable")
        self.starts = np.r_[0, np.cumsum(df)]
        self.posted, self.posted_weight = owner[order], self.weight[order].astype(float)
        # terms that many documents have are rows of a table, at most 4 * COMMON bytes a posting
        common = np.flatnonzero(df > self.n // COMMON)
        self.row = np.full(len(df), -1)
        self.row[common] = np.arange(len(common))
        self.table = np.zeros((len(common), self.n), np.float32)
        dense = self.row[self.slot] >= 0
        self.table[self.row[self.slot[dense]], owner[dense]] = self.weight[dense]

    def neighbours(self, k: int) -> np.ndarray:
        """Documents that share a term with document k, best first; equal scores in the documents' order."""
        slots = self.slot[self.bounds[k] : self.bounds[k + 1]]
        slots = slots[self.df[slots] > 1]
        if not len(slots):
            return np.zeros(0, int)
        rows = self.row[slots]
        score = self.table[rows[rows >= 0]].sum(axis=0, dtype=np.float32).astype(float)
        spans = [slice(i, j) for i, j in zip(*(self.starts[slots[rows < 0] + e].tolist() for e in (0, 1)))]
        if spans:
            owners = np.concatenate([self.posted[s] for s in spans])
            score += np.bincount(owners, np.concatenate([self.posted_weight[s] for s in spans]), minlength=self.n)
        order = np.argsort(-score, kind="stable")
        return order[: np.count_nonzero(score > 0)]


@dataclass
class Packer:
    """Pieces (document, start, length, sequence, offset) of a shard."""

    sizes: list[int]
    index: Bm25Index
    length: int = LENGTH
    pieces: list[tuple[int, int, int, int, int]] = field(default_factory=list)

    def run(self) -> list[tuple[int, int, int, int, int]]:
        n, used, next_doc = len(self.sizes), np.zeros(len(self.sizes), bool), 0
        at = [0] * n  # ids already placed
        sequence, offset, seed = 0, 0, -1

        def place(k: int) -> bool:
            """Put what fits of document k into the window; whether a rest is left."""
            nonlocal offset
            used[k] = True
            take = min(self.length - offset, self.sizes[k] - at[k])
            if take:
                self.pieces.append((k, at[k], take, sequence, offset))
                at[k] += take
                offset += take
            return at[k] < self.sizes[k]

        while True:
            if seed < 0:
                while next_doc < n and used[next_doc]:
                    next_doc += 1
                if next_doc == n:
                    break
                seed = next_doc
            rest = seed if place(seed) else -1
            if rest < 0 and offset < self.length:
                for k in self.index.neighbours(seed).tolist():
                    if not used[k] and place(k):
                        rest = k
                    if offset == self.length:
                        break
            seed = rest
            if offset == self.length:
                sequence, offset = sequence + 1, 0
        return self.pieces


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _ids_of(column: pa.ChunkedArray | pa.Array, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(b or b"", dtype) for b in column.to_pylist()]


def _document_frequencies(dtype: str, terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, ids = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            for doc in _ids_of(batch.column(0), dtype):
                df[_term_counts(doc)[0]] += 1
                docs, ids = docs + 1, ids + len(doc)
        seen = np.flatnonzero(df)
        # the terms -1 and -2 stand for documents and ids
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[seen, -1, -2]), pa.array(np.r_[df[seen], docs, ids])], ["term", "n"])

    return run


def statistics(docs: DataFrame, dtype: str, terms: int) -> Statistics:
    """Of the written ids; to the driver come two numbers and one for each term of the vocabulary."""
    counts = docs.select("ids").mapInArrow(_document_frequencies(dtype, terms), "term long, n long")
    df, totals = np.zeros(terms, np.int64), {-1: 0, -2: 0}
    for term, n in counts.groupBy("term").agg(F.sum("n")).collect():
        if term < 0:
            totals[term] = n
        else:
            df[term] = n
    return Statistics(totals[-1], totals[-2], df)


def _with_keys(dtype: str, ranks: np.ndarray):
    labels = np.random.default_rng(43).permutation(ranks.shape[1]).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = _ids_of(batch.column("ids"), dtype)
            keys = np.full((HASHES, len(docs)), -1, np.int32)
            held = np.array([k for k, d in enumerate(docs) if len(d)], int)
            if len(held):
                ids = np.concatenate(docs)
                starts = np.cumsum([0] + [len(docs[k]) for k in held[:-1]])
                for h in range(HASHES):
                    keys[h, held] = np.minimum.reduceat(ranks[h][ids], starts)
            # long documents have small ranks: in an order of their own they'd share partitions
            keys = np.where(keys < 0, keys, labels[keys])
            names = batch.schema.names + [f"k{h}" for h in range(HASHES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(k) for k in keys]], names)

    return run


def _pack_runs(dtype: str, end_id: int, length: int, shard_ids: int, whole: Statistics, with_ids: bool):
    """Packs runs of ``shard_ids`` ids of a partition in order; a run is all that is held at once."""

    def pack(part: int, first: int, doc_ids: list, docs: list[np.ndarray]) -> tuple[pa.RecordBatch, int]:
        # the end ids say nothing, so the index doesn't hold them
        pieces = Packer([len(d) + 1 for d in docs], Bm25Index(docs, whole), length).run()
        ended = [np.append(d, np.array([end_id], dtype)) for d in docs]
        raws = [ended[k][s : s + n].astype("<u4").tobytes() for k, s, n, _, _ in pieces]
        base = (part << 32) + first
        columns = {
            "doc_id": pa.array([doc_ids[p[0]] for p in pieces], pa.int64()),
            "start": pa.array([p[1] for p in pieces], pa.int64()),
            "length": pa.array([p[2] for p in pieces], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(r) for r in raws], pa.int64()),
            "doc_tokens": pa.array([len(ended[p[0]]) for p in pieces], pa.int64()),
            "sequence_id": pa.array([base + p[3] for p in pieces], pa.int64()),
            "offset": pa.array([p[4] for p in pieces], pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array(raws, pa.binary())
        return pa.RecordBatch.from_pydict(columns), first + pieces[-1][3] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, size, doc_ids, docs = 0, 0, 0, [], []
        for batch in batches:
            part = batch.column("part")[0].as_py() if len(batch) else part
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                doc_ids.append(doc_id)
                docs.append(np.frombuffer(ids.as_py() or b"", dtype))
                size += len(docs[-1]) + 1
                if size >= shard_ids:
                    out, first = pack(part, first, doc_ids, docs)
                    yield out
                    size, doc_ids, docs = 0, [], []
        if docs:
            yield pack(part, first, doc_ids, docs)[0]

    return run


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    shard_ids: int = SHARD_IDS,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all rows of ``df``: each id of each row, and an end id after each row, lies in exactly one piece.

    Null and empty texts hold the end id only. Rows that share an id, repeated rows too, are documents of their own.
    ``with_ids`` adds the pieces' ids as little-endian unsigned 32-bit numbers. An empty table gives no pieces.
    """
    spark = df.sparkSession
    ensure_shipped(spark)
    enc = encoder(tokenizer, False)
    dtype = enc.dtype.str
    docs = written(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            crc32_text(text_col).alias("crc"),
            token_bytes(text_col, tokenizer, spaced=False).alias("ids"),
        ),
        "packing-ids",
    )
    whole = statistics(docs, dtype, enc.vocabulary)
    keys = [f"k{h}" for h in range(HASHES)]
    keyed = docs.mapInArrow(
        _with_keys(dtype, whole.ranks()), "doc_id long, crc long, ids binary, " + ", ".join(f"{k} int" for k in keys)
    )
    parts = -(-(whole.ids + whole.docs) // (shard_ids * PART_SHARDS))
    parts = max(1, min(parts, max(MAX_PARTS, partitions(spark))))
    # the last key tells rows apart that are equal in all else, so no group of copies fills a partition
    order = [*keys, "crc", "doc_id", "row"]
    runs = keyed.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order)
    runs = runs.sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    schema = _PIECES + (", ids binary" if with_ids else "")
    return runs.mapInArrow(_pack_runs(dtype, end_id, length, shard_ids, whole, with_ids), schema)


def neighbour_recall(docs: list[np.ndarray], shard: np.ndarray, seeds: list[int], k: int) -> float:
    """Share of the seeds' k best neighbours in an index of all documents that lie in the seed's shard."""
    index = Bm25Index(docs)
    best = [(s, [j for j in index.neighbours(s)[: k + 1].tolist() if j != s][:k]) for s in seeds]
    return float(np.mean([np.mean(shard[near] == shard[s]) for s, near in best if near]))


def op7_lexical_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of up to 4096 ids."""
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
