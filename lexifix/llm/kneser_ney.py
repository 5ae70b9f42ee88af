"""Interpolated modified Kneser-Ney bigram model in sorted, memory-mapped arrays.

Counting runs in Spark. Tasks count what they read and send compressed arrays to shards chosen by hash, so hot words are
pre-aggregated and spread; a shard's task merges the arrays and writes them sorted to the shared folder:

* ``vocab-S.npy``: sorted 64-bit hashes of the words with that prefix, and their counts; a word's number is its place;
* ``pairs-S.npy``: sorted pairs (context number, word number) with that hash, and their counts;
* ``ctx-S.npy``: for the words of vocabulary shard S as contexts the sum of counts and the numbers of followers seen
  once, twice and more often; as words the number of contexts they follow.

Scoring tasks map the files into memory, look words and pairs up by binary search and interpolate:
p(w | h) = (c(hw) - D(c(hw))) / c(h) + g(h) * p(w), p(w) from numbers of contexts with discounts of their own, and at
the bottom 1 / (V + 1) for every word and for unknown ones. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ensure_shipped
from .common import fold_of, local_path, partitions, read, shared_dir, written

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The end token's name; no word has white space.
END = b"\n"
#: Tokens counted together in memory.
BLOCK_TOKENS = 2_000_000
#: Bytes of text that a shard of the model is counted from, about, and the number of shards at most (as a power of two).
SHARD_TEXT = 32 << 20
MOST_BITS = 20
#: Words whose hashes a worker remembers.
CACHED_WORDS = 400_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def token_hashes(text: str | None) -> list[int]:
    """Hashes of the words, A-Z lowered, and of the end token."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    words.append(END)
    return list(map(_hashes.__getitem__, words))


def blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch | int], np.ndarray, np.ndarray]]:
    """(rows, token hashes, documents' ends) for runs of documents of about BLOCK_TOKENS tokens."""
    rows, parts, ends, size = [], [], [], 0
    for batch in batches:
        for k, text in enumerate(batch.column(column)):
            part = np.array(token_hashes(text.as_py()), np.uint64)
            rows.append((batch, k))
            parts.append(part)
            size += len(part)
            ends.append(size)
            if size >= BLOCK_TOKENS:
                yield rows, np.concatenate(parts), np.array(ends)
                rows, parts, ends, size = [], [], [], 0
    if rows:
        yield rows, np.concatenate(parts), np.array(ends)


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def unpack(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype) if b else np.zeros(0, dtype)


def mixed(keys: np.ndarray) -> np.ndarray:
    z = (keys + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(32))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts (one column, or several)."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first, axis=0) if len(first) else counts[:0]


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one after the other, each with its .npy head; renamed into place when whole."""
    passing = os.path.join(folder, f"{name}.{os.getpid()}.{TaskContext.get().attemptNumber() if TaskContext.get() else 0}")
    os.makedirs(folder, exist_ok=True)
    with open(passing, "wb") as f:
        for a in arrays.values():
            np.lib.format.write_array(f, np.ascontiguousarray(a), allow_pickle=False)
    os.replace(passing, os.path.join(folder, name))


def mapped(path: str, count: int) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped."""
    out = []
    with open(path, "rb") as f:
        for _ in range(count):
            np.lib.format.read_magic(f)
            shape, _, dtype = np.lib.format.read_array_header_1_0(f)
            size = int(np.prod(shape)) * dtype.itemsize
            at = f.tell()
            out.append(np.memmap(path, dtype, "r", at, shape) if size else np.zeros(shape, dtype))
            f.seek(at + size)
    return out


def by_shard(shard: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, indices) of the shards that occur; indices keep their order."""
    order = np.argsort(shard.astype(np.uint16 if n <= 1 << 16 else np.uint32), kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(n + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, order[cuts[s] : cuts[s + 1]]


def narrow(counts: np.ndarray) -> np.ndarray:
    """32 bits a count where those do."""
    return counts.astype("<u4" if counts.max(initial=0) < 1 << 32 else "<u8")


_PARTS = "shard int, a binary, b binary, c binary"


def part_batch(rows: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch:
    shard, a, b, c = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(shard, pa.int32()), *(pa.array(x, pa.binary()) for x in (a, b, c))], names=["shard", "a", "b", "c"]
    )


def part_arrays(table: pa.Table, dtypes: tuple[str, str, str]) -> list[np.ndarray]:
    return [np.concatenate([unpack(x, d) for x in table.column(n).to_pylist()]) for n, d in zip("abc", dtypes)]


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, _ in blocks(batches, 0):
            words, counts = np.unique(tokens, return_counts=True)
            shard = (words >> np.uint64(64 - bits)).astype(np.int64)
            rows = [(s, pack(words[i]), pack(counts[i].astype("<u8")), b"") for s, i in by_shard(shard, 1 << bits)]
            yield part_batch(rows)

    return run


def _merge_words(folder: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        words, counts, _ = part_arrays(table, ("<u8", "<u8", "<u4"))
        words, counts = summed(words, counts.astype(np.int64))
        save(folder, f"vocab-{shard}.npy", {"words": words, "counts": counts})
        return pa.table({"shard": [shard], "n": [len(words)], "total": [int(counts.sum())]})

    return run


class Vocabulary:
    """Word numbers and counts by hash, from the mapped shards. The number V stands for a text's start."""

    def __init__(self, folder: str, bits: int, bases: list[int]) -> None:
        self.folder, self.bits, self.bases = folder, bits, bases
        self.size = bases[-1]
        self.files: dict[int, list[np.ndarray]] = {}

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, counts) of sorted distinct hashes; -1 and 0 for unknown words."""
        numbers, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        shard = (words >> np.uint64(64 - self.bits)).astype(np.int64)
        for s, i in by_shard(shard, 1 << self.bits):
            if self.bases[s] == self.bases[s + 1]:
                continue
            if s not in self.files:
                self.files[s] = mapped(f"{self.folder}/vocab-{s}.npy", 2)
            known, freq = self.files[s]
            at = np.minimum(np.searchsorted(known, words[i]), len(known) - 1)
            hit = known[at] == words[i]
            numbers[i[hit]] = at[hit] + self.bases[s]
            counts[i[hit]] = freq[at[hit]]
        return numbers, counts

    def shards_of(self, numbers: np.ndarray) -> np.ndarray:
        """Vocabulary shard of each word number; a text's start belongs to the last."""
        return np.minimum(np.searchsorted(np.array(self.bases), numbers, "right") - 1, (1 << self.bits) - 1)


def contexts_of(numbers: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """The token before each; ``start`` before a document's first."""
    before = np.r_[start, numbers[:-1]]
    before[np.r_[0, ends[:-1]]] = start
    return before


def _count_pairs(folder: str, bits: int, bases: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(folder, bits, bases)
        for _, tokens, ends in blocks(batches, 0):
            words, back = np.unique(tokens, return_inverse=True)
            numbers = vocabulary.find(words)[0][back]
            before = contexts_of(numbers, ends, vocabulary.size)
            keys, counts = np.unique((before.astype(np.uint64) << np.uint64(32)) | numbers.astype(np.uint64), return_counts=True)
            shard = (mixed(keys) >> np.uint64(64 - bits)).astype(np.int64)
            rows = [
                (s, pack((keys[i] >> np.uint64(32)).astype("<u4")), pack(keys[i].astype("<u4")), pack(counts[i].astype("<u8")))
                for s, i in by_shard(shard, 1 << bits)
            ]
            yield part_batch(rows)

    return run


#: Kinds of rows that a merged shard of pairs sends on.
_AS_CONTEXT, _AS_WORD, _COUNTS = 0, 1, 2
_STATS = "kind int, shard int, a binary, b binary, c binary"


def _merge_pairs(folder: str, bits: int, bases: list[int]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard, n = key[0].as_py(), 1 << bits
        first, second, counts = part_arrays(table, ("<u4", "<u4", "<u8"))
        keys, counts = summed((first.astype(np.uint64) << np.uint64(32)) | second, counts.astype(np.int64))
        save(folder, f"pairs-{shard}.npy", {"keys": keys, "counts": narrow(counts)})
        vocabulary = Vocabulary(folder, bits, bases)
        seen = np.stack([counts, counts == 1, counts == 2, counts > 2], axis=1).astype(np.int64)
        contexts, seen = summed((keys >> np.uint64(32)).astype(np.int64), seen)
        words, follows = summed((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), np.ones(len(keys), np.int64))
        rows = []
        for s, i in by_shard(vocabulary.shards_of(contexts), n):
            rows.append((_AS_CONTEXT, s, pack(contexts[i].astype("<u4")), pack(seen[i, 0].astype("<u8")), pack(seen[i, 1:].astype("<u4"))))
        for s, i in by_shard(vocabulary.shards_of(words), n):
            rows.append((_AS_WORD, s, pack(words[i].astype("<u4")), pack(follows[i].astype("<u4")), b""))
        tally = np.array([np.count_nonzero(counts == k) for k in range(1, 5)], "<i8")
        rows.append((_COUNTS, -1, pack(tally), b"", b""))
        names = [c.split()[0] for c in _STATS.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _merge_contexts(folder: str, bits: int, bases: list[int]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        low, size = bases[shard], bases[shard + 1] - bases[shard] + (shard == (1 << bits) - 1)
        total, seen, follows = np.zeros(size, np.int64), np.zeros((size, 3), np.int64), np.zeros(size, np.int64)
        for kind, a, b, c in zip(*(table.column(n).to_pylist() for n in ("kind", "a", "b", "c"))):
            at = unpack(a, "<u4").astype(np.int64) - low
            if kind == _AS_CONTEXT:  # a sender's words are distinct
                total[at] += unpack(b, "<u8").astype(np.int64)
                seen[at] += unpack(c, "<u4").reshape(-1, 3)
            else:
                follows[at] += unpack(b, "<u4")
        save(folder, f"ctx-{shard}.npy", {"total": total, "seen": seen.astype("<u4"), "follows": follows.astype("<u4")})
        tally = [int(np.count_nonzero(follows == k)) for k in range(1, 5)]
        return pa.table({"shard": [shard], "more": [int(np.count_nonzero(follows > 2))], "total": [int(follows.sum())], "tally": [tally]})

    return run


def discounts(tally: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of things seen once to four times; too few to tell: one half of each, kept positive."""
    n1, n2, n3, n4 = tally
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), float(k + 1)) for k, d in enumerate(raw)]


def discount_of(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def train(docs: DataFrame, folder: str, text_col: str = "text") -> dict:
    """Count all rows of ``docs`` into ``folder`` (a shared folder's URI); the model's manifest, also written there."""
    spark, target = docs.sparkSession, local_path(folder)
    ensure_shipped(spark)
    texts = docs.select(text_col)
    size = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    # shards of a size that doesn't depend on the table's, and enough of them for all tasks
    bits = max(1, min(MOST_BITS, (max(partitions(spark), -(-size // SHARD_TEXT)) - 1).bit_length()))
    words = texts.mapInArrow(_count_words(bits), _PARTS)
    merged = words.groupBy("shard").applyInArrow(_merge_words(target), "shard long, n long, total long").collect()  # a row a shard
    sizes = {r.shard: r.n for r in merged}
    bases = [0]
    for s in range(1 << bits):
        bases.append(bases[-1] + sizes.get(s, 0))
    if bases[-1] >= (1 << 32) - 1:
        raise ValueError("more than 2 ** 32 distinct words")
    pairs = texts.mapInArrow(_count_pairs(target, bits, bases), _PARTS)
    stats = written(pairs.groupBy("shard").applyInArrow(_merge_pairs(target, bits, bases), _STATS), "pair-stats")
    tally = np.zeros(4, np.int64)
    for r in stats.where(F.col("kind") == _COUNTS).select("a").collect():  # a row a shard
        tally += unpack(r.a, "<i8")
    contexts = stats.where(F.col("kind") != _COUNTS).groupBy("shard")
    found = contexts.applyInArrow(_merge_contexts(target, bits, bases), "shard long, more long, total long, tally array<long>").collect()
    follow_tally = np.sum([r.tally for r in found], axis=0).tolist() if found else [0] * 4
    total = sum(r.total for r in found)
    d = discounts(follow_tally)
    rest = (d[0] * follow_tally[0] + d[1] * follow_tally[1] + d[2] * sum(r.more for r in found)) / total if total else 1.0
    model = {
        "bits": bits,
        "bases": bases,
        "tokens": sum(r.total for r in merged),
        "words": bases[-1],
        "pair_discounts": discounts(tally.tolist()),
        "word_discounts": d,
        "pairs": total,
        "rest": rest,
        "contexts": sorted(r.shard for r in found),
    }
    os.makedirs(target, exist_ok=True)
    with open(f"{target}/manifest.json.new", "w") as f:
        json.dump(model, f)
    os.replace(f"{target}/manifest.json.new", f"{target}/manifest.json")
    return model


class Scorer:
    """Log-probabilities from the mapped files; one for a task."""

    def __init__(self, folder: str, model: dict) -> None:
        self.folder, self.model = folder, model
        self.vocabulary = Vocabulary(folder, model["bits"], model["bases"])
        self.pairs: dict[int, list[np.ndarray]] = {}
        self.contexts: dict[int, list[np.ndarray]] = {}
        self.known_contexts = set(model["contexts"])

    def _pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct keys."""
        out, bits = np.zeros(len(keys), np.int64), self.model["bits"]
        shard = (mixed(keys) >> np.uint64(64 - bits)).astype(np.int64)
        for s, i in by_shard(shard, 1 << bits):
            if s not in self.pairs:
                path = f"{self.folder}/pairs-{s}.npy"
                self.pairs[s] = mapped(path, 2) if os.path.exists(path) else [np.zeros(0, np.uint64), np.zeros(0, np.uint32)]
            known, counts = self.pairs[s]
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[i]), len(known) - 1)
                out[i] = np.where(known[at] == keys[i], counts[at], 0)
        return out

    def _context(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum of counts, followers seen once, twice, more; contexts followed) of sorted distinct word numbers."""
        total, seen, follows = np.zeros(len(numbers), np.int64), np.zeros((len(numbers), 3)), np.zeros(len(numbers), np.int64)
        for s, i in by_shard(self.vocabulary.shards_of(numbers), 1 << self.model["bits"]):
            if s not in self.known_contexts:
                continue
            if s not in self.contexts:
                self.contexts[s] = mapped(f"{self.folder}/ctx-{s}.npy", 3)
            at = numbers[i] - self.model["bases"][s]
            for out, source in zip((total, seen, follows), self.contexts[s]):
                out[i] = source[at]
        return total, seen, follows

    def score(self, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per document: (tokens, known tokens, base score, score), scores as sums of log10 probabilities."""
        m = self.model
        words, back = np.unique(tokens, return_inverse=True)
        numbers, counts = self.vocabulary.find(words)
        base = np.log10((counts + 0.5) / (m["tokens"] + 0.5 * (m["words"] + 1)))[back]
        start = m["words"]
        ids = numbers[back]
        before = contexts_of(ids, ends, start)
        uses = np.r_[numbers[numbers >= 0], start]
        uses = np.unique(uses)
        total, seen, follows = self._context(uses)
        weight = np.where(total > 0, (seen @ np.array(m["pair_discounts"])) / np.maximum(total, 1), 1.0)
        single = np.maximum(follows - discount_of(follows, m["word_discounts"]), 0.0) / max(m["pairs"], 1)
        bottom = m["rest"] / (m["words"] + 1)
        slot = np.minimum(np.searchsorted(uses, ids), len(uses) - 1)
        p = np.where(ids >= 0, single[slot], 0.0) + bottom
        slot = np.minimum(np.searchsorted(uses, before), len(uses) - 1)
        inside = np.flatnonzero((before >= 0) & (total[slot] > 0))
        p[inside] *= weight[slot[inside]]
        both = inside[ids[inside] >= 0]
        keys, where = np.unique((before[both].astype(np.uint64) << np.uint64(32)) | ids[both].astype(np.uint64), return_inverse=True)
        pair = self._pair_counts(keys)
        gain = np.maximum(pair - discount_of(pair, m["pair_discounts"]), 0.0)
        p[both] += gain[where] / total[slot[both]]
        starts = np.r_[0, ends[:-1]]
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every document has its end token
        return ends - starts, add((counts > 0)[back].astype(np.int64)), add(base), add(np.log10(p))


_SCORES = "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(folder: str, model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(folder, model)
        for rows, tokens, ends in blocks(batches, 1):
            n, known, base, score = scorer.score(tokens, ends)
            ids = [b.column(0)[k].as_py() for b, k in rows]
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(known, pa.int64())]
            columns += [pa.array([model["tokens"]] * len(ids), pa.int64()), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCORES.split(", ")])

    return run


def log_probabilities(docs: DataFrame, folder: str, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Null and empty texts consist of the end token. A model of an empty table gives every token probability 1, as its
    base does. A text's perplexity is 10 ** (-score / n_tokens).
    """
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(_score(local_path(folder), model), _SCORES)


def op4_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    folder = shared_dir(spark, "kneser-ney")
    model = train(docs.where(fold_of("doc_id", 5) != 1), folder)
    scores = log_probabilities(docs, folder, model).withColumnRenamed("id", "doc_id")
    return scores.withColumn("held_out", fold_of("doc_id", 5) == 1).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
