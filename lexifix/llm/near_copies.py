"""Groups of texts whose sets of word shingles have a Jaccard similarity of at least a limit, found exactly.

1. Every text becomes the set of its shingles' 64-bit hashes; the sets lie in files of the shared folder, one per task.
   Equal sets collapse to one, which has a SimHash fingerprint, the vote of its hashes.
2. Fingerprints at most 2 bits apart are found by their pivot distances, as in ``simhash.py``. The sets of a component of
   these links are compared, and those that are similar are a group.
3. Similar sets may differ in more bits (about 10 at 0.8), which no pivots single out, so an exact way finds the rest. Sets of sizes a and b that are similar to t share at least t * max(a, b) shingles. So whatever order the shingles have,
   each set's first n - ceil(t * n) + 1 ones hold a shared one: only these are dealt out. Shingles that are common in a
   sample of the texts come last in the order, which makes the first ones rare; the order never changes the result.
   Sets that meet under a shingle are compared, unless fingerprints or links found before join them already. A set is compared with a
   group's members only until one is similar, so a large group of near copies costs one comparison a member, about.
4. Components of the links are the groups.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ensure_shipped
from .common import drop_dir, local_path, lookup, shared_dir, written
from .simhash import LOWER, components, fingerprint_links, keep_leads, text_hash, vote

SHINGLE = 5
SIMILARITY = 0.8
#: Distinct texts in the sample that says which shingles are common, about.
SAMPLE = 10_000
#: Common shingles that are told to the tasks at most (0.8 MB).
COMMON = 100_000
#: A set's place: the task's number, then the place in its file in words of 8 bytes.
PLACE_BITS = 36
#: Sets of a shingle that are kept in memory at most, and pairs that a task remembers as not similar.
HELD_SETS = 256
HELD_PAIRS = 200_000

_digest = partial(xxhash.xxh64_digest, seed=42)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes; a shorter text, even an empty one, is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(words) <= shingle:
        hashes = _digest(b" ".join(words))
    else:
        hashes = b"".join(map(_digest, map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))))
    return np.unique(np.frombuffer(hashes, "<u8"))


def prefix(own: np.ndarray, common: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of the order: not common ones by hash, then common ones, the most common last."""
    size = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
    if not len(common):
        return own[:size]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    rank = np.where(common[at] == own, ranks[at], -1)
    return own[np.argsort(rank, kind="stable")[:size]]


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _sampled_shingles(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_signed(shingle_set(text.as_py(), shingle)))], names=["s"])

    return run


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the sample's common shingles, and their ranks from the least common."""
    step = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("text_hash"), F.lit(step)) == 0).dropDuplicates(["text_hash"]).select("text")
    counts = sample.mapInArrow(_sampled_shingles(shingle), "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.where("n > 2").orderBy(F.desc("n"), "s").limit(COMMON).collect()  # COMMON rows at most
    found = np.array([r.s for r in rows][::-1], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], order.astype(np.int32)


def _write_sets(folder: str, shingle: int, similarity: float, common: np.ndarray, ranks: np.ndarray):
    """(id, text_hash, sig, fp, place, prefix); the file has each set's size and the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().taskAttemptId()  # a repeated task writes a file of its own
        place = task << PLACE_BITS
        with open(f"{folder}/{task}", "wb") as f:
            for batch in batches:
                sigs, fps, places, firsts = [], [], [], []
                for text in batch.column(2):
                    own = shingle_set(text.as_py(), shingle)
                    raw = own.tobytes()
                    f.write(len(own).to_bytes(8, "little") + raw)
                    sigs.append(xxhash.xxh64_intdigest(raw, seed=7))
                    fps.append(vote(raw))
                    places.append(place)
                    firsts.append(_signed(prefix(own, common, ranks, similarity)))
                    place += len(own) + 1
                ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
                values = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(_signed(np.array(sigs, np.uint64))),
                        pa.array(_signed(np.array(fps, np.uint64))),
                        pa.array(places, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                    ],
                    names=["id", "text_hash", "sig", "fp", "place", "prefix"],
                )

    return run


class Linker:
    """Links among sets that meet; remembers what it found."""

    def __init__(self, fetch, similarity: float) -> None:
        self.fetch, self.similarity = fetch, similarity
        self.parent: dict[int, int] = {}
        self.unlike: set[tuple[int, int]] = set()

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def similar(self, a: int, b: int, held: dict[int, np.ndarray]) -> bool:
        pair = (a, b) if a < b else (b, a)
        if pair in self.unlike:
            return False
        for k in pair:
            if k not in held:
                if len(held) >= HELD_SETS:
                    held.pop(next(iter(held)))
                held[k] = self.fetch(k)
        x, y = held.get(a), held.get(b)
        x, y = self.fetch(a) if x is None else x, self.fetch(b) if y is None else y
        if len(x) > len(y):
            x, y = y, x
        if len(x) >= self.similarity * len(y) - 1e-9:
            shared = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
            if shared >= self.similarity * (len(x) + len(y) - shared) - 1e-9:
                return True
        if len(self.unlike) < HELD_PAIRS:
            self.unlike.add(pair)
        return False

    def link(self, places: list[int], leads: list[int]) -> Iterator[tuple[int, int]]:
        """Links that join the similar ones of ``places``, none within a group that is joined already; places with equal
        ``leads`` are."""
        groups: dict[int, list[int]] = {}
        held: dict[int, np.ndarray] = {}
        for a, lead in zip(places, leads):
            own = self.find(lead)
            for root in list(groups):
                if root == own or root not in groups:
                    continue
                match = next((b for b in groups[root] if self.similar(a, b, held)), None)
                if match is None:
                    continue
                yield a, match
                groups.setdefault(root, []).extend(groups.pop(own, []))
                self.parent[own] = root
                own = root
            groups.setdefault(own, []).append(a)


def _similar_links(folder: str, similarity: float, whole: bool = False):
    """Rows (s, place, lead) sorted by s, under which sets meet, to links; the last s of a batch waits for the next batch.

    ``lead`` is what to add to a place for that of its group's lead. ``whole``: each place is in one row, the links are
    from places to their group's lead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[int, int] = {}

        def fetch(place: int) -> np.ndarray:
            task, at = place >> PLACE_BITS, (place & ((1 << PLACE_BITS) - 1)) * 8
            if task not in files:
                if len(files) >= 512:
                    os.close(files.pop(next(iter(files))))
                files[task] = os.open(f"{folder}/{task}", os.O_RDONLY)
            size = int.from_bytes(os.pread(files[task], 8, at), "little")
            return np.frombuffer(os.pread(files[task], 8 * size, at + 8), "<u8")

        linker = Linker(fetch, similarity)

        def solve(s: np.ndarray, place: np.ndarray, lead: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(s)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(s)]
            many = ends - starts > 1
            for a, b in zip(starts[many].tolist(), ends[many].tolist()):
                own = place[a:b].tolist()
                links = list(linker.link(own, (place[a:b] + lead[a:b]).tolist()))
                if whole:
                    links = [(p, root) for p in own if (root := linker.find(p)) != p]
                if links:
                    u, v = zip(*links)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                s, place, lead = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                if held and held[-1][0][-1] != s[0]:
                    yield from solve(*map(np.concatenate, zip(*held)))
                    held = []
                first = int(np.searchsorted(s, s[-1]))
                if first:
                    yield from solve(*map(np.concatenate, zip(*held, (s[:first], place[:first], lead[:first]))))
                    held = []
                held.append((s[first:], place[first:], lead[first:]))
            if held:
                yield from solve(*map(np.concatenate, zip(*held)))
        finally:
            for f in files.values():
                os.close(f)

    return run


def fingerprint_groups(distinct: DataFrame, folder: str, similarity: float) -> DataFrame:
    """(u, v): distinct sets' places and those of their groups' leads, where pivots link the fingerprints (columns
    ``place`` and ``fp``) and the sets are similar enough."""
    fps = written(distinct.select("fp").distinct(), "prints")
    labels = components(fingerprint_links(fps)).withColumnRenamed("node", "fp")
    meets = distinct.join(labels, "fp", "left").select(
        F.coalesce("root", "fp").alias("s"), "place", F.lit(0).cast("long").alias("lead")
    )
    meets = meets.repartition("s").sortWithinPartitions("s")
    return meets.mapInArrow(_similar_links(local_path(folder), similarity, whole=True), "u long, v long")


def similar_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """(id, text_hash, root) for every row: rows with equal roots are joined by links of texts that are similar enough.

    Null and empty texts are equal. Only the two columns are read.
    """
    if not 0 < similarity <= 1:
        raise ValueError(f"similarity: {similarity}")
    spark = df.sparkSession
    ensure_shipped(spark)
    docs = df.select(F.col(id_col).alias("id"), text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    common, ranks = common_shingles(docs, shingle)
    folder = shared_dir(spark, "shingle-sets")
    kind = docs.schema["id"].dataType.simpleString()
    sets = docs.mapInArrow(
        _write_sets(local_path(folder), shingle, similarity, common, ranks),
        f"id {kind}, text_hash long, sig long, fp long, place long, prefix array<long>",
    )
    sets = written(sets, "sets")
    one = [F.min("fp").alias("fp"), F.min("place").alias("place"), F.count(F.lit(1)).alias("n")]  # fp follows from the set
    distinct = written(sets.groupBy("sig").agg(*one), "distinct")
    close = written(fingerprint_groups(distinct, folder, similarity), "close")
    leads = distinct.join(close, F.col("place") == F.col("u"), "left")
    leads = leads.select("place", F.coalesce(F.col("v") - F.col("place"), F.lit(0)).alias("lead"))
    firsts = sets.select("place", "prefix").join(leads, "place")
    meets = firsts.select(F.explode("prefix").alias("s"), "place", "lead").repartition("s").sortWithinPartitions("s")
    edges = written(meets.mapInArrow(_similar_links(local_path(folder), similarity), "u long, v long"), "similar")
    drop_dir(spark, folder)
    labels = components(close.union(edges)).withColumnRenamed("node", "place")
    table = distinct.join(labels, "place", "left").select("sig", "n", F.coalesce("root", "place").alias("root"))
    return lookup(sets.select("id", "text_hash", "sig"), written(table, "groups"), "sig", "n", F.col("text_hash")).drop("sig")


def keep_one_of_similar(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """One row of ``df`` for each group of similar texts, that with the smallest id."""
    return keep_leads(df, similar_groups(df, id_col, text_col, shingle, similarity), id_col, text_col)
