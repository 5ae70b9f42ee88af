"""SimHash near-duplicates found with pivot distance tables.

1. Every text gets a 64-bit fingerprint: a majority vote of its shingles' hashes, bit by bit.
2. Equal fingerprints collapse to one row. Each keeps its Hamming distances to fixed reference fingerprints (pivots).
3. The distances to the first few pivots are the partition key: cells are ranges of WIDTH distances to each, and a row
   lies in its own cell and in the next one where it is within 2 of it, so rows at most 2 bits apart meet in a cell. More
   pivots make the key as the table grows. In a cell, pairs whose distances to any pivot differ by more than 2 are
   discarded (by the triangle inequality they are further apart), sorted by one pivot so that far rows never meet;
   survivors are verified. Crowded cells are split over tasks by pairs of 16-bit bands, and those by bands of the bits
   that they haven't fixed, which loses no pair: fingerprints at most 2 bits apart agree in two of four bands at least.
4. Cells emit a spanning forest of their links, never all pairs; components come from alternating large-star and
   small-star steps on tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shipping import ensure_shipped
from .common import lookup, read, written

SHINGLE = 3
RADIUS = 2
N_PIVOTS = 16
BANDS = 4
#: Distances to a pivot that are one cell; more than RADIUS.
WIDTH = 3
#: Larger cells are split by bands. About this part of the rows is in one range of a pivot's distances.
CROWDED = 2048
RANGE_SHARE = 6
#: Pivots that make the partition key at most.
KEY_PIVOTS = 8
#: Pairs compared at once.
PAIR_BLOCK = 1 << 20

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_digest = partial(xxhash.xxh64_digest, seed=42)


def pivots(n: int = N_PIVOTS) -> list[int]:
    """Reference fingerprints: the splitmix64 sequence from 1."""
    out, mask = [], (1 << 64) - 1
    for i in range(1, n + 1):
        z = (i * 0x9E3779B97F4A7C15) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(z ^ (z >> 31))
    return out


def fingerprint(text: str | None) -> int:
    """64 bits: set where over half the shingles' hashes have the bit; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = _digest(b" ".join(words))
    else:
        hashes = b"".join(map(_digest, map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))))
    return vote(hashes)


def vote(hashes: bytes) -> int:
    """The bits that over half of the hashes, 8 bytes each, have."""
    n = len(hashes) // 8
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    step = 255 * 64
    for at in range(0, n, step):  # sums of up to 255 bits fit in a byte
        bits = np.unpackbits(rows[at : at + step], axis=1)
        full = len(bits) // 255 * 255
        if full:
            counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        if full < len(bits):
            counts += bits[full:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    out = np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64)
    return pa.array(out.view(np.int64))


def with_fingerprint(df: DataFrame, text_col: str = "text", name: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed 64-bit number; null texts count as empty."""
    ensure_shipped(df.sparkSession)
    return df.withColumn(name, _fingerprints(F.col(text_col)))


def _bands(bits: list[int]) -> list[list[int]]:
    """Four bands of the given bit positions."""
    cuts = [len(bits) * i // BANDS for i in range(BANDS + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _close_pairs(fp: np.ndarray, coords: np.ndarray, seen: dict[str, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at most RADIUS bits apart, by the distance table first and the fingerprints then.

    Rows are sorted by the last pivot, which is in no key. ``seen`` counts pairs: in the cell, met after the sort,
    left by the table, linked.
    """
    by = coords.shape[1] - 1
    order = np.argsort(coords[:, by], kind="stable")
    fp, coords = fp[order], coords[order].astype(np.int16)
    last = np.searchsorted(coords[:, by], coords[:, by] + RADIUS, "right")
    reach = last - np.arange(len(fp)) - 1
    ends = np.cumsum(reach)
    start = 0
    while start < len(fp):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PAIR_BLOCK, "right")))
        take = reach[start:stop]
        i = np.repeat(np.arange(start, stop), take)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(take) - take, take)
        met = len(i)
        for k in range(by - 1, -1, -1):
            if not len(i):
                break
            near = np.abs(coords[i, k] - coords[j, k]) <= RADIUS
            i, j = i[near], j[near]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS
        if seen is not None:
            for name, n in (("met", met), ("verified", len(i)), ("linked", int(near.sum()))):
                seen[name] = seen.get(name, 0) + n
        yield order[i[near]], order[j[near]]
        start = stop


def link(
    fp: np.ndarray, coords: np.ndarray, bits: list[int], seen: dict[str, int] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among distinct fingerprints that can differ in ``bits`` only: (index, index of its root) arrays."""
    if len(fp) > CROWDED and len(bits) > 2 * BANDS:
        bands = _bands(bits)
        for pair in combinations(range(BANDS), 2):
            mask = np.uint64(sum(1 << b for k in pair for b in bands[k]))
            rest = [b for k in range(BANDS) if k not in pair for b in bands[k]]
            key = fp & mask
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    for a, b in link(fp[group], coords[group], rest, seen):
                        yield group[a], group[b]
        return
    if seen is not None:
        seen["pairs"] = seen.get("pairs", 0) + len(fp) * (len(fp) - 1) // 2
    found = list(_close_pairs(fp, coords, seen))
    i, j = (np.concatenate([p[k] for p in found]) for k in (0, 1))
    label = _forest(len(fp), i, j)
    moved = np.flatnonzero(label != np.arange(len(fp)))
    yield moved, label[moved]


def _unpack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([x.astype("<i8").view(np.uint8).reshape(-1, 8) for x in (a, b)], axis=1)


def _cell_links(count: bool):
    """Rows (cell, which bands, their bits, fp, c1, c2) sorted by the first three to links, or to counts of pairs; the
    last cell of a batch waits for the next batch."""
    bands = _bands(list(range(64)))
    rests = [[b for k in range(BANDS) if k not in pair for b in bands[k]] for pair in combinations(range(BANDS), 2)]
    rests.append(list(range(64)))  # which = -1: a whole cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] | None = {} if count else None

        def solve(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            cell, which, key, fp, c1, c2 = (np.concatenate(x) for x in zip(*parts))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(key) != 0) | (np.diff(which) != 0)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
            a, b = [], []
            many = ends - starts > 1
            for s, e in zip(starts[many].tolist(), ends[many].tolist()):
                own = fp[s:e].view(np.uint64)
                for i, j in link(own, _unpack(c1[s:e], c2[s:e]), rests[int(which[s])], seen):
                    a.append(own[i])
                    b.append(own[j])
            if a and not count:
                left, right = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["u", "v"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if held and any(held[-1][k][-1] != rows[k][0] for k in range(3)):
                yield from solve(held)
                held = []
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
            first = int(np.argmax(same))
            if first:
                yield from solve([*held, [x[:first] for x in rows]])
                held = []
            held.append([x[first:] for x in rows])
        if held:
            yield from solve(held)
        if seen:
            names = ["pairs", "met", "verified", "linked"]
            yield pa.RecordBatch.from_arrays([pa.array([seen.get(n, 0)], pa.int64()) for n in names], names=names)

    return run


def distance_table(fps: DataFrame) -> DataFrame:
    """Add c1 and c2: the distances to the pivots, a byte each."""
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in pivots()]

    def packed(part: list[int]):
        out = F.lit(0).cast("bigint")
        for k, p in enumerate(part):
            distance = F.bit_count(F.col("fp").bitwiseXOR(F.lit(p).cast("bigint"))).cast("bigint")
            out = out.bitwiseOR(F.shiftleft(distance, 8 * k))
        return out

    return fps.withColumn("c1", packed(signed[:8])).withColumn("c2", packed(signed[8:]))


def cells(fps: DataFrame, pivots_in_key: int) -> DataFrame:
    """(fp, c1, c2, cell): the rows of the distance table in each of their cells."""
    table = distance_table(fps.select("fp"))

    def step(found: Column, k: int) -> Column:
        d = F.shiftright("c1", 8 * k).bitwiseAND(F.lit(255))
        here = F.array_distinct(F.array(F.floor(d / WIDTH), F.floor((d + RADIUS) / WIDTH)))
        return F.flatten(F.transform(found, lambda c: F.transform(here, lambda x: c.bitwiseOR(F.shiftleft(x, 5 * k)))))

    found = reduce(step, range(pivots_in_key), F.array(F.lit(0).cast("bigint")))
    return table.withColumn("cell", F.explode(found))


def _split_cells(fps: DataFrame) -> DataFrame:
    """Rows (cell, w, k, fp, c1, c2): whole cells, and crowded ones in a bucket for each pair of bands."""
    n = fps.count()
    depth = 1
    while depth < KEY_PIVOTS and n > CROWDED * RANGE_SHARE**depth:
        depth += 1
    rows = cells(fps, depth)
    crowded = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED)
    found = lookup(rows, written(crowded.withColumn("crowded", F.lit(True)), "crowded-cells"), "cell", "n", F.col("fp"))
    bands = _bands(list(range(64)))
    keys = []
    for w, pair in enumerate(combinations(range(BANDS), 2)):
        mask = sum(1 << b for k in pair for b in bands[k])
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(w).alias("w"), F.col("fp").bitwiseAND(F.lit(mask).cast("bigint")).alias("k")))
    whole = F.array(F.struct(F.lit(-1).alias("w"), F.lit(0).cast("bigint").alias("k")))
    found = found.withColumn("b", F.explode(F.when(F.col("crowded"), F.array(*keys)).otherwise(whole)))
    found = found.select("cell", F.col("b.w").alias("w"), F.col("b.k").alias("k"), "fp", "c1", "c2")
    return found.repartition("cell", "w", "k").sortWithinPartitions("cell", "w", "k")


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Spanning links (u, v) of distinct fingerprints (column ``fp``) at most RADIUS bits apart."""
    return _split_cells(fps).mapInArrow(_cell_links(False), "u long, v long")


def pair_counts(fps: DataFrame) -> DataFrame:
    """One row on the pairs of distinct fingerprints: in a cell, met after the sort by a pivot, left to verify by the
    whole distance table, linked (a pair in several cells counts in each)."""
    counts = _split_cells(fps).mapInArrow(_cell_links(True), "pairs long, met long, verified long, linked long")
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v), root being the smallest node of the component."""
    edges = written(edges.where("u <> v").distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = lookup(both, written(least, "least"), "u", "n", F.col("v")).where("v > u")
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = lookup(large, written(least, "least"), "u", "n", F.col("v"))
        small = small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        small = small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = written(small, "links")
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(pairs.select(F.col("root").alias("node"), "root").distinct())


def _grouped(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, fp) for every row, and per fingerprint its rows ``n``, component_id and component's ``root``."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_hash(text_col).alias("text_hash"))
    docs = written(with_fingerprint(docs).select("id", "text_hash", "fp"), "fingerprints")
    fps = written(docs.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    labels = components(fingerprint_links(fps)).withColumnRenamed("node", "fp")
    own = fps.join(labels, "fp")
    own = written(own, "members")
    roots = written(own.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("rows")), "roots")
    found = lookup(own.drop("n"), roots, "root", "rows", F.col("fp")).select("fp", "root", "component_id")
    table = fps.join(found, "fp", "left").select(
        "fp", "n", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("root", "fp").alias("root")
    )
    return docs, written(table, "components")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id of the texts reachable over links.

    Null and empty texts have fingerprint 0 and link like others; a null id is larger than any; rows that share an id
    each get a row. Only the two columns are read, so other columns can't clash.
    """
    docs, table = _grouped(df, id_col, text_col)
    return lookup(docs.drop("text_hash"), table.drop("root"), "fp", "n", F.xxhash64("id"))


def text_hash(text_col: str):
    """Tells apart rows that share an id; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def keep_leads(df: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``df`` for each ``root`` of ``rows`` (id, text_hash, root): that with the smallest id, nulls last."""
    least = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("text_hash"))).alias("m")
    leads = rows.groupBy("root").agg(least).select(F.col("m.id").alias("_lead"), F.col("m.text_hash").alias("_lead_text"))
    whole = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("_id"), text_hash(text_col).alias("_text")
    )
    kept = whole.join(leads, (F.col("_text") == F.col("_lead_text")) & F.col("_id").eqNullSafe(F.col("_lead")), "left_semi")
    # rows equal in id and text are of one group
    return kept.dropDuplicates(["_id", "_text"]).select("_row.*")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each component, that with the smallest id, whatever ids the rows share or lack."""
    docs, table = _grouped(df, id_col, text_col)
    roots = lookup(docs, table.select("fp", "n", "root"), "fp", "n", F.xxhash64("id"))
    return keep_leads(df, roots, id_col, text_col)


def op8_pivot_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")
