"""Content-addressed store of token ids.

Files, in one folder that all executors share:

* ``packs/pack-N.bin``: compressed chunks one after the other; a chunk is named by the BLAKE2b of its ids and is stored
  once in the whole store, wherever it occurs.
* ``recipes/recipe-N.bin``: documents in ascending id order, each with its Merkle root and its chunks' places.
* ``manifest.json``: the recipe files in order, with their Merkle roots, and the root over those.

Chunks are cut by a rolling hash of the last 16 ids, so an insertion changes the chunks around it only. Writers stage
packs by task, a narrow shuffle of chunk names finds first occurrences, and a compaction of each staged pack keeps those;
ids never pass a shuffle. Files get their names by task and are renamed into place, so a repeated task is harmless.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_dir, local_path, lookup, partitions, read, shared_dir, written
from .tokens import encoder

END_ID = 0
WINDOW_DOUBLINGS = 4  # a window of 16 ids
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 128, 512, 4096
#: Packs that a reading task keeps open at most.
OPEN_PACKS = 256

_HEAD = struct.Struct("<?qI16sI")  # has an id, id, tokens, Merkle root, chunks
_PLACE = struct.Struct("<IQII16s")  # pack, offset, bytes, ids, name


def _mixed(ids: np.ndarray) -> np.ndarray:
    """splitmix64 of each id."""
    z = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_table = _mixed(np.arange(1 << 16))


def window_hits(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last ids hits."""
    h = _table[ids] if ids.dtype.itemsize == 2 else _mixed(ids)
    for k in range(WINDOW_DOUBLINGS):  # h[i] = sum of mixed(ids[i - j]) << j
        step = 1 << k
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
    return np.flatnonzero((h >> np.uint64(40)) & np.uint64(MEAN_CHUNK - 1) == 0) + 1


def ends_of(hits: list[int], n: int) -> list[int]:
    """Ends of the chunks of n ids, within the least and greatest length."""
    ends, last = [], 0
    for hit in hits:
        while hit - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if hit - last >= MIN_CHUNK:
            ends.append(hit)
            last = hit
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def cut_points(ids: np.ndarray) -> list[int]:
    return ends_of(window_hits(ids).tolist(), len(ids)) if len(ids) else []


def cut_documents(docs: list[np.ndarray]) -> list[list[int]]:
    """Each document's cut points, hashed together: a window reaches into the document before for hits only that come
    sooner than the least chunk, and those don't cut."""
    bounds = np.cumsum([0, *map(len, docs)])
    hits = window_hits(np.concatenate(docs))
    places = np.searchsorted(hits, bounds, "right").tolist()
    return [
        ends_of((hits[places[k] : places[k + 1]] - bounds[k]).tolist(), len(d)) if len(d) > MIN_CHUNK else [len(d)]
        for k, d in enumerate(docs)
    ]


def name_of(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd node goes up as it is; no leaves: the name of nothing."""
    level = leaves or [name_of(b"")]
    while len(level) > 1:
        level = [name_of(b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


class _Output:
    """A file written under a passing name and renamed when whole."""

    def __init__(self, folder: str, name: str) -> None:
        os.makedirs(folder, exist_ok=True)
        self.path = os.path.join(folder, name)
        self.passing = f"{self.path}.{os.getpid()}.{TaskContext.get().attemptNumber() if TaskContext.get() else 0}"
        self.file = open(self.passing, "wb")  # noqa: SIM115
        self.at = 0

    def write(self, data: bytes) -> int:
        start = self.at
        self.file.write(data)
        self.at += len(data)
        return start

    def close(self) -> None:
        self.file.flush()
        os.fsync(self.file.fileno())
        self.file.close()
        os.replace(self.passing, self.path)


_CHUNK_SCHEMA = "doc_id long, rid long, seq int, doc_tokens long, name string, n_ids int, pack int, at long, size int"


def _stage(folder: str, tokenizer: str, spaced: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = TaskContext.get().partitionId()
        out, squeeze, known = None, zstandard.ZstdCompressor(level=1), {}
        enc = encoder(tokenizer, spaced)
        for batch in batches:
            rows = [[] for _ in range(9)]
            doc_ids, rids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            flat, bounds = enc.encode_array(batch.column(2))
            flat = np.insert(flat, bounds[1:], END_ID)
            bounds = (bounds + np.arange(len(bounds))).tolist()
            docs = [flat[i:j] for i, j in zip(bounds, bounds[1:])]
            for doc_id, rid, ids, stops in zip(doc_ids, rids, docs, cut_documents(docs) if docs else []):
                start = 0
                for seq, stop in enumerate(stops):
                    raw = ids[start:stop].astype("<u4").tobytes()
                    name = name_of(raw)
                    if name not in known:
                        out = out or _Output(folder, f"pack-{pack}.bin")
                        packed = squeeze.compress(ids[start:stop].tobytes())
                        known[name] = (out.write(packed), len(packed))
                    for column, value in zip(rows, (doc_id, rid, seq, len(ids), name.hex(), stop - start, pack, *known[name])):
                        column.append(value)
                    start = stop
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            names = [c.split()[0] for c in _CHUNK_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)
        if out:
            out.close()

    return run


def _compact(staged: str, folder: str):
    """Of each staged pack, copy the chunks that are first occurrences: rows (pack, sorted list of chunks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, counts, packs, ats, sizes = [], [], [], [], []
                out = _Output(folder, f"pack-{pack}.bin")
                with open(os.path.join(staged, f"pack-{pack}.bin"), "rb") as source:
                    for c in chunks:
                        source.seek(c["at"])
                        ats.append(out.write(source.read(c["size"])))
                        names.append(c["name"])
                        counts.append(c["n"])
                        packs.append(pack)
                        sizes.append(c["size"])
                out.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(packs, pa.int32()), pa.array(ats, pa.int64()), pa.array(sizes, pa.int32())],
                    names=["name", "n", "pack", "at", "size"],
                )

    return run


def recipe_bytes(doc_id: int | None, n: int, chunks: list[tuple]) -> tuple[bytes, bytes]:
    """(Merkle root, recipe) of a document."""
    root = merkle_root([c[4] for c in chunks])
    head = _HEAD.pack(doc_id is not None, doc_id or 0, n, root, len(chunks))
    return root, head + b"".join(_PLACE.pack(*c) for c in chunks)


def _write_recipes(folder: str):
    """Rows sorted by (doc_id, rid, seq) to one recipe file a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out, roots, tokens, docs, current, chunks = None, [], 0, 0, None, []

        def flush() -> None:
            nonlocal out, tokens, docs
            out = out or _Output(folder, f"recipe-{part}.bin")
            doc_id, _, n = current
            root, recipe = recipe_bytes(doc_id, n, chunks)
            out.write(recipe)
            roots.append(root)
            tokens += n
            docs += 1

        for batch in batches:
            for doc_id, rid, n, pack, at, size, n_ids, name in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if current != (doc_id, rid, n):
                    if current:
                        flush()
                    current, chunks = (doc_id, rid, n), []
                chunks.append((pack, at, size, n_ids, bytes.fromhex(name)))
        if current:
            flush()
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64()), pa.array([merkle_root(roots).hex()])],
                names=["part", "docs", "tokens", "root"],
            )

    return run


def write_store(
    df: DataFrame, folder: str, tokenizer: str, spaced: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode all rows of ``df``, an end id after each, and write the store to ``folder`` (a shared folder's URI).

    Null and empty texts hold the end id only. Null ids come first; rows that share an id follow each other in the
    order of the input. An empty table gives a manifest without files.
    """
    spark = df.sparkSession
    target = local_path(folder)
    staging = shared_dir(spark, "staged-packs")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text"))
    chunks = written(rows.mapInArrow(_stage(local_path(staging), tokenizer, spaced), _CHUNK_SCHEMA), "chunks")
    firsts = chunks.groupBy("name").agg(F.min(F.struct("pack", "at", "size")).alias("p"), F.count(F.lit(1)).alias("n"))
    kept = firsts.groupBy("p.pack").agg(
        F.sort_array(F.collect_list(F.struct(F.col("p.at").alias("at"), F.col("p.size").alias("size"), "name", "n"))).alias("chunks")
    )
    places = written(
        kept.mapInArrow(_compact(local_path(staging), f"{target}/packs"), "name string, n long, pack int, at long, size int"),
        "places",
    )
    drop_dir(spark, staging)
    recipe = lookup(chunks.drop("pack", "at", "size"), places, "name", "n", F.xxhash64("rid", "seq"))
    recipe = written(recipe.select("doc_id", "rid", "seq", "doc_tokens", "pack", "at", "size", "n_ids", "name"), "recipes")
    parts = (
        recipe.repartitionByRange(partitions(spark), "doc_id", "rid")
        .sortWithinPartitions("doc_id", "rid", "seq")
        .select("doc_id", "rid", "doc_tokens", "pack", "at", "size", "n_ids", "name")
        .mapInArrow(_write_recipes(f"{target}/recipes"), "part int, docs long, tokens long, root string")
        .collect()  # a row for each file
    )
    files, start = [], 0
    for p in sorted(parts, key=lambda p: p.part):
        files.append({"part": p.part, "docs": p.docs, "start": start, "tokens": p.tokens, "root": p.root})
        start += p.tokens
    root = merkle_root([bytes.fromhex(f["root"]) for f in files]).hex()
    width = encoder(tokenizer, spaced).dtype.itemsize
    manifest = {"version": 1, "id_bytes": width, "tokens": start, "root": root, "files": files}
    os.makedirs(target, exist_ok=True)
    with open(f"{target}/manifest.json.new", "w") as f:
        json.dump(manifest, f)
    os.replace(f"{target}/manifest.json.new", f"{target}/manifest.json")


def read_recipes(path: str) -> Iterator[tuple[int | None, int, bytes, list[tuple]]]:
    with open(path, "rb") as f:
        while head := f.read(_HEAD.size):
            has, doc_id, n, root, count = _HEAD.unpack(head)
            yield doc_id if has else None, n, root, list(_PLACE.iter_unpack(f.read(_PLACE.size * count)))


def _read_back(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[int, int] = {}  # open files, the latest used last
        expand = zstandard.ZstdDecompressor()
        dtype = np.dtype(f"<u{width}")
        try:
            for batch in batches:
                for part, start, root in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    roots, out = [], [[], [], [], []]
                    for doc_id, n, doc_root, places in read_recipes(f"{folder}/recipes/recipe-{part}.bin"):
                        raws = []
                        for pack, at, size, n_ids, name in places:
                            fd = packs.pop(pack, None)
                            if fd is None:
                                if len(packs) >= OPEN_PACKS:
                                    os.close(packs.pop(next(iter(packs))))
                                fd = os.open(f"{folder}/packs/pack-{pack}.bin", os.O_RDONLY)
                            packs[pack] = fd
                            packed = os.pread(fd, size, at)
                            raw = np.frombuffer(expand.decompress(packed, n_ids * width), dtype).astype("<u4").tobytes()
                            if name_of(raw) != name:
                                raise ValueError(f"chunk {name.hex()} in pack {pack} is damaged")
                            raws.append(raw)
                        whole = b"".join(raws)
                        if merkle_root([p[4] for p in places]) != doc_root or len(whole) != 4 * n:
                            raise ValueError(f"recipe of document {doc_id} is damaged")
                        roots.append(doc_root)
                        for column, value in zip(out, (doc_id, start, n, zlib.crc32(whole))):
                            column.append(value)
                        start += n
                        if len(out[0]) >= 10_000:
                            yield _docs(out)
                            out = [[], [], [], []]
                    if merkle_root(roots).hex() != root:
                        raise ValueError(f"recipe file {part} doesn't match the manifest")
                    yield _docs(out)
        finally:
            for fd in packs.values():
                os.close(fd)

    return run


def _docs(columns: list[list]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Rebuild and verify every document: (doc_id, start, n_tokens, ids_crc32). A damaged store raises an error."""
    target = local_path(folder)
    with open(f"{target}/manifest.json") as f:
        manifest = json.load(f)
    if merkle_root([bytes.fromhex(x["root"]) for x in manifest["files"]]).hex() != manifest["root"]:
        raise ValueError("the manifest is damaged")
    rows = [(x["part"], x["start"], x["root"]) for x in manifest["files"]]
    files = spark.createDataFrame(rows, "part int, start long, root string")
    dealt = files.repartition(max(1, min(len(rows), partitions(spark))))
    return dealt.mapInArrow(_read_back(target, manifest["id_bytes"]), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_content_store(spark, sf_dir: str) -> DataFrame:
    """All documents through a store in the shared folder and back."""
    import public_tokenizers

    folder = shared_dir(spark, "token-store")
    write_store(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_store(spark, folder)
