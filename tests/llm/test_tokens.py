import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import no_docs, odd_docs, odd_rows, prose
from tokenizers import Tokenizer

from lexifix.llm import packing, tokens
from lexifix.llm.common import local_path, shared_dir
from lexifix.llm.packing import Bm25Index, Packer, neighbour_recall, pack_documents
from lexifix.llm.token_store import cut_points, merkle_root, read_store, write_store
from lexifix.llm.tokens import PieceEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a", " a", "a ", "a  b", "a \n b", "a\n\nb  c \t d", "it 's don't I'LL", "<|endoftext|> x", "a  <|endoftext|>", "x  ́y", "\x1c a \x1f b", "ΟΔΟΣ Σ", "x" * 100 + " " + "y" * 99, "日本 語  ", "a\x85 b", "a\x01b \x01 c", "Ġ xĠ"]


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORD, False)])
def test_same_as_the_library(path, spaced, monkeypatch):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice(list("abé' \n\t.,!é́Σ1<|>\x01Ġ×İŉ\x85\xa0#'s ") + ["ab", " Wö", "\n", ". "]) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for slots in (1 << 22, 40):  # the second turns the table over, in small windows
        monkeypatch.setattr(tokens, "SLOTS", slots)
        monkeypatch.setattr(tokens, "WINDOW", 1 << 19 if slots > 40 else 64)
        encoder = PieceEncoder(path, spaced)
        got = [np.frombuffer(b, encoder.dtype).tolist() for k in range(0, len(texts), 50) for b in encoder.encode(texts[k : k + 50])]
        assert got == want


def encoded(path, end):
    t = Tokenizer.from_file(path)
    return [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, end]) for r in odd_rows()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_chunks_are_stable():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50_000, 60_000).astype("<u2")
    ends = cut_points(ids)
    assert ends[-1] == len(ids) and all(128 <= b - a <= 4096 for a, b in zip([0, *ends[:-2]], ends[:-1]))
    moved = {len(ids) + 1 - e for e in cut_points(np.r_[ids[:30_000], 7, ids[30_000:]].astype("<u2"))}
    assert len(moved & {len(ids) - e for e in ends}) > len(ends) * 0.9 or len({e + 1 for e in ends if e > 35_000} & {len(ids) + 1 - m for m in moved}) > 40
    assert cut_points(np.zeros(0, "<u2")) == [] and cut_points(np.zeros(9000, "<u2"))[-1] == 9000
    assert merkle_root([b"a", b"b", b"c"]) != merkle_root([b"a", b"c", b"b"])


def test_store_there_and_back(spark):
    for df in (odd_docs(spark), odd_docs(spark, True)):
        folder = shared_dir(spark, "store-test")
        write_store(df.repartition(3), folder, BYTE)
        rows = sorted(read_store(spark, folder).collect(), key=lambda r: r.start)
        want = encoded(BYTE, 0)
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((str(i), len(x), crc(x)) for i, x in want)
        assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
        ids = [r.doc_id for r in rows]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_chunks_are_stored_once(spark):
    text = prose(3000)
    once, twice = shared_dir(spark, "store-test"), shared_dir(spark, "store-test")
    size = lambda d: sum(os.path.getsize(f"{local_path(d)}/packs/{f}") for f in os.listdir(f"{local_path(d)}/packs"))
    for folder, n in ((once, 1), (twice, 9)):
        write_store(spark.createDataFrame([(i, text) for i in range(n)], "doc_id long, text string").repartition(3), folder, BYTE)
    assert size(once) == size(twice)
    pack = next(f for f in os.listdir(f"{local_path(once)}/packs"))
    path = f"{local_path(once)}/packs/{pack}"
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged|corrupt|error|Error"):
        read_store(spark, once).collect()


def test_empty_store(spark):
    folder = shared_dir(spark, "store-test")
    write_store(no_docs(spark), folder, BYTE)
    assert read_store(spark, folder).count() == 0


def test_packing(spark):
    want = encoded(WORD, 2)
    for df in (odd_docs(spark), odd_docs(spark, True)):
        pieces = pack_documents(df, WORD, length=64, shard_ids=5_000, with_ids=True).collect()
        documents, sequences = Counter(), {}
        for p in pieces:
            assert crc(np.frombuffer(p.ids, "<u4")) == p.ids_crc32 and len(p.ids) == 4 * p.length
            documents[str(p.doc_id), p.doc_tokens] += p.length
            sequences.setdefault(p.sequence_id, []).append(p)
        expected = Counter()
        for i, x in want:
            expected[str(i), len(x)] += len(x)
        assert documents == expected
        for parts in sequences.values():
            parts.sort(key=lambda p: p.offset)
            assert [p.offset for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
            assert sum(p.length for p in parts) <= 64
        parts = {s >> 32 for s in sequences}
        assert sum(sum(p.length for p in pieces) < 64 for pieces in sequences.values()) <= sum(expected.values()) // 5_000 + len(parts)
        by_id = {i: x for i, x in want if i is not None}
        for p in pieces:
            if p.doc_id is not None:
                assert np.frombuffer(p.ids, "<u4").tolist() == by_id[p.doc_id][p.start : p.start + p.length]
    assert pack_documents(no_docs(spark), WORD).count() == 0


def plain_bm25(docs, k):
    n, sizes = len(docs), [len(d) for d in docs]
    df = Counter(t for d in docs for t in set(d))
    w = lambda t, d: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / np.mean(sizes)))
    terms = sorted((t for t in set(docs[k]) if df[t] > 1), key=lambda t: (-np.float32(w(t, docs[k])), t))
    return {i: sum(w(t, d) for t in terms if t in d) for i, d in enumerate(docs)}


def test_neighbours_are_ranked_by_bm25():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 60, rng.integers(5, 40)).tolist() for _ in range(40)]
    index = Bm25Index([np.array(d, "<u2") for d in docs])
    for k in range(5):
        scores = plain_bm25(docs, k)
        got = index.neighbours(k).tolist()
        assert set(got) == {i for i, s in scores.items() if s > 0}
        assert [scores[i] for i in got] == pytest.approx(sorted((scores[i] for i in got), reverse=True), rel=1e-5)


def test_neighbours_share_a_window():
    a, b = list(range(100, 120)), list(range(200, 220))
    docs = [np.array(x, "<u2") for x in (a, b, a, b)]
    pieces = Packer([20] * 4, Bm25Index(docs), length=40).run()
    assert {frozenset(p[0] for p in pieces if p[3] == s) for s in (0, 1)} == {frozenset({0, 2}), frozenset({1, 3})}


def test_statistics_of_all_documents(spark):
    dtype = packing.encoder(WORD, False).dtype.str
    docs = [[1, 1, 5], [5, 9], [], [1]]
    df = spark.createDataFrame([(bytearray(np.array(d, dtype).tobytes()),) for d in docs], "ids binary").repartition(3)
    got = packing.statistics(df, dtype, 12)
    assert (got.docs, got.ids) == (4, 6) and got.df.tolist() == [0, 2, 0, 0, 0, 2, 0, 0, 0, 1, 0, 0]


def test_documents_that_share_rare_terms_are_in_one_shard(spark):
    rng = np.random.default_rng(7)
    words = sorted(t for t in Tokenizer.from_file(WORD).get_vocab() if t.isascii() and t.isalpha() and len(t) > 4)[:3000]
    texts = []
    for _ in range(150):
        text = rng.choice(words, 120).tolist()
        texts += [" ".join(text), " ".join([*text[:110], *rng.choice(words, 10)])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    enc = packing.encoder(WORD, False)
    docs = [np.frombuffer(b, enc.dtype) for b in enc.encode(texts)]
    pieces = pack_documents(df, WORD, length=512, shard_ids=sum(map(len, docs)) // 32).collect()
    shard = np.zeros(len(texts), int)
    for p in pieces:
        shard[p.doc_id] = p.sequence_id >> 32
    assert len(set(shard.tolist())) >= 6
    rare = neighbour_recall(docs, shard, list(range(0, 300, 7)), 1)
    assert rare > 3 * neighbour_recall(docs, rng.permutation(shard), list(range(0, 300, 7)), 1)


def test_many_copies_spread_over_partitions(spark):
    df = spark.createDataFrame([(i if i % 2 else None, "the same words in every document") for i in range(2000)], "doc_id long, text string")
    pieces = pack_documents(df, WORD, length=64, shard_ids=500).collect()
    sizes = Counter(p.sequence_id >> 32 for p in pieces)
    assert sum(p.length for p in pieces) == 2000 * pieces[0].doc_tokens and max(sizes.values()) < 2 * len(pieces) / len(sizes)
