import random
import re

import numpy as np
import pytest
import xxhash
from helpers import no_docs, odd_docs, odd_rows, prose

import corpus_pipeline
from lexifix.llm import near_copies, simhash
from lexifix.llm.near_copies import keep_one_of_similar, similar_groups
from lexifix.llm.simhash import components, fingerprint, fingerprint_links, keep_first, link, near_duplicates, pivots


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in [None, "", "One", "a B", "a b c", "ÀÉ x ß", prose(700), "a b c " * 300, *(r[1] for r in odd_rows())]:
        assert fingerprint(text) == plain_fingerprint(text)


def groups(values, radius=2):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return sorted(sorted(v for v in values if find(v) == r) for r in {find(v) for v in values})


def near(n, seed, spread):
    rnd, out = random.Random(seed), set()
    bases = [rnd.getrandbits(64) for _ in range(6)]
    while len(out) < n:
        v = rnd.choice(bases)
        for _ in range(rnd.randint(0, spread)):
            v ^= 1 << rnd.randrange(64)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("crowded", [2048, 8])
def test_links_within_a_bucket(monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    values = near(150, 3, 5)
    fp = np.array(values, np.uint64)
    coords = np.stack([np.bitwise_count(fp ^ np.uint64(p)) for p in pivots()], axis=1).astype(np.uint8)
    merged = {v: {v} for v in values}
    for a, b in link(fp, coords, list(range(64))):
        for x, y in zip(fp[a].tolist(), fp[b].tolist()):
            if merged[x] is not merged[y]:
                both = merged[x] | merged[y]
                for z in both:
                    merged[z] = both
    assert sorted({tuple(sorted(g)) for g in merged.values()}) == [tuple(g) for g in groups(values)]


@pytest.mark.parametrize("crowded", [2048, 40, 4])
def test_components_of_fingerprints(spark, monkeypatch, crowded):
    """Cells of one to four pivots' distances, whole and split by bands."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    values = near(200, 5, 4)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {}
    for r in components(fingerprint_links(fps)).collect():
        got.setdefault(r.root, set()).add(r.node % (1 << 64))
    assert sorted(sorted(g) for g in got.values()) == [g for g in groups(values) if len(g) > 1]


def test_close_pairs_share_a_cell(spark):
    rnd = random.Random(8)
    pairs = []
    for _ in range(200):
        v = rnd.getrandbits(64)
        pairs.append((v, v ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))))
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(sign(v),) for p in pairs for v in p], "fp long")
    for depth in (1, 4, 8):
        found = {}
        for r in simhash.cells(fps, depth).collect():
            found.setdefault(r.fp, set()).add(r.cell)
        assert all(found[sign(a)] & found[sign(b)] for a, b in pairs)


def test_pivots_discard_most_pairs(spark):
    rnd = random.Random(4)
    fps = spark.createDataFrame([(rnd.getrandbits(63),) for _ in range(3000)], "fp long")
    n = simhash.pair_counts(fps).first()
    assert 0 < n.pairs < 3000 * 2999 // 2 and n.verified < n.met / 100 and n.met < n.pairs
    assert tuple(simhash.pair_counts(fps.limit(0)).first()) == (0, 0, 0, 0)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_odd_documents(spark):
    for extra in (False, True):
        df = odd_docs(spark, extra)
        rows = near_duplicates(df).collect()
        assert sorted(map(str, (r.id for r in rows))) == sorted(map(str, (r[0] for r in odd_rows())))
        by_id = {r.id: r.component_id for r in rows if r.id is not None}
        assert by_id[7] == by_id[1] == 1 and by_id[3] == by_id[4] == by_id[6] == 3
        kept = keep_first(df)
        assert kept.columns == df.columns
        assert {r.doc_id for r in kept.collect()} == {r.component_id for r in rows}
        assert kept.count() == len({(r.component_id) for r in rows})
    assert near_duplicates(no_docs(spark)).count() == 0 and keep_first(no_docs(spark)).count() == 0


def test_one_document_of_each_group(spark):
    texts = {k: prose(60, k) for k in range(40, 46)}
    rows = [(None, texts[40]), (None, texts[41]), (None, texts[42]), (None, texts[42]), (5, texts[43]), (5, texts[44]), (3, texts[45]), (5, texts[45])]
    kept = keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, texts[40]), (None, texts[41]), (None, texts[42]), (5, texts[43]), (5, texts[44]), (3, texts[45])]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def five_words(text):
    w = re.split("[\x20\x09-\x0d]+", (text or "").strip("\x20\x09\x0a\x0b\x0c\x0d").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def edited():
    """Texts around the limit: copies with some words changed, of one another too, and a passage that many share."""
    rnd, rows = random.Random(8), []
    passage = prose(40, 99)
    for base in range(12):
        words = prose(rnd.randint(60, 200), base).split()
        for _ in range(9):
            new = list(rnd.choice([words, rows[-1][1].split()]) if rows and rnd.random() < 0.3 else words)
            for _ in range(rnd.randint(0, 6)):
                new[rnd.randrange(len(new))] = f"x{rnd.randrange(999)}"
            rows.append((len(rows), " ".join(new)))
    rows += [(len(rows) + i, f"{passage} {prose(30, 200 + i)}") for i in range(20)]
    rows += [(900 + i, t) for i, t in enumerate(["", None, " \n ", "One two", "one  two", "one two three"])]
    return rows


@pytest.mark.parametrize("sample", [10_000, 1])
def test_similar_texts_against_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    rows = edited()
    sets = [five_words(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    want = {}
    for i, (k, _) in enumerate(rows):
        want.setdefault(find(i), []).append(k)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in similar_groups(df).collect():
        got.setdefault(r.root, []).append(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert 12 < len(want) < len(rows) - 30
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(map(min, want.values()))


def test_fingerprints_by_pivots_come_first(spark, monkeypatch):
    """Long texts with few edits are grouped through the pivots; the exact way adds what is further apart."""
    rnd, texts = random.Random(5), []
    for base in range(6):
        words = prose(1500, 300 + base).split()
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 20):
            new = list(words)
            for _ in range(edits):
                new[rnd.randrange(len(new))] = f"y{rnd.randrange(9999)}"
            texts.append(" ".join(new))
    texts += [prose(50, 400), prose(50, 400) + " end", prose(50, 401)]
    sets = [near_copies.shingle_set(t) for t in texts]
    fps = [simhash.vote(s.tobytes()) for s in sets]
    like = lambda a, b: 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
    by_bits = [g for g in groups(sorted(set(fps))) if len(g) > 1]
    assert len(by_bits) > 4 and all(like(sets[fps.index(x)], sets[fps.index(y)]) for g in by_bits for x in g for y in g)
    seen, keep = [], near_copies.fingerprint_groups

    def spy(distinct, folder, similarity):
        found = keep(distinct, folder, similarity)
        fp = {r.place: r.fp % (1 << 64) for r in distinct.collect()}
        seen.extend((fp[r.u], fp[r.v]) for r in found.collect())
        return found

    monkeypatch.setattr(near_copies, "fingerprint_groups", spy)
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 30, 5), 30, 32]
    found = {}
    for u, v in seen:
        found.setdefault(v, {v}).add(u)
    assert sorted(sorted(g) for g in found.values() if len(g) > 1) == by_bits


def test_similar_odd_documents(spark):
    for extra in (False, True):
        df = odd_docs(spark, extra)
        kept = keep_one_of_similar(df)
        assert kept.columns == df.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "8", "None"]
    assert keep_one_of_similar(no_docs(spark)).count() == 0
