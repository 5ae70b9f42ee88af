import math
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import no_docs, odd_docs, odd_rows, prose

from lexifix.llm import kneser_ney
from lexifix.llm.common import shared_dir
from lexifix.llm.kneser_ney import discounts, log_probabilities, train


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


class Plain:
    def __init__(self, texts):
        docs = [words(t) for t in texts]
        self.c = Counter(w for d in docs for w in d)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.pairs = Counter(p for d in docs for p in zip([None, *d], d))
        self.follows = Counter(w for _, w in self.pairs)
        tally = lambda x: [sum(v == k for v in x.values()) for k in range(1, 5)]
        self.d2, self.d1 = discounts(tally(self.pairs)), discounts(tally(self.follows))
        self.contexts = defaultdict(lambda: [0, 0, 0, 0])
        for (h, _), k in self.pairs.items():
            self.contexts[h][0] += k
            self.contexts[h][min(k, 3)] += 1
        self.rest = sum(self.d(k, self.d1) for k in self.follows.values()) / max(len(self.pairs), 1) if self.pairs else 1.0

    @staticmethod
    def d(k, discount):
        return discount[min(k, 3) - 1] if k else 0.0

    def one(self, w):
        k = self.follows[w]
        return max(k - self.d(k, self.d1), 0) / max(len(self.pairs), 1) + self.rest / (self.v + 1)

    def p(self, h, w):
        if h not in self.contexts:
            return self.one(w)
        total, *seen = self.contexts[h]
        k = self.pairs.get((h, w), 0)
        return max(k - self.d(k, self.d2), 0) / total + sum(a * b for a, b in zip(self.d2, seen)) / total * self.one(w)

    def score(self, text):
        w = words(text)
        return sum(math.log10(self.p(h, x)) for h, x in zip([None, *w], w))

    def base(self, text):
        return sum(math.log10((self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in words(text))


def check(spark, train_df, score_df, train_texts):
    folder = shared_dir(spark, "lm-test")
    model = train(train_df, folder)
    plain = Plain(train_texts)
    rows = log_probabilities(score_df, folder, model).collect()
    texts = {zlib.crc32((r.text or "").encode()): r.text for r in score_df.collect()}
    assert len(rows) == score_df.count()
    by = sorted((r.n_tokens, round(r.base_score, 6), round(r.score, 6), r.n_known, r.train_tokens) for r in rows)
    want = sorted(
        (len(words(r.text)), round(plain.base(r.text), 6), round(plain.score(r.text), 6), sum(w in plain.c for w in words(r.text)), plain.n)
        for r in score_df.collect()
    )
    assert by == [pytest.approx(w, abs=2e-6) for w in want] and texts
    return plain


def test_against_plain_model(spark):
    docs = [(i, f"{prose(12, i % 5)} the cat Sat on the mat the {'cat ' * (i % 4)}", "en", "s", 0) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    plain = check(spark, df, df.union(odd_docs(spark)), [d[1] for d in docs])
    for h in ("the", "cat", None, "unseen"):
        assert sum(plain.p(h, w) for w in [*plain.c, "unknown"]) == pytest.approx(1.0)


def test_odd_training_texts(spark):
    check(spark, odd_docs(spark, True), odd_docs(spark, True), [r[1] for r in odd_rows()])


def test_empty_table(spark):
    folder = shared_dir(spark, "lm-test")
    model = train(no_docs(spark), folder)
    rows = log_probabilities(odd_docs(spark), folder, model).collect()
    assert {(r.score, r.base_score, r.n_known) for r in rows} == {(0.0, 0.0, 0)}
    assert log_probabilities(no_docs(spark), folder, model).count() == 0


def test_counts_beyond_32_bits():
    big = np.array([3, 1 << 33], np.int64)
    assert kneser_ney.narrow(big).tolist() == big.tolist() and kneser_ney.narrow(big[:1]).dtype.itemsize == 4
    words, counts = np.array([5, 9], "<u8"), np.array([1 << 33, 7], "<u8")
    row = kneser_ney.part_batch([(0, kneser_ney.pack(words), kneser_ney.pack(counts), b"")] * 2)
    with tempfile.TemporaryDirectory() as folder:
        out = kneser_ney._merge_words(folder)((pa.scalar(0),), pa.Table.from_batches([row]))
        assert out.to_pylist() == [{"shard": 0, "n": 2, "total": 2 * ((1 << 33) + 7)}]


def test_discounts_by_hand():
    """Y = n1 / (n1 + 2 n2); D1 = 1 - 2Y n2/n1, D2 = 2 - 3Y n3/n2, D3+ = 3 - 4Y n4/n3: 100, 50, 20, 10 give Y = 1/2."""
    assert discounts([100, 50, 20, 10]) == pytest.approx([0.5, 1.4, 2.0])
