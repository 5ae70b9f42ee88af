"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad; its features and those of its neighbours score the label, and a transition score
joins neighbouring labels. A document's score comes from its lines' forward-backward marginals, weighted by length.
Lines have no labels of their own: the field is trained on the driver, from a bounded sample of labelled documents, so
that the weighted marginals give the documents' labels. So a document may have good and bad lines.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shipping import ensure_shipped
from .common import fold_of, read, written

#: Bounds of the training sample: documents of each label, and lines of a document that may be in it.
TRAIN_DOCS = 1500
TRAIN_LINES = 256
#: In training a document of weighted marginal m has the odds exp(STEEP * (m - 1/2)): sure scores need sure lines.
STEEP = 8.0
#: Documents of about one length that are trained on together.
TRAIN_GROUP = 256

LATIN_UPPER = bytes(range(0x41, 0x5B)) + bytes(b for b in range(0xC0, 0xDF) if b != 0xD7)
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>"
OTHER_MARKS = b"!?@^_~={}[]\\/+;\"()"
N_LINE = 12
N_FEATURES = 3 * N_LINE + 1


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines with a word; the features of a line and of its two neighbours."""
    rows, lengths, seen = [], [], set()
    for line in (text or "").split("\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        raw = line.encode("latin-1", "replace")
        upper = size - len(raw.translate(None, LATIN_UPPER))
        digits = size - len(raw.translate(None, DIGITS))
        symbols = size - len(raw.translate(None, SYMBOLS))
        marks = size - len(raw.translate(None, OTHER_MARKS))
        same = sum(map(operator.eq, words, words[1:]))
        chars = sum(map(len, words))
        rows.append(
            (
                min(np.log1p(n), 6.0) / 3.0,
                upper / chars,
                digits / chars,
                min(1.0, 4.0 * symbols / chars),
                min(1.0, 4.0 * marks / chars),
                min(chars / n, 20.0) / 10.0,
                len(set(words)) / n,
                same / n,
                float(line in seen),
                float(words[-1][-1] in ".!?"),
                float(n < 4),
                float(symbols * 5 > n),
            )
        )
        lengths.append(chars)
        seen.add(line)
    if not rows:
        return np.zeros((0, N_FEATURES)), np.zeros(0)
    own = np.array(rows)
    edge = np.zeros((1, N_LINE))
    before, after = np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])
    return np.concatenate([own, before, after, np.ones((len(own), 1))], axis=1), np.array(lengths, float)


@dataclass(frozen=True)
class LineCrf:
    """weights: score of the label good by feature; transitions[a][b]: from label a to b; slope, offset: calibration."""

    weights: np.ndarray
    transitions: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """Each line's probability to be good, by scaled forward and backward passes."""
        n = len(features)
        good = 1.0 / (1.0 + np.exp(-np.clip(features @ self.weights, -30, 30)))
        if n == 1:
            return good
        (t00, t01), (t10, t11) = np.exp(np.clip(self.transitions, -30, 30)).tolist()
        e = good.tolist()
        forward, a0, a1 = [], 1.0 - e[0], e[0]
        forward.append((a0, a1))
        for g in e[1:]:
            x0, x1 = (a0 * t00 + a1 * t10) * (1.0 - g), (a0 * t01 + a1 * t11) * g
            s = x0 + x1
            a0, a1 = x0 / s, x1 / s
            forward.append((a0, a1))
        out = [a1]
        b0 = b1 = 1.0
        for k in range(n - 1, 0, -1):
            g = e[k]
            w0, w1 = (1.0 - g) * b0, g * b1
            x0, x1 = t00 * w0 + t01 * w1, t10 * w0 + t11 * w1
            s = x0 + x1
            b0, b1 = x0 / s, x1 / s
            a0, a1 = forward[k - 1]
            p0, p1 = a0 * b0, a1 * b1
            out.append(p1 / (p0 + p1))
        return np.array(out[::-1])

    def raw(self, features: np.ndarray, lengths: np.ndarray) -> float:
        """Length-weighted mean of the marginals."""
        return float(np.average(self.marginals(features), weights=lengths))

    def score(self, text: str | None) -> float:
        """0 to 1; a text without words has the score of a mean of one half."""
        features, lengths = line_features(text)
        mean = self.raw(features, lengths) if len(features) else 0.5
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * mean + self.offset, -30, 30))))


def _sums(emit: np.ndarray, mask: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the label good (n, steps) and sums of pairs of labels (n, 2, 2) of chains with emission scores (n, steps)."""
    n, steps = emit.shape
    good = 1.0 / (1.0 + np.exp(-np.clip(emit, -30, 30)))
    e, trans = np.stack([1.0 - good, good], axis=2), np.exp(np.clip(t, -30, 30))
    alpha, beta = np.zeros((n, steps, 2)), np.ones((n, steps, 2))
    alpha[:, 0] = e[:, 0]
    for k in range(1, steps):
        a = (alpha[:, k - 1] @ trans) * e[:, k]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, k] = np.where(mask[:, k, None], a, alpha[:, k - 1])
    for k in range(steps - 1, 0, -1):
        b = (e[:, k] * beta[:, k]) @ trans.T
        b /= b.sum(axis=1, keepdims=True)
        beta[:, k - 1] = np.where(mask[:, k, None], b, beta[:, k])
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * trans[None, None] * (e * beta)[:, 1:, None, :]
    pair /= np.maximum(pair.sum(axis=(2, 3), keepdims=True), 1e-300)
    return gamma[:, :, 1], np.einsum("nkab,nk->nab", pair, mask[:, 1:].astype(float))


def _gradients(chains: np.ndarray, mask: np.ndarray, share: np.ndarray, labels: np.ndarray, w: np.ndarray, t: np.ndarray):
    """Gradients of the documents' log-likelihood. ``share``: lines' shares of their document's length.

    A weighted sum of marginals is the slope of the log-partition in the direction of the weights, so its gradient is
    the marginals' (and pairs') slope in that direction, taken as a central difference.
    """
    emit, step = chains @ w, 1e-4
    (up, pairs_up), (down, pairs_down) = (_sums(emit + s * step * share, mask, t) for s in (1, -1))
    mean = ((up + down) / 2 * share).sum(axis=1)
    wrong = (labels - 1.0 / (1.0 + np.exp(-STEEP * (mean - 0.5)))) * STEEP
    slope = (up - down) / (2 * step) * mask
    return np.einsum("n,nk,nkf->f", wrong, slope, chains), np.einsum("n,nab->ab", wrong, (pairs_up - pairs_down) / (2 * step))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a little shrinkage."""
    design, theta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (y - p) - 0.01 * theta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 100, shrink: float = 1e-3) -> LineCrf:
    """Train from (features, lengths, label) of documents by Adam steps on the penalised likelihood of their labels.

    Without documents of both labels the field knows nothing: scores are one half, or lean to the only label.
    """
    docs = sorted((d for d in docs if len(d[0])), key=lambda d: len(d[0]))
    labels = {d[2] for d in docs}
    if len(labels) < 2:
        lean = 2.0 * (labels.pop() - 0.5) if labels else 0.0
        return LineCrf(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.0, lean)
    groups = []
    for k in range(0, len(docs), TRAIN_GROUP):
        part = docs[k : k + TRAIN_GROUP]
        steps = len(part[-1][0])
        x, mask, share = np.zeros((len(part), steps, N_FEATURES)), np.zeros((len(part), steps), bool), np.zeros((len(part), steps))
        for i, (features, lengths, _) in enumerate(part):
            x[i, : len(features)], mask[i, : len(features)], share[i, : len(features)] = features, True, lengths / lengths.sum()
        groups.append((x, mask, share, np.array([d[2] for d in part], float)))
    w, t = np.zeros(N_FEATURES), np.zeros((2, 2))
    m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for k in range(1, rounds + 1):
        found = [_gradients(*group, w, t) for group in groups]
        g = np.sum([np.r_[gw, gt.ravel()] for gw, gt in found], axis=0) / len(docs) - shrink * np.r_[w, t.ravel()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, t = w + step[:N_FEATURES], t + step[N_FEATURES:].reshape(2, 2)
    field = LineCrf(w, t)
    means = np.array([field.raw(f, n) for f, n, _ in docs])
    return LineCrf(w, t, *_logistic(means, np.array([d[2] for d in docs], float)))


_FEATURES_SCHEMA = T.StructType(
    [
        T.StructField("features", T.BinaryType()),
        T.StructField("lengths", T.BinaryType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("hash", T.LongType()),
    ]
)


def _training_rows(batches):
    for batch in batches:
        found = [line_features(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f.astype(np.float32).tobytes() for f, _ in found], pa.binary()),
                pa.array([n.tobytes() for _, n in found], pa.binary()),
                batch.column(1).cast(pa.int32()),
                batch.column(2).cast(pa.string()),
                batch.column(3),
            ],
            names=["features", "lengths", "label", "id", "hash"],
        )


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 3,
    held_out: int = 1,
    n_docs: int = TRAIN_DOCS,
    max_lines: int = TRAIN_LINES,
) -> LineCrf:
    """Fit on up to ``n_docs`` documents of each label, the first by hashed id, none of the held-out fold.

    The sample is drawn from documents of at most ``max_lines`` lines; a repeated row is in it once. Labels other than
    0 and 1 (null too) are no labels; of a document's two labels both count. Null ids match nothing.
    """
    ensure_shipped(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    marked = marked.where((fold_of("id", folds) != held_out) & F.col("id").isNotNull() & F.col("label").isin(0, 1)).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    short = texts.where(F.length("text") - F.length(F.translate("text", "\n", "")) < max_lines).select("id", "hash")
    able = short.join(marked, "id").distinct()
    parts = [able.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id", "hash").limit(n_docs) for y in (0, 1)]
    chosen = written(parts[0].union(parts[1]), "training-sample")  # 2 * n_docs rows at most
    rows = texts.join(F.broadcast(chosen), ["id", "hash"])
    made = rows.select("text", "label", "id", "hash").mapInArrow(_training_rows, _FEATURES_SCHEMA)
    found = made.dropDuplicates(["id", "hash", "label"]).collect()
    return fit(
        [
            (np.frombuffer(r.features, np.float32).reshape(-1, N_FEATURES).astype(float), np.frombuffer(r.lengths), r.label)
            for r in sorted(found, key=lambda r: (bytes(r.features), r.label))
        ]
    )


def with_score(df: DataFrame, model: LineCrf, text_col: str = "text", name: str = "score") -> DataFrame:
    """Add the quality score of every row; null and empty texts have the score of an undecided document."""

    ensure_shipped(df.sparkSession)
    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return df.withColumn(name, scored(F.col(text_col)))


def good_documents(df: DataFrame, model: LineCrf, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``df`` whose score is at least the threshold; names in ``df`` can't clash."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(text_col).alias("_text"))
    return with_score(rows, model, "_text", "_score").where(F.col("_score") >= threshold).select("_row.*")


def op3_line_crf(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from labels of documents outside the held-out fold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    return with_score(docs, model).select(
        "doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
