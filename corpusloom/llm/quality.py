"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text are cut at quantiles into at most 255 bins;
trees of fixed depth are grown on histograms of gradients and hessians of the
logistic loss.  All trees are flattened into arrays in heap order, so a batch
of documents walks every tree with a few array operations.

The trees are fitted on the driver, on at most `max_train` labelled rows: those
with the smallest hashes of their ids, and of rows that repeat an id the one with
the smallest text hash.  A row's id, language, source and label
are no statistics.

Defined results: null counts as empty, and empty texts are scored like any
others; documents that repeat a doc_id are rows of their own; of several labels
for a doc_id the lowest quality counts, null labels do not; with no label to
learn from the score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common

MAX_TRAIN = 20_000
N_TREES = 120
DEPTH = 4
RATE = 0.1
MAX_BINS = 255
THRESHOLD = 0.3

_MARKS = b".,;:!?|#$%&*@-_=+/\\\"'()<>[]{}~^`"
_UPPER, _LOWER, _DIGIT, _HIGH = (np.array([bool(f(c)) for c in range(256)]) for f in (lambda c: 65 <= c <= 90, lambda c: 97 <= c <= 122, lambda c: 48 <= c <= 57, lambda c: c >= 128))
#: What features() measures, in order.
NAMES = (
    ["log_bytes", "log_words", "upper", "lower", "digit", "high", "space", "newline", "letters_of_visible", "byte_entropy"]
    + [f"mark_{chr(m)}" for m in _MARKS]
    + ["word_mean", "word_std", "word_max", "distinct_words", "commonest_word", "top_ten_words", "short_words", "capital_words", "capitalised", "digit_words", "mark_ended", "markless", "word_entropy"]
    + ["lines", "line_mean", "line_std", "distinct_lines", "repeated_line_bytes", "commonest_line", "short_lines", "sentences_per_word", "repeated_pairs"]
)


def features(text: bytes) -> list[float]:
    """Statistics of one whole text."""
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = count / n
    some = share[share > 0]
    visible = n - int(count[32]) - int(count[9:14].sum())
    letters = int(count[_UPPER].sum() + count[_LOWER].sum() + count[_HIGH].sum())
    words = text.split()
    m = max(1, len(words))
    out = [
        float(np.log1p(n)), float(np.log1p(len(words))), *(float(share[k].sum()) for k in (_UPPER, _LOWER, _DIGIT, _HIGH)), float(share[32]), float(share[10]),
        letters / max(1, visible), float(-(some * np.log2(some)).sum()),
        *(1000 * share[list(_MARKS)]).tolist(),
    ]
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    freq = Counter(words)
    top = [c for _, c in freq.most_common(10)]
    p = np.fromiter(freq.values(), float, len(freq)) / m
    first = bytes([w[0] for w in words])
    last = bytes([w[-1] for w in words])
    a, z = np.frombuffer(first, np.uint8), np.frombuffer(last, np.uint8)
    marks = np.zeros(256, bool)
    marks[list(_MARKS)] = True
    pairs = len(set(zip(words, words[1:])))
    out += [
        float(size.mean()), float(size.std()), float(np.log1p(size.max())), len(freq) / m, top[0] / m if top else 0.0, sum(top) / m, float((size <= 3).sum() / m),
        sum(c for w, c in freq.items() if w.isupper() and len(w) > 1) / m, float(_UPPER[a].sum() / m), sum(c for w, c in freq.items() if w.isdigit()) / m, float(marks[z].sum() / m),
        sum(c for w, c in freq.items() if w.isalpha()) / m, float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
    ]
    lines = text.split(b"\n")
    k = len(lines)
    long = np.fromiter(map(len, lines), np.int64, k)
    same = Counter(lines)
    out += [
        float(np.log1p(k)), float(np.log1p(long.mean())), float(np.log1p(long.std())), len(same) / k, sum((c - 1) * len(x) for x, c in same.items()) / n,
        max(same.values()) / k, float((long < 20).sum() / k), float((count[46] + count[33] + count[63]) / m), 1 - pairs / max(1, len(words) - 1),
    ]
    return out


class Trees:
    """Boosted trees as arrays: feature, cut and child values in heap order."""

    def __init__(self, n_trees: int = N_TREES, depth: int = DEPTH, rate: float = RATE, max_bins: int = MAX_BINS, l2: float = 1.0, least: float = 1.0):
        self.n_trees, self.depth, self.rate, self.max_bins, self.l2, self.least = n_trees, depth, rate, max_bins, l2, least
        self.base = 0.0
        inner = (1 << depth) - 1
        self.feature, self.cut, self.leaf = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        if not n:
            return self
        mean = float(np.clip(y.mean(), 0.01, 0.99))
        self.base = float(np.log(mean / (1 - mean)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.max_bins)[1:-1])) for j in range(d)]
        bins = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)], 1)  # bin b: edges[b-1] < x <= edges[b]
        width = max(len(e) for e in edges) + 1
        flat = bins + np.arange(d) * width
        f = np.full(n, self.base)
        features_, cuts, leaves = [], [], []
        inner = (1 << self.depth) - 1
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(n, np.int64)  # within its level
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(self.depth):
                k = 1 << level
                at = (node[:, None] * (d * width) + flat).ravel()
                gs, hs = (np.bincount(at, np.repeat(v, d), k * d * width).reshape(k, d, width) for v in (g, h))
                gl, hl = gs.cumsum(2), hs.cumsum(2)
                gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
                gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                gain[(hl < self.least) | (ht - hl < self.least)] = 0
                best = gain.reshape(k, -1).argmax(1)
                good = gain.reshape(k, -1)[np.arange(k), best] > 1e-6
                j, b = best // width, best % width
                for i in np.flatnonzero(good):
                    feature[k - 1 + i], cut[k - 1 + i] = j[i], edges[j[i]][b[i]] if b[i] < len(edges[j[i]]) else np.inf
                node = 2 * node + (x[np.arange(n), feature[k - 1 + node]] > cut[k - 1 + node])
            gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
            leaf = -self.rate * gs / (hs + self.l2)
            f += leaf[node]
            features_.append(feature)
            cuts.append(cut)
            leaves.append(leaf)
        self.feature, self.cut, self.leaf = np.stack(features_), np.stack(cuts), np.stack(leaves)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1: every row in every tree at once, level by level."""
        if not len(self.leaf):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        t = np.arange(len(self.leaf))[None, :]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[t, node - self.feature.shape[1]].sum(axis=1))))


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in raw]).reshape(-1, len(NAMES))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, max_train: int = MAX_TRAIN, **options) -> Trees:
    """Learns from the labelled documents that are usable, max_train of them at most."""
    common.prepare(docs.sparkSession)
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (usable if usable is not None else F.lit(True)))
    chosen = rows.groupBy("doc_id").agg(F.min(label).alias("__label")).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_train)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(common.raw_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("__label").cast(pa.float64()), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_train small rows
    # of rows that repeat a doc_id the one with the smallest text hash is learned from, so the bound holds
    one = texts.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("__h"))
    texts = texts.withColumn("__h", F.xxhash64("text")).join(F.broadcast(one), ["doc_id", "__h"]).dropDuplicates(["doc_id", "__h"])
    data = texts.select("text", F.col("__label").cast("double").alias("__label")).mapInArrow(measure, "y double, x array<double>").toPandas()
    if data.empty:
        return Trees(**options)
    x, y = np.array(data["x"].tolist()), data["y"].to_numpy()
    order = np.lexsort([*x.T, y])  # whatever order the rows came in
    return Trees(**options).fit(x[order], y[order])


def scored(spark: SparkSession, model: Trees):
    """A column function of texts: the probability of label 1."""
    shared = common.prepare(spark).sparkContext.broadcast(model)  # n_trees times 2**depth numbers

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shared.value.predict(_matrix(common.raw_texts(batch))), pa.float64())
        common.release()

    return run.asNondeterministic()  # so that it runs once, however often it is used


def score(docs: DataFrame, model: Trees, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The columns of keep, score and predicted (1: score >= threshold)."""
    rows = common.boxed(docs).withColumn("__p", scored(docs.sparkSession, model)(common.field("text")))
    return rows.select(*common.fields(keep), F.col("__p").alias("score"), (F.col("__p") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score well enough, with their columns."""
    return common.unboxed(common.boxed(docs).filter(scored(docs.sparkSession, model)(common.field("text")) >= threshold))
