"""Quality classifier: histogram gradient-boosted trees over document statistics.

Spark computes every document's statistics; the trees are fitted on a bounded sample of labelled ones, on binned values,
and flattened into arrays that numpy walks for all documents of a slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bytes_of, crc_of, steps, table
from tessera.llm.words import words

#: Labelled documents that the fit may use (their statistics, 8 bytes each): those with the smallest hashes of doc_id.
FIT_ROWS = 20_000
BINS, DEPTH, TREES, RATE, LAMBDA, LEAST = 64, 4, 80, 0.15, 2.0, 10
#: Score from which a document is predicted to be good.
GOOD = 0.3
_KINDS = ["upper", "lower", "digit", "space", "line", "stop", "pause", "shout", "bar", "sign", "other", "wide"]
STATISTICS = ["bytes", "words", *_KINDS, "word_mean", "word_max", "word_sd", "distinct", "most_frequent", "twice_in_a_row", "shingle_distinct", "line_mean", "line_distinct", "line_most"]
_CLASS = np.full(256, _KINDS.index("other"), np.uint8)
for _name, _set in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", b" \t\r"), ("line", b"\n"), ("stop", b".?"), ("pause", b",;:"), ("shout", b"!"), ("bar", b"|"), ("sign", b"#$%&*+=<>@^~_\\/"), ("wide", range(128, 256))):
    _CLASS[list(_set)] = _KINDS.index(_name)


def statistics(column) -> np.ndarray:
    """(documents, STATISTICS) of whole texts; of empty and null ones all 0."""
    data, off = bytes_of(column)
    hashes, cut, starts, ends = words(column)
    docs, sizes = len(off) - 1, np.diff(off)
    of = np.repeat(np.arange(docs), sizes)
    kinds = np.bincount(of * len(_KINDS) + _CLASS[data], minlength=docs * len(_KINDS)).reshape(docs, -1) / np.maximum(sizes, 1)[:, None]
    out = np.zeros((docs, len(STATISTICS)))
    out[:, 0], out[:, 1] = np.log1p(sizes), np.log1p(np.diff(cut))
    out[:, 2 : 2 + len(_KINDS)] = kinds
    lengths = ends - starts
    line_ends = np.append(np.flatnonzero(data == 10), len(data))
    for d in range(docs):
        a, b = cut[d], cut[d + 1]
        if a == b:
            continue
        n, h, w = b - a, hashes[a:b], lengths[a:b]
        counts = np.unique(h, return_counts=True)[1]
        pairs = h[1:] * np.uint64(3) + h[:-1]
        lines = np.searchsorted(line_ends, starts[a:b])  # the line of each word
        firsts = np.flatnonzero(np.diff(lines, prepend=-1))
        lined = np.unique(np.add.reduceat(h * np.arange(1, n + 1, dtype=np.uint64), firsts) if len(firsts) == 1 else np.add.reduceat(h, firsts), return_counts=True)[1]
        out[d, 2 + len(_KINDS) :] = (w.mean(), np.log1p(w.max()), w.std(), len(counts) / n, counts.max() / n, np.count_nonzero(h[1:] == h[:-1]) / n, len(np.unique(pairs)) / max(1, n - 1), np.log1p(n / len(firsts)), len(lined) / len(firsts), lined.max() / len(firsts))
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> dict[str, np.ndarray]:
    """Trees as arrays: cuts (values that bin each statistic), feature, bin (trees, inner nodes), leaf (trees, leaves), base.

    Level by level: gradient and hessian sums of all nodes, statistics and bins in one bincount each, then the best cut of
    each node. A node that gains nothing sends all its rows left."""
    n, k = x.shape
    cuts = np.full((k, BINS - 1), np.inf)
    for f in range(k):
        own = np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) if n else []
        cuts[f, : len(own)] = own
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(k)], axis=1) if n else np.zeros((0, k), int)
    rate = (y.sum() + 1) / (n + 2)
    base = np.log(rate / (1 - rate))
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    model = {"cuts": cuts, "base": np.array(base), "feature": np.zeros((trees, inner), np.int32), "bin": np.full((trees, inner), BINS, np.int32), "leaf": np.zeros((trees, leaves))}
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            width = 1 << level
            key = ((node[:, None] * k + np.arange(k)) * BINS + binned).ravel()
            sg, sh, sn = (np.bincount(key, np.repeat(v, k), width * k * BINS).reshape(width, k, BINS).cumsum(axis=2) for v in (g, h, np.ones(n)))
            tg, th, tn = sg[:, :1, -1:], sh[:, :1, -1:], sn[:, :1, -1:]
            gain = sg**2 / (sh + LAMBDA) + (tg - sg) ** 2 / (th - sh + LAMBDA) - tg**2 / (th + LAMBDA)
            gain[(sn < LEAST) | (tn - sn < LEAST)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            worth = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            at = width - 1 + np.arange(width)
            model["feature"][t, at], model["bin"][t, at] = best // BINS, np.where(worth, best % BINS, BINS)
            row = width - 1 + node
            node = node * 2 + (binned[np.arange(n), model["feature"][t, row]] > model["bin"][t, row])
        value = -RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + LAMBDA)
        model["leaf"][t] = value
        score += value[node]
    return model


def score(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probability of label 1: all rows walk down each tree together."""
    binned = np.stack([np.searchsorted(model["cuts"][f], x[:, f], "left") for f in range(x.shape[1])], axis=1)
    total, rows = np.full(len(x), float(model["base"])), np.arange(len(x))
    for feature, bin_, leaf in zip(model["feature"], model["bin"], model["leaf"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (binned[rows, feature[node]] > bin_[node])
        total += leaf[node - (1 << DEPTH) + 1]
    return 1 / (1 + np.exp(-total))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """A model from documents (doc_id, text) and labels (doc_id, quality 0/1).

    Labels without a value are left out; of repeated ones the larger counts; without any, every score is 0.5."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, fit_rows / max(1, total)) * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.float64()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # about fit_rows rows of 200 bytes come to the driver, however many labels there are
    got = docs.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(run, "doc_id bigint, y double, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    return fit(x, got.column("y").to_numpy())


def scored(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, score of whole texts; only text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(sent.value, statistics(batch.column("text"))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(crc_of("doc_id"), F.lit(5)) == 0
    model = train(docs, labels.where(~held_out))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
