"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text, with numpy over its bytes.  Trees are grown here, level by
level, from histograms of at most 64 bins a feature, on a bounded sample of labelled documents
(SAMPLE, the smallest by hash).  The ensemble is flattened into arrays, and a batch of documents
walks all trees at once.

Defined results: null and empty texts are scored like any other from zero statistics; rows whose
label is null don't train; of rows that share an id and a label the smallest text trains; of splits of
equal gain the first feature and the lowest bin win; without a training row every score is 0.5; null ids stay null; repeated
rows score alike; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAF = 60, 4, 64, 0.15, 1.0, 20
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
FEATURES = (
    "log_words", "word_len", "word_len_sd", "long_words", "short_words", "unique_words", "unique_triples", "dup_lines", "line_words",
    "upper", "digits", "symbols", "pipes", "bangs", "commas", "ends", "quotes", "high_bytes", "letters", "entropy", "top_byte", "newlines",
)
SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8)


def statistics(data: bytes) -> list[float]:
    """The values of FEATURES for one UTF-8 text."""
    hist = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    ws = data.split()
    n = len(ws)
    chars = max(1, int(hist.sum() - hist[128:192].sum() - hist[SPACES].sum()))
    lens = np.fromiter(map(len, ws), dtype=np.int64, count=n) if n else np.zeros(1, dtype=np.int64)
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = hist[hist > 0] / max(1, len(data))
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    return [
        np.log1p(n), float(lens.mean()), float(lens.std()), float((lens > 12).mean()), float((lens <= 2).mean()), len(set(ws)) / max(1, n),
        len(set(zip(ws, ws[1:], ws[2:], strict=False))) / max(1, n - 2), 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
        upper / max(1, upper + lower), int(hist[48:58].sum()) / chars, int(hist[SYMBOLS].sum()) / max(1, n), hist[124] / max(1, n), hist[33] / max(1, n),
        hist[44] / max(1, n), (hist[46] + hist[63]) / max(1, n), (hist[34] + hist[39]) / max(1, n), int(hist[192:].sum()) / chars,
        (upper + lower + int(hist[192:].sum())) / chars, float(-(p * np.log2(p)).sum()), float(hist.max()) / max(1, len(data)), hist[10] / max(1, n),
    ]


def table_of(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in texts.cast(pa.binary()).to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass(frozen=True)
class Forest:
    """Complete trees of DEPTH levels, one row a tree; children of node i are 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(DEPTH):
            go = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + go
        raw = self.start + self.leaf[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Logistic boosting; every split is the best of all features' histograms of its node."""
    inner, leaves, d = 2**DEPTH - 1, 2**DEPTH, x.shape[1] if len(x) else 0
    feature = np.zeros((TREES, inner), dtype=np.int64)
    threshold, leaf = np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    if not len(x):
        return Forest(feature, threshold, leaf, 0.0)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1], method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(len(x), start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.zeros(width)
            for j in range(d):
                key = at * BINS + binned[:, j]
                gs, hs, ns = (np.bincount(key, weights=w, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (g, h, None))
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain = np.where((ns >= LEAF) & (nt - ns >= LEAF), gain, 0)[:, : len(edges[j])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(axis=1)
                for i in np.flatnonzero(gain[np.arange(width), k] > best + 1e-9):
                    best[i] = gain[i, k[i]]
                    feature[t, first + i], threshold[t, first + i] = j, edges[j][k[i]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = RATE * np.bincount(at, weights=g, minlength=leaves) / (np.bincount(at, weights=h, minlength=leaves) + L2)
        raw += leaf[t, at]
    return Forest(feature, threshold, leaf, start)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Forest:
    """Fit on at most `sample` labelled documents outside the held-out fold."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (remainder(F.col(doc_id), FOLDS) != HELD_OUT))
    chosen = chosen.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen.distinct()), "id")  # `sample` rows at most
    joined = joined.groupBy("id", "y").agg(F.min("text").alias("text"))  # one text of a repeated id

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(table_of(b.column(2))), pa.list_(pa.float64()))], ["id", "y", "x"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = joined.select("id", "y", "text").mapInArrow(measure, f"id {id_type}, y double, x array<double>").toPandas().sort_values(["id", "y"])
    return grow(np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES)), rows["y"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forest.scores(table_of(b.column(1))))], ["doc_id", "score"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scored = source.mapInArrow(walk, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
