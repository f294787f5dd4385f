"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier a bit, logistic over hashed letter trigrams of
the whole text, predicts it.  A document gets the language whose codeword has the least logistic
loss, bits weighed by their accuracy on the training sample, and is flagged as ambiguous where the
runner-up is close.  Up to five languages have the exhaustive code, more get a seeded random code of
large distance.

Defined results: null texts and texts without a letter are `und` with score 0; rows without a
language don't train; of rows that share an id and a language the smallest text trains; where codewords
are equally near, the first language by name wins; with no training row everything is `und`; with one language that is the answer;
null ids stay null and repeated rows are predicted alike; an empty table gives no rows; other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remainder

#: Training documents at most, shared evenly by the languages; hashed trigram dimensions.
SAMPLE, DIMENSIONS = 3_000, 1 << 13
FOLDS, HELD_OUT = 3, 1
STEPS, RATE, DECAY, AMBIGUOUS = 150, 2.0, 1e-4, 0.2
UNKNOWN = "und"
#: ASCII bytes that aren't letters become spaces.
ONLY_LETTERS = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
LETTER = regex.compile(r"\p{L}").search


def trigrams(text: str) -> np.ndarray:
    """Square roots of hashed trigram counts, of length one."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(ONLY_LETTERS).split()) + b" "
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    code = (b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))) * np.uint32(2654435761)
    counts = np.sqrt(np.bincount(code >> np.uint32(19), minlength=DIMENSIONS).astype(np.float32))
    return counts / max(float(np.linalg.norm(counts)), 1e-9)


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:  # all splits of the languages in two
        splits = [[1 if i == 0 or s >> (i - 1) & 1 else -1 for i in range(n)] for s in range(2 ** (n - 1) - 1)]
        return np.array(splits, dtype=np.float64).T
    bits, rng, best, far = 2 * int(np.ceil(np.log2(n))) + 10, np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        distance = (bits - code @ code.T)[np.triu_indices(n, 1)].min() / 2
        if distance > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, distance
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of the likelihood, and whether the runner-up is near."""
        margin = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * word) * self.trust).sum(axis=1) for word in self.code], axis=1)
        like = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share = like / like.sum(axis=1, keepdims=True)
        top = np.sort(share, axis=1)
        gap = top[:, -1] - (top[:, -2] if share.shape[1] > 1 else 0)
        return loss.argmin(axis=1), share.max(axis=1), gap < AMBIGUOUS


def fit(x: np.ndarray, langs: list[str]) -> Model | None:
    """One logistic classifier a bit, all bits at once, by gradient steps with momentum."""
    languages = tuple(sorted(set(langs)))
    if not languages:
        return None
    code = codewords(len(languages))
    goal = code[[languages.index(v) for v in langs]]
    w, b = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32), np.zeros(code.shape[1])
    dw, db = np.zeros_like(w), np.zeros_like(b)
    share = np.array([1 / langs.count(v) for v in langs])[:, None] / len(languages)  # languages weigh alike
    for _ in range(STEPS):
        pull = goal / (1 + np.exp(np.clip(goal * (x @ w + b), -30, 30))) * share
        dw = 0.9 * dw + RATE * (x.T @ pull.astype(np.float32) - DECAY * w)
        db = 0.9 * db + RATE * pull.sum(axis=0) * 0.1
        w, b = w + dw, b + db
    right = ((x @ w + b) * goal > 0).mean(axis=0)
    odds = np.clip(right, 0.55, 0.999)
    trust = np.log(odds / (1 - odds))
    return Model(languages, code, w, b, trust / trust.mean())


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fit on at most `sample` documents outside the held-out fold, the smallest by hash of each language."""
    known = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).isNotNull() & (remainder(F.col(doc_id), FOLDS) != HELD_OUT))
    each = max(1, sample // max(1, known.select(F.col(lang).cast("string")).distinct().count()))
    keys = known.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.xxhash64(doc_id).alias("h")).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = keys.withColumn("k", first).where(F.col("k") <= each).orderBy("k", "h", "lang", "id").limit(sample).select("id", "lang")
    texts = known.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    joined = texts.join(F.broadcast(chosen), ["id", "lang"])  # `sample` rows at most
    joined = joined.groupBy("id", "lang").agg(F.min("text").alias("text"))  # one text of a repeated id

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, value = [], []
            for t in b.column(2).to_pylist():
                v = trigrams(t)
                at.append(np.flatnonzero(v).astype(np.int16)), value.append(v[v != 0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(pa.int16())), pa.array(value, pa.list_(pa.float32()))], ["id", "lang", "at", "value"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = joined.select("id", "lang", "text").mapInArrow(measure, f"id {id_type}, lang string, at array<smallint>, value array<float>")
    rows = rows.toPandas().sort_values(["id", "lang"])
    x = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
    for i, (at, value) in enumerate(zip(rows["at"], rows["value"], strict=True)):
        x[i, np.asarray(at, dtype=np.int64)] = value
    return fit(x, rows["lang"].tolist())


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for every row of `docs`."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, near = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows, dtype=bool)
            texts = b.column(1).to_pylist()
            rows = [i for i, t in enumerate(texts) if model is not None and t is not None and LETTER(t)]
            for k in range(0, len(rows), 256):
                some = rows[k : k + 256]
                top, share, close = model.decode(np.stack([trigrams(texts[i]) for i in some]))
                score[some], near[some] = share, close
                for i, j in zip(some, top, strict=True):
                    lang[i] = model.languages[j]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(near)], ["doc_id", "lang_pred", "score", "ambiguous"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = source.mapInArrow(predict, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
    return found.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "ambiguous")
