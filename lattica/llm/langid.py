"""Language identification (operator 3): multinomial logistic regression on
TF-IDF weights of hashed character n-grams, sparse through the elastic net of
follow-the-regularised-leader, with its scores calibrated by a temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import column, held_out, in_arrow, learnable, sample_rows, with_results

BITS = 15
ORDERS = (1, 2, 3)
_MULTIPLIERS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
UNKNOWN = "und"


def ngram_counts(text: str, chunk: int = 1 << 20) -> np.ndarray:
    """How often each hashed n-gram of the lower-cased text occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    out = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(points), chunk):
        for n in ORDERS:
            part = points[at : at + chunk + n - 1]
            if len(part) < n:
                continue
            hashed = np.full(len(part) - n + 1, n, np.uint32)
            for k in range(n):
                hashed = (hashed ^ part[k : len(part) - n + 1 + k]) * _MULTIPLIERS[k]
                hashed ^= hashed >> np.uint32(15)
            out += np.bincount(hashed >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # labels x hashed n-grams
    temperature: float

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _vector(np.flatnonzero(counts), counts[counts > 0], self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The label and its probability; ``und`` and 0 for a text without a letter."""
        if not text or not self.labels or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        index, value = self.vector(ngram_counts(text))
        p = _softmax(self.weights[:, index] @ value / self.temperature)
        best = int(np.argmax(p))
        return self.labels[best], float(p[best])


def _vector(index: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value = np.log1p(counts) * idf[index]
    norm = np.sqrt((value * value).sum())
    return index, value / norm if norm else value


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], targets: list[int], n_labels: int, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """FTRL-proximal: each coordinate has its own learning rate; l1 zeroes weak
    weights and l2 shrinks the rest."""
    z, n = np.zeros((n_labels, 1 << BITS)), np.zeros((n_labels, 1 << BITS))
    weights = lambda z, n: np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(vectors)):
            index, value = vectors[i]
            zi, ni = z[:, index], n[:, index]
            w = weights(zi, ni)
            g = (_softmax(w @ value) - np.eye(n_labels)[targets[i]])[:, None] * value
            grown = ni + g * g
            z[:, index] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[:, index] = grown
    return weights(z, n)


def temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The temperature with the least log loss on rows that were not fitted to."""
    if not len(targets):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 160))
    loss = [-np.mean((s := logits / t)[np.arange(len(targets)), targets] - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) - s.max(1)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = 4000) -> Model:
    """Fit to learnable rows only (see ``common.learnable``).

    Document frequencies come from all of them; weights from at most
    ``sample`` of them, spread evenly over the labels; the temperature from
    a fifth of that sample, kept out of the fit."""
    rows = df.select(column(id_col).alias("id"), column(text_col).alias("text"), column(label_col).cast("string").alias("label")).where(learnable(F.col("id")) & F.col("text").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                found += ngram_counts(text.as_py()) > 0
                seen += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(at, -1)), "n": pa.array(np.append(found[at], seen))})

    # At most 2^BITS + 1 rows, whatever the corpus.
    total = in_arrow(rows.select("text"), frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = {r["bucket"]: r["n"] for r in total}
    n_docs = found.pop(-1, 0)
    df_counts = np.zeros(1 << BITS)
    df_counts[list(found)] = list(found.values())
    idf = np.log((1 + n_docs) / (1 + df_counts)) + 1

    labelled = rows.where(F.col("label").isNotNull())
    n_labels = max(1, labelled.select("label").distinct().count())
    chosen = sample_rows(labelled, "label", max(1, sample // n_labels))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(np.flatnonzero(c).astype("<u2").tobytes(), c[c > 0].astype("<u4").tobytes()) for c in (ngram_counts(t.as_py()) for t in batch.column(1))]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "label": batch.column(2), "index": pa.array([m[0] for m in made], pa.binary()), "count": pa.array([m[1] for m in made], pa.binary())})

    # Packed, so that the sample takes a few dozen MB on the driver whatever the texts' lengths.
    sent = in_arrow(chosen.select(F.col("id").cast("long").alias("id"), "text", "label"), vectors, "id long, label string, index binary, count binary")
    data = sorted((r.asDict() for r in sent.collect()), key=lambda r: (r["label"], r["id"] is None, r["id"] or 0, bytes(r["index"]), bytes(r["count"])))
    labels = sorted({r["label"] for r in data})
    xs = [_vector(np.frombuffer(r["index"], "<u2").astype(np.int32), np.frombuffer(r["count"], "<u4"), idf) for r in data]
    ys = [labels.index(r["label"]) for r in data]
    apart = [i for i in range(len(data)) if i % 5 == 0]
    fitted = [i for i in range(len(data)) if i % 5] or apart
    weights = ftrl([xs[i] for i in fitted], [ys[i] for i in fitted], len(labels)) if labels else np.zeros((0, 1 << BITS))
    logits = np.array([weights[:, xs[i][0]] @ xs[i][1] for i in apart]).reshape(len(apart), len(labels))
    return Model(labels, idf, weights, temperature(logits, np.array([ys[i] for i in apart], int)))


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``df`` as a struct), lang_pred and score, from whole texts alone.

    Null, empty and letterless texts are ``und`` with score 0; with nothing
    to learn from, all texts are.  Repeated rows, null ids and columns of any
    name stay as they are; an empty table gives no rows."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # labels x 2^15 numbers at most
    return with_results(df, text_col, lambda texts: [shared.value.predict(t) for t in texts], "lang_pred string, score double")


def predict_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; see ``fit`` and ``identify``."""
    model = fit(df, id_col, text_col, label_col, **options)
    found = identify(df.select(column(id_col).alias("doc_id"), column(text_col).alias("text")), model)
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
