"""Toxicity by compression distance (operator 4).

Two zstandard dictionaries are trained: one on ordinary text, one on toxic
text.  A window of words is compressed once with the ordinary dictionary and
once with the toxic one in front of it; the bytes that the toxic dictionary
saves are the window's margin.  A document's score comes from the margins of
all its windows through a calibrated logistic curve.

The toxic dictionary is trained on the words that set toxic text apart: those
found in far more different surroundings in toxic than in ordinary documents.
Counting surroundings, not occurrences, keeps copied passages out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import binary_list, column, held_out, in_arrow, learnable, sample_rows

#: Punctuation that is cut off words before their surroundings are counted.
_EDGES = b".,!?;:\"'()[]"
THRESHOLD = 0.3


def windows(text: bytes, size: int) -> list[bytes]:
    """Stretches of ``size`` words, one after another, ASCII letters lower-cased."""
    words = text.lower().split()
    return [b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


def _surroundings(texts: list[bytes]) -> dict[bytes, set[int]]:
    found: dict[bytes, set[int]] = defaultdict(set)
    for text in texts:
        words = [w.strip(_EDGES) for w in text.lower().split()]
        for before, word, after in zip([b"", *words], words, [*words[1:], b""]):
            found[word].add(xxhash.xxh64_intdigest(before + b" " + after))
    return found


def toxic_words(toxic: list[bytes], ordinary: list[bytes], share: float = 0.008, ratio: float = 16.0) -> list[bytes]:
    """Words with surroundings for at least ``share`` of the toxic texts (five at least), ``ratio`` times as many a text as in ordinary ones; the most telling last."""
    least = max(5, share * len(toxic))
    in_toxic, in_ordinary = _surroundings(toxic), _surroundings(ordinary)
    rate = lambda w, found, n: (len(found.get(w, ())) + 0.5) / max(1, n)
    telling = {w: len(s) for w, s in in_toxic.items() if w and len(s) >= least and rate(w, in_toxic, len(toxic)) > ratio * rate(w, in_ordinary, len(ordinary))}
    return sorted(telling, key=lambda w: (telling[w], w))


def _telling_text(texts: list[bytes], words: list[bytes]) -> list[bytes]:
    """Training samples: what is left of each toxic text when only its telling words stay."""
    telling = set(words)
    kept = ([w.strip(_EDGES) for w in t.lower().split()] for t in texts)
    return [b"".join(b" " + w + b" " for w in ws if w in telling) for ws in kept]


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content of a trained dictionary; the samples themselves where zstandard finds too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    curve: np.ndarray  # intercept and the weights of ``features``
    size: int
    level: int

    def compressors(self):
        import zstandard

        raw = lambda b: zstandard.ZstdCompressionDict(b or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        make = lambda d: zstandard.ZstdCompressor(level=self.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        return make(raw(self.ordinary)).compress, make(raw(self.toxic + self.ordinary)).compress

    def features(self, text: bytes, compressors) -> np.ndarray:
        """Largest margin, mean of the three largest, share of windows with a saving, log of their number."""
        ordinary, toxic = compressors
        found = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text, self.size)] or [0])
        top = np.sort(found)[::-1][:3]
        return np.array([top[0], top.mean(), (found >= 3).mean(), np.log1p((found >= 3).sum())])

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.curve[1:] + self.curve[0], -50, 50)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)) * len(x) / 100
        w = w + np.linalg.solve(h, a.T @ (y - p) - ridge * w * len(x) / 100)
    return w


def calibrate(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """A logistic curve whose ``threshold`` falls where the F1 measure is best."""
    if len(set(y.tolist())) < 2:
        return np.array([-3.0 if not y.any() else 3.0, 0, 0, 0, 0])
    w = _logistic(x, y)
    logits = x @ w[1:] + w[0]
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.append(np.diff(logits[order]) != 0, True)  # rows of one logit go together
    best = int(np.argmax(np.where(ends, f1, -1)))
    below = logits[order][best + 1] if best + 1 < len(y) else logits[order][best] - 1
    w[0] += np.log(threshold / (1 - threshold)) - (logits[order][best] + below) / 2
    return w


def fit(toxic: list[bytes], ordinary: list[bytes], size: int = 8, level: int = 12, dictionary: int = 24_000, most_windows: int = 100_000) -> Model:
    """Dictionaries from two thirds of the texts of either kind, the curve from
    the others.  The ordinary dictionary is trained on ``most_windows`` windows
    at most, taken evenly from all its texts."""
    learn = lambda texts: [t for i, t in enumerate(texts) if i % 3] or texts
    apart = lambda texts: [t for i, t in enumerate(texts) if i % 3 == 0]
    words = toxic_words(learn(toxic), learn(ordinary))
    plain = [w for t in learn(ordinary) for w in windows(t, size)]
    plain = plain[:: -(-len(plain) // most_windows)] if plain else plain
    model = Model(_trained(plain, dictionary), _trained(_telling_text(learn(toxic), words), dictionary // 2), np.zeros(5), size, level)
    rows, ys, tools = [], [], model.compressors()
    for texts, y in ((apart(toxic), 1), (apart(ordinary), 0)):
        rows += [model.features(t, tools) for t in texts]
        ys += [y] * len(texts)
    model.curve = calibrate(np.array(rows).reshape(-1, 4), np.array(ys), THRESHOLD)
    return model


def score_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 2000, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of each row, from its whole text.

    Labels are learned from at most ``sample`` toxic and twice as many ordinary
    learnable documents, those whose rows hash lowest; of a document's conflicting labels, toxic
    counts; unlabelled rows are only scored.  Null
    texts count as empty, which have a score as well; without labels of both
    kinds all scores are alike; repeated rows repeat; an empty table gives no
    rows.  The texts are not shuffled; the join for the sample carries ids."""
    docs = df.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    labelled = labels.select(column(id_col).cast("long").alias("doc_id"), column(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = sample_rows(labelled.where(learnable(F.col("doc_id"))), "y", 2 * sample)
    picked = picked.where(F.col("y") == 0).union(sample_rows(picked.where(F.col("y") == 1), "y", sample))
    found = docs.where("text is not null").join(F.broadcast(picked), "doc_id")  # 3 x sample ids
    # A repeated id stands for one document, that of the lowest text hash, so that the sample's rows are bounded.
    lowest = found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    rows = lowest.select("y", "least.text").collect()
    texts = {y: sorted(r["text"].encode() for r in rows if r["y"] == y) for y in (0, 1)}
    shuffled = {y: [t[i] for i in np.random.default_rng(5).permutation(len(t))] for y, t in texts.items()}
    model = fit(shuffled[1], shuffled[0], **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.compressors()
        for batch in batches:
            made = [model.features(t or b"", tools) for t in binary_list(batch.column(1))]
            score = model.score(np.array(made).reshape(-1, 4))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(2), "score": pa.array(score), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))})

    return in_arrow(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("h")), run, "doc_id long, held_out boolean, score double, predicted int")
