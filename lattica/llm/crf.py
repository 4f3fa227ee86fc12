"""Line labelling by a linear-chain conditional random field (operator 2).

Each line with a word is content or boilerplate.  A chain CRF scores lines by
a few measures of their form and neighbours by whether the label changes;
Viterbi decoding finds the best labelling of a text, and a document stays if
enough of its words stand in content lines.

No line labels exist, so the field is fitted to weak labels: plain rules on a
line's form, applied to a bounded sample of documents.  The field smooths the
rules' hard limits and carries labels over to neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import SPACES, binary_list, column, in_arrow, sample_rows

SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_ENDS = (b".", b"!", b"?", b'"', b"'", b":", b";", "…".encode(), "。".encode(), "”".encode())
CONTENT, BOILERPLATE = 0, 1
#: Rules fitted to: shares beyond which a line counts as boilerplate.
WEAK = {"symbols": 0.08, "capitals": 0.7, "repeated": 0.6, "digits": 0.4, "shouts": 0.5}
N_FEATURES = 10


def _without(line: bytes, drop: bytes) -> int:
    return len(line) - len(line.translate(None, drop))


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of measures for each line that has a word, and the words of each."""
    rows, counts, seen = [], [], set()
    for line in lines:
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        upper, lower = _without(line, _UPPER), _without(line, _LOWER)
        repeated = 1 - len(set(words)) / n if n >= 5 else 0.0
        rows.append((1.0, min(np.log1p(n) / 5, 2.0), _without(line, SYMBOLS) / size, upper / max(1, upper + lower) if n >= 3 else 0.0, _without(line, _DIGITS) / size, repeated, float(words[-1].endswith(_ENDS)), min(1.0, line.count(b"!!") / n), float(n < 5), float(line in seen)))
        counts.append(n)
        seen.add(line)
    return np.array(rows, float).reshape(-1, N_FEATURES), np.array(counts, np.int64)


def weak_labels(x: np.ndarray) -> np.ndarray:
    bad = (x[:, 2] > WEAK["symbols"]) | (x[:, 3] > WEAK["capitals"]) | (x[:, 5] > WEAK["repeated"]) | (x[:, 4] > WEAK["digits"]) | (x[:, 7] > WEAK["shouts"])
    return (bad | ((x[:, 8] > 0) & (x[:, 6] == 0) & (x[:, 9] > 0))).astype(int)


def fit(texts: list[bytes], steps: int = 80, rate: float = 0.2, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (2 x features) and transition weights (2 x 2): the
    largest penalised likelihood of the weak labels, by forward-backward and Adam."""
    seqs = [x for x in (line_features(t.split(b"\n"))[0] for t in texts) if len(x)]
    if not seqs:
        return np.zeros((2, N_FEATURES)), np.zeros((2, 2))
    seqs.sort(key=len, reverse=True)
    longest, n = len(seqs[0]), len(seqs)
    alive = np.array([sum(len(s) > t for s in seqs) for t in range(longest)])  # sequences are sorted: the first ones last longest
    xs = [np.stack([s[t] for s in seqs[: alive[t]]]) for t in range(longest)]
    ys = [weak_labels(x) for x in xs]
    total = alive.sum()
    params = np.zeros(2 * N_FEATURES + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    lse = lambda a, axis: np.logaddexp(a.take(0, axis), a.take(1, axis))
    for step in range(1, steps + 1):
        w, tr = params[:-4].reshape(2, -1), params[-4:].reshape(2, 2)
        em = [x @ w.T for x in xs]
        forward = [em[0]]
        for t in range(1, longest):
            forward.append(em[t] + lse(forward[-1][: alive[t], :, None] + tr, 1))
        backward = [np.zeros_like(e) for e in em]
        for t in range(longest - 2, -1, -1):
            k = alive[t + 1]
            backward[t][:k] = lse(tr + (em[t + 1] + backward[t + 1])[:, None, :], 2)
        z = lse(forward[0] + backward[0], 1)
        gw, gt = -decay * total * w, -decay * total * tr
        for t in range(longest):
            k = alive[t]
            p = np.exp(forward[t] + backward[t] - z[:k, None])
            hot = np.eye(2)[ys[t]]
            gw = gw + (hot - p).T @ xs[t]
            if t:
                both = np.exp(forward[t - 1][:k, :, None] + tr + (em[t] + backward[t])[:, None, :] - z[:k, None, None])
                gt = gt + np.einsum("ni,nj->ij", np.eye(2)[ys[t - 1][:k]], hot) - both.sum(0)
        g = np.concatenate([gw.ravel(), gt.ravel()]) / total
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return params[:-4].reshape(2, -1), params[-4:].reshape(2, 2)


def viterbi(emissions: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best labels of one sequence; of equal ones, those that say content earlier."""
    (cc, cb), (bc, bb) = transitions.tolist()
    back, (c, b) = [], emissions[0].tolist()
    for ec, eb in emissions[1:].tolist():
        from_c, from_b = (0 if c + cc >= b + bc else 1), (0 if c + cb >= b + bb else 1)
        back.append((from_c, from_b))
        c, b = max(c + cc, b + bc) + ec, max(c + cb, b + bb) + eb
    label = 0 if c >= b else 1
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return np.array(out[::-1])


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that stand in a window found twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    codes = ids[: n - window + 1]
    for k in range(1, window):
        if len(number) ** 2 >= 1 << 62 or codes.max(initial=0) >= (1 << 62) // max(1, len(number)):
            codes = np.unique(codes, return_inverse=True)[1]
        codes = codes * len(number) + ids[k : n - window + 1 + k]
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(codes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(window):
        covered[k : n - window + 1 + k] |= twice
    return int(covered.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    seen, repeats = set(), 0
    for line in text.split(b"\n"):
        if line and not line.isspace() and line.translate(None, SPACES):
            repeats += line in seen
            seen.add(line)
    tight = text.translate(None, SPACES)
    chars = len(tight) - len(tight.translate(None, bytes(range(0x80, 0xC0))) ) if not tight.isascii() else 0
    return len(words), len(tight) - chars, _without(text, SYMBOLS), repeats, repeated_words(words)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double"


def label_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000, keep_share: float = 0.5) -> DataFrame:
    """Counts, labels and a verdict for each document, from its whole text.

    The field is fitted to at most ``sample`` documents, those whose ids hash
    lowest.  ``kept`` needs the base rules and at least ``keep_share`` of the
    words in content lines.  Null and empty texts have no words and fail the
    base rules; repeated rows repeat; null ids pass through; an empty table
    gives no rows.  No shuffle of texts; memory is bounded by a batch."""
    docs = df.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    chosen = sample_rows(docs.where("text is not null").withColumn("all", F.lit(0)), "all", sample).select("text").collect()
    weights, transitions = fit(sorted(r["text"].encode() for r in chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in binary_list(batch.column(1)):
                text = text or b""
                n, chars, symbols, dups, repeats = base_counts(text)
                failed = n < 50 or 100 * repeats > 50 * n
                x, counts = line_features(text.split(b"\n"))
                content = viterbi(x @ weights.T, transitions) == CONTENT if len(x) else np.zeros(0, bool)
                share = float(counts[content].sum() / n) if n else 0.0
                rows.append((n, chars, symbols, dups, repeats, failed, not failed and share >= keep_share, len(x), int(content.sum()), share))
            columns = list(zip(*rows)) or [()] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return in_arrow(docs, run, SCHEMA)
