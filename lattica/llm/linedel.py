"""Line dedup by a deletion-neighbourhood join (operator 8).

Lines are sequences of words, known by a 64-bit hash of them.  Two lines belong
together if they are equal, or, from ``near_words`` words on, if one word
inserted, deleted or replaced turns one into the other.  Every line emits each variant with one word deleted
as a hashed key; lines that replace the same word share a variant at the same
place, and a line that another exceeds by one word is itself the other's
variant.  Equal variants are joined, the word edit distance is verified on the
text, and of each class the earliest line stays.

Variants are many, so lines without any possible partner are left out first,
without loss: one edit leaves the first or the second half of a line as it
was, so a line needs a half in common with some other line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import as_row, binary_list, column, cut, in_arrow
from lattica.llm.linking import components, hot_join

_SEED = 42
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bits of the map of wanted lines that goes to all executors (4 MB), and how many lines it is used for.
_MAP_BITS, _MAP_LINES = 25, 1 << 23


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _hash(data: bytes, seed: int = _SEED) -> int:
    return _signed(xxhash.xxh64_intdigest(data, seed))


def half_keys(words: list[bytes]) -> list[int]:
    """Hashes of the halves that a partner within one edit must share: lines of
    n and n + 1 words have a length 2 * floor(m / 2) in common, by which both are halved."""
    n, keys = len(words), []
    for even in {n // 2 * 2, (n - 1) // 2 * 2}:
        half = even // 2
        keys.append(_hash(b" ".join(words[:half]), 2 * even))
        keys.append(_hash(b" ".join(words[n - half :]), 2 * even + 1))
    return keys


def variants(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Hashes of the line without its word i, for each i, and of the line itself."""
    n = len(words)
    w = np.array([xxhash.xxh64_intdigest(x, _SEED) for x in words], np.uint64)
    with np.errstate(over="ignore"):
        powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _BASE, np.uint64))))
        whole = w * powers[n - 1 - np.arange(n)]
        after = np.concatenate((np.cumsum(whole[::-1])[::-1][1:], [np.uint64(0)]))
        before = np.concatenate(([np.uint64(0)], np.cumsum(w[: n - 1] * powers[n - 2 - np.arange(n - 1)])))
        return before + after, int(whole.sum())


def _mixed(hashed: np.ndarray, *salts) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = hashed.copy()
        for salt in salts:
            out = (out ^ (out >> np.uint64(32)) ^ np.asarray(salt, np.uint64)) * _MIX
        return (out ^ (out >> np.uint64(29))).view(np.int64)


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the word edit distance of the two is at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _lines(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    for at, line in enumerate(text.split(b"\n")):
        yield at, line.split()


def line_table(docs: DataFrame, least_words: int, near_words: int) -> DataFrame:
    """A row for each line of ``least_words`` words or more: id, version (hash
    of the whole text), place, the hash of its words and, if it may have near
    partners, its half keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"id": [], "version": [], "place": [], "line": [], "halves": []}
            for id_, text in zip(batch.column(0).to_pylist(), binary_list(batch.column(1))):
                version = _hash(text)
                for place, words in _lines(text):
                    if len(words) >= least_words:
                        for name, value in zip(out, (id_, version, place, _hash(b" ".join(words)), half_keys(words) if len(words) >= near_words else None)):
                            out[name].append(value)
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.list_(pa.int64()) if n == "halves" else pa.int64()) for n, v in out.items()})

    return in_arrow(docs, run, "id long, version long, place long, line long, halves array<long>")


def _wanted_texts(docs: DataFrame, wanted: DataFrame, least_words: int) -> DataFrame:
    """line and its words (joined by blanks) for the wanted lines, each once.

    Up to ``_MAP_LINES`` wanted lines, a map of bits of a fixed size goes to
    all executors and holds back nearly all others; beyond, it would be too
    full to help and all lines are dealt.  The join with ``wanted`` is exact."""
    mapped = wanted.limit(_MAP_LINES + 1).count() <= _MAP_LINES
    at = F.expr(f"line & {(1 << _MAP_BITS) - 1}L")
    bits = wanted.select(at.alias("at")).distinct().groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).collect() if mapped else []
    table = np.zeros(1 << (_MAP_BITS - 6), np.int64)
    if mapped:
        table[[r["word"] for r in bits]] = [r["bits"] for r in bits]
    else:
        table[:] = -1
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, bits = (1 << _MAP_BITS) - 1, shared.value
        for batch in batches:
            lines, texts = [], []
            for text in binary_list(batch.column(1)):
                for _, words in _lines(text):
                    if len(words) >= least_words:
                        joined = b" ".join(words)
                        line = _hash(joined)
                        if int(bits[(line & mask) >> 6]) >> (line & 63) & 1:
                            lines.append(line)
                            texts.append(joined)
            yield pa.RecordBatch.from_pydict({"line": pa.array(lines, pa.int64()), "words": pa.array(texts, pa.binary())})

    found = in_arrow(docs, run, "line long, words binary")
    return found.join(wanted, "line", "left_semi").groupBy("line").agg(F.first("words").alias("words"))


def near_lines(docs: DataFrame, distinct: DataFrame, least_words: int) -> DataFrame:
    """Verified edges (a, b) between hashes of lines one word edit apart: enough
    of them to connect all such lines (a star where many replace the same word)."""
    halves = distinct.select("line", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    wanted = cut(halves.join(shared, "half").select("line").distinct(), "wanted")
    texts = cut(_wanted_texts(docs, wanted, least_words), "lines")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lines, kinds = [], [], []
            for line, joined in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = joined.split(b" ")
                n = len(words)
                gone, own = variants(words)
                keys += [_mixed(gone, np.arange(n), 1), _mixed(gone, n - 1, 2), _mixed(np.array([own], np.uint64), n, 2)]
                kinds.append(np.repeat(np.array([0, 1, 2], np.int8), (n, n, 1)))
                lines.append(np.full(2 * n + 1, line))
            if keys:
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys)), "kind": pa.array(np.concatenate(kinds)), "line": pa.array(np.concatenate(lines))})

    keys = cut(in_arrow(texts, emit, "key long, kind byte, line long"), "variants")
    # Kind 0: lines without the word at one place; equal variants replace the same word, and each line is linked
    # to the smallest.  Kinds 1 and 2 share keys: a variant of a line (1) that is itself another line (2).
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("line")))
    centres = keys.groupBy("key").agg(F.coalesce(of(2), of(0)).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1 and b is not null")
    edges = hot_join(keys, cut(centres, "centres"), "key", "n").where("line != b").select(F.col("line").alias("a"), "b").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = [one_edit(a.split(b" "), b.split(b" ")) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(right, pa.bool_()))

    left = edges.join(texts.select(F.col("line").alias("a"), F.col("words").alias("wa")), "a")
    both = left.join(texts.select(F.col("line").alias("b"), F.col("words").alias("wb")), "b").select("a", "b", "wa", "wb")
    return in_arrow(both, verify, "a long, b long")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 1, near_words: int = 5) -> DataFrame:
    """``row`` (all columns of ``df`` as a struct, its text without repeated
    lines), n_lines and n_removed.

    Lines of fewer than ``least_words`` words (blank ones, unless set) always
    stay; from ``near_words`` words on a line one word edit away counts as a
    repeat, and so do lines that a chain of such edits connects.  Of each
    class the line that comes first by (id, text hash, place) stays; null ids
    come last.  The lines that stay are joined by line feeds as before;
    nothing else in the text changes.  Rows that repeat an id and text count
    as one document and are treated alike.  Null texts stay null (no lines);
    empty texts stay empty (one line); an empty table gives no rows; other
    columns, whatever their names, pass through."""
    text, id_ = column(text_col), column(id_col).cast("long")
    docs = df.where(text.isNotNull()).select(id_.alias("id"), text.alias("text"))
    lines = cut(line_table(docs, least_words, near_words), "places")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "version", "place"))
    distinct = cut(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), first.alias("first"), F.first("halves").alias("halves")), "distinct")
    roots = components(near_lines(docs, distinct, near_words))
    classes = distinct.select("line", "n", "first").join(roots.withColumnRenamed("node", "line"), "line", "left").withColumn("root", F.coalesce("root", "line"))
    repeated = classes.groupBy("root").agg(F.sum("n").alias("all"), F.min("first").alias("earliest")).where("all > 1").select("root", "earliest")
    verdicts = cut(classes.select("line", "root", "n").join(repeated, "root").select("line", "n", "earliest"), "repeated")
    dropped = hot_join(lines.select("id", "version", "place", "line"), verdicts, "line", "n").where(~F.struct(F.col("id").isNull(), "id", "version", "place").eqNullSafe(F.col("earliest")))
    gone = dropped.groupBy(F.col("id").alias("gone_id"), F.col("version").alias("gone_version")).agg(F.collect_set("place").alias("gone"))
    whole = df.select(as_row(df), id_.alias("id"), text.alias("text"))
    joined = whole.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_version")), "left").select("row", "text", "gone")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, removed = [], [], []
            for text, places in zip(binary_list(batch.column(1)), batch.column(2).to_pylist()):
                split = [] if text is None else text.split(b"\n")
                if places:
                    out = set(places)
                    text = b"\n".join([x for k, x in enumerate(split) if k not in out])
                texts.append(text)
                totals.append(len(split))
                removed.append(len(places or ()))
            row = batch.column(0)
            parts = row.flatten()
            parts[at] = pa.array(texts, pa.binary()).cast(parts[at].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(parts, fields=list(row.type)), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], names=["row", "n_lines", "n_removed"])

    from pyspark.sql import types as T

    at = df.columns.index(text_col)
    return in_arrow(joined, rebuild, T.StructType([whole.schema.fields[0], T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))


def summary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of the text that stays; null texts: null)."""
    found = dedup_lines(df.select(column(id_col).alias("doc_id"), column(text_col).alias("text")), **options)
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2("row.text", 256).alias("kept_sha256"))
