"""Near-duplicate texts by the exact Jaccard similarity of their shingles:
operator 10's second search, for similarities that no bit bound reaches.

Two texts are linked if their sets of hashed shingles have a similarity of
``least`` or more.  Pairs near 0.8 differ in about ten of 64 SimHash bits, too
many to search by bits alone, so candidates come from two searches: the
pigeonhole search of ``simhash`` for the closest, and prefixes for all others:
of n shingles in one order of all, two linked sets share one of the first
n - ceil(least * n) + 1 of either.  Shingles that are frequent in a sample of
the texts stand last in that order, so few prefixes hold them; the sample
decides what the search costs, never what it finds.  Sizes, the places of the
shared shingle and slots that only one of two sets fills leave candidates out
without loss, a SimHash of 256 bits nearly so: its bound (``reach``) lies 6.5
standard deviations beyond what ``least`` leads to.  What remains is compared
on the whole texts.

First each set is compared with one centre of each of its buckets.  Only pairs
that this leaves unconnected are compared in the cells of all buckets, so a
group of near copies makes few pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import simhash
from lattica.llm.common import binary_list, column, cut, in_arrow
from lattica.llm.linking import bucket_cells, components, hot_join, keep_rows, map_cells, row_hash, sized

#: Bits of the wide SimHash, and its 64-bit words.  Sets smaller than ``_FEW`` are compared whatever their bits.
_BITS, _FEW = 256, 64
_WORDS = [f"s{k}" for k in range(_BITS // 64)]
#: 256 slots that the hashes of a set fill, as 64-bit words.
_SLOTS = [f"m{k}" for k in range(4)]
_MULTIPLIERS = [np.uint64(x) for x in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Hashes of the different shingles of a text, in order; a text of fewer words is one shingle, none without a word."""
    words = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(b" ".join(words), 42)] if words else [], np.uint64).view(np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())], np.uint64).view(np.int64))


def rarest_first(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles in the order of their ``counts`` (0 for those not in ``frequent``, which is sorted), then of their hashes."""
    if not len(frequent):
        return found
    at = np.searchsorted(frequent, found)
    at[at == len(frequent)] = 0
    return found[np.argsort(np.where(frequent[at] == found, counts[at], 0), kind="stable")]


def prefix(found: np.ndarray, least: float) -> np.ndarray:
    """The shingles, in one order of all, of which any partner must have one among its own."""
    return found[: len(found) - math.ceil(least * len(found) - 1e-9) + 1] if len(found) else found


def wide_fingerprint(found: np.ndarray) -> list[int]:
    """The words of the wide SimHash of a set; the first is that of its 64-bit hashes."""
    out = []
    for k, multiplier in enumerate(_MULTIPLIERS):
        h = found.view(np.uint64) * multiplier
        out.append(simhash.majority(h ^ (h >> np.uint64(29)) if k else h))
    return out


def slots(found: np.ndarray) -> np.ndarray:
    """The words of the slots that a set fills."""
    filled = np.zeros(64 * len(_SLOTS), np.uint8)
    filled[(found.view(np.uint64) * _MULTIPLIERS[1]) >> np.uint64(56)] = 1
    return np.packbits(filled).view(np.int64)


def reach(least: float) -> int:
    """Bits of the wide SimHash in which linked sets may differ."""
    p = math.acos(2 * least / (1 + least)) / math.pi
    return min(_BITS, math.ceil(_BITS * p + 6.5 * math.sqrt(_BITS * p * (1 - p))))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _frequent(df: DataFrame, text_col: str, size: int, sample: int = 20_000, often: int = 3, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that ``often`` or more of about ``sample`` different texts have, sorted, and how many have each.

    Of more than ``most`` shingles the more frequent are taken.  Texts are
    chosen by a hash, so reruns agree; copies of a text count once."""
    text = column(text_col)
    share = min(1.0, sample / max(1, df.count()))
    at = F.xxhash64(text, F.lit("order")).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    chosen = df.where(text.isNotNull() & (at <= share)).select(text.alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in binary_list(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, size))], names=["key"])

    counts = cut(in_arrow(chosen, run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often), "frequent")
    lowest, total = None, 0
    for n, keys in sorted(map(tuple, counts.groupBy("n").agg(F.count(F.lit(1))).collect()), reverse=True):
        total += keys
        if total > most:
            break
        lowest = n
    if lowest is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    taken = counts.where(F.col("n") >= lowest).toArrow()
    keys, n = (taken.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(keys)
    return keys[order], n[order]


def _sets(df: DataFrame, id_col: str, text_col: str, size: int, least: float) -> DataFrame:
    """A row for each row: its id, version (hash of the text) and row (of all columns), node (hash of its set), size, wide SimHash, slots and prefix."""
    frequent, counts = _frequent(df, text_col, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, size) for t in binary_list(batch.column(3))]
            wide = np.array([wide_fingerprint(s) for s in found], np.int64).reshape(-1, len(_WORDS))
            filled = np.array([slots(s) for s in found], np.int64).reshape(-1, len(_SLOTS))
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3],
                pa.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in found], pa.uint64()).view(pa.int64()),
                pa.array([len(s) for s in found], pa.int32()),
                *(pa.array(np.ascontiguousarray(wide[:, k])) for k in range(len(_WORDS))),
                *(pa.array(np.ascontiguousarray(filled[:, k])) for k in range(len(_SLOTS))),
                pa.array([prefix(rarest_first(s, frequent, counts), least) for s in found], pa.list_(pa.int64())),
            ], names=["doc_id", "version", "row", "node", "n", *_WORDS, *_SLOTS, "prefix"])

    text = column(text_col)
    docs = df.select(column(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), row_hash(df).alias("row"), text.alias("text"))
    return in_arrow(docs, run, f"doc_id long, version long, row long, node long, n int, {', '.join(f'{w} long' for w in _WORDS + _SLOTS)}, prefix array<long>")


class _Search:
    """One search over the sets of ``df``; see the module."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, size: int, least: float):
        self.size, self.least = size, least
        self.docs = df.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
        self.sets = cut(_sets(df, id_col, text_col, size, least), "sets")
        self.distinct = cut(self.sets.groupBy("node").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("n", *_WORDS, *_SLOTS, "prefix"))), "distinct")

    def close(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes, slots and wide SimHashes allow a link."""
        ends = self.distinct.select("node", "n", *_WORDS, *_SLOTS)
        a = ends.select(*(F.col(c).alias(f"a_{c}") for c in ends.columns))
        b = ends.select(*(F.col(c).alias(f"b_{c}") for c in ends.columns))
        bits = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in _WORDS), F.lit(0))
        sizes = F.least("a_n", "b_n") >= self.least * F.greatest("a_n", "b_n") - 1e-9
        # What fills a slot that the other set leaves empty is not in both.
        alone = lambda x, y: sum((F.bit_count(F.col(f"{x}_{m}").bitwiseAND(F.bitwise_not(F.col(f"{y}_{m}")))) for m in _SLOTS), F.lit(0))
        common = F.least(F.col("a_n") - alone("a", "b"), F.col("b_n") - alone("b", "a"))
        sizes &= (1 + self.least) * common >= self.least * (F.col("a_n") + F.col("b_n")) - 1e-6
        joined = pairs.distinct().join(a, F.col("a") == F.col("a_node")).join(b, F.col("b") == F.col("b_node"))
        return joined.where(sizes & ((F.least("a_n", "b_n") < _FEW) | (bits <= reach(self.least)))).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes whose sets are similar, by their texts."""
        pairs = cut(self.close(pairs), "pairs")
        if pairs.isEmpty():
            return pairs
        wanted = cut(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
        # One document of each wanted set; its text is found by id and hash.
        chosen = self.sets.select("node", "doc_id", "version").join(sized(wanted), "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version")).alias("d"))
        chosen = cut(chosen.select("node", F.col("d.doc_id").alias("at"), F.col("d.version").alias("version")), "chosen")
        found = self.docs.join(sized(chosen), F.col("doc_id").eqNullSafe(F.col("at")) & (F.xxhash64("text") == F.col("version")))
        texts = cut(found.groupBy("node").agg(F.min("text").alias("text")), "texts")
        size, least = self.size, self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, np.ndarray] = {}

            def set_of(node: int, text: bytes) -> np.ndarray:
                if node not in known:
                    if sum(map(len, known.values())) > 1 << 20:
                        known.clear()
                    known[node] = shingles(text, size)
                return known[node]

            for batch in batches:
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                left, right = (binary_list(batch.column(k)) for k in (2, 3))
                same = [similar(set_of(m, x), set_of(n, y), least) for m, n, x, y in zip(a, b, left, right)]
                yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return cut(in_arrow(both.select("a", "b", "ta", "tb"), run, "a long, b long"), "links")

    def by_bits(self) -> DataFrame:
        """Candidates of the pigeonhole search: sets of one 64-bit SimHash, and of such within operator 10's bound."""
        nodes = self.distinct.select("node", F.col("s0").alias("fp"))
        lowest = cut(nodes.groupBy("fp").agg(F.min("node").alias("lowest")), "fingerprints")
        same = nodes.join(lowest, "fp").where("node != lowest").select(F.col("node").alias("a"), F.col("lowest").alias("b"))
        edges = simhash.links(lowest.select("fp")).distinct()
        of = lambda end: lowest.select(F.col("fp").alias(end), F.col("lowest").alias(f"{end}_node"))
        near = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
        return same.union(near)

    def links(self, block: int = 1024) -> DataFrame:
        """Edges (a, b) that connect all nodes whose sets are similar."""
        least, limit = self.least, reach(self.least)
        keys = self.distinct.select("node", "n", F.posexplode("prefix").alias("place", "key"))
        shared = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_key"), F.min("node").alias("centre")).where("n_key > 1"), "shared")
        keys = cut(hot_join(keys, shared, "key", "n_key").drop("n_key"), "keys")
        stars = keys.where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
        near = self.verified(stars.union(self.by_bits()))
        roots = components(near)

        def compare(c: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> pa.RecordBatch | None:
            n, place, root = (c[x] for x in ("n", "place", "root"))
            words, filled = ([c[w].view(np.uint64) for w in x] for x in (_WORDS, _SLOTS))
            out_a, out_b = [], []
            for at in range(0, len(left), 128):
                i, j = (x.ravel() for x in np.meshgrid(left[at : at + 128], right, indexing="ij"))
                # Sets that share this shingle first have at most what follows it in common.
                apart = np.floor((n[i] + n[j]) * (1 - least) / (1 + least) + 1e-9)
                common = np.minimum(n[i] - place[i], n[j] - place[j])
                fit = (root[i] != root[j]) & (n[i] + n[j] - 2 * common <= apart)
                if left is right:
                    fit &= i < j
                i, j = i[fit], j[fit]
                # What fills a slot that the other set leaves empty is not in both.
                only_i, only_j = (sum((np.bitwise_count(m[x] & ~m[y]).astype(np.int32) for m in filled), np.zeros(len(i), np.int32)) for x, y in ((i, j), (j, i)))
                fit = (1 + least) * np.minimum(n[i] - only_i, n[j] - only_j) >= least * (n[i] + n[j]) - 1e-6
                i, j = i[fit], j[fit]
                bits = sum((np.bitwise_count(w[i] ^ w[j]).astype(np.int16) for w in words), np.zeros(len(i), np.int16))
                near_ = (bits <= limit) | (np.minimum(n[i], n[j]) < _FEW)
                out_a.append(i[near_])
                out_b.append(j[near_])
            if not sum(map(len, out_a)):
                return None
            a, b = c["node"][np.concatenate(out_a)], c["node"][np.concatenate(out_b)]
            return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

        rooted = keys.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # Buckets whose sets are connected already need no cells.
        mixed = cut(rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n_bucket")).where("lo != hi").select("key", "n_bucket"), "mixed")
        cells = bucket_cells(rooted.drop("centre"), "key", "node", block, mixed)
        rest = map_cells(cells.join(self.distinct.select("node", *_WORDS, *_SLOTS), "node"), "key", compare, "a long, b long")
        return near.union(self.verified(rest))

    def members(self) -> DataFrame:
        """doc_id, row, root and component_id of each row."""
        roots = components(self.links())
        of = self.distinct.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        smallest = of.groupBy("root").agg(F.min("first").alias("component_id"))
        return self.sets.select("doc_id", "row", "node").join(of.join(smallest, "root").select("node", "root", "component_id"), "node")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id and component_id of each row.

    Texts of equal sets of shingles go through the search once; texts without
    words, null included, are one class.  component_id is the smallest id
    reachable, null only where no member has an id.  Repeated rows repeat; an
    empty table gives no rows."""
    return _Search(df, id_col, text_col, shingle, least).members().select("doc_id", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``df`` with one document of each class, as ``linking.keep_rows`` picks it."""
    return keep_rows(df, _Search(df, id_col, text_col, shingle, least).members(), id_col)
