"""SimHash near-duplicates by generalised pigeonhole search (operator 10).

Fingerprints within ``most`` differing bits are linked.  The 64 bits are
split into groups, correlated bits together; each group i gets a threshold
T_i, with the sum of T_i + 1 over all groups equal to most + 1.  Two linked
fingerprints then differ in at most T_i bits of some group i (T_i = -1: the
group isn't searched).  A dynamic programme picks the thresholds with the
least estimated cost: keys to probe, and candidate pairs to verify as
estimated from how often each bit is set in all fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import binary_list, column, cut, in_arrow
from lattica.llm.linking import bucket_cells, components, forest, keep_rows, map_cells, row_hash

BITS = 64
#: Estimated seconds for a key (dealt, sorted and read) and for a pair (compared in bulk).
COST_KEY, COST_PAIR = 2e-6, 4e-9


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The SimHash of a text as a signed 64-bit integer: a bit is set if over
    half the hashes of its shingles set it; 0 without a word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    return majority(np.array(hashes, np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes, as a signed integer."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, row (a hash of all columns) and fp of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([fingerprint(t, shingle) for t in binary_list(batch.column(2))], pa.int64())], names=["doc_id", "row", "fp"])

    return in_arrow(df.select(column(id_col).cast("long").alias("doc_id"), row_hash(df).alias("row"), column(text_col).alias("text")), run, "doc_id long, row long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for all pairs of bits, how many set both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(-1, BITS * BITS)), "n": pa.array(np.concatenate(([n], both.ravel())).astype(np.int64))})

    sums = {r["at"]: r["n"] for r in in_arrow(fps.select("fp"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}  # 4,097 rows
    return sums.get(-1, 0), np.array([sums.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, groups: int) -> list[list[int]]:
    """Bits in groups of about equal width, each grown by the bit that correlates most with it."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    correlation = np.abs(np.divide(both / max(1, n) - np.outer(p, p), spread, out=np.zeros_like(spread), where=spread > 0))
    left, out = list(range(BITS)), []
    for g in range(groups):
        own = [left.pop(0)]
        while len(own) < (BITS + g) // groups:
            own.append(left.pop(int(np.argmax([correlation[b, own].mean() for b in left]))))
        out.append(own)
    return out


def expected_pairs(n: int, p: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Estimated pairs that differ in at most t of the bits, for t = 0 ... most."""
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for b in bits:
        differ = 2 * p[b] * (1 - p[b])
        chance = chance * (1 - differ) + np.concatenate(([0], chance[:-1])) * differ
    return (np.cumsum(chance) * n * max(0, n - 1) / 2).tolist()


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 and up) that sum to ``total`` at the least cost;
    costs[i][t + 1] is that of group i at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, picked) in best.items():
            for t, more in enumerate(group, -1):
                if used + t not in then or cost + more < then[used + t][0]:
                    then[used + t] = (cost + more, [*picked, t])
        best = then
    return best.get(total, (math.inf, []))


def plan(n: int, both: np.ndarray, most: int) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds: the cheapest over numbers of groups."""
    p, best = np.diag(both) / max(1, n), (math.inf, [])
    for m in range(2, most + 2):
        groups = group_bits(n, both, m)
        costs = []
        for bits in groups:
            pairs = expected_pairs(n, p, bits, most)
            costs.append([0.0, *(n * sum(math.comb(len(bits), k) for k in range(t + 1)) * COST_KEY + pairs[t] * COST_PAIR for t in range(3))])
        cost, thresholds = allocate(costs, most + 1 - m)
        if cost < best[0]:
            best = (cost, list(zip(groups, thresholds)))
    return [(bits, t) for bits, t in best[1] if t >= 0]


def probe_keys(fp: np.ndarray, searches: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the row of each.  Where one bit may differ, only rows that have it 0 probe for 1: one of the two has."""
    keys, rows = [], []
    u, every = fp.view(np.uint64), np.arange(len(fp))
    for g, (bits, threshold) in enumerate(searches):
        key = np.full(len(fp), g + 1, np.int64) << 40
        for k, b in enumerate(bits):
            key |= ((u >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
        for weight in range(threshold + 1):
            for flip in combinations(range(len(bits)), weight):
                mask = sum(1 << k for k in flip)
                at = every[key >> flip[0] & 1 == 0] if threshold == weight == 1 else every
                keys.append(key[at] ^ mask)
                rows.append(at)
    return np.concatenate(keys), np.concatenate(rows)


def links(fps: DataFrame, most: int = 4, block: int = 1024) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) within ``most`` bits."""
    n, both = bit_statistics(fps)
    searches = plan(n, both, most)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 2000):
                part = np.ascontiguousarray(fp[at : at + 2000])
                key, row = probe_keys(part, searches)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key), "fp": pa.array(part[row])})

    def compare(c: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> pa.RecordBatch | None:
        fp = c["fp"].view(np.uint64)
        near = np.bitwise_count(fp[left][:, None] ^ fp[right][None, :]) <= most
        if left is right:
            np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        if not len(i):
            return None
        part, place = np.unique(np.concatenate([left[i], right[j]]), return_inverse=True)
        linked = np.zeros((len(part), len(part)), bool)
        linked[place[: len(i)], place[len(i) :]] = linked[place[len(i) :], place[: len(i)]] = True
        root = forest(linked)
        away = root != np.arange(len(part))
        return pa.RecordBatch.from_pydict({"a": pa.array(c["fp"][part[away]]), "b": pa.array(c["fp"][part[root[away]]])})

    keys = in_arrow(fps.select("fp"), emit, "key long, fp long")
    return map_cells(bucket_cells(cut(keys, "keys"), "key", "fp", block), "key", compare, "a long, b long")


def _members(df: DataFrame, id_col: str, text_col: str, shingle: int = 4, most: int = 4) -> DataFrame:
    found = cut(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct, most))
    members = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = members.groupBy("root").agg(F.min("first").alias("component_id"))
    return found.join(members.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row.

    A text without words, null included, has fingerprint zero and is linked
    like any other.  Equal fingerprints go through the search once.
    component_id is the smallest id reachable, null only where no member has
    an id.  Repeated rows repeat; an empty table gives no rows."""
    return _members(df, id_col, text_col, shingle, most).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with one document of each class, as ``linking.keep_rows`` picks it."""
    return keep_rows(df, _members(df, id_col, text_col, **options), id_col)
