"""Token ids as Re-Pair compressed shards (operator 1).

Documents are dealt to shards by ranges of their id, encoded with a public
tokenizer and stored in blocks.  Each block carries a grammar: the most
frequent pairs of neighbouring ids are replaced by new symbols, until no pair
is frequent, and the rules are kept with the number of ids that each symbol
expands to, so that one document, or one id inside a document, is read without
expanding the rest.  Blocks know their first and last document id, so one
document is found without reading all blocks.

Block format (little-endian), magic ``RPG2``:
  header      4 x u32 after the magic: documents, rules, symbols, terminals
              and u64: ids of all documents
  alphabet    terminals x u32, the ids that terminals stand for, the end last
  rules       rules x 2 x u32, the two symbols a rule stands for
  lengths     rules x u32, ids that the rule expands to
  doc ids     documents x i64, then documents x u8: 1 if the id is null
  offsets     (documents + 1) x u32, first symbol of each document
  symbols     u16 each if terminals + rules <= 65536, else u32
The terminal ``terminals - 1`` is the end of a document and reads back as the
end id.  No rule spans documents.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.batches import BatchEncoder, Known, by_matches
from lattica.llm.common import column, in_arrow, kept, new_path, partitions

MAGIC = b"RPG2"
HEAD = struct.Struct("<4s4IQ")


def _apart(hits: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the places ``hits``, in order, are replaced: no two neighbours,
    and of two neighbours the pair with the lower rank."""
    near = np.diff(hits) == 1
    chosen = np.zeros(len(hits), bool)
    # Neighbours of one rank are a run of one symbol: every other pair of it.
    again = np.flatnonzero(near & (rank[1:] == rank[:-1])) + 1
    out = np.zeros(len(hits), bool)
    if len(again):
        start = np.flatnonzero(np.concatenate(([True], np.diff(again) != 1)))
        out[again[(np.arange(len(again)) - np.repeat(start, np.diff(np.append(start, len(again))))) % 2 == 0]] = True
    alone = ~(np.concatenate(([False], near)) | np.append(near, False))
    chosen[alone] = True
    left = np.flatnonzero(~(alone | out))
    for turn in range(6):
        if not len(left):
            break
        near = np.diff(hits[left]) == 1
        before, after = np.concatenate(([False], near)), np.append(near, False)
        r = rank[left]
        if turn < 5:
            lower = r[1:] < r[:-1]
            win = ~(before & np.concatenate(([False], ~lower))) & ~(after & np.append(lower, False))
        else:  # what long chains leave: every other place
            start = np.flatnonzero(~before)
            win = (np.arange(len(left)) - np.repeat(start, np.diff(np.append(start, len(left))))) % 2 == 0
        chosen[left[win]] = True
        gone = win.copy()
        gone[1:] |= win[:-1] & near
        gone[:-1] |= win[1:] & near
        left = left[~gone]
    return chosen


def _grouped(left: np.ndarray, right: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pairs, equal ones together, and where each different one starts."""
    if base <= 1 << 16:  # pair and place as one number, which sorts fast
        both = (((left << np.uint32(16)) | right).astype(np.uint64) << np.uint64(32)) | np.arange(len(left), dtype=np.uint64)
        both.sort()
        pairs, order = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)
    else:
        pairs = (left.astype(np.uint64) << np.uint64(32)) | right
        order = np.argsort(pairs)
        pairs = pairs[order]
    new = np.flatnonzero(pairs[1:] != pairs[:-1])
    return order, np.concatenate(([0], new + 1)) if len(pairs) else np.zeros(0, np.int64)


def compress(symbols: np.ndarray, terminals: int, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair: the rules (n x 2) and the remaining symbols.

    Each round names all pairs that it can replace ``least`` times; where they
    overlap, the more frequent one is replaced.  Later rounds look only at
    pairs with a symbol of the round before, since no others have become more
    frequent, so their cost grows with what was replaced.  Rounds end when no
    pair is left to name.  Pairs with the end symbol ``terminals - 1`` never are."""
    end, seq, rules, base = terminals - 1, symbols.astype(np.uint32), [], terminals
    at = None  # all places
    while len(seq) > 1:
        left, right = seq[:-1], seq[1:]
        if at is not None:
            left, right = left[at], right[at]
        order, starts = _grouped(left, right, base)
        counts = np.diff(np.append(starts, len(order)))
        many = np.flatnonzero(counts >= least)
        first = order[starts[many]]
        open_ = (left[first] != end) & (right[first] != end)
        many, first = many[open_], first[open_]
        if not len(many):
            break
        by_count = np.lexsort((right[first], left[first], -counts[many]))
        many, first = many[by_count], first[by_count]
        size = counts[many]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        hits = order[np.repeat(starts[many], size) + inside]
        found = np.full(len(seq), -1, np.int32)
        found[hits if at is None else at[hits]] = np.repeat(np.arange(len(many), dtype=np.int32), size)
        hits = np.flatnonzero(found >= 0)
        of = found[hits]
        chosen = np.flatnonzero(_apart(hits, of))
        hits, of = hits[chosen], of[chosen]
        used = np.bincount(of, minlength=len(many)) >= least
        if not used.any():
            break
        if not used.all():
            stay = used[of]
            hits, of = hits[stay], of[stay]
        number = np.cumsum(used) - 1
        rules.append(np.stack([left[first[used]], right[first[used]]], axis=1))
        seq[hits] = (base + number).astype(np.uint32)[of]
        keep = np.ones(len(seq), bool)
        keep[hits + 1] = False
        seq = seq[keep]
        base += int(used.sum())
        # The new symbols' places, and the pairs that they are the right or left half of.
        new = hits - np.arange(len(hits))
        at = np.stack([new - 1, new], axis=1).ravel()
        at = at[np.append(at[1:] != at[:-1], True) & (at >= 0) & (at < len(seq) - 1)]
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), seq


def pack(doc_ids: list[int | None], ids: list[bytes], vocabulary: int, **limits) -> bytes:
    """One block of whole documents; ``ids`` are without the end id."""
    end = np.array([vocabulary], "<u4").tobytes()
    symbols = np.frombuffer(end.join([*ids, b""]), "<u4")
    alphabet = np.flatnonzero(np.bincount(symbols, minlength=vocabulary + 1))
    own = np.zeros(vocabulary + 1, np.uint32)
    own[alphabet] = np.arange(len(alphabet))
    terminals = len(alphabet)
    rules, seq = compress(own[symbols], terminals, **limits)
    lengths = _lengths(rules, terminals)
    ends = np.flatnonzero(seq == terminals - 1) + 1
    small = terminals + len(rules) <= 1 << 16
    return b"".join([
        HEAD.pack(MAGIC, len(doc_ids), len(rules), len(seq), terminals, len(symbols)),
        alphabet.astype("<u4").tobytes(),
        rules.astype("<u4").tobytes(),
        lengths[terminals:].astype("<u4").tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], "u1").tobytes(),
        np.concatenate(([0], ends)).astype("<u4").tobytes(),
        seq.astype("<u2" if small else "<u4").tobytes(),
    ])


def _stretches(rules: np.ndarray, terminals: int) -> Iterator[tuple[int, int]]:
    """Stretches of rules that only name symbols before the stretch, one after another."""
    at = 0
    while at < len(rules):
        later = np.flatnonzero((rules[at:] >= terminals + at).any(axis=1))
        stop = at + max(1, int(later[0]) if len(later) else len(rules) - at)
        yield at, stop
        at = stop


def _lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each symbol expands to; a rule only names symbols before it."""
    lengths = np.ones(terminals + len(rules), np.int64)
    for at, stop in _stretches(rules, terminals):
        lengths[terminals + at : terminals + stop] = lengths[rules[at:stop, 0]] + lengths[rules[at:stop, 1]]
    return lengths


def _places(symbols: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the expansions of ``symbols`` stand, one after another, in the flat list of all expansions."""
    n = lengths[symbols]
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n - starts[symbols], n)


@dataclass
class Block:
    """A block that was read; see the format above."""

    doc_ids: list[int | None]
    alphabet: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    offsets: np.ndarray
    symbols: np.ndarray

    @classmethod
    def read(cls, data: bytes, end_id: int) -> "Block":
        magic, docs, n_rules, n_symbols, terminals, _ = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a Re-Pair block")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        alphabet = take("<u4", terminals).copy()
        alphabet[-1:] = end_id
        rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        lengths = np.concatenate([np.ones(terminals, np.int64), take("<u4", n_rules).astype(np.int64)])
        ids, nulls = take("<i8", docs), take("u1", docs)
        offsets = take("<u4", docs + 1)
        symbols = take("<u2" if terminals + n_rules <= 1 << 16 else "<u4", n_symbols)
        return cls([None if n else int(x) for x, n in zip(ids, nulls)], alphabet, rules, lengths, offsets, symbols)

    def expand(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the first id of each document (and the end)."""
        terminals = len(self.alphabet)
        starts = np.concatenate(([0], np.cumsum(self.lengths)))
        flat = np.zeros(int(starts[-1]), np.uint32)  # the expansions of all symbols, end to end
        flat[:terminals] = self.alphabet
        for at, stop in _stretches(self.rules, terminals):
            flat[starts[terminals + at] : starts[terminals + stop]] = flat[_places(self.rules[at:stop].ravel(), self.lengths, starts)]
        bounds = np.concatenate(([0], np.cumsum(self.lengths[self.symbols])))[self.offsets]
        return flat[_places(self.symbols, self.lengths, starts)], bounds

    def document(self, k: int) -> list[int]:
        """The ids of document ``k``, its end id included, without expanding others."""
        terminals, out, stack = len(self.alphabet), [], self.symbols[self.offsets[k] : self.offsets[k + 1]].tolist()[::-1]
        while stack:
            x = stack.pop()
            if x < terminals:
                out.append(int(self.alphabet[x]))
            else:
                left, right = self.rules[x - terminals].tolist()
                stack += (right, left)
        return out

    def token(self, k: int, i: int) -> int:
        """Id ``i`` of document ``k``: skip by expansion lengths, then descend one rule at a time."""
        terminals, symbols = len(self.alphabet), self.symbols[self.offsets[k] : self.offsets[k + 1]]
        ends = np.cumsum(self.lengths[symbols])
        if not 0 <= i < (int(ends[-1]) if len(ends) else 0):
            raise IndexError(i)
        at = int(np.searchsorted(ends, i, side="right"))
        x, i = int(symbols[at]), i - (int(ends[at - 1]) if at else 0)
        while x >= terminals:
            left, right = self.rules[x - terminals].tolist()
            n = int(self.lengths[left])
            x, i = (left, i) if i < n else (right, i - n)
        return int(self.alphabet[x])


# Fixed values of byte-level vocabularies: the character that each byte is written as, and the pattern of matches.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
MATCHES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+", re.ASCII).findall
#: Pieces of ASCII and Latin letters, on which ``MATCHES`` is the pattern whatever the version of Unicode.
PLAIN = re.compile(rf"[\x00-\x7f{_LETTER}]*").fullmatch
#: Blanks and letters, which are one match each if a blank only stands in front.
LETTERS = re.compile(rf"[ {_LETTER}]*").fullmatch
#: Stands between matches; no byte is written so.
BORDER = "\uffff"
# The character that each byte is written as, by number; 255, which UTF-8 never has, is the border.
_WRITTEN_AS = np.array([ord(BYTES[b]) for b in range(255)] + [ord(BORDER)], "<u4")


def _written(matches: list[str]) -> tuple[str, np.ndarray]:
    """The bytes of the matches as characters, borders between them, and each match's number of bytes."""
    data = BORDER.join(matches).encode().replace(BORDER.encode(), b"\xff")
    data = np.frombuffer(data, np.uint8)
    ends = np.append(np.flatnonzero(data == 255), len(data))
    return _WRITTEN_AS[data].tobytes().decode("utf-32-le"), np.diff(ends, prepend=-1) - 1


def _encoder(path: str) -> tuple[BatchEncoder, int]:
    """A worker process keeps its encoder, and the pieces it knows, from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    tokenizer, merger = Tokenizer.from_file(path), Tokenizer.from_file(path)
    merger.pre_tokenizer = CharDelimiterSplit(BORDER)  # for matches whose bytes are written as characters already
    merger.encode_special_tokens = True  # pieces with the string of an added token never get there
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    # Whole texts go through the library at once where an added token could reach across a blank.
    whole = any(" " in t.content or t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values())
    special = re.compile("|".join(map(re.escape, added.values())) or r"(?!)").search
    # Byte-level tokens are written one character for each byte; added tokens as they are.
    widths = np.array([len(added[i].encode()) if i in added else len(tokenizer.id_to_token(i) or "") for i in range(size)])

    def ids_of(encoding, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many of them each string of ``lengths`` bytes has: borders of strings are borders of tokens, found by counting bytes."""
        ids = np.array(encoding.ids, np.uint32)
        return ids, np.diff(np.searchsorted(np.cumsum(widths[ids]), np.cumsum(lengths)) + 1, prepend=0)

    def merged(matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text, lengths = _written(matches)
        return ids_of(merger.encode_batch_fast([text], add_special_tokens=False)[0], lengths)

    def alone(texts: list[str]) -> list[np.ndarray]:
        """The ids of each text by the library's whole way."""
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(texts: list[str], known: Known) -> np.ndarray:
        """Pieces of plain characters are split here and only merged by the library; others take its whole way."""
        words = [k for k, t in enumerate(texts) if t[1:].isalpha()]
        joined = "".join([texts[k] for k in words])
        if not LETTERS(joined) or special(joined):
            words = [k for k in words if LETTERS(texts[k]) and not special(texts[k])]
        kind = np.zeros(len(texts), np.uint8)
        kind[words] = 1
        plain, ended, rest = [], [], []
        for k in np.flatnonzero(kind == 0).tolist():
            text = texts[k]
            # White space at the end could go on in the next piece, if the two were joined.
            (ended if text[-1].isspace() else plain if PLAIN(text) and not special(text) else rest).append(k)
        places = np.zeros(len(texts), np.int64)
        if ended:
            some = [texts[k] for k in ended]
            ids = alone(some)
            places[ended] = known.add(some, np.concatenate(ids), np.array([len(x) for x in ids]))
        if rest:
            some = [texts[k] for k in rest]
            encoding = tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0]
            places[rest] = known.add(some, *ids_of(encoding, np.array([len(t.encode()) for t in some])))
        if words or plain:
            some = [texts[k] for k in plain]
            places[words + plain] = by_matches(known, some, MATCHES("".join(some)), merged, [texts[k] for k in words])
        return places

    if whole:
        class Whole:
            def encode_all(self, texts):
                return (array("I", tokenizer.encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts)

        return Whole(), size
    return BatchEncoder(alone, learn, limit=1_200_000), size


WRITTEN = "part int, block int, before long, n_ids long, n_docs int, first_id long, last_id long, content binary"


def _shards(docs: DataFrame, n: int) -> tuple[Column, int]:
    """The shard of each row of ``docs`` (id, place), in ascending order of both, and the number of shards.

    Bounds are quantiles of the ids; an id that is several quantiles, and rows
    without an id, have as many shards as their share, by ``place`` (0 to 1)."""
    probes = [k / n for k in range(1, n)] or [0.5]
    rows, ids, found = docs.select(F.count(F.lit(1)), F.count("id"), F.percentile_approx("id", probes, 10_000)).first()
    found = found or []
    bounds = sorted(set(found))
    nulls = max(1, -(-n * (rows - ids) // rows)) if rows > ids else 0
    inside = lambda k: F.least(F.floor(F.col("place") * k), F.lit(k - 1)).cast("int")
    at, before = nulls, []
    heavy = {}
    for b in bounds:
        before.append(at)  # rows between the bound before and this one
        at += 1
        if found.count(b) > 1:
            heavy[b] = (at, found.count(b))
            at += found.count(b)
    before.append(at)
    shard = F.lit(nulls)
    if bounds:
        shard = F.element_at(F.array(*map(F.lit, before)), F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("id"))) + 1)
        for b, (first, k) in heavy.items():
            shard = F.when(F.col("id") == b, inside(k) + first).otherwise(shard)
    return F.when(F.col("id").isNull(), inside(nulls) if nulls else F.lit(0)).otherwise(shard).cast("int"), at + 1


def write_shards(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1_000_000, **limits) -> None:
    """Encode and write all documents as Re-Pair blocks, in ascending order of id.

    The blocks are the binary rows of a Parquet table at ``path``, so any
    store that Spark reaches can hold them, and Spark's commit protocol
    leaves only the blocks of tasks that succeeded.  A block closes once it
    holds ``block_ids`` ids, so memory is bounded by that and one document.
    Null and empty texts have the end id only; null ids come first; rows of
    the same id stand together, in the order of a hash of their text, so
    reruns agree; an empty table writes no blocks."""
    spark = df.sparkSession
    text = F.coalesce(column(text_col), F.lit(""))
    docs = df.select(column(id_col).cast("long").alias("id"), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    docs = docs.withColumn("place", F.col("hash").cast("double") / F.lit(2.0**64) + F.lit(0.5))
    # Bounds from the ids alone: the texts are read and dealt once.
    shard, n = _shards(df.select(column(id_col).cast("long").alias("id")), partitions(spark))
    dealt = docs.repartitionById(n, shard).sortWithinPartitions("id", "hash", "text").select("id", "text")
    key = ("encoder", tokenizer)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, vocabulary = kept(key, lambda: _encoder(tokenizer))
        part, block, before, held, ids, count = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, before, held, ids, count
            content = pack(held, ids, vocabulary, **limits)
            known = [x for x in held if x is not None]
            ends = (known[0], known[-1]) if known else (None, None)
            columns = ([part], [block], [before], [count], [len(held)], [ends[0]], [ends[1]], [content])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in WRITTEN.split(", ")])
            block, before, held, ids, count = block + 1, before + count, [], [], 0
            return out

        for batch in batches:
            for doc, encoded in zip(batch.column(0).to_pylist(), encoder.encode_all(t.as_py() for t in batch.column(1))):
                ids.append(encoded)
                held.append(doc)
                count += len(ids[-1]) // 4 + 1
                if count >= block_ids:
                    yield close()
        if held:
            yield close()

    in_arrow(dealt, blocks, WRITTEN, key).write.option("compression", "none").parquet(path)


def read_shards(spark: SparkSession, path: str, end_id: int) -> DataFrame:
    """One row per document from the written blocks: doc_id, start (ids of all
    documents before it), n_tokens (its end id included), ids_crc32 (of its ids
    as little-endian unsigned 32-bit integers)."""
    written = spark.read.schema(WRITTEN).parquet(path)
    # One row per shard, so the offsets are as small as the list of partitions.
    sums = sorted((r["part"], r["n"]) for r in written.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    offsets, total = {}, 0
    for part, n in sums:
        offsets[part], total = total, total + n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                block = Block.read(content.as_py(), end_id)
                ids, bounds = block.expand()
                data = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(block.doc_ids, pa.int64()), "start": pa.array(bounds[:-1] + before + offsets[part]), "n_tokens": pa.array(np.diff(bounds)), "ids_crc32": pa.array(crcs, pa.int64())})

    return in_arrow(written.select("part", "before", "content"), documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, path: str, doc_id: int, end_id: int) -> list[list[int]]:
    """The ids (end id included) of each document with this id, in written
    order; only blocks whose range of ids holds it are read, and only its own
    symbols are expanded."""
    found = spark.read.schema(WRITTEN).parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    out = []
    for row in found.orderBy("part", "block").select("content").toLocalIterator():  # blocks of one id, one at a time
        block = Block.read(bytes(row["content"]), end_id)
        out += [block.document(k) for k, x in enumerate(block.doc_ids) if x == doc_id]
    return out


def encode_to_shards(df: DataFrame, tokenizer: str, end_id: int, path: str | None = None, **options) -> DataFrame:
    """Write the shards (to the shared folder unless ``path`` is given) and return what they hold."""
    path = path or new_path(df.sparkSession, "repair")
    write_shards(df, path, tokenizer, **options)
    return read_shards(df.sparkSession, path, end_id)
