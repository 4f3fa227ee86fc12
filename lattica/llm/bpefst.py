"""Byte-level BPE as a lazily determinised transducer (operator 9).

Merging by rank is equivalent to a local rule: a sequence of tokens is the
encoding of its bytes exactly if each token encodes to itself and no merge
ever crosses the border of two neighbours.  That makes BPE a regular
relation.  The nondeterministic transducer guesses token borders; its
hypotheses are (tokens not yet emitted, bytes of the token being read).  States
of the deterministic one are sets of hypotheses, built when first reached.
A step emits the tokens that all hypotheses agree on, which happens at the
latest when the longest possible token has passed: bounded lookahead.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.batches import BatchEncoder, Known, by_matches
from lattica.llm.common import column, in_arrow, kept
from lattica.llm.pieces import Memory, PieceEncoder


def load_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}


class Merges:
    """What the merges say about single tokens and pairs of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self._right: dict[bytes, list[bytes]] = {}
        self._left: dict[bytes, list[bytes]] = {}

    def parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes ``token``; None for a single byte.

        Raises LookupError for a token that merging never makes."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                raise LookupError(token)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def edge(self, token: bytes, right: bool) -> list[bytes]:
        """The pieces that touch the token's right or left border while it is merged, smallest first."""
        memo = self._right if right else self._left
        if token not in memo:
            two = self.parts(token)
            memo[token] = [*(self.edge(two[right], right) if two else ()), token]
        return memo[token]

    def stays(self, left: bytes, right: bytes) -> bool:
        """Whether merging ``left + right`` never crosses the border between the two."""
        a, b = self.edge(left, True), self.edge(right, False)
        rank, i, j, never = self.ranks, 0, 0, 1 << 60
        while True:
            grow_a = rank[a[i + 1]] if i + 1 < len(a) else never
            grow_b = rank[b[j + 1]] if j + 1 < len(b) else never
            cross = rank.get(a[i] + b[j], never)
            # Of equal ranks the merge further left comes first.
            if cross < grow_a and cross <= grow_b and cross < never:
                return False
            if grow_a == grow_b == never:
                return True
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1


class Transducer:
    """Bytes in, token ids out (as little-endian unsigned 32-bit integers).

    A state is (last token emitted, hypotheses); a hypothesis is (tokens not
    yet emitted, trie node of the token being read).  At most ``limit``
    states are kept; once there are as many, further ones are worked out each
    time they are reached, so memory stays bounded and frequent ones, which
    come early, stay."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 300_000):
        self.merges, self.limit, self.pairs_limit = Merges(ranks), limit, max(10_000, limit * 5 // 3)
        self.tokens = {t: r for t, r in ranks.items() if self._made(t)}
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.packed = {r: array("I", (r,)).tobytes() for r in ranks.values()}
        # A trie of the tokens: child node by node * 256 + byte, the token that ends at a node, and whether it goes on.
        self.child: dict[int, int] = {}
        self.token_at, self.goes_on = [-1], [True]
        for token, rank in self.tokens.items():
            node = 0
            for byte in token:
                self.goes_on[node] = True
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.goes_on.append(False)
                node = self.child[key]
            self.token_at[node] = rank
        self.below: list[list[int]] = [[] for _ in self.token_at]  # tokens that extend a node, where they are few
        for token, rank in self.tokens.items():
            node = 0
            for byte in token[:-1]:
                node = self.child[node << 8 | byte]
                if len(self.below[node]) <= self.FEW:
                    self.below[node].append(rank)
        self._alive: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        self.states: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.steps: dict[int, tuple[int, bytes]] = {}
        self.ends: dict[int, bytes] = {}  # what a byte at the end of the text still emits
        self._state((-1, (((), 0),)))

    def _made(self, token: bytes) -> bool:
        try:
            two = self.merges.parts(token)
            return two is None or all(x in self.merges.ranks for x in two)
        except LookupError:
            return False

    def _state(self, state: tuple) -> int:
        """The state's number, or -1 if it is new and there is no room."""
        found = self.index.get(state)
        if found is None:
            if len(self.states) >= self.limit:
                return -1
            found = self.index[state] = len(self.states)
            self.states.append(state)
        return found

    def _fits(self, last: int, token: int) -> bool:
        key = last << 20 | token
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > self.pairs_limit:
                self._pairs.clear()
            found = self._pairs[key] = self.merges.stays(self.bytes_of[last], self.bytes_of[token])
        return found

    #: Nodes that more tokens extend count as open without a look at each.
    FEW = 4

    def _open(self, before: int, node: int) -> bool:
        """Whether some longer token from ``node`` can follow the token ``before``: hypotheses
        without a future are dropped, so that others are decided sooner and fewer states differ."""
        key = before << 20 | node
        found = self._alive.get(key)
        if found is None:
            if len(self._alive) > self.pairs_limit:
                self._alive.clear()
            few = self.below[node]
            found = self._alive[key] = len(few) > self.FEW or any(self._fits(before, t) for t in few)
        return found

    def _step(self, state: tuple, byte: int) -> tuple[tuple, bytes]:
        """The state after one more byte, and the ids that all hypotheses agree on."""
        last, hypotheses = state
        child, token_at, goes_on, pairs, alive = self.child, self.token_at, self.goes_on, self._pairs, self._alive
        out, closed = [], None
        for tokens, node in hypotheses:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            token = token_at[node]
            if closed is None and token >= 0:  # the encoding of what was read so far is unique
                before = tokens[-1] if tokens else last
                if before < 0 or pairs.get(before << 20 | token) or self._fits(before, token):
                    closed = (*tokens, token)
            if goes_on[node]:
                before = tokens[-1] if tokens else last
                if before < 0 or alive.get(before << 20 | node) or self._open(before, node):
                    out.append((tokens, node))
        out.append((closed, 0))
        first, agreed = out[0][0], 0
        if not first:
            return (last, tuple(out)), b""
        for token in first:
            if any([len(t) <= agreed or t[agreed] != token for t, _ in out]):
                break
            agreed += 1
        if not agreed:
            return (last, tuple(out)), b""
        return (first[agreed - 1], tuple([(t[agreed:], n) for t, n in out])), b"".join([self.packed[t] for t in first[:agreed]])

    def _end(self, state: tuple, byte: int) -> bytes:
        """The ids not yet emitted if the text ends with ``byte``, where a token must end."""
        last, hypotheses = state
        child, token_at, packed = self.child, self.token_at, self.packed
        for tokens, node in hypotheses:
            node = child.get(node << 8 | byte)
            if node is not None and (token := token_at[node]) >= 0:
                before = tokens[-1] if tokens else last
                if before < 0 or self._pairs.get(before << 20 | token) or self._fits(before, token):
                    return b"".join([packed[t] for t in tokens]) + packed[token] if tokens else packed[token]
        raise LookupError(byte)

    def run(self, data: bytes) -> bytes:
        """The ids of one match of the pattern."""
        emitted, at, steps, index, state = [], 0, self.steps, self.index, (-1, (((), 0),))
        for byte in data[:-1]:
            if at >= 0:
                found = steps.get(at << 8 | byte)
                if found is not None:
                    at, ids = found
                else:
                    state, ids = self._step(self.states[at], byte)
                    then = self._state(state)
                    if then >= 0:
                        steps[at << 8 | byte] = (then, ids)
                    at = then
            else:
                state, ids = self._step(state, byte)
                at = index.get(state, -1)  # back among the kept states, if it is one
            if ids:
                emitted.append(ids)
        if not data:
            return b""
        # After the last byte nothing is open, so no state is made.
        rest = self.ends.get(at << 8 | data[-1]) if at >= 0 else None
        if rest is None:
            rest = self._end(self.states[at] if at >= 0 else state, data[-1])
            if at >= 0 and len(self.ends) < self.limit:
                self.ends[at << 8 | data[-1]] = rest
        emitted.append(rest)
        return b"".join(emitted)


def utf8_whole(data: bytes) -> int:
    """Bytes of ``data`` that end with a whole character: the state machine
    over the last lead byte and its continuation bytes."""
    n = len(data)
    for back in range(1, min(4, n) + 1):
        byte = data[n - back]
        if byte & 0xC0 == 0x80:
            continue
        need = 1 if byte < 0x80 else 2 if byte >> 5 == 6 else 3 if byte >> 4 == 14 else 4 if byte >> 3 == 30 else 1
        return n if need <= back else n - back
    return n


class StreamDecoder:
    """Decodes ids piece by piece; a character whose bytes are not all there yet waits."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of, self.waiting = bytes_of, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.waiting + b"".join(map(self.bytes_of.__getitem__, ids))
        whole = utf8_whole(data)
        self.waiting = data[whole:]
        return data[:whole].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Encodes and decodes whole texts by a rank file and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: float = 1.0):
        """``memory`` scales all tables; at 1 they take up to about 500 MB."""
        import regex

        self.split = regex.compile(pattern).findall
        self.transducer = Transducer(ranks, int(200_000 * memory))
        self.known = Memory(int(200_000 * memory))
        self.pieces = PieceEncoder(lambda texts: [b"".join(map(self.match, self.split(t))) for t in texts], limit=int(300_000 * memory))
        self.batches = BatchEncoder(lambda texts: [np.frombuffer(b"".join(map(self.match, self.split(t))), "<u4") for t in texts], self._learn, limit=int(500_000 * memory))
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def match(self, text: str) -> bytes:
        """The ids of one match of the pattern, from a bounded memory or the transducer."""
        ids = self.known.young.get(text)
        if ids is None:
            ids = self.known.get(text)
        if ids is None:
            ids = self.transducer.run(text.encode())
            if len(text) <= 32:
                self.known.put(text, ids)
        return ids

    def _runs(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of different matches, and how many each has."""
        ids = [self.transducer.run(m.encode()) for m in matches]
        return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4

    def _learn(self, texts: list[str], known: Known) -> np.ndarray:
        """Adds pieces to the memory; white space at the end of one could go on in the next if the two were joined."""
        joined = [k for k, t in enumerate(texts) if not t[-1].isspace()]
        ended = [k for k, t in enumerate(texts) if t[-1].isspace()]
        some = [texts[k] for k in joined + ended]
        matches = self.split("".join(some[: len(joined)]))
        for text in some[len(joined) :]:
            matches += self.split(text)
        places = np.zeros(len(texts), np.int64)
        places[joined + ended] = by_matches(known, some, matches, self._runs)
        return places

    def encode(self, text: str) -> bytes:
        return self.pieces.encode(text)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each of many texts, null ones as empty."""
        return self.batches.encode_all(texts, step=2_000_000)

    def decode(self, ids: bytes, step: int = 65_536) -> Iterator[str]:
        """Texts that join to the decoded text, from ``step`` ids at a time."""
        numbers, decoder = array("I"), StreamDecoder(self.bytes_of)
        numbers.frombytes(ids)
        for at in range(0, len(numbers), step):
            yield decoder.feed(numbers[at : at + step])
        yield decoder.close()


def encode_decode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", memory: float = 1.0) -> DataFrame:
    """Encode every whole text and decode its ids: doc_id, n_tokens,
    ids_sha256 (ids as little-endian unsigned 32-bit integers) and
    decoded_sha256 (the decoded bytes).

    Null texts count as empty, which have no ids.  Rows that repeat give
    rows that repeat; ids may be null; an empty table gives no rows.  No
    shuffle: memory is bounded by the codec's tables, which ``memory`` scales
    and which a worker process keeps, with the states it has built, from task
    to task until another operator's task starts there, and one batch."""
    key = ("codec", ranks, pattern, memory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(key, lambda: Codec(load_ranks(ranks), pattern, memory))
        for batch in batches:
            counts, hashed, decoded = [], [], []
            for ids in codec.encode_all(t.as_py() for t in batch.column(1)):
                counts.append(len(ids) // 4)
                hashed.append(hashlib.sha256(ids).hexdigest())
                digest = hashlib.sha256()
                for part in codec.decode(ids):
                    digest.update(part.encode())
                decoded.append(digest.hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(hashed, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})

    return in_arrow(df.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", key)
