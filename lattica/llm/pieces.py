"""Byte-level BPE by pieces: split a text where no token can cross, and remember the ids of pieces.

The pattern that precedes byte-level merges lets white space stand only at
the start of a match.  A boundary therefore lies before every blank that
follows a non-blank character, and the stretches between such boundaries
encode independently.  Words repeat, so a bounded memory of piece -> ids
saves most of the work without changing any result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<!\s) ")


def split_pieces(text: str) -> list[str]:
    """Pieces whose encodings join to that of ``text``.

    The first stands as it is; each of the others lost one leading blank.
    Python's white space contains that of the pattern, so a cut is only
    missed, never made, where the two disagree."""
    return _CUT.split(text) if _AFTER_SPACE.search(text) else text.split(" ")


class Memory:
    """A bounded memory in two generations: when the young one is full it
    becomes the old one, and what is asked for again moves back up."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        found = self.old.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def update(self, found: dict) -> None:
        """Puts many at once; what goes beyond ``limit`` is not kept."""
        if len(self.young) + len(found) > self.limit:
            self.old, self.young = self.young, {}
        self.young.update(found if len(found) <= self.limit else islice(found.items(), self.limit))


class PieceEncoder:
    """Encodes texts through a memory of at most twice ``limit`` pieces.

    ``encode_many`` maps a list of strings, which join to a text that may be
    cut where they meet, to their ids as little-endian unsigned 32-bit
    integers in bytes.  Pieces longer than ``longest`` characters are encoded
    anew each time, so memory stays bounded.  A full stop or comma after
    letters is a match of its own, so such pieces are put together from two."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = 200_000, longest: int = 64):
        self.encode_many, self.longest = encode_many, longest
        self.memory = Memory(limit)
        self.marks: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None], step: int = 64) -> Iterator[bytes]:
        """The ids of each text, null ones as empty; pieces that ``step`` texts lack are encoded together."""
        texts = iter(texts)
        while some := [split_pieces(t or "") for t in islice(texts, step)]:
            firsts = [pieces.pop(0) for pieces in some]
            known = self.memory.young.get
            found = [list(map(known, pieces)) for pieces in some]
            fresh = self._fresh(list({p for pieces, ids in zip(some, found) for p, i in zip(pieces, ids) if i is None}))
            for first, pieces, ids in zip(firsts, some, found):
                rest = b"".join([i or fresh[p] for p, i in zip(pieces, ids)])
                yield self.encode_many([first])[0] + rest if first else rest

    def _fresh(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces that the young memory lacks."""
        memory, longest, out, missing, marked = self.memory, self.longest, {}, {}, []
        young, old = memory.young, memory.old
        for p in pieces:
            found = old.get(p)
            if found is not None:
                out[p] = found
            elif p[-1:] in (".", ",") and p[:-1].isalpha():
                marked.append(p)
                word = p[:-1]
                found = young.get(word) or old.get(word)
                if found is None:
                    missing[word] = None
                else:
                    out[word] = found
            else:
                missing[p] = None
        if missing:
            out.update(zip(missing, self.encode_many([" " + p for p in missing])))
        for p in marked:
            mark = p[-1]
            if mark not in self.marks:
                self.marks[mark] = self.encode_many([mark])[0]
            out[p] = out[p[:-1]] + self.marks[mark]
        memory.update({p: ids for p, ids in out.items() if len(p) <= longest})
        return out
