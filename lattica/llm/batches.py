"""Pieces of many texts at once: made different in Arrow, looked up once, their ids gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lattica.llm.pieces import _CUT

# ``_AFTER_SPACE`` for Arrow, with Python's white space as fixed values.
_AFTER_ANY_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_BLANK, _NOTHING = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())


def _split_all(texts: list[str]) -> tuple[pa.ListArray, list[int]]:
    """The pieces of each text as ``split_pieces`` has them, and which text each list belongs to."""
    column = pa.array(texts, pa.large_string())
    odd = pc.match_substring_regex(column, _AFTER_ANY_SPACE)
    lists, rest = pc.split_pattern(column.filter(pc.invert(odd)), " "), np.flatnonzero(odd.to_numpy(False)).tolist()
    order = np.flatnonzero(~odd.to_numpy(False)).tolist() + rest
    if rest:
        lists = pa.concat_arrays([lists, pa.array([_CUT.split(texts[k]) for k in rest], lists.type)])
    return lists, order


class Known:
    """Strings and their ids, in numbered places.  ``trim`` bounds them: of
    more than ``limit`` the half that was asked for last stays, and none of
    more than ``longest`` bytes."""

    def __init__(self, limit: int, longest: int = 128):
        self.limit, self.longest, self.turn = limit, longest, 0
        self.strings = pa.array([], pa.large_string())
        self.ids, self.starts, self.lengths, self.asked = np.zeros(0, np.uint32), *(np.zeros(0, np.int64) for _ in range(3))

    def find(self, strings: pa.Array) -> np.ndarray:
        """The place of each of different strings, -1 if it has none."""
        # Arrow builds a table of the strings asked for: they are fewer than those known.
        asked = pc.fill_null(pc.index_in(self.strings, value_set=strings), -1).to_numpy()
        known = np.flatnonzero(asked >= 0)
        places = np.full(len(strings), -1, np.int64)
        places[asked[known]] = known
        self.asked[known] = self.turn
        return places

    def add(self, strings: list[str], ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The places of strings that had none; ``ids`` are those of all, one after another."""
        n = len(self.strings)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.strings = pa.concat_arrays([self.strings, pa.array(strings, pa.large_string())])
        self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        self.asked = np.append(self.asked, np.full(len(strings), self.turn))
        return np.arange(n, n + len(strings))

    def gather(self, places: np.ndarray) -> np.ndarray:
        """The ids of the strings at ``places``, one after another."""
        lengths = self.lengths[places]
        ends = np.cumsum(lengths)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[places] - ends + lengths, lengths)]

    def trim(self) -> None:
        stay = pc.binary_length(self.strings).to_numpy() <= self.longest
        if len(stay) > self.limit:
            late = np.zeros(len(stay), bool)
            late[np.argsort(self.asked, kind="stable")[-(self.limit // 2) or len(stay) :]] = True
            stay &= late
        if not stay.all():
            places = np.flatnonzero(stay)
            self.ids, self.lengths, self.asked = self.gather(places), self.lengths[places], self.asked[places]
            self.starts, self.strings = np.cumsum(self.lengths) - self.lengths, self.strings.take(pa.array(places))


def by_matches(known: Known, texts: list[str], matches: list[str], merge: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], words: Sequence[str] = ()) -> np.ndarray:
    """Adds ``words``, different texts of one match each, and ``texts``, whose
    ``matches`` stand one after another; returns the places of both.

    Matches that are not known go to ``merge``, which gives all their ids and each one's number of ids."""
    split = pa.array(matches, pa.large_string()).dictionary_encode()
    codes, found = split.indices.to_numpy(), known.find(split.dictionary)
    missing = np.flatnonzero(found < 0)
    wanted = split.dictionary.take(pa.array(missing)).to_pylist()
    strings = list(dict.fromkeys([*words, *wanted]))  # a match may be one of the words
    added = known.add(strings, *merge(strings)) if strings else missing
    if len(missing):
        number = dict(zip(strings, added.tolist()))
        found[missing] = [number[m] for m in wanted]
    if not texts:
        return added[: len(words)]
    each = found[codes]
    ends = np.cumsum([len(t) for t in texts])
    stops = np.searchsorted(np.cumsum(pc.utf8_length(split.dictionary).to_numpy()[codes]), ends) + 1
    n_matches = np.diff(stops, prepend=0)
    places = each[stops - 1]  # right for texts of one match
    several = np.flatnonzero(n_matches > 1)
    if len(several):
        lengths = np.diff(np.cumsum(known.lengths[each])[stops - 1], prepend=0)
        ids = known.gather(each[np.repeat(n_matches > 1, n_matches)])
        places[several] = known.add([texts[k] for k in several.tolist()], ids, lengths[several])
    return np.concatenate([added[: len(words)], places])


class BatchEncoder:
    """Encodes texts through a bounded memory of pieces.

    ``alone`` maps strings to their ids, one array each.  ``learn`` adds
    pieces, each with the blank before it, to the memory and returns their
    places.  Memory is that of at most ``limit`` pieces and of one step of texts."""

    def __init__(self, alone: Callable[[list[str]], list[np.ndarray]], learn: Callable[[list[str], Known], np.ndarray], limit: int):
        self.alone, self.learn, self.known = alone, learn, Known(limit)

    def encode_all(self, texts: Iterable[str | None], step: int = 8_000_000) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, null ones as empty;
        texts of ``step`` characters, or one longer text, are encoded together."""
        some, size = [], 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1]) + 100
            if size >= step:
                yield from self._step(some)
                some, size = [], 0
        if some:
            yield from self._step(some)

    def _step(self, texts: list[str], stretch: int = 1 << 18) -> list[bytes]:
        """The ids of each text: different pieces are looked up once, and their ids put in all their places."""
        known = self.known
        known.turn += 1
        lists, order = _split_all(texts)
        starts, flat = lists.offsets.to_numpy(), lists.flatten()
        later = np.ones(len(flat), bool)
        later[starts[:-1]] = False
        firsts = iter(self.alone([first for first in flat.take(pa.array(starts[:-1])).to_pylist() if first]))
        coded = flat.filter(pa.array(later)).dictionary_encode()
        pieces = pc.binary_join_element_wise(_BLANK, coded.dictionary, _NOTHING)
        places = known.find(pieces)
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = self.learn(pieces.take(pa.array(new)).to_pylist(), known)
        places = places[coded.indices.to_numpy()]
        n_before = np.concatenate(([0], np.cumsum(known.lengths[places])))
        out = [known.gather(places[k : k + stretch]) for k in range(0, len(places), stretch)]
        known.trim()
        data = memoryview(np.concatenate(out) if out else np.zeros(0, np.uint32)).cast("B")
        bounds = (4 * n_before[starts - np.arange(len(starts))]).tolist()
        results = [b""] * len(texts)
        begins = pc.binary_length(flat).to_numpy()[starts[:-1]] > 0
        for k, first, a, b in zip(order, begins.tolist(), bounds, bounds[1:]):
            results[k] = b"".join((next(firsts), data[a:b])) if first else bytes(data[a:b])
        return results
