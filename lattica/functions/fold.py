"""One-code-point case folding, as a translation table built from the running Python's Unicode data."""

from __future__ import annotations

import functools
import sys

#: Code points whose folding came after Unicode 15.0.
LATER: frozenset[int] = frozenset()


@functools.lru_cache(maxsize=1)
def table() -> tuple[str, str]:
    """Characters that fold to another, and what each folds to."""
    source, target = [], []
    for point in range(sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF or point in LATER:
            continue
        c = chr(point)
        folded = c.casefold()
        if len(folded) != 1:
            folded = c.lower() if len(c.lower()) == 1 else c
        if folded != c:
            source.append(c)
            target.append(folded)
    return "".join(source), "".join(target)


def fold(text: str) -> str:
    return text.translate(str.maketrans(*table()))
