"""Banded alignment: the edit distance of two word sequences, as far as it stays within a bound."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np


def within(a: Sequence, b: Sequence, most: int) -> bool:
    """Whether at most `most` insertions, deletions and substitutions turn a into b.

    Equal ends are cut off, sequences whose elements differ too often as bags are refused, and what remains is aligned
    inside the band of diagonals that `most` edits can reach, the column's cells held as the bits of an integer.
    """
    if len(a) > len(b):
        a, b = b, a
    lo, top = 0, len(a)
    while lo < top and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < top - lo and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    if len(b) - len(a) > most:
        return False
    if not a or not most:
        return len(b) <= most
    left = Counter(b)
    left.subtract(a)
    if max(sum(v for v in left.values() if v > 0), -sum(v for v in left.values() if v < 0)) > most:
        return False
    return _band(b, a, most)


def alike(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """within() of two arrays, whose equal ends are cut off first."""
    short = min(len(a), len(b))
    same = a[:short] == b[:short]
    lo = short if same.all() else int(same.argmin())
    same = a[len(a) - short + lo :][::-1] == b[len(b) - short + lo :][::-1]
    end = short - lo if same.all() else int(same.argmin())
    return within(a[lo : len(a) - end].tolist(), b[lo : len(b) - end].tolist(), most)


def _band(rows: Sequence, columns: Sequence, most: int) -> bool:
    """rows is at least as long as columns, by `most` at most. Bit i of a column's integers is row j - most + i."""
    size = 2 * most + 1
    ones = (1 << size) - 1
    # place[w]: the rows that hold w, shifted so that the band's window starts at bit 0 for column 0
    place: dict = {}
    for i, w in enumerate(rows):
        place[w] = place.get(w, 0) | (1 << (i + most))
    # cells right of row 0 in the first band: vertical differences of +1 at rows above 0
    vp, vn = ones ^ ((1 << most) - 1), 0
    distance = most  # of the band's last row in column 0
    for j, w in enumerate(columns):
        eq = (place.get(w, 0) >> j) & ones
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & ones
        hp = vn | (ones & ~(d0 | vp))
        hn = d0 & vp
        if j < len(rows) - most:  # the band's last row moves down a diagonal
            if not d0 >> (size - 1) & 1:
                distance += 1
        else:  # the last row is the text's last; its bit moves towards bit 0
            bit = size - 2 - (j - (len(rows) - most))
            if hp >> bit & 1:
                distance += 1
            elif hn >> bit & 1:
                distance -= 1
        vp = (hn | (ones & ~((d0 >> 1) | hp))) & ones
        vn = (d0 >> 1) & hp
    return distance <= most


def similarity_bound(n: int, m: int, similarity: float) -> int:
    """The most edits at which 1 - edits / max(n, m) is still `similarity`."""
    return int((1 - similarity) * max(n, m) + 1e-9)
