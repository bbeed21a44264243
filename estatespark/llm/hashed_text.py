"""Hashed features of texts, computed on whole arrays of bytes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def gram_codes(letters: np.ndarray, sizes: Sequence[int], bits: int) -> np.ndarray:
    """A code below 2**bits for every run of `sizes` neighbouring bytes, repeats included."""
    wide, found = letters.astype(np.uint64), []
    rolled = np.zeros(len(wide), np.uint64)
    for size in range(1, max(sizes) + 1):
        last = len(wide) - size + 1
        if last <= 0:
            break
        # Codes of the runs one shorter, one byte further along each.
        rolled = (rolled[:last] << np.uint64(8)) + wide[size - 1 : size - 1 + last]
        if size in sizes:
            found.append(((rolled + np.uint64(size << 56)) * MULTIPLIER) >> np.uint64(64 - bits))
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


class Distinct:
    """Distinct codes of an array without sorting it: each code keeps its last place in a table."""

    def __init__(self, bits: int):
        self.place = np.zeros(1 << bits, np.int32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        order = np.arange(len(codes), dtype=np.int32)
        self.place[codes] = order
        return codes[self.place[codes] == order]


def slices(length: int, most: int, overlap: int):
    """Ranges that cover `length` positions, each sharing `overlap` with the next, so that no run is lost at a border."""
    start = 0
    while start < length:
        yield start, min(length, start + most)
        if start + most >= length:
            return
        start += most - overlap
