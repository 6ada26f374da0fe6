"""What a worker remembers of words and their ids, in a few flat arrays.

A dict of small objects takes some 200 bytes a word; here a word takes its own
bytes, its ids and about 16 bytes more, so a worker can remember many more in less memory.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def spans(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all elements of the spans, one span after the other, and where each span's elements begin (and the last end)."""
    total = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(begin - total[:-1], size) + np.arange(total[-1]), total


class Memo:
    """Ids of words by ``encode`` (word -> packed 32-bit ids); at most ``most`` words of at most ``longest`` bytes are kept."""

    def __init__(self, encode: Callable[[bytes], bytes], most: int, longest: int):
        self.encode, self.most, self.longest = encode, most, longest
        self.keys = pa.array([], pa.binary())
        self.flat, self.size, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def look(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after the other, and how many each has."""
        at = pc.fill_null(pc.index_in(words, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        self.used[at[at >= 0]] = True
        at[new] = len(self.keys) + np.arange(len(new))
        if len(new):
            fresh = words.take(pa.array(new))
            packed = [self.encode(w) for w in fresh.to_pylist()]
            self.keys = pa.concat_arrays([self.keys, fresh])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(packed), np.int32)])
            self.size = np.concatenate([self.size, np.fromiter(map(len, packed), np.int64, len(packed)) // 4])
            self.used = np.concatenate([self.used, np.ones(len(new), bool)])
        size = self.size[at]
        ids = self.flat[spans((np.cumsum(self.size) - self.size)[at], size)[0]]
        if len(new):
            self._trim()
        return ids, size

    def _trim(self) -> None:
        """Drops long words, and where the rest is too many those not asked for since the last time, then the oldest."""
        keep = pc.binary_length(self.keys).to_numpy(zero_copy_only=False) <= self.longest
        if keep.sum() > self.most:
            keep &= self.used
            self.used[:] = False
            if keep.sum() > self.most:
                places = np.flatnonzero(keep)
                keep[places[: len(places) - self.most // 2]] = False
        if not keep.all():
            places = np.flatnonzero(keep)
            self.flat = self.flat[spans((np.cumsum(self.size) - self.size)[places], self.size[places])[0]]
            self.keys, self.size, self.used = self.keys.take(pa.array(places)), self.size[places], self.used[places]
