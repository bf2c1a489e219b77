"""Words, word hashes and n-gram hashes of Arrow string columns, as NumPy arrays.

A word is a run of bytes other than U+0020 and U+0009 to U+000D. All of those are
single bytes in UTF-8, so words are found on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_CYCLE = 4096  # positions in a word before the powers repeat
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, in place on a uint64 array."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    of_byte = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
    base = int(rng.integers(0, 1 << 63)) * 2 + 1
    powers = [1]
    for _ in range(_CYCLE - 1):
        powers.append(powers[-1] * base & _MASK)
    return of_byte, np.array(powers, dtype=np.uint64)


_TABLES = [_tables(11), _tables(12)]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its values; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    buffers = texts.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if buffers[2] is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each, or of a single row."""
    _, offsets = bytes_of(texts)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(stop, len(texts))
        start = stop


class Words:
    """The words of some texts: ``starts`` and ``ends`` in ``data``, and ``first`` (texts + 1), the words before each text."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = bytes_of(texts)
        n = len(self.data)
        inner = ~_SEP[self.data] if n else np.zeros(0, bool)
        begin = inner.copy()
        begin[1:] &= ~inner[:-1]
        edges = self.offsets[:-1][self.offsets[:-1] < n]
        begin[edges] = inner[edges]
        end = inner.copy()
        end[:-1] &= ~inner[1:]
        last = self.offsets[1:] - 1
        last = last[last >= 0]
        end[last] = inner[last]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self._inner = inner

    def hashes(self, family: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; the two families are independent."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        of_byte, powers = _TABLES[family]
        lengths = self.ends - self.starts
        before = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
        values = of_byte[self.data[self._inner]]
        values *= powers[at & (_CYCLE - 1)]
        if len(at) and int(lengths.max()) > _CYCLE:
            values = mix(values + (at // _CYCLE).astype(np.uint64))
        out = np.add.reduceat(values, before)
        return mix(out + lengths.astype(np.uint64) * U(0x9E3779B97F4A7C15))


def join(h: np.ndarray, step: int, length: int | None = None, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """From hashes of windows at every place, those of windows ``step`` longer made of two of them."""
    if len(h) <= step:
        return np.zeros(0, np.uint64)
    return mix(h[:-step] * U(base) + mix(h[step:] + U(step * 2654435761)))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n word hashes (len(h) - n + 1 of them), from runs half as long."""
    out, length = h, 1
    while length < n:
        step = min(length, n - length)
        out = join(out, step)
        length += step
    return out
