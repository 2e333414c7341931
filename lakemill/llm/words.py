"""Vectorised word handling shared by the text operators.

A word is a maximal run of UTF-8 bytes outside ``[\\x20\\x09-\\x0D]``. Texts are handled as Arrow string
arrays; everything here works on slices of bounded size, so that memory follows the slice, not the batch.
Nulls count as texts without words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once. One longer text is handled alone.
SLICE_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
GOLDEN = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def pair_name(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit name of ordered pairs."""
    return mix(mix(a + U64((int(GOLDEN) * (2 * salt + 1)) & (2**64 - 1))) ^ (b * _M1 + GOLDEN))


class Words:
    """The words of some texts; words ``bounds[i]:bounds[i+1]`` are text i's, word j is ``raw[starts[j]:ends[j]]``."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, raw: np.ndarray):
        self.starts, self.ends, self.bounds, self.raw = starts, ends, bounds, raw
        self.n = len(starts)

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: bytes times random odd 64-bit numbers for their places, summed and mixed.

        Two different words agree with a chance of at most 2**-56.
        """
        return self.several_hashes((seed,), lower)[0]

    def several_hashes(self, seeds: tuple[int, ...], lower: bool = False) -> list[np.ndarray]:
        """Hashes by several seeds, which are independent of one another."""
        if not self.n:
            return [np.zeros(0, np.uint64) for _ in seeds]
        lengths = self.ends - self.starts
        first = np.zeros(self.n, np.int64)
        np.cumsum(lengths[:-1], out=first[1:])
        kept = self.raw[~_IS_SPACE[self.raw]]
        if lower:
            kept = _LOWER[kept]
        place = np.arange(len(kept)) - np.repeat(first, lengths)
        kept = kept.astype(np.uint64) + U64(1)
        longest = int(lengths.max())
        return [mix(np.add.reduceat(_coefficients(seed, longest)[place] * kept, first)) for seed in seeds]

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


_COEFFICIENTS: dict[int, np.ndarray] = {}


def _coefficients(seed: int, n: int) -> np.ndarray:
    have = _COEFFICIENTS.get(seed)
    if have is None or len(have) < n:
        have = mix((np.arange(max(n, 256), dtype=np.uint64) + U64(1)) * GOLDEN + U64(seed)) | U64(1)
        if n <= 1 << 16:
            _COEFFICIENTS[seed] = have
    return have


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[first_of_runs(values)]


def first_of_runs(values: np.ndarray) -> np.ndarray:
    """Marks where a value differs from the one before it."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string or binary array whose bytes stay near ``most``."""
    n = len(texts)
    if not n:
        return
    at = offsets_of(texts)
    i = 0
    while i < n:
        j = int(np.searchsorted(at, at[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def offsets_of(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * kind().itemsize).astype(np.int64)


def plain(texts) -> pa.Array:
    """One Arrow binary array with nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    return texts


def split(texts: pa.Array) -> Words:
    """The words of all texts of an array (as from ``plain``); ``bounds[i]:bounds[i+1]`` are text i's."""
    at = offsets_of(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    space = _IS_SPACE[raw]
    word = np.empty(len(raw) + 1, bool)
    word[:-1] = ~space
    word[-1] = False
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = at[1:-1]
    inner = inner[inner < len(raw)]
    first[inner] = word[inner]  # a text's first byte never continues the text before
    starts = np.flatnonzero(first)
    last = word[:-1].copy()
    last &= ~word[1:]
    cut = inner[inner > 0] - 1
    last[cut] = word[cut]
    ends = np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, at)
    return Words(starts, ends, bounds, raw)


def window_hashes(h: np.ndarray, bounds: np.ndarray, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` consecutive values inside the bounds, and where each starts.

    Built by doubling, so that the cost is a few passes for any width.
    """
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, have = h, 1
    parts: list[tuple[int, np.ndarray]] = []
    todo, level = width, 0
    while todo:
        if todo & 1:
            parts.append((have, power))
        todo >>= 1
        if todo:
            power = pair_name(power[: len(power) - have], power[have:], salt * 64 + level)
            have, level = have * 2, level + 1
    out, at = None, 0
    for size, values in parts:
        values = values[at : at + n - width + 1]
        out = values.copy() if out is None else pair_name(out, values, salt * 64 + 32 + at)
        at += size
    lengths = np.diff(bounds)
    ok = np.ones(n - width + 1, bool)
    ends = bounds[1:]
    # windows that would cross a bound start in the last width-1 places before it
    gap = np.minimum(lengths, width - 1)
    total = int(gap.sum())
    if total:
        spots = np.repeat(ends - gap, gap) + np.arange(total) - np.repeat(np.cumsum(gap) - gap, gap)
        ok[spots[spots < len(ok)]] = False
    where = np.flatnonzero(ok)
    return (out[where] if out is not None else np.zeros(len(where), np.uint64)), where
