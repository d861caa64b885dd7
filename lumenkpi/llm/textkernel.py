"""Vectorised text primitives over Arrow string arrays: words, tokens, shingles and sketches as numpy arrays.

All functions take whole texts.  Work is done on blocks of about ``BLOCK`` bytes cut between documents (or between
words of one long document), so memory is bounded by the block and the longest document, not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 21

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_BASE = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        out = np.full(max(n, 4096), _BASE, np.uint64)
        out[0] = 1
        _POWERS = np.multiply.accumulate(out)
    return _POWERS[:n]


#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space, \t, \n, \v, \f, \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (rows + 1) of a string array; a null reads as an empty text."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8), offs


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at least one row and, if more than one, of at most ``size`` bytes."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run data[starts:ends) (none of them empty), in pieces of bounded size."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        s, e = starts[i:j], ends[i:j]
        lengths = e - s
        at = np.cumsum(lengths) - lengths
        inside = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(at, lengths)
        values = _BYTE[data[inside + np.repeat(s, lengths)]] * powers(int(lengths.max()))[inside]
        out[i:j] = np.add.reduceat(values, at)
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _GOLD)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs without white space: starts, ends (in ``data``) and, per row, the index of its first word.

    ``data`` and ``offsets`` are as from :func:`text_buffers`; offsets may start anywhere.  The third array has one
    entry more than there are rows.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    solid = ~SPACE[data[lo:hi]]
    return _runs(solid, solid, offsets, lo)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes (letters, digits, non-ASCII) and of punctuation, as :func:`words` returns them."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    kind = _KIND[data[lo:hi]]
    return _runs(kind, kind > 0, offsets, lo)


_KIND = np.full(256, 2, np.uint8)
_KIND[SPACE] = 0
_KIND[128:] = 1
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    _KIND[_c] = 1


def _runs(kind: np.ndarray, solid: np.ndarray, offsets: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(kind)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:n])
    cuts = offsets - lo
    new[cuts] = True
    edges = np.flatnonzero(new)
    starts, ends = edges[:-1], edges[1:]
    keep = solid[starts]
    starts, ends = starts[keep], ends[keep]
    first = np.searchsorted(starts, cuts, "left")
    return starts + lo, ends + lo, first


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """The 64-bit hash of the run of ``width`` words from each place on, whatever text they belong to."""
    n = len(hashes)
    window = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        window += hashes[j : n - width + 1 + j] * (powers(2 * width + 2)[2 * j + 2] | np.uint64(1)) if len(window) else window
    return mix(window)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its runs of ``width`` words.

    A row with fewer words has its whole sequence as one; a row without words an empty set.
    """
    window = shingles(hashes, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(window[a : b - width + 1]))
        elif b > a:
            few = (hashes[a:b] * powers(2 * width + 2)[2 : 2 * (b - a) + 2 : 2]).sum(keepdims=True) + np.array([b - a], np.uint64) * _GOLD
            out.append(mix(few))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_shingles(col: pa.Array, width: int = 5) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, shingle sets of the rows from there on) for each block of a string array; A-Z are lower-cased."""
    data, offsets = text_buffers(col)
    for a, b in blocks(offsets):
        part = LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = words(part, offsets[a : b + 1] - offsets[a])
        yield a, shingle_sets(run_hashes(part, starts, ends), first, width)


class FastSketch:
    """Fast similarity sketching: ``t`` coordinates filled by rounds of hashed bin placement.

    In round i < t every element falls into a hashed bin with the value (i, hash); in round t + j it falls into bin j.
    A bin keeps its least value, and a set is done as soon as all its bins are filled, so after 2 t rounds at the
    latest every coordinate of a non-empty set is filled.  Two sets agree in a coordinate with a probability of their
    Jaccard similarity, and the share of agreeing coordinates is concentrated about it.
    """

    def __init__(self, t: int = 128, seed: int = 1):
        assert t & (t - 1) == 0 and 2 <= t <= 128, "t is a power of two up to 128"
        self.t = t
        self.seeds = mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * _GOLD + np.uint64(seed * int(_M1) % (1 << 64)))
        self.shift = np.uint64(64 - t.bit_length() + 1)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of t values for each set; the rows of empty sets are all 2**64 - 1."""
        return self.flat(np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.array([len(s) for s in sets], np.int64))

    def flat(self, items: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same for sets that stand one after the other in ``items``."""
        t, n = self.t, len(sizes)
        empty = np.uint64(0xFFFFFFFFFFFFFFFF)
        out = np.full((n, t), empty, np.uint64)
        flat = out.reshape(-1)
        live = np.flatnonzero(sizes)
        if not len(live):
            return out
        owner = np.repeat(np.arange(n), sizes) * t
        low = np.uint64((1 << 56) - 1)
        for i in range(2 * t):
            h = mix(items ^ self.seeds[i])
            bins = (h >> self.shift).astype(np.int64) if i < t else i - t
            np.minimum.at(flat, owner + bins, (h & low) | np.uint64(i << 56))
            live = live[(out[live] == empty).any(axis=1)]
            if not len(live):
                break
            more = np.zeros(n, bool)
            more[live] = True
            stay = more[owner // t]
            items, owner = items[stay], owner[stay]
        return out


def band_hashes(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of ``rows`` coordinates; equal bands of different places differ."""
    n, t = sketches.shape
    parts = sketches.reshape(n, t // rows, rows)
    out = np.zeros((n, t // rows), np.uint64)
    for j in range(rows):
        out = mix(out ^ (parts[:, :, j] + np.uint64((j + 1) * int(_GOLD) % (1 << 64))))
    return mix(out + np.arange(1, t // rows + 1, dtype=np.uint64) * _M2).view(np.int64)


def set_identities(items: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first of the two numbers of :func:`set_identity` for non-empty sets that stand one after the other."""
    return np.add.reduceat(mix(items), np.cumsum(sizes) - sizes).view(np.int64) if len(sizes) else np.zeros(0, np.int64)


def least_of_windows(values: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """The places that hold the least value (the first of equal ones) of some ``window`` values in a row.

    Rows are the ranges [first, last) of ``values``, in order; a row of fewer values has the place of its least one.
    Values are compared by their upper 36 bits.
    """
    n = len(values)
    some = last > first
    first, last = first[some], last[some]
    if not len(first):
        return np.zeros(0, np.int64)
    place = np.uint64((1 << 28) - 1)
    least = (values & ~place) | np.arange(n, dtype=np.uint64)  # the place breaks ties
    few = last - first < window
    short = np.minimum.reduceat(np.append(least, place), np.stack([first[few], last[few]], 1).reshape(-1))[::2] if few.any() else least[:0]
    step, size = least, 1  # step[i]: the least of size values from i on
    while size < window and n >= window:
        by = min(size, window - size)
        step = np.minimum(step[: len(step) - by], step[by:])
        size += by
    begin = np.zeros(n + 1, np.int8)  # where a whole window begins
    begin[first[~few]] = 1
    begin[last[~few] - window + 1] -= 1
    inside = np.flatnonzero(np.cumsum(begin[:n], dtype=np.int8) > 0)
    found = step[inside] if len(inside) else least[:0]
    return np.unique(np.concatenate([short, found]) & place).astype(np.int64)


def set_identity(items: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that identify a set of hashes, as signed integers."""
    if not len(items):
        return 0, 0
    one, two = mix(items), mix(items + _GOLD)
    return int(one.sum().view(np.int64)), int((two ^ (two >> _S31)).sum().view(np.int64))
