"""Word shingles of texts or lines as 64-bit hashes, computed for a whole batch by numpy.

Words are runs of other bytes than space and 0x09-0x0D of the UTF-8 text, A-Z lower-cased. A unit's set (a unit is a text or a line)
is that of its five-word shingles; a unit of one to four words has its whole sequence as the one shingle, one without words none.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, WIDTH + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of the bytes."""
    buf = np.frombuffer(data, np.uint8)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.diff(np.concatenate(([True], _BLANK[buf], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    forward, back = _power(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[buf]] * forward, out=total[1:])
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * _BASE), start


def sets(words: np.ndarray, unit: np.ndarray, n_units: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, unit after unit, and how many each of the n_units has. unit: of each word, ascending."""
    n = len(words)
    per = np.bincount(unit, minlength=n_units)
    first = np.cumsum(per) - per
    shingle = np.zeros(max(0, n - WIDTH + 1), np.uint64)
    for j in range(WIDTH):
        shingle += words[j : n - WIDTH + 1 + j] * _PLACE[j]
    inside = unit[: len(shingle)] == unit[WIDTH - 1 :] if n >= WIDTH else np.zeros(0, bool)
    found, owner = [mix(shingle[inside])], [unit[: len(shingle)][inside]]
    for m in range(1, WIDTH):
        short = np.flatnonzero(per == m)
        whole = np.full(len(short), np.uint64(int(_PLACE[WIDTH]) * m % (1 << 64)))
        for j in range(m):
            whole += words[first[short] + j] * _PLACE[j]
        if len(short):
            found.append(mix(whole))
            owner.append(short)
    hashes, owner = np.concatenate(found), np.concatenate(owner)
    if np.any((per > 0) & (per < WIDTH)):  # else the units are in order
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    # units in which the leading bits of two shingles agree may hold one twice; only those are sorted in full
    bits = max(1, int(n_units).bit_length())
    key = np.sort((owner.astype(np.uint64) << np.uint64(64 - bits)) | (hashes >> np.uint64(bits)))
    twice = np.zeros(n_units, bool)
    twice[(key[1:][key[1:] == key[:-1]] >> np.uint64(64 - bits)).astype(np.int64)] = True
    if twice.any():
        at = np.flatnonzero(twice[owner])
        order = at[np.lexsort((hashes[at], owner[at]))]
        again = np.zeros(len(hashes), bool)
        again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        hashes, owner = hashes[~again], owner[~again]
    return hashes, np.bincount(owner, minlength=n_units)


def text_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """sets() of whole texts."""
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(x) + 1 for x in raw]) if raw else np.zeros(0, np.int64)
    words, at = word_hashes(b"\n".join(raw))
    return sets(words, np.searchsorted(ends, at, "right"), len(raw))


def line_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """sets() of the lines that have words, and each such line's text and its number there, from 0."""
    raw = [t.encode() for t in texts]
    data = b"\n".join(raw)
    words, at = word_hashes(data)
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line = np.searchsorted(breaks, at)  # the line, counted over the whole batch, of each word
    ends = np.cumsum([len(x) + 1 for x in raw]) if raw else np.zeros(0, np.int64)
    used, place = np.unique(line, return_index=True)
    text = np.searchsorted(ends, at[place], "right")
    before = np.searchsorted(breaks, np.concatenate(([0], ends[:-1]))) if raw else np.zeros(0, np.int64)
    hashes, size = sets(words, np.searchsorted(used, line), len(used))
    return hashes, size, text, used - before[text]


def identity(hashes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that name each set, the same for equal sets."""
    return tuple(_sums(mix(hashes ^ salt), size).view(np.int64) for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)))


def parity(hashes: np.ndarray, size: np.ndarray, longs: int) -> np.ndarray:
    """A row of 64 * longs bits for each set: a bit is set if an odd number of the set's hashes fall on it.

    A bit in which two rows differ stands for a hash that only one of the sets has. So the number of such bits never exceeds the
    size of the symmetric difference.
    """
    out = np.zeros((len(size), longs), np.uint64)
    full = np.flatnonzero(size)
    start = (np.cumsum(size) - size)[full]
    if len(full):
        bit = np.uint64(1) << (hashes & np.uint64(63))
        place = (hashes >> np.uint64(6)) % np.uint64(longs)
        for k in range(longs):
            out[full, k] = np.bitwise_xor.reduceat(np.where(place == k, bit, np.uint64(0)), start)
    return out.view(np.int64)


def _sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
    end = np.cumsum(size)
    return total[end] - total[end - size]
