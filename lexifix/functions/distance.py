"""Optimal string alignment distance over whole columns: many short pairs at once, long pairs in a band that doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Pairs whose longer string has up to so many characters are worked on together.
SHORT = (16, 32, 64, 128)


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each text's begin and the last ends)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = b"" if raw is None else raw.to_pybytes()[offsets[0] : offsets[-1]]
    first = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80  # a character's first byte
    places = np.r_[0, np.cumsum(first)][offsets - offsets[0]]
    return np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32), places


def _matrix(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, filler: int) -> np.ndarray:
    """Row i: the ith character of each text."""
    out = np.full((width, len(starts)), filler, np.uint32)
    for i in range(width):
        has = np.flatnonzero(sizes > i)
        out[i, has] = points[starts[has] + i]
    return out


def _banded(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Distances of pairs (characters in columns, lengths n and m); k + 1 for all above k.

    Cells (i, i + o) for |o| <= k, a row of cells for all pairs at a time.
    """
    pairs, far = a.shape[1], np.uint8(min(k + 1, 250))
    out = np.full(pairs, far, np.uint8)
    width = 2 * k + 1
    last = np.full((width + 2, pairs), far, np.uint8)  # one more on each side stands for cells outside
    before = last.copy()
    for o in range(k + 1):
        last[k + 1 + o] = o
    diff = m.astype(np.int64) - n
    inside = np.abs(diff) <= k
    done = np.flatnonzero(inside & (n == 0))
    out[done] = last[k + 1 + diff[done], done]
    for i in range(1, int(n.max(initial=0)) + 1):
        row = np.full((width + 2, pairs), far, np.uint8)
        for o in range(-k, k + 1):
            j, c = i + o, o + k + 1
            if j < 0 or j > len(b):
                continue
            if j == 0:
                row[c] = min(i, far)
                continue
            cell = last[c] + (a[i - 1] != b[j - 1])
            np.minimum(cell, last[c + 1] + np.uint8(1), out=cell)
            np.minimum(cell, row[c - 1] + np.uint8(1), out=cell)
            if i > 1 and j > 1:
                swapped = (a[i - 1] == b[j - 2]) & (a[i - 2] == b[j - 1])
                np.minimum(cell, np.where(swapped, before[c] + np.uint8(1), far), out=cell)
            np.minimum(cell, far, out=row[c])
        done = np.flatnonzero(inside & (n == i))
        out[done] = row[k + 1 + diff[done], done]
        before, last = last, row
    return out


def osa_long(a: np.ndarray, b: np.ndarray, limit: int | None = None) -> int:
    """Distance of two arrays of code points, limit + 1 if above; a band about the diagonal doubles until it holds it."""
    n, m = len(a), len(b)
    far = n + m + 1
    band = max(abs(n - m), 32)
    if limit is not None and abs(n - m) > limit:
        return limit + 1
    while True:
        band = min(band, max(n, m)) if limit is None else min(band, max(n, m), max(limit, abs(n - m)))
        size = 2 * band + 1
        offsets = np.arange(-band, band + 1)
        padded = np.r_[np.zeros(band + 2, np.int64) - 1, b.astype(np.int64), np.zeros(2 * band + 2, np.int64) - 2]
        # padded[j + band + 1] is b[j - 1]
        last = np.where((offsets >= 0) & (offsets <= m), offsets, far)
        before = np.full(size, far)
        for i in range(1, n + 1):
            at = i + offsets[0] + band + 1
            here, left = padded[at : at + size], padded[at - 1 : at - 1 + size]
            row = last + (here != a[i - 1])
            np.minimum(row[:-1], last[1:] + 1, out=row[:-1])
            if i > 1:
                swap = (left == a[i - 1]) & (here == a[i - 2])
                swap[: max(0, 2 - i + band)] = False
                row[swap] = np.minimum(row[swap], before[swap] + 1)
            low = -i + band  # the place of j = 0
            if low >= 0:
                row[:low], row[low] = far, i
            high = m - i + band
            if high + 1 < size:
                row[max(0, high + 1) :] = far
            row = np.minimum.accumulate(row - offsets) + offsets  # from the left neighbour
            if high + 1 < size:
                row[max(0, high + 1) :] = far
            before, last = last, np.minimum(row, far)
        found = int(last[m - n + band])
        if found <= band or band >= max(n, m):
            return found if limit is None else min(found, limit + 1)
        if limit is not None and band >= limit:
            return limit + 1
        band *= 2


def osa_pairs(a: pa.Array, b: pa.Array, limit: int | None = None) -> pa.Array:
    """Distances of two columns; null for a null and for more than ``limit``."""
    some = np.asarray(a.is_valid()) & np.asarray(b.is_valid())
    out, valid = np.zeros(len(a), np.int32), some.copy()
    pa_, places_a = _points(a.fill_null(""))
    pb, places_b = _points(b.fill_null(""))
    n, m = np.diff(places_a), np.diff(places_b)
    longest = np.maximum(n, m)
    low = 0
    if limit is not None and limit <= 8:
        for width in SHORT:
            at = np.flatnonzero(some & (longest <= width) & (longest >= low))
            low = width + 1
            for part in np.split(at, range(8192, len(at), 8192)) if len(at) else ():
                x = _matrix(pa_, places_a[part], n[part], int(n[part].max()), 0x110000)
                y = _matrix(pb, places_b[part], m[part], int(m[part].max()), 0x110001)
                out[part] = _banded(x, y, n[part], m[part], limit)
    for k in np.flatnonzero(some & (longest >= low)).tolist():
        out[k] = osa_long(pa_[places_a[k] : places_a[k + 1]], pb[places_b[k] : places_b[k + 1]], limit)
    if limit is not None:
        valid &= out <= limit
    return pa.array(out, pa.int32(), mask=~valid)
