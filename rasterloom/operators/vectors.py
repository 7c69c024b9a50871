"""The same row filters on whole chunks in numpy, for bulk encoding inside Arrow batches."""

from __future__ import annotations

import numpy as np

from ..functions.spec import Filter
from .filters import BIG_ROW, MOST_COST

#: Rows that are unfiltered together along diagonals.
BAND = 512


def _shifted(a: np.ndarray, bpp: int) -> np.ndarray:
    out = np.zeros_like(a)
    out[:, bpp:] = a[:, :-bpp] if bpp < a.shape[1] else 0
    return out


def filter_one(rows: np.ndarray, above: np.ndarray, bpp: int, kind: Filter) -> np.ndarray:
    """rows, above: uint8 matrices, above holding the row over each. Bytes wrap by themselves; only Paeth needs wider numbers."""
    if kind == Filter.NONE:
        return rows
    if kind == Filter.SUB:
        return rows - _shifted(rows, bpp)
    if kind == Filter.UP:
        return rows - above
    left = _shifted(rows, bpp)
    if kind == Filter.AVERAGE:
        return rows - ((left & above) + ((left ^ above) >> 1))
    corner = _shifted(above, bpp)
    wide = corner.astype(np.int16)
    a, b = above - wide, left - wide
    c = np.abs(a + b)
    np.abs(a, out=a)
    np.abs(b, out=b)
    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
    return rows - guess


def costs(filtered: np.ndarray) -> np.ndarray:
    """The cost of each filtered row."""
    total = np.minimum(filtered, 0 - filtered).sum(1, dtype=np.int64)
    return np.minimum(total, MOST_COST) if filtered.shape[1] >= BIG_ROW else total


def filter_chunk(rows: np.ndarray, above: np.ndarray, bpp: int, mode: Filter | None) -> np.ndarray:
    """Selector byte and filtered bytes of each row; mode None chooses the cheapest of Sub, Up, Average, Paeth, earlier on a tie."""
    out = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    if mode is not None:
        out[:, 0], out[:, 1:] = int(mode), filter_one(rows, above, bpp, mode)
        return out
    best = None
    for kind in (Filter.SUB, Filter.UP, Filter.AVERAGE, Filter.PAETH):
        done = filter_one(rows, above, bpp, kind)
        cost = costs(done)
        if best is None:
            best, better = cost, slice(None)
        else:
            better = np.flatnonzero(cost < best)
            best = np.minimum(best, cost)
        out[better, 0], out[better, 1:] = int(kind), done[better]
    return out


def _unfilter_band(kinds: np.ndarray, lines: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows of a band, as (row, pixel, byte). A pixel needs its left and upper neighbours, so all pixels of a diagonal are done at once:
    in the skewed matrix, pixel x of row r (from 1, 0 being the row above) stands at [x + r + 1, r]."""
    n_rows, n, bpp = lines.shape
    skewed = np.zeros((n + n_rows + 2, n_rows + 1, bpp), np.int16)
    given = np.zeros((n + n_rows + 2, n_rows, bpp), np.int16)
    skewed[1 : n + 1, 0] = above
    for r in range(n_rows):
        given[r + 2 : r + 2 + n, r] = lines[r]
    is_sub, is_up, is_average, is_paeth = ((kinds == k).astype(np.int16)[:, None] for k in (1, 2, 3, 4))
    for d in range(2, n + n_rows + 1):
        left, up, corner = skewed[d - 1, 1:], skewed[d - 1, :-1], skewed[d - 2, :-1]
        a, b = up - corner, left - corner
        c = np.abs(a + b)
        a, b = np.abs(a), np.abs(b)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = is_sub * left + is_up * up + is_average * ((left + up) >> 1) + is_paeth * paeth
        skewed[d, 1:] = (given[d] + guess) & 255
    return np.stack([skewed[r + 1 : r + 1 + n, r] for r in range(1, n_rows + 1)]).astype(np.uint8)


def unfilter(data: np.ndarray, bpp: int) -> np.ndarray:
    """The rows behind a matrix of selector bytes and filtered bytes."""
    kinds, lines = data[:, 0], data[:, 1:]
    if len(wrong := np.flatnonzero(kinds > Filter.PAETH)):
        raise ValueError(f"no filter has the code {kinds[wrong[0]]}")
    out = np.zeros(lines.shape, np.uint8)
    width = out.shape[1]
    above = np.zeros(width, np.uint8)
    y = 0
    while y < len(data):
        if kinds[y] >= Filter.AVERAGE:
            # as far as such rows go on, with few others between
            end = min(len(data), y + BAND)
            band = _unfilter_band(kinds[y:end], lines[y:end].reshape(end - y, -1, bpp), above.reshape(-1, bpp))
            out[y:end] = band.reshape(end - y, width)
            y = end
        else:
            x = lines[y]
            if kinds[y] == Filter.SUB:
                x = np.cumsum(x.reshape(-1, bpp), 0, dtype=np.uint8).ravel()
            elif kinds[y] == Filter.UP:
                x = x + above
            out[y] = x
            y += 1
        above = out[y - 1]
    return out
