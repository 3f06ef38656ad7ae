"""The same summaries and bounds over batches of series in numpy, for scans that keep a running best."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .series import breakpoints


def matrix(batch: pa.RecordBatch, vector: str, *others: str) -> tuple[np.ndarray, ...]:
    """The vectors of an Arrow batch as a matrix, without copying them row by row, and other columns; rows with a null in any are left out.
    All vectors have one length."""
    batch = batch.select([vector, *others])
    if any(c.null_count for c in batch.columns):
        batch = batch.filter(reduce(pc.and_, [pc.is_valid(c) for c in batch.columns]))
    v = batch.column(0)
    flat, lengths = v.flatten(), np.diff(v.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError(f"vectors of {lengths.min()} and {lengths.max()} numbers")
    return (flat.to_numpy(zero_copy_only=False).reshape(len(v), -1 if len(v) else 0), *(batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(others))))


def znorm(x: np.ndarray) -> np.ndarray:
    sd = x.std(axis=1, keepdims=True)
    return np.where(sd > 1e-12, (x - x.mean(axis=1, keepdims=True)) / np.where(sd > 1e-12, sd, 1), 0.0)


def squared_distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of x to the series q, by differences (no cancellation)."""
    d = x - q
    return np.einsum("ij,ij->i", d, d)


def products(x: np.ndarray, qs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances, queries x rows, by one matrix product, and for each query by how much they may be wrong."""
    x2, q2 = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", qs, qs)
    return q2[:, None] + x2 - 2 * (qs @ x.T), 2e-15 * x.shape[1] * (q2 + (x2.max() if len(x2) else 0.0))


def paa(x: np.ndarray, segments: int) -> np.ndarray:
    step = x.shape[1] // segments
    return x[:, : step * segments].reshape(len(x), segments, step).mean(axis=2)


def symbols(means: np.ndarray, cardinality: int) -> np.ndarray:
    return np.searchsorted(np.array(breakpoints(cardinality)), means, side="left").astype(np.int16)


def segment_stats(x: np.ndarray, ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    cuts = [0, *ends]
    parts = [x[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.stack([p.mean(axis=1) for p in parts], axis=1), np.stack([p.std(axis=1) for p in parts], axis=1)


def spectrum(x: np.ndarray, coefficients: int) -> np.ndarray:
    """Real and imaginary parts of Fourier coefficients 1, 2, ..., scaled by 1 / sqrt(length)."""
    c = np.fft.rfft(x, axis=1)[:, 1 : coefficients + 1] / x.shape[1] ** 0.5
    return np.stack([c.real, c.imag], axis=2).reshape(len(x), -1)


def envelope(q: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower extremes within band points, of a series or of each row."""
    pad = np.pad(q, [(0, 0)] * (q.ndim - 1) + [(band, band)], mode="edge")
    view = np.lib.stride_tricks.sliding_window_view(pad, 2 * band + 1, axis=-1)
    return view.max(axis=-1), view.min(axis=-1)


def lb_keogh(x: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    gap = np.maximum(0, np.maximum(x - upper, lower - x))
    return np.einsum("ij,ij->i", gap, gap)


def dtw(x: np.ndarray, q: np.ndarray, band: int, bound: float | np.ndarray = np.inf, env: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Squared time-warping cost of each row of x to q within a band; costs over bound are infinity, and rows whose every path passes it are
    given up. q and bound: one, or one for each row. env: the envelope of q, by which rows are given up for what the points to come must add."""
    m, n = x.shape
    out, live = np.full(m, np.inf), np.arange(m)
    limit = np.broadcast_to(np.asarray(bound, float), m)
    a, b = np.ascontiguousarray(x.T), np.ascontiguousarray(np.broadcast_to(q, x.shape).T)  # a point of all rows lies together
    rest = np.zeros((n + 1, m))  # what points i and after add at least
    if env is not None:
        upper, lower = (np.broadcast_to(e, x.shape).T for e in env)
        gap = np.maximum(0, np.maximum(a - upper, lower - a))
        rest[:n] = np.cumsum((gap * gap)[::-1], axis=0)[::-1]
    before, now = np.full((n + 1, m), np.inf), np.full((n + 1, m), np.inf)
    before[0] = 0
    for i in range(n):
        lo, hi = max(0, i - band), min(n, i + band + 1)
        cost = (a[i] - b[lo:hi]) ** 2
        up = np.minimum(before[lo:hi], before[lo + 1 : hi + 1])
        left: float | np.ndarray = np.inf
        for j in range(hi - lo):
            left = np.add(cost[j], np.minimum(up[j], left, out=up[j]), out=now[lo + j + 1])
        before[0] = np.inf
        before, now = now, before  # a cell outside the band is never written before it is read
        if i % 4 == 3 and i + 1 < n:
            keep = before[lo + 1 : hi + 1].min(axis=0) + rest[i + 1] <= limit * (1 + 1e-12)
            kept = np.count_nonzero(keep)
            if not kept:
                return out
            if kept < 0.8 * len(live):
                live, limit = live[keep], limit[keep]
                a, b, rest, before, now = (y[:, keep] for y in (a, b, rest, before, now))
    out[live] = np.where(before[n] <= limit, before[n], np.inf)
    return out
