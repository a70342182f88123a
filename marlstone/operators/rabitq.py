"""Quantised vectors: codes of residuals against a centroid, and estimates of dot products from them.

One bit per dimension is the residual's sign. With B bits the sign bit is the
highest, the others quantise the magnitude on a grid that is scaled so that the
code points as nearly as possible along the residual.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPSILON0 = 1.9
#: Where the search for the scale begins, as a part of its end, for 0 to 8 magnitude bits.
START = (0.0, 0.15, 0.20, 0.52, 0.59, 0.71, 0.75, 0.77, 0.81)
#: Levels searched above the highest one, the guard added before truncation, the least denominator.
EXTRA_LEVELS, TRUNCATION, TINY = 10, 1e-5, 1e-10


@dataclass(frozen=True)
class Code:
    codes: np.ndarray  # uint8, one for each dimension
    add: float
    scale: float
    error: float
    bits: int


def one_bit(x: np.ndarray, centroid: np.ndarray) -> Code:
    """A zero residual has a scale of zero and no error."""
    r = np.asarray(x, np.float32) - np.asarray(centroid, np.float32)
    d = len(r)
    norm = float(np.sqrt(np.dot(r, r)))
    o = r / max(norm, 1e-10)
    code = (o >= 0).astype(np.uint8)
    ip = float(np.sum(np.where(code, o, -o))) / np.sqrt(d)
    ip = ip if abs(ip) >= TINY else TINY
    error = 0.0 if d <= 1 else norm * np.sqrt(max(0.0, (1 - ip * ip) / max(ip * ip, 1e-20))) * EPSILON0 / np.sqrt(d - 1)
    return Code(code, 0.0, norm / (ip * np.sqrt(d)), float(error), 1)


def best_scale(o: np.ndarray, bits: int) -> float:
    """Scale t in the search range for which floor(t * o) + 1/2 points best along ``o`` (non-negative, unit).

    The levels change only at t = level / o[i]. All such steps are sorted once
    and the cosine after each follows from running sums.
    """
    f = np.float32
    o = np.asarray(o, f)
    top = 2**bits - 1
    end = f(top + EXTRA_LEVELS) / o.max()
    start = np.floor(end * f(START[bits]) * o + f(TRUNCATION))
    some = np.flatnonzero(o > 0)
    level = start[some, None] + 1 + np.arange(top + 1, dtype=f)[None, :]
    t = level / o[some, None]
    ok = (level <= top) & (t < end)
    ok[:, 0] = True
    dim = np.broadcast_to(some[:, None], t.shape)[ok]
    level, t = level[ok], t[ok]
    order = np.lexsort((dim, t))
    # Running sums stay in single precision and in order, as the published codes were made.
    dot = np.cumsum(np.concatenate([[np.cumsum((start + f(0.5)) * o, dtype=f)[-1]], o[dim[order]]]), dtype=f)[1:]
    square = np.cumsum(np.concatenate([[np.cumsum(start * start + start, dtype=f)[-1] + f(0.25 * len(o))], 2 * level[order]]), dtype=f)[1:]
    return float(t[order][np.argmax(dot / np.sqrt(square))])


def multi_bit(x: np.ndarray, centroid: np.ndarray, bits: int = 8) -> Code:
    if not 2 <= bits <= 8:
        raise ValueError("2 to 8 bits")
    c = np.asarray(centroid, np.float32)
    r = np.asarray(x, np.float32) - c
    d, half = len(r), 2 ** (bits - 1)
    norm = float(np.sqrt(np.cumsum(r * r, dtype=np.float32)[-1]))
    if not np.isfinite(norm) or norm == 0.0:
        return Code(np.full(d, half, np.uint8), 1.0, 0.0, 0.0, bits)
    o = np.abs(r / np.float32(norm))
    u = np.minimum(np.floor(np.float32(best_scale(o, bits - 1)) * o + np.float32(TRUNCATION)), half - 1).astype(np.int64)
    inverse = 1.0 / float(np.sum((u + 0.5) * o))
    inverse = inverse if np.isfinite(inverse) and inverse > np.finfo(np.float32).tiny else 1.0
    up = r >= 0
    code = np.where(up, u + half, half - 1 - u)
    s = code - (half - 0.5)
    r64 = r.astype(np.float64)
    rs = float(np.dot(r64, s))
    rs = rs if abs(rs) >= TINY else (TINY if rs >= 0 else -TINY)
    n2 = norm * norm
    inner = (n2 * float(np.dot(s, s)) / (rs * rs) - 1) / (d - 1) if d > 1 else 0.0
    error = norm * EPSILON0 * np.sqrt(inner if inner >= 0 else 0.0001)
    add = 1 - float(np.dot(r64, c)) + n2 * float(np.dot(c.astype(np.float64), s)) / rs
    return Code(code.astype(np.uint8), add, -inverse * norm, float(error), bits)


def estimate(codes: np.ndarray, bits: int, add: np.ndarray, scale: np.ndarray, q: np.ndarray, centroid_dot: np.ndarray) -> np.ndarray:
    """Estimated dot products of rows of codes with query ``q``; ``centroid_dot`` is the query's dot with each row's centroid."""
    q = np.asarray(q, np.float64)
    if bits == 1:
        return centroid_dot + scale * (2 * (codes @ q) - q.sum())
    half = 2 ** (bits - 1)
    return 1 - (-centroid_dot + add + scale * (codes @ q - (half - 0.5) * q.sum()))


def estimate_rows(codes: np.ndarray, bits: int, add: np.ndarray, scale: np.ndarray, q: np.ndarray, centroid_dot: np.ndarray) -> np.ndarray:
    """``estimate`` with a query of its own for each row."""
    dot = np.einsum("ij,ij->i", codes, q)
    if bits == 1:
        return centroid_dot + scale * (2 * dot - q.sum(1))
    return 1 - (-centroid_dot + add + scale * (dot - (2 ** (bits - 1) - 0.5) * q.sum(1)))
