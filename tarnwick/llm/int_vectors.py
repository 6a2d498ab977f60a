"""Exact inner products of integer vectors, and blocks of vectors as bytes."""

from __future__ import annotations

import numpy as np

#: Sums of absolute products below it are exact in doubles, and in longs.
DOUBLE, LONG = float(1 << 53), float(1 << 63)
KINDS = ("<i2", "<i4", "<i8")


def narrow(x: np.ndarray) -> tuple[str, bytes]:
    """A matrix of longs in the smallest of KINDS that holds it."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    kind = next(k for k in KINDS if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, x.astype(kind).tobytes()


def sizes(x: np.ndarray) -> np.ndarray:
    """Components' sizes as doubles."""
    return np.abs(x.astype(np.float64))


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x @ q.T as longs, exact. A score that fits no long is an error.

    Doubles serve where no sum of absolute products reaches 2 ** 53, longs where none reaches 2 ** 63, and Python's
    integers for what is left.
    """
    width = max(x.shape[1], q.shape[1])
    most = sizes(x).max(initial=0) * sizes(q).max(initial=0) * width
    if x.shape[1] != q.shape[1]:
        x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
    if most < DOUBLE:
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    x, q = x.astype(np.int64), q.astype(np.int64)
    with np.errstate(over="ignore"):
        out = x @ q.T
    if most < LONG * 0.99:
        return out
    for i, j in zip(*np.nonzero(sizes(x) @ sizes(q).T >= LONG * 0.99), strict=True):
        s = sum(a * b for a, b in zip(x[i].tolist(), q[j].tolist(), strict=True))
        if not -(1 << 63) <= s < 1 << 63:
            raise OverflowError(f"a score of {s} fits no long")
        out[i, j] = s
    return out


def matrix(n: int, width: int, kind: str, data: bytes) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, width)
