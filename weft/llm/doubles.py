"""Sums and matrix products beyond double precision, by error-free transformations of doubles.

A number is a pair (high, low) whose exact sum it is. A product of matrices is split into
slices of 21 bits, so that products of slices over at most 1,024 terms are exact in
doubles, in any order of summation; only their sums are rounded, in pairs.
"""

from __future__ import annotations

import numpy as np

#: Bits of a slice, and the terms that an exact product of slices may have: 2 * BITS + log2(TERMS) is below 53.
BITS, TERMS = 21, 1024
#: Products of slices that reach above 2**-63 of the largest entries.
_PARTS = ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0))

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a, b) -> Pair:
    """a + b and what rounding it lost, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(a: Pair, b: Pair) -> Pair:
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    e = e + t
    high = s + e
    low = e - (high - s) + f
    out = high + low
    return out, low - (out - high)


def add_double(a: Pair, b) -> Pair:
    s, e = two_sum(a[0], b)
    e = e + a[1]
    high = s + e
    return high, e - (high - s)


def scaled(a: Pair, divisor: float) -> Pair:
    """a / divisor."""
    high = a[0] / divisor
    # high * divisor, exactly, by Dekker's split
    c = 134217729.0
    ah, bh = c * high - (c * high - high), c * divisor - (c * divisor - divisor)
    al, bl = high - ah, divisor - bh
    p = high * divisor
    err = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    low = ((a[0] - p) - err + a[1]) / divisor
    out = high + low
    return out, low - (out - high)


def slices(a: Pair, axis: int) -> list[np.ndarray]:
    """Three slices of each entry, in units of its row's or column's largest (the maximum is taken along axis)."""
    top = np.maximum(np.abs(a[0]).max(axis=axis, keepdims=True, initial=0.0), np.finfo(float).tiny * 2.0**80)
    unit = np.exp2(np.ceil(np.log2(top)))
    out, rest = [], a[0]
    for k in (1, 2, 3):
        if k == 3:
            rest = rest + a[1]
        shift = 1.5 * unit * 2.0 ** (52 - BITS * k)
        out.append((rest + shift) - shift)
        rest = rest - out[-1]
    return out


def product(a: Pair, b: Pair) -> Pair:
    """a @ b."""
    out = (np.zeros((a[0].shape[0], b[0].shape[1])),) * 2
    for at in range(0, a[0].shape[1], TERMS):
        own = slice(at, at + TERMS)
        left, right = slices((a[0][:, own], a[1][:, own]), 1), slices((b[0][own], b[1][own]), 0)
        for i, j in _PARTS:
            out = add_double(out, left[i] @ right[j])
    return out


def exact(a: np.ndarray) -> Pair:
    return a, np.zeros_like(a)
