"""Vectorised 64-bit hashes of bytes, words and windows in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

U = np.uint64
#: Bytes that are hashed at once.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


@cache
def byte_values(seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64, 256, dtype=np.uint64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))


POWERS = Powers(0x9E3779B97F4A7C15)
OTHER = Powers(0xD6E8FEB86659FD93)


def prefix(values: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Sums from which span() takes the hash of any run of values."""
    powers.need(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers.up[: len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, start, end, powers: Powers = POWERS) -> np.ndarray:
    """Hash of values[start:end], the same wherever the run stands."""
    return mix((sums[end] - sums[start]) * powers.down[start])


def char_class(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in text]] = True
    return out


#: Words of the substring dedup are runs of anything but ASCII white space.
NOT_SPACE = ~char_class(" \t\n\x0b\x0c\r")
#: Words of the decontamination: digits, lower-case ASCII letters, all beyond ASCII.
WORD = char_class("0123456789abcdefghijklmnopqrstuvwxyz")
WORD[128:] = True


def hash_runs(arr: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each of the ascending runs arr[start:end]; long arrays are hashed in pieces cut between runs."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        sums = prefix(byte_values()[arr[lo:hi]])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix(span(sums, s, e) + (e - s).astype(np.uint64))
        at = to
    return out


def words(buf: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every maximal run of bytes of the class `inside`."""
    arr = np.frombuffer(buf, np.uint8)
    mark = inside[arr].view(np.int8)
    step = np.diff(mark, prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return hash_runs(arr, starts, ends), starts, ends


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
