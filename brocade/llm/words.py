"""Words of many documents at once: numpy arrays over one buffer instead of a Python loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import MASK, U64, mix

#: Base of the rolling polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        with np.errstate(over="ignore"):
            got = np.full(max(n, 1 << 16, 0 if got is None else len(got)) + 1, U64(base))
            got[0] = 1
            got = np.cumprod(got, dtype=U64)
        _powers[base] = got
    return got[:n]


BYTE = mix(np.arange(256, dtype=U64) + U64(7))
"""A random 64-bit value for each byte."""


@dataclass
class Words:
    """Words of a batch in reading order. start, end: bytes in buffer; doc: row of the batch; first: first word of each row (one entry more than rows)."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def split(rows: list[bytes]) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of each row; in the buffer they are parted by one space, rows by one newline."""
    buffer = np.frombuffer(b"\n".join([b" ".join(x.split()) for x in rows]) + b"\n", np.uint8)
    ends = np.flatnonzero((buffer == 32) | (buffer == 10))
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = buffer[ends] == 10
    doc = np.cumsum(last) - last
    full = ends > starts
    starts, ends, doc = starts[full], ends[full], doc[full]
    return Words(buffer, starts, ends, doc, np.searchsorted(doc, np.arange(len(rows) + 1)))


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(w.buffer) + 1, U64)
        np.cumsum(BYTE[w.buffer] * powers(BASE, len(w.buffer)), out=sums[1:])
        return mix((sums[w.end] - sums[w.start]) * powers(INVERSE, len(w.buffer))[w.start] + (w.end - w.start).astype(U64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, across rows too."""
    if len(h) < n:
        return h[:0]
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = out * U64(BASE) + h[k : len(h) - n + 1 + k]
        return mix(out)


def gather(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the slices one after the other, and int32 offsets as Arrow has them."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return buffer[index], offsets.astype(np.int32)


assert (BASE * INVERSE) & MASK == 1
