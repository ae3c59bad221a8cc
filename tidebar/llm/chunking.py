"""Content-defined cuts: a gear rolling hash over bytes or token ids, so equal runs are cut alike."""

from __future__ import annotations

import numpy as np

_WINDOW = 32


def _gear(values: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random 32-bit number for each symbol."""
    x = values.astype(np.uint32)
    x = (x + np.uint32(0x9E3779B9)) * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


_BYTE_GEAR = _gear(np.arange(256))


def cut_candidates(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Positions after which a cut may be made; one in 2**bits, decided by the last 32 symbols alone."""
    h = _BYTE_GEAR[symbols] if symbols.dtype == np.uint8 else _gear(symbols)
    width = 1
    while width < _WINDOW:
        if len(h) > width:
            nxt = h.copy()
            nxt[width:] += h[:-width] << np.uint32(width)
            h = nxt
        width *= 2
    return np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1


def cuts(candidates: np.ndarray, start: int, end: int, least: int, most: int) -> list[int]:
    """Chunk ends of symbols[start:end]; ``least`` must be at least the window of the hash."""
    out, at = [], start
    if end - start > least:
        lo, hi = np.searchsorted(candidates, (start + least, end))
        for c in candidates[lo:hi].tolist():
            while c - at > most:
                at += most
                out.append(at)
            if c - at >= least:
                at = c
                out.append(c)
    while end - at > most:
        at += most
        out.append(at)
    if end > at:
        out.append(end)
    return out
