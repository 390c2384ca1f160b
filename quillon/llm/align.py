"""Banded alignment of integer sequences: the longest common subsequence inside a band, a row of the table in one integer."""

from __future__ import annotations

import numpy as np

#: Bits that the symbols' places may take as whole integers; beyond that, a row's bits are made from places within its band.
MOST_BITS = 128 << 20


def masks(b: np.ndarray, wanted: np.ndarray) -> dict[int, int]:
    """For each of the wanted symbols the places in b as bits."""
    order = np.argsort(b, kind="stable")
    wanted = np.unique(wanted)
    low, high = np.searchsorted(b, wanted, "left", sorter=order), np.searchsorted(b, wanted, "right", sorter=order)
    out = {}
    for x, i, j in zip(wanted.tolist(), low.tolist(), high.tolist(), strict=True):
        if j > i:
            bits = np.zeros(len(b), bool)
            bits[order[i:j]] = True
            out[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def places(b: np.ndarray, wanted: np.ndarray) -> dict[int, np.ndarray]:
    """For each of the wanted symbols its places in b, rising."""
    order = np.argsort(b, kind="stable")
    wanted = np.unique(wanted)
    low, high = np.searchsorted(b, wanted, "left", sorter=order), np.searchsorted(b, wanted, "right", sorter=order)
    return {x: order[i:j] for x, i, j in zip(wanted.tolist(), low.tolist(), high.tolist(), strict=True) if j > i}


def inside(at: np.ndarray, start: int, width: int) -> int:
    """Places from `start` on, `width` of them, as bits."""
    near = at[np.searchsorted(at, start) : np.searchsorted(at, start + width)] - start
    if len(near) < 4:
        return sum(1 << k for k in near.tolist())
    bits = np.zeros(width, bool)
    bits[near] = True
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def common(a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """The length of the longest common subsequence that pairs a[i] with b[i + low] .. b[i + high], and the end of the
    shortest beginning of b that has one so long."""
    width, small = high - low + 1, len(b) * min(len(a), len(b)) <= MOST_BITS
    bits = masks(b, a) if small else places(b, a)
    full = (1 << width) - 1
    row, base, last = full, 0, 0  # a bit is set where the length doesn't grow
    for i, x in enumerate(a.tolist()):
        at = i + low
        if i:  # the band moves on by one place
            if not row & 1:
                base, last = base + 1, at
            row = row >> 1 | 1 << (width - 1)
        if (match := bits.get(x)) is not None:
            hit = row & ((match >> at if at >= 0 else match << -at) if small else inside(match, at, width))
            row = (row + hit | row - hit) & full
    grows = row ^ full
    return base + grows.bit_count(), len(a) - 1 + low + grows.bit_length() if grows else last
