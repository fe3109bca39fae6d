"""Hamming distances of many 64-bit codes at once, on bit planes.

Plane ``b`` holds bit ``b`` of all codes, eight codes to a byte. Comparing every code with the one
``shift`` places on is then an exclusive or of the planes with the planes moved by ``shift`` bits. The
differing bits are added up in vertical counters, two planes at a time with a carry-save adder. Lanes
are looked at in blocks, and a block is abandoned once all its lanes exceed the radius.
"""

from __future__ import annotations

import numpy as np

BITS = 64
BLOCK_BYTES = 64
STEP = 8


def planes_of(codes: np.ndarray) -> np.ndarray:
    """Bit planes, ``BITS`` rows of packed lanes; lane i is bit ``i % 8`` of byte ``i // 8``."""
    bits = np.unpackbits(codes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def moved(planes: np.ndarray, shift: int, width: int) -> np.ndarray:
    """The first ``width`` bytes of the planes once lane ``i + shift`` stands in lane ``i``."""
    first, bits = divmod(shift, 8)
    out = np.zeros((planes.shape[0], width), np.uint8)
    low = planes[:, first : first + width]
    out[:, : low.shape[1]] = low >> bits
    if bits:
        high = planes[:, first + 1 : first + 1 + width]
        out[:, : high.shape[1]] |= high << (8 - bits)
    return out


def above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius."""
    over = np.zeros_like(counters[0])
    equal = np.full_like(counters[0], 255)
    for b in reversed(range(len(counters))):
        if radius >> b & 1:
            equal &= counters[b]
        else:
            over |= equal & counters[b]
            equal &= ~counters[b]
    return over


def near_lanes(planes: np.ndarray, shift: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Indices of the valid lanes within ``radius`` of the lane ``shift`` places on.

    ``valid`` is packed like the planes and as wide as the part that is looked at.
    """
    width = len(valid)
    blocks = -(-width // BLOCK_BYTES)
    padded = blocks * BLOCK_BYTES

    def blocked(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((rows.shape[0], padded), np.uint8)
        out[:, : rows.shape[1]] = rows
        return out.reshape(rows.shape[0], blocks, BLOCK_BYTES)

    open_ = blocked(valid[None, :])[0]
    left, right = blocked(planes[:, :width]), blocked(moved(planes, shift, width))
    at = np.flatnonzero(open_.any(axis=1))
    size = (radius + 1).bit_length()
    counters = [np.zeros((len(at), BLOCK_BYTES), np.uint8) for _ in range(size)]
    open_ = open_[at]
    for step in range(0, BITS, STEP):
        if not len(at):
            break
        for b in range(step, step + STEP, 2):
            x, y = left[b, at] ^ right[b, at], left[b + 1, at] ^ right[b + 1, at]
            half = counters[0] ^ x
            carry = (counters[0] & x) | (half & y)
            counters[0] = half ^ y
            for k in range(1, size):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            open_ &= ~carry
            open_ &= ~above(counters, radius)
        alive = open_.any(axis=1)
        if not alive.all():
            at, open_ = at[alive], open_[alive]
            counters = [c[alive] for c in counters]
    found = np.zeros((blocks, BLOCK_BYTES), np.uint8)
    found[at] = open_
    return np.flatnonzero(np.unpackbits(found.reshape(-1), bitorder="little"))


def bucket_links(codes: np.ndarray, buckets: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between codes of one bucket within ``radius``: as many as connect what is connected.

    ``buckets`` numbers each code's bucket, in any order. Pairs that are connected already are not
    returned again, and a bucket that has become one component is left.
    """
    _, number, sizes = np.unique(buckets, return_inverse=True, return_counts=True)
    order = np.lexsort((number, -sizes[number]))
    codes, number = codes[order], number[order]
    size = sizes[number]
    many = int(np.count_nonzero(size > 1))
    codes, number, size = codes[:many], number[:many], size[:many]
    none = np.zeros(0, codes.dtype)
    if not many:
        return none, none
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    ends = np.repeat(np.r_[starts[1:], many], np.diff(np.r_[starts, many]))
    group = np.cumsum(np.r_[False, number[1:] != number[:-1]])
    parts = size[starts].copy()
    parent = np.arange(many)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    planes = planes_of(codes)
    left, right = [], []
    for shift in range(1, int(size[0])):
        lanes = int(np.count_nonzero(size > shift))
        spot = np.arange(lanes)
        wanted = (spot + shift < ends[:lanes]) & (parts[group[:lanes]] > 1)
        if not wanted.any():
            if not (parts[group[:lanes]] > 1).any():
                break
            continue
        near = near_lanes(planes, shift, np.packbits(wanted, bitorder="little"), radius)
        for i in near.tolist():
            a, b = root(i), root(i + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parts[group[i]] -= 1
                left.append(i)
                right.append(i + shift)
    return codes[left], codes[right]
