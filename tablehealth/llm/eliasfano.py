"""Elias-Fano coding of non-decreasing integers, as numpy arrays that can lie in a mapped file.

The low bits of each value are packed side by side. The high bits stand in a bit vector in unary: value i with high
part h sets bit ``h + i``. Counts of ones before each 64-bit word make both kinds of bit selectable. All
operations take and return whole arrays.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile

import numpy as np
from pyarrow import fs

_U = np.uint64


def _byte_selects() -> np.ndarray:
    """Place of the set bit of each rank in each byte, at ``byte * 8 + rank``."""
    table = np.zeros((256, 8), np.int64)
    for byte in range(256):
        places = [b for b in range(8) if byte >> b & 1]
        table[byte, : len(places)] = places
    return table.reshape(-1)


_BYTES = _byte_selects()


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit with this rank in each word."""
    place = np.zeros(len(word), np.int64)
    for step in (32, 16, 8):
        ones = np.bitwise_count(word & _U((1 << step) - 1)).astype(np.int64)
        on = rank >= ones
        rank = rank - ones * on
        shift = step * on
        word = word >> shift.astype(np.uint64)
        place += shift
    return place + _BYTES[(word & _U(255)).astype(np.int64) * 8 + rank]


class EliasFano:
    """``n`` values with ``width`` low bits each."""

    PARTS = ("low", "high", "ones", "zeros")

    def __init__(self, n: int, width: int, top: int, parts: dict[str, np.ndarray]) -> None:
        self.n, self.width, self.top = n, width, top
        self.low, self.high, self.ones, self.zeros = (parts[p] for p in self.PARTS)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """From a sorted uint64 array."""
        n = len(values)
        last = int(values[-1]) if n else 0
        width = max(0, ((last + 1) // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width and n:
            bits = values & _U((1 << width) - 1)
            at = np.arange(n, dtype=np.int64) * width
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, bits << shift)
            over = (at & 63) + width > 64
            np.bitwise_or.at(low, word[over] + 1, bits[over] >> (_U(64) - shift[over]))
        upper = (values >> _U(width)).astype(np.int64) + np.arange(n)
        top = last >> width
        high = np.zeros((n + top + 1) // 64 + 1, np.uint64)
        np.bitwise_or.at(high, upper >> 6, _U(1) << (upper & 63).astype(np.uint64))
        ones = np.r_[0, np.cumsum(np.bitwise_count(high).astype(np.int64))][:-1]
        zeros = np.arange(len(high)) * 64 - ones
        small = np.uint32 if len(high) * 64 < 1 << 32 else np.int64
        return cls(n, width, top, {"low": low, "high": high, "ones": ones.astype(small), "zeros": zeros.astype(small)})

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift
        rest = self.low[word + 1] << ((_U(64) - shift) & _U(63))
        value |= np.where(shift > 0, rest, _U(0))
        return value & _U((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at these places."""
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), "right") - 1
        bit = _select_in_word(self.high[word], i - self.ones[word]) + word * 64
        return ((bit - i).astype(np.uint64) << _U(self.width)) | self._lows(i)

    def _before(self, part: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part."""
        out = np.zeros(len(part), np.int64)
        out[part > self.top] = self.n
        some = np.flatnonzero((part > 0) & (part <= self.top))
        k = part[some] - 1
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), "right") - 1
        bit = _select_in_word(~self.high[word], k - self.zeros[word]) + word * 64
        out[some] = bit - k
        return out

    def find(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each x within its range, by its first successor there; -1 where it is not."""
        part = (x >> _U(self.width)).astype(np.int64)
        want = x & _U((1 << self.width) - 1)
        a, b = np.maximum(start, self._before(part)), np.minimum(end, self._before(part + 1))
        stop = b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            less = self._lows(middle) < want[open_]
            a[open_] = np.where(less, middle + 1, a[open_])
            b[open_] = np.where(less, b[open_], middle)
            open_ = open_[a[open_] < b[open_]]
        found = np.full(len(x), -1, np.int64)
        some = np.flatnonzero(a < stop)
        hit = some[self._lows(a[some]) == want[some]]
        found[hit] = a[hit]
        return found


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file:")


def save(uri: str, numbers: dict[str, int], arrays: dict[str, np.ndarray]) -> None:
    """Write named numbers and arrays as one file."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 8) * 8
    text = json.dumps({"numbers": numbers, "arrays": head}).encode()
    text += b" " * (-len(text) % 8)
    system, path = _opened(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(path) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


def load(uri: str) -> tuple[dict[str, int], dict[str, np.ndarray]]:
    """Map a file that ``save`` wrote. One from a remote store is copied to a file without a name first."""
    system, path = _opened(uri)
    if isinstance(system, fs.LocalFileSystem):
        source = open(path, "rb")
    else:
        source = tempfile.TemporaryFile()
        with system.open_input_stream(path) as given:
            while block := given.read(1 << 22):
                source.write(block)
        source.flush()
    with source:
        data = mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(data[:8], "little")
    head = json.loads(data[8 : 8 + size])
    arrays = {
        name: np.frombuffer(data, kind, count, 8 + size + at)
        for name, (kind, count, at) in head["arrays"].items()
    }
    return head["numbers"], arrays


def packed(name: str, code: EliasFano) -> tuple[dict[str, int], dict[str, np.ndarray]]:
    """What ``save`` needs of a sequence."""
    numbers = {f"{name}.n": code.n, f"{name}.width": code.width, f"{name}.top": code.top}
    return numbers, {f"{name}.{p}": getattr(code, p) for p in EliasFano.PARTS}


def unpacked(name: str, numbers: dict[str, int], arrays: dict[str, np.ndarray]) -> EliasFano:
    return EliasFano(
        *(numbers[f"{name}.{x}"] for x in ("n", "width", "top")),
        {p: arrays[f"{name}.{p}"] for p in EliasFano.PARTS},
    )
