"""Elias-Fano coding of monotone integer lists, queried by successor search, and files that hold them.

All queries take and return arrays. A list of n values below u takes about
2 + log2(u / n) bits a value.
"""

from __future__ import annotations

import json
import os
import struct
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np

_SUPER = 8  # words of 64 bits to a directory entry
_CHUNK = 1 << 17


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """values, each of `width` bits, end to end in 64-bit words, with a spare word behind."""
    n = len(values)
    words = np.zeros((n * width + 63) // 64 + 1, np.uint64)
    if width and n:
        at = np.arange(n, dtype=np.uint64) * np.uint64(width)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(words, word, values << off)
        over = off + np.uint64(width) > 64
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (np.uint64(64) - off[over]))
    return words


def _bit_of(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one of each word, by halving."""
    place = np.zeros(len(words), np.uint8)
    for half in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(words & np.uint64((1 << half) - 1))
        over = below <= k
        k = k - below * over
        step = over * np.uint8(half)
        words = words >> step
        place += step
    return place


def _bit_before(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Place of the last one of each word below the given place, -1 where there is none."""
    m = words & ((np.uint64(1) << place) - np.uint64(1))
    for half in (1, 2, 4, 8, 16, 32):
        m = m | (m >> np.uint64(half))
    return np.bitwise_count(m).astype(np.int64) - 1


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """values: unsigned and in rising order; equal neighbours are allowed."""
        v = np.ascontiguousarray(values, np.uint64)
        n = len(v)
        u = int(v[-1]) + 1 if n else 1
        bits = max(0, (u // max(n, 1)).bit_length() - 1)
        low = _pack_bits(v & np.uint64((1 << bits) - 1), bits)
        at = (v >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        size = int(at[-1]) + 2 if n else 1
        plain = np.zeros(-(-size // (64 * _SUPER)) * 64 * _SUPER, np.uint8)
        plain[at.astype(np.int64)] = 1
        high = np.packbits(plain, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).reshape(-1, _SUPER).sum(1))]).astype(np.uint32 if n < 1 << 32 else np.uint64)
        return cls(n, bits, low, high, ones)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.head": np.array([self.n, self.low_bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @classmethod
    def load(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = map(int, arrays[f"{name}.head"])
        return cls(n, bits, *(arrays[f"{name}.{x}"] for x in ("low", "high", "ones")))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        w = self.low_bits
        if not w:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(w)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.low[word] >> off
        cross = np.flatnonzero(off + np.uint64(w) > 64)
        out[cross] |= self.low[word[cross] + 1] << (np.uint64(64) - off[cross])
        return out & np.uint64((1 << w) - 1)

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Position of the k-th (from 0) one or zero of the upper bits."""
        out = np.empty(len(k), np.int64)
        full = self.ones.astype(np.int64)
        before = full if bit else np.arange(len(full), dtype=np.int64) * 64 * _SUPER - full
        for s in range(0, len(k), _CHUNK):
            kk = k[s : s + _CHUNK]
            block = np.searchsorted(before, kk, side="right") - 1
            words = self.high[block[:, None] * _SUPER + np.arange(_SUPER)]
            words = words if bit else ~words
            counts = np.bitwise_count(words)
            rest = (kk - before[block]).astype(np.int16)
            word, upto = np.zeros(len(kk), np.int64), np.zeros(len(kk), np.int16)
            past = np.zeros(len(kk), np.int16)
            for c in range(_SUPER - 1):
                upto += counts[:, c]
                over = upto <= rest
                word += over
                past[over] = upto[over]
            out[s : s + _CHUNK] = (block * _SUPER + word) * 64 + _bit_of(words[np.arange(len(kk)), word], rest - past)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, 1) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x, -1 where the list lacks it: successor search, by halving, among the values that share x's upper part."""
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        upper = x >> np.uint64(self.low_bits)
        live = np.flatnonzero(upper < np.uint64(len(self.high) * 64 - self.n))
        h = upper[live].astype(np.int64)
        at = self._select(h, 0)
        end = at - h
        last = _bit_before(~self.high[at >> 6], (at & 63).astype(np.uint64))
        low = (at & ~63) + last - (h - 1)  # the zero before is mostly in the same word
        low[h == 0] = 0
        far = np.flatnonzero((last < 0) & (h > 0))
        low[far] = self._select(h[far] - 1, 0) - (h[far] - 1)
        want = x[live] & np.uint64((1 << self.low_bits) - 1)
        top = end.copy()
        busy = np.flatnonzero(low < top)
        while len(busy):
            mid = (low[busy] + top[busy]) >> 1
            less = self._lows(mid) < want[busy]
            low[busy[less]] = mid[less] + 1
            top[busy[~less]] = mid[~less]
            busy = busy[low[busy] < top[busy]]
        ok = np.flatnonzero(low < end)
        ok = ok[self._lows(low[ok]) == want[ok]]
        out[live[ok]] = low[ok]
        return out


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one file that can be mapped into memory."""
    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = [a.dtype.str, at, len(a)]
        raw += b"\0" * (-len(raw) % 8)
        parts.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text + b"".join(parts)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Writes a file of the shared folder; a task that runs again replaces it as a whole."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        os.makedirs(os.path.dirname(parts.path), exist_ok=True)
        own = f"{parts.path}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            f.write(data)
        os.replace(own, parts.path)
        return
    store, path = _store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)


def exists(uri: str) -> bool:
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return os.path.exists(parts.path)
    store, path = _store(uri)
    return bool(store.get_file_info(path).type)


def discard(uri: str) -> None:
    """Removes a file; maps of it stay valid, and one that has gone is no error."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        if os.path.exists(parts.path):
            os.remove(parts.path)
        return
    if exists(uri):
        store, path = _store(uri)
        store.delete_file(path)


def open_mapped(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory; a store that can't be mapped is read through an unnamed local copy."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        raw = np.memmap(parts.path, np.uint8, "r")
    else:
        store, path = _store(uri)
        with store.open_input_stream(path) as f, tempfile.TemporaryFile() as copy:
            while block := f.read(1 << 24):
                copy.write(block)
            copy.flush()
            raw = np.memmap(copy, np.uint8, "r")
    n = struct.unpack("<Q", raw[:8].tobytes())[0]
    head = json.loads(raw[8 : 8 + n].tobytes())
    start = 8 + n
    return {name: raw[start + at : start + at + np.dtype(kind).itemsize * size].view(kind) for name, (kind, at, size) in head.items()}
