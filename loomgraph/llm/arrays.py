"""Words of Arrow text columns as 64-bit codes, and compressed blocks of arrays, without a Python step per word."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Characters of a word that have random codes of their own; later ones are those of a multiple.
PLACES = 64
#: Bytes that are coded at a time.
STEP = 1 << 18
CODES = np.random.default_rng(20_240_229).integers(0, 1 << 64, PLACES * 256, np.uint64, endpoint=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; a null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def string_codes(chars: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The codes of the strings of bytes that start at `head`, each up to the next start."""
    bounds = np.r_[head, len(chars)]
    out = np.empty(len(head), np.uint64)
    # Some strings at a time, so that what is held per byte stays small.
    cuts = [0, *np.unique(np.searchsorted(bounds, np.arange(STEP, len(chars), STEP))).tolist(), len(head)]
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        size = np.diff(bounds[a : b + 1])
        some = chars[bounds[a] : bounds[b]]
        start = bounds[a:b] - bounds[a]
        place = np.arange(len(some)) - np.repeat(start, size)
        with np.errstate(over="ignore"):
            value = CODES[((place & (PLACES - 1)) << 8) | some]
            if size.max() > PLACES:
                late = place >= PLACES
                value[late] *= mix((place[late] // PLACES).astype(np.uint64)) | np.uint64(1)
            np.add.reduceat(value, start, out=out[a:b])
    return out


def word_codes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(code of every word, n + 1 bounds of each text's words).

    Words are the maximal runs outside ASCII white space, A-Z lower-cased. Equal words have equal
    codes; two different ones share a code with probability 2 to the power -64.
    """
    raw, at = buffer(column)
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    ink = ~BLANK[raw]
    first = np.empty(len(raw), bool)
    first[0] = True
    np.logical_not(ink[:-1], out=first[1:])
    first[at[:-1][at[:-1] < len(raw)]] = True
    first &= ink
    start = np.flatnonzero(first)
    bounds = np.searchsorted(start, at)
    if not len(start):
        return np.empty(0, np.uint64), bounds
    return string_codes((LOWER[raw] if lower else raw)[ink], np.flatnonzero(first[ink])), bounds


class Lookup:
    """Places of up to some hundred thousand distinct codes, as levels of open tables."""

    def __init__(self, codes: np.ndarray):
        self.levels = []
        left = np.arange(len(codes))
        bits = max(4, int(len(codes)).bit_length() + 1)
        while len(left):
            slot = (mix(codes[left] + np.uint64(len(self.levels))) >> np.uint64(64 - bits)).astype(np.int64)
            _, one = np.unique(slot, return_index=True)
            table, place = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            table[slot[one]], place[slot[one]] = codes[left[one]], left[one]
            self.levels.append((bits, table, place))
            left = np.delete(left, one)
            bits = max(4, int(len(left)).bit_length() + 1)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code, -1 for those not held."""
        out = np.full(len(codes), -1, np.int32)
        open_, some = np.arange(len(codes)), codes
        for k, (bits, table, place) in enumerate(self.levels):
            slot = (mix(some + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64)
            hit = (table[slot] == some) & (place[slot] >= 0)
            out[open_[hit]] = place[slot[hit]]
            open_, some = open_[~hit], some[~hit]
        return out


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """The arrays as one compressed block, bytes of equal weight side by side."""
    head, body = [struct.pack("<i", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(struct.pack("<4sq", a.dtype.str.encode(), len(a)))
        body.append(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
    return b"".join(head) + zstandard.ZstdCompressor(level).compress(b"".join(body))


def unpack(block: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<i", block)
    at = 4 + n * 12
    body, out, pos = zstandard.ZstdDecompressor().decompress(memoryview(block)[at:]), [], 0
    for k in range(n):
        kind, size = struct.unpack_from("<4sq", block, 4 + k * 12)
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        planes = np.frombuffer(body, np.uint8, size * dtype.itemsize, pos).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(-1))
        pos += size * dtype.itemsize
    return out
