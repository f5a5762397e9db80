"""Vectorised work on the UTF-8 bytes of Arrow text columns: blocks of documents, word spans and rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: An odd multiplier has an inverse modulo 2**64, so that any slice of a prefix hash can be brought to one scale.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that one vectorised step takes, so that its 8-byte columns stay small; a longer document makes a step of its own.
BLOCK_BYTES = 1 << 18


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    n = len(flat)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def lists(column: pa.Array) -> tuple[pa.StructArray, np.ndarray]:
    """The structs in a column of lists, and the offsets of its rows; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes)])


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def powers(n: int, base: int = BASE) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("p", ())) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        _TABLES["p"], _TABLES["q"] = powers(size), powers(size, _INVERSE)
        if size > 8 * BLOCK_BYTES:  # one very long document: not kept
            return _TABLES.pop("p"), _TABLES.pop("q")
    return _TABLES["p"], _TABLES["q"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers (a public finaliser: xor-shifts and odd multipliers)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Rolling:
    """Hashes of any slices of one array of small numbers, from one prefix sum modulo 2**64."""

    def __init__(self, values: np.ndarray, spread: int = 0xD6E8FEB86659FD93):
        n = len(values)
        self.p, self.q = _powers(n + 1)
        # Values pass through a bijection first, so that the polynomial doesn't see small neighbouring digits.
        v = mixed(np.arange(256, dtype=np.uint64) + np.uint64(spread))[values] if values.dtype == np.uint8 else mixed(values ^ np.uint64(spread))
        self.h = np.zeros(n + 1, np.uint64)
        np.cumsum(v * self.p[:n], out=self.h[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.h[end] - self.h[start]) * self.q[start] + (end - start).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """Of every slice of ``length`` values."""
        n = len(self.h) - length
        return mixed((self.h[length:] - self.h[:n]) * self.q[:n] + np.uint64(length))


def separated(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with one line feed after each, and where each row starts."""
    return np.insert(raw, offsets[1:], 10).astype(np.uint8, copy=False), offsets[:-1] + np.arange(len(offsets) - 1)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
