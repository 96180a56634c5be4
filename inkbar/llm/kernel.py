"""Word and byte kernels over Arrow text columns, vectorised with numpy.

Everything here is a pure function of one Arrow slice.  Slices are bounded by
bytes of text (``pieces``), so memory does not depend on how many rows Spark puts
into a batch; a text longer than the bound is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 21


def _class(chars: bytes, above: bool) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars, dtype=np.uint8)] = True
    table[128:] = above
    return table


# bytes that belong to a token, by kind of token
NOT_SPACE = ~_class(b" \t\n\x0b\x0c\r", False)
LETTERS = _class(bytes(range(65, 91)) + bytes(range(97, 123)), True)
ALNUM = LETTERS | _class(b"0123456789", True)

_rng = np.random.Generator(np.random.PCG64(20240229))
_MIX = _rng.integers(1, 2**64, size=256, dtype=np.uint64) | np.uint64(1)
_SHINGLE = _rng.integers(1, 2**64, size=64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not len(column):
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
        start, base = 0, 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


class Tokens:
    """Maximal runs of member bytes: hashes, byte ranges, and offsets by row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        inside = member[data]
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        firsts = offsets[:-1][offsets[:-1] < len(data)]
        before[firsts] = False  # a token does not reach over rows
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:] & before[1:]
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(self.start, offsets)  # first token of each row
        self.data = data
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        if not len(self):
            return np.zeros(0, dtype=np.uint64)
        length = self.end - self.start
        power = np.cumprod(np.full(int(length.max()), _BASE, dtype=np.uint64))
        at = self._places()
        np.clip(at, 0, len(power) - 1, out=at)
        value = np.where(self.inside, _MIX[self.data], np.uint64(0))
        value *= power[at]
        return mix(np.add.reduceat(value, self.start) + length.astype(np.uint64))

    def _places(self) -> np.ndarray:
        first = self.start[0]
        steps = np.diff(np.append(self.start, len(self.data)))
        at = np.arange(len(self.data))
        at[first:] -= np.repeat(self.start, steps)
        at[:first] = 0
        return at

    def strings(self, which: np.ndarray) -> list[str]:
        raw = self.data.tobytes()
        return [
            raw[s:e].decode("utf-8", "replace")
            for s, e in zip(self.start[which].tolist(), self.end[which].tolist())
        ]


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def windows(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` tokens inside a row, and offsets by row.

    ``row`` holds the first token of each row, with the end as its last entry.  A
    row of fewer tokens (but one at least) has one window, of all its tokens.
    """
    count = np.diff(row)
    n_windows = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    at = np.zeros(len(row), dtype=np.int64)
    np.cumsum(n_windows, out=at[1:])
    if not at[-1]:
        return np.zeros(0, dtype=np.uint64), at
    padded = np.concatenate([hashes, np.zeros(size, dtype=np.uint64)])
    total = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(size):
        total += padded[k : k + len(hashes)] * _SHINGLE[k]
    first = np.repeat(row[:-1] - at[:-1], n_windows) + np.arange(at[-1])
    out = total[first]
    for i in np.flatnonzero((count > 0) & (count < size)).tolist():
        tokens = hashes[row[i] : row[i + 1]]
        out[at[i]] = np.sum(tokens * _SHINGLE[: len(tokens)], dtype=np.uint64) + np.uint64(
            len(tokens)
        )
    return mix(out), at
