"""Words and pieces of texts as numpy arrays: UTF-8 buffers, places, and a hash table whose keys are short pieces.

A piece of up to 15 bytes is two numbers: its first 8 bytes, and its further bytes with its length on top. So equal
numbers mean equal pieces, and many pieces are looked up at once.
"""

from __future__ import annotations

import numpy as np

#: The lowest k bytes of a number, for k from 0 to 8.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longest piece that two numbers hold.
SHORT = 15


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of an Arrow string column, without a copy; a null has no bytes."""
    import pyarrow as pa

    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not offsets.size:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return held, bounds - bounds[0]


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The same of a list."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every span, one span after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_places(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of bytes other than ASCII white space; no run goes beyond its text."""
    inside = np.concatenate([[False], (data != 32) & ((data < 9) | (data > 13)), [False]])
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    starts[edges] = inside[1:-1][edges]
    ends[edges - 1] = inside[1:-1][edges - 1]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1 - at


def short_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers of pieces of up to SHORT bytes."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eights = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))
    first = np.minimum(lengths, 8)
    return eights[starts] & _MASKS[first], (eights[starts + first] & _MASKS[lengths - first]) | (lengths.astype(np.uint64) << np.uint64(56))


def short_bytes(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all pieces, lengths), back from their numbers."""
    lengths = (high >> np.uint64(56)).astype(np.int64)
    rows = np.stack([low, high], 1).view(np.uint8).reshape(-1, 16)
    return rows[np.arange(16) < lengths[:, None]], lengths


def distinct_keys(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of every distinct key, for each key the number of its distinct key)."""
    order = np.lexsort((high, low))
    new = np.append(True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]))[: len(order)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class Table:
    """A hash table with open addressing from keys to numbers from 0 on."""

    def __init__(self, bits: int = 14):
        self.count = 0
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits, self.low, self.high, self.value = bits, np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of every key, -1 for those not held."""
        out, left, at, mask = np.full(len(low), -1, np.int64), np.arange(len(low)), self._slot(low, high), (1 << self.bits) - 1
        while len(left):
            value = self.value[at]
            same = (self.low[at] == low[left]) & (self.high[at] == high[left]) & (value >= 0)
            out[left[same]] = value[same]
            more = ~same & (value >= 0)
            left, at = left[more], (at[more] + 1) & mask
        return out

    def add(self, low: np.ndarray, high: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct keys that aren't held yet."""
        self.count += len(low)
        if 2 * self.count > 1 << self.bits:
            kept = self.value >= 0
            held = self.low[kept], self.high[kept], self.value[kept]
            self._clear(self.count.bit_length() + 1)
            self._put(*held)
        self._put(low, high, numbers)

    def _put(self, low: np.ndarray, high: np.ndarray, numbers: np.ndarray) -> None:
        at, mask = self._slot(low, high), (1 << self.bits) - 1
        while len(at):
            free = self.value[at] < 0
            self.value[at[free]] = numbers[free]
            won = free & (self.value[at] == numbers)
            self.low[at[won]], self.high[at[won]] = low[won], high[won]
            low, high, numbers, at = low[~won], high[~won], numbers[~won], (at[~won] + 1) & mask
