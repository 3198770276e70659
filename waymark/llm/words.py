"""Words, lines and hashes of many texts at once, as NumPy arrays.

A word is a run of bytes other than space and tab to carriage return, which in
UTF-8 is the same as ``[^\\x20\\x09-\\x0D]+`` over characters. All texts of a
slice lie in one byte buffer, so every step is a handful of array operations,
however many texts there are.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_BYTES = np.arange(256)
IS_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
LEADS = (_BYTES & 0xC0) != 0x80

#: Bytes beyond which a word is hashed by itself.
LONG_WORD = 256
_KEY = np.uint64(0x3C79AC492BA7B653)
#: Masks that keep the first k of eight bytes.
_LEADING = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice stay near ``limit`` bytes.

    A longer text makes a slice of its own. No row is dropped.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, at, data = column.buffers()
    first, n = column.offset, len(column)
    offsets = np.frombuffer(at, kind)[first : first + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits, one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A keyed 64-bit hash of each span's bytes; equal bytes have equal hashes.

    Eight bytes at a time go into a state that is mixed by shifts and products
    after each step, so no sum or power of bytes decides equality.
    """
    sizes = ends - starts
    state = mix(sizes.astype(np.uint64) + _KEY)
    eight = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", eight, 0, (1,))
    left = np.flatnonzero(sizes <= LONG_WORD)
    at = 0
    while len(left):
        rest = np.minimum(sizes[left] - at, 8)
        chunk = eight[starts[left] + at] & _LEADING[rest]
        state[left] = mix(state[left] ^ chunk) + _KEY
        at += 8
        left = left[sizes[left] > at]
    for k in np.flatnonzero(sizes > LONG_WORD):
        digest = blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest()
        state[k] = int.from_bytes(digest, "little")
    return state


@dataclass
class Words:
    """Words of the texts of a slice."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, *, lower: bool = False) -> Words:
        data, offsets = text_bytes(column)
        if lower:
            data = LOWER[data]
        return cls(data, offsets, *spans(~IS_SPACE[data], offsets))

    @cached_property
    def bounds(self) -> np.ndarray:
        """Of each text, the position of its first word; one more at the end."""
        return np.searchsorted(self.starts, self.offsets)

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @cached_property
    def texts(self) -> np.ndarray:
        """Of each word, the position of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def joined(self, chosen: np.ndarray) -> bytes:
        """The chosen words, in the given order, joined by one space."""
        if len(chosen) == 0:
            return b""
        starts, sizes = self.starts[chosen], self.ends[chosen] - self.starts[chosen]
        ends = np.cumsum(sizes + 1)
        at = np.arange(ends[-1]) - np.repeat(ends - sizes - 1 - starts, sizes + 1)
        gap = ends - 1
        at[gap] = 0
        out = self.data[at]
        out[gap] = 32
        return out[:-1].tobytes()

    @cached_property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of ``inside``, cut where a text begins."""
    n = len(inside)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = inside & cut[:n]
    first[1:] |= inside[1:] & ~inside[:-1]
    last = inside & cut[1:]
    last[:-1] |= inside[:-1] & ~inside[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def release(*caches) -> None:
    """Give a task's tables back: its worker lives on and serves other stages."""
    for cached in caches:
        cached.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum ``values`` over each text's range; an empty range sums to zero."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
