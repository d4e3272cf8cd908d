"""Byte-level helpers that the text operators share.

Operators read Arrow string columns as flat UTF-8 buffers and work on them with numpy, so the
cost of a word is a few vector operations and not a Python object. All of them cut a batch into
slices of about SLICE_BYTES, so memory does not follow the size of Spark's batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Spans of up to so many 8-byte lanes are hashed by lanes, longer ones by blake2b.
LANES = 4
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_KEYS = mix(np.arange(1, 4, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of data[s:e] for every span; equal bytes have equal hashes.

    Spans of one size of up to 8 bytes never collide: a mixer is a bijection. Up to 8 * LANES
    bytes two chains of lanes, differently keyed and mixed, are joined; longer spans are hashed
    by blake2b. Where a wrong match would change a result, callers compare bytes (same_bytes).
    """
    sizes = ends - starts
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    keys = mix(_KEYS + np.uint64(seed))
    out = mix((sizes.astype(np.uint64) + keys[0]) ^ mix(lanes[np.minimum(starts, len(data))] & _MASKS[np.minimum(sizes, 8)]))
    which = np.flatnonzero((sizes > 8) & (sizes <= 8 * LANES))
    if len(which):
        a, b = out[which], np.full(len(which), keys[1])
        rest, at = sizes[which], starts[which]
        for lane in range(-(-int(rest.max()) // 8)):
            left = np.clip(rest - 8 * lane, 0, 8)
            word = lanes[np.minimum(at + 8 * lane, len(data))] & _MASKS[left]
            more = left > 0
            if lane:
                a = np.where(more, mix(a ^ word), a)
            b = np.where(more, _turned(b ^ (word * keys[2]), 29) * np.uint64(0xD6E8FEB86659FD93) + word, b)
        out[which] = mix(a ^ mix(b))
    key = int(keys[1]).to_bytes(8, "little")
    for i in np.flatnonzero(sizes > 8 * LANES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
    return out


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether data[s:e] equals other[f:t], span by span."""
    sizes = ends - starts
    out = sizes == to - from_
    which = np.flatnonzero(out & (sizes > 0))
    n = sizes[which]
    differs = data[ragged(starts[which], n)] != other[ragged(from_[which], n)]
    if differs.any():
        out[which[np.repeat(np.arange(len(which)), n)[differs]]] = False
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes (len(words) - k + 1 of them)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out ^= words[i : i + n]
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out)


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of the ranges offset .. offset + length."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(offsets - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about `limit` bytes of text: (rows, bytes, offsets)."""
    for batch in batches:
        data, at = utf8(batch.column(batch.schema.get_field_index(text)))
        first, n = 0, batch.num_rows
        while first < n:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that do not cross a row's border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(inside))]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many spans begin before each row: bounds[i]:bounds[i + 1] are those of row i."""
    return np.searchsorted(starts, offsets, "left")


class Store:
    """A bounded map from byte strings to short integer sequences, kept in flat arrays. Strings
    are found by hash and compared byte by byte, so a colliding hash costs time and no result."""

    def __init__(self, kind: type, most: int) -> None:
        self.kind, self.most = kind, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.offsets = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.kind)
        self.bytes = np.zeros(0, np.uint8)
        self.spans = np.zeros(1, np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slots[at], -1)

    def _add(self, keys: np.ndarray, raw: np.ndarray, sizes: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Adds sorted new keys, their strings and sequences laid end to end; returns their slots."""
        new = np.arange(len(keys), dtype=np.int64) + len(self.lengths)
        starts = np.cumsum(lengths) - lengths + len(self.flat)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, new)
        self.lengths, self.offsets = np.concatenate([self.lengths, lengths]), np.concatenate([self.offsets, starts])
        self.flat = np.concatenate([self.flat, flat.astype(self.kind)])
        self.bytes, self.spans = np.concatenate([self.bytes, raw]), np.concatenate([self.spans, self.spans[-1] + np.cumsum(sizes)])
        return new

    def sequences(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of the spans of a buffer, laid end to end, and their lengths. `make`
        gives those of the spans at some places; it is asked once for each new string."""
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        keys = span_hashes(data, starts, ends)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        sizes = ends - starts
        head = first[inverse]
        apart = sizes != sizes[head]
        long = np.flatnonzero((sizes > 8) & (head != np.arange(len(head))))
        apart[long] = ~same_bytes(data, starts[long], ends[long], data, starts[head[long]], ends[head[long]])
        slots = self._find(distinct)
        known = np.flatnonzero(slots >= 0)
        same = same_bytes(data, starts[first[known]], ends[first[known]], self.bytes, self.spans[slots[known]], self.spans[slots[known] + 1])
        clash = np.zeros(len(distinct), bool)
        clash[known[~same]] = True
        odd = apart | clash[inverse]
        new = np.flatnonzero(slots < 0)
        if len(new):
            if len(self.keys) + len(new) > self.most:
                self.clear()
                new = np.arange(len(distinct))
                odd = apart
            at = first[new]
            raw = data[ragged(starts[at], sizes[at])]
            slots[new] = self._add(distinct[new], raw, sizes[at], *make(at))
        slots = slots[inverse]
        lengths = self.lengths[slots]
        if not odd.any():
            return self.flat[ragged(self.offsets[slots], lengths)], lengths
        which = np.flatnonzero(odd)
        own, lengths[which] = make(which)
        at = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), self.kind)
        out[ragged(at[which], lengths[which])] = own
        rest = np.flatnonzero(~odd)
        out[ragged(at[rest], lengths[rest])] = self.flat[ragged(self.offsets[slots[rest]], lengths[rest])]
        return out, lengths
