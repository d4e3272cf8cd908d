"""SentencePiece encoding and decoding with byte offsets into the original text.

A text is normalised by the model's own rules: at each place the longest prefix found in the
compiled character map (a double-array trie) is replaced, else one character is copied, and the
source offset of every normalised byte is recorded. The normalised text is cut into pieces by
the library, with a copy of the model that normalises nothing, and the recorded alignment takes
every piece back to a span of original bytes. Spans follow each other and cover the text: a
dummy prefix has an empty span, a byte piece has the span of its one byte.

Whole buffers are normalised at once: the trie is entered only where a byte begins one of its
keys, all other characters are copied by vector operations, and both write the same alignment.
Where no piece of the vocabulary crosses a space mark or a line end, the normalised rows are cut
there, each distinct chunk is encoded once, and a bounded store that compares bytes holds its
ids. Rows of other models are chunks of their own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import _text

MARK = "▁"
_NORMAL, _CONTROL, _BYTE = 1, 3, 6


class CharacterMap:
    """A compiled character map: u32 trie size, trie units, then NUL-ended replacements."""

    def __init__(self, raw: bytes) -> None:
        size = int.from_bytes(raw[:4], "little") if len(raw) > 4 else 0
        self.units = np.frombuffer(raw, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = raw[4 + size :] if size else b""
        self.begins = np.zeros(256, bool)
        if self.units:
            root = self._step(self.units[0])
            self.begins[[c for c in range(1, 256) if (root ^ c) < len(self.units) and self.units[root ^ c] & 0x800000FF == c]] = True

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int, end: int | None = None) -> tuple[bytes, int] | None:
        """The replacement of the longest prefix of data[at:end] in the map and its length."""
        units = self.units
        if not units:
            return None
        step = self._step
        node, found = step(units[0]), None
        for i in range(at, len(data) if end is None else end):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[0])
        return self.replacements[found[0] : end], found[1]


class Codec:
    """Encoder and decoder of one model file, for flat UTF-8 buffers."""

    def __init__(self, file: str, add_bos: bool = False, add_eos: bool = True, most_chunks: int = 1_500_000) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(file, "rb") as src:
            raw = src.read()
        model = pb.ModelProto()
        model.ParseFromString(raw)
        rules = model.normalizer_spec
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.dummy, self.tidy, self.escape = rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        kinds = [p.type for p in model.pieces]
        texts = [p.piece for p in model.pieces]
        self.before = [self.library.bos_id()] if add_bos else []
        self.after = [self.library.eos_id()] if add_eos else []
        self.kinds = kinds
        plain_kinds = {_NORMAL, _CONTROL, _BYTE, 2}
        #: No id is lost in its piece's text, so spans and decoded text follow from the ids.
        self.plain_kinds = {*kinds} <= {2, _NORMAL, _CONTROL, _BYTE} and kinds.count(_BYTE) == 256
        self.cuts = self.plain_kinds and self.escape and not self.suffix and not any("\n" in t or MARK in t.lstrip(MARK) for t, k in zip(texts, kinds, strict=True) if k == _NORMAL)
        shown = [bytes([int(t[3:5], 16)]) if k == _BYTE else t.replace(MARK, " ").encode() if k == _NORMAL else b"" for t, k in zip(texts, kinds, strict=True)]
        self.sizes = np.array([len(x) for x in shown], np.int64)
        #: Bytes of each id in the normalised text.
        self.widths = np.array([1 if k == _BYTE else len(t.encode()) if k == _NORMAL else 0 for t, k in zip(texts, kinds, strict=True)], np.int64)
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.cumsum(self.sizes) - self.sizes
        digits = [str(i).encode() + b" " for i in range(len(texts))]
        self.digit_sizes = np.array([len(x) for x in digits], np.int64)
        self.digits = np.zeros((len(texts), int(self.digit_sizes.max())), np.uint8)
        for i, x in enumerate(digits):
            self.digits[i, : len(x)] = np.frombuffer(x, np.uint8)
        rules.name, rules.precompiled_charsmap = "identity", b""
        rules.add_dummy_prefix = rules.remove_extra_whitespaces = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.store = _text.Store(np.uint32, most_chunks)
        #: Decoding is the pieces' texts end to end, without the dummy prefix.
        self.simple = self.plain_kinds and self.dummy and not self.tidy and self.escape and not self.suffix

    # --- encoding

    def normalised(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows of a flat buffer: normalised bytes, the rows' bounds in them, for each byte
        its source offset within its row, and each row's source offset where its last byte's
        source ends. A copied byte comes from itself, a replaced prefix's bytes from its first
        one, a dummy prefix from the character that it stands before. Bytes that are no UTF-8
        become U+FFFD."""
        data, offsets, where = self._whole(data, offsets)
        rows = len(offsets) - 1
        flat, source = data, np.arange(len(data))
        if self.map.begins.any():
            start = np.flatnonzero((data & 0xC0) != 0x80)
            row_end = offsets[np.searchsorted(offsets, start, "right")] if len(start) else start
            keep, raw, after = np.ones(len(data), bool), data.tobytes(), 0
            into, by = [], []
            for i in np.flatnonzero(self.map.begins[data[start]]).tolist():
                at = int(start[i])
                if at >= after and (found := self.map.longest(raw, at, int(row_end[i]))):
                    after = at + found[1]
                    keep[at:after] = False
                    into.append(at)
                    by.append(found[0])
            lengths = np.array([len(x) for x in by], np.int64)
            flat = np.concatenate([data[keep], np.frombuffer(b"".join(by), np.uint8)])
            source = np.concatenate([np.flatnonzero(keep), np.repeat(np.array(into, np.int64), lengths)])
            order = np.argsort(source, kind="stable")
            flat, source = flat[order], source[order]
        row = np.searchsorted(offsets, source, "right") - 1 if self.map.begins.any() or self.tidy else np.repeat(np.arange(rows), np.diff(offsets))
        space, ends = flat == 0x20, offsets[1:].copy()
        if self.tidy and len(flat):
            first = np.concatenate([[True], row[1:] != row[:-1]])
            again = space & (first | np.concatenate([[False], space[:-1]]))
            flat, source, row, space = (x[~again] for x in (flat, source, row, space))
            last = np.concatenate([row[1:] != row[:-1], [True]])[: len(row)] & space
            ends[row[last]] = source[last]
            flat, source, row, space = (x[~last] for x in (flat, source, row, space))
        counts = np.bincount(row, minlength=rows)
        if self.dummy:
            some = np.flatnonzero(counts if self.tidy else np.diff(offsets))
            bounds = np.concatenate([[0], np.cumsum(counts)])
            spot, at = (bounds[some + 1], ends[some]) if self.suffix else (bounds[some], offsets[some])
            if self.tidy and not self.suffix:
                at = source[bounds[some]]
            flat, source, space = np.insert(flat, spot, 0x20), np.insert(source, spot, at), np.insert(space, spot, True)
            counts[some] += 1
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if self.escape:
            width = np.where(space, 3, 1)
            total = np.concatenate([[0], np.cumsum(width)])
            flat, source, bounds = np.repeat(flat, width), np.repeat(source, width), total[bounds]
            marks = total[1:][space] - 3
            for i, byte in enumerate(MARK.encode()):
                flat[marks + i] = byte
        begin = where(offsets[:-1])
        return flat, bounds, where(source) - np.repeat(begin, np.diff(bounds)), where(ends) - begin

    @staticmethod
    def _whole(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        """The buffer as it is: Spark's strings are UTF-8; only bytes that are not are replaced."""
        try:
            data.tobytes().decode()
            return data, offsets, lambda x: x
        except UnicodeDecodeError:
            pass
        parts, places, bounds = [], [], [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            at, own = a, []
            for char in data[a:b].tobytes().decode("utf-8", "surrogateescape"):
                fixed = char.encode() if not 0xDC80 <= ord(char) <= 0xDCFF else "\ufffd".encode()
                own.append(fixed)
                places += [at] * len(fixed)
                at += 1 if 0xDC80 <= ord(char) <= 0xDCFF else len(fixed)
            parts.append(b"".join(own))
            bounds.append(bounds[-1] + len(parts[-1]))
        known = np.array([*places, int(offsets[-1])], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.array(bounds, np.int64), lambda x: known[x]

    def _chunks(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of the chunks of normalised rows: before every run of marks, around line ends."""
        n = len(data)
        edge = np.zeros(n, bool)
        if self.cuts and n > 2:
            mark = np.zeros(n + 3, bool)
            mark[3:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
            edge |= mark[3:] & ~mark[:-3]
            line = data == 0x0A
            edge[1:] |= line[1:] | line[:-1]
        edge[bounds[:-1][np.diff(bounds) > 0]] = True
        return np.flatnonzero(edge)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a flat buffer's rows: ids end to end, the source offset within its row at which
        each id's span ends (a span begins where the one before ends), and ids for each row."""
        flat, bounds, align, row_end = self.normalised(data, offsets)
        starts = self._chunks(flat, bounds)
        stops = np.append(starts[1:], len(flat))[: len(starts)]

        def make(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            texts = [flat[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[places].tolist(), stops[places].tolist(), strict=True)]
            got = self.plain.encode(texts, num_threads=1)
            lengths = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter((i for x in got for i in x), np.uint32, int(lengths.sum())), lengths

        if self.plain_kinds:
            ids, lengths = self.store.sequences(flat, starts, stops, make)
            ids = ids.astype(np.int64)
            widths = self.widths[ids]
        else:  # a piece's text may be any: take it from the library, row by row
            pieces = [self.plain.encode(flat[a:b].tobytes().decode("utf-8", "replace"), return_type="proto").pieces for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            ids = np.array([p.id for own in pieces for p in own], np.int64)
            widths = np.array([1 if self.kinds[p.id] == _BYTE else len(p.surface.encode()) for own in pieces for p in own], np.int64)
            lengths = np.array([len(own) for own in pieces], np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.diff(total[np.searchsorted(starts, bounds, "left")])
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.minimum(np.cumsum(widths), bounds[row + 1]) if len(ids) else np.zeros(0, np.int64)
        whole = place >= bounds[row + 1]
        ends = np.where(whole, row_end[row], align[np.minimum(place, max(0, len(align) - 1))] if len(align) else place)
        if self.after:
            at = np.cumsum(counts)
            ids, ends, counts = np.insert(ids, at, self.after[0]), np.insert(ends, at, np.diff(offsets)), counts + 1
        if self.before:
            at = np.cumsum(counts) - counts
            ids, ends, counts = np.insert(ids, at, self.before[0]), np.insert(ends, at, 0), counts + 1
        return ids, ends, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of the library's decode() of each row's ids."""
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if not self.simple:
            return [self.library.decode(ids[a:b].tolist()).encode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        sizes = self.sizes[ids]
        data = self.shown[_text.ragged(self.shown_at[ids], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = total[bounds].tolist()
        unknown = self.library.unk_id()
        odd = {*(np.searchsorted(bounds, np.flatnonzero(ids == unknown), "right") - 1).tolist()}
        out = []
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            raw = data[a:b].tobytes()
            try:
                raw.decode()
            except UnicodeDecodeError:
                odd.add(i)
            out.append(raw[1:] if raw.startswith(b" ") else raw)
        for i in odd:
            out[i] = self.library.decode(ids[bounds[i] : bounds[i + 1]].tolist()).encode()
        return out

    def decimals(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each row's ids as decimals joined by one space."""
        width = np.arange(self.digits.shape[1])
        flat = self.digits[ids][width < self.digit_sizes[ids][:, None]]
        total = np.concatenate([[0], np.cumsum(self.digit_sizes[ids])])
        at = total[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [flat[a : max(a, b - 1)].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


_PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])


def encode(docs: DataFrame, file: str, add_bos: bool = False, add_eos: bool = True) -> DataFrame:
    """doc_id, ids, and the byte offsets in the text at which the ids' spans end, for every row.
    A null or empty text has only the ids that are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(file, add_bos, add_eos)
        for rows, data, at in _text.slices(batches, "text"):
            ids, ends, counts = codec.encode(data, at)
            bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (ids, ends)]
            yield pa.RecordBatch.from_arrays([_text.column(rows, "doc_id"), *lists], names=["doc_id", "ids", "ends"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


_DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("spans_crc32", T.LongType())])


def digests(docs: DataFrame, file: str, with_ids: bool = False) -> DataFrame:
    """Encodes with an end id, decodes again, and gives per row: doc_id, n_tokens, digests of
    the ids and of the decoded text, the crc32 of the spans' ends (little-endian u32) and, if
    asked for, the ids.

    A null or empty text has the end id alone and decodes to an empty text. Texts are read whole,
    however long. Rows that repeat a doc_id or a text, or have no doc_id, are rows like others.
    Other columns are ignored; an empty table gives an empty result."""
    schema = T.StructType([*_DIGESTS.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]) if with_ids else _DIGESTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(file)
        hexed = lambda x: hashlib.sha256(x).hexdigest()
        for rows, data, at in _text.slices(batches, "text"):
            ids, ends, counts = codec.encode(data, at)
            spans = memoryview(ends.astype("<u4").tobytes())
            bounds = (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))] if with_ids else []
            yield pa.RecordBatch.from_arrays(
                [
                    _text.column(rows, "doc_id"),
                    pa.array(counts),
                    pa.array([hexed(x) for x in codec.decimals(ids, counts)], pa.string()),
                    pa.array([hexed(x) for x in codec.decode(ids, counts)], pa.string()),
                    pa.array([zlib.crc32(spans[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64()),
                    *lists,
                ],
                names=schema.names,
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
