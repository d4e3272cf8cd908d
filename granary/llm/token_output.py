"""Token-ID output: Elias-Fano document boundaries over a concatenated id array.

`WordEncoder` gives exactly the ids of the tokenizers library for a BPE file with lower-casing,
letter, digit and symbol runs, and word ends. Texts of ASCII and Latin-1 letters are cut into
words by byte classes, each distinct word is encoded once, in numpy batches over all new words,
and its ids are kept in a bounded store. All else (other scripts, apostrophes, control
characters, special tokens, words of over 48 bytes) goes to the library, chunk by chunk.

`write` puts documents in ascending doc_id order into segment files, and `read` gives every
document's position back from those files alone. A segment file is
    b"IDSEG002", then 11 little-endian u64: documents, ids, bytes per id (2 where the vocabulary
    has at most 65,536 ids, else 4), null doc_ids, the least other doc_id; then for the doc_ids
    less the least one, and for the n + 1 boundaries: low bits per value, bytes of low bits,
    bytes of high bits; low and high bits of both; ids.
doc_ids and boundaries are kept by Elias-Fano: `low` bits of each value in a packed array, the
rest in unary in a bit vector, 2 + low bits a value. `selected` finds a run of values from
sampled positions of ones; readers ask for READ_DOCS at a time and never expand a whole table.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import _text
from granary.llm._store import folder, written

MAGIC = b"IDSEG002"
#: Ids in a segment, about; a segment holds whole documents.
SEGMENT_IDS = 1 << 22
NULL_ID = -(2**63)
#: Boundaries that a reader selects at once.
READ_DOCS = 4096
#: Text of one writing task, and segments of one reading task, about.
PART_BYTES = 1 << 30
READ_SEGMENTS = 64


# --- Elias-Fano -----------------------------------------------------------------------------

class EliasFano:
    """A non-decreasing sequence in about 2 + log2(last / n) bits a value."""

    SAMPLE = 256

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray) -> None:
        self.n, self.low, self.lows, self.highs = n, low, lows, highs
        self._ranks: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values).astype(np.uint64)
        n, last = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (last // max(n, 1)).bit_length() - 1) if last >= n > 0 else 0
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low, lows, np.packbits(high, bitorder="little"))

    def _sampled(self) -> np.ndarray:
        """Ones before every block of SAMPLE bits."""
        if self._ranks is None:
            counts = np.unpackbits(self.highs, bitorder="little").reshape(-1, 8).sum(axis=1, dtype=np.int64)
            step = self.SAMPLE // 8
            counts = np.pad(counts, (0, -len(counts) % step)).reshape(-1, step).sum(axis=1)
            self._ranks = np.concatenate([[0], np.cumsum(counts)])
        return self._ranks

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.selected(i, i + 1)[0])

    def selected(self, first: int, last: int) -> np.ndarray:
        """The values of ranks first to last - 1, from the blocks of bits that hold their ones."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        if first == last:
            return np.zeros(0, np.int64)
        begin, end = (int(x) - 1 for x in np.searchsorted(self._sampled(), [first, last - 1], "right"))
        step = self.SAMPLE // 8
        ones = np.flatnonzero(np.unpackbits(self.highs[begin * step : (end + 1) * step], bitorder="little"))
        ones = ones[first - int(self._ranks[begin]) :][: last - first] + begin * self.SAMPLE
        high = (ones - np.arange(first, last)).astype(np.uint64)
        if not self.low:
            return high.view(np.int64)
        start = first * self.low
        bits = np.unpackbits(self.lows[start // 8 : (last * self.low + 7) // 8], bitorder="little")[start % 8 :][: (last - first) * self.low]
        low = bits.reshape(-1, self.low).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low, dtype=np.uint64))
        return ((high << np.uint64(self.low)) | low).view(np.int64)

    def bits(self) -> int:
        return 8 * (len(self.lows) + len(self.highs))


# --- segment files --------------------------------------------------------------------------

def pack_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """`doc_ids` are ascending longs, nulls as NULL_ID; `ids` are little-endian u2 or u4."""
    doc_ids = np.asarray(doc_ids, np.int64)
    nulls = int(np.searchsorted(doc_ids, NULL_ID, "right"))
    least = int(doc_ids[nulls]) if nulls < len(doc_ids) else 0
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(lengths)]))
    names = EliasFano.of(doc_ids[nulls:].view(np.uint64) - np.array(least, np.int64).view(np.uint64))
    sizes = [x for made in (names, bounds) for x in (made.low, len(made.lows), len(made.highs))]
    head = np.array([len(doc_ids), len(ids), ids.dtype.itemsize, nulls, least % 2**64, *sizes], "<u8")
    return b"".join([MAGIC, head.tobytes(), *(part.tobytes() for made in (names, bounds) for part in (made.lows, made.highs)), ids.tobytes()])


class Segment:
    """A segment file's bytes: ids of document i are ids[bounds.select(i):bounds.select(i + 1)]."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise ValueError("not a segment of token ids")
        self.n, n_ids, width, self.nulls, self.least, *sizes = (int(x) for x in np.frombuffer(raw, "<u8", 11, 8))
        at = 96
        made = []
        for n, (low, n_low, n_high) in ((self.n - self.nulls, sizes[:3]), (self.n + 1, sizes[3:])):
            made.append(EliasFano(n, low, np.frombuffer(raw, np.uint8, n_low, at), np.frombuffer(raw, np.uint8, n_high, at + n_low)))
            at += n_low + n_high
        self.names, self.bounds = made
        self.ids = np.frombuffer(raw, f"<u{width}", n_ids, at)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def doc_ids(self, first: int, last: int) -> np.ndarray:
        """doc_ids of documents first to last - 1, NULL_ID for null."""
        named = self.names.selected(max(0, first - self.nulls), max(0, last - self.nulls)).view(np.uint64) + np.uint64(self.least)
        return np.concatenate([np.full(last - first - len(named), NULL_ID), named.view(np.int64)])


def _save(uri: str, name: str, raw: bytes) -> None:
    """Writes under another name, then renames: a lost or repeated task leaves whole files."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(part := f"{path}/.{name}.{uuid.uuid4().hex}") as out:
        out.write(raw)
    fs.move(part, f"{path}/{name}")


def _load(uri: str, name: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(f"{path}/{name}") as src:
        return src.read()


# --- encoding -------------------------------------------------------------------------------

def _byte_letters() -> list[str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 as it is, the rest from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of whole texts, equal to the library's encode(text, add_special_tokens=False)."""

    LONGEST = 48
    NONE = np.iinfo(np.int32).max

    def __init__(self, file: str, most_words: int = 1_500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as src:
            model = json.load(src)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(left << 20 | right, kind="stable")
        self.pairs = (left << 20 | right)[order]
        self.ranks, self.made = order.astype(np.int32), made[order]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        self.store, self.chunks = (_text.Store(np.uint32, most_words) for _ in range(2))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (right >= 0), at, -1)

    def _merged(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte-pair merges of many words of one length at once; (ids end to end, counts)."""
        n, width = words.shape
        symbols = self.inner[words]
        symbols[:, -1] = self.last[words[:, -1]]
        if width == 1:
            return symbols[:, 0], np.ones(n, np.int64)
        at = self._rank(symbols[:, :-1], symbols[:, 1:])
        ranks = np.where(at >= 0, self.ranks[at], self.NONE)
        columns = np.arange(width)
        live = np.arange(n)
        while len(live):
            where = ranks[live].argmin(axis=1)
            found = ranks[live, where] < self.NONE
            live, where = live[found], where[found]
            if not len(live):
                break
            rows = symbols[live]
            new = self.made[np.searchsorted(self.pairs, rows[np.arange(len(live)), where] << 20 | rows[np.arange(len(live)), where + 1])]
            moved = np.concatenate([rows[:, 1:], np.full((len(live), 1), -1)], axis=1)
            rows = np.where(columns > where[:, None], moved, rows)
            rows[np.arange(len(live)), where] = new
            symbols[live] = rows
            near = ranks[live]
            shifted = np.concatenate([near[:, 1:], np.full((len(live), 1), self.NONE, near.dtype)], axis=1)
            near = np.where(columns[:-1] > where[:, None], shifted, near)
            for step in (-1, 0):
                pos = where + step
                use = np.flatnonzero((pos >= 0) & (pos < width - 1))
                got = self._rank(rows[use, pos[use]], rows[use, pos[use] + 1])
                near[use, pos[use]] = np.where(got >= 0, self.ranks[got], self.NONE)
            ranks[live] = near
        keep = symbols >= 0
        return symbols[keep], keep.sum(axis=1)

    def _merges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words, laid end to end, and their numbers."""
        sizes = ends - starts
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            flat, counts[which] = self._merged(data[starts[which][:, None] + np.arange(size)])
            parts.append((which, flat))
        at = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        for which, ids in parts:
            out[_text.ragged(at[which], counts[which])] = ids
        return out, counts

    def _by_library(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [raw[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        got = [x.ids for x in self.library.encode_batch(texts, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a flat UTF-8 buffer, end to end, and their number in each row."""
        starts, ends, whole, data = self.split(raw, offsets)
        parts = []
        for own, buffer, store, make in ((~whole, data, self.store, self._merges), (whole, raw, self.chunks, self._by_library)):
            places = np.flatnonzero(own)
            first, last = starts[places], ends[places]
            new = lambda at, buffer=buffer, first=first, last=last, make=make: make(buffer, first[at], last[at])
            parts.append((places, *store.sequences(buffer, first, last, new)))
        lengths = np.zeros(len(starts), np.int64)
        for places, _, own in parts:
            lengths[places] = own
        ids = np.zeros(int(lengths.sum()), np.uint32)
        at = np.cumsum(lengths) - lengths
        for places, flat, own in parts:
            ids[_text.ragged(at[places], own)] = flat
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[_text.rows_of(starts, offsets)])

    @staticmethod
    def split(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, whole, lower-cased bytes). A span is a run of letters, a digit or a run
        of symbols, or, where `whole` is set, a run without ASCII white space for the library."""
        n = len(raw)
        data = np.where((raw >= 0x41) & (raw <= 0x5A), raw | 0x20, raw)
        lead = raw == 0xC3
        second = np.zeros(n, bool)
        second[1:] = lead[:-1]
        data = np.where(second & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97), raw | 0x20, data)
        space = (raw == 0x20) | ((raw >= 9) & (raw <= 13))
        kind = np.full(n, 3, np.uint8)
        kind[((data >= 0x61) & (data <= 0x7A)) | lead | second] = 1
        kind[(raw >= 0x30) & (raw <= 0x39)] = 2
        kind[space] = 0
        hard = ((raw >= 0x80) & ~lead & ~second) | (second & ((raw == 0x97) | (raw == 0xB7))) | (raw == 0x27) | ((raw < 0x20) & ~space) | (raw == 0x7F)
        angle = np.zeros(n, bool)
        angle[:-1] = (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
        hard |= angle
        chunk_start, chunk_end = _text.spans_of(~space, offsets)
        if not len(chunk_start):
            return chunk_start, chunk_end, np.zeros(0, bool), data
        edge = np.zeros(n, bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        edge[chunk_start] = True
        edge &= ~space
        starts = np.flatnonzero(edge)
        owner = np.searchsorted(chunk_start, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], n), chunk_end[owner])
        long = np.flatnonzero(ends - starts > WordEncoder.LONGEST)
        flags = np.zeros(len(chunk_start), bool)
        flags[owner[long]] = True
        spots = np.flatnonzero(hard)
        flags[np.searchsorted(chunk_start, spots, "right") - 1] |= True
        keep = ~flags[owner]
        hard_chunks = np.flatnonzero(flags)
        starts = np.concatenate([starts[keep], chunk_start[hard_chunks]])
        ends = np.concatenate([ends[keep], chunk_end[hard_chunks]])
        whole = np.concatenate([np.zeros(int(keep.sum()), bool), np.ones(len(hard_chunks), bool)])
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order], whole[order], data


_ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType())])


def encode(docs: DataFrame, file: str, end_id: int | None = None, borders: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, part, place, width, ids binary: little-endian, `width` bytes each) of every row. A
    null text has the end id alone. The place is a hash of the text. The part is the number of
    borders below doc_id, a null being the least; a doc_id that is n borders has n parts, by
    ranges of the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(file)
        width = encoder.width if end_id is None or end_id < 1 << 16 else 4
        limits = np.array(borders, np.int64)
        for rows, data, at in _text.slices(batches, "text"):
            ids, counts = encoder.encode(data, at)
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                counts = counts + 1
            ends = np.concatenate([[0], width * np.cumsum(counts)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.astype(f"<u{width}").tobytes())])
            own = _text.column(rows, "doc_id")
            number, place = own.fill_null(NULL_ID).to_numpy(zero_copy_only=False), _text.column(rows, "place")
            part, above = np.searchsorted(limits, number, "left"), np.searchsorted(limits, number, "right")
            share = (place.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)  # in the order of places
            part += (share * np.maximum(above - part, 1).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([own, pa.array(part.astype(np.int32)), place, pa.array(np.full(len(counts), width, np.int32)), packed], names=_ENCODED.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("place"), "text").mapInArrow(run, _ENCODED)


# --- writing and reading --------------------------------------------------------------------

_MANIFEST = T.StructType([T.StructField("name", T.StringType()), T.StructField("part", T.LongType()), T.StructField("number", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])


def write(docs: DataFrame, file: str, end_id: int | None = None, segment_ids: int = SEGMENT_IDS) -> tuple[str, DataFrame]:
    """Encodes and writes `docs`; returns the folder and its manifest (name, start, n_docs, n_ids),
    one row for each segment file, start being the ids of all segments before it.

    Documents are dealt by ranges of doc_id, about PART_BYTES of text each, whose borders are
    quantiles found from the ids alone, so nothing is encoded twice or kept between. A doc_id that
    many rows have, null among them, is as many borders as it fills ranges, and its rows are dealt
    over these by their texts' hashes (a doc_id beyond 2**53 other than null stays in one range).
    Segments in the order of their names hold the ids in ascending doc_id order (null first, equal
    doc_ids in the order of these hashes, then of their bytes). Every task streams its sorted rows
    and holds one segment at a time. An empty table gives no segment; other columns are ignored.
    """
    spark = docs.sparkSession
    where = folder(spark, "segments")
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // PART_BYTES))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"))
    quantiles = own.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    borders = sorted(min(int(x), 2**63 - 1) for x in quantiles)
    dealt = encode(docs, file, end_id, tuple(borders))
    dealt = dealt.repartitionById(parts, "part").sortWithinPartitions("doc_id", "place", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, number = TaskContext.get().partitionId(), 0
        doc_ids: list[np.ndarray] = []
        raws: list[bytes] = []
        lengths: list[np.ndarray] = []
        size, width = 0, 4

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            name = f"seg-{place:08d}-{number:08d}.ids"
            n = np.concatenate(lengths)
            _save(where, name, pack_segment(np.concatenate(doc_ids), n, np.frombuffer(b"".join(raws), f"<u{width}")))
            row = pa.RecordBatch.from_pylist([{"name": name, "part": place, "number": number, "n_docs": len(n), "n_ids": int(n.sum())}], schema=pa.schema([("name", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            number, size = number + 1, 0
            for kept in (doc_ids, raws, lengths):
                kept.clear()
            return row

        for batch in batches:
            own = _text.column(batch, "doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            packed = _text.column(batch, "ids")
            ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
            flat = packed.buffers()[2]
            width = _text.column(batch, "width")[0].as_py()
            first = 0
            while first < len(own):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + width * (segment_ids - size), "right")) - 1)
                doc_ids.append(own[first:last])
                raws.append(flat.slice(int(ends[first]), int(ends[last] - ends[first])).to_pybytes() if ends[last] > ends[first] else b"")
                lengths.append(np.diff(ends[first : last + 1]) // width)
                size += int(ends[last] - ends[first]) // width
                first = last
                if size >= segment_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    listed = written(dealt.mapInArrow(run, _MANIFEST), "manifest")
    return where, _with_starts(listed)


def _with_starts(listed: DataFrame) -> DataFrame:
    """Adds `start`. One row a segment: the totals of the parts are few, so they alone are
    summed in order; within a part a window does it."""
    from pyspark.sql import Window

    by_part = listed.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    before = by_part.select("part", (F.sum("all_ids").over(Window.orderBy("part")) - F.col("all_ids")).alias("before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    return listed.withColumn("inner", inner).join(before, "part").select("name", (F.col("before") + F.col("inner")).alias("start"), "n_docs", "n_ids")


_READ = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def read(where: str, manifest: DataFrame) -> DataFrame:
    """Per document of the segment files: doc_id, start (ids of all documents before it),
    n_tokens and the crc32 of its ids' bytes. A task reads one file after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(_text.column(batch, "name").to_pylist(), _text.column(batch, "start").to_pylist(), strict=True):
                segment = Segment(_load(where, name))
                for first in range(0, segment.n, READ_DOCS):
                    last = min(segment.n, first + READ_DOCS)
                    bounds = segment.bounds.selected(first, last + 1)
                    raw = memoryview(segment.ids[bounds[0] : bounds[-1]].astype("<u4").tobytes())
                    places = (4 * (bounds - bounds[0])).tolist()
                    crcs = [zlib.crc32(raw[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]
                    own = segment.doc_ids(first, last)
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NULL_ID), pa.array(bounds[:-1] + start), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), manifest.count() // READ_SEGMENTS)
    return manifest.repartition(tasks, "name").mapInArrow(run, _READ)
