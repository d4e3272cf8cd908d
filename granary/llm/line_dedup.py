"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. The exact table
counts, for every non-empty key, the documents that hold it. Keys counted at least `min_docs`
times are common; each shard of the key space has a cuckoo filter of its common keys. Filters
say "perhaps": those keys of the exact table that are not common and yet pass a filter are listed
as exceptions, so filters and exceptions together decide exactly for every key that was counted.

`LineIndex` keeps counts and filters as tables: inserting and deleting documents changes counts,
and keys that cross the threshold are put into, or taken out of, their shard's filter. Deleting
what was inserted brings the former decisions back.

Filters are small (about 8 bytes a common key) but grow with the data. They are broadcast while
they take at most FILTER_BYTES; beyond that keys are joined with the exact table instead.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import _text
from granary.llm._joins import spread_join
from granary.llm._store import written

FILTER_BYTES = 64 << 20
KEYS_PER_SHARD = 1 << 20
_WHITE = b" \t\n\x0b\x0c\r"


class CuckooFilter:
    """Buckets of four 32-bit fingerprints; a key may lie in two buckets. Keys are two longs."""

    WAYS, KICKS = 4, 500

    def __init__(self, table: np.ndarray) -> None:
        self.table, self.mask = table, np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, (2 * keys // cls.WAYS).bit_length())
        return cls(np.zeros((buckets, cls.WAYS), np.uint32))

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h1, h2 = np.asarray(h1, np.int64).view(np.uint64), np.asarray(h2, np.int64).view(np.uint64)
        prints = np.maximum(h2 >> np.uint64(32), np.uint64(1)).astype(np.uint32)
        first = h1 & self.mask
        return prints, first, first ^ (_text.mix(prints.astype(np.uint64)) & self.mask)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(h1, h2)
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False when a key finds no place: the filter is then to be built anew, larger."""
        prints, first, second = self._places(h1, h2)
        for print_, *places in zip(prints.tolist(), first.tolist(), second.tolist(), strict=True):
            if not self._put(print_, places):
                return False
        return True

    def _put(self, print_: int, places: list[int]) -> bool:
        for place in places:
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = print_
                return True
        place = places[0]
        for kick in range(self.KICKS):
            way = kick % self.WAYS
            print_, self.table[place, way] = int(self.table[place, way]), print_
            place ^= int(_text.mix(np.array([print_], np.uint64))[0] & self.mask)
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = print_
                return True
        return False

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Takes out keys that were inserted before."""
        prints, first, second = self._places(h1, h2)
        for print_, *places in zip(prints.tolist(), first.tolist(), second.tolist(), strict=True):
            for place in places:
                held = np.flatnonzero(self.table[place] == print_)
                if len(held):
                    self.table[place, held[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint32).reshape(-1, cls.WAYS).copy())


def line_keys(text: bytes) -> list[bytes]:
    """The 16-byte key of every line; empty for a line of white space."""
    digest = hashlib.blake2b
    return [digest(k, digest_size=16).digest() if (k := line.strip(_WHITE).lower()) else b"" for line in text.split(b"\n")]


def _pairs(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


_COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("h1", "h2", "refs")])


def counted(docs: DataFrame) -> DataFrame:
    """(h1, h2, refs): for every key the number of rows of `docs` that hold it. Each task sums
    what it has read before rows are dealt by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            h1, h2 = _pairs(list(counts))
            out = pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(list(counts.values()), pa.int64())], names=["h1", "h2", "refs"])
            counts.clear()
            return out

        for _, data, at in _text.slices(batches, "text"):
            raw = data.tobytes()
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                counts.update({*line_keys(raw[a:b])})
            counts.pop(b"", None)
            if len(counts) > 200_000:
                yield flush()
        if counts:
            yield flush()

    return docs.select("text").mapInArrow(run, _COUNTS).groupBy("h1", "h2").agg(F.sum("refs").alias("refs"))


_FILTERS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("bits", T.BinaryType())])


class LineIndex:
    """Counts and filters of the documents inserted so far. `refs` and `filters` are tables in
    the shared folder; every change makes new ones, so a failed change leaves the old ones."""

    def __init__(self, spark: SparkSession, min_docs: int = 10) -> None:
        self.spark, self.min_docs, self.shards = spark, min_docs, 32
        self.refs = spark.createDataFrame([], _COUNTS)
        self.filters = spark.createDataFrame([], _FILTERS)

    def _shard(self) -> F.Column:
        return F.shiftrightunsigned("h1", 40).bitwiseAND(F.lit(self.shards - 1)).cast("int").alias("shard")

    def insert(self, docs: DataFrame) -> None:
        self._change(counted(docs))

    def delete(self, docs: DataFrame) -> None:
        """Takes back documents that were inserted with the same texts."""
        self._change(counted(docs).withColumn("refs", -F.col("refs")))

    def _change(self, delta: DataFrame) -> None:
        first = self.refs.isEmpty()
        if first:
            moved = written(delta.select("h1", "h2", "refs", F.lit(0).cast("long").alias("was")), "line-refs")
        else:
            both = self.refs.select("h1", "h2", "refs", F.col("refs").alias("was")).unionByName(delta.withColumn("was", F.lit(0).cast("long")))
            moved = written(both.groupBy("h1", "h2").agg(F.sum("refs").alias("refs"), F.sum("was").alias("was")), "line-refs")
        self.refs = moved.where(F.col("refs") > 0).select("h1", "h2", "refs")
        up = (F.col("refs") >= self.min_docs) & (F.col("was") < self.min_docs)
        down = (F.col("refs") < self.min_docs) & (F.col("was") >= self.min_docs)
        if first:
            self._build()
            return
        crossed = moved.where(up | down).select(self._shard(), "h1", "h2", up.alias("up"))

        def run(key: tuple, own: pa.Table, keys: pa.Table) -> pa.Table:
            raw = own.column("bits")[0].as_py() if own.num_rows else None
            kept = CuckooFilter.from_bytes(raw) if raw else CuckooFilter.sized(max(64, keys.num_rows))
            h1, h2, went_up = (keys.column(c).to_numpy() for c in ("h1", "h2", "up"))
            went_up = went_up.astype(bool)
            kept.delete(h1[~went_up], h2[~went_up])
            bits = kept.to_bytes() if kept.insert(h1[went_up], h2[went_up]) else None
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits], pa.binary())})

        self.filters = written(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(run, _FILTERS), "line-filters")
        if not self.filters.where(F.col("bits").isNull()).isEmpty():
            self._build()

    def common(self) -> DataFrame:
        return self.refs.where(F.col("refs") >= self.min_docs).select("h1", "h2")

    def _build(self) -> None:
        """Builds all filters from the exact counts."""
        n = self.common().count()
        self.shards = 1 << max(5, (n // KEYS_PER_SHARD).bit_length())

        def run(table: pa.Table) -> pa.Table:
            h1, h2 = table.column("h1").to_numpy(), table.column("h2").to_numpy()
            size = max(64, len(h1))
            while not (kept := CuckooFilter.sized(size)).insert(h1, h2):
                size *= 2
            return pa.table({"shard": table.column("shard")[:1], "bits": pa.array([kept.to_bytes()], pa.binary())})

        self.filters = written(self.common().select(self._shard(), "h1", "h2").groupBy("shard").applyInArrow(run, _FILTERS), "line-filters")

    def _decider(self):  # noqa: ANN202
        """A broadcast (filters by shard, exceptions, shards), or None where it would be too large."""
        total = self.filters.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
        if total > FILTER_BYTES:
            return None
        filters = {r["shard"]: bytes(r["bits"]) for r in self.filters.toLocalIterator()}
        sent = self.spark.sparkContext.broadcast((filters, self.shards))

        def perhaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe = _Probe(*sent.value)
            for batch in batches:
                h1, h2 = (_text.column(batch, c).to_numpy() for c in ("h1", "h2"))
                yield batch.filter(pa.array(probe(h1, h2)))

        rare = self.refs.where(F.col("refs") < self.min_docs)
        wrong = written(rare.mapInArrow(perhaps, rare.schema).select("h1", "h2"), "line-exceptions")
        if wrong.count() * 16 > FILTER_BYTES:
            return None
        exceptions = [(r[0], r[1]) for r in wrong.toLocalIterator()]
        return self.spark.sparkContext.broadcast((filters, self.shards, exceptions))

    def apply(self, docs: DataFrame) -> DataFrame:
        """`docs` (whose lines were counted) without common lines; adds n_lines and n_dropped.

        A null text stays null and has one line, an empty one stays empty. Rows stay as they are,
        repeated ones and those with a null doc_id too; each counts as a document. A line that a
        document repeats counts once in it and goes everywhere in it. Texts are read whole. Columns
        named n_lines or n_dropped are replaced; an empty table gives an empty result.
        """
        docs = docs.drop("n_lines", "n_dropped")
        sent = self._decider()
        if sent is None:
            return self._joined(docs)
        schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe = _Probe(*sent.value)
            for rows, data, at in _text.slices(batches, "text"):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                keys = [line_keys(t) for t in texts]
                distinct = list({k for own in keys for k in own if k})
                drop = {k for k, yes in zip(distinct, probe(*_pairs(distinct)).tolist(), strict=True) if yes} if distinct else set()
                yield _without(rows, texts, keys, [drop] * len(texts))

        return docs.mapInArrow(run, schema)

    def _joined(self, docs: DataFrame) -> DataFrame:
        """The same by joins: common keys of every distinct text, looked up by the text's sha256.
        The commonest lines are broadcast, so no task gathers a line that most texts hold."""
        schema = T.StructType([T.StructField("sha", T.BinaryType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, data, at in _text.slices(batches, "text"):
                raw = data.tobytes()
                keys = [[*{*line_keys(raw[a:b])} - {b""}] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                h1, h2 = _pairs([k for own in keys for k in own])
                row = np.repeat(np.arange(len(keys)), [len(own) for own in keys])
                yield pa.RecordBatch.from_arrays([_text.column(rows, "sha").take(pa.array(row)), pa.array(h1), pa.array(h2)], names=schema.names)

        named = docs.withColumn("__sha", F.unhex(F.sha2("text", 256)))
        texts = named.where(F.col("text").isNotNull()).groupBy(F.col("__sha").alias("sha")).agg(F.first("text").alias("text"))
        common = self.refs.where(F.col("refs") >= self.min_docs)
        found = spread_join(texts.mapInArrow(explode, schema), common, ["h1", "h2"], "refs", common.agg(F.sum("refs")).first()[0] or 0)
        drops = found.groupBy(F.col("sha").alias("__sha")).agg(F.collect_list(F.struct("h1", "h2")).alias("__drop"))
        whole = named.join(drops, "__sha", "left").select(*docs.columns, "__drop")
        out = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, data, at in _text.slices(batches, "text"):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                drops = [{np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in own or ()} for own in _text.column(rows, "__drop").to_pylist()]
                yield _without(rows.drop_columns(["__drop"]), texts, [line_keys(t) for t in texts], drops)

        return whole.mapInArrow(run, out)


class _Probe:
    """Exact for counted keys: in the shard's filter and no exception."""

    def __init__(self, filters: dict[int, bytes], shards: int, exceptions: list[tuple[int, int]] | None = None) -> None:
        self.filters = {k: CuckooFilter.from_bytes(v) for k, v in filters.items()}
        self.shards, self.exceptions = shards, {*exceptions} if exceptions else set()

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        shard = ((h1.view(np.uint64) >> np.uint64(40)) & np.uint64(self.shards - 1)).astype(np.int64)
        for s in np.unique(shard).tolist():
            if s in self.filters:
                own = np.flatnonzero(shard == s)
                out[own] = self.filters[s].contains(h1[own], h2[own])
        if self.exceptions:
            for i in np.flatnonzero(out).tolist():
                out[i] = (int(h1[i]), int(h2[i])) not in self.exceptions
        return out


def _without(rows: pa.RecordBatch, texts: list[bytes], keys: list[list[bytes]], drops: list[set[bytes]]) -> pa.RecordBatch:
    kept, dropped = [], []
    valid = _text.column(rows, "text").is_valid().to_pylist()
    for text, own, drop, there in zip(texts, keys, drops, valid, strict=True):
        if not there:
            kept.append(None)
            dropped.append(0)
        elif drop.isdisjoint(own):
            kept.append(text)
            dropped.append(0)
        else:
            lines = [x for x, k in zip(text.split(b"\n"), own, strict=True) if k not in drop]
            kept.append(b"\n".join(lines))
            dropped.append(len(own) - len(lines))
    i = rows.schema.get_field_index("text")
    columns = list(rows.columns)
    columns[i] = pa.array(kept, pa.binary()).cast(pa.string())
    names = [*rows.schema.names, "n_lines", "n_dropped"]
    return pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in keys], pa.int64()), pa.array(dropped, pa.int64())], names=names)


def dedup_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """`docs` without the lines whose keys are in at least `min_docs` rows."""
    index = LineIndex(docs.sparkSession, min_docs)
    index.insert(docs)
    return index.apply(docs)
