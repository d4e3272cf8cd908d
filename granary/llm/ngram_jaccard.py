"""N-gram Jaccard self-join by MinHash with Bayesian pruning and exact verification.

Texts are A-Z lower-cased and cut at ASCII white space; the shingles of a text are its distinct
runs of five words (all its words, if it has one to four). Two documents are linked when their
shingle sets have a Jaccard similarity of at least 4/5. A text without words has no links.

1. Documents with equal shingle sets form a class; one row stands for it from here on.
2. MinHash values (BANDS * ROWS, two bytes each) put classes into one bucket a band. A pair at
   4/5 shares no bucket with probability (1 - 0.8**4)**32, about 5e-8.
3. Within buckets, pairs are compared STEP values at a time and dropped as soon as the posterior
   probability of reaching 4/5 (uniform prior, binomial matches) is below TOLERANCE. A pair is
   looked at in the first band it shares only. What survives is passed on as a spanning forest.
4. Forests are joined to candidate components. Their texts alone are read again; every pair of
   classes of a component is verified on whole shingle sets by products of incidence matrices.
   Counts of links and a spanning forest of true links come out, never the pairs.

Words and shingles are compared by 64-bit hashes (`_text.span_hashes`, two keyed chains or
blake2b; two given shingles are taken for one with a probability of about 5e-20), classes by two
sums of differently mixed shingle hashes and their number.

A row is known by its doc_id and the sha256 of its text, a class by a number of its own, so null
and repeated doc_ids do not mix rows. Buckets and components are dealt as pairs of chunks of
BLOCK to 16 * BLOCK classes, so that no task holds a large one. Keys that hold a great part of
the rows are joined by broadcast (`_joins`), a bounded number of them by definition; candidate
classes are broadcast up to BROADCAST_ROWS and shuffled beyond.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import _text
from granary.llm._joins import spread_join
from granary.llm._store import written

WORDS = 5
SIMILARITY = Fraction(4, 5)
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP, TOLERANCE = 16, 1e-9
BLOCK = 128
BROADCAST_ROWS = 1 << 18

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_PERMUTE = _text.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def least_matches(step: int = STEP, similarity: Fraction = SIMILARITY, tolerance: float = TOLERANCE) -> list[int]:
    """For step, 2 * step, ... compared values: the fewest matches that keep a pair. With a
    uniform prior, P(J >= t | m of n match) = P(Bin(n + 1, t) <= m)."""
    t, out = float(similarity), []
    for n in range(step, HASHES + 1, step):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= tolerance:
                out.append(m)
                break
    return out


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, end to end; and the rows' bounds."""
    data = _FOLD[data]
    starts, ends = _text.spans_of((data != 0x20) & ((data < 9) | (data > 13)), offsets)
    words, bounds = _text.span_hashes(data, starts, ends), _text.rows_of(starts, offsets)
    counts = np.diff(bounds)
    grams = _text.gram_hashes(words, WORDS)
    full = np.maximum(counts - WORDS + 1, 0)
    at = _text.ragged(bounds[:-1], full)
    values, rows = grams[at] if len(at) else np.zeros(0, np.uint64), np.repeat(np.arange(len(counts)), full)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        whole = np.array([_text.gram_hashes(words[bounds[i] : bounds[i + 1]], int(counts[i]))[0] for i in short], np.uint64)
        values, rows = np.concatenate([values, whole]), np.concatenate([rows, short])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    if len(values):
        first = np.concatenate([[True], (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])])
        values, rows = values[first], rows[first]
    return values, np.searchsorted(rows, np.arange(len(counts) + 1), "left")


_SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("sha", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("t1", "t2", "n")), T.StructField("sig", T.BinaryType())])


def _binary(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    at = (bounds * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])


def _known(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's sha256; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, sha, digest (t1, t2) and size n of the shingle set, and its MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in _text.slices(batches, "text"):
            values, bounds = shingles(data, at)
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(_text.mix(values ^ np.uint64(s)), dtype=np.uint64)]) for s in (1, 2)]
            t1, t2 = (np.diff(x[bounds]).view(np.int64) for x in sums)
            sig = np.zeros((len(n), HASHES), "<u2")
            if len(some):
                for i in range(HASHES):
                    sig[some, i] = (np.minimum.reduceat(values * _PERMUTE[i], bounds[some]) >> np.uint64(32)).astype(np.uint16)
            wide = np.arange(len(n) + 1, dtype=np.int64) * HASHES
            yield pa.RecordBatch.from_arrays([_text.column(rows, "doc_id"), _text.column(rows, "sha"), pa.array(t1), pa.array(t2), pa.array(n), _binary(sig.ravel(), wide)], names=_SIGNED.names)

    return _known(docs).mapInArrow(run, _SIGNED)


# --- runs of rows of one group --------------------------------------------------------------

def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole groups, each with the bounds of its groups."""
    kept: pa.Table | None = None

    def cut(table: pa.Table) -> np.ndarray:
        edge = np.zeros(table.num_rows, bool)
        edge[0] = True
        for key in keys:
            values = table.column(key).to_numpy()
            edge[1:] |= values[1:] != values[:-1]
        return np.append(np.flatnonzero(edge), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([kept, table]) if kept is not None else table
        bounds = cut(table)
        kept = table.slice(int(bounds[-2]))
        if len(bounds) > 2:
            yield table.slice(0, int(bounds[-2])).combine_chunks(), bounds[:-1]
    if kept is not None:
        yield kept.combine_chunks(), np.array([0, kept.num_rows])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each one's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _chunks(size: str) -> F.Column:
    """The number of chunks of a group: of BLOCK members, sixteen at most while these have no
    more than 16 * BLOCK members, and more beyond."""
    n = F.col(size)
    return F.greatest(F.least(F.ceil(n / BLOCK), F.lit(16)), F.ceil(n / (16 * BLOCK))).cast("int")


def _blocks(df: DataFrame, group: str, size: str, member: str) -> DataFrame:
    """Deals the rows of a group of `size` members into pairs of chunks: adds blk (the pair),
    side (0 or 1, the row's chunk in it; -1 where the pair is one chunk with itself), whole, true
    where the group is one chunk, and part, a number that neighbouring pairs of a group do not
    share, so a large group's pairs go to as many tasks as there are."""
    own = F.pmod(F.xxhash64(member), F.col("__q")).cast("int")
    dealt = df.withColumn("__q", _chunks(size)).withColumn("__own", own).withColumn("__other", F.explode(F.when(F.col("__q") > 1, F.sequence(F.lit(0), F.col("__q") - 1)).otherwise(F.array(F.lit(0)))))
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    place = low * F.col("__q") - F.floor(low * (low - 1) / 2) + high - low
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.withColumns({"part": F.pmod(F.pmod(F.xxhash64(group), F.lit(n)) + place, F.lit(n)).cast("int"), "blk": low.cast("long") * F.lit(1 << 31) + high, "side": F.when(low == high, -1).when(F.col("__own") == low, 0).otherwise(1).cast("int"), "whole": F.col("__q") == 1}).drop("__q", "__own", "__other")


def _pairs(side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of a block that are to be looked at, some at a time."""
    if side[0] < 0:
        n = len(side)
        for first in range(0, n, 64):
            last = min(n, first + 64)
            a, b = np.divmod(np.arange((last - first) * n), n)
            a += first
            yield a[a < b], b[a < b]
        return
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for first in range(0, len(left), 64):
        part = left[first : first + 64]
        yield np.repeat(part, len(right)), np.tile(right, len(part))


# --- candidates -----------------------------------------------------------------------------

_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


class _Pruner:
    """Pairs that may be similar, of those that share a bucket."""

    def __init__(self, sigs: np.ndarray) -> None:
        self.values = sigs.view("<u2").reshape(-1, HASHES)
        self.bands = sigs.view("<u8").reshape(-1, BANDS)
        self.least = least_matches()

    def __call__(self, a: np.ndarray, b: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`band`: of each pair the band whose bucket it is looked at in."""
        for i in range(int(band.max()) if len(band) else 0):
            fresh = (band <= i) | (self.bands[a, i] != self.bands[b, i])
            a, b, band = a[fresh], b[fresh], band[fresh]
        matches = np.zeros(len(a), np.int64)
        for i, least in enumerate(self.least):
            at = slice(i * STEP, (i + 1) * STEP)
            matches += (self.values[a, at] == self.values[b, at]).sum(axis=1)
            likely = matches >= least
            a, b, matches = a[likely], b[likely], matches[likely]
        return a, b


def _candidates(reps: DataFrame) -> DataFrame:
    """Edges (a, b) of spanning forests of the pairs of `reps` (rep, sig) that survive pruning."""
    spread = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("band", T.IntegerType()), T.StructField("rep", T.LongType())])

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = b"".join(_text.column(batch, "sig").to_pylist())
            values = np.frombuffer(sig, "<u8").reshape(-1, BANDS)
            salted = _text.mix(values + _text.mix(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)
            rep = np.repeat(_text.column(batch, "rep").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(salted.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(values))), pa.array(rep)], names=["bucket", "band", "rep"])

    spread_rows = reps.select("rep", "sig").mapInArrow(bands, spread)
    rows = written(spread_rows, "bands")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    shared = spread_join(rows, sizes, ["bucket"], "size", rows.count()).join(reps.select("rep", "sig"), "rep")
    dealt = _blocks(shared, "bucket", "size", "rep").select("part", "bucket", "blk", "band", "side", "rep", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _groups(batches, ["bucket", "blk"]):
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8)
            rep, side, band = (table.column(c).to_numpy() for c in ("rep", "side", "band"))
            prune = _Pruner(sigs)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            sizes = np.diff(bounds)
            for size in np.unique(sizes[sizes <= 64]).tolist():
                if size < 2:
                    continue
                firsts = bounds[:-1][sizes == size]
                firsts = firsts[side[firsts] < 0]
                i, j = np.triu_indices(size, 1)
                step = max(1, 200_000 // len(i))
                for k in range(0, len(firsts), step):
                    a, b = ((firsts[k : k + step, None] + x).ravel() for x in (i, j))
                    found.append(prune(a, b, band[a]))
            for first, size in zip(bounds[:-1].tolist(), sizes.tolist(), strict=True):
                if size > 64 or (size > 1 and side[first] >= 0):
                    own = prune.bands[first : first + size, : band[first]]
                    if any((own[:, i] == own[0, i]).all() for i in range(own.shape[1])):
                        continue  # all pairs are looked at in an earlier band
                    for a, b in _pairs(side[first : first + size]):
                        a, b = prune(a + first, b + first, band[a + first])
                        if len(a):
                            small = _roots(size, a - first, b - first)
                            at = np.flatnonzero(small != np.arange(size))
                            found.append((at + first, small[at] + first))
            if not found:
                continue
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            ids, inverse = np.unique(rep, return_inverse=True)
            root = _roots(len(ids), inverse[a], inverse[b])
            at = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]])], names=["a", "b"])

    n = max(1, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartitionById(n, "part").sortWithinPartitions("bucket", "blk", "rep").mapInArrow(run, _EDGE)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of `edges` (a, b), root being the component's least node: large
    and small stars in turn until nothing changes. Every round is written, so a lost executor
    costs at most a round."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(e)
    while before[0]:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("held"))
        large = spread_join(both.where(F.col("b") > F.col("a")), least, ["a"], "held", 2 * before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("held"))
        small = spread_join(large, least, ["a"], "held", before[0]).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        e = written(small, "small-star")
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


# --- verification ---------------------------------------------------------------------------

def _similar(values: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Places of the similar pairs between two lists of rows (for one list with itself, a < b)."""
    own = left is right
    rows = left if own else np.concatenate([left, right])
    flat = np.concatenate([values[i] for i in rows])
    sizes = np.array([len(values[i]) for i in rows])
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    number = np.cumsum(counts > 1) - 1
    row, column = np.repeat(np.arange(len(rows)), sizes)[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    nl = len(left)
    both = np.zeros((nl, nl if own else len(right)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    step = max(64, (8 << 20) // max(1, len(rows)) // 4)
    for first in range(0, width, step):
        a, b = np.searchsorted(column, [first, first + step])
        part = np.zeros((len(rows), min(step, width - first)), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        both += part[:nl] @ (part if own else part[nl:]).T
    total = sizes[:nl, None] + (sizes if own else sizes[nl:])[None, :]
    p, q = similarity.numerator, similarity.denominator
    found = np.rint(both).astype(np.int64) * (p + q) >= p * total
    if own:
        found = np.triu(found, 1)
    i, j = np.nonzero(found)
    return left[i], right[j]


_VERIFIED = T.StructType([T.StructField("rep", T.LongType()), T.StructField("links", T.LongType()), T.StructField("root", T.LongType()), T.StructField("whole", T.BooleanType())])


def _verified(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """For `candidates` (rep, doc_id, sha, comp, size, copies): in each block the documents linked
    to rep, and the least rep it is joined to there; whole where the block is the component."""
    few = candidates.count() <= BROADCAST_ROWS
    near = lambda rows: F.broadcast(rows) if few else rows
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat a text and doc_id are taken once from a task
        for batch in batches:
            fresh = [not (r in seen or seen.add(r)) for r in _text.column(batch, "rep").to_pylist()]
            for rows, data, at in _text.slices(iter([batch.filter(pa.array(fresh, pa.bool_()))]), "text"):
                values, bounds = shingles(data, at)
                yield pa.RecordBatch.from_arrays([_text.column(rows, "rep"), _binary(values, bounds)], names=["rep", "shingles"])

    own = _known(docs)
    wanted = candidates.select("rep", F.col("doc_id").alias("__id"), F.col("sha").alias("__sha"))
    texts = own.join(near(wanted), own["doc_id"].eqNullSafe(wanted["__id"]) & (own["sha"] == wanted["__sha"])).select("rep", "text").mapInArrow(sets, schema)
    joined = texts.join(near(candidates.select("rep", "comp", "size", "copies")), "rep")
    dealt = _blocks(joined, "comp", "size", "rep").select("part", "comp", "blk", "side", "whole", "rep", "copies", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _groups(batches, ["comp", "blk"]):
            rep, copies, side, whole = (table.column(c).to_numpy() for c in ("rep", "copies", "side", "whole"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
            links, root = np.zeros(len(rep), np.int64), rep.copy()
            alone = np.zeros(len(rep), bool)
            for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                at = np.arange(first, last)
                _, once = np.unique(rep[at], return_index=True)
                at = at[np.sort(once)]  # tasks may have read the same text
                alone[at] = True
                if side[first] < 0:
                    a, b = _similar(sets, at, at, SIMILARITY)
                else:
                    left, right = at[side[at] == 0], at[side[at] == 1]
                    a, b = _similar(sets, left, right, SIMILARITY) if len(left) and len(right) else (at[:0], at[:0])
                links += np.bincount(a, copies[b], len(rep)).astype(np.int64) + np.bincount(b, copies[a], len(rep)).astype(np.int64)
                order = at[np.argsort(rep[at], kind="stable")]
                rank = np.zeros(len(rep), np.int64)
                rank[order] = np.arange(len(order))
                root[order] = rep[order[_roots(len(order), rank[a], rank[b])]]
            yield pa.RecordBatch.from_arrays([pa.array(x[alone]) for x in (rep, links, root, whole)], names=["rep", "links", "root", "whole"])

    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartitionById(n, "part").sortWithinPartitions("comp", "blk", "rep").mapInArrow(run, _VERIFIED)


def _first() -> F.Column:
    """A row's place among others: by doc_id, nulls last, then by text digest."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("sha"))


def _classified(docs: DataFrame) -> DataFrame:
    """doc_id and sha of every row of `docs` that has words, with `copies` (rows of equal
    shingles), `links` (rows of other, similar shingles), `same` and `first`: the first row, as
    by `_first`, of equal shingles and of its whole class. Rows without words: nulls."""
    signed = written(_signatures(docs), "signatures")
    key = ["t1", "t2", "n"]
    classes = signed.where(F.col("n") > 0).groupBy(*key).agg(F.min(_first()).alias("same"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    found = written(components(written(_candidates(classes.select("rep", "sig")), "candidates")), "components")
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    sized = spread_join(found, sizes, ["root"], "size", found.count())
    wanted = sized.join(classes.select(F.col("rep").alias("node"), "copies", "same"), "node").select(F.col("node").alias("rep"), "same.doc_id", "same.sha", F.col("root").alias("comp"), "size", "copies")
    checked = written(_verified(docs, written(wanted, "wanted")), "verified")
    linked = checked.groupBy("rep").agg(F.sum("links").alias("links"), F.min(F.when(F.col("whole"), F.col("root"))).alias("root"))
    parts = checked.where(~F.col("whole") & (F.col("rep") != F.col("root"))).select(F.col("rep").alias("a"), F.col("root").alias("b"))
    if not parts.isEmpty():
        joined = written(components(parts).select(F.col("node").alias("rep"), F.col("root").alias("part_root")), "part-roots")
        linked = linked.join(joined, "rep", "left").withColumn("root", F.coalesce("part_root", "root")).drop("part_root")
    linked = written(linked.withColumn("root", F.coalesce("root", "rep")), "links")
    members = linked.select("rep", "root").join(classes.select("rep", "same"), "rep")
    firsts = members.groupBy("root").agg(F.min("same").alias("first"), F.count("*").alias("size"))
    firsts = spread_join(linked, firsts, ["root"], "size", linked.count()).select("rep", "links", "first")
    known = written(classes.drop("sig").join(firsts, "rep", "left").select(*key, "copies", "same", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("first", "same").alias("first")), "class-table")
    rows = signed.select("doc_id", "sha", *key)
    worded = spread_join(rows.where(F.col("n") > 0), known, key, "copies", rows.count())
    plain = rows.where(F.col("n") == 0).select("doc_id", "sha", *(F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("copies", "same", "links", "first")))
    return worded.select(*plain.columns).unionByName(plain)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For every row of `docs`: doc_id, class_id (the least doc_id of its component of linked
    documents), copy_of (the least doc_id with the same shingles), n_links (the other rows whose
    similarity is at least 4/5, copies included) and class_key (the least sha256, in hex, of the
    texts of the component's first copies; null without words).

    - Rows without words (null, empty, white space) are in a class of their own: class_id and
      copy_of are their doc_id, and they have no links.
    - Null doc_ids come last: class_id and copy_of are null only where no row of the class has a
      doc_id. Rows that repeat a doc_id are rows like others; with one text they are copies, with
      different texts they are in the classes of these. Then two classes can have one class_id,
      and class_key tells them apart.
    - Very long texts are handled as others, whole. An empty table gives an empty result. Other
      columns are ignored.
    """
    rows = _classified(docs)
    links = F.when(F.col("copies").isNull(), F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long")
    pick = lambda which: F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col(f"{which}.doc_id"))
    return rows.select("doc_id", pick("first").alias("class_id"), pick("same").alias("copy_of"), links.alias("n_links"), F.lower(F.hex("first.sha")).alias("class_key"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stand for their class: the first one by doc_id, nulls last, then by
    the sha256 of its text; of rows that repeat this doc_id and text one, by a hash of all its
    columns. Rows without words all stay. The result does not depend on the order of rows. The
    rows to drop, fewer than those to keep, are broadcast up to BROADCAST_ROWS and shuffled
    beyond."""
    rows = written(_classified(docs).select("doc_id", "sha", "first"), "near-classes").where(F.col("first").isNotNull())
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sha") == F.col("first.sha"))
    named = lambda found: found.select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha")).distinct()
    drop = named(rows.where(~stays))
    again = named(rows.where(stays).groupBy("doc_id", "sha").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    few = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    known = docs.withColumns({"__row_id": F.col("doc_id").cast("long"), "__row_sha": F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))})
    on = lambda: F.col("__row_id").eqNullSafe(F.col("__id")) & (F.col("__row_sha") == F.col("__sha"))
    kept = known.join(few(drop), on(), "left_anti")
    if not again.isEmpty():
        whole = F.struct(*docs.columns)
        order = F.xxhash64(*(c for c in docs.columns if not isinstance(docs.schema[c].dataType, T.MapType)))
        once = kept.join(few(again), on(), "left_semi").groupBy("__row_id", "__row_sha").agg(F.min_by(whole, order).alias("__whole")).select("__whole.*")
        return kept.join(few(again), on(), "left_anti").select(*docs.columns).unionByName(once)
    return kept.select(*docs.columns)
