"""Sharding by Karmarkar-Karp differencing: shards of nearly equal bytes from indivisible groups.

A group is all documents of one text. `differencing` starts from one partial partition for each
item, its weight on one way and nothing on the others, and repeatedly combines the two partial
partitions with the largest spread, the heaviest way of one with the lightest of the other.

Groups are counted before anything is dealt. While there are more than MOST_ITEMS, they are
packed in chunks of at most CHUNK, each by differencing, into fewer, nearly equal bundles, which
are the next level's items. Groups heavier than a shard's part in 64 stay alone (there are at most
64 * shards). The items left, a bounded number of small ones, are differenced on the driver, so
one huge group shares its shard with less than the others get, and these stay equal. A shard is
never split over a group and no row is dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm._joins import spread_join
from granary.llm._store import written

CHUNK = 1 << 16
MOST_ITEMS = 1 << 15
#: Rows numbered by one window group, about.
SLOT_ROWS = 20_000


def differencing(weights: list[int], ways: int) -> list[int]:
    """The way (0 to ways - 1) of each item. Deterministic; ties go by position."""
    n = len(weights)
    if not n:
        return []
    rest = (0,) * (ways - 1)
    parts: list[tuple] = [(w, *rest) for w in weights]  # in descending order
    joins: list[tuple[int, int, list[int]]] = []
    heap = [(-w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sums = list(map(int.__add__, parts[a], reversed(parts[b])))
        order = sorted(range(ways), key=sums.__getitem__, reverse=True)
        low = sums[order[-1]]
        parts[a] = parts[b] = ()
        parts.append(tuple(sums[i] - low for i in order))
        joins.append((a, b, order))
        heapq.heappush(heap, (low - sums[order[0]], n + len(joins) - 1))
    ways_of: dict[int, list[int]] = {n + len(joins) - 1: list(range(ways))}
    out = [0] * n
    if not joins:
        return out
    for node in range(n + len(joins) - 1, n - 1, -1):
        a, b, order = joins[node - n]
        at = ways_of.pop(node)
        left, right = [0] * ways, [0] * ways
        for j, i in enumerate(order):
            left[i] = right[ways - 1 - i] = at[j]
        for child, mapped in ((a, left), (b, right)):
            if child < n:
                out[child] = mapped[0]
            else:
                ways_of[child] = mapped
    return out


def _bundled(items: DataFrame, chunk: int, ways: int) -> DataFrame:
    """`items` (item, bytes) and the bundle of each: `ways` bundles for every `chunk` items."""
    schema = T.StructType([*items.schema.fields, T.StructField("bundle", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        top = TaskContext.get().partitionId() << 40
        number = 0
        kept: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number
            table = pa.Table.from_batches(kept).combine_chunks()
            kept.clear()
            for first in range(0, table.num_rows, chunk):
                part = table.slice(first, chunk)
                if part.num_rows < chunk and not last:
                    kept.extend(part.to_batches())
                    break
                own = max(1, ways * part.num_rows // chunk)
                slots = np.array(differencing(part.column("bytes").to_pylist(), own), np.int64)
                yield from part.append_column("bundle", pa.array(top | number << 12 | slots)).to_batches()
                number += 1

        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
            if sum(x.num_rows for x in kept) >= chunk:
                yield from flush(False)
        if kept:
            yield from flush(True)

    return items.mapInArrow(run, schema)


def _shards_of(items: DataFrame, key: str, shards: int) -> DataFrame:
    """(key, shard) of a bounded number of items, differenced on the driver."""
    rows = sorted((-int(r[1]), int(r[0])) for r in items.select(key, "bytes").toLocalIterator())
    ways = differencing([-w for w, _ in rows], shards)
    spark = items.sparkSession
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.createDataFrame([(k, s) for (_, k), s in zip(rows, ways, strict=True)], schema)


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """Adds `shard` to `groups`, which has a unique long `group` and long `bytes`."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy_from = max(1, total // (64 * shards))
    heavy, light = groups.where(F.col("bytes") > heavy_from), groups.where(F.col("bytes") <= heavy_from)
    levels: list[DataFrame] = []
    sums = light.select(F.col("group").alias("item"), "bytes")
    ways = min(8 * shards, max(2, CHUNK // 4), 4096)
    while (n := sums.count()) > MOST_ITEMS:
        chunk = min(CHUNK, max(2 * ways, 2 * ways * n // MOST_ITEMS))
        level = written(_bundled(sums.repartition(-(-n // CHUNK), "item"), chunk, ways), "bundles")
        levels.append(level.select("item", "bundle"))
        sums = written(level.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).withColumnRenamed("bundle", "item"), "bundle-sums")
    items = sums.withColumn("alone", F.lit(False)).unionByName(heavy.select(F.col("group").alias("item"), "bytes", F.lit(True).alias("alone")))
    numbered = written(items.withColumn("n", F.row_number().over(Window.orderBy("alone", F.desc("bytes"), "item")).cast("long")), "items")
    ways_of = written(numbered.join(_shards_of(numbered, "n", shards), "n").select("item", "alone", "shard"), "ways")
    found = ways_of.where(~F.col("alone")).select("item", "shard")
    for level in reversed(levels):
        found = level.join(found.withColumnRenamed("item", "bundle"), "bundle").select("item", "shard")
    found = found.withColumnRenamed("item", "group").unionByName(ways_of.where("alone").select(F.col("item").alias("group"), "shard"))
    return groups.join(found, "group").select(*groups.columns, "shard")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    Size is the text's UTF-8 bytes plus 8; a null text counts as empty and is grouped with empty
    ones. Slots number each shard's documents from 0 without gaps, by blocks of doc_id hashes and
    doc_id; a null doc_id comes first in its block. Repeated rows have slots of their own and,
    with one text, one shard. A very long text is one heavy item, never split. Groups are texts
    with the same size and the same two hashes, differently seeded (128 bits). Other columns are
    ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))
    sized = written(sized, "sizes")
    key = ["k1", "k2", "size"]
    counted = sized.groupBy(*key).agg(F.count("*").alias("n"))
    groups = counted.select(*key, "n", F.monotonically_increasing_id().alias("group"), (F.col("n") * F.col("size")).alias("bytes"))
    placed = written(assign_groups(written(groups, "groups"), shards).select(*key, "n", "shard"), "placed")
    rows = placed.agg(F.sum("n")).first()[0] or 0
    blocks = max(8, -(-rows // (shards * SLOT_ROWS)))
    dealt = written(spread_join(sized, placed, key, "n", rows).drop("n").withColumn("block", F.pmod(F.xxhash64("doc_id", *key), F.lit(blocks)).cast("int")), "dealt")
    counts = dealt.groupBy("shard", "block").agg(F.count("*").alias("in_block"))
    starts = counts.select("shard", "block", (F.sum("in_block").over(Window.partitionBy("shard").orderBy("block")) - F.col("in_block")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", *key))
    return dealt.withColumn("number", number).join(starts, ["shard", "block"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
