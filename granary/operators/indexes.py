"""Index documents of a snapshot: full rebuild and maintenance after a change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.documents import index_document, prefixes_document, snapshot_document, with_sidecars
from granary.functions.paths import group_path, is_snapshot, prefix
from granary.operators.snapshots import matching, without
from granary.schema import GA, GAV, INDEX_FILES, METADATA, PREFIXES_FILE, content_id

PAIR, TRIPLE = ["domain", *GA], ["domain", *GAV]
NEW = ["content_id", "kind", "domain", *GAV, "filename", "sha256", "relative_path", "body"]


def versions_of(artifacts: DataFrame) -> DataFrame:
    """(domain, group, artifact, versions): distinct versions in code point order."""
    return artifacts.groupBy(*PAIR).agg(F.array_sort(F.collect_set("version")).alias("versions"))


def files_of(artifacts: DataFrame) -> DataFrame:
    """(domain, group, artifact, version, filenames) of snapshot versions."""
    return artifacts.where(is_snapshot(F.col("version"))).groupBy(*TRIPLE).agg(F.array_sort(F.collect_list("filename")).alias("filenames"))


def _content(df: DataFrame) -> DataFrame:
    named = df.withColumn("kind", F.lit(METADATA)).withColumn("sha256", F.sha2("body", 256))
    return named.withColumn("content_id", content_id(METADATA)).select(*NEW)


def _files(df: DataFrame, xml: Column, folder: list[Column]) -> DataFrame:
    """Four rows for each document: itself and its checksums."""
    rows = df.select(*TRIPLE, F.concat_ws("/", *folder).alias("__at"), F.inline(with_sidecars(xml)))
    return _content(rows.withColumn("relative_path", F.concat_ws("/", "__at", "filename")))


def pair_documents(artifacts: DataFrame, as_of: Column) -> DataFrame:
    rows = versions_of(artifacts).withColumn("version", F.lit(None).cast("string"))
    return _files(rows, index_document(F.col("group_id"), F.col("artifact_id"), F.col("versions"), as_of), [group_path(F.col("group_id")), F.col("artifact_id")])


def triple_documents(artifacts: DataFrame, as_of: Column) -> DataFrame:
    rows = files_of(artifacts)
    xml = snapshot_document(F.col("group_id"), F.col("artifact_id"), F.col("version"), F.col("filenames"), as_of)
    return _files(rows, xml, [group_path(F.col("group_id")), F.col("artifact_id"), F.col("version")])


def prefixes_of(artifacts: DataFrame) -> DataFrame:
    return artifacts.select("domain", prefix(F.col("group_id")).alias("prefix")).distinct()


def prefix_file(artifacts: DataFrame) -> DataFrame:
    """The prefix list of all artifacts' groups; no row if there are none."""
    lists = prefixes_of(artifacts).groupBy("domain").agg(prefixes_document(F.array_sort(F.collect_list("prefix"))).alias("body"))
    blank = {"group_id": "", "artifact_id": "", "version": None, "filename": PREFIXES_FILE, "relative_path": PREFIXES_FILE}
    return _content(lists.withColumns({k: F.lit(v).cast("string") for k, v in blank.items()}))


def is_index(metadata: DataFrame) -> DataFrame:
    return metadata.where(F.col("filename").isin(INDEX_FILES))


def orphans(metadata: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Index files of pairs without any artifact, whatever their version."""
    return without(is_index(metadata), artifacts.select(*PAIR).distinct(), PAIR)


def rebuilt(artifacts: DataFrame, metadata: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Full rebuild: (new documents with bodies, index and prefix content to remove). Index files
    of versions that are no snapshots stay while their pair lives."""
    new = pair_documents(artifacts, as_of).unionByName(triple_documents(artifacts, as_of)).unionByName(prefix_file(artifacts))
    kept = is_index(metadata).where(F.col("version").isNull() | is_snapshot(F.col("version")))
    stale = without(kept, new, ["content_id"])
    old_lists = without(metadata.where(F.col("filename") == PREFIXES_FILE), new, ["content_id"])
    return new, orphans(metadata, artifacts).unionByName(stale).unionByName(old_lists).select("kind", "content_id").distinct()


def prefix_set_changed(touched: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Prefixes of touched pairs that no untouched pair of the snapshot has, or that none has."""
    own = touched.select("domain", prefix(F.col("group_id")).alias("prefix")).distinct()
    untouched = prefixes_of(without(artifacts, touched, PAIR))
    return own.exceptAll(untouched.distinct()).unionByName(own.exceptAll(prefixes_of(artifacts))).distinct()


def maintained(added: DataFrame, removed: DataFrame, artifacts: DataFrame, metadata: DataFrame, as_of: Column, everything: Callable[[], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """After a change of artifacts: (new documents with bodies, content to remove), for touched
    pairs and snapshot versions only. The prefix list is made anew if the set of prefixes changed
    or the snapshot has none. `artifacts` may be those of the touched prefixes only; then
    `everything` gives all, for the list."""
    both = added.select(*TRIPLE).unionByName(removed.select(*TRIPLE))
    pairs = both.select(*PAIR).distinct()
    triples = both.where(is_snapshot(F.col("version"))).distinct()
    stale = matching(is_index(metadata).where(F.col("version").isNull()), pairs, PAIR).unionByName(matching(is_index(metadata), triples, TRIPLE))
    own = matching(artifacts, pairs, PAIR)
    new = pair_documents(own, as_of).unionByName(triple_documents(matching(own, triples, TRIPLE), as_of))
    lists = metadata.where(F.col("filename") == PREFIXES_FILE)
    if not pairs.isEmpty() and (lists.isEmpty() or not prefix_set_changed(pairs, artifacts).isEmpty()):
        new = new.unionByName(prefix_file(artifacts if everything is None else everything()))
        stale = stale.unionByName(lists)
    return new, without(stale, new, ["content_id"]).select("kind", "content_id").distinct()
