"""Content records made from files, inserted if absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.paths import is_absolute, is_metadata_path, path_parts, sidecar_parent
from granary.functions.pom import parsed_index
from granary.operators.snapshots import matching, without
from granary.schema import ARTIFACT, CONTENT, GAV, INDEX_FILE, MAX_LENGTHS, METADATA, QUARANTINE, content_id


def described(files: DataFrame, known: DataFrame) -> DataFrame:
    """(domain, relative_path, sha256, content) with kind, key columns and a reason for refusal,
    null if the file is accepted. Of several bodies of one path the least sha256 is accepted;
    without a body (content is null) index documents cannot be read. Index documents are keyed by what they name, their sidecars by
    the parent's record in `known` or in the same batch, else by the path."""
    path = F.col("relative_path")
    parts = files.withColumns({"kind": F.when(is_metadata_path(path), METADATA).otherwise(ARTIFACT), "p": path_parts(path)})
    index = (F.col("kind") == METADATA) & (F.col("p.filename") == INDEX_FILE)
    read = parts.withColumn("x", F.when(index, parsed_index(F.when(index, F.col("content")))))
    own = read.where(index & F.col("x.ok")).select("domain", "relative_path", F.col("x.group_id").alias("group_id"), F.col("x.artifact_id").alias("artifact_id"), F.col("x.version").alias("version"))
    asked = read.withColumn("parent_path", F.when((F.col("kind") == METADATA) & ~index, sidecar_parent(path)))
    wanted = asked.where(F.col("parent_path").isNotNull()).select("domain", F.col("parent_path").alias("relative_path")).distinct()
    parents = own.unionByName(known.select("domain", "relative_path", *GAV)).join(wanted, ["domain", "relative_path"], "left_semi")
    parents = parents.groupBy("domain", "relative_path").agg(F.min(F.struct(*GAV)).alias("parent")).withColumnRenamed("relative_path", "parent_path")
    joined = asked.join(parents, ["domain", "parent_path"], "left")
    pick = lambda n: F.when(index, F.col(f"x.{n}")).when(F.col("parent").isNotNull(), F.col(f"parent.{n}")).otherwise(F.col(f"p.{n}")).alias(n)
    more = ["labels"] if "labels" in files.columns else []
    keyed = joined.select("domain", "relative_path", "sha256", *more, "kind", *map(pick, GAV), F.col("p.filename").alias("filename"), (index & ~F.col("x.ok")).alias("broken"))
    reason = F.when(is_absolute(path), "absolute path").when(F.col("broken"), "index document is not valid XML").when((F.col("kind") == ARTIFACT) & F.col("version").isNull(), "artifact without a version")
    for name, most in MAX_LENGTHS.items():
        reason = reason.when(F.char_length(name) > most, f"{name} is longer than {most}")
    judged = keyed.withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNull(), F.col("sha256"))).over(Window.partitionBy("domain", "relative_path"))
    second = F.when(F.col("sha256") != first, F.lit("second body of a path"))
    return judged.withColumn("reason", F.coalesce("reason", second)).drop("broken")


def accepted(files: DataFrame) -> DataFrame:
    """Content rows of described files, one for each id; labels are those of a column `labels`,
    a map, or none."""
    rows = files.where(F.col("reason").isNull())
    ids = F.when(F.col("kind") == ARTIFACT, content_id(ARTIFACT)).otherwise(content_id(METADATA))
    labels = F.col("labels") if "labels" in files.columns else F.lit(None)
    empty = F.create_map().cast("map<string,string>")
    full = rows.withColumn("content_id", ids).withColumn("labels", F.coalesce(labels.cast("map<string,string>"), empty))
    least = F.struct("relative_path", F.sort_array(F.map_entries("labels")))
    return full.groupBy("content_id").agg(F.min_by(F.struct(*CONTENT.names), least).alias("row")).select("row.*")


def quarantined(files: DataFrame) -> DataFrame:
    return files.where(F.col("reason").isNotNull()).select(*QUARANTINE.names)


def inserted(new: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of `new` that are not known yet."""
    return without(new, known, ["content_id"])


def filled(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known artifacts without a blob that get one from `new`."""
    fresh = new.select("content_id", F.col("sha256").alias("new_sha256")).where(F.col("new_sha256").isNotNull())
    empty = known.where((F.col("kind") == ARTIFACT) & F.col("sha256").isNull())
    return empty.join(fresh, "content_id").withColumn("sha256", F.col("new_sha256")).select(*known.columns)


def labelled(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known rows that get labels from `new`, which names some; those it does not name stay."""
    more = new.where(F.coalesce(F.size("labels"), F.lit(0)) > 0).select("content_id", F.col("labels").alias("more"))
    old = F.coalesce(F.col("labels"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key("more", k))
    return known.join(more, "content_id").withColumn("labels", F.map_concat(kept, F.col("more"))).select(*known.columns)


def changed(known: DataFrame, new: DataFrame) -> DataFrame:
    """The rows to append after an insert: first writer wins, except for missing blobs and for
    labels. Only the known rows of the new ids are looked at."""
    have = matching(known, new, ["content_id"])
    better = filled(have, new)
    base = without(have, better, ["content_id"]).unionByName(better)
    relabelled = labelled(base, new)
    return inserted(new, have).select(*known.columns).unionByName(without(better, relabelled, ["content_id"])).unionByName(relabelled)


def saved(known: DataFrame, new: DataFrame) -> DataFrame:
    """All content after an insert."""
    rows = changed(known, new)
    return without(known, rows, ["content_id"]).unionByName(rows)
