"""Snapshot algebra over a log of events (repo_id, version, op, kind, content_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.schema import REPO_KEYS

MEMBER = ["kind", "content_id"]


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of keys where nulls are equal; Spark plans it as an equi-join."""
    return reduce(Column.__and__, (left[k].eqNullSafe(right[k]) for k in keys))


def matching(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `left` whose key, nulls included, is in `right`."""
    other = right.select(*(F.col(k).alias(f"__{k}") for k in keys))
    return left.join(other, reduce(Column.__and__, (left[k].eqNullSafe(other[f"__{k}"]) for k in keys)), "left_semi")


def without(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `left` whose key, nulls included, is not in `right`."""
    other = right.select(*(F.col(k).alias(f"__{k}") for k in keys))
    return left.join(other, reduce(Column.__and__, (left[k].eqNullSafe(other[f"__{k}"]) for k in keys)), "left_anti")


def snapshot(events: DataFrame, repo_id: str, version: int) -> DataFrame:
    """(kind, content_id) of a repository at a version; version 0 is empty."""
    past = events.where((F.col("repo_id") == repo_id) & (F.col("version") <= version))
    return past.groupBy(*MEMBER).agg(F.max_by("op", "version").alias("op")).where(F.col("op") == "add").select(*MEMBER)


def resumed(base: DataFrame, later: DataFrame) -> DataFrame:
    """(kind, content_id) after `later` events (version, op, kind, content_id) on `base`."""
    last = later.groupBy(*MEMBER).agg(F.max_by("op", "version").alias("op"))
    return without(base.select(*MEMBER), last, MEMBER).unionByName(last.where(F.col("op") == "add").select(*MEMBER))


def settled(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """The change (op, kind, content_id) that `wanted` (rank, op, kind, content_id) asks of
    `members`: the highest rank of each content decides, and what holds already is no change."""
    last = wanted.groupBy(*MEMBER).agg(F.max_by("op", "rank").alias("op"))
    there = matching(members, last, MEMBER).select(*MEMBER)
    fresh, gone = (last.where(F.col("op") == op) for op in ("add", "remove"))
    return without(fresh, there, MEMBER).unionByName(matching(gone, there, MEMBER)).select("op", *MEMBER)


def changes(events: DataFrame, repo_id: str, version: int, op: str) -> DataFrame:
    """What was added (op 'add') or removed (op 'remove') at a version."""
    return events.where((F.col("repo_id") == repo_id) & (F.col("version") == version) & (F.col("op") == op)).select(*MEMBER)


def intervals(events: DataFrame) -> DataFrame:
    """(repo_id, kind, content_id, version_added, version_removed): one row for each stay."""
    following = F.lead("version").over(Window.partitionBy("repo_id", *MEMBER).orderBy("version"))
    stays = events.withColumn("version_removed", following).where(F.col("op") == "add")
    return stays.select("repo_id", *MEMBER, F.col("version").alias("version_added"), "version_removed")


def at_version(stays: DataFrame, version: int) -> DataFrame:
    """Rows of an interval-encoded membership that hold at a version."""
    return stays.where((F.col("version_added") <= version) & (F.col("version_removed").isNull() | (F.col("version_removed") > version)))


def live(stays: DataFrame) -> DataFrame:
    return stays.where(F.col("version_removed").isNull())


def modified(base: DataFrame, add: DataFrame, remove: DataFrame | None = None) -> DataFrame:
    """(base without remove) and add; what is in both lists stays in."""
    kept = base if remove is None else without(base, remove, MEMBER)
    return kept.select(*MEMBER).unionByName(add.select(*MEMBER)).distinct()


def conflicts(added: DataFrame) -> DataFrame:
    """Keys that two different contents of `added` share; such a change is refused."""
    keys = REPO_KEYS["artifact"]
    return added.groupBy("kind", *keys).agg(F.countDistinct("content_id").alias("n")).where(F.col("n") > 1)


def displaced(base: DataFrame, added: DataFrame) -> DataFrame:
    """Rows of `base` that newly added content with the same in-repository key replaces. Rows of
    both carry kind, content_id and the key columns; package rows have a null filename."""
    keys = ["kind", *REPO_KEYS["artifact"]]
    return without(matching(base, added, keys), added, MEMBER)


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events' op, kind and content_id that turn one snapshot into another."""
    return (
        without(new, old, MEMBER).select(F.lit("add").alias("op"), *MEMBER)
        .unionByName(without(old, new, MEMBER).select(F.lit("remove").alias("op"), *MEMBER))
    )
