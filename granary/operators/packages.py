"""Package records, one for each release, kept up with the artifacts of a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.paths import is_snapshot, pom_name
from granary.functions.pom import parsed_pom
from granary.operators.snapshots import matching, without
from granary.schema import GAV, PACKAGE, PACKAGES, POM, content_id

KEY = ["domain", *GAV]


def affected(added: DataFrame, removed: DataFrame) -> DataFrame:
    """Distinct releases of the artifacts that a change touched."""
    return added.select(*KEY).unionByName(removed.select(*KEY)).distinct()


def live_of(artifacts: DataFrame, touched: DataFrame) -> DataFrame:
    """Of the touched releases, those with an artifact in the snapshot."""
    return matching(artifacts, touched, KEY).select(*KEY).distinct()


def dead_of(touched: DataFrame, alive: DataFrame) -> DataFrame:
    return without(touched, alive, KEY)


def needing_pom(alive: DataFrame, packages: DataFrame) -> DataFrame:
    """Live releases without a package, and all live snapshots."""
    return without(alive.where(~is_snapshot(F.col("version"))), packages, KEY).unionByName(alive.where(is_snapshot(F.col("version"))))


def pom_bodies(needed: DataFrame, artifacts: DataFrame, blobs: DataFrame, any_pom: bool = False) -> DataFrame:
    """(release, content) of the project files of needed releases. Files without a blob give
    nothing. With any_pom every *.pom counts, the least file name first."""
    named = F.endswith("filename", F.lit(".pom")) if any_pom else F.col("filename") == pom_name(F.col("artifact_id"), F.col("version"))
    files = matching(artifacts.where(named & F.col("sha256").isNotNull()), needed, KEY).groupBy(*KEY).agg(F.min_by("sha256", "filename").alias("sha256"))
    return files.join(blobs.select("domain", "sha256", "content"), ["domain", "sha256"]).select(*KEY, "content")


def upserted(bodies: DataFrame, packages: DataFrame) -> DataFrame:
    """Packages to write: new ones, and snapshots with fresh fields. Releases are immutable. A
    body that cannot be read leaves an old package's fields, and gives a new one nulls."""
    parsed = bodies.select(*KEY, parsed_pom(F.col("content")).alias("pom"))
    old = matching(packages, parsed, KEY).select(*(F.col(k).alias(f"__{k}") for k in KEY), F.struct(*POM.names).alias("old"), F.lit(True).alias("known"))
    on = [parsed[k].eqNullSafe(old[f"__{k}"]) for k in KEY]
    both = parsed.join(old, on, "left").where(F.col("known").isNull() | is_snapshot(F.col("version")))
    fields = [F.when(F.col("pom.ok"), F.col(f"pom.{n}")).otherwise(F.col(f"old.{n}")).alias(n) for n in POM.names]
    return both.select(*KEY, *fields).withColumn("content_id", content_id(PACKAGE)).select(*PACKAGES.names)


def merged(packages: DataFrame, fresh: DataFrame) -> DataFrame:
    """All packages after an upsert."""
    return without(packages, fresh, ["content_id"]).unionByName(fresh)


def maintained(added: DataFrame, removed: DataFrame, artifacts: DataFrame, packages: DataFrame, blobs: DataFrame, any_pom: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a change of artifacts asks for: (packages to write, content ids to add, release keys
    whose packages go). A live release without a project file and without a package gives none."""
    touched = affected(added, removed)
    packages = matching(packages, touched, KEY)
    alive = live_of(artifacts, touched)
    fresh = upserted(pom_bodies(needing_pom(alive, packages), artifacts, blobs, any_pom), packages)
    known = packages.select(*KEY, "content_id").unionByName(fresh.select(*KEY, "content_id")).distinct()
    return fresh, matching(known, alive, KEY).select("content_id"), dead_of(touched, alive)


def backfilled(artifacts: DataFrame, packages: DataFrame, blobs: DataFrame) -> DataFrame:
    """New packages for all *.pom artifacts whose release has none. The fields come from the
    file with the exact name; a release with other *.pom files only gets an empty package."""
    releases = without(artifacts.where(F.endswith("filename", F.lit(".pom"))).select(*KEY).distinct(), packages, KEY)
    exact = pom_bodies(releases, artifacts, blobs)
    rest = without(releases, exact, KEY).withColumn("content", F.lit(None).cast("binary"))
    return upserted(exact.unionByName(rest), packages)
