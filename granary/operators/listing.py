"""Filtered, scoped and paged listings of content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.labels import filter_expression, selector
from granary.functions.paths import is_metadata_path, path_parts
from granary.schema import ARTIFACT, GAV, METADATA

#: Columns by which each kind can be filtered, and those a listing shows.
FILTERS = {"artifact": [*GAV, "filename"], "metadata": [*GAV, "filename"], "package": [*GAV, "name", "packaging"]}
SHOWN = {
    "artifact": ["content_id", *GAV, "filename"],
    "metadata": ["content_id", *GAV, "filename", "sha256"],
    "package": ["content_id", *GAV, "name", "description", "packaging", "url", "scm_url", "licenses", "dependencies"],
}


def filtered(content: DataFrame, kind: str, **values: str | None) -> DataFrame:
    """Rows equal to all given values; None asks for null."""
    for name, value in values.items():
        if name not in FILTERS[kind]:
            raise ValueError(f"{kind} has no filter {name}")
        content = content.where(F.col(name).isNull() if value is None else F.col(name) == value)
    return content


def selected(content: DataFrame, labels: str | None = None, q: str | None = None) -> DataFrame:
    """Rows that a label selector and a filter expression pick."""
    if labels is not None:
        content = content.where(selector(F.col("labels"), labels))
    if q is not None:
        fields = {c: F.col(c) for c in content.columns if c != "labels"}
        content = content.where(filter_expression(q, fields, F.col("labels") if "labels" in content.columns else None))
    return content


def shown(content: DataFrame, kind: str) -> DataFrame:
    """The columns that a listing of a kind has."""
    return content.select(*SHOWN[kind])


def of_domain(rows: DataFrame, domain: str) -> DataFrame:
    """Rows of one tenant."""
    return rows.where(F.col("domain") == domain)


def in_snapshot(content: DataFrame, members: DataFrame) -> DataFrame:
    return content.join(members.select("content_id"), "content_id", "left_semi")


def scoped(rows: DataFrame, grants: DataFrame, principal: str, permission: str, object_id: str = "repo_id") -> DataFrame:
    """Rows a principal may see: all by a grant of scope 'model', else those granted one by one."""
    own = grants.where((F.col("principal") == principal) & (F.col("permission") == permission))
    everything = own.where(F.col("scope") == "model").select(F.lit(True).alias("all")).distinct()
    named = own.where(F.col("scope") == "object").select(F.col("object_id").alias("__object")).distinct()
    single = rows.join(named, rows[object_id] == named["__object"], "left_semi").select(*rows.columns)
    return rows.join(F.broadcast(everything), F.lit(True), "left_semi").unionByName(without_rows(single, everything))


def without_rows(rows: DataFrame, flag: DataFrame) -> DataFrame:
    """`rows` if `flag` (one row at most) is empty, else none."""
    return rows.join(F.broadcast(flag), F.lit(True), "left_anti")


def page(rows: DataFrame, key: str | list[str], offset: int = 0, limit: int = 100) -> DataFrame:
    """One page in the order of a unique key. Columns are those of `rows`."""
    keys = [key] if isinstance(key, str) else key
    return rows.orderBy(*keys).offset(offset).limit(limit)


def page_after(rows: DataFrame, key: str, last: object = None, limit: int = 100) -> DataFrame:
    """The page that follows the key `last`, the first page where that is None: no row before it
    is sorted again, however far the page is."""
    return (rows if last is None else rows.where(F.col(key) > F.lit(last))).orderBy(key).limit(limit)


def counted_page(rows: DataFrame, key: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page with the number of all rows and whether pages follow or precede. The total is an
    aggregate of its own, so no window gathers all rows."""
    total = rows.agg(F.count("*").alias("count"))
    return page(rows, key, offset, limit).join(F.broadcast(total)).withColumns({"has_next": F.col("count") > offset + limit, "has_previous": F.lit(offset > 0)})


def first_of(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """The first row of each group."""
    return rows.groupBy(*(F.col(g).alias(f"__{g}") for g in group)).agg(F.min_by(F.struct(*rows.columns), order).alias("__row")).select("__row.*")


def exactly_one(rows: DataFrame) -> DataFrame:
    """`rows`, checked to be one."""
    n = rows.limit(2).count()
    if n != 1:
        raise LookupError("nothing found" if n == 0 else "more than one found")
    return rows


def at_path(path: str, content: DataFrame) -> DataFrame:
    """The content that a path names by its parts; its kind follows the path. The parts are
    constants of the plan, so no job is run for them and they reach the scan."""
    parts, kind = path_parts(F.lit(path)), F.when(is_metadata_path(F.lit(path)), METADATA).otherwise(ARTIFACT)
    rows = content.where(F.col("kind") == kind)
    for name in (*GAV, "filename"):
        rows = rows.where(F.col(name).eqNullSafe(parts[name]))
    return rows


def lookup(path: str, content: DataFrame, members: DataFrame) -> DataFrame:
    """The one content of a snapshot at a path."""
    return exactly_one(in_snapshot(at_path(path, content), members))
