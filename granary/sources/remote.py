"""Content that came through a remote: lazily kept, added to a repository later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.documents import since
from granary.functions.paths import is_stream_only
from granary.operators.snapshots import MEMBER, without


def keepable(paths: DataFrame) -> DataFrame:
    """Rows whose relative_path is kept when pulled through; the rest is passed on only."""
    return paths.where(~is_stream_only(F.col("relative_path")))


def not_live(content: DataFrame, members: DataFrame) -> DataFrame:
    """Pulled content that the repository does not hold yet."""
    return without(content, members, MEMBER)


def fetched_since(fetches: DataFrame, versions: DataFrame, repo_id: str, remote_id: str) -> DataFrame:
    """content_id of what a remote gave since the repository's latest version was made, that
    moment included; since ever where there is no version but 0."""
    latest = versions.where((F.col("repo_id") == repo_id) & (F.col("version") > 0)).agg(since(F.max_by("created", "version")).alias("bound"))
    own = fetches.where(F.col("remote_id") == remote_id)
    return own.join(F.broadcast(latest), F.col("created") >= F.col("bound"), "left_semi").select("content_id").distinct()


def cached(content: DataFrame, fetches: DataFrame, versions: DataFrame, repo_id: str, remote_id: str) -> DataFrame:
    return content.join(fetched_since(fetches, versions, repo_id, remote_id), "content_id", "left_semi")
