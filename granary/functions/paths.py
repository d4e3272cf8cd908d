"""Layout paths: parts, classes of files, prefixes. Pure column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.schema import INDEX_FILE, PREFIXES_FILE, SNAPSHOT


def _head(path: Column) -> Column:
    """What stands before the last segment, without slashes at its end; '' if there is no slash."""
    return F.regexp_extract(path, r"(?s)\A(.*?)/+[^/]*\z", 1)


def _tail(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def is_version(segment: Column) -> Column:
    """A segment is a version if it begins with an ASCII letter or digit and its first line has
    a digit of any script."""
    return segment.rlike(r"\A(?=[^\n]*\p{Nd})[a-zA-Z0-9]")


def path_parts(path: Column) -> Column:
    """struct(group_id, artifact_id, version, filename) of a relative path. Without a version
    segment the version is null and the segment is the artifact."""
    folder = _head(path)
    last, above = _tail(folder), _head(folder)
    versioned = is_version(last)
    group = F.when(versioned, _head(above)).otherwise(above)
    return F.struct(
        F.replace(group, F.lit("/"), F.lit(".")).alias("group_id"),
        F.when(versioned, _tail(above)).otherwise(last).alias("artifact_id"),
        F.when(versioned, last).alias("version"),
        _tail(path).alias("filename"),
    )


def extension_and_classifier(filename: Column, artifact_id: Column, version: Column) -> Column:
    """struct(extension, classifier) of a file of a release; an absent classifier is null."""
    stem = F.concat(artifact_id, F.lit("-"), version)
    rest = F.substring(filename, F.char_length(stem) + 1, F.lit(2**31 - 1))
    own = F.startswith(filename, stem)
    classified, plain = own & F.startswith(rest, F.lit("-")), own & F.startswith(rest, F.lit("."))
    extension = (
        F.when(classified, F.regexp_extract(rest, r"(?s)\A-[^.]*\.(.*)\z", 1))
        .when(plain, F.substring(rest, F.lit(2), F.lit(2**31 - 1)))
        .otherwise(F.regexp_extract(filename, r"\.([^.]*)\z", 1))
    )
    return F.struct(extension.alias("extension"), F.when(classified, F.regexp_extract(rest, r"\A-([^.]*)", 1)).alias("classifier"))


def prefix(group_id: Column) -> Column:
    """The first two segments of a group as a path."""
    return F.concat(F.lit("/"), F.array_join(F.slice(F.split(group_id, r"[./]"), 1, 2), "/"))


def sidecar_parent(path: Column) -> Column:
    """The path a checksum sidecar belongs to: its last extension is dropped."""
    return F.regexp_replace(path, r"\.[^.]*\z", "")


def group_path(group_id: Column) -> Column:
    return F.replace(group_id, F.lit("."), F.lit("/"))


def pom_name(artifact_id: Column, version: Column) -> Column:
    return F.concat(artifact_id, F.lit("-"), version, F.lit(".pom"))


def index_path(group_id: Column, artifact_id: Column, version: Column | None = None) -> Column:
    """Where an index document is kept; concat_ws leaves out a null version."""
    parts = [group_path(group_id), artifact_id, *([version] if version is not None else []), F.lit(INDEX_FILE)]
    return F.concat_ws("/", *parts)


def is_snapshot(version: Column) -> Column:
    return F.endswith(version, F.lit(SNAPSHOT))


# Three different notions of "metadata"; they are not interchangeable. Fixed values.


def is_metadata_path(path: Column) -> Column:
    """Files that are taken in as metadata: any .xml and its checksum sidecars."""
    return path.rlike(r"\.(xml|xml\.sha1|xml\.md5|xml\.sha224|xml\.sha256|xml\.sha384|xml\.sha512)$")


def is_stream_only(path: Column) -> Column:
    """Files of a remote that are passed through and never kept."""
    suffixes = ("/maven-metadata.xml", ".xml.md5", ".xml.sha1", ".xml.sha224", ".xml.sha256", ".xml.sha384", ".xml.sha512")
    found = path == PREFIXES_FILE
    for suffix in suffixes:
        found = found | F.endswith(path, F.lit(suffix))
    return found


def is_absolute(path: Column) -> Column:
    return F.startswith(path, F.lit("/"))
