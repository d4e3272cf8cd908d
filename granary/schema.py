"""Tables, keys and fixed values of a versioned package repository.

Content is immutable and has a deterministic id, the sha256 of its kind and key; only a missing
blob and labels are filled in later. A repository is a log of events: at a version, content was
added or removed. Nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and suffixes that repository clients rely on.
INDEX_FILE = "maven-metadata.xml"
INDEX_FILES = ["maven-metadata.xml", "maven-metadata.xml.md5", "maven-metadata.xml.sha1", "maven-metadata.xml.sha256"]
PREFIXES_FILE = ".meta/prefixes.txt"
PREFIXES_HEADER = "## repository-prefixes/2.0"
SNAPSHOT = "-SNAPSHOT"
POM_NAMESPACE = "http://maven.apache.org/POM/4.0.0"
XML_DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>'

ARTIFACT, METADATA, PACKAGE = "artifact", "metadata", "package"

GA = ["group_id", "artifact_id"]
GAV = [*GA, "version"]
#: Keys that are unique within one snapshot, by kind; version may be null and nulls are equal.
REPO_KEYS = {ARTIFACT: [*GAV, "filename"], METADATA: [*GAV, "filename"], PACKAGE: GAV}
#: Keys that are unique within a domain, by kind; they make up the content id, and so does the
#: sha256 of a snapshot version's artifact.
UNIQUE_KEYS = {ARTIFACT: ["domain", *GAV, "filename"], METADATA: ["domain", *GAV, "filename", "sha256"], PACKAGE: ["domain", *GAV]}


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])


_S, _L = T.StringType(), T.LongType()

LICENSE = _fields(("name", _S), ("url", _S))
DEPENDENCY = _fields(("group_id", _S), ("artifact_id", _S), ("version", _S), ("scope", _S), ("optional", T.BooleanType()))
POM = _fields(("name", _S), ("description", _S), ("packaging", _S), ("url", _S), ("scm_url", _S), ("licenses", T.ArrayType(LICENSE)), ("dependencies", T.ArrayType(DEPENDENCY)))

CONTENT = _fields(
    ("content_id", _S), ("kind", _S), ("domain", _S), ("group_id", _S), ("artifact_id", _S), ("version", _S), ("filename", _S),
    ("sha256", _S), ("relative_path", _S), ("labels", T.MapType(_S, _S)),
)
PACKAGES = T.StructType([*_fields(("content_id", _S), ("domain", _S), ("group_id", _S), ("artifact_id", _S), ("version", _S)).fields, *POM.fields])
BLOBS = _fields(("domain", _S), ("sha256", _S), ("size", _L), ("md5", _S), ("sha1", _S), ("sha224", _S), ("sha384", _S), ("sha512", _S), ("content", T.BinaryType()))
EVENTS = _fields(("repo_id", _S), ("version", _L), ("op", _S), ("kind", _S), ("content_id", _S))
VERSIONS = _fields(("repo_id", _S), ("version", _L), ("created", T.TimestampType()))
FETCHES = _fields(("content_id", _S), ("remote_id", _S), ("created", T.TimestampType()))
MEMBERS = _fields(("repo_id", _S), ("version", _L), ("kind", _S), ("content_id", _S))
_DROPPED = ("dropped", T.BooleanType())
GRANTS = _fields(("principal", _S), ("scope", _S), ("object_id", _S), ("permission", _S), _DROPPED)
REMOTES = _fields(("domain", _S), ("name", _S), ("url", _S), ("policy", _S), _DROPPED)
DISTRIBUTIONS = _fields(("domain", _S), ("name", _S), ("base_path", _S), ("repository", _S), ("remote", _S), _DROPPED)
REPOSITORIES = _fields(("domain", _S), ("name", _S), ("repo_id", _S), ("remote", _S), ("description", _S), _DROPPED)
QUARANTINE = _fields(("relative_path", _S), ("reason", _S))

#: Column lengths that the data model allows; longer values are quarantined.
MAX_LENGTHS = {"group_id": 255, "artifact_id": 255, "version": 255, "filename": 255}


def content_id(kind: str) -> Column:
    """The id of content of a kind, from its unique key. Values are written with their lengths, so
    no two keys are written alike, whatever is in them, and a null differs from an empty string."""
    parts = [F.col(c) for c in UNIQUE_KEYS[kind]]
    if kind == ARTIFACT:  # a redeployed snapshot file is other content, so old versions keep theirs
        parts.append(F.when(F.endswith("version", F.lit(SNAPSHOT)), F.col("sha256")))
    return F.sha2(F.concat_ws("\n", F.lit(kind), *(F.coalesce(F.concat(F.char_length(p).cast("string"), F.lit("="), p), F.lit("~")) for p in parts)), 256)
