"""Index documents, prefix lists, digests and placeholders, built from columns byte for byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.paths import extension_and_classifier
from granary.schema import INDEX_FILE, PREFIXES_HEADER, SNAPSHOT, XML_DECLARATION


def escaped(text: Column) -> Column:
    """XML text: only & < > are replaced."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def element(tag: str, text: Column) -> Column:
    return F.when(text == "", F.lit(f"<{tag} />")).otherwise(F.concat(F.lit(f"<{tag}>"), escaped(text), F.lit(f"</{tag}>")))


def wrapped(tag: str, *inner: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), *inner, F.lit(f"</{tag}>"))


def document(root: Column) -> Column:
    return F.concat(F.lit(XML_DECLARATION + "\n"), root, F.lit("\n"))


def stamp(as_of: Column) -> Column:
    """yyyyMMddHHmmss of an injected time, in the session's time zone (UTC)."""
    return F.date_format(as_of, "yyyyMMddHHmmss")


def since(created: Column) -> Column:
    """A time bound that is the epoch where there is none."""
    return F.coalesce(created, F.lit("1970-01-01 00:00:00").cast("timestamp"))


def latest(versions: Column) -> Column:
    """The last of sorted versions, '' if there is none. Order is that of code points."""
    return F.coalesce(F.try_element_at(versions, F.lit(-1)), F.lit(""))


def release(versions: Column) -> Column:
    return latest(F.filter(versions, lambda v: ~F.endswith(v, F.lit(SNAPSHOT))))


def index_document(group_id: Column, artifact_id: Column, versions: Column, as_of: Column) -> Column:
    """The repository-level index of sorted versions."""
    listed = F.array_join(F.transform(versions, lambda v: element("version", v)), "")
    versioning = wrapped("versioning", element("latest", latest(versions)), element("release", release(versions)), wrapped("versions", listed), element("lastUpdated", stamp(as_of)))
    return document(wrapped("metadata", element("groupId", group_id), element("artifactId", artifact_id), versioning))


def snapshot_document(group_id: Column, artifact_id: Column, version: Column, filenames: Column, as_of: Column) -> Column:
    """The index of one snapshot version's sorted files."""
    updated = stamp(as_of)

    def entry(filename: Column) -> Column:
        parts = extension_and_classifier(filename, artifact_id, version)
        classifier = F.when(parts["classifier"] != "", element("classifier", parts["classifier"])).otherwise("")
        return wrapped("snapshotVersion", F.coalesce(classifier, F.lit("")), element("extension", parts["extension"]), element("value", version), element("updated", updated))

    entries = F.array_join(F.transform(filenames, entry), "")
    versioning = wrapped("versioning", wrapped("snapshot", element("localCopy", F.lit("true"))), wrapped("snapshotVersions", entries), element("lastUpdated", updated))
    return document(wrapped("metadata", element("groupId", group_id), element("artifactId", artifact_id), element("version", version), versioning))


def prefixes_document(prefixes: Column) -> Column:
    """The prefix list of sorted prefixes."""
    return F.concat(F.array_join(F.concat(F.array(F.lit(PREFIXES_HEADER)), prefixes), "\n"), F.lit("\n"))


def with_sidecars(xml: Column) -> Column:
    """array<struct(filename, body)>: an index document and its three checksum files."""
    digests = (("", xml), (".md5", F.md5(xml)), (".sha1", F.sha1(xml)), (".sha256", F.sha2(xml, 256)))
    return F.array(*(F.struct(F.lit(INDEX_FILE + suffix).alias("filename"), body.alias("body")) for suffix, body in digests))


def digests(content: Column) -> dict[str, Column]:
    """All digests of a body, lowercase hex."""
    return {"md5": F.md5(content), "sha1": F.sha1(content)} | {f"sha{n}": F.sha2(content, n) for n in (224, 256, 384, 512)}


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def resolved(text: Column, properties: Column, passes: int = 10) -> Column:
    """`text` with ${key} replaced from a map, all at once in each pass, up to `passes` times;
    unknown keys stay, and cycles end with the passes."""
    pattern = r"\$\{([^}]+)\}"

    def one_pass(value: Column) -> Column:
        between = F.split(value, pattern, -1)
        values = F.transform(F.regexp_extract_all(value, F.lit(pattern), 1), lambda k: F.coalesce(F.try_element_at(properties, k), F.concat(F.lit("${"), k, F.lit("}"))))
        return F.array_join(F.zip_with(between, values, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return F.reduce(F.sequence(F.lit(1), F.lit(passes)), text, lambda value, _: F.when(F.contains(value, F.lit("${")), one_pass(value)).otherwise(value))
