"""The query catalogue: every operator applied to whole driver tables, with SQL for comparison.

The tables are a star schema, so repository inputs are projections of them: a part stands for a
file of a release, an order for content whose year is the version that added it. Projections are
SQL expressions that both engines read; what follows is the library's operators here and plain
SQL there.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import documents, labels, paths, pom
from granary.operators import content, indexes, listing, packages, snapshots
from granary.plans.repository import Engine
from granary.plans.settings import first_distributions
from granary.schema import CONTENT, PACKAGES, POM, content_id
from granary.sources import files, remote

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A file of a release from a row of part; the same text in both engines.
FILE = """
    'd' AS domain,
    lower(replace(p_brand, '#', '.')) || '.' || lower(p_type) AS group_id,
    replace(p_name, ' ', '-') AS artifact_id,
    cast(p_size AS string) || '.' || cast(p_partkey % 3 AS string) || CASE WHEN p_size % 5 = 0 THEN '-SNAPSHOT' ELSE '' END AS version,
    replace(p_name, ' ', '-') || '-' || cast(p_size AS string) || '.' || cast(p_partkey % 3 AS string) || CASE WHEN p_size % 5 = 0 THEN '-SNAPSHOT' ELSE '' END
        || CASE p_partkey % 5 WHEN 0 THEN '.jar' WHEN 1 THEN '.pom' WHEN 2 THEN '-sources.jar' WHEN 3 THEN '.tar.gz' ELSE '-linux.tar.gz' END AS filename,
    p_partkey
"""
_FILES = f"files AS (SELECT {FILE} FROM part)"
#: Order keys as content: added in the order's year, every third removed two versions later.
STAY = """
    cast(o_orderkey AS string) AS content_id,
    cast(year(o_orderdate) - 1994 AS bigint) AS version_added,
    CASE WHEN o_orderkey % 3 = 0 THEN cast(year(o_orderdate) - 1992 AS bigint) END AS version_removed
"""
_STAYS = f"stays AS (SELECT {STAY} FROM orders)"
_AS_OF = "2024-05-06 07:08:09"
_STAMP = "20240506070809"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr(*_columns(FILE), *more)


def _columns(text: str) -> list[str]:
    """The expressions of a projection, cut at commas outside brackets and quotes."""
    out, depth, quoted, own = [], 0, False, ""
    for c in text:
        quoted ^= c == "'"
        depth += (not quoted) * ((c == "(") - (c == ")"))
        if c == "," and not depth and not quoted:
            out.append(own.strip())
            own = ""
        else:
            own += c
    return [*out, own.strip()]


def _stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr(*_columns(STAY), "'r' AS repo_id", "'artifact' AS kind")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    stays = _stays(spark, sf_dir)
    row = lambda op, at: F.struct(F.lit(op).alias("op"), F.col(at).alias("version"))
    both = stays.select("repo_id", "kind", "content_id", F.inline(F.array(row("add", "version_added"), row("remove", "version_removed"))))
    return both.where(F.col("version").isNotNull())


def _as_of() -> F.Column:
    return F.lit(_AS_OF).cast("timestamp")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- aggregation: versions, latest, release


_LISTED = f"""{_FILES}, listed AS (
    SELECT domain, group_id, artifact_id, string_agg(DISTINCT version, ',' ORDER BY version) AS versions, max(version) AS latest,
           coalesce(max(version) FILTER (WHERE NOT suffix(version, '-SNAPSHOT')), '') AS release
    FROM files GROUP BY ALL)"""


@query(f"WITH {_LISTED} SELECT group_id, artifact_id, versions, latest, release FROM listed")
def version_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group and artifact: sorted distinct versions, the last, and the last release."""
    v = F.col("versions")
    return indexes.versions_of(_files(spark, sf_dir)).select("group_id", "artifact_id", F.array_join(v, ",").alias("versions"), documents.latest(v).alias("latest"), documents.release(v).alias("release"))


@query(f"WITH {_FILES} SELECT DISTINCT group_id, artifact_id, version FROM files")
def distinct_gav(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = _files(spark, sf_dir).where(F.lit(False))
    return packages.affected(_files(spark, sf_dir), none).select("group_id", "artifact_id", "version")


@query(f"""WITH {_FILES} SELECT group_id, artifact_id, version, string_agg(filename, ',' ORDER BY filename) AS filenames
    FROM files WHERE suffix(version, '-SNAPSHOT') GROUP BY ALL""")
def snapshot_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.files_of(_files(spark, sf_dir)).select("group_id", "artifact_id", "version", F.array_join("filenames", ",").alias("filenames"))


# --- paths


_PATH = """
    CASE p_partkey % 8
        WHEN 0 THEN replace(p_name, ' ', '-') || '.jar'
        WHEN 1 THEN 'com//' || lower(p_type) || '//lib/' || cast(p_size AS string) || '.0/f.jar'
        WHEN 2 THEN replace(p_name, ' ', '/') || '/' || cast(p_size AS string) || '/f.pom'
        WHEN 3 THEN 'org/' || lower(p_type) || '/log4j/maven-metadata.xml'
        WHEN 4 THEN 'org/' || lower(p_type) || '/lib/maven-metadata.xml.sha1'
        WHEN 5 THEN '.meta/prefixes.txt'
        WHEN 6 THEN 'a/b/' || lower(p_type) || '/_1/f.xml.sha512'
        ELSE 'org/x/' || replace(p_name, ' ', '-') || '/final-' || cast(p_size AS string) || '/x.xml' END AS path
"""
_PARTS = f"""paths AS (SELECT p_partkey, {_PATH} FROM part),
    one AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS filename, regexp_extract(path, '^(.*?)/+[^/]*$', 1) AS folder FROM paths),
    two AS (SELECT *, regexp_extract(folder, '([^/]*)$', 1) AS last, regexp_extract(folder, '^(.*?)/+[^/]*$', 1) AS above FROM one),
    three AS (SELECT *, regexp_matches(last, '^[a-zA-Z0-9]') AND regexp_matches(last, '[0-9]') AS versioned FROM two)"""


@query(f"""WITH {_PARTS} SELECT p_partkey, path, filename, CASE WHEN versioned THEN last END AS version,
    CASE WHEN versioned THEN regexp_extract(above, '([^/]*)$', 1) ELSE last END AS artifact_id,
    replace(CASE WHEN versioned THEN regexp_extract(above, '^(.*?)/+[^/]*$', 1) ELSE above END, '/', '.') AS group_id FROM three""")
def gav_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").selectExpr("p_partkey", _PATH)
    return rows.select("p_partkey", "path", paths.path_parts(F.col("path")).alias("p")).select("p_partkey", "path", "p.*")


@query(f"SELECT p_partkey, regexp_matches(path, '[.](xml|xml[.](sha1|md5|sha224|sha256|sha384|sha512))$') AS is_metadata FROM (SELECT p_partkey, {_PATH} FROM part)")
def metadata_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr("p_partkey", _PATH).select("p_partkey", paths.is_metadata_path(F.col("path")).alias("is_metadata"))


@query(f"""SELECT p_partkey, path FROM (SELECT p_partkey, {_PATH} FROM part)
    WHERE NOT (suffix(path, '/maven-metadata.xml') OR regexp_matches(path, '[.]xml[.](md5|sha1|sha224|sha256|sha384|sha512)$') OR path = '.meta/prefixes.txt')""")
def stream_only_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").selectExpr("p_partkey", _PATH).withColumnRenamed("path", "relative_path")
    return remote.keepable(rows).select("p_partkey", F.col("relative_path").alias("path"))


@query(f"""WITH {_FILES}, r AS (SELECT *, substr(filename, length(artifact_id || '-' || version) + 1) AS rest FROM files)
    SELECT p_partkey, filename,
        CASE WHEN starts_with(rest, '-') THEN CASE WHEN contains(rest, '.') THEN regexp_extract(rest, '^-[^.]*[.](.*)$', 1) ELSE '' END ELSE substr(rest, 2) END AS extension,
        CASE WHEN starts_with(rest, '-') THEN regexp_extract(rest, '^-([^.]*)', 1) END AS classifier FROM r""")
def ext_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = paths.extension_and_classifier(F.col("filename"), F.col("artifact_id"), F.col("version"))
    return _files(spark, sf_dir).select("p_partkey", "filename", parts.alias("x")).select("p_partkey", "filename", "x.*")


@query(f"WITH {_FILES} SELECT DISTINCT '/' || string_split(group_id, '.')[1] || '/' || string_split(group_id, '.')[2] AS prefix FROM files")
def repo_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.prefixes_of(_files(spark, sf_dir)).select("prefix")


# --- documents


_DOC = f"""{_FILES}, listed AS (
    SELECT group_id, artifact_id, string_agg(DISTINCT '<version>' || version || '</version>', '' ORDER BY '<version>' || version || '</version>') AS versions,
           max(version) AS latest, max(version) FILTER (WHERE NOT suffix(version, '-SNAPSHOT')) AS release
    FROM files GROUP BY ALL),
    docs AS (SELECT group_id, artifact_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<metadata><groupId>' || group_id || '</groupId><artifactId>' || artifact_id
        || '</artifactId><versioning><latest>' || latest || '</latest>' || coalesce('<release>' || release || '</release>', '<release />') || '<versions>' || versions
        || '</versions><lastUpdated>{_STAMP}</lastUpdated></versioning></metadata>' || chr(10) AS body FROM listed)"""


@query(f"WITH {_DOC} SELECT group_id, artifact_id, sha256(body) AS sha256, length(body) AS n FROM docs")
def index_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = indexes.pair_documents(_files(spark, sf_dir), _as_of()).where(F.col("filename") == "maven-metadata.xml")
    return made.select("group_id", "artifact_id", "sha256", F.char_length("body").cast("long").alias("n"))


@query(f"""WITH {_DOC}, rows AS (
    SELECT *, 'maven-metadata.xml' AS filename FROM docs UNION ALL SELECT group_id, artifact_id, md5(body), 'maven-metadata.xml.md5' FROM docs
    UNION ALL SELECT group_id, artifact_id, sha1(body), 'maven-metadata.xml.sha1' FROM docs UNION ALL SELECT group_id, artifact_id, sha256(body), 'maven-metadata.xml.sha256' FROM docs)
    SELECT replace(group_id, '.', '/') || '/' || artifact_id || '/' || filename AS relative_path, sha256(body) AS sha256 FROM rows""")
def sidecar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.pair_documents(_files(spark, sf_dir), _as_of()).select("relative_path", "sha256")


@query(f"""WITH {_FILES}, r AS (SELECT *, substr(filename, length(artifact_id || '-' || version) + 1) AS rest FROM files WHERE suffix(version, '-SNAPSHOT')),
    e AS (SELECT group_id, artifact_id, version, filename, '<snapshotVersion>' || CASE WHEN starts_with(rest, '-') THEN '<classifier>' || regexp_extract(rest, '^-([^.]*)', 1) || '</classifier>' ELSE '' END
        || '<extension>' || CASE WHEN starts_with(rest, '-') THEN regexp_extract(rest, '^-[^.]*[.](.*)$', 1) ELSE substr(rest, 2) END || '</extension><value>' || version
        || '</value><updated>{_STAMP}</updated></snapshotVersion>' AS entry FROM r)
    SELECT group_id, artifact_id, version, sha256('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<metadata><groupId>' || group_id || '</groupId><artifactId>' || artifact_id
        || '</artifactId><version>' || version || '</version><versioning><snapshot><localCopy>true</localCopy></snapshot><snapshotVersions>' || string_agg(entry, '' ORDER BY filename)
        || '</snapshotVersions><lastUpdated>{_STAMP}</lastUpdated></versioning></metadata>' || chr(10)) AS sha256 FROM e GROUP BY group_id, artifact_id, version""")
def snapshot_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = indexes.triple_documents(_files(spark, sf_dir), _as_of()).where(F.col("filename") == "maven-metadata.xml")
    return made.select("group_id", "artifact_id", "version", "sha256")


@query(f"""WITH {_FILES}, p AS (SELECT DISTINCT '/' || string_split(group_id, '.')[1] || '/' || string_split(group_id, '.')[2] AS prefix FROM files)
    SELECT '## repository-prefixes/2.0' || chr(10) || string_agg(prefix, chr(10) ORDER BY prefix) || chr(10) AS body FROM p""")
def prefixes_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.prefix_file(_files(spark, sf_dir)).select("body")


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.digests(F.col("text").cast("binary"))
    return _table(spark, sf_dir, "documents").select("doc_id", *(found[n].alias(n) for n in ("md5", "sha1", "sha256")))


@query()
def digests_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests that SQL has not; tests compare them."""
    found = documents.digests(F.col("text").cast("binary"))
    return _table(spark, sf_dir, "documents").select("doc_id", *(found[n].alias(n) for n in ("sha224", "sha384", "sha512")))


@query("SELECT event_id, coalesce(CASE WHEN event_type <> 'view' THEN ts END, TIMESTAMP '1970-01-01 00:00:00') AS bound FROM events")
def epoch_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time bound, the epoch where there is none."""
    return _table(spark, sf_dir, "events").select("event_id", documents.since(F.when(F.col("event_type") != "view", F.col("ts"))).alias("bound"))


# --- snapshots


_AT = "version_added <= {n} AND (version_removed IS NULL OR version_removed > {n})"


@query(f"WITH {_STAYS} SELECT content_id FROM stays WHERE {_AT.format(n=4)}")
def snapshot_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot(_events(spark, sf_dir), "r", 4).select("content_id")


@query(f"WITH {_STAYS} SELECT content_id FROM stays WHERE version_added = 4")
def snapshot_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.changes(_events(spark, sf_dir), "r", 4, "add").select("content_id")


@query(f"WITH {_STAYS} SELECT content_id FROM stays WHERE version_removed = 4")
def snapshot_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.changes(_events(spark, sf_dir), "r", 4, "remove").select("content_id")


@query(f"WITH {_STAYS} SELECT content_id, version_added, coalesce(version_removed, -1) AS version_removed FROM stays")
def membership_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.intervals(_events(spark, sf_dir)).select("content_id", "version_added", F.coalesce("version_removed", F.lit(-1)).alias("version_removed"))


@query(f"WITH {_STAYS} SELECT content_id FROM stays WHERE version_removed IS NULL")
def live_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.live(_stays(spark, sf_dir)).select("content_id")


@query(f"""WITH {_STAYS} SELECT content_id FROM stays WHERE {_AT.format(n=4)} AND cast(content_id AS bigint) % 10 <> 1
    UNION SELECT content_id FROM stays WHERE version_added = 6""")
def modify_add_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    base = snapshots.snapshot(events, "r", 4)
    return snapshots.modified(base, snapshots.changes(events, "r", 6, "add"), base.where(F.col("content_id").cast("long") % 10 == 1)).select("content_id")


@query(f"WITH {_STAYS} SELECT content_id FROM stays WHERE false")
def remove_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = snapshots.snapshot(_events(spark, sf_dir), "r", 4)
    return snapshots.modified(base, base.limit(0), base).select("content_id")


@query(f"WITH {_STAYS} SELECT CASE WHEN {_AT.format(n=3)} THEN 'add' ELSE 'remove' END AS op, content_id FROM stays WHERE ({_AT.format(n=3)}) <> ({_AT.format(n=6)})")
def base_version_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that turn version 6 into an exact copy of version 3."""
    events = _events(spark, sf_dir)
    return snapshots.delta(snapshots.snapshot(events, "r", 6), snapshots.snapshot(events, "r", 3)).select("op", "content_id")


@query(f"WITH {_STAYS} SELECT content_id FROM stays WHERE {_AT.format(n=5)} AND cast(content_id AS bigint) % 7 = 0")
def promote_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = snapshots.snapshot(_events(spark, sf_dir), "r", 5)
    return snapshots.matching(source, source.where(F.col("content_id").cast("long") % 7 == 0), ["content_id"]).select("content_id")


_KEYED = """k AS (SELECT o_orderkey, 'g' || cast(o_custkey % 50 AS string) AS group_id, o_orderpriority AS artifact_id,
    CASE WHEN o_orderkey % 4 <> 0 THEN cast(o_custkey % 3 AS string) END AS version, o_orderstatus AS filename FROM orders)"""


@query(f"""WITH {_KEYED} SELECT cast(b.o_orderkey AS string) AS content_id FROM k b WHERE b.o_orderkey % 2 = 0 AND EXISTS (SELECT 1 FROM k n WHERE (n.o_orderkey % 11 = 1 OR n.o_orderkey % 2 = 1) AND n.group_id = b.group_id
    AND n.artifact_id = b.artifact_id AND n.version IS NOT DISTINCT FROM b.version AND n.filename = b.filename AND n.o_orderkey <> b.o_orderkey)
    AND NOT (b.o_orderkey % 11 = 1)""")
def dedup_by_key_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content that newly added content with the same key, null versions included, replaces."""
    keyed = _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "'artifact' AS kind", "cast(o_orderkey AS string) AS content_id", "'g' || cast(o_custkey % 50 AS string) AS group_id", "o_orderpriority AS artifact_id",
        "CASE WHEN o_orderkey % 4 <> 0 THEN cast(o_custkey % 3 AS string) END AS version", "o_orderstatus AS filename",
    )
    return snapshots.displaced(keyed.where("o_orderkey % 2 = 0"), keyed.where("o_orderkey % 11 = 1 OR o_orderkey % 2 = 1")).select("content_id")


# --- packages


_TOUCHED = f"""{_FILES}, touched AS (SELECT DISTINCT group_id, artifact_id, version FROM files WHERE p_partkey % 3 <> 0),
    there AS (SELECT * FROM files WHERE p_partkey % 4 = 0 OR p_partkey % 3 = 0), alive AS (SELECT DISTINCT group_id, artifact_id, version FROM there SEMI JOIN touched USING (group_id, artifact_id, version)),
    known AS (SELECT DISTINCT group_id, artifact_id, version FROM files WHERE p_partkey % 6 = 0)"""


def _release_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _files(spark, sf_dir)
    touched = packages.affected(rows.where("p_partkey % 3 = 1"), rows.where("p_partkey % 3 = 2"))
    return touched, packages.live_of(rows.where("p_partkey % 4 = 0 OR p_partkey % 3 = 0"), touched), rows.where("p_partkey % 6 = 0").select(*packages.KEY).distinct()


@query(f"WITH {_TOUCHED} SELECT * FROM alive")
def live_gavs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _release_parts(spark, sf_dir)[1].drop("domain")


@query(f"WITH {_TOUCHED} SELECT * FROM touched EXCEPT SELECT * FROM alive")
def dead_gavs(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched, alive, _ = _release_parts(spark, sf_dir)
    return packages.dead_of(touched, alive).drop("domain")


@query(f"WITH {_TOUCHED} SELECT * FROM alive a WHERE suffix(version, '-SNAPSHOT') OR NOT EXISTS (SELECT 1 FROM known k WHERE (k.group_id, k.artifact_id, k.version) = (a.group_id, a.artifact_id, a.version))")
def needs_pom(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, alive, known = _release_parts(spark, sf_dir)
    return packages.needing_pom(alive, known).drop("domain")


#: A project file's text from a row of part; no character needs escaping.
_POM = """'<project><groupId>' || lower(p_brand) || '</groupId><artifactId>' || replace(p_name, ' ', '-') || '</artifactId><version>' || cast(p_size AS string)
    || '</version><name>' || p_name || '</name><description> ${project.artifactId} of ' || p_type || '</description><url>${home}/' || cast(p_partkey AS string)
    || '</url><properties><home>http://${host}</home><host>h' || cast(p_size AS string) || '.org</host></properties><licenses><license><name>' || p_brand
    || '</name></license></licenses><dependencies><dependency><groupId>g</groupId><artifactId>' || p_type || '</artifactId><optional>true</optional></dependency></dependencies></project>'"""


@query("""SELECT p_partkey, p_name AS name, ' ' || replace(p_name, ' ', '-') || ' of ' || p_type AS description, 'jar' AS packaging, 'http://h' || cast(p_size AS string) || '.org/' || cast(p_partkey AS string) AS url,
    CAST(NULL AS varchar) AS scm_url, p_brand || '|' AS licenses, 'g|' || p_type || '||null|true' AS dependencies FROM part""")
def pom_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project files built from parts and read back, placeholders resolved."""
    rows = _table(spark, sf_dir, "part").select("p_partkey", pom.parsed_pom(F.expr(_sql_text(_POM)).cast("binary")).alias("x"))
    lic, dep = F.col("x.licenses")[0], F.col("x.dependencies")[0]
    joined = F.concat_ws("|", dep["group_id"], dep["artifact_id"], dep["version"], F.coalesce(dep["scope"], F.lit("null")), dep["optional"].cast("string"))
    return rows.select("p_partkey", "x.name", "x.description", "x.packaging", "x.url", "x.scm_url", F.concat_ws("|", lic["name"], lic["url"]).alias("licenses"), joined.alias("dependencies"))


def _sql_text(text: str) -> str:
    """SQL whose string literals keep '${', which Spark would take for a variable."""
    return text.replace("${", "' || '$' || '{")


@query(f"""WITH {_FILES} SELECT f.group_id, f.artifact_id, f.version, min(f.filename) AS filename, count(*) AS n_lines FROM files f JOIN lineitem ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    WHERE f.filename = f.artifact_id || '-' || f.version || '.pom' AND o_orderstatus = 'O' GROUP BY ALL""")
def pom_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project files by their exact name, joined with two larger tables in place of blobs."""
    rows = _files(spark, sf_dir).where(F.col("filename") == paths.pom_name(F.col("artifact_id"), F.col("version")))
    lines = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    orders = _table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    joined = lines.join(rows, lines["l_partkey"] == rows["p_partkey"]).join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.groupBy("group_id", "artifact_id", "version").agg(F.min("filename").alias("filename"), F.count("*").alias("n_lines"))


def _poms(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    """(release, content): one project file for each release of some parts."""
    rows = _table(spark, sf_dir, "part").where(where).selectExpr(*_columns(FILE), f"{_sql_text(_POM)} AS pom")
    return rows.groupBy(*packages.KEY).agg(F.max("pom").cast("binary").alias("content"))


@query(f"""WITH files AS (SELECT {FILE}, p_name AS name, 'http://h' || cast(p_size AS string) || '.org/' || cast(p_partkey AS string) AS url, {_POM} AS pom FROM part),
    fresh AS (SELECT group_id, artifact_id, version, max_by(url, pom) AS url FROM files WHERE p_partkey % 3 = 1 OR p_partkey % 2 = 1 GROUP BY ALL),
    known AS (SELECT group_id, artifact_id, version, 'old' AS url FROM files WHERE p_partkey % 2 = 0 GROUP BY ALL)
    SELECT coalesce(k.group_id, n.group_id) AS group_id, coalesce(k.artifact_id, n.artifact_id) AS artifact_id, coalesce(k.version, n.version) AS version,
        CASE WHEN k.url IS NULL OR (n.url IS NOT NULL AND suffix(k.version, '-SNAPSHOT')) THEN n.url ELSE k.url END AS url
    FROM known k FULL JOIN fresh n ON (k.group_id, k.artifact_id, k.version) = (n.group_id, n.artifact_id, n.version)""")
def package_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert if absent; only snapshots are refreshed."""
    known = _files(spark, sf_dir).where("p_partkey % 2 = 0").select(*packages.KEY).distinct()
    known = known.withColumns({n: F.lit(None).cast(POM[n].dataType) for n in POM.names}).withColumn("url", F.lit("old")).withColumn("content_id", packages.content_id("package")).select(*PACKAGES.names)
    fresh = packages.upserted(_poms(spark, sf_dir, "p_partkey % 3 = 1 OR p_partkey % 2 = 1"), known)
    return packages.merged(known, fresh).select("group_id", "artifact_id", "version", "url")


@query(f"""WITH files AS (SELECT {FILE}, {_POM} AS body FROM part), poms AS (SELECT * FROM files WHERE suffix(filename, '.pom'))
    SELECT group_id, artifact_id, version, max(CASE WHEN filename = artifact_id || '-' || version || '.pom' THEN 1 ELSE 0 END) = 1 AS filled FROM poms GROUP BY ALL""")
def package_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").selectExpr(*_columns(FILE), f"{_sql_text(_POM)} AS body", f"sha2({_sql_text(_POM)}, 256) AS sha256")
    blobs = rows.select("domain", "sha256", F.col("body").cast("binary").alias("content"))
    known = spark.createDataFrame([], PACKAGES)
    return packages.backfilled(rows, known, blobs).select("group_id", "artifact_id", "version", F.col("name").isNotNull().alias("filled"))


# --- index maintenance


_META = f"""{_FILES}, meta AS (SELECT DISTINCT group_id, artifact_id, CASE WHEN p_partkey % 2 = 0 THEN version END AS version, 'maven-metadata.xml' AS filename FROM files WHERE p_partkey % 2 < 2),
    there AS (SELECT * FROM files WHERE p_partkey % 9 = 0)"""


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir)
    named = rows.select("domain", "group_id", "artifact_id", F.expr("CASE WHEN p_partkey % 2 = 0 THEN version END").alias("version")).distinct()
    return named.withColumns({"kind": F.lit("metadata"), "filename": F.lit("maven-metadata.xml"), "content_id": F.concat_ws("|", "group_id", "artifact_id", F.coalesce("version", F.lit("-")))})


@query(f"WITH {_META} SELECT m.group_id, m.artifact_id, m.version FROM meta m WHERE NOT EXISTS (SELECT 1 FROM there t WHERE (t.group_id, t.artifact_id) = (m.group_id, m.artifact_id))")
def orphan_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.orphans(_metadata(spark, sf_dir), _files(spark, sf_dir).where("p_partkey % 9 = 0")).select("group_id", "artifact_id", "version")


@query(f"""WITH {_META} SELECT m.group_id || '|' || m.artifact_id || '|' || coalesce(m.version, '-') AS content_id FROM meta m
    WHERE m.version IS NULL OR suffix(m.version, '-SNAPSHOT') OR NOT EXISTS (SELECT 1 FROM there t WHERE (t.group_id, t.artifact_id) = (m.group_id, m.artifact_id))""")
def stale_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a full rebuild removes: orphans, and old documents that it makes anew."""
    return indexes.rebuilt(_files(spark, sf_dir).where("p_partkey % 9 = 0"), _metadata(spark, sf_dir), _as_of())[1].select("content_id")


_CHANGE = """now AS (SELECT * FROM files WHERE p_partkey % 10 <> 3), touched AS (SELECT DISTINCT group_id, artifact_id, version FROM files WHERE p_partkey % 10 IN (3, 4)),
    pairs AS (SELECT DISTINCT group_id, artifact_id FROM touched)"""


@query(f"""WITH {_META}, {_CHANGE}
    SELECT m.group_id || '|' || m.artifact_id || '|' || coalesce(m.version, '-') AS content_id FROM meta m
    WHERE (m.version IS NULL AND EXISTS (SELECT 1 FROM pairs p WHERE (p.group_id, p.artifact_id) = (m.group_id, m.artifact_id)))
       OR (suffix(m.version, '-SNAPSHOT') AND EXISTS (SELECT 1 FROM touched t WHERE (t.group_id, t.artifact_id, t.version) = (m.group_id, m.artifact_id, m.version)))""")
def incremental_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change removes: the touched pairs' and touched snapshots' documents."""
    rows = _files(spark, sf_dir)
    return indexes.maintained(rows.where("p_partkey % 10 = 4"), rows.where("p_partkey % 10 = 3"), rows.where("p_partkey % 10 <> 3"), _metadata(spark, sf_dir), _as_of())[1].select("content_id")


@query(f"""WITH {_FILES}, {_CHANGE}, listed AS (SELECT DISTINCT group_id, artifact_id FROM now SEMI JOIN pairs USING (group_id, artifact_id)),
    snaps AS (SELECT DISTINCT group_id, artifact_id, version FROM now SEMI JOIN touched USING (group_id, artifact_id, version) WHERE suffix(version, '-SNAPSHOT')),
    docs AS (SELECT replace(group_id, '.', '/') || '/' || artifact_id AS place FROM listed UNION ALL SELECT replace(group_id, '.', '/') || '/' || artifact_id || '/' || version FROM snaps)
    SELECT place || '/maven-metadata.xml' || s AS relative_path FROM docs, (VALUES (''), ('.md5'), ('.sha1'), ('.sha256')) AS v(s) UNION ALL SELECT '.meta/prefixes.txt'""")
def incremental_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the documents that a change makes anew; the snapshot had no prefix list."""
    rows = _files(spark, sf_dir)
    return indexes.maintained(rows.where("p_partkey % 10 = 4"), rows.where("p_partkey % 10 = 3"), rows.where("p_partkey % 10 <> 3"), _metadata(spark, sf_dir), _as_of())[0].select("relative_path")


@query(f"""WITH {_FILES}, p AS (SELECT *, '/' || string_split(group_id, '.')[1] || '/' || string_split(group_id, '.')[2] AS prefix FROM files),
    touched AS (SELECT DISTINCT group_id, artifact_id FROM p WHERE group_id LIKE 'brand.1.%' OR p_partkey % 97 = 5), now AS (SELECT * FROM p WHERE p_partkey % 4 <> 0)
    SELECT DISTINCT prefix FROM p SEMI JOIN touched USING (group_id, artifact_id)
    WHERE prefix NOT IN (SELECT prefix FROM now ANTI JOIN touched USING (group_id, artifact_id)) OR prefix NOT IN (SELECT prefix FROM now)""")
def prefix_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir)
    touched = rows.where("group_id LIKE 'brand.1.%' OR p_partkey % 97 = 5").select(*indexes.PAIR).distinct()
    return indexes.prefix_set_changed(touched, rows.where("p_partkey % 4 <> 0")).select("prefix")


# --- content


@query(f"""WITH {_FILES}, known AS (SELECT DISTINCT sha256(group_id) AS sha256 FROM files WHERE p_partkey % 5 = 0)
    SELECT DISTINCT sha256(group_id) AS sha256, cast(strlen(group_id) AS bigint) AS size, md5(group_id) AS md5 FROM files WHERE p_partkey % 5 <> 0 AND sha256(group_id) NOT IN (SELECT sha256 FROM known)""")
def blob_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that the domain does not have yet, each once."""
    rows = _files(spark, sf_dir).select("domain", "p_partkey", F.col("group_id").cast("binary").alias("content"))
    return files.new_blobs(rows.where("p_partkey % 5 <> 0"), files.blobs_of(rows.where("p_partkey % 5 = 0"))).select("sha256", "size", "md5")


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").selectExpr("'d' AS domain", f"{'/'!r} || p_name AS slash", _PATH, "p_partkey", "p_size", "p_type")
    path = F.when(F.col("p_partkey") % 13 == 0, F.col("slash")).otherwise(F.col("path"))
    body = F.when(F.col("p_size") % 4 == 0, F.lit("<broken>")).otherwise(F.concat(F.lit("<metadata><groupId>org."), F.lower("p_type"), F.lit("</groupId><artifactId>log4j</artifactId></metadata>")))
    rows = rows.select("domain", path.alias("relative_path"), body.cast("binary").alias("content")).withColumn("sha256", F.sha2("content", 256))
    return content.described(rows, spark.createDataFrame([], CONTENT))


@query(f"""WITH paths AS (SELECT p_size, p_type, CASE WHEN p_partkey % 13 = 0 THEN '/' || p_name ELSE path END AS relative_path FROM (SELECT p_partkey, p_size, p_type, p_name, {_PATH} FROM part)),
    judged AS (SELECT relative_path, sha256(CASE WHEN p_size % 4 = 0 THEN '<broken>' ELSE '<metadata><groupId>org.' || lower(p_type) || '</groupId><artifactId>log4j</artifactId></metadata>' END) AS sha256,
        CASE WHEN starts_with(relative_path, '/') THEN 'absolute path' WHEN suffix(relative_path, '/maven-metadata.xml') AND p_size % 4 = 0 THEN 'index document is not valid XML'
        WHEN NOT contains(relative_path, '/') OR relative_path = '.meta/prefixes.txt' THEN 'artifact without a version' END AS reason FROM paths),
    firsts AS (SELECT relative_path, min(sha256) AS first FROM judged WHERE reason IS NULL GROUP BY relative_path)
    SELECT relative_path, coalesce(reason, 'second body of a path') AS reason FROM judged LEFT JOIN firsts USING (relative_path) WHERE reason IS NOT NULL OR sha256 <> first""")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are refused, with the reason."""
    return content.quarantined(_described(spark, sf_dir))


@query(f"""WITH paths AS (SELECT p_partkey, p_size, lower(p_type) AS t, {_PATH} FROM part WHERE p_partkey % 13 <> 0)
    SELECT path AS relative_path, 'org.' || t AS group_id, 'log4j' AS artifact_id, CAST(NULL AS varchar) AS version FROM paths WHERE suffix(path, '/maven-metadata.xml') AND p_size % 4 <> 0""")
def index_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index documents keyed by what they name, not by their paths."""
    rows = _described(spark, sf_dir).where(F.endswith("relative_path", F.lit("/maven-metadata.xml")) & F.col("reason").isNull())
    return rows.select("relative_path", "group_id", "artifact_id", "version")


@query(f"""WITH {_FILES}, f AS (SELECT *, replace(group_id, '.', '/') || '/' || filename AS path FROM files),
    parents AS (SELECT path, min(version) AS version FROM f WHERE p_partkey % 2 = 0 GROUP BY path)
    SELECT p_partkey, f.path || '.sha1' AS relative_path, coalesce(p.version, 'none') AS version FROM f LEFT JOIN parents p USING (path)""")
def parent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sidecar takes its version from the content at the path without the last extension."""
    rows = _files(spark, sf_dir).withColumn("path", F.concat_ws("/", paths.group_path(F.col("group_id")), "filename"))
    parents = rows.where("p_partkey % 2 = 0").groupBy("path").agg(F.min("version").alias("version"))
    sidecars = rows.select("p_partkey", F.concat("path", F.lit(".sha1")).alias("relative_path"))
    joined = sidecars.withColumn("path", paths.sidecar_parent(F.col("relative_path"))).join(parents, "path", "left")
    return joined.select("p_partkey", "relative_path", F.coalesce("version", F.lit("none")).alias("version"))


def _keyed_content(spark: SparkSession, sf_dir: str, where: str, sha: str) -> DataFrame:
    rows = _files(spark, sf_dir).where(where).withColumns({"kind": F.lit("artifact"), "sha256": F.expr(sha)})
    rows = rows.groupBy("kind", "domain", "group_id", "artifact_id", "version", "filename").agg(F.max("sha256").alias("sha256")).withColumn("content_id", content_id("artifact"))
    return rows.withColumn("relative_path", F.lit(None).cast("string")).withColumn("labels", F.lit(None).cast("map<string,string>")).select(*CONTENT.names)


@query(f"""WITH {_FILES}, k AS (SELECT group_id, artifact_id, version, filename, max(CASE WHEN p_partkey % 4 = 0 THEN 'old' END) AS sha256 FROM files WHERE p_partkey % 2 = 0 GROUP BY ALL),
    n AS (SELECT DISTINCT group_id, artifact_id, version, filename, 'new' AS sha256 FROM files WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 1),
    release AS (SELECT coalesce(k.group_id, n.group_id) AS group_id, coalesce(k.filename, n.filename) AS filename, coalesce(k.version, n.version) AS version, coalesce(k.sha256, n.sha256) AS sha256
        FROM k FULL JOIN n ON (k.group_id, k.artifact_id, k.version, k.filename) = (n.group_id, n.artifact_id, n.version, n.filename))
    SELECT group_id, filename, version, sha256 FROM release WHERE NOT suffix(version, '-SNAPSHOT')
    UNION ALL SELECT group_id, filename, version, sha256 FROM (SELECT * FROM k UNION ALL SELECT * FROM n) WHERE suffix(version, '-SNAPSHOT')""")
def insert_or_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First writer wins and missing blobs are filled; another file of a snapshot is other content."""
    known = _keyed_content(spark, sf_dir, "p_partkey % 2 = 0", "CASE WHEN p_partkey % 4 = 0 THEN 'old' END")
    new = _keyed_content(spark, sf_dir, "p_partkey % 3 = 0 OR p_partkey % 2 = 1", "'new'")
    return content.saved(known, new).select("group_id", "filename", "version", "sha256")


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-30 18:00:00')""")
def cached_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as content, purchases as what a remote gave, since the latest version's time."""
    fetches = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("content_id"), F.col("event_type").alias("remote_id"), F.col("ts").alias("created"))
    versions = spark.createDataFrame([("r", 1, "2024-01-02 00:00:00"), ("r", 2, "2024-01-30 18:00:00")], "repo_id string, version long, created string").withColumn("created", F.col("created").cast("timestamp"))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("content_id"))
    return remote.cached(rows, fetches, versions, "r", "purchase").select("c_custkey")


# --- listing


@query(f"""WITH {_FILES}, f AS (SELECT * FROM files WHERE artifact_id IN (SELECT artifact_id FROM files WHERE p_partkey = 0)), n AS (SELECT count(*) AS n FROM f)
    SELECT p_partkey, group_id, version, n.n AS count, n.n > 30 AS has_next, true AS has_previous FROM f, n ORDER BY p_partkey LIMIT 20 OFFSET 10""")
def filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of an equality filter, with the count of all rows."""
    rows = _files(spark, sf_dir)
    name = rows.where("p_partkey = 0").select("artifact_id").first()[0]
    return listing.counted_page(listing.filtered(rows, "artifact", artifact_id=name), "p_partkey", 10, 20).select("p_partkey", "group_id", "version", "count", "has_next", "has_previous")


@query(f"WITH {_FILES} SELECT p_partkey, group_id, artifact_id, version, filename FROM files WHERE group_id = 'brand.1.economy' AND artifact_id = 'red-widget'")
def artifact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.filtered(_files(spark, sf_dir), "artifact", group_id="brand.1.economy", artifact_id="red-widget").select("p_partkey", "group_id", "artifact_id", "version", "filename")


_LABELS = "CASE WHEN event_type = 'error' THEN map('level', 'high', 'user', cast(user_id AS string)) WHEN event_type = 'view' THEN map('type', 'page', 'user', cast(user_id AS string)) ELSE map('type', event_type) END AS labels"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr("event_id", "user_id", _LABELS)


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'error') AND contains(cast(user_id AS string), '1') AND event_type = 'view'")
def label_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.selected(_labelled(spark, sf_dir), labels="type=page,user~1").select("event_id")


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'signup') OR (event_type = 'view' AND user_id = 3)")
def label_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = "label_select='level' OR label_select='type=signup' OR (label_select=\"type=page\" AND user_id=3)"
    return listing.selected(_labelled(spark, sf_dir), q=q).select("event_id")


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'done=yes,level=high' WHEN 'view' THEN 'done=yes,type=page' ELSE 'done=yes,type=' || event_type END AS labels FROM events""")
def label_set_unset(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = labels.set_label(labels.unset_label(F.col("labels"), "user"), "done", "yes")
    shown = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return _labelled(spark, sf_dir).select("event_id", F.array_join(shown, ",").alias("labels"))


@query("""SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2""")
def row_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders a principal may see by grants on nations."""
    nations = _table(spark, sf_dir, "nation")
    grants = nations.select(F.concat(F.lit("p"), "n_regionkey").alias("principal"), F.lit("object").alias("scope"), F.col("n_nationkey").cast("string").alias("object_id"), F.lit("view").alias("permission"))
    rows = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").cast("string").alias("repo_id"))
    return listing.scoped(rows, grants, "p2", "view").select("o_orderkey")


@query(f"""WITH {_FILES}, one AS (SELECT group_id, artifact_id, version, filename FROM files WHERE p_partkey = 7)
    SELECT count(*) AS n, min(p_partkey) AS p_partkey FROM files SEMI JOIN one USING (group_id, artifact_id, version, filename)""")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files at one path, found by its parts."""
    rows = _files(spark, sf_dir).withColumn("kind", F.lit("artifact"))
    path = rows.where("p_partkey = 7").select(F.concat_ws("/", paths.group_path(F.col("group_id")), "artifact_id", "version", "filename")).first()[0]
    return listing.at_path(path, rows).agg(F.count("*").alias("n"), F.min("p_partkey").alias("p_partkey"))


_ONE_PATH = "'org.' || lower(p_type) AS group_id, replace(p_name, ' ', '-') AS artifact_id, cast(p_partkey AS string) || '.0' AS version, 'f.jar' AS filename"


@query(f"SELECT p_partkey, group_id, artifact_id, version FROM (SELECT p_partkey, {_ONE_PATH} FROM part) WHERE p_partkey = 8")
def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one content of a snapshot at a path; it is an error if there is none or another."""
    rows = _table(spark, sf_dir, "part").selectExpr("p_partkey", "'artifact' AS kind", "cast(p_partkey AS string) AS content_id", *_columns(_ONE_PATH))
    path = rows.where("p_partkey = 8").select(F.concat_ws("/", paths.group_path(F.col("group_id")), "artifact_id", "version", "filename")).first()[0]
    members = rows.where("p_partkey % 4 = 0").select("kind", "content_id")
    return listing.lookup(path, rows, members).select("p_partkey", "group_id", "artifact_id", "version")


@query(f"WITH {_STAYS} SELECT o_orderkey, o_totalprice FROM orders WHERE cast(o_orderkey AS string) IN (SELECT content_id FROM stays WHERE {_AT.format(n=4)})")
def snapshot_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the content that is in a snapshot."""
    rows = _table(spark, sf_dir, "orders").withColumn("content_id", F.col("o_orderkey").cast("string"))
    return listing.in_snapshot(rows, snapshots.snapshot(_events(spark, sf_dir), "r", 4)).select("o_orderkey", "o_totalprice")


@query(f"WITH {_STAYS} SELECT content_id FROM stays WHERE {_AT.format(n=5)}")
def snapshot_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot from an earlier one that is kept whole, and the events since."""
    events = _events(spark, sf_dir)
    return snapshots.resumed(snapshots.snapshot(events, "r", 3), events.where("version > 3 AND version <= 5")).select("content_id")


@query(f"WITH {_STAYS} SELECT content_id FROM stays WHERE {_AT.format(n=5)}")
def snapshot_by_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.at_version(snapshots.intervals(_events(spark, sf_dir)), 5).select("content_id")


@query(f"WITH {_FILES} SELECT p_partkey, group_id, version FROM files JOIN part USING (p_partkey) WHERE p_name = 'red widget' AND p_type = 'ECONOMY' AND artifact_id = 'red-widget'")
def package_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages by name, packaging and artifact."""
    rows = _files(spark, sf_dir, "p_name AS name", "p_type AS packaging")
    return listing.filtered(rows, "package", name="red widget", packaging="ECONOMY", artifact_id="red-widget").select("p_partkey", "group_id", "version")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'")
def domain_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one tenant; an order's priority is its domain."""
    return listing.of_domain(_table(spark, sf_dir, "orders").withColumn("domain", F.col("o_orderpriority")), "2-HIGH").select("o_orderkey")


@query(f"WITH {_FILES} SELECT cast(p_partkey AS string) AS content_id, group_id, artifact_id, version, filename FROM files")
def shown_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.shown(_files(spark, sf_dir).withColumn("content_id", F.col("p_partkey").cast("string")), "artifact")


@query(f"WITH {_FILES} SELECT p_partkey, group_id FROM files WHERE p_partkey > 50 ORDER BY p_partkey LIMIT 20")
def page_after_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page behind a key, without sorting the pages before it."""
    return listing.page_after(_files(spark, sf_dir), "p_partkey", 50, 20).select("p_partkey", "group_id")


@query("SELECT c_mktsegment AS repository, min(c_name) AS name FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY c_mktsegment")
def first_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first distribution, by name, of each repository; some serve none."""
    rows = _table(spark, sf_dir, "customer").selectExpr("'d' AS domain", "c_name AS name", "CASE WHEN c_nationkey % 5 <> 0 THEN c_mktsegment END AS repository")
    return first_distributions(rows).select("repository", "name")


# --- verbs of an engine, in a folder of their own


def _engine(spark: SparkSession) -> Engine:
    """An empty engine in the shared folder of the session; a local session may have none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='granary-')}"
    return Engine(spark, f"{base.rstrip('/')}/engines/{uuid.uuid4().hex}")


def _paths(spark: SparkSession, sf_dir: str, body: str, where: str = "true") -> DataFrame:
    path = F.concat_ws("/", paths.group_path(F.col("group_id")), "artifact_id", "version", "filename")
    return _files(spark, sf_dir).where(where).select(path.alias("relative_path"), F.expr(body).cast("binary").alias("content")).distinct()


_PLACED = f"{_FILES}, placed AS (SELECT DISTINCT replace(group_id, '.', '/') || '/' || artifact_id || '/' || version || '/' || filename AS relative_path, version FROM files)"


@query(f"""WITH {_PLACED} SELECT 1 AS at, relative_path, sha256('one') AS sha256 FROM placed
    UNION ALL SELECT 2, relative_path, sha256(CASE WHEN suffix(version, '-SNAPSHOT') THEN 'two' ELSE 'one' END) FROM placed""")
def snapshot_redeploy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files are deployed twice, with another body the second time: a new version in which
    snapshot files are replaced and releases stay, while version 1 keeps its own."""
    repo = _engine(spark).repository("r")
    for body in ("'one'", "'two'"):
        repo.deploy(_paths(spark, sf_dir, body), derive=False)
    rows = [repo.content("artifact", v).select(F.lit(v).alias("at"), "relative_path", "sha256") for v in (1, 2)]
    return rows[0].unionByName(rows[1])


@query(f"""WITH {_PLACED}, b AS (SELECT sha256(relative_path) AS sha256, cast(strlen(relative_path) AS bigint) AS size FROM placed) SELECT sha256, size, count(*) AS n FROM b GROUP BY ALL""")
def blob_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that are uploaded twice are kept once; the second upload appends none."""
    engine = _engine(spark)
    files = _paths(spark, sf_dir, "concat_ws('/', replace(group_id, '.', '/'), artifact_id, version, filename)").withColumn("domain", F.lit("d"))
    for _ in range(2):
        engine.upload(files, parse_poms=False)
    return engine.store.read("blobs").groupBy("sha256", "size").agg(F.count("*").alias("n"))


@query(f"""WITH {_PLACED} SELECT relative_path, 'brand=' || string_split(relative_path, '/')[2] || ',type=' || CASE WHEN suffix(relative_path, '.pom') THEN 'pom' ELSE 'file' END AS labels FROM placed""")
def upload_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels given as a JSON object with each file."""
    files = _paths(spark, sf_dir, "'x'").withColumn("domain", F.lit("d"))
    kind = F.when(F.endswith("relative_path", F.lit(".pom")), F.lit("pom")).otherwise("file")
    files = files.withColumn("labels", F.to_json(F.struct(kind.alias("type"), F.split("relative_path", "/")[1].alias("brand"))))
    shown = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return _engine(spark).upload(files, parse_poms=False).select("relative_path", F.array_join(shown, ",").alias("labels"))


@query(f"""WITH {_PLACED}
    SELECT 'add' AS op, 1 AS version, count(*) AS n FROM placed UNION ALL SELECT 'remove', 2, count(*) FROM placed WHERE suffix(version, '-SNAPSHOT')""")
def version_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of two versions: all files come, then the snapshots' files go."""
    repo = _engine(spark).repository("r")
    repo.deploy(_paths(spark, sf_dir, "'x'"), derive=False)
    gone = repo.content("artifact").where(paths.is_snapshot(F.col("version")))
    repo.modify(remove=gone.select("kind", "content_id"), derive=False)
    return repo.store.read("events").groupBy("op", F.col("version").cast("int").alias("version")).agg(F.count("*").alias("n"))


@query(f"""WITH {_TOUCHED} SELECT 'add' AS op, a.group_id, a.artifact_id, a.version FROM alive a WHERE EXISTS (SELECT 1 FROM known k WHERE (k.group_id, k.artifact_id, k.version) = (a.group_id, a.artifact_id, a.version))
        OR EXISTS (SELECT 1 FROM there t WHERE (t.group_id, t.artifact_id, t.version) = (a.group_id, a.artifact_id, a.version) AND t.filename = t.artifact_id || '-' || t.version || '.pom')
    UNION ALL SELECT 'remove', group_id, artifact_id, version FROM (SELECT group_id, artifact_id, version FROM touched EXCEPT SELECT * FROM alive)""")
def packages_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change of artifacts asks of the packages: releases whose package is there, old or
    made from a project file, and those whose package goes."""
    rows = _files(spark, sf_dir, "sha2(cast(p_partkey AS string), 256) AS sha256", "p_name AS name")
    known = rows.where("p_partkey % 6 = 0").select(*packages.KEY).distinct().withColumns({n: F.lit(None).cast(POM[n].dataType) for n in POM.names}).withColumn("content_id", content_id("package")).select(*PACKAGES.names)
    blobs = rows.select("domain", "sha256", F.format_string("<project><name>%s</name></project>", "name").cast("binary").alias("content"))
    there = rows.where("p_partkey % 4 = 0 OR p_partkey % 3 = 0")
    fresh, ids, dead = packages.maintained(rows.where("p_partkey % 3 = 1"), rows.where("p_partkey % 3 = 2"), there, known, blobs)
    named = known.unionByName(fresh).select("content_id", "group_id", "artifact_id", "version").distinct()
    alive = named.join(ids.distinct(), "content_id", "left_semi").drop("content_id").withColumn("op", F.lit("add"))
    return alive.unionByName(dead.drop("domain").withColumn("op", F.lit("remove"))).select("op", "group_id", "artifact_id", "version")


# --- strings and JSON


@query("""SELECT p_partkey, 'x-' || p_name || '-' || p_type || '/' || chr(36) || '{none}' AS resolved FROM part""")
def resolve_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested placeholders; unknown ones stay."""
    values = F.create_map(F.lit("a"), F.concat(F.lit("${b}"), F.lit("-"), F.col("p_type")), F.lit("b"), F.col("p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", documents.resolved(F.lit("x-${a}/${none}"), values).alias("resolved"))


@query("SELECT p_partkey, p_name AS name, CAST(NULL AS varchar) AS url FROM part")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of a package as JSON and back."""
    licenses = F.array(F.struct(F.col("p_name").alias("name"), F.lit(None).cast("string").alias("url")))
    rows = _table(spark, sf_dir, "part").select("p_partkey", pom.as_json(licenses).alias("j"))
    back = pom.from_json(F.col("j"), "licenses")[0]
    return rows.select("p_partkey", back["name"].alias("name"), back["url"].alias("url"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.try_element_at(labels.parsed_labels(F.col("props")), F.lit("k")).alias("k"))


@query("SELECT p_partkey, 'a&amp;b &lt;' || p_name || '&gt;' AS escaped FROM part")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", documents.escaped(F.concat(F.lit("a&b <"), "p_name", F.lit(">"))).alias("escaped"))
