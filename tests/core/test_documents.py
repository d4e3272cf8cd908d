"""Index documents are compared with the standard library's writer."""

import hashlib
from xml.etree.ElementTree import Element, SubElement, tostring

from pyspark.sql import functions as F

from granary.functions import documents, labels
from granary.operators import indexes, listing

STAMP = "20240102030405"


def as_of():
    return F.lit("2024-01-02 03:04:05").cast("timestamp")


def written(root):
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + tostring(root, encoding="unicode") + "\n"


def tree(tag, *children):
    root = Element(tag)
    for name, value in children:
        SubElement(root, name).text = value
    return root


def test_pair_document(spark):
    files = [("d", "g&<h>", "a", v, f"a-{v}.jar") for v in ("10.0", "9.0", "9.1-SNAPSHOT")] + [("d", "only", "snap", "1-SNAPSHOT", "x.jar")]
    rows = indexes.pair_documents(spark.createDataFrame(files, "domain string, group_id string, artifact_id string, version string, filename string"), as_of()).collect()
    assert len(rows) == 8
    for group, artifact, versions, release in (("g&<h>", "a", ["10.0", "9.0", "9.1-SNAPSHOT"], "9.0"), ("only", "snap", ["1-SNAPSHOT"], "")):
        root = tree("metadata", ("groupId", group), ("artifactId", artifact))
        part = SubElement(root, "versioning")
        SubElement(part, "latest").text = versions[-1]
        SubElement(part, "release").text = release
        listed = SubElement(part, "versions")
        for v in versions:
            SubElement(listed, "version").text = v
        SubElement(part, "lastUpdated").text = STAMP
        own = {r["filename"]: r["body"] for r in rows if r["group_id"] == group}
        body = written(root)
        assert own["maven-metadata.xml"] == body
        assert own["maven-metadata.xml.sha1"] == hashlib.sha1(body.encode()).hexdigest()
        assert own["maven-metadata.xml.sha256"] == hashlib.sha256(body.encode()).hexdigest()
        assert own["maven-metadata.xml.md5"] == hashlib.md5(body.encode()).hexdigest()


def test_triple_document(spark):
    v = "1-SNAPSHOT"
    files = [("d", "g", "a", v, f) for f in (f"a-{v}.jar", f"a-{v}.pom", f"a-{v}-sources.jar", "odd")]
    rows = indexes.triple_documents(spark.createDataFrame(files, "domain string, group_id string, artifact_id string, version string, filename string"), as_of()).collect()
    root = tree("metadata", ("groupId", "g"), ("artifactId", "a"), ("version", v))
    part = SubElement(root, "versioning")
    SubElement(SubElement(part, "snapshot"), "localCopy").text = "true"
    listed = SubElement(part, "snapshotVersions")
    for classifier, extension in (("sources", "jar"), (None, "jar"), (None, "pom"), (None, "")):
        one = SubElement(listed, "snapshotVersion")
        if classifier:
            SubElement(one, "classifier").text = classifier
        for name, value in (("extension", extension), ("value", v), ("updated", STAMP)):
            SubElement(one, name).text = value
    SubElement(part, "lastUpdated").text = STAMP
    assert {r["filename"]: r["body"] for r in rows}["maven-metadata.xml"] == written(root)
    assert rows[0]["relative_path"].startswith(f"g/a/{v}/")


def test_prefix_file(spark):
    files = spark.createDataFrame([("d", g) for g in ("com.b.c", "com.a", "x", "com.b.d")], "domain string, group_id string")
    assert indexes.prefix_file(files).first()["body"] == "## repository-prefixes/2.0\n/com/a\n/com/b\n/x\n"
    assert indexes.prefix_file(files.limit(0)).count() == 0


def test_strip(spark):
    assert spark.range(1).select(documents.stripped(F.lit("\t  a b\n "))).first()[0] == "a b"


def test_labels(spark):
    rows = [{"run": "R", "type": t} for t in ("jar", "pom", "sbom") for _ in range(4)] + [{"run": "S"}, None]
    df = spark.createDataFrame([(x,) for x in rows], "labels map<string,string>")
    count = lambda **k: listing.selected(df, **k).count()
    assert [count(labels=x) for x in ("run=R", "run=R,type=jar", "run=R,type", "run=R,type~bo", "type!=jar")] == [12, 4, 12, 4, 8]
    assert count(q="label_select='type=jar' OR label_select='type=pom'") == 8
    assert count(q="NOT (label_select='run=R') AND label_select='run'") == 1
    changed = df.select(labels.set_label(labels.unset_label(F.col("labels"), "type"), "run", "T").alias("labels"))
    assert listing.selected(changed, labels="run=T").count() == 14
    assert spark.range(1).select(labels.parsed_labels(F.lit("not json"))).first()[0] is None
