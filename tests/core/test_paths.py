"""Paths: expectations are those of the survey's fixtures."""

import itertools
import posixpath
import re

import pytest
from pyspark.sql import functions as F

from granary.functions import paths


def expected(path):
    folder, filename = posixpath.split(path)
    above, last = posixpath.split(folder)
    if re.match(r"(?=[^\n]*\d)[a-zA-Z0-9]", last):
        above, artifact = posixpath.split(above)
        return above.replace("/", "."), artifact, last, filename
    return above.replace("/", "."), last, None, filename


NAMED = {
    "org/springframework/cloud/spring-cloud-config-server/4.3.0-redhat-1/x.jar": ("org.springframework.cloud", "spring-cloud-config-server", "4.3.0-redhat-1", "x.jar"),
    "com/example/my-lib/final-1.2.3/my-lib-final-1.2.3.jar": ("com.example", "my-lib", "final-1.2.3", "my-lib-final-1.2.3.jar"),
    "academy/alex/custommatcher/1.0/custommatcher-1.0-javadoc.jar.sha1": ("academy.alex", "custommatcher", "1.0", "custommatcher-1.0-javadoc.jar.sha1"),
    "com/x/log4j/maven-metadata.xml": ("com", "x", "log4j", "maven-metadata.xml"),
    ".meta/prefixes.txt": ("", ".meta", None, "prefixes.txt"),
    "foo.jar": ("", "", None, "foo.jar"),
}


def test_path_parts(spark):
    segments = ["", "a", "1", "_1", "log4j", "x.y"]
    made = ["/".join(p) for n in range(1, 6) for p in itertools.product(segments, repeat=n)]
    cases = NAMED | {p: expected(p) for p in made if not p.startswith("/") and p}
    rows = spark.createDataFrame([(p,) for p in cases], "path string").select("path", paths.path_parts(F.col("path")).alias("p")).select("path", "p.*").collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == cases


@pytest.mark.parametrize(("text", "yes"), [("log4j", True), ("1_0", True), ("final-1.2.3", True), ("mylib", False), ("_1", False), ("", False), ("a\n1", False), ("a٣", True)])
def test_version(spark, text, yes):
    assert spark.range(1).select(paths.is_version(F.lit(text))).first()[0] is yes


def test_extension_and_classifier(spark):
    cases = {
        "lib-1.0.jar": ("jar", None), "lib-1.0-sources.jar": ("jar", "sources"), "lib-1.0.tar.gz": ("tar.gz", None), "lib-1.0-linux.tar.gz": ("tar.gz", "linux"),
        "lib-1.0.jar.sha1": ("jar.sha1", None), "lib-1.0-x": ("", "x"), "other.zip": ("zip", None), "other": ("", None), "lib-1.0": ("0", None), "lib-1.0-.jar": ("jar", ""), "lib-1.0x.jar": ("jar", None),
    }
    rows = spark.createDataFrame([(c,) for c in cases], "f string").select("f", paths.extension_and_classifier(F.col("f"), F.lit("lib"), F.lit("1.0")).alias("x")).collect()
    assert {r["f"]: tuple(r["x"]) for r in rows} == cases


def test_prefix(spark):
    cases = {"com.fasterxml.jackson.core": "/com/fasterxml", "commons-fileupload": "/commons-fileupload", "": "/", "a.": "/a/", ".a.b": "//a", "a..b": "/a/"}
    rows = spark.createDataFrame([(c,) for c in cases], "g string").select("g", paths.prefix(F.col("g"))).collect()
    assert {r[0]: r[1] for r in rows} == cases


def test_classes_of_files_differ(spark):
    rows = ["a/maven-metadata.xml", "a/b.xml", "a/b.xml.sha512", "a/b.jar", ".meta/prefixes.txt", "maven-metadata.xml"]
    got = spark.createDataFrame([(p,) for p in rows], "p string").select("p", paths.is_metadata_path(F.col("p")), paths.is_stream_only(F.col("p"))).collect()
    assert [tuple(r)[1:] for r in got] == [(True, True), (True, False), (True, True), (False, False), (False, True), (True, False)]


def test_no_two_keys_have_one_id(spark):
    from granary.schema import GAV, content_id

    rows = [("a", "b\n1=c", "d", "f"), ("a", "b", "c\n1=d", "f"), ("a", "b\n=c", "d", "f"), ("a", "b", None, "f"), ("a", "b", "", "f"), ("a", "b", "~", "f"), ("a\n1=b", "c", "d", "f"), ("a", "b", "c", "1=d\nf")]
    df = spark.createDataFrame([("d", *r) for r in rows], f"domain string, {' string, '.join(GAV)} string, filename string").withColumn("sha256", F.lit("x"))
    assert df.select(content_id("artifact")).distinct().count() == len(rows)
