"""Project files: cases of the survey's fixtures, built here."""

from pyspark.sql import functions as F

from granary.functions import documents, pom

NS = "http://maven.apache.org/POM/4.0.0"


def of(inner, ns=True):
    return pom.pom_fields(f'<project xmlns="{NS}">{inner}</project>' if ns else f"<project>{inner}</project>")


def test_fields_and_defaults():
    got = of("<name>A</name><url/>")
    assert got == {"name": "A", "description": None, "url": None, "packaging": "jar", "scm_url": None, "licenses": None, "dependencies": None}
    assert of("<packaging/>")["packaging"] is None
    assert of("<name>A</name>", ns=False)["name"] == "A"
    assert of("<licenses/><dependencies/>")["licenses"] == [] == of("<dependencies/>")["dependencies"]


def test_lists():
    got = of("<licenses><license><name>L</name></license><license><url>u</url></license></licenses>")
    assert got["licenses"] == [{"name": "L", "url": ""}, {"name": "", "url": "u"}]
    dep = "<dependency><groupId>g</groupId><artifactId>a</artifactId>{}</dependency>"
    many = "".join(dep.format(x) for x in ("", "<optional>true</optional>", "<optional>TRUE</optional>", "<scope>test</scope><version>1</version>"))
    got = of(f"<dependencies>{many}</dependencies><dependencyManagement><dependencies>{dep}</dependencies></dependencyManagement>")["dependencies"]
    assert [(d["optional"], d["scope"], d["version"]) for d in got] == [(False, None, ""), (True, None, ""), (False, None, ""), (False, "test", "1")]


def test_placeholders():
    chained = "<properties><a>${b}/docs</a><b> https://${c} </b><c>example.com</c></properties><url>${a}</url>"
    assert of(chained)["url"] == "https://example.com/docs"
    circular = of("<properties><a>${b}</a><b>${a}</b></properties><name>${a}</name>")["name"]
    assert "${" in circular
    assert of("<name>${nope}</name>")["name"] == "${nope}"
    assert of("<artifactId>x</artifactId><name>${project.artifactId}</name>")["name"] == "x"


def test_text_rules():
    assert of("<name> a </name>")["name"] == " a "
    assert of("<name>a<!-- c -->b</name>")["name"] == "ab"
    assert of("<name>a<b>c</b>d</name>")["name"] == "a"
    assert of("<name>one</name><name>two</name>")["name"] == "one"
    assert of("<scm/>")["scm_url"] is None
    assert pom.pom_fields(f'<m:project xmlns:m="{NS}"><m:name>p</m:name></m:project>')["name"] == "p"
    assert pom.pom_fields('<project xmlns="urn:other"><name>p</name></project>')["name"] is None


def test_refused():
    for bad in ("", "<a>", "no xml", "<a/>junk", '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>', None):
        assert pom.pom_fields(bad) is None


def test_udf_keeps_null_and_empty_apart(spark):
    rows = spark.createDataFrame([(1, "<project/>"), (2, "<project><licenses/></project>"), (3, "<project>"), (4, None)], "i int, b string")
    got = {r["i"]: r["x"] for r in rows.select("i", pom.parsed_pom(F.col("b").cast("binary")).alias("x")).collect()}
    assert (got[1]["ok"], got[1]["licenses"], got[2]["licenses"], got[3]["ok"], got[4]["ok"]) == (True, None, [], False, False)


def test_resolved_column_equals_parser(spark):
    cases = {"${a}": "x-${b}", "${a}${a}": "1", "p${a}q": "${a}${a}", "${${a}}": "b", "${": "z", "plain": "z", "${n}": "z", "": "z"}
    rows = spark.createDataFrame([(t, {"a": v, "b": "${c}", "c": "deep"}) for t, v in cases.items()], "t string, p map<string,string>")
    got = {r[0]: r[1] for r in rows.select("t", documents.resolved(F.col("t"), F.col("p"))).collect()}
    assert got == {t: pom.resolve(t, {"a": v, "b": "${c}", "c": "deep"}) for t, v in cases.items()}


def test_index_fields():
    assert pom.index_fields("<metadata><groupId>g</groupId><version>1-SNAPSHOT</version></metadata>") == {"ok": True, "group_id": "g", "artifact_id": "", "version": "1-SNAPSHOT"}
    assert not pom.index_fields("<metadata>")["ok"]
