"""Whole repositories: scenarios of the survey's fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from granary.operators import indexes, listing, snapshots
from granary.plans import repository
from granary.plans.repository import Engine
from granary.sources import tables
from granary.sources.files import binary_files, new_blobs
from granary.sources.tables import Conflict, Store
from granary.streaming.ingest import ingest


def when(day):
    return dt.datetime(2024, 1, day)


def jar(group, artifact, version, suffix=".jar", body="x"):
    return (f"{group.replace('.', '/')}/{artifact}/{version}/{artifact}-{version}{suffix}", body.encode())


def pom(group, artifact, version, name):
    return jar(group, artifact, version, ".pom", f"<project><name>{name}</name></project>")


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store")


def deploy(repo, *files, day=1, **options):
    return repo.deploy(repo.spark.createDataFrame(list(files), "relative_path string, content binary"), when(day), **options)


def names(repo, kind="metadata"):
    return sorted(r[0] for r in repo.content(kind).select("relative_path").collect())


def test_life_of_a_repository(engine):
    repo = engine.repository("r")
    assert repo.latest_version() == 0 and repo.members().count() == 0
    assert deploy(repo, jar("com.x", "lib", "1.0"), jar("com.x", "lib", "2.0-SNAPSHOT"), pom("com.x", "lib", "2.0-SNAPSHOT", "V1")) == 1
    assert len(names(repo)) == 9
    index = repo.content("metadata", artifact_id="lib", version=None, filename="maven-metadata.xml")
    sha = index.first()["sha256"]
    body = bytes(engine.store.read("blobs").where(F.col("sha256") == sha).first()["content"]).decode()
    assert "<latest>2.0-SNAPSHOT</latest><release>1.0</release>" in body
    assert [r["name"] for r in repo.content("package").collect()] == ["V1"]
    # the same again changes nothing but what a snapshot's new file asks for
    assert deploy(repo, jar("com.x", "lib", "1.0")) == 1
    # a snapshot's project file is refreshed
    assert deploy(repo, pom("com.x", "lib", "2.0-SNAPSHOT", "V2"), jar("com.x", "lib", "3.0"), day=2) == 2
    assert [r["name"] for r in repo.content("package").collect()] == ["V2"]
    assert repo.content("artifact", 1).count() == 3 and repo.content("artifact").count() == 4
    # remove the snapshot: its index and package go, the pair's stay
    gone = repo.content("artifact", version="2.0-SNAPSHOT").select("kind", "content_id")
    assert repo.modify(remove=gone, as_of=when(3)) == 3
    assert len(names(repo)) == 5 and repo.content("package").count() == 0
    assert repo.changes(3, "remove").where(F.col("kind") == "artifact").count() == 2
    # remove all
    assert repo.modify(remove="*", as_of=when(4)) == 4
    assert repo.members().count() == 0
    # an exact copy of an old version, and promotion by reference
    assert repo.modify(base_version=1, as_of=when(5), derive=False) == 5
    assert snapshots.delta(repo.members(), repo.members(1)).count() == 0
    other = engine.repository("other")
    assert other.promote(repo, repo.content("artifact", version="1.0").select("content_id"), when(6)) == 1
    assert other.content("artifact").count() == 1 and len(names(other)) == 5
    # a destroyed version is gone, the others stay
    repo.destroy_version(5)
    assert repo.latest_version() == 4 and repo.members().count() == 0
    with pytest.raises(LookupError):
        repo.members(5)
    assert repo.members(1).count() == 13
    assert deploy(repo, jar("com.y", "z", "1"), day=7) == 6
    assert repo.content("artifact").count() == 1


def test_repair(engine):
    repo = engine.repository("r")
    assert repo.repair_metadata() == 0
    stale = b"<metadata><groupId>com.x</groupId><artifactId>lib</artifactId></metadata>"
    orphan = b"<metadata><groupId>com.none</groupId><artifactId>gone</artifactId></metadata>"
    files = [jar("com.x", "lib", "1.0"), jar("com.x", "lib", "1.1-SNAPSHOT"), ("com/x/lib/maven-metadata.xml", stale), ("com/none/gone/maven-metadata.xml", orphan)]
    assert deploy(repo, *files, derive=False) == 1
    assert repo.repair_metadata(when(2)) == 2
    paths = names(repo)
    assert len(paths) == 9 and not any("none" in p for p in paths)
    assert repo.repair_metadata(when(2)) == 2
    # maintenance after a change gives what a full rebuild gives
    assert deploy(repo, jar("com.x", "lib", "2.0"), jar("org.y", "m", "3-SNAPSHOT"), day=3) == 3
    documents, gone = indexes.rebuilt(repo.content("artifact"), repo.content("metadata"), F.lit(when(3)))
    have = {r[0] for r in repo.content("metadata").select("content_id").collect()}
    full = {r["content_id"] for r in documents.collect()}
    untouched = {r["content_id"] for r in repo.content("metadata").where("version = '1.1-SNAPSHOT'").collect()}
    assert have - full == untouched and full - have == {r["content_id"] for r in documents.where("version = '1.1-SNAPSHOT'").collect()}


def test_pull_and_cached_content(engine):
    repo = engine.repository("r")
    files = engine.spark.createDataFrame([jar("com.x", "lib", "1.0"), pom("com.x", "lib", "1.0", "N"), ("com/x/lib/maven-metadata.xml", b"<metadata/>")], "relative_path string, content binary")
    assert repo.pull(files, "up", when(1)) == 1
    assert names(repo) == [] and repo.content("package").count() == 0 and repo.content("artifact").count() == 2
    assert repo.pull(files, "up", when(2)) == 1
    other = engine.repository("other")
    assert other.add_cached_content("up", when(3)) == 1
    assert other.content("package").count() == 1 and len(names(other)) == 5
    assert other.add_cached_content("nobody", when(4)) == 1
    # without a remote, the repository's own
    third = engine.repository("third")
    with pytest.raises(ValueError):
        third.add_cached_content()
    engine.add_remote("up", "https://example.org")
    engine.add_repository("third", remote="up")
    assert third.add_cached_content(as_of=when(5)) == 1 and third.content("artifact").count() == 2


def test_newly_added_content_displaces(engine):
    repo = engine.repository("r")
    one, two = (f"<metadata><groupId>g</groupId><artifactId>a</artifactId><x>{i}</x></metadata>".encode() for i in (1, 2))
    assert deploy(repo, ("g/a/maven-metadata.xml", one)) == 1
    assert deploy(repo, ("g/a/maven-metadata.xml", two)) == 2
    assert repo.content("metadata").count() == 1 and repo.body("g/a/maven-metadata.xml") == two
    assert repo.body("g/a/maven-metadata.xml", 1) == one
    side = (("g/a/maven-metadata.xml.sha1", b"00"),)
    assert deploy(repo, *side) == 3
    assert repo.content("metadata", filename="maven-metadata.xml.sha1").first()["group_id"] == "g"


def test_refused_files(engine):
    repo = engine.repository("r")
    assert deploy(repo, ("/abs/a/1/f.jar", b"x"), ("foo.jar", b"x"), ("g/a/maven-metadata.xml", b"<broken"), ("g/a/1/" + "f" * 300, b"x")) == 0
    assert sorted(r[1].split()[0] for r in engine.store.read("quarantine").collect()) == ["absolute", "artifact", "filename", "index"]


def test_no_pom_no_package_and_backfill(engine):
    repo = engine.repository("r")
    assert deploy(repo, jar("com.x", "lib", "1.0")) == 1
    assert repo.content("package").count() == 0
    assert deploy(repo, pom("com.x", "old", "1", "Old"), derive=False) == 2
    engine.backfill_packages()
    assert [r["name"] for r in engine.store.read("packages").collect()] == ["Old"]


def test_labels_and_scope(engine, spark):
    repo = engine.repository("r")
    deploy(repo, jar("com.x", "lib", "1.0"))
    one = repo.content("artifact").first()["content_id"]
    engine.label(one, "type", "jar")
    assert listing.selected(repo.content("artifact"), labels="type=jar").count() == 1
    engine.label(one, "type", None)
    assert listing.selected(repo.content("artifact"), labels="type").count() == 0
    rows = spark.createDataFrame([("a",), ("b",)], "repo_id string")
    grants = spark.createDataFrame([("viewer", "model", None, "view"), ("bob", "object", "b", "view"), ("eve", "object", "b", "change")], "principal string, scope string, object_id string, permission string")
    assert [listing.scoped(rows, grants, p, "view").count() for p in ("viewer", "bob", "eve", "none")] == [2, 1, 0, 0]


def test_settings_are_kept(engine, spark):
    engine.add_remote("up", "https://example.org")
    for bad in (lambda: engine.add_remote("x", ""), lambda: engine.add_remote("x", "u", "never"), lambda: engine.add_remote("up", "u"), lambda: engine.change_remote("up", policy="never"), lambda: engine.change_remote("up", color="red"), lambda: engine.add_repository("r", remote="none")):
        with pytest.raises(ValueError):
            bad()
    engine.add_remote("up", "https://example.com", domain="other")
    engine.add_repository("r", remote="up", description="first")
    engine.change_repository("r", description="second")
    for name in ("d2", "d1"):
        engine.add_distribution(name, f"base/{name}", "r")
    engine.change_remote("up", policy="streamed")
    again = Engine(spark, engine.store.root)  # after a restart
    assert again.remotes().where("domain = 'default'").first().asDict() == {"domain": "default", "name": "up", "url": "https://example.org", "policy": "streamed"}
    assert again.repositories().first()["description"] == "second"
    assert again.distribution_of("r").first()["base_path"] == "base/d1" and again.distribution_of("s").count() == 0
    again.drop_distribution("d1")
    assert [r["name"] for r in again.distributions().collect()] == ["d2"]
    with pytest.raises(LookupError):
        again.drop_distribution("d1")
    again.grant("bob", "view", "r")
    again.grant("eve", "view")
    again.revoke("eve", "view")
    assert again.grants().collect() == [("bob", "object", "r", "view")]


def test_a_redeployed_snapshot_is_a_new_version(engine):
    repo = engine.repository("r")
    assert deploy(repo, jar("g", "a", "1-SNAPSHOT", body="one"), jar("g", "a", "2", body="one"), derive=False) == 1
    assert deploy(repo, jar("g", "a", "1-SNAPSHOT", body="two"), day=2, derive=False) == 2
    path = "g/a/1-SNAPSHOT/a-1-SNAPSHOT.jar"
    assert repo.body(path) == b"two" and repo.body(path, 1) == b"one" and repo.content("artifact").count() == 2
    # a release keeps its first body
    assert deploy(repo, jar("g", "a", "2", body="two"), day=3, derive=False) == 2 and repo.body("g/a/2/a-2.jar") == b"one"


def test_each_file_of_a_deploy_is_a_version(engine):
    repo = engine.repository("r")
    for i, suffix in enumerate((".jar", ".jar.md5", ".pom")):
        assert deploy(repo, jar("g", "a", "1", suffix), derive=False) == i + 1
    assert [repo.members(v).count() for v in range(4)] == [0, 1, 2, 3]


def test_members_are_kept_whole_now_and_then(engine, monkeypatch):
    monkeypatch.setattr(repository, "WHOLE_EVERY", 2)
    monkeypatch.setattr(tables, "MERGE", 3)
    monkeypatch.setattr(tables, "CHECKPOINT", 4)
    repo = engine.repository("r")
    rows = engine.upload(engine.spark.createDataFrame([("default", *jar("g", "a", f"{i}")) for i in range(7)], "domain string, relative_path string, content binary"))
    ids = [r["content_id"] for r in rows.orderBy("version").collect()]
    one = lambda i: engine.spark.createDataFrame([("artifact", ids[i])], "kind string, content_id string")
    for i in range(5):
        assert repo.modify(one(i), as_of=when(i + 1), derive=False) == i + 1
        engine.label(ids[i], "n", str(i))
    assert repo.modify(remove=one(0), as_of=when(9), derive=False) == 6
    assert [repo.members(v).count() for v in range(7)] == [0, 1, 2, 3, 4, 5, 4]
    assert engine.store.whole_versions(repo.key) == [2, 4, 6]
    assert len(engine.store._state()["tables"]["events"]) < 6 and len(engine.store._state()["tables"]["content"]) < 6
    again = Engine(engine.spark, engine.store.root).repository("r")
    assert {r["labels"]["n"] for r in again.content("artifact").collect()} == {"1", "2", "3", "4"} and again.members(3).count() == 3


def test_writes_follow_the_change(engine):
    """A second, small deploy appends rows of its own only."""
    repo = engine.repository("r")
    deploy(repo, *(jar(f"com.x{i}", "lib", "1.0") for i in range(40)))
    folders = {t: {x[0] for x in v} for t, v in engine.store._state()["tables"].items()}
    deploy(repo, jar("com.x1", "lib", "2.0"), day=2)
    rows = {}
    for table, now in engine.store._state()["tables"].items():
        new = [x for x in now if x[0] not in folders.get(table, set())]
        assert {x[0] for x in now} >= folders.get(table, set())
        rows[table] = engine.store._load(table, new).count()
    assert rows["content"] == 5 and rows["events"] == 9 and rows["versions"] == 1 and rows["blobs"] <= 4
    engine.label(repo.content("artifact", version="2.0").first()["content_id"], "a", "b")
    last = engine.store._state()["tables"]["content"][-1]
    assert engine.store._load("content", [last]).count() == 1


def test_two_writers(engine, spark):
    """The second writer of a repository fails whole; writers of different ones do not meet."""
    other = Engine(spark, engine.store.root)
    deploy(engine.repository("r"), jar("g", "a", "1"), derive=False)
    with pytest.raises(Conflict), engine.store.transaction("default:r"):
        deploy(engine.repository("r"), jar("g", "a", "2"), derive=False)
        assert engine.repository("r").latest_version() == 2  # it sees its own writes, others do not
        assert other.repository("r").latest_version() == 1
        deploy(other.repository("r"), jar("g", "b", "1"), derive=False)
    repo = engine.repository("r")
    assert repo.latest_version() == 2 and {r["artifact_id"] for r in repo.content("artifact").collect()} == {"a", "b"}
    assert repo.content("artifact", version="2").count() == 0
    with engine.store.transaction("default:r"):
        deploy(repo, jar("g", "a", "3"), derive=False)
        deploy(other.repository("s"), jar("g", "c", "1"), derive=False)
    assert repo.latest_version() == 3 and engine.repository("s").latest_version() == 1


def test_a_verb_that_fails_leaves_nothing(engine):
    repo = engine.repository("r")
    deploy(repo, jar("g", "a", "1"), derive=False)
    with pytest.raises(ZeroDivisionError), engine.store.transaction(repo.key):
        deploy(repo, jar("g", "a", "2"), derive=False)
        raise ZeroDivisionError
    assert repo.latest_version() == 1 and engine.store.read("content").where("kind = 'artifact'").count() == 1


def test_uploads(engine, spark):
    """With labels, by reference to a blob, and into a repository in one commit."""
    repo = engine.repository("r")
    body, path = b"bytes", "g/a/1/a-1.jar"
    sha = "277089d91c0bdf4f2e6862ba7e4a07605119431f5d13f726dd352b06f1b206a9"
    first = spark.createDataFrame([("default", path, body, '{"type": "jar", "by": "me"}'), ("default", "g/a/2/a-2.jar", body, "no json")], "domain string, relative_path string, content binary, labels string")
    assert {r["version"]: r["labels"] for r in engine.upload(first).collect()} == {"1": {"type": "jar", "by": "me"}, "2": {}}
    assert engine.store.read("blobs").count() == 1 and repo.latest_version() == 0
    refer = spark.createDataFrame([("default", "g/b/1/b-1.jar", sha), ("default", "g/b/2/b-2.jar", "00"), ("other", "g/b/3/b-3.jar", sha)], "domain string, relative_path string, sha256 string")
    assert [r["version"] for r in engine.upload(refer, repository=repo).collect()] == ["1"]
    assert repo.latest_version() == 1 and repo.body("g/b/1/b-1.jar") == body
    assert engine.store.read("quarantine").where("reason = 'no such blob'").count() == 2
    # labels that are given again are added
    more = first.limit(1).selectExpr("domain", "relative_path", "content", "'{\"type\": \"lib\"}' AS labels")
    one = engine.upload(more).first()
    assert one["labels"] == {"type": "lib", "by": "me"}
    assert engine.retrieve(one["content_id"]).columns == listing.SHOWN["artifact"]
    with pytest.raises(LookupError):
        engine.retrieve("none")


def test_domains_are_apart(engine):
    mine, other = engine.repository("r", "mine"), engine.repository("r", "other")
    assert deploy(mine, jar("g", "a", "1", body="m"), derive=False) == 1 and deploy(other, jar("g", "a", "1", body="o"), derive=False) == 1
    assert mine.body("g/a/1/a-1.jar") == b"m" and other.body("g/a/1/a-1.jar") == b"o"
    with pytest.raises(ValueError):
        mine.modify(other.content("artifact").select("kind", "content_id"))
    assert mine.content("artifact").select("domain").collect() == [("mine",)]


def test_listings_show_their_columns(engine):
    repo = engine.repository("r")
    deploy(repo, jar("g", "a", "1"), pom("g", "a", "1", "N"))
    for kind, columns in listing.SHOWN.items():
        assert repo.listed(kind).columns == columns
    assert repo.listed("package", name="N", packaging="jar").count() == 1 and repo.listed("package", name="M").count() == 0
    assert repo.listed("artifact", q="filename='a-1.jar'").count() == 1


def test_second_body_of_a_path(engine):
    repo = engine.repository("r")
    bodies = sorted([b"one", b"two"], key=lambda x: __import__("hashlib").sha256(x).hexdigest())
    for files in ([("g/a/1/a-1.jar", x) for x in bodies], [("g/b/1/b-1.jar", x) for x in bodies[::-1]]):
        deploy(repo, *files, derive=False)
        assert repo.body(files[0][0]) == bodies[0]
    assert [r["reason"] for r in engine.store.read("quarantine").collect()] == ["second body of a path"] * 2


def test_repair_of_a_version(engine, spark):
    repo = engine.repository("r")
    files = [jar("g", "a", "1", body="one"), jar("g", "a", "2", body="two")]
    deploy(repo, *files, derive=False)
    assert repo.missing_blobs().count() == 0
    lost = Engine(spark, engine.store.root + "-copy")
    for table in ("content", "packages", "events", "versions"):
        lost.store.copied(table, engine.store)
    lost.store.append("blobs", engine.store.read("blobs").where("octet_length(content) > 3"))
    broken = lost.repository("r")
    assert {r["version"] for r in broken.missing_blobs().where("kind = 'artifact'").collect()} == {"1", "2"}
    with pytest.raises(LookupError):
        broken.body("g/a/1/a-1.jar")
    given = spark.createDataFrame([files[0], (files[1][0], b"wrong")], "relative_path string, content binary")
    assert [r["version"] for r in broken.repair_version(given).collect()] == ["2"]
    assert broken.body("g/a/1/a-1.jar") == b"one"


def test_bodies_are_not_shuffled(spark):
    files = spark.createDataFrame([("d", f"p{i % 7}", bytes([i % 5])) for i in range(50)] + [("d", None, b"x"), ("e", "p", b"x"), ("d", "q", None)], "domain string, relative_path string, content binary")
    known = new_blobs(files.where("relative_path = 'p1'"), None)
    found = new_blobs(files, known.limit(2))
    assert sorted(bytes(r["content"]) for r in found.collect()) == sorted([*({bytes([i]) for i in range(5)} - {bytes(r["content"]) for r in known.limit(2).collect()}), b"x", b"x"])
    once = spark.createDataFrame([("d", f"p{i}", bytes([i % 5])) for i in range(50)], "domain string, relative_path string, content binary").write.mode("overwrite")
    once.saveAsTable("some_files")
    text = new_blobs(spark.table("some_files"), None)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" in text
    plan = new_blobs(spark.table("some_files"), None)
    plan.collect()
    exchanged = [line for line in plan._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line and "path" in line]
    assert exchanged and all("content#" not in line.split("ENSURE")[0] for line in exchanged)


def test_stream(engine, tmp_path):
    folder = tmp_path / "in"
    repo = engine.repository("r")

    def put(path, body):
        at = folder / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(body)

    put(*jar("com.x", "lib", "1.0"))
    assert binary_files(engine.spark, f"file://{folder}").select("relative_path").first()[0] == "com/x/lib/1.0/lib-1.0.jar"
    for _ in range(2):
        ingest(repo, f"file://{folder}", f"file://{tmp_path}/marks").awaitTermination()
        assert repo.latest_version() == 1
    put(*jar("com.x", "lib", "1.1"))
    ingest(repo, f"file://{folder}", f"file://{tmp_path}/marks").awaitTermination()
    assert repo.latest_version() == 2 and repo.content("artifact").count() == 2
