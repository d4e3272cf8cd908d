"""Repositories: verbs that make new versions, and reads of any version."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.labels import parsed_labels, set_label, unset_label
from granary.functions.paths import prefix
from granary.operators import content as contents
from granary.operators import indexes, listing, packages, snapshots
from granary.plans.settings import Settings
from granary.schema import ARTIFACT, CONTENT, GAV, METADATA, PACKAGE
from granary.sources import files as sources
from granary.sources import remote
from granary.sources.tables import Store

_EPOCH = dt.datetime(1970, 1, 1)
#: Versions between two that keep all their members; those between are read from the events.
WHOLE_EVERY = 16


class Engine(Settings):
    """All repositories of a store. Verbs are atomic; one that meets another writer of the same
    repository raises `Conflict` and changes nothing."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)

    def repository(self, repo_id: str, domain: str = "default") -> Repository:
        return Repository(self, repo_id, domain)

    def upload(self, files: DataFrame, parse_poms: bool = True, repository: Repository | None = None, as_of: dt.datetime = _EPOCH) -> DataFrame:
        """Keeps files as blobs and content; returns their content rows. A file is (domain,
        relative_path) with `content`, its body, or `sha256`, a reference to a blob that the
        domain has, and may have `labels`, a JSON object of strings (ignored if it is none).
        Refused files go to quarantine. Project files make packages of new releases and refresh
        those of snapshots. With a repository the content is added to it, in the same commit."""
        store = self.store
        with store.transaction(*([repository.key] if repository else [])):
            new = self._kept(files, parse_poms)
            if repository is not None:
                repository.modify(new.select(*snapshots.MEMBER), as_of=as_of)
            return store.staged(snapshots.matching(store.read("content"), new, ["content_id"]))

    def _kept(self, files: DataFrame, parse_poms: bool) -> DataFrame:
        store = self.store
        body = F.col("content") if "content" in files.columns else F.lit(None).cast("binary")
        given = F.lower("sha256") if "sha256" in files.columns else F.lit(None).cast("string")
        labels = parsed_labels(F.col("labels")) if "labels" in files.columns else F.lit(None).cast("map<string,string>")
        files = files.select("domain", "relative_path", body.alias("content"), F.coalesce(F.sha2(body, 256), given).alias("sha256"), labels.alias("labels"))
        known_blobs = store.read("blobs")
        by_reference = files.where(F.col("content").isNull() & F.col("sha256").isNotNull())
        if not by_reference.isEmpty():
            held = snapshots.matching(known_blobs, by_reference, ["domain", "sha256"]).select("domain", "sha256", F.col("content").alias("__body"), F.lit(True).alias("held"))
            named = files.join(held, ["domain", "sha256"], "left")
            missing = F.col("content").isNull() & F.col("sha256").isNotNull() & F.col("held").isNull()
            unknown = store.staged(named.where(missing).select("relative_path", F.lit("no such blob").alias("reason")))
            if not unknown.isEmpty():
                store.append("quarantine", unknown)
            files = store.staged(named.where(~missing).withColumn("content", F.coalesce("content", "__body")).select(*files.columns))
        fresh = store.staged(sources.new_blobs(files, known_blobs, store.staged))
        if not fresh.isEmpty():
            store.append("blobs", fresh)
        known = store.read("content")
        described = store.staged(contents.described(files, known))
        refused = contents.quarantined(described)
        if not refused.isEmpty():
            store.append("quarantine", refused)
        new = store.staged(contents.accepted(described))
        delta = store.staged(contents.changed(known, new))
        if not delta.isEmpty():
            store.append("content", delta)
        if parse_poms:
            own = new.where((F.col("kind") == ARTIFACT) & F.endswith("filename", F.lit(".pom")))
            bodies = store.staged(packages.pom_bodies(own.select(*packages.KEY).distinct(), own, store.read("blobs")))
            if not bodies.isEmpty():
                store.append("packages", store.staged(packages.upserted(bodies, store.read("packages"))))
        return new

    def backfill_packages(self) -> None:
        """Packages for all project files that have none."""
        artifacts = self.store.read("content").where(F.col("kind") == ARTIFACT)
        with self.store.transaction():
            self.store.append("packages", self.store.staged(packages.backfilled(artifacts, self.store.read("packages"), self.store.read("blobs"))))

    def retrieve(self, content_id: str) -> DataFrame:
        """The one content, or package, of an id, with the columns that its kind shows."""
        rows = self.store.read("content").where(F.col("content_id") == content_id)
        kind = rows.select("kind").first()
        if kind is None:
            return listing.exactly_one(listing.shown(self.store.read("packages").where(F.col("content_id") == content_id), PACKAGE))
        return listing.exactly_one(listing.shown(rows, kind[0]))

    def label(self, content_id: str, key: str, value: str | None) -> None:
        """Sets a label, or drops it where value is None; only the row of the content is written."""
        labels = F.col("labels")
        new = unset_label(labels, key) if value is None else set_label(labels, key, value)
        with self.store.transaction(f"label {content_id}"):
            rows = listing.exactly_one(self.store.read("content").where(F.col("content_id") == content_id))
            self.store.append("content", self.store.staged(rows.withColumn("labels", new)))


class Repository:
    """One repository of a domain. Content of other domains is neither seen nor taken in."""

    def __init__(self, engine: Engine, repo_id: str, domain: str) -> None:
        self.engine, self.repo_id, self.domain = engine, repo_id, domain
        self.spark, self.store = engine.spark, engine.store
        #: The name of the repository in the tables that all domains share.
        self.key = f"{domain}:{repo_id}"

    # --- reading

    def versions(self) -> DataFrame:
        """(version, created) of all versions that were not destroyed."""
        own = self.store.read("versions").where(F.col("repo_id") == self.key)
        kept = own.groupBy("version").agg(F.max("created").alias("created"), F.max(F.col("created").isNull()).alias("gone"))
        return kept.where(~F.col("gone")).select("version", "created")

    def latest_version(self) -> int:
        return self.versions().agg(F.max("version")).first()[0] or 0

    def _last_number(self) -> int:
        return self.store.read("versions").where(F.col("repo_id") == self.key).agg(F.max("version")).first()[0] or 0

    def _at(self, number: int) -> DataFrame:
        """Members at a version: those of the last version before it that keeps all, and the
        events since. Only folders of this repository are read."""
        start = max((v for v in self.store.whole_versions(self.key) if v <= number), default=0)
        base = self.store.read("members").where((F.col("repo_id") == self.key) & (F.col("version") == start))
        later = self.store.read("events").where((F.col("repo_id") == self.key) & (F.col("version") > start) & (F.col("version") <= number))
        return snapshots.resumed(base, later)

    def members(self, version: int | None = None) -> DataFrame:
        """(kind, content_id) at a version, the latest by default; version 0 is empty."""
        if version and self.versions().where(F.col("version") == version).isEmpty():
            raise LookupError(f"no version {version}")
        return self._at(self.latest_version() if version is None else version)

    def changes(self, version: int, op: str) -> DataFrame:
        return snapshots.changes(self.store.read("events"), self.key, version, op)

    def _rows(self, kind: str) -> DataFrame:
        rows = self.store.read("packages") if kind == PACKAGE else self.store.read("content").where(F.col("kind") == kind)
        return listing.of_domain(rows, self.domain)

    def content(self, kind: str, at: int | None = None, **filters: str | None) -> DataFrame:
        """Content of a kind in the snapshot of version `at`, filtered by equality."""
        members = self.members(at).where(F.col("kind") == kind)
        return listing.in_snapshot(listing.filtered(self._rows(kind), kind, **filters), members)

    def listed(self, kind: str, at: int | None = None, labels: str | None = None, q: str | None = None, **filters: str | None) -> DataFrame:
        """The columns that a listing of the kind shows, of content that all filters pick."""
        return listing.shown(listing.selected(self.content(kind, at, **filters), labels, q), kind)

    def find(self, path: str, version: int | None = None) -> DataFrame:
        return listing.lookup(path, listing.of_domain(self.store.read("content"), self.domain), self.members(version))

    def body(self, path: str, version: int | None = None) -> bytes:
        """The bytes served at a path."""
        sha = self.find(path, version).first()["sha256"]
        found = listing.of_domain(self.store.read("blobs"), self.domain).where(F.col("sha256") == sha).select("content").first()
        if found is None:
            raise LookupError("its blob is missing")
        return bytes(found["content"])

    # --- new versions

    def _keyed(self) -> DataFrame:
        """All content of the domain with the columns of its in-repository keys."""
        columns = ["kind", "content_id", *GAV, "filename"]
        own = listing.of_domain(self.store.read("content"), self.domain).select(*columns)
        return own.unionByName(self._rows(PACKAGE).select(F.lit(PACKAGE).alias("kind"), "content_id", *GAV, F.lit(None).cast("string").alias("filename")))

    def _save(self, documents: DataFrame) -> None:
        """Keeps generated documents and their bodies."""
        blobs = self.store.staged(sources.new_blobs(documents.select("domain", "relative_path", F.col("body").cast("binary").alias("content")), self.store.read("blobs"), self.store.staged))
        if not blobs.isEmpty():
            self.store.append("blobs", blobs)
        rows = documents.withColumn("labels", F.create_map().cast("map<string,string>")).select(*CONTENT.names)
        delta = self.store.staged(contents.inserted(rows, snapshots.matching(self.store.read("content"), rows, ["content_id"])))
        if not delta.isEmpty():
            self.store.append("content", delta)

    def _commit(self, change: DataFrame, as_of: dt.datetime) -> int:
        """Writes a change (op, kind, content_id) of the latest members as the next version; an
        empty one makes none."""
        latest, last = self.latest_version(), self._last_number()
        if change.isEmpty():
            return latest
        if last > latest:  # the last version was destroyed: the log goes on from its members
            after = snapshots.resumed(self._at(latest), change.withColumn("version", F.lit(1)))
            change = self.store.staged(snapshots.delta(self._at(last), after))
        number = last + 1
        self.store.append("events", change.select(F.lit(self.key).alias("repo_id"), F.lit(number).alias("version"), "op", "kind", "content_id"))
        self.store.append("versions", self.spark.createDataFrame([(self.key, number, as_of)], "repo_id string, version long, created timestamp"))
        if number % WHOLE_EVERY == 0:
            self.store.keep_whole(self.key, number, self._at(number))
        return number

    def modify(self, add: DataFrame | None = None, remove: DataFrame | str | None = None, base_version: tuple[str, int] | int | None = None, as_of: dt.datetime = _EPOCH, derive: bool = True) -> int:
        """Removes, then adds, (kind, content_id) rows; "*" removes all. With base_version (a
        number, or a repository and a number) that snapshot is started from. Newly added content
        displaces what has its key. `derive` keeps packages and index documents up. What is
        written is in proportion to the change."""
        staged, member = self.store.staged, snapshots.MEMBER
        empty = self.spark.createDataFrame([], "kind string, content_id string")
        with self.store.transaction(self.key):
            members = self.members()
            add = staged((add if add is not None else empty).select(*member).distinct())
            start = members
            if base_version is not None:
                repo, number = base_version if isinstance(base_version, tuple) else (self.repo_id, base_version)
                start = staged(Repository(self.engine, repo, self.domain)._at(number))
            remove = start if isinstance(remove, str) and remove == "*" else empty if remove is None else remove
            gone = staged(snapshots.matching(start, remove, member))
            fresh = staged(snapshots.without(add, snapshots.without(snapshots.matching(start, add, member), gone, member), member))
            everything = self._keyed()
            keyed = staged(snapshots.matching(everything, fresh, member))
            foreign = snapshots.without(fresh, keyed, member)
            if not foreign.isEmpty():
                raise ValueError("added content is unknown in the domain")
            if not snapshots.conflicts(keyed).isEmpty():
                raise ValueError("two added contents have the same key")
            rivals = snapshots.matching(everything, keyed, ["kind", *GAV, "filename"])
            displaced = staged(snapshots.without(snapshots.matching(start, rivals, member), fresh, member))
            wanted = fresh.select(F.lit(2).alias("rank"), F.lit("add").alias("op"), *member)
            wanted = wanted.unionByName(displaced.select(F.lit(1).alias("rank"), F.lit("remove").alias("op"), *member))
            wanted = wanted.unionByName(gone.select(F.lit(0).alias("rank"), F.lit("remove").alias("op"), *member))
            if base_version is not None:
                base = snapshots.delta(members, start).select(F.lit(-1).alias("rank"), "op", *member)
                wanted = wanted.unionByName(base)
            change = staged(snapshots.settled(wanted, members))
            if derive:
                change = self._derived(members, change, as_of)
            return self._commit(change, as_of)

    def _derived(self, members: DataFrame, change: DataFrame, as_of: dt.datetime) -> DataFrame:
        """`change` with packages and index documents that follow its artifacts. Artifacts of the
        touched prefixes alone are read; all of them only where the prefix list is made anew."""
        store, staged, member = self.store, self.store.staged, snapshots.MEMBER
        everything = self._rows(ARTIFACT)
        of = lambda op: staged(snapshots.matching(everything, change.where((F.col("op") == op) & (F.col("kind") == ARTIFACT)), member))
        added, removed = of("add"), of("remove")
        if added.isEmpty() and removed.isEmpty():
            return change
        after = snapshots.resumed(members, change.withColumn("version", F.lit(1)))
        touched = added.unionByName(removed).select("domain", prefix(F.col("group_id")).alias("prefix")).distinct()
        near = snapshots.matching(everything.withColumn("prefix", prefix(F.col("group_id"))), staged(touched), ["domain", "prefix"]).drop("prefix")
        artifacts = staged(listing.in_snapshot(near, after))
        known = self._rows(PACKAGE)
        fresh, ids, dead = (staged(x) for x in packages.maintained(added, removed, artifacts, known, store.read("blobs")))
        gone = snapshots.matching(known, dead, packages.KEY).select(F.lit(PACKAGE).alias("kind"), "content_id")
        indexed = self._rows(METADATA)
        pairs = added.unionByName(removed).select(*indexes.PAIR).distinct()
        metadata = snapshots.matching(indexed, pairs, indexes.PAIR).unionByName(indexed.where(F.col("filename") == indexes.PREFIXES_FILE))
        metadata = staged(listing.in_snapshot(metadata, after))
        documents, stale = (staged(x) for x in indexes.maintained(added, removed, artifacts, metadata, F.lit(as_of), lambda: listing.in_snapshot(everything, after)))
        ranked = lambda rows, rank, op: rows.select(F.lit(rank).alias("rank"), F.lit(op).alias("op"), *member)
        wanted = change.select(F.lit(0).alias("rank"), "op", *member).unionByName(ranked(gone, 1, "remove")).unionByName(ranked(ids.withColumn("kind", F.lit(PACKAGE)), 2, "add"))
        wanted = wanted.unionByName(ranked(stale, 3, "remove")).unionByName(ranked(documents, 4, "add"))
        self._save(documents)
        if not fresh.isEmpty():
            store.append("packages", fresh)
        return staged(snapshots.settled(wanted, members))

    def _named(self, files: DataFrame) -> DataFrame:
        return files.withColumn("domain", F.lit(self.domain))

    def deploy(self, files: DataFrame, as_of: dt.datetime = _EPOCH, derive: bool = True) -> int:
        """Files (relative_path, content; see Engine.upload) in one version; metadata and snapshot
        files replace those of their key."""
        with self.store.transaction(self.key):
            new = self.engine.upload(self._named(files))
            return self.modify(new.select(*snapshots.MEMBER), as_of=as_of, derive=derive)

    def pull(self, files: DataFrame, remote_id: str, as_of: dt.datetime) -> int:
        """Files that came through a remote: kept unless they are for passing on only, logged,
        and added without derived content. What is live already makes no version."""
        with self.store.transaction(self.key):
            new = self.engine.upload(remote.keepable(self._named(files)), parse_poms=False)
            self.store.append("fetches", new.select("content_id", F.lit(remote_id).alias("remote_id"), F.lit(as_of).alias("created")))
            return self.modify(remote.not_live(new.select(*snapshots.MEMBER), self.members()), as_of=as_of, derive=False)

    def add_cached_content(self, remote_id: str | None = None, as_of: dt.datetime = _EPOCH) -> int:
        """What a remote gave since the latest version, with derived content. Without a remote
        that of the repository is meant; it is an error if there is none."""
        if remote_id is None:
            own = listing.of_domain(self.engine.repositories(), self.domain).where(F.col("repo_id") == self.repo_id).select("remote").first()
            remote_id = own["remote"] if own else None
            if remote_id is None:
                raise ValueError("name a remote, or give the repository one")
        rows = remote.cached(listing.of_domain(self.store.read("content"), self.domain), self.store.read("fetches"), self.store.read("versions"), self.key, remote_id)
        return self.modify(rows.select(*snapshots.MEMBER), as_of=as_of)

    def promote(self, source: Repository, content: DataFrame, as_of: dt.datetime = _EPOCH) -> int:
        """Content of another repository, by reference."""
        return self.modify(snapshots.matching(source.members(), content, ["content_id"]), as_of=as_of)

    def repair_metadata(self, as_of: dt.datetime = _EPOCH) -> int:
        """Index documents and the prefix list made anew for the whole snapshot. Packages stay."""
        staged, member = self.store.staged, snapshots.MEMBER
        with self.store.transaction(self.key):
            documents, stale = (staged(x) for x in indexes.rebuilt(staged(self.content(ARTIFACT)), staged(self.content(METADATA)), F.lit(as_of)))
            self._save(documents)
            wanted = documents.select(F.lit(1).alias("rank"), F.lit("add").alias("op"), *member).unionByName(stale.select(F.lit(0).alias("rank"), F.lit("remove").alias("op"), *member))
            return self._commit(staged(snapshots.settled(wanted, self.members())), as_of)

    def missing_blobs(self, version: int | None = None) -> DataFrame:
        """Content of a version whose bytes the domain does not have: without a sha256, or with one
        that no blob has."""
        rows = listing.in_snapshot(listing.of_domain(self.store.read("content"), self.domain), self.members(version))
        return snapshots.without(rows, listing.of_domain(self.store.read("blobs"), self.domain), ["domain", "sha256"])

    def repair_version(self, files: DataFrame, version: int | None = None) -> DataFrame:
        """Takes the bodies of missing blobs from `files` (relative_path, content), where the
        digest is that of the content or the content has none; returns what is still missing."""
        lost = self.store.staged(self.missing_blobs(version).select("content_id", "relative_path", F.col("sha256").alias("wanted")))
        found = self._named(files).withColumn("found", F.sha2("content", 256)).join(lost, "relative_path")
        found = self.store.staged(found.where(F.col("wanted").isNull() | (F.col("wanted") == F.col("found"))).select("domain", "relative_path", "content", "content_id", "found"))
        with self.store.transaction(self.key):
            blobs = self.store.staged(sources.new_blobs(found, self.store.read("blobs"), self.store.staged))
            if not blobs.isEmpty():
                self.store.append("blobs", blobs)
            rows = found.groupBy("content_id").agg(F.min("found").alias("sha256"))
            better = self.store.staged(contents.filled(snapshots.matching(self.store.read("content"), rows, ["content_id"]), rows))
            if not better.isEmpty():
                self.store.append("content", better)
        return self.missing_blobs(version)

    def destroy_version(self, version: int) -> None:
        """The version can no longer be read; all others stay as they are."""
        with self.store.transaction(self.key):
            self.members(version)
            self.store.append("versions", self.spark.createDataFrame([(self.key, version, None)], "repo_id string, version long, created timestamp"))
