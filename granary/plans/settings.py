"""Settings of an engine, kept in its tables: remotes, distributions, repositories and grants.

Each is listed as a DataFrame, and added, changed or dropped by name within a domain. A setting
that two writers change at once is changed by the first; the other raises `Conflict`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import listing
from granary.sources.tables import KEYED, TABLES, Store

POLICIES = ("immediate", "on_demand", "streamed")


class Settings:
    store: Store

    def _one(self, table: str, **key: str) -> DataFrame:
        rows = self.store.read(table)
        for column, value in key.items():
            rows = rows.where(F.col(column) == value)
        return rows

    def _put(self, table: str, row: dict, dropped: bool = False) -> None:
        kind = TABLES[table]
        self.store.append(table, self.store.spark.createDataFrame([tuple({**row, "dropped": dropped}.get(n) for n in kind.names)], kind))

    def _touch(self, table: str, key: dict) -> str:
        return " ".join([table, *map(str, key.values())])

    def _add(self, table: str, row: dict) -> None:
        key = {k: row[k] for k in KEYED[table]}
        with self.store.transaction(self._touch(table, key)):
            if not self._one(table, **key).isEmpty():
                raise ValueError(f"{table} has {list(key.values())} already")
            self._put(table, row)

    def _change(self, table: str, name: str, domain: str, **values: str | None) -> None:
        key = {"domain": domain, "name": name}
        with self.store.transaction(self._touch(table, key)):
            old = listing.exactly_one(self._one(table, **key)).first().asDict()
            if unknown := {*values} - ({*old} - {"domain", "name", "repo_id"}):
                raise ValueError(f"{table} has no {sorted(unknown)} to change")
            self._put(table, self._checked(table, old | values))

    def _drop(self, table: str, name: str, domain: str) -> None:
        key = {"domain": domain, "name": name}
        with self.store.transaction(self._touch(table, key)):
            self._put(table, listing.exactly_one(self._one(table, **key)).first().asDict(), dropped=True)

    def _checked(self, table: str, row: dict) -> dict:
        if table == "remotes":
            if not row["url"]:
                raise ValueError("a remote needs a url")
            if row["policy"] not in POLICIES:
                raise ValueError(f"no such policy: {row['policy']}")
        if table == "repositories" and row["remote"] is not None and self._one("remotes", domain=row["domain"], name=row["remote"]).isEmpty():
            raise ValueError(f"no remote {row['remote']}")
        return row

    # --- remotes

    def remotes(self) -> DataFrame:
        """(domain, name, url, policy) of upstream sources."""
        return self.store.read("remotes")

    def add_remote(self, name: str, url: str, policy: str = "immediate", domain: str = "default") -> None:
        self._add("remotes", self._checked("remotes", {"domain": domain, "name": name, "url": url, "policy": policy}))

    def change_remote(self, name: str, domain: str = "default", **values: str | None) -> None:
        self._change("remotes", name, domain, **values)

    def drop_remote(self, name: str, domain: str = "default") -> None:
        self._drop("remotes", name, domain)

    # --- distributions

    def distributions(self) -> DataFrame:
        """(domain, name, base_path, repository, remote) of the places where something is served."""
        return self.store.read("distributions")

    def add_distribution(self, name: str, base_path: str, repository: str | None = None, remote: str | None = None, domain: str = "default") -> None:
        self._add("distributions", {"domain": domain, "name": name, "base_path": base_path, "repository": repository, "remote": remote})

    def change_distribution(self, name: str, domain: str = "default", **values: str | None) -> None:
        self._change("distributions", name, domain, **values)

    def drop_distribution(self, name: str, domain: str = "default") -> None:
        self._drop("distributions", name, domain)

    def distribution_of(self, repository: str, domain: str = "default") -> DataFrame:
        """The first distribution, by name, that serves a repository; none if none does."""
        return first_distributions(self.distributions()).where((F.col("domain") == domain) & (F.col("repository") == repository))

    # --- repositories

    def repositories(self) -> DataFrame:
        """(domain, name, repo_id, remote, description); content is kept under the repo_id."""
        return self.store.read("repositories")

    def add_repository(self, name: str, remote: str | None = None, description: str | None = None, domain: str = "default") -> None:
        self._add("repositories", self._checked("repositories", {"domain": domain, "name": name, "repo_id": name, "remote": remote, "description": description}))

    def change_repository(self, name: str, domain: str = "default", **values: str | None) -> None:
        self._change("repositories", name, domain, **values)

    def drop_repository(self, name: str, domain: str = "default") -> None:
        """Takes it off the list; its versions stay in the log."""
        self._drop("repositories", name, domain)

    # --- grants

    def grants(self) -> DataFrame:
        return self.store.read("grants")

    def grant(self, principal: str, permission: str, object_id: str | None = None) -> None:
        """A permission on one object, or on all where none is named."""
        row = {"principal": principal, "scope": "object" if object_id else "model", "object_id": object_id, "permission": permission}
        with self.store.transaction(self._touch("grants", row)):
            self._put("grants", row)

    def revoke(self, principal: str, permission: str, object_id: str | None = None) -> None:
        row = {"principal": principal, "scope": "object" if object_id else "model", "object_id": object_id, "permission": permission}
        with self.store.transaction(self._touch("grants", row)):
            self._put("grants", row, dropped=True)


def first_distributions(distributions: DataFrame) -> DataFrame:
    """Of the distributions of each repository the first by name."""
    return listing.first_of(distributions.where(F.col("repository").isNotNull()), ["domain", "repository"], "name")
