"""Catalog of schemas, tables and indexes with versioned entries, and checkpoints.

Entries form version chains: creating and dropping append, the latest version
counts. Tables' rows are durable once committed, so a checkpoint is a manifest: all
entries and, for every live table, the records of its log up to now. It is one file
``snapshots/vN``, which only one writer can create; the newest that is complete
counts, and there is no pointer that a crash could leave behind.

A catalog that is loaded reads the manifest's data in place and goes on in logs of
its own, so two that were loaded from one root don't see or delete each other's
rows; the next checkpoint of either goes to the same root. Older manifests than the
previous one are removed, and with them data that only they name.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from . import storage
from .table import Table
from .types import Column, schema_of

DEFAULT = "main"


class CatalogError(Exception):
    code = -1


class NotFound(CatalogError):
    code = -1


class Protected(CatalogError):
    code = -1


class AlreadyExists(CatalogError):
    code = -2


@dataclass
class Entry:
    kind: str
    schema: str
    name: str
    version: int
    deleted: bool = False
    info: str = ""


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.chain: dict[tuple[str, str, str], list[Entry]] = {}
        self.log, self.base = f"log-{uuid.uuid4().hex}", {}  # records of loaded tables, by (schema, name, version)

    # -- entries --------------------------------------------------------------
    def _latest(self, kind: str, schema: str, name: str) -> Entry | None:
        chain = self.chain.get((kind, schema, name))
        return chain[-1] if chain and not chain[-1].deleted else None

    def _push(self, kind: str, schema: str, name: str, deleted: bool = False, info: str = "") -> Entry:
        chain = self.chain.setdefault((kind, schema, name), [])
        chain.append(Entry(kind, schema, name, len(chain) + 1, deleted, info))
        return chain[-1]

    def _create(self, kind: str, schema: str, name: str, if_not_exists: bool, info: str = "") -> int:
        if self._latest(kind, schema, name):
            if if_not_exists:
                return 0
            raise AlreadyExists(f"{kind} {schema}.{name}" if kind != "schema" else f"schema {name}")
        self._push(kind, schema, name, info=info)
        return 0

    def entries(self, kind: str, schema: str = "", live: bool = True) -> list[Entry]:
        """Latest versions; with live=False dropped ones, too."""
        last = [c[-1] for (k, s, _), c in self.chain.items() if k == kind and s == schema]
        return [e for e in last if not (live and e.deleted)]

    def count(self, kind: str, schema: str = "") -> int:
        return len(self.entries(kind, schema))

    def history(self) -> DataFrame:
        """(kind, schema, name, version, deleted) of every version."""
        rows = [(e.kind, e.schema, e.name, e.version, e.deleted) for c in self.chain.values() for e in c]
        return self.spark.createDataFrame(rows, "kind string, schema string, name string, version int, deleted boolean")

    # -- schemas --------------------------------------------------------------
    def create_schema(self, name: str, if_not_exists: bool = False) -> int:
        return self._create("schema", "", name, if_not_exists)

    def has_schema(self, name: str) -> bool:
        return self._latest("schema", "", name) is not None

    def drop_schema(self, name: str) -> int:
        """With all its tables; a missing one is no error, the default one can't go."""
        if name == DEFAULT:
            raise Protected(name)
        for kind in ("table", "index"):
            for e in self.entries(kind, name):
                self._push(kind, name, e.name, deleted=True)
        if self.has_schema(name):
            self._push("schema", "", name, deleted=True)
        return 0

    # -- tables ---------------------------------------------------------------
    def create_table(self, schema: str, name: str, columns: list[Column], if_not_exists: bool = False, kind: str = "row") -> int:
        if not self.has_schema(schema):
            raise NotFound(f"schema {schema}")
        fields = schema_of(columns)
        Table(self.spark, "", fields, kind)  # checks the kind
        return self._create("table", schema, name, if_not_exists, json.dumps({"kind": kind, "columns": [asdict(c) for c in columns], "folder": uuid.uuid4().hex}))

    def table(self, schema: str, name: str) -> Table | None:
        e = self._latest("table", schema, name)
        if not e or not self.has_schema(schema):
            return None
        info = json.loads(e.info)
        return Table(self.spark, f"{self.root}/data/{schema}/{name}/{info['folder']}", schema_of([Column(**c) for c in info["columns"]]), info["kind"], self.log, self.base.get((schema, name, e.version), ()), shared=True)

    def types(self, schema: str, name: str) -> list[str]:
        e = self._latest("table", schema, name)
        if not e:
            raise NotFound(f"table {schema}.{name}")
        return [c["type"] for c in json.loads(e.info)["columns"]]

    def drop_table(self, schema: str, name: str) -> bool:
        """False for a name that never was; dropping twice is fine."""
        if ("table", schema, name) not in self.chain:
            return False
        self._push("table", schema, name, deleted=True)
        return True

    def create_index(self, schema: str, name: str, info: str = "", if_not_exists: bool = False) -> int:
        if not self.has_schema(schema):
            raise NotFound(f"schema {schema}")
        return self._create("index", schema, name, if_not_exists, info)

    # -- checkpoints ----------------------------------------------------------
    def _versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in storage.names(self.spark, f"{self.root}/snapshots") if n[1:].isdigit())

    def _manifest(self, n: int) -> dict | None:
        return storage.read(self.spark, f"{self.root}/snapshots/v{n}")

    @staticmethod
    def _data(manifest: dict | None) -> set[str]:
        return {f"{t['path']}/{r['data']}" for t in (manifest or {}).get("tables", []) for r in t["records"]}

    def checkpoint(self) -> int:
        """The number of the new manifest. Another catalog's checkpoint at the same moment makes it try the next number."""
        tables = []
        for chain in self.chain.values():
            e = chain[-1]
            if e.kind == "table" and not e.deleted and (t := self.table(e.schema, e.name)) is not None:
                tables.append({"schema": e.schema, "name": e.name, "version": e.version, "path": t.path[len(self.root) + 1 :], "records": t.records()})
        manifest = {"entries": [asdict(e) for c in self.chain.values() for e in c], "tables": tables}
        n = max([0, *self._versions()]) + 1
        while not storage.create(self.spark, f"{self.root}/snapshots/v{n}", manifest):
            n += 1
        old = [v for v in self._versions() if v < n - 1]
        kept = self._data(manifest).union(*(self._data(self._manifest(v)) for v in self._versions() if v >= n - 1))
        for v in old:
            for path in self._data(self._manifest(v)) - kept:
                storage.delete(self.spark, f"{self.root}/{path}")
            storage.delete(self.spark, f"{self.root}/snapshots/v{v}")
        return n

    def active(self) -> str | None:
        """The newest manifest that was written to its end."""
        return next((f"v{n}" for n in reversed(self._versions()) if self._manifest(n)), None)

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Catalog:
        """The catalog and its rows as of the last checkpoint under ``root``; without one, an empty catalog. Nothing is copied."""
        out = cls(spark, root)
        if (v := out.active()) is None:
            return out
        manifest = out._manifest(int(v[1:]))
        for e in manifest["entries"]:
            out.chain.setdefault((e["kind"], e["schema"], e["name"]), []).append(Entry(**e))
        out.base = {(t["schema"], t["name"], t["version"]): t["records"] for t in manifest["tables"]}
        return out
