"""Several tables that change as one: immutable data, numbered manifests, commits that win or lose whole.

A store is a folder. `data` holds Parquet folders that are never changed; `versions` holds a manifest for each version,
which names every table's folders. A commit writes its data first and then one small file, the next manifest, under a
name that must still be free: of two writers that began with one version the second finds the name taken and gets a
Conflict, with nothing of its own to be seen. A writer that dies before that leaves folders that no manifest names.

Deletions are rows of keys (tombstones), which are merged when a table is read: they hide rows of earlier versions, so
an update is a deletion and an insertion in one commit. Any version can be read again until vacuum() forgets it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.sources import shared


class Conflict(RuntimeError):
    """Another commit came first."""


@dataclass
class Store:
    spark: SparkSession
    path: str

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in shared.names(self.spark, f"{self.path}/versions") if n.startswith("v") and n.endswith(".json")]

    def version(self) -> int:
        """The newest; 0 where nothing was committed."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        return json.loads(shared.read_text(self.spark, _manifest(self.path, version))) if version else {"tables": {}}

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(self.version() if version is None else version)["tables"])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table's rows at a version, by default the newest. Filters and columns reach the Parquet files."""
        at = self.version() if version is None else version
        entry = self.manifest(at)["tables"].get(table)
        if entry is None:
            raise KeyError(f"no table {table} at version {at} of {self.path}")
        schema, key = StructType.fromJson(entry["schema"]), entry["key"]
        rows = gone = None
        for part in entry["parts"]:
            own = schema if part["kind"] == "rows" else StructType([schema[c] for c in key])
            df = self.spark.read.schema(own).parquet(f"{self.path}/data/{part['data']}").withColumn("__at", F.lit(part["version"]).cast("long"))
            if part["kind"] == "rows":
                rows = df if rows is None else rows.unionByName(df)
            else:
                gone = df if gone is None else gone.unionByName(df)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        if gone is not None:
            gone = gone.groupBy(*key).agg(F.max("__at").alias("__gone"))
            rows = rows.join(gone, key, "left").filter("__gone IS NULL OR __at >= __gone")
        return rows.select(*schema.names)

    def begin(self) -> Change:
        return Change(self, self.version())

    def compact(self, table: str) -> int:
        """The table's rows as one part without tombstones, as a new version."""
        change = self.begin()
        change.replace(table, self.read(table, change.base))
        return change.commit()

    def vacuum(self, keep: int = 1) -> list[str]:
        """Forgets all but the newest versions and deletes data that no manifest left names. Not while writers are at work:
        what they have written isn't named yet."""
        versions = sorted(self.versions())
        for v in versions[:-keep]:
            shared.delete(self.spark, _manifest(self.path, v))
        named = {p["data"] for v in versions[-keep:] for t in self.manifest(v)["tables"].values() for p in t["parts"]}
        lost = [d for d in shared.names(self.spark, f"{self.path}/data") if d not in named]
        for d in lost:
            shared.delete(self.spark, f"{self.path}/data/{d}")
        return lost


def _manifest(path: str, version: int) -> str:
    return f"{path}/versions/v{version:020d}.json"


@dataclass
class Change:
    """What one commit does to a store. Data is written when it is named here, and seen when commit() returns."""

    store: Store
    base: int
    tables: dict[str, dict] = field(default_factory=dict)

    def _entry(self, table: str) -> dict:
        if table not in self.tables:
            old = self.store.manifest(self.base)["tables"].get(table)
            if old is None:
                raise KeyError(f"no table {table} at version {self.base}")
            self.tables[table] = {**old, "parts": list(old["parts"])}
        return self.tables[table]

    def _write(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.store.path}/data/{name}")
        return name

    def create(self, table: str, schema: StructType, key: list[str]) -> Change:
        if table in self.tables or table in self.store.manifest(self.base)["tables"]:
            raise ValueError(f"table {table} is there already")
        self.tables[table] = {"schema": json.loads(schema.json()), "key": key, "parts": []}
        return self

    def insert(self, table: str, rows: DataFrame) -> Change:
        entry = self._entry(table)
        names = StructType.fromJson(entry["schema"]).names
        entry["parts"].append({"kind": "rows", "data": self._write(rows.select(*names)), "version": self.base + 1})
        return self

    def delete(self, table: str, keys: DataFrame) -> Change:
        """Hides the rows of these keys that earlier versions hold."""
        entry = self._entry(table)
        entry["parts"].append({"kind": "gone", "data": self._write(keys.select(*entry["key"])), "version": self.base + 1})
        return self

    def update(self, table: str, rows: DataFrame) -> Change:
        """Whole rows in place of those of equal keys."""
        self.insert(table, rows)
        entry = self.tables[table]
        done = self.store.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{self.store.path}/data/{entry['parts'][-1]['data']}")
        return self.delete(table, done)

    def replace(self, table: str, rows: DataFrame) -> Change:
        entry = self._entry(table)
        names = StructType.fromJson(entry["schema"]).names
        entry["parts"] = [{"kind": "rows", "data": self._write(rows.select(*names)), "version": self.base + 1}]
        return self

    def commit(self) -> int:
        """The new version. Conflict: another one was committed since begin(); nothing of this one is seen."""
        tables = {**self.store.manifest(self.base)["tables"], **self.tables}
        version = self.base + 1
        if not shared.write_once(self.store.spark, _manifest(self.store.path, version), json.dumps({"version": version, "tables": tables})):
            raise Conflict(f"version {version} of {self.store.path} is there already")
        return version
