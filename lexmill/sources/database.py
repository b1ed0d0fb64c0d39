"""Tables in a database over JDBC: reads parted by key bounds, filters and pages done by the database, writes that show at once.

Whole reads are parted by ranges of a numeric key, whose bounds the database tells. Equality and range filters of the
returned frame go to the database (Spark pushes them into each range's query). A write fills a staging table by as many
tasks as the frame has partitions, and one transaction then moves its rows; a lost task or job leaves the target as it was. A task that ran twice may have filled the staging table twice, so equal rows of it are moved once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def quoted(value: object) -> str:
    """A literal of SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


@dataclass(frozen=True)
class Database:
    spark: SparkSession
    url: str
    driver: str | None = None

    def _options(self) -> dict[str, str]:
        return {"url": self.url, **({"driver": self.driver} if self.driver else {})}

    def run(self, *statements: str) -> list[int]:
        """Statements as one transaction: all of them or none. Returns how many rows each changed."""
        connection = self._connect()
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            try:
                out = [statement.executeUpdate(s) for s in statements]
                connection.commit()
                return out
            except Exception:
                connection.rollback()
                raise
        finally:
            connection.close()

    def query(self, sql: str) -> DataFrame:
        """Rows of a query that the database runs whole: pages, sorts, aggregates."""
        return self.spark.read.format("jdbc").options(**self._options(), query=sql).load()

    def table(self, name: str, key: str | None = None, partitions: int = 8) -> DataFrame:
        """A table in `partitions` ranges of a numeric key; rows without a key are in the first range."""
        options = self._options()
        if key:
            low, high = self.query(f"SELECT MIN({key}) AS LOW_KEY, MAX({key}) AS HIGH_KEY FROM {name}").first()
            if low is not None and high > low:
                options |= {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(partitions)}
        return self.spark.read.format("jdbc").options(**options, dbtable=name).load()

    def page(self, name: str, where: str, order: str, limit: int, offset: int = 0, columns: str = "*") -> DataFrame:
        """Rows offset + 1 to offset + limit in an order; only these leave the database."""
        return self.query(f"SELECT {columns} FROM {name} WHERE {where} ORDER BY {order} OFFSET {offset} ROWS FETCH NEXT {limit} ROWS ONLY")

    def exists(self, name: str) -> bool:
        connection = self._connect()
        try:
            return connection.getMetaData().getTables(None, None, self.stored(name), None).next()
        finally:
            connection.close()

    def stored(self, name: str) -> str:
        """A name as the database keeps it where a statement doesn't quote it; Spark's writer quotes names."""
        connection = self._connect()
        try:
            return name.upper() if connection.getMetaData().storesUpperCaseIdentifiers() else name.lower()
        finally:
            connection.close()

    def _connect(self):
        if self.driver:
            self.spark._jvm.java.lang.Class.forName(self.driver)
        return self.spark._jvm.java.sql.DriverManager.getConnection(self.url)

    def insert(self, name: str, rows: DataFrame, *more: str, key: str | None = None) -> int:
        """Adds rows to a table that is there; `more` statements are part of the same transaction. key: rows whose key the
        table holds are replaced. Returns how many rows were moved."""
        columns = ", ".join(rows.columns)
        with self.held(rows, key) as staging:
            first = [f"DELETE FROM {name} WHERE {key} IN (SELECT {key} FROM {staging})"] if key else []
            return self.run(*first, f"INSERT INTO {name} ({columns}) SELECT DISTINCT {columns} FROM {staging}", *more)[len(first)]

    @contextmanager
    def held(self, rows: DataFrame, key: str | None = None) -> Iterator[str]:
        """The name of a table that holds rows until the block ends, with an index of a key; equal rows may be in it more
        often than given."""
        staging = self.stored(f"staging_{uuid.uuid4().hex[:12]}")
        rows = rows.toDF(*map(self.stored, rows.columns))
        try:
            rows.write.format("jdbc").options(**self._options(), dbtable=staging, createTableColumnTypes=_types(rows)).mode("error").save()
            if key:
                self.run(f"CREATE INDEX {staging}_key ON {staging} ({key})")
            yield staging
        finally:
            if self.exists(staging):
                self.run(f"DROP TABLE {staging}")


def _types(rows: DataFrame) -> str:
    """Strings as VARCHAR, so that the database can compare and sort them."""
    return ", ".join(f"{f.name} VARCHAR(4096)" for f in rows.schema if f.dataType.simpleString() == "string") or f"{rows.columns[0]} {rows.schema[0].dataType.simpleString()}"
