"""Read-only sessions of a database: queries only, in sessions that the database itself says can't write.

Each session that the executors open begins with the guard's statement. Before anything is read, a probe session asks
the database whether that took effect; without the expected answer nothing is read. Queries are read in ranges of a
column, each range by a task of its own.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .files import statement_kind


@dataclass(frozen=True)
class Guard:
    """How a kind of database is held to reading: a statement for each session, and a query that must give an answer."""

    probe: str
    expected: str
    init: str | None = None


#: PostgreSQL confines each session; Apache Derby says how its connections are opened.
POSTGRES = Guard("SELECT current_setting('transaction_read_only') AS v", "on", "SET default_transaction_read_only = on")
DERBY = Guard("SELECT SYSCS_UTIL.SYSCS_GET_DATABASE_PROPERTY('derby.database.defaultConnectionMode') AS v FROM SYSIBM.SYSDUMMY1", "readOnlyAccess")


class NotReadOnly(PermissionError):
    """The database didn't confirm that a session can only read."""


@dataclass
class ReadOnlySession:
    """Queries of one database. evidence tells what was confirmed and which kinds of statements were sent."""

    spark: SparkSession
    url: str
    guard: Guard = POSTGRES
    timeout_s: int = 60
    options: Mapping[str, str] = field(default_factory=dict)
    evidence: dict = field(default_factory=lambda: {"read_only": False, "statements": []})

    def _reader(self, query: str):
        kind = statement_kind(query)
        if kind not in ("select", "with"):
            raise ValueError(f"only queries can be read, not {kind}")
        self.evidence["statements"].append(kind)
        reader = self.spark.read.format("jdbc").option("url", self.url).option("queryTimeout", self.timeout_s).options(**self.options)
        return reader if self.guard.init is None else reader.option("sessionInitStatement", self.guard.init)

    def confirm(self) -> None:
        """Ask the database; raises unless it says that the session only reads."""
        found = self._reader(self.guard.probe).option("query", self.guard.probe).load().first()
        if found is None or found[0] != self.guard.expected:
            raise NotReadOnly(f"the database doesn't confirm a read-only session: {found and found[0]}")
        self.evidence["read_only"] = True

    def read(self, query: str, by: str | None = None, partitions: int = 8) -> DataFrame:
        """A query's rows; by: an integer column whose range is read in so many parts, null values with the first."""
        if not self.evidence["read_only"]:
            self.confirm()
        reader = self._reader(query)
        if by is None:
            return reader.option("query", query).load()
        low, high = self._reader(query).option("query", f"SELECT min(q.{by}) AS low, max(q.{by}) AS high FROM ({query}) q").load().first()
        table = reader.option("dbtable", f"({query}) q")
        if low is None or low == high:
            return table.load()
        return table.option("partitionColumn", by).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", partitions).load()
