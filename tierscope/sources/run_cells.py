"""Run cells as a data source of their own: `spark.read.format("run_cells")`, after register(spark).

A cell is a JSON file whose name tells partition, case, page and tier. Filters on these reach the file list, so cells of
other tiers are neither opened nor parsed; files are dealt out in runs of `filesPerPartition`. Writing makes one file a
cell, staged by the tasks and moved to its place when all of them are done; a name that is there already stops the
write with nothing moved. Each write leaves an entry in the folder's log, and a stream reads the log in order, so it has
the cells that batch reads have, each once. The folder is one that every node mounts; read_cells() reads other stores.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "partition string, case_id string, page int, tier string, status string, started_at timestamp, finished_at timestamp, wall_ms double, observed_minimum_wall_ms double, artifact_key string, cache_hit boolean, provider_id string, error_code string"
_NAMED = ("partition", "case_id", "page", "tier")
_NAME = re.compile(r"(calibration|evaluation)-(.+?)(?:-P(\d{4,}))?-(T[0-3])\.json")
_LOG, _STAGED = "_log", "_staged-"


def parsed_name(name: str) -> dict:
    """What a file name tells; raises if it isn't one of a run cell."""
    found = _NAME.fullmatch(name)
    if not found:
        raise ValueError(f"not a run cell: {name}")
    partition, case_id, page, tier = found.groups()
    return {"partition": partition, "case_id": case_id, "page": None if page is None else int(page), "tier": tier}


def file_name(partition: str, case_id: str, page: int | None, tier: str) -> str:
    name = "-".join([partition, case_id, *([] if page is None else [f"P{page:04d}"]), tier]) + ".json"
    if "/" in name or parsed_name(name) != {"partition": partition, "case_id": case_id, "page": page, "tier": tier}:
        raise ValueError(f"not a run cell: {name}")
    return name


def _time(value: str | None) -> datetime | None:
    """An instant without its zone, in UTC, as the engine takes timestamps of a UTC session."""
    return None if value is None else datetime.fromisoformat(value.replace("Z", "+00:00")).astimezone(timezone.utc)


def _row(folder: str, name: str) -> tuple:
    with open(os.path.join(folder, name), encoding="utf-8") as f:
        cell = json.load(f)
    cache, provider, error = (cell.get(k) or {} for k in ("cache", "provider", "error"))
    number = lambda k: None if cell.get(k) is None else float(cell[k])
    return (*parsed_name(name).values(), cell.get("status"), _time(cell.get("startedAt")), _time(cell.get("finishedAt")), number("wallMs"), number("observedMinimumWallMs"), cell.get("artifactKey"), cache.get("hit"), provider.get("id"), error.get("code"))


def _folder(options: dict) -> str:
    path = options.get("path")
    if not path:
        raise ValueError("run_cells needs a path")
    if "://" in path or path.startswith("file:"):
        if not path.startswith("file:"):
            raise ValueError("run_cells reads a mounted folder; read_cells() reads other stores")
        path = re.sub("^file:(//)?", "", path)
    return path


@dataclass
class Files(InputPartition):
    names: list[str]


def _dealt(names: Sequence[str], size: int) -> list[Files]:
    return [Files(list(names[i : i + size])) for i in range(0, len(names), size)] or [Files([])]


class CellReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.size, self.wanted = _folder(options), int(options.get("filesPerPartition", 500)), {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on what names tell are taken over; the others go back to the engine."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in _NAMED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        names = sorted(e.name for e in os.scandir(self.folder) if e.is_file() and not e.name.startswith((".", "_")))
        return _dealt([n for n, told in zip(names, map(parsed_name, names)) if all(told[c] is not None and told[c] in v for c, v in self.wanted.items())], self.size)

    def read(self, partition: Files) -> Iterator[tuple]:
        for name in partition.names:
            yield _row(self.folder, name)


@dataclass
class Staged(WriterCommitMessage):
    names: list[str]


class CellWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("run cells are never overwritten; append to them")
        self.folder = _folder(options)
        self.staged = os.path.join(self.folder, _STAGED + uuid.uuid4().hex)

    def write(self, rows: Iterator[Row]) -> Staged:
        # Attempts of a task have folders of their own: what a lost one leaves is never moved.
        own = os.path.join(self.staged, uuid.uuid4().hex)
        os.makedirs(own)
        names = []
        for row in rows:
            r = row.asDict()
            name = file_name(*(r[c] for c in _NAMED))
            at = lambda t: None if t is None else (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).isoformat()
            cell = {"caseId": r["case_id"], "page": r["page"], "tier": r["tier"], "status": r["status"], "startedAt": at(r["started_at"]), "finishedAt": at(r["finished_at"]), "wallMs": r["wall_ms"], "observedMinimumWallMs": r["observed_minimum_wall_ms"], "artifactKey": r["artifact_key"], "cache": {"hit": r["cache_hit"]}, "provider": {"id": r["provider_id"]}, "error": {"code": r["error_code"]}}
            with open(os.path.join(own, name), "x", encoding="utf-8") as f:  # a name twice in a task stops it
                json.dump(cell, f, ensure_ascii=False)
            names.append(f"{os.path.basename(own)}/{name}")
        return Staged(names)

    def commit(self, messages: list[Staged | None]) -> None:
        staged = [n for m in messages if m is not None for n in m.names]
        names = [n.split("/")[1] for n in staged]
        if len(set(names)) < len(names):
            raise FileExistsError("a run cell is written twice")
        moved = []
        try:
            for source, name in zip(staged, names):
                os.link(os.path.join(self.staged, source), os.path.join(self.folder, name))  # fails where the name is there
                moved.append(name)
        except FileExistsError:
            for name in moved:
                os.unlink(os.path.join(self.folder, name))
            raise
        self._log(names)
        shutil.rmtree(self.staged, ignore_errors=True)

    def _log(self, names: list[str]) -> None:
        """The next entry of the log; of two writers that take a number one goes on to the next."""
        log = os.path.join(self.folder, _LOG)
        os.makedirs(log, exist_ok=True)
        whole = os.path.join(self.staged, "entry")
        with open(whole, "w", encoding="utf-8") as f:
            json.dump(sorted(names), f)
        n = _entries(self.folder)
        while True:
            try:
                os.link(whole, os.path.join(log, f"{n:012d}.json"))
                return
            except FileExistsError:
                n += 1

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


def _entries(folder: str) -> int:
    log = os.path.join(folder, _LOG)
    return max((int(n.split(".")[0]) + 1 for n in os.listdir(log)), default=0) if os.path.isdir(log) else 0


class CellStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.size = _folder(options), int(options.get("filesPerPartition", 500))

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        return {"entry": _entries(self.folder)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        names = []
        for n in range(start["entry"], end["entry"]):
            with open(os.path.join(self.folder, _LOG, f"{n:012d}.json"), encoding="utf-8") as f:
                names += json.load(f)
        return _dealt(names, self.size)

    def read(self, partition: Files) -> Iterator[tuple]:
        for name in partition.names:
            yield _row(self.folder, name)

    def commit(self, end: dict) -> None:
        """Entries stay: other streams and later starts read them."""


class RunCells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CellReader:
        return CellReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> CellWriter:
        return CellWriter(self.options, overwrite)

    def streamReader(self, schema: StructType) -> CellStream:
        return CellStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunCells)
