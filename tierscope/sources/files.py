"""Files: JSON and JSON lines, run cells by name, and writers that never overwrite."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.work import written
from .claims import Claims

_READ_ONLY = {"select", "with", "begin", "rollback", "set", "show"}
_OPTION = re.compile(r"^[a-zA-Z0-9][a-zA-Z0-9._-]*$")

CELL_SCHEMA = "caseId string, page int, inputContentHash string, tier string, status string, startedAt string, finishedAt string, wallMs double, observedMinimumWallMs double, artifactKey string, cache struct<hit: boolean, key: string, lookupMs: double>, provider struct<id: string, version: string, model: string, execution: string>, error struct<code: string, message: string>"
_CELL = r"^(calibration|evaluation)-(.+?)(?:-P(\d{4,}))?-(T[0-3])\.json$"


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Whole JSON documents, one row a file; malformed ones fail."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One row a line; blank lines are none, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Run cells of a folder; partition, case, page and tier come from the file name, which must be well formed."""
    rows = read_json(spark, path, CELL_SCHEMA).withColumn("file", F.col("_metadata.file_name"))
    part = lambda i: F.nullif(F.regexp_extract("file", _CELL, i), F.lit(""))
    name = F.when(F.col("file").rlike(_CELL), F.col("file")).otherwise(F.raise_error(F.concat(F.lit("not a run cell: "), "file")).cast("string"))
    return rows.withColumn("file", name).select("file", part(1).alias("partition"), part(2).alias("case_id"), part(3).cast("int").alias("page"), part(4).alias("tier"), F.col("status"), F.to_timestamp("startedAt").alias("started_at"), F.to_timestamp("finishedAt").alias("finished_at"), F.col("wallMs").alias("wall_ms"), F.col("observedMinimumWallMs").alias("observed_minimum_wall_ms"), F.col("artifactKey").alias("artifact_key"), F.col("cache.hit").alias("cache_hit"), F.col("provider.id").alias("provider_id"), F.col("error.code").alias("error_code"))


def read_blobs(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, length, content) of files, bytes as they are."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


class StorageError(Exception):
    """A blob can't be read; code tells why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def http_get(url: str, timeout_s: float = 60.0) -> bytes:
    """The body at a URL, redirects followed; STORAGE_HTTP_<status> otherwise."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="GET"), timeout=timeout_s) as r:
            return r.read()
    except urllib.error.HTTPError as e:
        raise StorageError(f"STORAGE_HTTP_{e.code}") from e
    except (urllib.error.URLError, TimeoutError) as e:
        raise StorageError("STORAGE_UNREACHABLE") from e


def read_stored(files: DataFrame, folder: str, get: Callable[[str], bytes] = http_get, key: str = "case_id") -> DataFrame:
    """(key, content, content_hash, error_code) of stored files (key, storage_url, storage_path, file_hash).

    http and https URLs are fetched by the executors, other files read below folder by Spark. Where file_hash is a
    SHA-256, content of another hash is refused; a null one is not tested.
    """
    web = F.coalesce(F.col("storage_url").rlike("(?i)^https?://"), F.lit(False))
    kind = files.schema[key].dataType.simpleString()

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, url, want in zip(frame["key_"], frame["storage_url"], frame["file_hash"], strict=True):
                try:
                    row = (k, get(url), want, None)
                except StorageError as e:
                    row = (k, None, want, e.code)
                yield pd.DataFrame([row], columns=["key_", "content", "file_hash", "error_code"])

    fetched = files.where(web).select(F.col(key).alias("key_"), "storage_url", "file_hash").mapInPandas(fetch, f"key_ {kind}, content binary, file_hash string, error_code string")
    outside = F.col("storage_path").startswith("/") | F.array_contains(F.split("storage_path", "/"), "..")
    root = files.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(files.sparkSession._jsc.hadoopConfiguration()).makeQualified(root).toString()
    blobs = read_blobs(files.sparkSession, folder, "*").select(F.expr(f"substring(path, {len(root.rstrip('/')) + 2})").alias("storage_path"), "content")
    local = files.where(~web).select(F.col(key).alias("key_"), "storage_path", "file_hash", outside.alias("outside_")).join(blobs, "storage_path", "left")
    why = F.when(F.col("outside_"), "STORAGE_PATH_OUTSIDE_FOLDER").when(F.col("content").isNull(), "STORAGE_NOT_FOUND")
    rows = fetched.unionByName(local.select("key_", F.when(~F.col("outside_"), F.col("content")).alias("content"), "file_hash", why.alias("error_code")))
    want, found = F.lower("file_hash"), F.sha2("content", 256)
    other = want.rlike("^[a-f0-9]{64}$") & (want != found)
    code = F.coalesce("error_code", F.when(other, "STORAGE_HASH_MISMATCH"))
    return rows.select(F.col("key_").alias(key), F.when(code.isNull(), F.col("content")).alias("content"), F.when(code.isNull(), found).alias("content_hash"), code.alias("error_code"))


def read_or_cache(files: DataFrame, folder: str, cache: str, get: Callable[[str], bytes] = http_get, key: str = "case_id") -> DataFrame:
    """read_stored through a cache folder of (key, content, content_hash): a copy there is used where no hash is known
    or the known one is its own, of several copies the one of the least hash. The others are read once, and those that
    can be are added to the cache; what can't be has no content and read_stored's error_code."""
    spark = files.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    kind = files.schema[key].dataType.simpleString()
    copies = spark.read.schema(f"`{key}` {kind}, content binary, content_hash string").parquet(cache) if there else spark.createDataFrame([], f"`{key}` {kind}, content binary, content_hash string")
    want = F.lower("file_hash")
    fitting = files.select(key, F.when(want.rlike("^[a-f0-9]{64}$"), want).alias("want_")).join(copies, key).where("want_ IS NULL OR want_ = content_hash")
    known = written(fitting.groupBy(key).agg(F.min_by("content", "content_hash").alias("content"), F.min("content_hash").alias("content_hash")), "stored-known")
    read = written(read_stored(files.join(known.select(key), key, "left_anti"), folder, get, key), "stored-read")
    # A copy of another hash stays in the cache and is never used again; what is read now is added beside it.
    read.where("error_code IS NULL").select(key, "content", "content_hash").write.mode("append").parquet(cache)
    return known.withColumn("error_code", F.lit(None).cast("string")).unionByName(read)


def write_pair(spark: SparkSession, text: str, path: str) -> str:
    """Write a declaration and, beside it, a manifest with its SHA-256, where neither is yet; returns the hash."""
    digest = hashlib.sha256(text.encode()).hexdigest()
    write_new(spark.createDataFrame([(text,)], "value string").coalesce(1), path, "parquet")
    write_new(spark.createDataFrame([(digest, True)], "sha256 string, immutable_write boolean").coalesce(1), f"{path}.manifest", "parquet")
    return digest


def read_pair(spark: SparkSession, path: str) -> dict:
    """The declaration that write_pair wrote; raises unless its manifest has its hash and it is frozen."""
    text, m = spark.read.parquet(path).first()["value"], spark.read.parquet(f"{path}.manifest").first()
    if not m["immutable_write"] or m["sha256"] != hashlib.sha256(text.encode()).hexdigest():
        raise ValueError("the manifest isn't of this declaration")
    value = json.loads(text)
    if value.get("status") != "frozen":
        raise ValueError("the declaration isn't frozen")
    return value


def verify_hashes(checks: DataFrame) -> DataFrame:
    """(name, found, passed) of (name, content, sha256): whether each content, canonical JSON or bytes, has its hash."""
    found = F.sha2(F.col("content").cast("binary"), 256)
    return checks.select("name", found.alias("found"), F.coalesce(found == F.lower("sha256"), F.lit(False)).alias("passed"))


def statement_kind(sql: str) -> str:
    """The first keyword of a statement; raises unless it can't write."""
    kind = (re.match(r"\s*([A-Za-z]+)", sql) or [None, ""])[1].lower()
    if kind not in _READ_ONLY:
        raise ValueError(f"statement not allowed: {kind or 'none'}")
    return kind


def checked_option(name: str, value: str) -> str:
    """A command option that is safe in a file name."""
    if not _OPTION.match(value):
        raise ValueError(f"{name} has characters that aren't allowed")
    return value


def safe_path(folder: str, name: str) -> str:
    """A path below a folder; absolute names and steps up are refused."""
    if name.startswith("/") or ".." in name.split("/"):
        raise ValueError("the path leaves its folder")
    return f"{folder.rstrip('/')}/{name}"


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write where nothing is yet; fails otherwise. The commit is all or nothing."""
    df.write.mode("errorifexists").format(kind).save(path)


def write_once(df: DataFrame, path: str, wait_s: float = 600.0) -> bool:
    """Write, or find the same rows there already (False); other rows are an error. The path is claimed meanwhile: of two
    writers one writes, and the other one compares."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    with Claims(spark, f"{target.getParent().toString()}/_claims", wait_s).held([target.getName()]):
        if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            df.write.mode("errorifexists").parquet(path)
            return True
        there = spark.read.parquet(path)
        if there.exceptAll(df).limit(1).count() or df.exceptAll(there).limit(1).count():
            raise ValueError(f"{path} holds other rows")
        return False


def write_pending(df: DataFrame, path: str) -> None:
    """Write unless something is there; what is there stays."""
    df.write.mode("ignore").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; values with commas, quotes or line breaks are quoted, quotes doubled."""
    df.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').csv(path)
