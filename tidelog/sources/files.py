"""Files beside the log: stored objects, payload files, and the providers' manifest."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import split_provided


_local: list[str] = []


def stored_objects(spark: SparkSession, path: str, contents: bool = False) -> DataFrame:
    """Objects kept as files named by their hash, in folders of two hex digits: sha, size, mtime and, on demand, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    columns = [F.element_at(F.split("path", "/"), -1).alias("sha"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime")]
    return files.select(*columns, *(["content"] if contents else [])).where(F.col("sha").rlike("^[0-9a-f]{64}$"))


def corrupt_objects(objects: DataFrame) -> DataFrame:
    """Objects (with contents) that do not hash to their name."""
    return objects.where(F.sha2("content", 256) != F.col("sha")).drop("content")


def payload_files(spark: SparkSession, path: str) -> DataFrame:
    """One payload a file."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("payload"))


def provider_manifest(subscriptions: DataFrame) -> DataFrame:
    """What each active provider offers, a row each, as its sidecar says it."""
    rows = subscriptions.where((F.col("role") == "provider") & F.col("deregistered_at").isNull())
    return rows.select("plugin", split_provided(F.col("event_type_filter")).alias("provides"), "registered_at")


def write_sidecars(subscriptions: DataFrame, path: str) -> None:
    """The active providers' manifest as JSON, a folder a plugin; what stood there, of providers now gone too, is replaced."""
    provider_manifest(subscriptions).write.mode("overwrite").partitionBy("plugin").json(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only where a single JVM runs everything."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tidelog-"))
            atexit.register(shutil.rmtree, _local[0], True)
        found = "file://" + _local[0]
    return f"{found.rstrip('/')}/tidelog-{name}-{uuid.uuid4().hex}"
