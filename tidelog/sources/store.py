"""A durable event store on Parquet: a live tier, warm monthly buckets, and one pointer file.

Every commit writes new folders and then replaces ``store.json`` by a rename, so readers see one
state and a writer that dies leaves only folders nobody points to. A sweep commits the warm rows
before it commits the smaller live tier; a crash between the two leaves rows in both, which reads
heal by preferring live rows. There is one writer at a time, held by an exclusively created lock
file, which counts no more once it is ``LEASE_MS`` old.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EVENT, EVENT_COLUMNS, MANIFEST, BusError, Config
from ..operators import emit as emits
from ..operators import poll as polls
from ..operators import sweep as sweeps

VERSION = 1
#: A writer that has held the store for so long is taken for dead.
LEASE_MS = 6 * 3_600_000


class EventStore:
    """A store under ``path``, any folder that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._fs.exists(self._path("store.json")):
            self._commit({"version": VERSION, "high_water": 0, "live": [], "buckets": {}})
        elif self.state()["version"] > VERSION:
            raise BusError("WB-005", "the store is of a later version")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def state(self) -> dict:
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/store.json", wholetext=True).collect()))

    def _commit(self, state: dict) -> None:
        part = self._path(f"store-{uuid.uuid4().hex}.tmp")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        conf = self.spark._jsc.hadoopConfiguration()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.getFileSystem(conf).getUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(part), self._fs.makeQualified(self._path("store.json")), options)

    @contextlib.contextmanager
    def writing(self) -> Iterator[dict]:
        """The state under the writer's lock; it is committed if the body ends well."""
        lock = self._path("lock")
        try:
            if self._fs.exists(lock) and time.time() * 1000 - self._fs.getFileStatus(lock).getModificationTime() > LEASE_MS:
                self._fs.delete(lock, False)
            self._fs.create(lock, False).close()
        except Exception as e:
            raise BusError("WB-004", "another writer holds the store") from e
        try:
            state = self.state()
            yield state
            self._commit(state)
        finally:
            self._fs.delete(lock, False)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).parquet(*[f"{self.path}/{f}" for f in folders])

    def live(self) -> DataFrame:
        return self._read(self.state()["live"])

    def manifest(self) -> DataFrame:
        rows = [(k, b["min"], b["max"], b["created_at"], b["sealed_at"], b["bytes"]) for k, b in sorted(self.state()["buckets"].items())]
        return self.spark.createDataFrame(rows, MANIFEST)

    def warm(self, low: int = 0, high: int = (1 << 63) - 1) -> DataFrame:
        """Warm rows of the buckets that may hold ids in [low, high]; the others are not opened. WB-013 if one cannot be read."""
        kept = [r["bucket"] for r in polls.covering(self.manifest(), low, high).collect()]
        buckets = self.state()["buckets"]
        for k in kept:
            try:
                rows = self._read(buckets[k]["folders"])
                rows.where(F.col("event_id") > (1 << 62)).select("event_id").isEmpty()  # opens the footers, whose ranges rule all rows out
            except Exception as e:
                raise BusError("WB-013", f"bucket {k} cannot be read", bucket=k) from e
        return self._read([f for k in kept for f in buckets[k]["folders"]])

    def emit(self, batch: DataFrame, now: int, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Appends a batch; (accepted rows as written, rejected rows).

        The batch is written down first, since ids need several passes that must see the same rows.
        """
        with self.writing() as state:
            incoming = f"{self.path}/incoming/{uuid.uuid4().hex}"
            batch.write.parquet(incoming)
            batch = self.spark.read.schema(batch.schema).parquet(incoming)
            known = self._read(state["live"])
            accepted, rejected = emits.emit_batch(batch, known, registry, now, state["high_water"], self.config)
            folder = f"live/{uuid.uuid4().hex}"
            accepted.select(*EVENT_COLUMNS).write.parquet(f"{self.path}/{folder}")
            written = self._read([folder])
            top = written.agg(F.max("event_id")).first()[0]
            if top is not None:
                state["live"].append(folder)
                state["high_water"] = top
        return written, rejected

    def poll(self, last_event_id: int, filter_text: str, now: int, batch: int = polls.BATCH) -> DataFrame:
        live = self.live()
        polls.check_cursor(live, last_event_id)
        return polls.poll(live, last_event_id, filter_text, now, batch)

    def poll_tiered(self, last_event_id: int, where: dict | None = None, batch: int = polls.BATCH) -> DataFrame:
        """Live and warm rows together. WB-003 only if rows after the cursor are in neither tier."""
        live = self.live()
        low = live.agg(F.min("event_id")).first()[0]
        warm_low = min((b["min"] for b in self.state()["buckets"].values() if b["min"] is not None), default=None)
        lows = [x for x in (low, warm_low) if x is not None]
        if lows and last_event_id < min(lows) - 1:
            raise BusError("WB-003", f"cursor at {last_event_id}, oldest event {min(lows)}")
        if low is not None and warm_low is None:
            return polls.poll_tiered(live, self._read([]), last_event_id, where, batch)
        return polls.poll_tiered(live, self.warm(last_event_id + 1), last_event_id, where, batch)

    def sweep(self, now: int, batch: int = sweeps.BATCH, bucket_bytes: int = sweeps.BUCKET_BYTES, stop_after_warm: bool = False) -> dict:
        """Moves the oldest eligible rows into their months' buckets.

        Rows of a bucket that cannot be read or written stay live and are named as deferred. Only the
        live folders that rows leave are written anew. Joins are by shuffles: a column of ids takes
        little of a compressed file, so Spark's estimate would broadcast millions of them.
        """
        with self.writing() as state:
            live = self._read(state["live"]).withColumn("_folder", F.regexp_extract(F.input_file_name(), "/(live/[0-9a-f]{32})/", 1))
            chosen = sweeps.candidates(live, now, batch).withColumn("bucket", sweeps.month_of())
            folder = f"warm/{uuid.uuid4().hex}"
            months = [r["bucket"] for r in chosen.select("bucket").distinct().collect()]
            manifest = [r.asDict() for r in self.manifest().collect()]
            deferred = []
            for month in months:
                bucket, seal = sweeps.choose_bucket(month, manifest, bucket_bytes)
                old = state["buckets"].get(bucket, {"folders": []})
                target = f"{folder}/{bucket}"
                try:
                    have = self._read(old["folders"])
                    rows = chosen.where(F.col("bucket") == month).select(*EVENT_COLUMNS).join(have.select("event_id").hint("merge"), "event_id", "left_anti")
                    rows.repartitionByRange("event_id").sortWithinPartitions("event_id").write.parquet(f"{self.path}/{target}")
                    r = self._read([*old["folders"], target]).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
                    size = self._fs.getContentSummary(self._path(target)).getLength()
                except Exception:
                    deferred.append(month)
                    continue
                if seal:
                    state["buckets"][seal]["sealed_at"] = now
                state["buckets"][bucket] = {"folders": [*old["folders"], target], "min": r["lo"], "max": r["hi"], "created_at": old.get("created_at", now), "sealed_at": None, "bytes": old.get("bytes", 0) + size}
            self._commit(state)  # warm first
            if stop_after_warm:
                return {"moved": 0, "buckets": months}
            gone = chosen.where(~F.col("bucket").isin(*deferred)) if deferred else chosen
            left = {r["_folder"]: r["n"] for r in gone.groupBy("_folder").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a folder
            moved = sum(left.values())
            if left:
                kept = f"live/{uuid.uuid4().hex}"
                self._read(sorted(left)).join(gone.select("event_id").hint("merge"), "event_id", "left_anti").write.parquet(f"{self.path}/{kept}")
                state["live"] = [f for f in state["live"] if f not in left] + [kept]
            size = sum(self._fs.getContentSummary(self._path(f)).getLength() for f in state["live"])
            warning = sweeps.bloat(self._read(state["live"]).count(), size)
        return {"moved": moved, "buckets": sorted(set(months) - set(deferred)), "deferred": sorted(deferred), "warning": warning}
