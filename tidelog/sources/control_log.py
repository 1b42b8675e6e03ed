"""Control tables on Parquet: appended change rows that fold to the latest state of each key.

A change is a small file in its table's folder; ``compact`` rewrites a table as one snapshot and
names it in the next change's place, so readers see the old files or the new ones. A row marked
``gone`` removes its key. Rows of one writer are ordered by ``seq``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ATTEMPT, CURSOR, DEAD_LETTER, SUBSCRIPTION

#: Columns and keys of each table.
TABLES = {
    "subscriptions": (SUBSCRIPTION, ["subscription_id"]),
    "cursors": (CURSOR, ["cursor_id"]),
    "attempts": (ATTEMPT, ["cursor_id", "event_id"]),
    "dead_letters": (DEAD_LETTER, ["dl_id"]),
}


class ControlLog:
    """The control tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._last = spark, path.rstrip("/"), 0

    def _seq(self) -> int:
        self._last = max(self._last + 1, time.time_ns())
        return self._last

    def _changes(self, name: str) -> DataFrame:
        schema = f"{TABLES[name][0]}, seq bigint, gone boolean"
        folder = f"{self.path}/{name}"
        target = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)

    def read(self, name: str) -> DataFrame:
        """The latest row of each key that is not gone."""
        schema, keys = TABLES[name]
        columns = [x.split()[0] for x in schema.split(", ")]
        latest = self._changes(name).groupBy(*keys).agg(F.max_by(F.struct(*columns, "gone"), "seq").alias("s")).select("s.*")
        return latest.where("not gone").drop("gone").select(*columns)

    def put(self, name: str, rows: DataFrame, gone: bool = False) -> None:
        """Appends a change for each row."""
        columns = [x.split()[0] for x in TABLES[name][0].split(", ")]
        rows.select(*columns, F.lit(self._seq()).alias("seq"), F.lit(gone).alias("gone")).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def put_rows(self, name: str, rows: Iterable[dict], gone: bool = False) -> None:
        schema = TABLES[name][0]
        columns = [x.split()[0] for x in schema.split(", ")]
        found = [tuple(r.get(c) for c in columns) for r in rows]
        if found:
            self.put(name, self.spark.createDataFrame(found, schema), gone)

    def compact(self, name: str) -> None:
        """One snapshot instead of the changes so far. Keys that are gone stay out; a crash leaves rows twice, which fold."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return
        old = [x.getPath() for x in fs.listStatus(folder)]
        now = self.read(name)
        # a snapshot keeps its rows' order before later changes; removed keys go only once their changes are gone too
        now.withColumns({"seq": F.lit(self._seq()), "gone": F.lit(False)}).write.parquet(f"{self.path}/{name}/snapshot-{uuid.uuid4().hex}")
        for path in old:
            fs.delete(path, True)
