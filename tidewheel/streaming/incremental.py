"""Scheduled incremental loads as bounded streams: availableNow, foreachBatch, keyed merge."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import latest_per_key
from ..sources.landing import upsert


class ParquetTable:
    """A keyed Parquet table of numbered folders; the newest whole one (with Spark's _SUCCESS) is the table, also
    after a restart. A merge always writes a new folder, so a failed one leaves the table as it was, and a repeated
    batch changes nothing. Of the rows of a key the first in ``order`` stays, whether it came before or comes
    now; without an order the batch wins, and of its rows with one key any."""

    def __init__(self, spark: SparkSession, path: str, schema, order: list[Column] | None = None, keep: int = 2):
        self.spark, self.path, self.schema, self.order, self.keep = spark, path.rstrip("/"), schema, order, keep
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)

    def versions(self) -> list[int]:
        """Whole versions, oldest first."""
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        whole = self.versions()
        if not whole:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{whole[-1]}")

    def merge(self, batch: DataFrame, keys: list[str]) -> None:
        if self.order:
            old = self.read().join(batch.select(*keys), keys, "left_semi")
            batch = latest_per_key(old.unionByName(batch), keys, self.order)
        else:
            batch = batch.dropDuplicates(keys)
        whole = self.versions()
        # what a failed merge left under the next number is overwritten
        upsert(self.read(), batch, keys).write.mode("overwrite").parquet(f"{self.path}/v{whole[-1] + 1 if whole else 0}")
        for old in self.versions()[: -self.keep]:
            self._fs.delete(self._path(f"{self.path}/v{old}"), True)


AUDIT = "batch_id long, rows long, started timestamp, finished timestamp, status string"


def incremental_load(spark: SparkSession, source: str, table: ParquetTable, keys: list[str], checkpoint: str, files_per_batch: int = 1) -> DataFrame:
    """Reads what is new in ``source`` (a folder of Parquet files) and merges it by key. Returns the audit of all
    runs with this checkpoint: batch_id, rows, started, finished, status (ok or error); a failed batch is raised again."""
    log = f"{checkpoint.rstrip('/')}-audit"

    def note(batch_id: int, rows: int | None, started: datetime, status: str) -> None:
        spark.createDataFrame([(batch_id, rows, started, datetime.now(timezone.utc), status)], AUDIT).coalesce(1).write.mode("append").parquet(log)

    def land(batch: DataFrame, batch_id: int) -> None:
        started, batch = datetime.now(timezone.utc), batch.persist()
        try:
            table.merge(batch, keys)
            note(batch_id, batch.count(), started, "ok")
        except Exception:
            note(batch_id, None, started, "error")
            raise
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    try:
        return spark.read.schema(AUDIT).parquet(log)
    except AnalysisException:  # nothing has been loaded yet
        return spark.createDataFrame([], AUDIT)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode a new local one where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path or tempfile.mkdtemp(prefix="tidewheel-")


def scratch(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
