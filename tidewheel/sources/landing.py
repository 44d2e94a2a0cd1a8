"""Landing: payload flattening, row validation, keyed merge, marks, audit, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The patterns of secrets in messages and what replaces them.
SECRETS = [(r"(?i)(api_?key|token|password|secret)=[^&\s]+", "$1=***"), (r"(?i)bearer\s+[a-z0-9._-]+", "Bearer ***")]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every floating column without NaN: missing values have one form."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns))


def flatten_bars(payload: DataFrame, key: str = "symbol") -> DataFrame:
    """Parallel arrays (timestamps, open, high, low, close, volume, adjclose) -> a row for each bar.
    The adjusted close wins over the close; bars without either are dropped; a currency suffix of
    the key is cut off."""
    arrays = F.arrays_zip("timestamps", "open", "high", "low", "close", "volume", "adjclose")
    rows = payload.select(F.split(key, "-")[0].alias(key), F.explode(arrays).alias("b"))
    close = F.coalesce("b.adjclose", "b.close")
    return rows.select(key, F.to_date(F.timestamp_seconds("b.timestamps")).alias("date"), "b.open", "b.high", "b.low", close.alias("close"), "b.volume").where("close is not null")


def flatten_observations(payload: DataFrame, key: str, column: str, schema: str) -> DataFrame:
    """A JSON array of records -> rows; a number written as "." or not at all is null."""
    rows = payload.select(key, F.explode(F.from_json(column, schema)).alias("o")).select(key, "o.*")
    return rows.withColumn("value", F.expr("try_cast(value as double)"))


def flatten_envelope(payload: DataFrame, key: str, column: str, schema: str) -> DataFrame:
    """A JSON array of page information and records -> the records as rows."""
    return flatten_observations(payload.withColumn(column, F.get_json_object(column, "$[1]")), key, column, schema)


def required(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are all there; a missing key column is an error."""
    if lost := set(keys) - set(df.columns):
        raise ValueError(f"missing columns: {sorted(lost)}")
    return df.dropna(subset=keys)


def validated(df: DataFrame, types: dict[str, str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows with the given types, rejected rows with a reason). Undeclared columns stay."""
    cast = {c: F.expr(f"try_cast(`{c}` as {t})") for c, t in types.items()}
    reasons = [F.when(F.col(c).isNotNull() & cast[c].isNull(), F.lit(f"{c} is not {t}")) for c, t in types.items()]
    reasons += [F.when(F.col(k).isNull(), F.lit(f"{k} is null")) for k in keys]
    flagged = df.withColumn("reason", F.array_join(F.array_compact(F.array(*reasons)), "; "))
    return flagged.where("reason = ''").drop("reason").withColumns(cast), flagged.where("reason != ''")


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], loaded_at: Column | None = None) -> DataFrame:
    """``existing`` with the rows of ``batch``: a row of the batch replaces the row of its key. Of the batch's rows with
    one key one counts. ``loaded_at`` stamps what comes in; rows that stay keep theirs."""
    batch = batch.dropDuplicates(keys)
    if loaded_at is not None:
        batch = batch.withColumn("loaded_at", loaded_at)
    return existing.join(batch.select(*keys), keys, "left_anti").unionByName(batch, allowMissingColumns=True)


def high_water_mark(df: DataFrame, time_col: str, keys: list[str] | None = None) -> DataFrame:
    """The latest time, by key if keys are given: a new key has no mark and gets its history."""
    return df.groupBy(*(keys or [])).agg(F.max(time_col).alias("mark"))


def newer(df: DataFrame, marks: DataFrame, time_col: str, keys: list[str]) -> DataFrame:
    """Rows after their key's mark."""
    return df.join(marks, keys, "left").where(F.col("mark").isNull() | (F.col(time_col) > F.col("mark"))).drop("mark")


def audit_latest(runs: DataFrame) -> DataFrame:
    """The last state of each run; messages are cut at 500 characters."""
    last = W.partitionBy("run_id").orderBy(F.col("logged_at").desc())
    rows = runs.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")
    return rows.withColumn("message", F.substring("message", 1, 500))


def redact_text(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    for pattern, mask in SECRETS:
        c = F.regexp_replace(c, pattern, mask)
    return c


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """A catalog table, or an empty frame if it doesn't exist; a drifted schema is still an error."""
    if not spark.catalog.tableExists(name):
        return spark.createDataFrame([], schema)
    return spark.table(name).select(*(F.col(f.name).cast(f.dataType) for f in schema))


def ensure_tables(spark: SparkSession, tables: dict[str, T.StructType], folder: str) -> dict[str, list[str]]:
    """Catalog tables with these schemas: one that is absent is created empty below ``folder``, one that is there gets the columns that it lacks
    (null in its rows, which stay where they are; only the catalog changes). Returns the added columns of each table, all of them for a new one.
    Names are compared as the session does; a column that is there keeps its type. Called again it changes nothing."""
    added = {}
    for name, schema in tables.items():
        if not spark.catalog.tableExists(name):
            spark.catalog.createTable(name, path=f"{folder}/{name}", source="parquet", schema=schema)
            added[name] = schema.fieldNames()
            continue
        fold = str.lower if spark.conf.get("spark.sql.caseSensitive") == "false" else str
        there = {fold(c) for c in spark.table(name).columns}
        lacking = [f for f in schema if fold(f.name) not in there]
        if lacking:
            spark.sql(f"alter table {name} add columns ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in lacking)})")
        added[name] = [f.name for f in lacking]
    return added


def _files(spark: SparkSession, path: str):
    to = spark._jvm.org.apache.hadoop.fs.Path
    return to, to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def snapshots(spark: SparkSession, path: str) -> list[str]:
    """The published snapshots below ``path``, oldest first."""
    to, fs = _files(spark, path)
    if not fs.exists(to(path)):
        return []
    return sorted(f"{path}/{s.getPath().getName()}" for s in fs.listStatus(to(path)) if s.getPath().getName().startswith("snapshot-"))


def snapshot_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the newest snapshot."""
    return spark.read.parquet(f"{snapshots(spark, path)[-1]}/{name}")


def export_snapshot(tables: dict[str, DataFrame], path: str, partitions: int | None = None, max_bytes: int | None = None, keep: int = 2) -> DataFrame:
    """Publishes all tables together and returns the manifest: table, rows.

    The tables and their manifest (table ``_manifest``) are written below a name that readers don't look at; one rename to ``snapshot-<number>`` publishes them, so a
    reader finds either the whole new snapshot or the one before, and a failure at any point leaves that one in place. Of the snapshots the last ``keep`` stay.
    ``partitions``: files of each table; ``max_bytes``: a snapshot that is larger is not published. One writer at a time, on a file system that renames
    folders at once: where another writer took the number first, the rename is refused and this is an error.
    """
    if not tables:
        raise ValueError("a snapshot has at least one table")
    spark = next(iter(tables.values())).sparkSession
    staged = f"{path}/.staged-{uuid.uuid4().hex}"
    to, fs = _files(spark, path)
    try:
        counts = []
        for name, df in tables.items():
            (df.coalesce(partitions) if partitions else df).write.parquet(f"{staged}/{name}")
            counts.append((name, spark.read.schema(df.schema).parquet(f"{staged}/{name}").count()))
        manifest = spark.createDataFrame(counts, "table string, rows long")
        manifest.coalesce(1).write.parquet(f"{staged}/_manifest")
        size = fs.getContentSummary(to(staged)).getLength()
        if max_bytes is not None and size > max_bytes:
            raise ValueError(f"the snapshot has {size} bytes, more than {max_bytes}")
        before = snapshots(spark, path)
        number = int(before[-1].rsplit("-", 1)[1]) + 1 if before else 1
        place = to(f"{path}/snapshot-{number:09d}")
        if fs.exists(place) or not fs.rename(to(staged), place):
            raise OSError(f"{place.toString()} was not published")
    finally:
        fs.delete(to(staged), True)  # nothing is left of it once it has been published
    for old in snapshots(spark, path)[:-keep]:
        fs.delete(to(old), True)
    return manifest


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table at ``path``: what several plans read is computed once."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
