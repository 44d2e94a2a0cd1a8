"""What the corpus operators share: shared-folder tables, word and white-space rules, folds."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The white space of the contracts: space and tab to carriage return.
WS = r"[\x20\x09-\x0D]+"
NOT_WS = r"[^\x20\x09-\x0D]"
PY_WS = "\t\n\x0b\x0c\r "


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local folder is made once and set, but only in local mode: on a cluster
    each executor would write to its own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tidewheel.local.checkpoint", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidewheel-")
        spark.conf.set("spark.tidewheel.local.checkpoint", path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends here, and
    a lost executor costs no recomputation of what stands before. Shuffle files that only the
    written plan needed are released at once: Spark drops them when the driver collects its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewheel/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
    written = spark.read.schema(df.schema).parquet(path)
    written.written_path = path
    return written


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote and that nothing reads any more."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(conf).delete(path, True)


def map_texts(docs: DataFrame, fields: str, start: Callable[[], Callable[[list[str]], dict]], text_col: str = "text", keep_text: bool = False, at_once: int = 500) -> DataFrame:
    """Adds columns made from texts. ``start()`` gives, once in each task, a function from a list of texts to
    a list or array (numpy's, or Arrow's as it is) for each of ``fields``. The other columns pass through Arrow as they are, so that null
    and 64-bit ids stay what they are."""
    added = StructType.fromDDL(fields)
    kept = [f for f in docs.schema if keep_text or f.name != text_col]
    types = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                got = make(part.column(text_col).to_pylist())
                columns = [part.column(f.name) for f in kept] + [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in types]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + types.names)
                del part, got, columns
            del batch
        # workers serve later tasks, too: what this one no longer needs goes back
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, StructType(kept + list(added)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def words(col: str | Column = "text") -> Column:
    """The words of a text: maximal runs without white space."""
    return F.filter(F.split(text_or_empty(col), WS), lambda w: w != "")


def n_words(col: str | Column = "text") -> Column:
    """Number of words, without building them."""
    squeezed = F.regexp_replace(text_or_empty(col), NOT_WS + "+", "x")
    return F.length(F.regexp_replace(squeezed, WS, "")).cast("long")


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(c.cast("string")), F.lit(modulus))


def hashed_sample(df: DataFrame, n: int, id_col: str, seed: int, *ties: str) -> DataFrame:
    """At most ``n`` rows, the first by a hash of their id, the same on every run.

    Rows are cut to about one and a half times as many where they are read, so that tasks do not
    each send ``n`` rows to be ordered.
    """
    share = 1.5 * n / max(1, df.select(id_col).count())
    u = F.xxhash64(F.lit(seed), id_col)
    cut = df if share >= 1 else df.where(u < F.lit(int((share - 0.5) * 2**64)))
    return cut.orderBy(u, id_col, *ties).limit(n)
