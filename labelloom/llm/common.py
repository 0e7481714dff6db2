"""What the training-data operators share: scratch tables, tables by path, a let-binding."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of ids or hashes that are broadcast at most: some 20 MB on each executor.
BROADCAST_ROWS = 500_000
#: Spark's setting by which a finished query's shuffle files are deleted at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the bytes of an Arrow batch, without a bound by default, and the bound taken where the session sets none.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may lack the setting: it then gets a folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    The write's own shuffle files, which nothing reads again, go when it is done.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that is read no more."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Have the driver's JVM collect what finished jobs left, so that Spark's cleaner deletes their shuffle files now and not at some later time."""
    spark.sparkContext._jvm.System.gc()


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows as the right side of a join: broadcast if a count shows it small, else hinted to merge."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of few rows that the driver has; by Arrow, as a list of rows would start Python workers of another kind on the executors, which stay beside the others."""
    schema = spark.createDataFrame([], schema).schema
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema, strict=True)]
    return spark.createDataFrame(pa.table(arrays, names=schema.names), schema)


def quoted(names: Iterable[str]) -> list[Column]:
    """The columns of those names, dots and backticks in them included."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def hand_back() -> None:
    """Give memory that a Python worker has freed back to the system: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(f, schema)`` for rows with texts.

    Arrow batches are bounded by bytes: 10,000 rows of long texts would be held by the JVM and by Python at once. The bound
    stays set in the session, as the rows are computed later; one that the session has set is left. A worker hands back
    what a task has freed.
    """
    if df.sparkSession.conf.get(BATCH, None) is None:
        df.sparkSession.conf.set(BATCH, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            hand_back()

    return df.mapInArrow(bounded, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in small ones, so that a worker holds few texts as Python objects at once."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it.

    Projections that are merged copy an expression into every place that names it, into the
    lambdas of array functions too; a lambda variable is not copied.
    """
    return F.transform(F.array(value), body)[0]
