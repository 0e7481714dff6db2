"""Reading and writing the engine's tables (section A)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from labelloom.operators.boxes import class_ids
from labelloom.operators.labels import ranked

from .scratch import sized, written

#: Suffixes of image files, and words that mean true.
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")
TRUE = ("true", "1", "yes", "y")


VIDEO_SUFFIXES = ("mp4", "avi", "mov", "mkv", "webm", "m4v")


def files(spark: SparkSession, roots: list[str], suffixes=IMAGE_SUFFIXES) -> DataFrame:
    """path, length, modificationTime of files with one of the suffixes below the roots, each once (A1, A2); contents stay unread."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", "length", "modificationTime")
    return listed.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)).dropDuplicates(["path"])


def videos(spark: SparkSession, roots: list[str], limit: int = 200) -> DataFrame:
    """path, length of up to ``limit`` videos, root by root in the given order and by path within one, each once."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    first = F.lit(len(roots))
    for k, root in reversed(list(enumerate(roots))):
        named = at(root).getFileSystem(conf).makeQualified(at(root)).toString()  # as the listing writes it
        first = F.when(F.col("path").startswith(named.rstrip("/") + "/"), k).otherwise(first)
    return files(spark, roots, VIDEO_SUFFIXES).orderBy(first, "path").limit(limit).select("path", "length")


def laid_out(rows: DataFrame, root: str) -> DataFrame:
    """Write each row's ``content`` (binary) as the file ``root/path``, and return path and length of what was written.

    Tasks write files of their own; a task that runs again writes the same ones.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            names, contents = b.column(0).to_pylist(), b.column(1).to_pylist()
            for folder in {n.rpartition("/")[0] for n in names}:
                store.create_dir(f"{base}/{folder}", recursive=True)
            for n, content in zip(names, contents, strict=True):
                with store.open_output_stream(f"{base}/{n}", compression=None) as out:
                    out.write(content)
            yield pa.RecordBatch.from_pydict({"path": names, "length": pa.array([len(c) for c in contents], pa.int64())})

    return rows.select("path", "content").mapInArrow(put, "path string, length long")


def conformed(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema``: absent ones null, values that do not read as the type null."""
    return df.select(*[_as(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None), f.dataType.simpleString()).alias(f.name) for f in schema])


def _as(value: Column, kind: str) -> Column:
    if kind == "boolean":
        return said_true(value.cast("string"))
    return value.try_cast(kind)


def said_true(value: Column) -> Column:
    """Whether a text means true; null does not."""
    return F.coalesce(F.lower(F.trim(value)).isin(*TRUE), F.lit(False))


def grown(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The rows of a table whose files were written under several generations of its schema, with the columns of ``schema``.

    Files that lack a column have null in it. A table with a column that the schema does not know is another's: it is left
    alone, and None returned.
    """
    stored = spark.read.option("mergeSchema", True).parquet(path)
    if set(stored.columns) - set(schema.names):
        return None
    return conformed(stored, schema)


def evolved(old: DataFrame, new: DataFrame, known: set[str]) -> DataFrame:
    """Old and new rows with the columns of both, absent ones null (A12); a column that is not known is an error."""
    strange = (set(old.columns) | set(new.columns)) - known
    if strange:
        raise ValueError(f"columns that the table does not know: {sorted(strange)}")
    return old.unionByName(new, allowMissingColumns=True)


def append_by_day(df: DataFrame, time: str, path: str) -> None:
    """Append rows in folders by UTC day, so that a day's rows are read alone (A9, A10); adaptive execution splits days of many rows."""
    df.withColumn("day", F.to_date(time)).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


#: Encodings that foreign files are tried in, in this order.
ENCODINGS = ("utf-8-sig", "cp949")


def _recoded(df: DataFrame, encoding: str) -> DataFrame:
    """Texts that were read byte by byte, as the encoding means them, with ``bad``: whether a cell of the row is not valid in it."""
    names = df.columns

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad, out = [False] * b.num_rows, []
            for column in b.columns:
                cells = column.to_pylist()
                for k, x in enumerate(cells):
                    if x is not None:
                        try:
                            cells[k] = x.encode("latin-1").decode(encoding)
                        except UnicodeDecodeError:
                            cells[k], bad[k] = None, True
                out.append(pa.array(cells, pa.string()))
            yield pa.RecordBatch.from_arrays([*out, pa.array(bad, pa.bool_())], names=[*names, "bad"])

    return df.mapInArrow(decode, StructType([*df.schema.fields, StructField("bad", BooleanType())]))


def readable_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """A CSV with a header in the first encoding that all of it is valid in (A13); none is an error.

    Cells are told apart byte by byte, which leaves every other byte as it is in encodings that hold ASCII, and decoded in
    tasks; a trial reads until it finds a cell that is not valid.
    """
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    for encoding in encodings:
        try:
            named = [c.encode("latin-1").decode(encoding) for c in raw.columns]
        except UnicodeDecodeError:
            continue
        got = _recoded(raw.toDF(*[f"c{k}" for k in range(len(named))]), encoding)
        if not got.where("bad").head(1):
            return got.drop("bad").toDF(*named)
    raise ValueError(f"{path} is in none of the encodings {', '.join(encodings)}")


def official_split(spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]], encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """A CSV of foreign column names with ours: each name takes the first of its spellings that the file has."""
    df = readable_csv(spark, path, encodings)
    named = {c.strip().lstrip("﻿").lower(): c for c in df.columns}
    return df.select(*[next((F.col(f"`{named[s]}`") for s in spelt if s in named), F.lit(None).cast("string")).alias(ours) for ours, spelt in columns.items()])


def chosen_split(split: DataFrame, categories: tuple[str, ...], bad: str = "anomaly") -> DataFrame:
    """The rows of a foreign split in some categories, with y: 1 where the label says ``bad``."""
    return split.where(F.col("category").isin(*categories)).withColumn("y", (F.lower("label") == bad).cast("long"))


def filled(df: DataFrame, schema: StructType) -> DataFrame:
    """``conformed`` with 0 or an empty text for what is absent or does not read as its type."""
    got = conformed(df, schema)
    return got.fillna(0).fillna("").select(*got.columns)


def csv_copy(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as CSV files with a header and read it back with its own types."""
    df.write.option("header", True).option("escape", '"').csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).option("escape", '"').csv(path)


def replace_splits(df: DataFrame, path: str, key: str = "seq") -> DataFrame:
    """The splits table in full, its files in order of the key, in place of what lies at ``path``.

    The new files are written beside the old ones and swapped in by name when all are there: a write that fails leaves
    the old table as it is, and ``df`` may read from it.
    """
    spark = df.sparkSession
    new, old = f"{path.rstrip('/')}-new-{uuid.uuid4().hex}", f"{path.rstrip('/')}-old-{uuid.uuid4().hex}"
    df.select(key, "split").repartitionByRange(key).sortWithinPartitions(key).write.parquet(new)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = files.exists(at(path))
    if had:
        files.rename(at(path), at(old))
    if not files.rename(at(new), at(path)):
        if had:
            files.rename(at(old), at(path))
        raise OSError(f"{path} could not be replaced")
    if had:
        files.delete(at(old), True)
    return spark.read.parquet(path)


def uploaded(batch: DataFrame, content: str, suffix: str = ".png") -> DataFrame:
    """Adds sha1, image_id and path, named by content, to rows of bytes with a category (A5); null content has none of them."""
    named = batch.withColumn("sha1", F.sha1(content))
    image = F.substring("sha1", 1, 16)
    return named.withColumns({"image_id": image, "path": F.concat("category", F.lit("/"), image, F.lit(suffix))})


def import_outcomes(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """Each listed file with its outcome: failed, mask, duplicate or added (A3, A5).

    ``listing`` has seq, sha1 and is_mask; a file without a hash could not be read. The first of equal contents is added.
    """
    first = listing.where(~F.col("is_mask") & F.col("sha1").isNotNull()).groupBy("sha1").agg(F.min("seq").alias("first"))
    known = stored.select("sha1").distinct().withColumn("known", F.lit(True))
    df = listing.join(first.hint("merge"), "sha1", "left").join(known.hint("merge"), "sha1", "left")
    outcome = F.when(F.col("sha1").isNull(), "failed").when(F.col("is_mask"), "mask").when(F.col("known") | (F.col("seq") > F.col("first")), "duplicate").otherwise("added")
    return df.withColumn("outcome", outcome).drop("first", "known")


def coco(boxes: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations and categories of a COCO export as three tables with dense ids from 1 (A17), to be written as such.

    Images are numbered by image_id, annotations by image and seq, categories by label. Numbers come from counted ranges of
    the whole table, so no task numbers all rows.
    """
    used = written(images.join(boxes.select("image_id").distinct().hint("merge"), "image_id", "left_semi"), "images")
    numbers = ranked(used, [], ["image_id"], ["image_id"]).select("image_id", F.col("r").alias("image"))
    kinds = written(class_ids(boxes).select("label", (F.col("class_id") + 1).alias("category_id")), "classes")
    marks = written(boxes.join(numbers.hint("merge"), "image_id").join(sized(kinds), "label"), "marks")
    order = ranked(marks, [], ["image", "seq"], ["seq"]).select("seq", F.col("r").alias("id"))
    annotations = marks.join(order.hint("merge"), "seq").select("id", F.col("image").alias("image_id"), "category_id", F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"), F.lit(0).alias("iscrowd"))
    return used.join(numbers.hint("merge"), "image_id").select(F.col("image").alias("id"), "width", "height", F.col("path").alias("file_name")), annotations, kinds.select(F.col("category_id").alias("id"), F.col("label").alias("name"))
