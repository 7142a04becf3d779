"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_SHIPPED: set[str] = set()
#: Bytes of one Arrow batch on its way to Python and back, at most; Spark's own default is 64 MB.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application, and keep the session's
    Arrow batches small: rows hold whole texts here, so a number of rows bounds nothing."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (size := spark.conf.get(name).rstrip("b")).isdecimal() and not 0 < int(size) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="kindred-")) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it on a cluster. Where it is unset, which is so only on one
    machine, a temporary folder takes its place.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), f"kindred-shared-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{shared_dir(spark)}/kindred/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder: frames that came from here
    can't be read any more."""
    remove(spark, f"{shared_dir(spark)}/kindred/{spark.sparkContext.applicationId}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in whichever file system holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there, and a lost
    executor costs nothing that is written."""
    path = scratch(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """Intermediate tables of one run, which go when the run no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, tag: str, **options: str) -> DataFrame:
        self.paths[tag] = scratch(self.spark, tag)
        df.write.options(**options).parquet(self.paths[tag])
        return self.spark.read.schema(df.schema).parquet(self.paths[tag])

    def drop(self, *tags: str) -> None:
        for tag in tags:
            remove(self.spark, self.paths.pop(tag))


def column(name: str, within: str = "") -> Column:
    """A column, or a field of the struct ``within``, by its very name: dots, blanks and all."""
    return F.col(f"{within}.`{name.replace('`', '``')}`" if within else f"`{name.replace('`', '``')}`")


def as_row(df: DataFrame, *more: Column) -> DataFrame:
    """All columns of ``df`` as the struct ``row``, which no name of theirs can clash with, and ``more``."""
    return df.select(F.struct(*(column(c).alias(c) for c in df.columns)).alias("row"), *more)


def with_row(df: DataFrame, ddl: str) -> StructType:
    """The type of the column ``row`` of ``df`` and further ones."""
    return StructType([StructField("row", df.schema["row"].dataType), *StructType.fromDDL(ddl)])


def fresh(name: str, df: DataFrame) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def doc_order() -> list[Column]:
    """Ascending doc_id, and an order of repeated ids that doesn't hang on the partitioning."""
    return [F.col("doc_id").asc_nulls_first(), F.xxhash64(text_of())]
