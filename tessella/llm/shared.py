"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where master is local and the setting is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tessella-")
    return _local_roots[app]


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and rereads it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tessella-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Appended:
    """A table in the shared folder to which blocks of rows are added one after the other."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema = spark, schema
        self.path = f"{shared_root(spark)}/tessella-{uuid.uuid4().hex}"
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def ascii_lower(column) -> F.Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_of(column, modulus: int) -> F.Column:
    """crc32 of the value's text, modulo; a null value falls in bucket -1 (never held out)."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % F.lit(modulus), F.lit(-1))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have (Spark tells names apart without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def id_type(df: DataFrame, column: str = "doc_id") -> str:
    """The type of the id column, as a schema string has it."""
    return df.schema[column].dataType.simpleString()
