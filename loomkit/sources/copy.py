"""COPY in both directions, with the checks and the row count that its users expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.errors import InvalidArgument

#: Codecs by the suffix of a path (fixed values).
CODECS = {"gz": "gzip", "zst": "zstd", "bz2": "bzip2", "snappy": "snappy", "lz4": "lz4"}


def copy_to(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", **options) -> int:
    """Writes df and returns the rows written, counted while they are."""
    suffix = path.rpartition(".")[2]
    if suffix in CODECS:
        options.setdefault("compression", CODECS[suffix])
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format(fmt).mode(mode).options(**options).save(path)
    return int(seen.get["n"])


def copy_from(spark: SparkSession, path: str, target: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """The file's rows as the target has them. Another number of columns, or of names in formats that have them, is an error."""
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("csv", "json"):
        if fmt == "csv":
            width = len(spark.read.format(fmt).options(**options).load(path).columns)
            if width != len(target):
                raise InvalidArgument(f"{width} columns where the target has {len(target)}")
        return reader.schema(target).load(path)
    found = reader.load(path)
    if len(found.columns) != len(target):
        raise InvalidArgument(f"{len(found.columns)} columns where the target has {len(target)}")
    return found.select(*(F.col(f"`{a}`").cast(f.dataType).alias(f.name) for a, f in zip(found.columns, target)))


def append(df: DataFrame, table: str) -> None:
    """Rows appended to a table of the session's catalog, by position; another number of columns is an error."""
    have = df.sparkSession.table(table).schema
    if len(have) != len(df.columns):
        raise InvalidArgument(f"{len(df.columns)} columns where {table} has {len(have)}")
    df.toDF(*have.names).write.insertInto(table)


def decoded(spark: SparkSession, path: str, charset: str) -> DataFrame:
    """Whole files as text of a charset: path, length and text."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.decode("content", charset).alias("text"))


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length and time of the files of a folder whose names fit a glob."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")
