"""Shared pieces of the corpus operators: row-wise Arrow stages, tables cut to shared storage, small hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII upper case to lower case, everything that is not a digit, letter or byte of a non-ASCII character to a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Spark's own setting: shuffle files of a SQL execution are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a bucket of a table that is dealt out once.
BUCKET_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents; dealt to all cores if the scan has fewer parts than that (files of one row group)."""
    found, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return found if found.rdd.getNumPartitions() >= cores else found.repartition(cores)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII digits, ASCII letters and non-ASCII characters, as UTF-8."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def named(column: str) -> Column:
    """The column of exactly this name, dots and quotes in it included."""
    return F.col("`" + column.replace("`", "``") + "`")


def private(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as set it apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct; named() quotes them, so any names will do."""
    return F.struct(*(named(c).alias(c) for c in df.columns))


def annotate(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], list[tuple]]], fields: T.StructType) -> DataFrame:
    """All columns of df and those of fields, computed from the text of each row by tasks of their own (no shuffle).

    make() runs once in a task and returns a function from a list of texts (None where null) to a list of tuples.
    A column of df that has the name of a new one, in whatever case, is replaced; other names may be any, dots included.
    An empty df gives an empty result with the same columns.
    """
    names = [f.name for f in fields]
    new = {n.lower() for n in names}
    take = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in new]
    kept = [df.schema.fields[i] for i in take]
    schema = T.StructType(kept + list(fields.fields))
    place = df.columns.index(text_col)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fn = fn or make()
            rows = fn(batch.column(place).to_pylist())
            made = [pa.array(list(col), f.type) for col, f in zip(zip(*rows), arrow)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in take] + made, names=[f.name for f in kept] + names)

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)  # PySpark looks columns up by name there


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (for tests on one machine) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomkit-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor costs no recomputation.

    The shuffle files of the write are deleted with it, so that at any time only those of one step take disk.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    written(spark, lambda: df.write.option("compression", "zstd").parquet(path))
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession, write: Callable[[], None]) -> None:
    """Runs a write, after which Spark deletes the shuffle files that were made for it."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        write()
    finally:
        spark.conf.set(CLEANUP, before)


def dealt_once(df: DataFrame, keys: list[str], n_bytes: int, bucket_bytes: int = BUCKET_BYTES, grouped: bool = False) -> DataFrame:
    """df as a table in the shared folder, bucketed by keys, so that joins on them leave it where it is.

    The number of buckets grows with n_bytes (of df), so a bucket stays about as large at any size; Spark allows 100,000.
    grouped: df is grouped by keys, so that its own last shuffle deals the rows. The catalog only knows the table while it is
    made: what reads it needs the files alone.
    """
    spark, name = df.sparkSession, f"loomkit_{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    buckets = min(100_000, max(int(before), -(-n_bytes // bucket_bytes)))
    table = df if grouped else df.repartition(buckets, *keys)
    spark.conf.set("spark.sql.shuffle.partitions", str(buckets))
    try:
        written(spark, lambda: table.write.bucketBy(buckets, *keys).option("compression", "zstd").option("path", new_path(spark, "dealt")).saveAsTable(name))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables made by cut() that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            delete(df.sparkSession, folder)
