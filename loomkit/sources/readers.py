"""Sources written in Python: a filterable sequence, Arrow producers, web archives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNull, LessThan, LessThanOrEqual, Not

from loomkit.errors import InvalidArgument


class Span(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SequenceReader(DataSourceReader):
    """Numbers under a limit; predicates on value narrow what is made.

    =, <, <=, > and >= narrow the range and <> and IN the numbers in it; IS NULL leaves none and IS NOT NULL all, as no value is
    null. All are checked again above the scan.
    """

    def __init__(self, options: dict):
        self.low, self.high, self.parts = 0, int(options.get("limit", 0)), int(options.get("partitions", 4))
        self.only: set[int] | None = None
        self.never: set[int] = set()
        if self.high < 0:
            raise InvalidArgument("the limit is negative")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, Not) and isinstance(f.child, EqualTo) and f.child.attribute == ("value",) and isinstance(f.child.value, int):
                self.never.add(f.child.value)
            if getattr(f, "attribute", None) != ("value",):
                pass
            elif isinstance(f, In):
                here = {v for v in f.value if isinstance(v, int)}
                self.only = here if self.only is None else self.only & here
                self.low, self.high = max(self.low, min(here, default=0)), min(self.high, max(here, default=-1) + 1)
            elif isinstance(f, IsNull):
                self.high = self.low
            elif isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.high = min(self.high, f.value + 1)
                if isinstance(f, LessThan):
                    self.high = min(self.high, f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        step = max(1, -(-max(0, self.high - self.low) // self.parts))
        return [Span(a, min(a + step, self.high)) for a in range(self.low, self.high, step)] or [Span(0, 0)]

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        for a in range(part.low, part.high, 65536):
            made = range(a, min(a + 65536, part.high))
            if self.only is not None:
                made = sorted(v for v in self.only if v in made)
            yield pa.record_batch([pa.array([v for v in made if v not in self.never] if self.never else made, pa.int64())], names=["value"])


class SequenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loom_sequence"

    def schema(self) -> str:
        return "value bigint"

    def reader(self, schema) -> DataSourceReader:
        return SequenceReader(self.options)


def sequence(spark: SparkSession, limit: int, partitions: int = 4) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SequenceSource)
    return spark.read.format("loom_sequence").option("limit", limit).option("partitions", partitions).load()


@F.udtf(returnType=T.StructType([T.StructField("value", T.LongType())]))
class EmitSequence:
    """Rows 0 to limit - 1; none for 0, an error for less."""

    def eval(self, limit: int):
        if limit is None:
            return
        if limit < 0:
            raise InvalidArgument("the limit is negative")
        for i in range(limit):
            yield (i,)


def produced(spark: SparkSession, schema: str, parts: int, produce: Callable[[int], Iterator[pa.RecordBatch]]) -> DataFrame:
    """A table whose parts are made by tasks: produce(k) gives part k's batches, an end of them ends the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from produce(k)

    return spark.range(0, parts, 1, parts).mapInArrow(run, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of web archive files: type, address, date, and content. A file goes to one task; records are split there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(0).to_pylist():
                at = data.find(b"WARC/")
                while at >= 0:
                    end = data.find(b"\r\n\r\n", at)
                    if end < 0:
                        break
                    heads = dict(line.split(b":", 1) for line in data[at:end].split(b"\r\n")[1:] if b":" in line)
                    get = lambda k: heads.get(k, b"").strip().decode("utf-8", "replace") or None
                    size = int(heads.get(b"Content-Length", b"0"))
                    rows.append((get(b"WARC-Type"), get(b"WARC-Target-URI"), get(b"WARC-Date"), data[end + 4 : end + 4 + size]))
                    at = data.find(b"WARC/", end + 4 + size)
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.binary()))], names=["type", "uri", "date", "content"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "type string, uri string, date string, content binary")
