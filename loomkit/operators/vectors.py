"""Vector search and value indexes over tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.errors import InvalidArgument, InvalidState


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: (u * v).cast("double")), F.lit(0.0), lambda s, d: s + d)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Vectors of a block of rows and of a block of queries.
ROWS, QUERIES = 4096, 512


def nearest(ids: list, rows: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[list, np.ndarray]]:
    """For each query the ids and L2 distances of the k closest rows, ties by id."""
    near = (rows * rows).sum(1)[None, :] - 2 * queries @ rows.T
    found = []
    for q, d in zip(queries, near):
        size = float(np.abs(d).max()) + float(q @ q)
        most = np.partition(d, k - 1)[k - 1] if k < len(d) else np.inf
        some = np.flatnonzero(d <= most + 1e-9 * (1 + size))  # all that rounding may have put behind
        exact = np.sqrt(((rows[some] - q) ** 2).sum(1))
        best = sorted(zip(exact.tolist(), (ids[i] for i in some)))[:k]
        found.append(([i for _, i in best], np.array([x for x, _ in best])))
    return found


class VectorIndex:
    """create, append, delete, build, search, drop over a table of (id, vector); exact, closest first, ties by id.

    search is a scan with a top-k in each task; only k rows of each task meet. search_all takes a table of queries.
    """

    def __init__(self, df: DataFrame, id_col: str, vector_col: str, dims: int):
        self.df, self.id_col, self.vector_col, self.dims, self.built = df.select(id_col, vector_col), id_col, vector_col, dims, False

    def append(self, df: DataFrame) -> None:
        self.df, self.built = self.df.unionByName(df.select(self.id_col, self.vector_col)), False

    def delete(self, ids: DataFrame) -> None:
        """Leaves out the rows whose id is in ids (a column of the id's name)."""
        self.df = self.df.join(ids.select(self.id_col).distinct(), self.id_col, "left_anti")

    def drop(self) -> None:
        """Empties the index; build() is needed before it is searched again."""
        self.df, self.built = self.df.limit(0), False

    def build(self) -> VectorIndex:
        if self.df.where(F.size(self.vector_col) != self.dims).limit(1).count():
            raise InvalidArgument(f"a vector doesn't have {self.dims} numbers")
        self.built = True
        return self

    def search(self, query: list[float], k: int, distance=l2) -> DataFrame:
        if not self.built:
            raise InvalidState("build() comes first")
        if len(query) != self.dims:
            raise InvalidArgument(f"the query has {len(query)} numbers where {self.dims} are declared")
        q = F.array(*(F.lit(float(x)) for x in query))
        d = distance(F.transform(self.vector_col, lambda x: x.cast("double")), q)
        return self.df.where(F.col(self.vector_col).isNotNull()).select(self.id_col, d.alias("distance")).orderBy("distance", self.id_col).limit(k)


    def search_all(self, queries: DataFrame, query_id: str, k: int) -> DataFrame:
        """query_id, id_col and distance (L2) of the k closest rows of each row of queries (query_id, vector).

        Blocks of queries meet blocks of rows; each pair of blocks keeps k rows a query, which are merged by query id.
        Rows and queries without a vector are left out.
        """
        if not self.built:
            raise InvalidState("build() comes first")
        if queries.where(F.size(self.vector_col) != self.dims).limit(1).count():
            raise InvalidArgument(f"a query doesn't have {self.dims} numbers")
        ids, dims = (queries.schema[query_id].dataType, self.df.schema[self.id_col].dataType), self.dims

        def blocks(df: DataFrame, id_col: str, size: int, names: list[str], kind: T.DataType) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for at in range(0, batch.num_rows, size):
                        part = batch.slice(at, size)
                        data = np.array(part.column(1).to_pylist(), np.float64).tobytes()
                        own = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                        yield pa.RecordBatch.from_arrays([own, pa.array([data], pa.binary())], names=names)

            schema = T.StructType([T.StructField(names[0], T.ArrayType(kind)), T.StructField(names[1], T.BinaryType())])
            return df.where(F.col(self.vector_col).isNotNull()).select(id_col, self.vector_col).mapInArrow(run, schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for qs, qv, rs, rv in zip(*(c.to_pylist() for c in batch.columns)):
                    q, r = (np.frombuffer(x, np.float64).reshape(-1, dims) for x in (qv, rv))
                    found = nearest(rs, r, q, k)
                    own = [i for i, (near, _) in zip(qs, found) for _ in near]
                    near = [i for f, _ in found for i in f]
                    yield pa.RecordBatch.from_arrays([pa.array(own, batch.column(0).type.value_type), pa.array(near, batch.column(2).type.value_type), pa.array(np.concatenate([d for _, d in found]), pa.float64())], names=["_query", "_near", "distance"])

        both = blocks(queries, query_id, QUERIES, ["_q", "_qv"], ids[0]).crossJoin(blocks(self.df, self.id_col, ROWS, ["_r", "_rv"], ids[1]))
        schema = T.StructType([T.StructField("_query", ids[0]), T.StructField("_near", ids[1]), T.StructField("distance", T.DoubleType())])
        place = F.row_number().over(Window.partitionBy("_query").orderBy("distance", "_near"))
        merged = both.mapInArrow(run, schema).withColumn("_place", place).where(F.col("_place") <= k)
        return merged.select(F.col("_query").alias(query_id), F.col("_near").alias(self.id_col), "distance")


def range_scan(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows from low to high, both included: a pushed filter, by which Parquet skips row groups."""
    return df.where(F.col(column).between(low, high))


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values that stand more than once, with their counts; none if the column is unique."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def natural_key(c: Column) -> Column:
    """A sort key by which digits order as numbers and letters without case."""
    padded = F.transform(F.split(F.lower(c), r"(?<=\D)(?=\d)|(?<=\d)(?=\D)"), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, F.lit("0"))).otherwise(p))
    return F.array_join(padded, "")


#: Keys drawn for each range of numbered().
DRAWN = 100


def numbered(df: DataFrame, key: Column, name: str, parts: int = 64) -> DataFrame:
    """df with each row's place (from 1) in the order of key: ranges of keys are numbered by tasks of their own.

    What precedes a range is a sum over `parts` counts, which are broadcast. Equal keys are one range; their order is open.
    Ranges end at keys drawn here once, so that counts and places have the same ones: Spark draws those of a
    repartitionByRange anew for each plan that reads it. Which keys are drawn says only how even the ranges are.
    """
    keyed = df.withColumn("_order", key)
    keys = keyed.select("_order").where(F.col("_order").isNotNull())
    drawn = keys.sample(min(1.0, DRAWN * parts / max(1, keys.count())), 1).orderBy("_order").collect()  # DRAWN * parts keys or so
    ends = F.array(*(F.lit(drawn[len(drawn) * i // parts][0]) for i in range(1, parts) if drawn)).cast(T.ArrayType(keyed.schema["_order"].dataType))
    place = F.transform(F.array("_order"), lambda k: F.size(F.filter(ends, lambda e: e <= k)))  # the key is made once a row, not for each end
    cut = keyed.withColumn("_part", place[0])
    counts = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_order"))
    return cut.join(F.broadcast(before), "_part").withColumn(name, own + F.col("_before")).drop("_order", "_part", "_before")


def kmeans(df: DataFrame, id_col: str, vector_col: str, k: int, seed: int = 1, rounds: int = 20) -> DataFrame:
    """id_col and cluster (from 0), by Spark's own k-means; rows without a vector have none and are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector_col).isNotNull()).select(id_col, array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds).fit(rows)
    return model.transform(rows).select(id_col, F.col("prediction").alias("cluster"))
