"""Joins beyond equality: as-of and by ranges, with broadcasts only behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and bytes (as text) of a side that may be broadcast.
SMALL, SMALL_BYTES = 50_000, 32 << 20


def if_small(df: DataFrame, most: int = SMALL, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows and most_bytes bytes; measuring stops after that many rows."""
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")), F.lit(0))
    n, n_bytes = df.limit(most + 1).agg(F.count(F.lit(1)), size).head()
    return F.broadcast(df) if n <= most and n_bytes <= most_bytes else df


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], value: str, name: str, slices: bool = False) -> DataFrame:
    """left with the value of the last row of right at or before it (by `on`), within equal `by`.

    Both sides are put into one table and a window carries the last value on: one shuffle and no row pairs. With slices,
    time is cut into days and each starts from the last value before it, so that a key that holds much of the data is
    spread over tasks, for two more shuffles. Of rows of right at one time the greatest value counts.
    """
    none = F.lit(None).cast(right.schema[value].dataType)
    l = left.withColumns({"_v": F.struct(F.lit(False).alias("has"), none.alias("v")), "_side": F.lit(1)})
    r = right.groupBy(*by, on).agg(F.max(value).alias("_m")).select(*by, on, F.struct(F.lit(True).alias("has"), F.col("_m").alias("v")).alias("_v"), F.lit(0).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    found = lambda w: F.last(F.when(F.col("_v.has"), F.col("_v")), ignorenulls=True).over(w)
    if not slices:
        out = both.withColumn("_found", found(Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        both = both.withColumn("_slice", F.date_trunc("day", F.col(on)))
        last = both.where("_v.has").groupBy(*by, "_slice").agg(F.max_by("_v", on).alias("_last"))
        slices = both.select(*by, "_slice").distinct().join(last, [*by, "_slice"], "left")
        before = slices.withColumn("_before", F.last("_last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
        inner = Window.partitionBy(*by, "_slice").orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("_found", found(inner)).join(before, [*by, "_slice"]).withColumn("_found", F.coalesce("_found", "_before"))
    return out.where("_side = 1").select(*left.columns, F.col("_found.v").alias(name))


def ranges(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """points and the spans [low, high) that hold them: an equality of buckets, then the exact test.

    Buckets are of `width`, twice that, four times that, and so on; a span stands in those of the first width that is as long
    as it, three at most, however long it is. A point looks in one bucket of each width that any span uses (they are counted
    first: one for each doubling of the length). width should be near the shortest usual span.
    """
    held = spans.where(F.col(low) < F.col(high)).withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2((F.col(high) - F.col(low)) / width))).cast("int"))
    levels = [r[0] for r in held.select("_level").distinct().collect()]  # under 2,100 even for doubles
    bucket = lambda c: F.floor(c / (width * F.pow(F.lit(2.0), F.col("_level"))))
    p = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_b", bucket(F.col(at)))
    s = held.withColumn("_b", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    return p.join(s, ["_level", "_b"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_level", "_b")
