"""Window frames that Spark's grammar lacks: EXCLUDE, GROUPS, and DISTINCT or FILTER inside a window.

sum, count and avg over a frame without the current row, its peers or its other peers are sums over the parts of the frame
before and after these: plain window sums, which spill and need no arrays. Nothing is subtracted, so infinities, NaN and
numbers of very different size come out right. Any other aggregate folds the frame's list of (row, key, value).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.errors import InvalidArgument

EXCLUDE = ("no others", "current row", "group", "ties")


def excluding(df: DataFrame, keys: list[str], order: list[str], x: str, how: str, start: int, end: int, name: str, agg: str = "sum") -> DataFrame:
    """df with agg (sum, count or avg) of x over a frame without the rows that EXCLUDE names.

    "no others" and "current row" take ROWS from start to end; "group" and "ties" take RANGE frames over one order column. If
    that one is of an integer type, both parts of the frame are plain windows; else the frame's values are listed once, and
    memory grows with the frame. Ties in a ROWS order are the caller's to break. For groups and ties in ROWS frames there is
    fold_excluding.
    """
    if how not in EXCLUDE or agg not in ("sum", "count", "avg"):
        raise InvalidArgument(f"unknown exclusion {how!r} or aggregate {agg!r}")
    base, ranged = Window.partitionBy(*keys).orderBy(*order), how in ("group", "ties")
    between = base.rangeBetween if ranged else base.rowsBetween
    own = [] if how in ("no others", "group") or not start <= 0 <= end or how == "current row" else [(F.col(x), F.col(x).isNotNull().cast("long"))]
    if how == "no others" or not start <= 0 <= end:
        parts = [(F.sum(x).over(between(start, end)), F.count(x).over(between(start, end)))]
    elif ranged and not isinstance(df.schema[order[0]].dataType, T.IntegralType):
        bound = lambda d: f"{abs(d)!r}{'D' * isinstance(d, float)} {'PRECEDING' if d < 0 else 'FOLLOWING'}"
        named = lambda c: "`" + c.replace("`", "``") + "`"
        frame = f"PARTITION BY {', '.join(map(named, keys))} ORDER BY {named(order[0])} RANGE BETWEEN {bound(start)} AND {bound(end)}"
        listed = F.expr(f"collect_list(struct({named(order[0])} AS k, {named(x)} AS v)) OVER ({frame})")  # the Column API takes whole numbers only
        others = F.transform(F.filter(listed, lambda e: ~e["k"].eqNullSafe(F.col(order[0])) & e["v"].isNotNull()), lambda e: e["v"])
        parts = [(F.aggregate(others, F.lit(0).cast(df.schema[x].dataType), lambda a, v: (a + v).cast(df.schema[x].dataType)), F.size(others).cast("long"))]
    else:
        frames = [between(start, -1)] * (start < 0) + [between(1, end)] * (end > 0)
        parts = [(F.sum(x).over(w), F.count(x).over(w)) for w in frames]
    parts += own
    n = reduce(add, (p for _, p in parts), F.lit(0).cast("long"))
    sums = [F.coalesce(p, F.lit(0)) for p, _ in parts]
    s = reduce(add, sums) if sums else F.lit(None).cast(df.schema[x].dataType)
    return df.withColumn(name, {"count": n, "sum": F.when(n > 0, s), "avg": F.when(n > 0, s / n)}[agg])


def fold_excluding(df: DataFrame, keys: list[str], order: str, tie: str, x: str, how: str, start: int, end: int, finish: Callable[[Column], Column], name: str) -> DataFrame:
    """df with finish(array of the frame's values) over ROWS start to end, ordered by (order, tie), without what EXCLUDE names.

    Any aggregate, NULLs skipped; memory grows with the frame.
    """
    w = Window.partitionBy(*keys).orderBy(order, tie)
    df = df.withColumn("_row", F.row_number().over(w))
    listed = F.collect_list(F.struct("_row", F.col(order).alias("_key"), F.col(x).alias("_x"))).over(w.rowsBetween(start, end))
    keep = {
        "no others": lambda e: F.lit(True),
        "current row": lambda e: e["_row"] != F.col("_row"),
        "group": lambda e: ~e["_key"].eqNullSafe(F.col(order)),
        "ties": lambda e: (e["_row"] == F.col("_row")) | ~e["_key"].eqNullSafe(F.col(order)),
    }[how]
    values = F.transform(F.filter(F.col("_frame"), lambda e: keep(e) & e["_x"].isNotNull()), lambda e: e["_x"])
    return df.withColumn("_frame", listed).withColumn(name, finish(values)).drop("_frame", "_row")


def groups_frame(df: DataFrame, keys: list[str], order: str, agg: Column, start: int, end: int, name: str) -> DataFrame:
    """df with agg over GROUPS start to end: peer groups are numbered, and the frame is a range of their numbers."""
    df = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)))
    return df.withColumn(name, agg.over(Window.partitionBy(*keys).orderBy("_group").rangeBetween(start, end))).drop("_group")


def distinct_over(x: Column, window, finish: Callable[[Column], Column]) -> Column:
    """finish(array of the distinct values in the frame); memory grows with them."""
    return finish(F.collect_set(x).over(window))


def filtered_over(agg: Callable[[Column], Column], x: Column, where: Column, window) -> Column:
    return agg(F.when(where, x)).over(window)


def sum_of(values: Column) -> Column:
    """A finish: the sum of an array; null if it is empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v))
