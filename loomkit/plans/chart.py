"""Chart specifications from tables: Vega-Lite JSON, for a whole table or one for each facet."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.errors import InvalidArgument

#: Marks of a chart, and the schema that a specification names (fixed values).
MARKS = ("bar", "line", "point", "area", "tick", "circle", "square", "rect")
SCHEMA = "https://vega.github.io/schema/vega-lite/v5.json"


def kind_of(kind: T.DataType) -> str:
    """How a column is measured: numbers by quantity, dates and times by time, the rest by name."""
    return "quantitative" if isinstance(kind, T.NumericType) else "temporal" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "nominal"


def _spec(df: DataFrame, mark: str, channels: dict[str, str]) -> Column:
    """The specification of a group's rows, which it holds: for results of a size to be drawn."""
    if mark not in MARKS:
        raise InvalidArgument(f"unknown mark {mark!r}")
    if missing := [c for c in channels.values() if c not in df.columns]:
        raise InvalidArgument(f"no column {missing[0]!r}")
    encoding = {channel: {"field": c, "type": kind_of(df.schema[c].dataType)} for channel, c in channels.items()}
    head, tail = json.dumps({"$schema": SCHEMA, "mark": mark, "encoding": encoding})[:-1], "}}"
    used = list(dict.fromkeys(channels.values()))
    values = F.to_json(F.array_sort(F.collect_list(F.struct(*used))))
    return F.concat(F.lit(head + ', "data": {"values": '), values, F.lit(tail))


def vegalite(df: DataFrame, mark: str, **channels: str) -> DataFrame:
    """One row, spec: the chart of df's rows; channels (x, y, color, size, ...) name columns."""
    return df.agg(_spec(df, mark, channels).alias("spec"))


def vegalite_grid(df: DataFrame, facet: str, mark: str, **channels: str) -> DataFrame:
    """facet and spec: a chart for each value of a column."""
    return df.groupBy(facet).agg(_spec(df, mark, channels).alias("spec"))
