"""Logical types of modules as Spark types, and the few values that need a rule of their own."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.errors import InvalidArgument, Unsupported

#: Names that modules declare and the Spark types that hold them (unsigned ones are widened).
PLAIN = {
    "boolean": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType(),
    "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "date": T.DateType(), "time": T.LongType(),
    "uuid": T.StringType(), "hugeint": T.DecimalType(38, 0), "uhugeint": T.DecimalType(38, 0), "decimal": T.DecimalType(18, 3),
    "interval": T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())]),
}
#: SQL spellings of the same.
SPELLED = {
    "bool": "boolean", "tinyint": "int8", "smallint": "int16", "int": "int32", "integer": "int32", "bigint": "int64", "utinyint": "uint8",
    "usmallint": "uint16", "uinteger": "uint32", "ubigint": "uint64", "float": "float32", "real": "float32", "double": "float64",
    "varchar": "text", "string": "text", "bytea": "blob", "binary": "blob", "numeric": "decimal", "timestamp with time zone": "timestamptz",
}
UNSIGNED = {"uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64, "uhugeint": 126}


def spark_type(name: str, aliases: dict[str, str] | None = None) -> T.DataType:
    """The Spark type of a declared one: plain names, T[], T[n], STRUCT(a T, ...), MAP(K, V), DECIMAL(w, s), aliases."""
    text = name.strip()
    lower = text.lower()
    if aliases and lower in aliases:
        return spark_type(aliases[lower], aliases)
    lower = SPELLED.get(lower, lower)
    if lower in PLAIN:
        return PLAIN[lower]
    if found := re.fullmatch(r"(.*)\[\d*\]", text, re.S):
        return T.ArrayType(spark_type(found[1], aliases), True)
    if found := re.fullmatch(r"(?i)(?:decimal|numeric)\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)", text):
        return T.DecimalType(int(found[1]), int(found[2]))
    if found := re.fullmatch(r"(?i)list\s*\((.*)\)", text, re.S):
        return T.ArrayType(spark_type(found[1], aliases), True)
    if found := re.fullmatch(r"(?i)map\s*\((.*)\)", text, re.S):
        parts = parted(found[1])
        if len(parts) != 2:
            raise InvalidArgument(f"a map has two types: {name}")
        return T.MapType(*(spark_type(p, aliases) for p in parts), True)
    if found := re.fullmatch(r"(?i)struct\s*\((.*)\)", text, re.S):
        fields = [p.strip().partition(" ") for p in parted(found[1])]
        return T.StructType([T.StructField(n.strip('"'), spark_type(t, aliases), True) for n, _, t in fields])
    raise Unsupported(f"no such type: {name}")


def parted(text: str) -> list[str]:
    """text cut at the commas outside parentheses."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def fixed_length(c: Column, n: int) -> Column:
    """An array column that must have n items; another length is an error."""
    return F.when(c.isNull() | (F.size(c) == n), c).otherwise(F.raise_error(F.format_string(f"an array of %d items where {n} are declared", F.size(c))))


def in_range(c: Column, name: str) -> Column:
    """An unsigned value, checked: below 0 or over the type's greatest is an error."""
    most = (1 << UNSIGNED[name]) - 1
    wide = c.cast("decimal(38,0)")
    ok = c.isNull() | wide.between(F.lit(0).cast("decimal(38,0)"), F.lit(str(most)).cast("decimal(38,0)"))
    return F.when(ok, c).otherwise(F.raise_error(F.concat(F.lit(f"out of the range of {name}: "), c.cast("string"))))


def enum_ordinal(c: Column, members: list[str]) -> Column:
    """The place of an enum's value among its members, from 0, by which it is ordered; an unknown value is an error."""
    place = F.array_position(F.array(*map(F.lit, members)), c)
    return F.when(c.isNull(), None).when(place > 0, (place - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a member of the enum: "), c)))


def uuid_halves(value: str) -> tuple[int, int]:
    n = uuid.UUID(value).int
    return n >> 64, n & (1 << 64) - 1


def uuid_text(high: int, low: int) -> str:
    return str(uuid.UUID(int=(high << 64) | low))


def interval(months: Column, days: Column, micros: Column) -> Column:
    return F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), micros.cast("long").alias("micros"))


def cast_to(c: Column, name: str, aliases: dict[str, str] | None = None) -> Column:
    return c.cast(spark_type(name, aliases))
