"""Custom aggregates that take DISTINCT, FILTER, GROUP BY, CUBE and OVER like built-in ones.

Where an aggregate is a formula of built-in ones it is written as that, so Spark combines partial results before the
shuffle; exact percentiles of large groups are found in steps. Where it isn't, it folds the list of a group's values; a group must then fit into a task, as the docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: States that a task of an incremental aggregate holds before it sends them on.
STATES = 100_000


def over(c: Column, window) -> Column:
    return c if window is None else c.over(window)


def chosen(x: Column, where: Column | None) -> Column:
    """x where the filter holds, else null: FILTER for aggregates and windows alike."""
    return x if where is None else F.when(where, x)


def sample_sum(x: Column, where: Column | None = None, distinct: bool = False, window=None) -> Column:
    """The sum of the values that aren't null; 0 if there are none."""
    x = chosen(x, where)
    return F.coalesce(over(F.sum_distinct(x) if distinct else F.sum(x), window), F.lit(0))


def harmonic_mean(x: Column, where: Column | None = None, distinct: bool = False, window=None) -> Column:
    """n / sum(1 / x) of the values that aren't null; null if there are none."""
    x = chosen(x.cast("double"), where)
    inverse = F.lit(1.0) / F.nullif(x, F.lit(0.0))
    if distinct:
        return over(F.count_distinct(x), window) / over(F.sum_distinct(inverse), window)
    return over(F.count(x), window) / over(F.sum(inverse), window)


def fold(x: Column, finish: Callable[[Column], Column], where: Column | None = None, distinct: bool = False, order: Column | None = None, window=None) -> Column:
    """finish(array of the group's values that aren't null), in the order given, else in no order.

    The array holds the whole group. A window's DISTINCT and FILTER work as well.
    """
    x = chosen(x, where)
    if order is not None:
        pairs = F.array_sort(over(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("k"), x.alias("v")))), window))
        values = F.transform(pairs, lambda p: p["v"])
        return finish(F.array_distinct(values) if distinct else values)
    values = over(F.collect_list(x), window)
    return finish(F.array_distinct(values) if distinct else values)


def median_of(values: Column) -> Column:
    """A finish: the median of an array."""
    ranked, n = F.array_sort(values), F.size(values)
    at = lambda i: F.get(ranked, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0)


#: Share of a group's values on each side of a percentile that are looked through for it.
NEAR = 0.001


def percentiles(df: DataFrame, keys: list[str], x: Column, at: dict[str, float], also: list[Column] = (), how: str = "groupBy") -> DataFrame:
    """keys, the aggregates `also`, and for each name in `at` that percentile of x, exact (as Spark's percentile gives it).

    how is groupBy, rollup or cube. Spark's own percentile brings all values of a group to one task. Here approximate
    percentiles part a group's values, the parts are counted, and the values of those that hold a rank looked for (about
    2 NEAR of them all) are ranked. A bad approximation makes parts larger, never results other. df is read three times;
    groups are broadcast, so for very many small ones take Spark's own.
    """
    n_keys = len(keys)
    sets = {"groupBy": [(1 << n_keys) - 1], "rollup": [((1 << i) - 1) << (n_keys - i) for i in range(n_keys + 1)], "cube": range(1 << n_keys)}[how]
    rows = df.withColumn("_x", x.cast("double"))
    ends = sorted({min(1.0, max(0.0, p + d)) for p in at.values() for d in (-NEAR, NEAR)})
    own_set = F.lit(0) if how == "groupBy" else F.grouping_id()
    groups = getattr(rows, how)(*keys).agg(own_set.cast("long").alias("_set"), *also, F.count("_x").alias("_n"), F.percentile_approx("_x", ends, int(2 / NEAR)).alias("_ends"))

    held = lambda kept: [F.when(F.lit(bool(kept >> (n_keys - 1 - i) & 1)), F.col(k)).alias(k) for i, k in enumerate(keys)]
    each = F.explode(F.array(*(F.struct(F.lit((1 << n_keys) - 1 - kept).cast("long").alias("_set"), *held(kept)) for kept in sets))).alias("_g")
    place = ["_set", *keys]

    def met(left: DataFrame, right: DataFrame, on: list[str], kind: str = "inner") -> DataFrame:
        right = right.select(*(F.col(c).alias(f"_r_{c}") if c in on else c for c in right.columns))
        same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]  # keys may be null
        return left.join(F.broadcast(right), same, kind).drop(*(f"_r_{c}" for c in on))

    spread = rows.where(F.col("_x").isNotNull()).select(each, "_x").select("_g.*", "_x")
    number = reduce(lambda a, b: a + b, ((F.get("_ends", F.lit(i)) < F.col("_x")).cast("int") + (F.get("_ends", F.lit(i)) <= F.col("_x")).cast("int") for i in range(len(ends))))
    parted = met(spread, groups.select(*place, "_n", "_ends"), place).withColumn("_part", number)
    counts = parted.groupBy(*place, "_part").agg(F.count(F.lit(1)).alias("_size"), F.first("_n").alias("_n"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*place).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in at.items()}
    holds = reduce(lambda a, b: a | b, ((F.col("_before") <= F.ceil(r)) & (F.floor(r) < F.col("_before") + F.col("_size")) for r in rank.values()))
    looked = counts.withColumn("_before", before).where(holds).select(*place, "_part", "_before")
    values = met(parted, looked, [*place, "_part"]).groupBy(*place, "_part", "_x").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"), F.first("_before").alias("_before"))
    values = values.withColumn("_end", F.col("_before") + F.sum("_c").over(Window.partitionBy(*place, "_part").orderBy("_x")))
    value = lambda r: F.max(F.when((F.col("_end") - F.col("_c") <= r) & (r < F.col("_end")), F.col("_x")))
    found = values.groupBy(*place).agg(*(F.struct(value(F.floor(r)).alias("a"), value(F.ceil(r)).alias("b")).alias(name) for name, r in rank.items()))
    joined = met(groups, found, place, "left")
    done = []
    for name, r in rank.items():
        a, b = F.col(name)["a"], F.col(name)["b"]
        done.append(F.when(a == b, a).otherwise((F.ceil(r) - r) * a + (r - F.floor(r)) * b).alias(name))
    return joined.select(*(c for c in groups.columns if c not in ("_set", "_n", "_ends")), *done)


def ordered_concat(x: Column, order: Column, separator: str = ",", **modifiers) -> Column:
    return fold(x.cast("string"), lambda v: F.array_join(v, separator), order=order, **modifiers)


def ema(x: Column, order: Column, alpha: float, **modifiers) -> Column:
    """Exponential moving average over a group or frame, in order, from its first value on."""
    step = lambda a, v: F.when(a.isNull(), v).otherwise(alpha * v + (1 - alpha) * a)
    return fold(x.cast("double"), lambda v: F.aggregate(v, F.lit(None).cast("double"), step), order=order, **modifiers)


def rsi(x: Column, order: Column, **modifiers) -> Column:
    """100 gains / (gains + losses) of the steps of a group or frame, in order; null without a step, 50 if nothing moves."""

    def finish(v: Column) -> Column:
        steps = F.zip_with(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), lambda b, a: b - a)
        total = lambda sign: F.aggregate(steps, F.lit(0.0), lambda a, d: a + F.greatest(sign * d, F.lit(0.0)))
        up, down = total(1), total(-1)
        return F.when(F.size(v) < 2, None).when(up + down == 0, 50.0).otherwise(100.0 * up / (up + down))

    return fold(x.cast("double"), finish, order=order, **modifiers)


#: Bits of one bitmap of a Bloom filter, which Spark's bitmap aggregate fixes, and the bitmaps (each with a hash of its own).
BITMAP, BLOOM_HASHES = 1 << 15, 4


def _places(x: Column, parts: int) -> list[Column]:
    """For each hash the place of x among the bits of its bitmaps."""
    return [F.pmod(F.xxhash64(F.lit(k), x), F.lit(parts * BITMAP)).cast("long") for k in range(BLOOM_HASHES)]


def bloom_filter(x: Column, parts: int = 1, where: Column | None = None) -> Column:
    """A Bloom filter of a group's values, as binary: BLOOM_HASHES times `parts` bitmaps of BITMAP bits.

    Each is built by Spark's own bitmap aggregate, so partial results are bitmaps too: 4 KB each, whatever the group's
    size, combined before the shuffle. About 3,000 values a part keep false positives under 0.01 %; 20,000 under 5 %.
    """
    x = chosen(x.cast("string"), where)
    bitmaps = []
    for place in _places(x, parts):
        for k in range(parts):
            bit = F.pmod(place, F.lit(BITMAP))
            bitmaps.append(F.bitmap_construct_agg(F.when(x.isNotNull() & (F.floor(place / BITMAP) == k), bit)))
    return F.concat(*bitmaps)


def bloom_contains(bloom: Column, x: Column, parts: int = 1) -> Column:
    """False if x was surely not added; null if either is null."""
    x, found = x.cast("string"), F.lit(True)
    for k, place in enumerate(_places(x, parts)):
        at = place + k * parts * BITMAP
        byte = F.conv(F.hex(F.substr(bloom, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found = found & (F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1)
    return F.when(bloom.isNotNull() & x.isNotNull(), found)


def xor_filter(x: Column, where: Column | None = None) -> Column:
    """A sorted list of 32-bit fingerprints with the promises of a xor filter: no false negatives, few false positives.

    It takes 4 bytes a distinct value and holds them in one row: for groups that fit there. For others, bloom_filter.
    """
    x = chosen(x.cast("string"), where)
    return F.array_sort(F.collect_set(F.when(x.isNotNull(), F.hash(x))))


def xor_filter_contains(held: Column, x: Column) -> Column:
    return F.when(x.isNotNull(), F.array_contains(held, F.hash(x.cast("string"))))


def incremental(df: DataFrame, keys: list[str], columns: list[str], state: str, init: Callable[[], tuple], update: Callable[[tuple, tuple], tuple], combine: Callable[[tuple, tuple], tuple], finish: Callable[[tuple], object], name: str, returns: str) -> DataFrame:
    """keys and name: an aggregate of a module's own by its four steps, in two stages as Spark's own do.

    Each task makes states from init and update for the keys that it sees, STATES at a time, and sends one row for a key and
    turn; these are combined and finished by key. state is the DDL of a state's fields. No stage holds a group: the first
    one holds states, the second one combines them row by row. Rows are tuples of columns, in no order; so combine must not
    depend on it.
    """
    fields = T._parse_datatype_string(state).fields if isinstance(state, str) else state.fields
    held_schema = T.StructType([*(df.schema[k] for k in keys), *fields])
    out_schema = T.StructType([*(df.schema[k] for k in keys), T.StructField(name, T._parse_datatype_string(returns))])
    from pyspark.sql.pandas.types import to_arrow_schema

    def batch(states: dict, schema) -> pa.RecordBatch:
        rows = [(*key, *s) for key, s in states.items()]
        columns_ = list(zip(*rows)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns_, schema)], schema=schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, schema = {}, to_arrow_schema(held_schema)
        for b in batches:
            values = [c.to_pylist() for c in b.columns]
            for row in zip(*values):
                key = row[: len(keys)]
                states[key] = update(states[key] if key in states else init(), row[len(keys) :])
            if len(states) >= STATES:
                yield batch(states, schema)
                states = {}
        yield batch(states, schema)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, held = to_arrow_schema(out_schema), None, None
        for b in batches:  # sorted by key
            done = {}
            for row in zip(*(c.to_pylist() for c in b.columns)):
                key, own = row[: len(keys)], row[len(keys) :]
                if held is not None and key == now:
                    held = combine(held, own)
                    continue
                if held is not None:
                    done[now] = (finish(held),)
                now, held = key, own
            yield batch(done, schema)
        if held is not None:
            yield batch({now: (finish(held),)}, schema)

    made = df.select(*keys, *columns).mapInArrow(first, held_schema)
    return made.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(last, out_schema)
