"""The workbench, types, frames, catalog and sources."""

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit import errors
from loomkit.operators import aggregates as A
from loomkit.operators import frames, joins, vectors
from loomkit.plans import catalog, search
from loomkit.registry import Module, Workbench, preloads
from loomkit.sources import copy, readers
from loomkit.suite import small_catalog
from loomkit.types import fixed_length, in_range, spark_type, uuid_halves, uuid_text


class Twice(Module):
    name, version, contract = "twice", "1.2.0", "pkg@4.1.0"

    def load(self, bench):
        bench.scalar("loom_twice", "x * 2", {"x": "BIGINT"}, "BIGINT")
        bench.aggregate("hm", A.harmonic_mean)


def test_load_registers_once(spark):
    bench = Workbench(spark)
    assert bench.load(Twice()).head().registered == 2
    assert bench.load(Twice()).head().registered == 2
    assert [r.v for r in spark.sql("SELECT loom_twice(x) AS v FROM VALUES (1L), (NULL), (3L) AS t(x)").collect()] == [2, None, 6]
    assert sorted(bench.records) == [1, 2]
    bench.forget("twice")
    bench.column("next", lambda x: x)
    assert sorted(bench.records) == [3]


def test_contract_and_requirements(spark):
    bench = Workbench(spark)
    late = type("Late", (Module,), {"name": "late", "contract": "pkg@4.9.0"})
    needy = type("Needy", (Module,), {"name": "needy", "requires": ("other",)})
    with pytest.raises(errors.Unsupported):
        bench.load(late())
    with pytest.raises(errors.InvalidState):
        bench.load(needy())


def test_python_function_skips_nulls(spark):
    bench = Workbench(spark)
    bench.python("loom_len", lambda s: s.str.len(), "INTEGER")
    assert [r[0] for r in spark.sql("SELECT loom_len(x) FROM VALUES ('ab'), (NULL), ('') AS t(x)").collect()] == [2, None, 0]


def test_aliases_keep_modifiers(spark):
    Workbench(spark).alias("my_total", "sum", namespace="loom_ns")
    spark.sql("SELECT * FROM VALUES (20, 1), (20, 2), (10, 3) AS t(x, k)").createOrReplaceTempView("loom_t")
    assert spark.sql("SELECT loom_ns.my_total(DISTINCT x) FILTER (WHERE k < 3) AS v FROM loom_t").head().v == 20
    got = spark.sql("SELECT my_total(x) OVER (ORDER BY k) AS v FROM loom_t ORDER BY k").collect()
    assert [r.v for r in got] == [20, 40, 50]
    with pytest.raises(errors.InvalidArgument):
        Workbench(spark).alias("bad-name", "sum")


def test_aggregates(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 2.0), ("b", 8.0), ("b", None)], "g string, x double")
    got = {r.g: round(r.hm, 6) for r in d.groupBy("g").agg(A.harmonic_mean(F.col("x")).alias("hm")).collect()}
    assert got == {"a": 1.714286, "b": 3.2}
    none = d.where("false").agg(A.harmonic_mean(F.col("x")).alias("hm"), A.sample_sum(F.col("x")).alias("s"), A.fold(F.col("x"), A.median_of).alias("m")).head()
    assert none.hm is None and none.s == 0 and none.m is None
    fruit = spark.createDataFrame([("apple",), ("banana",), ("cherry",), (None,)], "v string").agg(A.bloom_filter(F.col("v")).alias("b"), A.xor_filter(F.col("v")).alias("x"))
    row = fruit.select(A.bloom_contains(F.col("b"), F.lit("apple")).alias("yes"), A.bloom_contains(F.col("b"), F.lit("durian")).alias("no"), A.xor_filter_contains(F.col("x"), F.lit("banana")).alias("xor")).head()
    assert (row.yes, row.no, row.xor) == (True, False, True)


def test_frames_with_nulls(spark):
    d = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 2, 7), (1, 4, 1)], "g int, o int, x int")
    alone = frames.excluding(d, ["g"], ["o", "x"], "x", "current row", 0, 0, "s")
    assert [r.s for r in alone.collect()] == [None] * 4
    ties = frames.excluding(d, ["g"], ["o"], "x", "ties", -1, 1, "s").orderBy("o", "x").collect()
    assert [r.s for r in ties] == [12, 5, 12, 1]
    folded = frames.fold_excluding(d, ["g"], "o", "x", "x", "group", -2, 0, lambda v: F.size(v), "n").orderBy("o", "x").collect()
    assert [r.n for r in folded] == [0, 1, 1, 1]
    with pytest.raises(errors.InvalidArgument):
        frames.excluding(d, ["g"], ["o"], "x", "all", 0, 0, "s")


def test_types(spark):
    assert spark_type("STRUCT(a INT, b MAP(VARCHAR, BIGINT)[])") == T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.ArrayType(T.MapType(T.StringType(), T.LongType())))])
    assert spark_type("DECIMAL") == T.DecimalType(18, 3) and spark_type("uint64") == T.DecimalType(20, 0)
    with pytest.raises(errors.Unsupported):
        spark_type("nonsense")
    u = "00112233-4455-6677-8899-aabbccddeeff"
    assert uuid_text(*uuid_halves(u)) == u
    assert spark.range(1).select(in_range(F.lit(255), "uint8").alias("v")).head().v == 255
    for bad in (in_range(F.lit(256), "uint8"), fixed_length(F.array(F.lit(1)), 2)):
        with pytest.raises(Exception, match="range|items"):
            spark.range(1).select(bad.alias("v")).collect()


def test_settings_pragmas_queries(spark):
    bench, heard = Workbench(spark), []
    bench.setting("depth", "", "bigint", "3", lambda k, v: heard.append((k, v)))
    assert bench.option("depth") == 3
    bench.set_option("depth", 9)
    assert bench.option("depth") == 9 and heard == [("depth", 9)]
    with pytest.raises(ValueError):
        bench.set_option("depth", "deep")
    assert bench.option("depth") == 9 and bench.config("loomkit.absent") is None
    bench.pragma("two", lambda n: f"SELECT 1 AS a;\nSELECT {n} AS a;")
    assert bench.run_pragma("two", 5).head().a == 5
    assert bench.query("SELECT 1, NULL, 'x'") == [["1", "", "x"]]
    assert preloads("a=/x/b.py:/y/c.py") == [("a", "/x/b.py"), ("c", "/y/c.py")]


def test_catalog(spark, tmp_path):
    c = small_catalog(spark)
    docs = catalog.docs(c)
    assert docs.count() == 3
    own = spark.createDataFrame([("aba", "aba_validate", None, "Own summary.", None, None, "us")], docs.schema)
    row = catalog.overlay(docs, own).where("module = 'aba'").head()
    assert row.summary == "Own summary." and row.tags == "us,validator,banking" and row.signature.startswith("aba_validate(")
    assert search.help_text(docs, "aba").startswith("## aba_validate(routing VARCHAR) -> BOOLEAN")
    assert search.help_text(docs, "nothing") is None
    bench, prefixes = Workbench(spark), catalog.Prefixes(spark, str(tmp_path / "prefixes"))
    assert prefixes.declare(bench, "st", "stats", {"total": "sum"}).head().macros == 1
    prefixes.declare(bench, "st", "stats", {"total": "sum"})
    assert prefixes.table().count() == 1 and prefixes.replay(bench, {"stats": {"total": "sum"}}) == 1
    assert spark.sql("SELECT st.total(x) AS v FROM VALUES (1), (2) AS t(x)").head().v == 3
    assert sorted(catalog.views(spark, c, bench, str(tmp_path / "none"), prefixes.table())) == ["cache", "docs", "events", "functions", "host", "host_capabilities", "module_compatibility", "modules", "prefixes"]


def test_cache(tmp_path):
    f = tmp_path / "x.bin"
    f.write_bytes(b"data")
    digest = hashlib.sha256(b"data").hexdigest()
    assert open(catalog.cached(str(f), digest, str(tmp_path / "c")), "rb").read() == b"data"
    with pytest.raises(errors.Io):
        catalog.cached(str(f), "0" * 64, str(tmp_path / "c"))
    assert len(list((tmp_path / "c").iterdir())) == 1


def test_sources(spark, tmp_path):
    d = spark.createDataFrame([(1, ""), (2, "a"), (3, None)], "k int, v string")
    assert copy.copy_to(d, str(tmp_path / "d")) == 3
    assert copy.copy_from(spark, str(tmp_path / "d"), d.schema).orderBy("k").collect() == d.collect()
    with pytest.raises(errors.InvalidArgument):
        copy.copy_from(spark, str(tmp_path / "d"), T.StructType(d.schema.fields[:1]))
    with pytest.raises(errors.Unsupported):
        Workbench(spark).read("/x/y.unknown")
    assert readers.sequence(spark, 0).count() == 0
    assert [r.value for r in readers.sequence(spark, 10).where("value > 7").orderBy("value").collect()] == [8, 9]
    Workbench(spark).table("loom_seq", readers.EmitSequence)
    assert spark.sql("SELECT count(*) AS n FROM loom_seq(4096)").head().n == 4096
    with pytest.raises(Exception, match="negative"):
        spark.sql("SELECT * FROM loom_seq(-1)").collect()
    body = b"hello"
    (tmp_path / "w.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\nContent-Length: 5\r\n\r\n" + body + b"\r\n\r\n")
    assert [(r.uri, bytes(r.content)) for r in readers.read_warc(spark, str(tmp_path / "w.warc")).collect()] == [("http://a/", body)]


def test_joins_and_vectors(spark):
    left = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 10:00:00'), (1, TIMESTAMP '2024-01-03 10:00:00'), (2, TIMESTAMP '2024-01-01 00:00:00') AS t(k, ts)")
    right = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 09:00:00', 5), (1, TIMESTAMP '2024-01-01 10:00:00', 6), (1, TIMESTAMP '2024-01-02 10:00:00', CAST(NULL AS INT)) AS t(k, ts, v)")
    for salt in (0, 1):
        assert [r.v0 for r in joins.asof(left, right, "ts", ["k"], "v", "v0", salt).orderBy("k", "ts").collect()] == [6, None, None]
    e = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None)], "id int, v array<double>")
    index = vectors.VectorIndex(e.where("v is not null"), "id", "v", 2)
    with pytest.raises(errors.InvalidState):
        index.search([0.0, 0.0], 1)
    assert [r.id for r in index.build().search([1.0, 0.9], 2).collect()] == [2, 1]
    assert vectors.duplicates(e, "id").count() == 0
    w = Window.orderBy(vectors.natural_key(F.col("n")))
    assert [r.n for r in spark.createDataFrame([("a10",), ("A9",), ("a1b",)], "n string").withColumn("r", F.row_number().over(w)).orderBy("r").collect()] == ["a1b", "A9", "a10"]


def test_forget_takes_functions_back(spark):
    bench = Workbench(spark)

    class Full(Module):
        name = "full"

        def load(self, bench):
            bench.scalar("loom_gone", "x + 1", {"x": "BIGINT"}, "BIGINT")
            bench.python("loom_gone_py", lambda s: s, "BIGINT")
            bench.macro("loom_gone_macro", {"x": "INT"}, "x * 2")
            bench.alias("loom_gone_sum", "sum", namespace="loom_gone_ns")
            bench.column("loom_gone_column", lambda x: x)
            bench.replacement("gone", lambda s, p: s.range(1))

    bench.load(Full())
    assert spark.sql("SELECT loom_gone(1L), loom_gone_py(1L), loom_gone_macro(1), loom_gone_sum(1), loom_gone_ns.loom_gone_sum(1) FROM range(1)").count() == 1
    bench.forget("full")
    for call in ("loom_gone(1L)", "loom_gone_py(1L)", "loom_gone_macro(1)", "loom_gone_sum(1)", "loom_gone_ns.loom_gone_sum(1)"):
        with pytest.raises(Exception, match="(?i)routine|function"):
            spark.sql(f"SELECT {call} FROM range(1)").collect()
    with pytest.raises(errors.InvalidState):
        bench.call("loom_gone_column", F.lit(1))
    with pytest.raises(errors.Unsupported):
        bench.read("x.gone")


def test_preload_loads(spark, tmp_path):
    path = tmp_path / "extra.py"
    path.write_text("from loomkit.registry import Module\nclass Extra(Module):\n    name = 'extra'\n    def load(self, bench):\n        bench.scalar('loom_extra', 'x * 10', {'x': 'BIGINT'}, 'BIGINT')\n")
    bench = Workbench(spark)
    assert bench.preload(f"extra={path}") == ["extra"]
    assert spark.sql("SELECT loom_extra(4L) AS v").head().v == 40
    with pytest.raises(errors.Io):
        bench.preload(str(tmp_path / "none.py"))


def test_help_search_and_version_in_sql(spark):
    bench, docs = Workbench(spark), catalog.docs(small_catalog(spark))
    bench.sql_functions(docs)
    assert spark.sql("SELECT loom_version() AS v").head().v == bench.version()
    got = spark.sql("SELECT module, function, score FROM loom_search('HASH digit') ORDER BY score DESC").collect()
    assert [tuple(r) for r in got] == [(r.module, r.function, r.score) for r in search.search(docs, "HASH digit").collect()]
    assert "aba_validate(routing VARCHAR) -> BOOLEAN" in spark.sql("SELECT help FROM loom_help('aba')").head().help


def test_incremental_aggregate(spark):
    """The longest text of a key, whatever the partitions, and keys of which a task sees more than it holds."""
    rows = [(k % 40 if k % 7 else None, f"{'x' * (k % 13)}{k}") for k in range(1000)]
    longest = lambda a, b: max(a, b, key=lambda s: (s[0], s[1]))
    run = lambda df: A.incremental(df, ["k"], ["t"], "n bigint, t string", lambda: (-1, ""), lambda s, r: longest(s, (len(r[0]), r[0])), longest, lambda s: s[1], "longest", "string")
    df, held = spark.createDataFrame(rows, "k long, t string"), A.STATES
    want = {k: max((t for j, t in rows if j == k), key=lambda t: (len(t), t)) for k in {k for k, _ in rows}}
    try:
        for states in (3, held):
            A.STATES = states
            assert {r.k: r.longest for r in run(df.repartition(3)).collect()} == want
    finally:
        A.STATES = held
    assert run(df.where("false")).count() == 0


def test_bloom_of_many_values(spark):
    made = spark.range(200_000).agg(A.bloom_filter(F.col("id"), 32).alias("b"))
    both = spark.range(199_000, 201_000).crossJoin(made).select("id", A.bloom_contains(F.col("b"), F.col("id"), 32).alias("has"))
    assert both.where("id < 200000 AND NOT has").count() == 0 and both.where("id >= 200000 AND has").count() < 20


def test_numbered_is_one_order(spark):
    got = vectors.numbered(spark.range(1000).withColumn("x", F.xxhash64("id")), F.col("x"), "place", 7).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 1001)) and [r.x for r in got] == sorted(r.x for r in got)


def test_namespaces_that_overlap(spark):
    bench = Workbench(spark)
    bench.alias("loom_both", "sum", namespace="loom_overlap")
    bench.alias("loom_both", "sum", namespace="loom_overlap")
    with pytest.raises(errors.InvalidState):
        bench.alias("loom_both", "max", namespace="loom_overlap")


def test_ranges_of_very_different_lengths(spark):
    points = spark.createDataFrame([(float(x),) for x in (-5, 0, 1, 9, 10, 11, 99_999, 100_000)], "x double")
    spans = spark.createDataFrame([(0.0, 10.0), (-1e6, 1e6), (10.0, 10.5), (5.0, 5.0), (99_999.0, 100_000.0), (0.0, 70_000.0)], "low double, high double")
    got = sorted((r.x, r.low, r.high) for r in joins.ranges(points, spans, "x", "low", "high", 1.0).collect())
    assert got == sorted((p.x, s.low, s.high) for p in points.collect() for s in spans.collect() if s.low <= p.x < s.high)


def test_index_deletes_and_drops(spark):
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "id long, v array<double>")
    index = vectors.VectorIndex(rows, "id", "v", 2).build()
    index.delete(spark.createDataFrame([(0,), (1,)], "id long"))
    assert [r.id for r in index.search([0.0, 0.0], 2).collect()] == [2, 3]
    index.drop()
    with pytest.raises(errors.InvalidState):
        index.search([0.0, 0.0], 1)
    assert index.build().search([0.0, 0.0], 1).count() == 0


def test_charts_of_unknown_fields(spark):
    from loomkit.plans import chart

    with pytest.raises(errors.InvalidArgument):
        chart.vegalite(spark.range(3), "bar", x="nothing")
    with pytest.raises(errors.InvalidArgument):
        chart.vegalite(spark.range(3), "cake", x="id")
    assert '"values": [{"id":0},{"id":1},{"id":2}]' in chart.vegalite(spark.range(3), "bar", x="id").head().spec
