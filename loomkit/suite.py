"""Queries over the synthetic tables, one or more for each operator, with SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomkit.errors import InvalidState
from loomkit.functions import encoding, geo, hashing, stats, text, validators, web
from loomkit.operators import aggregates as A
from loomkit.operators import frames, joins, vectors
from loomkit.plans import catalog, chart, contract, search
from loomkit.registry import Workbench
from loomkit.sources import copy, readers
from loomkit.streaming import windows
from loomkit.types import enum_ordinal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def key9(c: str) -> Column:
    return F.lpad(F.col(c).cast("string"), 9, "0")


# scalars ---------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, CAST(sum(l_linenumber + 1) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def scalar_plus_one(spark, sf_dir):
    bench = Workbench(spark)
    bench.scalar("loom_plus_one", "x + 1", {"x": "BIGINT"}, "BIGINT")
    t(spark, sf_dir, "lineitem").createOrReplaceTempView("loom_lineitem")
    return spark.sql("SELECT l_returnflag, sum(loom_plus_one(l_linenumber)) AS total FROM loom_lineitem GROUP BY 1")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalar_plus_one(spark, sf_dir)


@query("SELECT l_returnflag, CAST(sum(l_linenumber + 1) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def scalar_python(spark, sf_dir):
    Workbench(spark).python("loom_py_plus_one", lambda x: x.astype("int64") + 1, "BIGINT")
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.expr("sum(loom_py_plus_one(cast(l_linenumber as bigint)))").alias("total"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_linenumber AS BIGINT) + 1 END AS v FROM lineitem")
def scalar_null_propagation(spark, sf_dir):
    bench = Workbench(spark)
    bench.column("plus_one", lambda x: x + 1)
    x = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber").cast("long"))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bench.call("plus_one", x).alias("v"))


@query("SELECT n_nationkey, translate(n_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') AS v FROM nation")
def rot13_text(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", text.rot13(F.col("n_name")).alias("v"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS v FROM part")
def slugify_part(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.slugify(F.col("p_name")).alias("v"))


@query("""WITH d AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS s FROM orders)
SELECT o_orderkey, (3 * CAST(s[1] AS INT) + 7 * CAST(s[2] AS INT) + CAST(s[3] AS INT) + 3 * CAST(s[4] AS INT) + 7 * CAST(s[5] AS INT) + CAST(s[6] AS INT) + 3 * CAST(s[7] AS INT) + 7 * CAST(s[8] AS INT) + CAST(s[9] AS INT)) % 10 = 0 AS v FROM d""")
def aba_from_keys(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", validators.aba_validate(key9("o_orderkey")).alias("v"))


LUHN = "list_sum(list_transform(range(1, len({s}) + 1), lambda i: CASE WHEN (len({s}) - i) % 2 = 0 THEN CAST({s}[i] AS INT) ELSE (CAST({s}[i] AS INT) * 2) // 10 + (CAST({s}[i] AS INT) * 2) % 10 END)) % 10 = 0"


@query(f"WITH d AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS s FROM orders) SELECT o_orderkey, {LUHN.format(s='s')} AS v FROM d")
def luhn_orders(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", validators.luhn_validate(key9("o_orderkey")).alias("v"))


@query(f"""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'us' ELSE 'US' END || CASE WHEN p_partkey % 5 = 0 THEN 'K' ELSE '' END || lpad(CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 5 = 0 THEN 8 ELSE 9 END, '0') || CAST(p_partkey % 10 AS VARCHAR) AS code FROM part),
d AS (SELECT p_partkey, code, array_to_string(list_transform(string_split(code, ''), lambda x: CASE WHEN x BETWEEN 'A' AND 'Z' THEN CAST(ord(x) - 55 AS VARCHAR) ELSE x END), '') AS s FROM c)
SELECT p_partkey, CASE WHEN regexp_full_match(code, '[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]') THEN {LUHN.format(s='s')} ELSE false END AS v FROM (SELECT p_partkey, code, CASE WHEN regexp_full_match(s, '[0-9]+') THEN s ELSE '0' END AS s FROM d)""")
def isin_parts(spark, sf_dir):
    """Codes with right and wrong check digits, with a letter inside, and some in small letters."""
    k, five = F.col("p_partkey"), F.col("p_partkey") % 5 == 0
    number = F.when(five, F.concat(F.lit("K"), F.lpad(k.cast("string"), 8, "0"))).otherwise(F.lpad(k.cast("string"), 9, "0"))
    code = F.concat(F.when(k % 7 == 0, "us").otherwise("US"), number, (k % 10).cast("string"))
    return t(spark, sf_dir, "part").select("p_partkey", validators.isin_validate(code).alias("v"))


@query("""WITH d AS (SELECT c_custkey, 'DE89' || lpad(CAST(c_custkey AS VARCHAR), 18, '0') AS s FROM customer)
SELECT c_custkey, CAST(lpad(CAST(c_custkey AS VARCHAR), 18, '0') || '131489' AS HUGEINT) % 97 = 1 AS v FROM d""")
def iban_customers(spark, sf_dir):
    code = F.concat(F.lit("DE89"), F.lpad(F.col("c_custkey").cast("string"), 18, "0"))
    return t(spark, sf_dir, "customer").select("c_custkey", validators.iban_validate(code).alias("v"))


@query("""SELECT c_custkey, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(d - c) / 2), 2))), 6) AS km
FROM (SELECT c_custkey, c_custkey % 90 - 45.0 AS a, (c_custkey * 7) % 80 - 40.0 AS b, c_custkey % 180 - 90.0 AS c, (c_custkey * 11) % 170 - 85.0 AS d FROM customer)""")
def haversine_grid(spark, sf_dir):
    k = F.col("c_custkey")
    a, b, c, d = k % 90 - 45.0, (k * 7) % 80 - 40.0, k % 180 - 90.0, (k * 11) % 170 - 85.0
    return t(spark, sf_dir, "customer").select("c_custkey", r(geo.haversine_km(a, c, b, d)).alias("km"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 1024 AS BIGINT) AS x, CAST(l_suppkey % 1024 AS BIGINT) AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(list_sum(list_transform(range(10), lambda i: ((x >> i) & 1) << (2 * i))) + list_sum(list_transform(range(10), lambda i: ((y >> i) & 1) << (2 * i + 1))) AS BIGINT) AS z, x, y FROM b""")
def morton_lineitem(spark, sf_dir):
    z = geo.morton_encode(F.col("l_partkey") % 1024, F.col("l_suppkey") % 1024)
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", z.alias("z"))
    return rows.select("*", geo.morton_decode_x(F.col("z")).alias("x"), geo.morton_decode_y(F.col("z")).alias("y"))


@query("""WITH RECURSIVE h AS (SELECT range % 16 AS x0, range // 16 AS y0, range % 16 AS x, range // 16 AS y, CAST(8 AS BIGINT) AS s, CAST(0 AS BIGINT) AS d FROM range(256)
UNION ALL SELECT x0, y0, CASE WHEN ry = 0 THEN fy ELSE fx END, CASE WHEN ry = 0 THEN fx ELSE fy END, s // 2, d + s * s * xor(3 * rx, ry)
FROM (SELECT *, CASE WHEN ry = 0 AND rx = 1 THEN s - 1 - u ELSE u END AS fx, CASE WHEN ry = 0 AND rx = 1 THEN s - 1 - v ELSE v END AS fy
FROM (SELECT x0, y0, s, d, CAST(x & s > 0 AS BIGINT) AS rx, CAST(y & s > 0 AS BIGINT) AS ry, x & (s - 1) AS u, y & (s - 1) AS v FROM h WHERE s > 0)))
SELECT x0 AS x, y0 AS y, d, x0 AS back_x, y0 AS back_y FROM h WHERE s = 0""")
def hilbert_walk(spark, sf_dir):
    """All cells of a square on the curve, and from there back."""
    cells = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    d = cells.select("x", "y", geo.hilbert_encode(F.col("x"), F.col("y"), 4).alias("d"))
    back = geo.hilbert_decode(F.col("d"), 4)
    return d.select("x", "y", "d", back["x"].alias("back_x"), back["y"].alias("back_y"))


@query("""SELECT s_suppkey, round(degrees(asin(sin(radians(d)) * sin(radians(27.12825)) + cos(radians(d)) * cos(radians(27.12825)) * cos(radians(a - 192.85948)))), 6) AS b, round(15.0 * (a % 24 + 30 / 60.0 + 15 / 3600.0), 6) AS h
FROM (SELECT s_suppkey, s_suppkey * 3.0 AS a, s_suppkey % 120 - 60.0 AS d FROM supplier)""")
def sky_positions(spark, sf_dir):
    a, d = F.col("s_suppkey") * 3.0, F.col("s_suppkey") % 120 - 60.0
    return t(spark, sf_dir, "supplier").select("s_suppkey", r(geo.equatorial_to_galactic_b(a, d)).alias("b"), r(geo.hms_to_deg(a % 24, F.lit(30), F.lit(15))).alias("h"))


@query("SELECT p_partkey, sha1(p_name) AS sha1, md5(p_name) AS md5, sha256(p_name) AS sha256 FROM part")
def hashes_part(spark, sf_dir):
    n = F.col("p_name")
    return t(spark, sf_dir, "part").select("p_partkey", hashing.sha1(n).alias("sha1"), F.md5(n).alias("md5"), F.sha2(n, 256).alias("sha256"))


@query()
def hashes_python(spark, sf_dir):
    n = F.col("n_name")
    return t(spark, sf_dir, "nation").select("n_nationkey", hashing.sha3_256(n).alias("sha3"), hashing.xxh32(n).alias("x32"), hashing.xxh64(n).alias("x64"), hashing.xxh3(n).alias("x3"), hashing.murmur3(n).alias("m3"), encoding.base32_encode(n.cast("binary")).alias("b32"), encoding.base58_encode(n.cast("binary")).alias("b58"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(damerau_levenshtein(a.n_name, b.n_name) AS INT) AS dl, CAST(levenshtein(a.n_name, b.n_name) AS INT) AS lev FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def text_distances(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    pairs = n.alias("a").join(n.alias("b"), F.col("a.n_regionkey") == F.col("b.n_regionkey"))
    x, y = F.col("a.n_name"), F.col("b.n_name")
    return pairs.select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), text.damerau_levenshtein(x, y).alias("dl"), F.levenshtein(x, y).alias("lev"))


@query("""SELECT c_custkey, round(exp(-pow(x, 2) / 2) / sqrt(2 * pi()), 6) AS pdf, round(1 - exp(-0.5 * abs(x)), 6) AS e, round(exp(k * ln(2.5) - 2.5 - ln(CAST(factorial(k) AS DOUBLE))), 6) AS p
FROM (SELECT c_custkey, c_acctbal / 5000 AS x, CAST(c_custkey % 12 AS INT) AS k FROM customer)""")
def distributions(spark, sf_dir):
    x, k = F.col("c_acctbal") / 5000, (F.col("c_custkey") % 12).cast("int")
    return t(spark, sf_dir, "customer").select("c_custkey", r(stats.normal_pdf(x, F.lit(0.0), F.lit(1.0))).alias("pdf"), r(stats.exponential_cdf(F.abs(x), F.lit(0.5))).alias("e"), r(stats.poisson_pmf(k, F.lit(2.5))).alias("p"))


@query(f"""WITH h AS (SELECT page_id, lower(regexp_extract(CASE WHEN page_id % 3 = 0 THEN replace(replace(url, '.com', '.co.uk'), '.net', '.com.au') ELSE url END, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host FROM pages),
n AS (SELECT page_id, host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS two FROM h),
k AS (SELECT page_id, host, two, CASE WHEN two IN {web.SUFFIXES} THEN 3 ELSE 2 END AS labels FROM n)
SELECT page_id, host, CASE WHEN len(string_split(host, '.')) >= labels THEN array_to_string(list_slice(string_split(host, '.'), -labels, -1), '.') END AS domain,
CASE WHEN labels = 3 THEN two ELSE string_split(host, '.')[-1] END AS suffix FROM k""")
def url_domain_pages(spark, sf_dir):
    """Hosts of pages, some moved under suffixes of two labels."""
    u = F.when(F.col("page_id") % 3 == 0, F.replace(F.replace("url", F.lit(".com"), F.lit(".co.uk")), F.lit(".net"), F.lit(".com.au"))).otherwise(F.col("url"))
    return t(spark, sf_dir, "pages").select("page_id", web.host(u).alias("host"), web.registrable_domain(u).alias("domain"), web.public_suffix(u).alias("suffix"))


@query()
def html_text_pages(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 60 AND CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 <> 0 AS ok FROM events")
def json_events(spark, sf_dir):
    """Texts with the number as it is, as text where 3 divides it (a wrong type), and bounds that some break."""
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 60}}}
    k = F.get_json_object("props", "$.k")
    held = F.when(k.cast("long") % 3 == 0, F.to_json(F.struct(k.alias("k")))).otherwise(F.col("props"))
    return t(spark, sf_dir, "events").select("event_id", k.cast("long").alias("k"), web.json_schema_valid(held, schema).alias("ok"))


@query("SELECT o_orderkey, ((epoch_ms(o_orderdate) - 1577836800000) << 22) | (o_orderkey & 4194303) AS id FROM orders WHERE o_orderdate >= TIMESTAMP '2020-01-01' UNION ALL SELECT o_orderkey, (epoch_ms(o_orderdate) - 1577836800000) * 4194304 + (o_orderkey & 4194303) FROM orders WHERE o_orderdate < TIMESTAMP '2020-01-01'")
def tsid_orders(spark, sf_dir):
    made = encoding.tsid_from_timestamp(F.col("o_orderdate"), F.col("o_orderkey"))
    return t(spark, sf_dir, "orders").select("o_orderkey", encoding.tsid_decode(encoding.tsid_encode(made)).alias("id"))


@query("SELECT user_id, array_to_string(list_transform(v, lambda x: CASE WHEN list_max(v) > 0 AND x > 0 THEN repeat('█', CAST(round(x / list_max(v) * 10) AS INT)) ELSE '' END), chr(10)) AS bars FROM (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1)")
def bars_events(spark, sf_dir):
    values = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"])
    return t(spark, sf_dir, "events").groupBy("user_id").agg(text.bars(values, 10).alias("bars"))


@query("SELECT n_regionkey, replace(replace(to_json({'$schema': 'https://vega.github.io/schema/vega-lite/v5.json', 'mark': 'bar', 'encoding': {'x': {'field': 'n_name', 'type': 'nominal'}, 'y': {'field': 'n_nationkey', 'type': 'quantitative'}}, 'data': {'values': list({'n_name': n_name, 'n_nationkey': n_nationkey} ORDER BY n_name)}}), ' ', ''), chr(9), '') AS spec FROM nation GROUP BY 1")
def vegalite_nations(spark, sf_dir):
    grid = chart.vegalite_grid(t(spark, sf_dir, "nation"), "n_regionkey", "bar", x="n_name", y="n_nationkey")
    return grid.select("n_regionkey", F.replace("spec", F.lit(" "), F.lit("")).alias("spec"))


@query("SELECT count(*) AS rows, CAST(4 AS BIGINT) AS clusters FROM embeddings WHERE embedding IS NOT NULL")
def kmeans_embeddings(spark, sf_dir):
    found = vectors.kmeans(t(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4)
    return found.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("cluster").alias("clusters"))


# aggregates ------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS s FROM lineitem GROUP BY 1")
def sample_sum_group(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(A.sample_sum(F.col("l_linenumber")).alias("s"))


@query("SELECT CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS s, round(CAST(NULL AS DOUBLE), 1) AS hm FROM lineitem WHERE false")
def sample_sum_empty(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").where("false").agg(A.sample_sum(F.col("l_linenumber")).alias("s"), A.harmonic_mean(F.col("l_quantity")).alias("hm"))


@query("SELECT l_returnflag, round(count(l_quantity) / sum(1.0 / l_quantity), 6) AS hm FROM lineitem GROUP BY 1")
def harmonic_mean_group(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r(A.harmonic_mean(F.col("l_quantity"))).alias("hm"))


@query("SELECT l_returnflag, round(count(DISTINCT l_quantity) / sum(DISTINCT 1.0 / l_quantity), 6) AS hm FROM lineitem GROUP BY 1")
def hm_distinct(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r(A.harmonic_mean(F.col("l_quantity"), distinct=True)).alias("hm"))


@query("SELECT l_returnflag, round(count(l_quantity) FILTER (WHERE l_discount > 0.05) / sum(1.0 / l_quantity) FILTER (WHERE l_discount > 0.05), 6) AS hm FROM lineitem GROUP BY 1")
def hm_filter(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r(A.harmonic_mean(F.col("l_quantity"), where=F.col("l_discount") > 0.05)).alias("hm"))


@query("SELECT o_orderkey, round(count(o_totalprice) OVER w / sum(1.0 / o_totalprice) OVER w, 4) AS hm FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def hm_window_rows(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return t(spark, sf_dir, "orders").select("o_orderkey", r(A.harmonic_mean(F.col("o_totalprice"), window=w), 4).alias("hm"))


@query("SELECT l_returnflag, l_linestatus, round(count(l_quantity) / sum(1.0 / l_quantity), 6) AS hm, median(l_extendedprice) AS med FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def hm_rollup(spark, sf_dir):
    hm = r(A.harmonic_mean(F.col("l_quantity"))).alias("hm")
    return A.percentiles(t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice"), {"med": 0.5}, [hm], "rollup")


@query("SELECT o_custkey, median(DISTINCT o_totalprice) FILTER (WHERE o_orderstatus <> 'P') AS med FROM orders GROUP BY 1")
def fold_median(spark, sf_dir):
    m = A.fold(F.col("o_totalprice"), A.median_of, where=F.col("o_orderstatus") != "P", distinct=True)
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(m.alias("med"))


@query("SELECT o_orderstatus, CAST(sum(DISTINCT o_custkey) FILTER (WHERE o_orderkey % 2 = 0) AS BIGINT) AS s FROM orders GROUP BY 1")
def alias_sum_distinct_filter(spark, sf_dir):
    Workbench(spark).alias("loom_total", "sum")
    return t(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.expr("loom_total(DISTINCT o_custkey) FILTER (WHERE o_orderkey % 2 = 0)").alias("s"))


@query("SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM orders")
def ns_alias_over(spark, sf_dir):
    Workbench(spark).alias("total", "sum", namespace="loom_stats")
    return t(spark, sf_dir, "orders").selectExpr("o_orderkey", "loom_stats.total(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s")


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names, string_agg(n_name, ',' ORDER BY n_nationkey) AS by_key FROM nation GROUP BY 1")
def ordered_string_agg(spark, sf_dir):
    names = F.expr("listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name DESC)")
    return t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(names.alias("names"), A.ordered_concat(F.col("n_name"), F.col("n_nationkey")).alias("by_key"))


@query("SELECT n_regionkey, sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey)) AS h FROM nation GROUP BY 1")
def hash_agg_nations(spark, sf_dir):
    return t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(hashing.hash_agg(F.col("n_name"), F.col("n_nationkey")).alias("h"))


@query("SELECT p_brand, count(*) AS members, count(*) AS in_bloom, count(*) AS in_xor, true AS few_strangers FROM part GROUP BY 1")
def bloom_membership(spark, sf_dir):
    """All members are found in their brand's filters, and at most one in 50 names that no part has."""
    parts = t(spark, sf_dir, "part").select("p_brand", "p_name")
    made = parts.groupBy("p_brand").agg(A.bloom_filter(F.col("p_name")).alias("bloom"), A.xor_filter(F.col("p_name")).alias("xor"))
    held = parts.join(made, "p_brand")
    hit = lambda c: F.count_if(c).alias
    stranger = F.concat("p_name", F.lit(" of no part"))
    few = F.count_if(A.bloom_contains(F.col("bloom"), stranger)) * 50 <= F.count(F.lit(1))
    return held.groupBy("p_brand").agg(F.count(F.lit(1)).alias("members"), hit(A.bloom_contains(F.col("bloom"), F.col("p_name")))("in_bloom"), hit(A.xor_filter_contains(F.col("xor"), F.col("p_name")))("in_xor"), few.alias("few_strangers"))


@query("SELECT l_returnflag, count(*) AS n, round(var_pop(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1 ".replace("count(*) AS n, ", ""))
def incremental_variance(spark, sf_dir):
    """A module's own aggregate by init, update, combine and finish: number, mean and squared deviations (Chan's merge)."""

    def combine(a, b):
        n = a[0] + b[0]
        step = b[1] - a[1]
        return n, a[1] + step * b[0] / n, a[2] + b[2] + step * step * a[0] * b[0] / n

    made = A.incremental(t(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_extendedprice"], "n bigint, mean double, m2 double", lambda: (0, 0.0, 0.0), lambda s, row: combine(s, (1, row[0], 0.0)), combine, lambda s: s[2] / s[0], "v", "double")
    return made.select("l_returnflag", r(F.col("v"), 2).alias("v"))


@query("SELECT event_type, true AS distinct_close, true AS median_close FROM events GROUP BY 1")
def approximate_events(spark, sf_dir):
    """Approximate aggregates within their stated errors of the exact ones."""
    e = t(spark, sf_dir, "events")
    near = F.abs(F.approx_count_distinct("user_id", 0.02) - F.count_distinct("user_id")) <= 0.1 * F.count_distinct("user_id") + 1
    d = A.percentiles(e, ["event_type"], F.col("value"), {"low": 0.48, "high": 0.52}, [near.alias("distinct_close"), F.percentile_approx("value", 0.5, 1000).alias("mid")])
    return d.select("event_type", "distinct_close", F.col("mid").between(F.col("low"), F.col("high")).alias("median_close"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n, CAST(grouping(event_type) AS BIGINT) AS g FROM events GROUP BY CUBE (event_type)")
def cube_events(spark, sf_dir):
    return t(spark, sf_dir, "events").cube("event_type").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"), F.grouping("event_type").cast("long").alias("g"))


# windows ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), 2) AS s FROM orders")
def frame_exclude_current(spark, sf_dir):
    d = frames.excluding(t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "current row", -2, 2, "s")
    return d.select("o_orderkey", r(F.col("s"), 2).alias("s"))


ODD_NUMBERS = "CASE o_orderkey % 5 WHEN 0 THEN 1e16 WHEN 1 THEN 1.0 WHEN 2 THEN {inf} WHEN 3 THEN 2.0 END"


def odd_numbers() -> Column:
    """Numbers of which a sum can't be taken back: one hides others, one is infinite, some are null."""
    return F.expr(ODD_NUMBERS.format(inf="double('Infinity')") + " + 0D")


@query(f"SELECT o_orderkey, sum({ODD_NUMBERS.format(inf=chr(39) + 'inf' + chr(39) + '::DOUBLE')}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS s FROM orders")
def frame_exclude_odd_numbers(spark, sf_dir):
    d = t(spark, sf_dir, "orders").withColumn("x", odd_numbers())
    return frames.excluding(d, ["o_custkey"], ["o_orderdate", "o_orderkey"], "x", "current row", -1, 1, "s").select("o_orderkey", "s")


@query("SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE NO OTHERS) AS top, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE NO OTHERS), 4) AS mean FROM orders")
def frame_exclude_no_others(spark, sf_dir):
    d = frames.fold_excluding(t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", "o_totalprice", "no others", -1, 1, F.array_max, "top")
    d = frames.excluding(d, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "no others", -1, 1, "mean", "avg")
    return d.select("o_orderkey", "top", r(F.col("mean"), 4).alias("mean"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY round(value, 1) RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING EXCLUDE GROUP), 3) AS s FROM events")
def frame_exclude_group_doubles(spark, sf_dir):
    d = t(spark, sf_dir, "events").withColumn("k", F.round("value", 1))
    return frames.excluding(d, ["user_id"], ["k"], "value", "group", -0.5, 0.5, "s").select("event_id", r(F.col("s"), 3).alias("s"))


RANGED = "OVER (PARTITION BY o_orderstatus ORDER BY CAST(o_custkey AS BIGINT) RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING EXCLUDE {})"


@query(f"SELECT o_orderkey, CAST(sum(o_orderkey) {RANGED.format('GROUP')} AS BIGINT) AS s FROM orders")
def frame_exclude_group(spark, sf_dir):
    return frames.excluding(t(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_custkey"], "o_orderkey", "group", -5, 5, "s").select("o_orderkey", "s")


@query(f"SELECT o_orderkey, count(o_orderkey) {RANGED.format('TIES')} AS n FROM orders")
def frame_exclude_ties(spark, sf_dir):
    return frames.excluding(t(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_custkey"], "o_orderkey", "ties", -5, 5, "n", "count").select("o_orderkey", "n")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW), 4) AS s FROM events")
def frame_exclude_fold(spark, sf_dir):
    d = frames.fold_excluding(t(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "value", "current row", -3, 0, frames.sum_of, "s")
    return d.select("event_id", r(F.col("s"), 4).alias("s"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM orders")
def frame_groups(spark, sf_dir):
    return frames.groups_frame(t(spark, sf_dir, "orders"), ["o_orderstatus"], "o_custkey", F.count(F.lit(1)), -1, 1, "n").select("o_orderkey", "n")


@query("SELECT event_id, count(DISTINCT event_type) OVER w AS kinds, round(sum(value) FILTER (WHERE event_type = 'click') OVER w, 4) AS clicks FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def window_distinct_filter(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    kinds = frames.distinct_over(F.col("event_type"), w, lambda a: F.size(a).cast("long"))
    clicks = frames.filtered_over(F.sum, F.col("value"), F.col("event_type") == "click", w)
    return t(spark, sf_dir, "events").select("event_id", kinds.alias("kinds"), r(clicks, 4).alias("clicks"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS sma FROM events")
def sma_events(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return t(spark, sf_dir, "events").select("event_id", r(F.avg("value").over(w)).alias("sma"))


@query("""WITH v AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1)
SELECT user_id, round(list_reduce(v, lambda a, x: 0.3 * x + 0.7 * a), 6) AS ema,
round((SELECT CASE WHEN len(v) < 2 THEN NULL WHEN u + d = 0 THEN 50.0 ELSE 100 * u / (u + d) END FROM (SELECT coalesce(list_sum(list_transform(range(2, len(v) + 1), lambda i: greatest(v[i] - v[i - 1], 0.0))), 0) AS u, coalesce(list_sum(list_transform(range(2, len(v) + 1), lambda i: greatest(v[i - 1] - v[i], 0.0))), 0) AS d)), 6) AS rsi FROM v""")
def ema_rsi_events(spark, sf_dir):
    order = F.struct("ts", "event_id")
    return t(spark, sf_dir, "events").groupBy("user_id").agg(r(A.ema(F.col("value"), order, 0.3)).alias("ema"), r(A.rsi(F.col("value"), order)).alias("rsi"))


@query("SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS INT) AS rk, lag(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS before FROM customer")
def ranking(spark, sf_dir):
    w = Window.partitionBy("c_mktsegment")
    return t(spark, sf_dir, "customer").select("c_custkey", F.rank().over(w.orderBy(F.desc("c_acctbal"))).alias("rk"), F.lag("c_custkey").over(w.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("before"))


# table functions, macros, casts, types --------------------------------------------------------------------------


@query("SELECT range AS value FROM range(5000)")
def emit_sequence(spark, sf_dir):
    Workbench(spark).table("loom_emit_sequence", readers.EmitSequence)
    return spark.sql("SELECT value FROM loom_emit_sequence(5000)")


@query("SELECT n_nationkey, CAST(v AS BIGINT) AS value FROM nation, unnest(range(n_nationkey)) AS u(v)")
def lateral_emit(spark, sf_dir):
    Workbench(spark).table("loom_emit_sequence", readers.EmitSequence)
    t(spark, sf_dir, "nation").createOrReplaceTempView("loom_nation")
    return spark.sql("SELECT n_nationkey, value FROM loom_nation, LATERAL loom_emit_sequence(n_nationkey)")


@query("SELECT range AS value FROM range(1000) WHERE range >= 990")
def sequence_source(spark, sf_dir):
    return readers.sequence(spark, 1000).where("value >= 990")


@query("SELECT range AS value FROM range(1000) WHERE range IN (3, 5, 8, 2000) AND range <> 5 AND range IS NOT NULL UNION ALL SELECT range FROM range(1000) WHERE range IS NULL")
def sequence_predicates(spark, sf_dir):
    numbers = lambda: readers.sequence(spark, 1000)
    return numbers().where("value IN (3, 5, 8, 2000) AND value <> 5 AND value IS NOT NULL").unionByName(numbers().where("value IS NULL"))


@query("SELECT range * range AS square FROM range(100)")
def arrow_producer(spark, sf_dir):
    import pyarrow as pa

    return readers.produced(spark, "square bigint", 4, lambda k: iter([pa.record_batch([pa.array([i * i for i in range(25 * k, 25 * k + 25)], pa.int64())], names=["square"])]))


@query("SELECT p_partkey, p_size * 2 + 1 AS v FROM part")
def macro_scalar(spark, sf_dir):
    Workbench(spark).macro("loom_twice_plus", {"x": "INT", "more": "INT DEFAULT 1"}, "x * 2 + more")
    return t(spark, sf_dir, "part").selectExpr("p_partkey", "loom_twice_plus(p_size) AS v")


@query("SELECT n_name FROM nation WHERE n_regionkey = 2")
def macro_table(spark, sf_dir):
    t(spark, sf_dir, "nation").createOrReplaceTempView("loom_nation")
    Workbench(spark).table_macro("loom_nations_of", {"region": "INT"}, {"n_name": "STRING"}, "SELECT n_name FROM loom_nation WHERE n_regionkey = region")
    return spark.sql("SELECT n_name FROM loom_nations_of(2)")


@query("SELECT c_custkey, CAST(floor(c_acctbal * 100) AS BIGINT) AS cents, CAST(c_acctbal AS DECIMAL(12, 2)) AS money FROM customer")
def cast_custom(spark, sf_dir):
    bench = Workbench(spark)
    bench.type_alias("cents", "BIGINT")
    bench.type_alias("money", "DECIMAL(12, 2)")
    bench.cast("double", "cents", lambda c: F.floor(c * 100).cast("long"), "implicit", 50)
    c = F.col("c_acctbal")
    return t(spark, sf_dir, "customer").select("c_custkey", bench.convert(c, "double", "cents").alias("cents"), bench.convert(c, "double", "money").alias("money"))


@query("SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 END AS INT) AS place FROM orders")
def enum_order(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", enum_ordinal(F.col("o_orderstatus"), ["O", "P", "F"]).alias("place"))


@query("SELECT 'loomkit.limit' AS key, '7' AS value")
def pragma_setting(spark, sf_dir):
    bench = Workbench(spark)
    bench.setting("limit", "how many", "bigint", "5")
    bench.set_option("limit", 7)
    bench.pragma("show_limit", lambda: f"SELECT 'loomkit.limit' AS key, '{bench.option('limit')}' AS value;")
    return bench.run_pragma("show_limit")


# catalog ---------------------------------------------------------------------------------------------------------

#: A small catalog to try the plans on.
CATALOG = {
    "extensions": [
        {"name": "aba", "version": "1.0.0", "exports": ["aba_validate"], "content_digest": "a" * 64, "wit_contract_version": "pkg@4.1.0", "unknown": 1,
         "providers": [{"id": "w2", "kind": "wasm", "abi": "pkg@2.0", "content_digest": "b" * 64}, {"id": "w4", "kind": "wasm", "abi": "pkg@4.0", "content_digest": "c" * 64}, {"id": "n", "kind": "native", "platform": "linux", "duckdb_version": "v1"}],
         "functions": [{"name": "aba_validate", "kind": "scalar", "returns": "BOOLEAN", "arguments": [{"name": "routing", "type": "VARCHAR"}], "summary": "Check a routing number.", "description": "Nine digits with a check digit.", "tags": ["validator", "banking"]}]},
        {"name": "crypto", "version": "2.0.0", "namespace": "crypto", "prefix": "c", "content_digest": "d" * 64, "wit_contract_version": "pkg@3.0.0", "crates": ["x"],
         "providers": [{"id": "cn", "kind": "community-native", "extension_name": "crypto", "function_mapping": {"hash": "crypto_hash"}}],
         "functions": [{"name": "hash", "kind": "scalar", "returns": "VARCHAR", "arguments": [], "summary": "Hash of a text.", "tags": ["hash", "digest"]}, {"name": " ", "kind": "scalar"}]},
        {"name": "sample", "version": "0.1.0", "providers": None, "content_digest": "e" * 64, "wit_contract_version": "pkg@4.2.0",
         "functions": [{"name": "emit_sequence", "kind": "table", "arguments": [{"name": "limit", "type": "BIGINT"}], "columns": [{"name": "value", "type": "BIGINT"}], "summary": "Numbers up to a limit."}]},
    ]
}


def small_catalog(spark: SparkSession) -> DataFrame:
    return catalog.of_json(spark, json.dumps(CATALOG))


#: The same catalog for SQL: modules, and their providers in order.
MODULES_SQL = "(VALUES ('aba', 'pkg@4.1.0', repeat('a', 64)), ('crypto', 'pkg@3.0.0', repeat('d', 64)), ('sample', 'pkg@4.2.0', repeat('e', 64))) AS m(module, contract, own)"
PROVIDERS_SQL = "(VALUES ('aba', 0, 'w2', 'wasm', 'pkg@2.0', repeat('b', 64), NULL, NULL, NULL), ('aba', 1, 'w4', 'wasm', 'pkg@4.0', repeat('c', 64), NULL, NULL, NULL), ('aba', 2, 'n', 'native', NULL, NULL, 'linux', 'v1', NULL), ('crypto', 0, 'cn', 'community-native', NULL, NULL, NULL, NULL, 'crypto')) AS p(module, place, id, kind, abi, digest, platform, version, extension)"


@query(f"""WITH f AS (SELECT module, arg_min(id, place) AS provider, arg_min(digest, place) AS digest FROM {PROVIDERS_SQL} WHERE kind = 'wasm' AND digest IS NOT NULL AND try_cast(regexp_extract(abi, '@([^.]*)', 1) AS INT) = 4 GROUP BY 1)
SELECT m.module, f.provider, coalesce(f.digest, CASE WHEN try_cast(regexp_extract(contract, '@([^.]*)', 1) AS INT) = 4 THEN own END) AS digest FROM {MODULES_SQL} LEFT JOIN f USING (module)""")
def provider_select(spark, sf_dir):
    return catalog.digests(small_catalog(spark), host=4)


@query(f"""WITH c AS (SELECT module, arg_min(id, place) AS id FROM {PROVIDERS_SQL} WHERE kind = 'community-native' AND extension IS NOT NULL GROUP BY 1),
e AS (SELECT module, arg_min(id, place) AS id FROM {PROVIDERS_SQL} WHERE kind = 'native' AND platform = 'linux' AND version = 'v1' GROUP BY 1)
SELECT m.module, coalesce(c.id, e.id) AS provider, CASE WHEN c.id IS NOT NULL THEN 'community' WHEN e.id IS NOT NULL THEN 'native' END AS kind FROM {MODULES_SQL} LEFT JOIN c USING (module) LEFT JOIN e USING (module)""")
def native_select(spark, sf_dir):
    return catalog.natives(small_catalog(spark), "linux", "v1")


@query("SELECT * FROM (VALUES ('aba', 'aba_validate', 'aba_validate(routing VARCHAR) -> BOOLEAN', 'validator,banking'), ('crypto', 'hash', 'hash() -> VARCHAR', 'hash,digest'), ('sample', 'emit_sequence', 'emit_sequence(limit BIGINT) TABLE(value BIGINT)', NULL)) AS v(module, function, signature, tags)")
def docs_view(spark, sf_dir):
    return catalog.docs(small_catalog(spark)).select("module", "function", "signature", "tags")


@query("""WITH d AS (SELECT * FROM (VALUES ('aba', 'aba_validate', 'Check a routing number.', 'Nine digits with a check digit.', 'validator,banking'), ('crypto', 'hash', 'Hash of a text.', NULL, 'hash,digest'), ('sample', 'emit_sequence', 'Numbers up to a limit.', NULL, NULL)) AS v(module, function, summary, description, tags)),
w AS (SELECT unnest(string_split(lower('HASH digit'), ' ')) AS word),
s AS (SELECT module, function, summary, CAST(sum(10 * CAST(contains(lower(function), word) AS INT) + 5 * CAST(contains(lower(coalesce(tags, '')), word) AS INT) + 3 * CAST(contains(lower(coalesce(summary, '')), word) AS INT) + CAST(contains(lower(coalesce(description, '')), word) AS INT)) AS BIGINT) AS score FROM d, w GROUP BY ALL)
SELECT * FROM s WHERE score > 0""")
def search_ranked(spark, sf_dir):
    return search.search(catalog.docs(small_catalog(spark)), "HASH digit")


@query("""WITH m AS (SELECT * FROM (VALUES ('override_me', 'other'), ('distance', 'geo_dist')) AS v(alias, target)), f AS (SELECT unnest(['ta_sma', 'ta_ema', 'other', 'ta_not-safe', 'ta_']) AS name)
SELECT alias, target FROM m UNION ALL SELECT substr(name, 4), name FROM f WHERE starts_with(name, 'ta_') AND regexp_full_match(substr(name, 4), '[A-Za-z0-9_]+') AND name NOT IN (SELECT target FROM m)""")
def alias_pairs(spark, sf_dir):
    mapping = spark.createDataFrame([("override_me", "other"), ("distance", "geo_dist")], "alias string, target string")
    functions = spark.createDataFrame([("ta_sma",), ("ta_ema",), ("other",), ("ta_not-safe",), ("ta_",)], "name string")
    return catalog.alias_pairs(mapping, functions, "ta_")


@query(r"""SELECT contract, coalesce(try_cast(regexp_extract(contract, '@(\d+)\.(\d+)(\.\d+)?$', 1) AS INT) = 4 AND try_cast(regexp_extract(contract, '@(\d+)\.(\d+)(\.\d+)?$', 2) AS INT) <= 2, false) AS ok
FROM (SELECT unnest(['p@4.0.0', 'p@4.2', 'p@4.3.0', 'p@3.0.0', 'p@5.1.0', 'p']) AS contract)""")
def contract_gate(spark, sf_dir):
    rows = spark.createDataFrame([(c,) for c in ("p@4.0.0", "p@4.2", "p@4.3.0", "p@3.0.0", "p@5.1.0", "p")], "contract string")
    return rows.select("contract", contract.accepts_column(F.col("contract")).alias("ok"))


@query("SELECT count(*) AS n, min(range) AS first, max(range) AS last FROM (SELECT range FROM range(1034) ORDER BY range DESC LIMIT 1024)")
def events_ring(spark, sf_dir):
    bench = Workbench(spark)
    for i in range(1034):
        bench.event("tick", None, str(i))
    return bench.events().agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


# vectors, indexes, order ----------------------------------------------------------------------------------------


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: pow(CAST(embedding[i] AS DOUBLE) - (SELECT CAST(q.embedding[i] AS DOUBLE) FROM embeddings q WHERE q.vec_id = 0), 2)))), 5) AS distance FROM embeddings ORDER BY 2, 1 LIMIT 10".replace("(SELECT CAST(q.embedding[i] AS DOUBLE) FROM embeddings q WHERE q.vec_id = 0)", "CAST(qe[i] AS DOUBLE)").replace("FROM embeddings ORDER", "FROM embeddings, (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0) ORDER"))
def knn_topk(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").head().embedding
    found = vectors.VectorIndex(e, "vec_id", "embedding", len(q)).build().search(q, 10)
    return found.select("vec_id", r(F.col("distance"), 5).alias("distance"))


@query("""SELECT query_id, vec_id, round(d, 5) AS distance FROM (SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS place
FROM (SELECT q.vec_id AS query_id, e.vec_id, sqrt(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: pow(CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE), 2)))) AS d
FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)) WHERE place <= 10""")
def knn_topk_all(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    index = vectors.VectorIndex(e, "vec_id", "embedding", len(e.head().embedding)).build()
    found = index.search_all(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", 10)
    return found.select("query_id", "vec_id", r(F.col("distance"), 5).alias("distance"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 400")
def range_index_scan(spark, sf_dir):
    return vectors.range_scan(t(spark, sf_dir, "orders"), "o_orderkey", 100, 400).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def unique_check(spark, sf_dir):
    return vectors.duplicates(t(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT c_name, CAST(row_number() OVER (ORDER BY c_custkey) AS INT) AS place FROM customer")
def collation_sortkey(spark, sf_dir):
    name = F.concat(F.lit("Customer"), F.col("c_custkey").cast("string"))
    return vectors.numbered(t(spark, sf_dir, "customer"), vectors.natural_key(name), "place").select("c_name", F.col("place").cast("int"))


# sources and sinks ----------------------------------------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; a folder of this machine only where the session runs on it alone."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidState("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/loomkit-{uuid.uuid4().hex}/{name}"


@query("SELECT n_nationkey, n_name, n_regionkey, CAST(25 AS BIGINT) AS written FROM nation")
def copy_roundtrip(spark, sf_dir):
    path, df = scratch(spark, "nation.csv"), t(spark, sf_dir, "nation")
    written = copy.copy_to(df, path, "csv", header=True)
    return copy.copy_from(spark, path, df.schema, "csv", header=True).withColumn("written", F.lit(written).cast("long"))


@query("SELECT n_nationkey, upper(n_name) AS n_name FROM nation")
def replacement_scan(spark, sf_dir):
    bench, path = Workbench(spark), scratch(spark, "nation.shout")
    copy.copy_to(t(spark, sf_dir, "nation"), path)
    bench.replacement("shout", lambda s, p: s.read.parquet(p).withColumn("n_name", F.upper("n_name")))
    return bench.read(path).select("n_nationkey", "n_name")


# joins and sets -------------------------------------------------------------------------------------------------


@query("SELECT c.event_id, p.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type <> 'click' GROUP BY 1, 2) p ON c.user_id = p.user_id AND c.ts >= p.ts")
def join_asof_events(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    found = joins.asof(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type <> 'click'").select("user_id", "ts", "value"), "ts", ["user_id"], "value", "last_value")
    return found.select("event_id", "last_value")


@query("SELECT l.l_orderkey, l.l_linenumber, b.low AS band FROM lineitem l JOIN (SELECT CAST(range * 10.0 AS DOUBLE) AS low, CAST(range * 10.0 + 7 AS DOUBLE) AS high FROM range(6)) b ON l.l_quantity >= b.low AND l.l_quantity < b.high")
def join_ranges(spark, sf_dir):
    spans = spark.range(6).select((F.col("id") * 10.0).alias("low"), (F.col("id") * 10.0 + 7).alias("high"))
    found = joins.ranges(t(spark, sf_dir, "lineitem"), spans, "l_quantity", "low", "high", 10.0)
    return found.select("l_orderkey", "l_linenumber", F.col("low").alias("band"))


@query("SELECT c_custkey, 'semi' AS side FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) UNION ALL SELECT c_custkey, 'anti' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_anti(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    match = F.col("c_custkey") == F.col("o_custkey")
    semi = c.join(o.where("o_totalprice > 300000"), match, "left_semi").select("c_custkey", F.lit("semi").alias("side"))
    return semi.unionByName(c.join(o, match, "left_anti").select("c_custkey", F.lit("anti").alias("side")))


@query("SELECT r_name, n_name, count(c_custkey) AS n FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def join_kinds(spark, sf_dir):
    n = joins.if_small(t(spark, sf_dir, "nation"))
    reg = joins.if_small(t(spark, sf_dir, "region"))
    per = t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return n.join(reg, F.col("n_regionkey") == F.col("r_regionkey")).join(per, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("r_name", "n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT k, kind FROM (SELECT n_nationkey AS k, 'u' AS kind FROM nation UNION SELECT c_nationkey, 'u' FROM customer) UNION ALL (SELECT n_nationkey, 'i' FROM nation INTERSECT SELECT s_nationkey, 'i' FROM supplier) UNION ALL (SELECT n_nationkey, 'e' FROM nation EXCEPT SELECT r_regionkey, 'e' FROM region)")
def set_ops(spark, sf_dir):
    k = lambda name, c: t(spark, sf_dir, name).select(F.col(c).alias("k"))
    n = k("nation", "n_nationkey")
    parts = [("u", n.union(k("customer", "c_nationkey")).distinct()), ("i", n.intersect(k("supplier", "s_nationkey"))), ("e", n.subtract(k("region", "r_regionkey")))]
    return reduce(DataFrame.unionByName, (d.withColumn("kind", F.lit(kind)) for kind, d in parts))


# streams --------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2")
def tumbling_events(spark, sf_dir):
    d = windows.tumbling(t(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("s")])
    return d.select(F.col("window_start").cast("timestamp_ntz").alias("h"), "event_type", "n", "s")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessionize_events(spark, sf_dir):
    d = windows.sessions(t(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"], [F.count(F.lit(1)).alias("n")])
    return d.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1")
def stream_totals(spark, sf_dir):
    """The events table as a file stream, run to its end; the stream's state is the running totals."""
    schema = t(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").format("parquet").load(sf_dir)
    totals = stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    path = scratch(spark, "totals")
    write = lambda df, _: df.write.mode("overwrite").parquet(path)
    run = totals.writeStream.outputMode("complete").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return spark.read.parquet(path).select("event_type", "n", r(F.col("s"), 4).alias("s"))


@query("SELECT label, count(*) AS n FROM embeddings WHERE false GROUP BY 1")
def empty_table(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").where("false").groupBy("label").agg(F.count(F.lit(1)).alias("n"))

