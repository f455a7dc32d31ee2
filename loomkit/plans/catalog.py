"""The catalog of modules: JSON read with a fixed schema, and what is chosen from it, as DataFrames.

Unknown fields are ignored, absent lists are empty, values of a wrong kind are null.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkit.errors import InvalidArgument, Io
from loomkit.plans.contract import MAJOR, major_of

SCHEMA = """extensions array<struct<name string, version string, description string, categories array<string>, exports array<string>,
requires array<string>, crates array<string>, content_digest string, wit_contract_version string, namespace string, prefix string,
providers array<struct<id string, kind string, abi string, content_digest string, status string, platform string, duckdb_version string,
url string, extension_name string, community_prefix string, function_mapping map<string,string>>>,
functions array<struct<name string, kind string, returns string, arguments array<struct<name string, type string>>,
columns array<struct<name string, type string>>, summary string, description string, example string, tags array<string>>>>>"""
SAFE = "^[A-Za-z0-9_]+$"


def parse(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row per module of catalog texts."""
    rows = texts.select(F.explode(F.from_json(column, f"struct<{SCHEMA.replace('extensions array', 'extensions: array', 1)}>")["extensions"]).alias("m")).select("m.*")
    empty = lambda name: F.coalesce(name, F.array().cast(rows.schema[name].dataType)).alias(name)
    return rows.withColumns({n: empty(n) for n in ("providers", "functions", "exports", "requires", "categories", "crates")})


def of_json(spark: SparkSession, text: str) -> DataFrame:
    return parse(spark.createDataFrame([(text,)], "value string"))


def modules(catalog: DataFrame, loaded: list[str] = ()) -> DataFrame:
    has = lambda kind: F.exists("functions", lambda f: f["kind"] == kind)
    return catalog.select("name", "version", "description", "categories", "exports", "requires", F.col("name").isin(list(loaded)).alias("loaded"), F.when(F.size("crates") > 0, F.lit("rust")).alias("language"), has("scalar").alias("scalars"), has("table").alias("tables"), has("aggregate").alias("aggregates"), F.exists("providers", lambda p: p["kind"].isin("native", "community-native")).alias("native_available"))


def docs(catalog: DataFrame) -> DataFrame:
    """One row per documented function; nameless ones are left out."""
    rows = catalog.select(F.col("name").alias("module"), F.explode("functions").alias("f")).where(F.coalesce(F.trim("f.name"), F.lit("")) != "")
    return rows.select("module", F.col("f.name").alias("function"), signature(F.col("f")).alias("signature"), "f.summary", "f.description", "f.example", F.array_join("f.tags", ",").alias("tags"))


def signature(f: Column) -> Column:
    """name(arg T, ...) -> R, and name(arg T, ...) TABLE(col T, ...) for tables."""
    listed = lambda items: F.array_join(F.transform(F.coalesce(items, F.array().cast("array<struct<name:string,type:string>>")), lambda a: F.concat_ws(" ", a["name"], a["type"])), ", ")
    head = F.concat(f["name"], F.lit("("), listed(f["arguments"]), F.lit(")"))
    return F.when(f["kind"] == "table", F.concat(head, F.lit(" TABLE("), listed(f["columns"]), F.lit(")"))).otherwise(F.concat(head, F.lit(" -> "), F.coalesce(f["returns"], F.lit("?"))))


def overlay(known: DataFrame, own: DataFrame) -> DataFrame:
    """Docs of the catalog with those that modules bring: the modules' fields win, tags are united."""
    both = known.alias("k").join(own.alias("o"), ["module", "function"], "full")
    fields = [F.coalesce(F.col(f"o.{c}"), F.col(f"k.{c}")).alias(c) for c in ("signature", "summary", "description", "example")]
    split = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda t: t != "")
    return both.select("module", "function", *fields, F.array_join(F.array_union(split("o.tags"), split("k.tags")), ",").alias("tags"))


def providers(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.col("name").alias("module"), "content_digest", "wit_contract_version", F.posexplode_outer("providers").alias("place", "p"))


def digests(catalog: DataFrame, host: int = MAJOR) -> DataFrame:
    """The provider to load and its digest: the first wasm one with a digest and the host's major version, else the module's own digest if its generation is the host's, else none."""
    fits = lambda p: (p["kind"] == "wasm") & p["content_digest"].isNotNull() & (major_of(p["abi"]) == host)
    first = F.get(F.filter("providers", fits), F.lit(0))
    own = F.when(major_of(F.concat(F.lit("@"), F.regexp_replace("wit_contract_version", "^.*@", ""))) == host, F.col("content_digest"))
    return catalog.select(F.col("name").alias("module"), first["id"].alias("provider"), F.coalesce(first["content_digest"], own).alias("digest"))


def natives(catalog: DataFrame, platform: str, version: str) -> DataFrame:
    """The native provider: the first community one with an extension name, else one for exactly this platform and version, else none."""
    community = F.get(F.filter("providers", lambda p: (p["kind"] == "community-native") & p["extension_name"].isNotNull()), F.lit(0))
    exact = F.get(F.filter("providers", lambda p: (p["kind"] == "native") & (p["platform"] == platform) & (p["duckdb_version"] == version)), F.lit(0))
    return catalog.select(F.col("name").alias("module"), F.coalesce(community["id"], exact["id"]).alias("provider"), F.when(community["id"].isNotNull(), "community").when(exact["id"].isNotNull(), "native").alias("kind"))


def alias_pairs(mapping: DataFrame, functions: DataFrame, prefix: str) -> DataFrame:
    """alias and target: the mapping's (alias, target) first, then functions without their prefix, unless they are mapped or the name isn't safe. In order."""
    safe = mapping.where(F.col("alias").rlike(SAFE) & F.col("target").rlike(SAFE)).select(F.lit(0).alias("step"), "alias", "target")
    stripped = F.substr(F.col("name"), F.lit(len(prefix) + 1))
    rest = functions.where(F.startswith("name", F.lit(prefix)) if prefix else F.lit(False)).select(F.lit(1).alias("step"), stripped.alias("alias"), F.col("name").alias("target"))
    rest = rest.where(F.col("alias").rlike(SAFE) & F.col("target").rlike(SAFE)).join(mapping, "target", "left_anti").select("step", "alias", "target")
    return safe.unionByName(rest).orderBy("step", "alias").select("alias", "target")


def views(spark: SparkSession, catalog: DataFrame, bench, cache_dir: str, prefixes: DataFrame) -> dict[str, DataFrame]:
    """The discovery views by name, registered as temporary views with the prefix loom_."""
    files = [(f, os.path.getsize(os.path.join(cache_dir, f))) for f in sorted(os.listdir(cache_dir))] if os.path.isdir(cache_dir) else []
    found = {
        "modules": modules(catalog, list(bench.modules)), "functions": bench.functions(), "docs": docs(catalog), "events": bench.events(), "prefixes": prefixes,
        "host": spark.createDataFrame([(bench.version(), spark.version, MAJOR)], "version string, engine string, contract_major int"),
        "host_capabilities": spark.createDataFrame([(c,) for c in bench_capabilities()], "capability string"),
        "cache": spark.createDataFrame(files, "digest string, size long"),
        "module_compatibility": digests(catalog).withColumn("compatible", F.col("digest").isNotNull()),
    }
    for name, df in found.items():
        df.createOrReplaceTempView(f"loom_{name}")
    return found


def bench_capabilities() -> tuple:
    from loomkit.registry import CAPABILITIES

    return CAPABILITIES


class Prefixes:
    """Short names of namespaces, kept in a Parquet folder of any file system and declared again after a restart.

    A declaration is appended with its time and the latest one of an alias counts, so none is ever half written. Declaring
    twice changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        try:
            rows = self.spark.read.schema("alias string, namespace string, at long").parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "alias string, namespace string")
        return rows.groupBy("alias").agg(F.max_by("namespace", "at").alias("namespace"))

    def declare(self, bench, alias: str, namespace: str, functions: dict[str, str]) -> DataFrame:
        """alias.f for each function f of a namespace (name: target); returns alias, namespace and how many there are."""
        from loomkit.alias import checked

        checked(alias, namespace)
        for name, target in functions.items():
            bench.aliases.add(name, target, alias)
        if self.table().where((F.col("alias") == alias) & (F.col("namespace") == namespace)).isEmpty():
            row = self.spark.createDataFrame([(alias, namespace, time.time_ns())], "alias string, namespace string, at long")
            row.coalesce(1).write.mode("append").parquet(self.path)
        bench.event("prefix", None, f"{alias} = {namespace}")
        return self.spark.createDataFrame([(alias, namespace, len(functions))], "alias string, namespace string, macros long")

    def replay(self, bench, namespaces: dict[str, dict[str, str]]) -> int:
        found = [r for r in self.table().collect() if r.namespace in namespaces]
        for r in found:
            for name, target in namespaces[r.namespace].items():
                bench.aliases.add(name, target, r.alias)
        return len(found)


def cached(source: str, digest: str, cache_dir: str) -> str:
    """The path of a local file's copy by its SHA-256; a file with another digest is never kept."""
    if not all(c in "0123456789abcdef" for c in digest) or len(digest) != 64:
        raise InvalidArgument("a digest is 64 hexadecimal digits")
    path = os.path.join(cache_dir, digest)
    if os.path.exists(path) and _sha256(path) == digest:
        return path
    os.makedirs(cache_dir, exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    try:
        shutil.copyfile(source, part)
        if _sha256(part) != digest:
            raise Io(f"{source} doesn't have the digest {digest}")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return path


def _sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
