"""Other names for functions that the session knows, aggregates included.

The alias shares the target's builder in the session's function registry, so DISTINCT, FILTER, OVER and inner orders work
as for the target. This is the only module that reaches into the session's JVM objects; it needs a classic session.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from loomkit.errors import InvalidArgument, InvalidState, Unsupported

SAFE = re.compile(r"[A-Za-z0-9_]+")


def checked(*names: str) -> None:
    for name in names:
        if not SAFE.fullmatch(name or ""):
            raise InvalidArgument(f"not an identifier: {name!r}")


class Aliases:
    def __init__(self, spark: SparkSession):
        if not hasattr(spark, "_jsparkSession"):
            raise Unsupported("aliases need a classic session")
        self.spark = spark
        self.registry = spark._jsparkSession.sessionState().functionRegistry()

    def _name(self, name: str, schema: str | None = None):
        jvm = self.spark._jvm
        ident = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        if schema is None:
            return ident(name)
        some = jvm.scala.Option.apply
        return ident(name, some(schema), some("spark_catalog"))

    def exists(self, name: str) -> bool:
        return self.registry.functionExists(self._name(name))

    def add(self, alias: str, target: str, schema: str | None = None) -> None:
        """alias (or schema.alias) for a function of the session."""
        checked(alias, target, *([schema] if schema else []))
        builder = self.registry.lookupFunctionBuilder(self._name(target))
        if builder.isEmpty():
            raise InvalidState(f"no function {target}")
        info = self.registry.lookupFunction(self._name(target)).get()
        if schema:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
            self.spark.sql(f"CREATE OR REPLACE FUNCTION `{schema}`.`{alias}` AS 'org.example.Placeholder'")
        self.registry.registerFunction(self._name(alias, schema), info, builder.get())

    def drop(self, alias: str, schema: str | None = None) -> None:
        """Takes an alias back; a schema's placeholder, by which SQL resolves names of two parts, goes too."""
        self.registry.dropFunction(self._name(alias, schema))
        if schema:
            self.spark.sql(f"DROP FUNCTION IF EXISTS `{schema}`.`{alias}`")
