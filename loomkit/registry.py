"""A workbench: what modules register with a session, and the calls that users make.

    bench = Workbench(spark)
    bench.load(MyModule())            # registers what the module declares
    spark.sql("SELECT twice(x) FROM t")
"""

from __future__ import annotations

import functools
import importlib.util
import logging
import operator
import os
import re
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomkit import __version__
from loomkit.alias import Aliases, checked
from loomkit.errors import InvalidArgument, InvalidState, Io, Unsupported
from loomkit.plans.contract import accepts
from loomkit.plans.search import WEIGHTS
from loomkit.types import cast_to, enum_ordinal, spark_type

#: Events that are kept.
EVENTS = 1024
CAPABILITIES = ("scalar", "table", "aggregate", "pragma", "macro", "cast", "type", "setting", "copy", "replacement", "arrow", "log")


class Record(NamedTuple):
    handle: int
    module: str
    kind: str
    name: str
    arguments: tuple = ()
    returns: str = ""
    flags: tuple = ()


class Setting(NamedTuple):
    name: str
    description: str
    kind: str
    default: str | None
    changed: Callable[[str, Any], None] | None = None


class Module:
    """A module says what it is and registers its functions in load(bench)."""

    name, version, requires, contract = "module", "0.0.0", (), None

    def load(self, bench: Workbench) -> None:
        raise NotImplementedError

    def reconfigure(self, keys: list[str]) -> None:
        pass

    def shutdown(self) -> None:
        pass


def null_safe(build: Callable[..., Column]) -> Callable[..., Column]:
    """The default rule: any null argument gives null, and the function isn't asked."""

    def call(*args: Column) -> Column:
        if not args:
            return build()
        missing = args[0].isNull()
        for a in args[1:]:
            missing = missing | a.isNull()
        return F.when(~missing, build(*args))

    return call


class Workbench:
    def __init__(self, spark: SparkSession):
        self.spark, self.aliases = spark, Aliases(spark)
        self.records: dict[int, Record] = {}
        self.modules: dict[str, Module] = {}
        self.columns: dict[str, Callable[..., Column]] = {}
        self.aggregates: dict[str, Callable[..., Column]] = {}
        self.pragmas: dict[str, Callable[..., str]] = {}
        self.settings: dict[str, Setting] = {}
        self.types: dict[str, str] = {}
        self.enums: dict[str, list[str]] = {}
        self.casts: dict[tuple[str, str], tuple[Callable[[Column], Column], str, int]] = {}
        self.readers: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.writers: dict[str, Callable[[DataFrame, str, dict], int]] = {}
        self.sinks: dict[str, Callable[[Row], None]] = {}
        self.ring: deque = deque(maxlen=EVENTS)
        self._next, self._seq, self._owner = 1, 0, "session"

    # what happens ----------------------------------------------------------------------------------------------

    def event(self, kind: str, module: str | None = None, detail: str = "") -> None:
        """Noted with a number that goes on when old events leave."""
        self.ring.append((self._seq, time.time_ns() // 1000, kind, module, detail))
        self._seq += 1

    def events(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.ring), "seq long, ts_micros long, kind string, module string, detail string")

    def _record(self, kind: str, name: str, arguments: Iterable = (), returns: str = "", flags: Iterable = ()) -> int:
        handle, self._next = self._next, self._next + 1
        self.records[handle] = Record(handle, self._owner, kind, name, tuple(arguments), returns, tuple(flags))
        self.event("register", self._owner, f"{kind} {name}")
        return handle

    # modules ---------------------------------------------------------------------------------------------------

    def load(self, module: Module) -> DataFrame:
        """Registers what the module declares; again: nothing changes. Returns name, version and the number of functions."""
        if TaskContext.get() is not None:
            raise InvalidState("modules are loaded on the driver")
        if module.name not in self.modules:
            if module.contract and not accepts(module.contract):
                raise Unsupported(f"{module.name} needs contract {module.contract}")
            if missing := [r for r in module.requires if r not in self.modules]:
                raise InvalidState(f"{module.name} needs {', '.join(missing)}")
            self._owner = module.name
            try:
                module.load(self)
            except Exception:
                self.forget(module.name)
                raise
            finally:
                self._owner = "session"
            self.modules[module.name] = module
            self.event("load", module.name, module.version)
        count = sum(r.module == module.name for r in self.records.values())
        return self.spark.createDataFrame([(module.name, module.version, count)], "name string, version string, registered long")

    def forget(self, name: str) -> None:
        """Shuts a module down and drops all that it registered, SQL functions included; its handles are not used again."""
        if module := self.modules.pop(name, None):
            module.shutdown()
        held = {"column": self.columns, "aggregate": self.aggregates, "pragma": self.pragmas, "setting": self.settings, "replacement": self.readers, "log sink": self.sinks}
        for handle in [h for h, r in self.records.items() if r.module == name]:
            r = self.records.pop(handle)
            if r.kind in ("scalar", "table", "macro", "table macro"):
                self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {r.name}")
            elif r.kind == "alias":
                schema, _, alias = r.name.rpartition(".")
                self.aliases.drop(alias)
                if schema:
                    self.aliases.drop(alias, schema)
            elif r.kind == "cast":
                self.casts.pop(tuple(x.strip().lower() for x in r.name.split("->")), None)
            elif r.kind in ("type", "enum"):
                self.types.pop(r.name.lower(), None)
                self.enums.pop(r.name, None)
            elif r.kind in held:
                held[r.kind].pop(r.name.lower().lstrip(".") if r.kind == "replacement" else r.name, None)
        self.event("unload", name)

    def reconfigure(self, keys: list[str]) -> None:
        for module in self.modules.values():
            module.reconfigure(keys)

    def functions(self) -> DataFrame:
        rows = [(r.handle, r.module, r.kind, r.name, list(map(str, r.arguments)), r.returns, list(r.flags)) for r in self.records.values()]
        return self.spark.createDataFrame(rows, "handle long, module string, kind string, name string, arguments array<string>, returns string, flags array<string>")

    # functions -------------------------------------------------------------------------------------------------

    def scalar(self, name: str, body: str, arguments: dict[str, str], returns: str, nulls: str = "default", deterministic: bool = True) -> int:
        """A SQL expression over its arguments, inlined by the optimizer. nulls: "default" (any null gives null) or "special"."""
        checked(name, *arguments)
        ddl = lambda t: spark_type(t, self.types).simpleString()
        if nulls == "default" and arguments:
            body = f"CASE WHEN {' AND '.join(f'{a} IS NOT NULL' for a in arguments)} THEN {body} END"
        params = ", ".join(f"{a} {ddl(t)}" for a, t in arguments.items())
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ddl(returns)} {'' if deterministic else 'NOT DETERMINISTIC'} RETURN CAST({body} AS {ddl(returns)})")
        return self._record("scalar", name, arguments.items(), returns, () if deterministic else ("volatile",))

    def column(self, name: str, build: Callable[..., Column], nulls: str = "default") -> int:
        """A function over Columns, for bench.call(name, ...)."""
        self.columns[name] = null_safe(build) if nulls == "default" else build
        return self._record("column", name)

    def call(self, name: str, *args: Column) -> Column:
        if name not in self.columns:
            raise InvalidState(f"no function {name}")
        return self.columns[name](*args)

    def python(self, name: str, fn: Callable, returns: str, nulls: str = "default", options: dict | None = None) -> int:
        """A vectorized Python function (pandas Series in, Series out). Volatile if options are given without deterministic."""
        import pandas as pd

        kept = fn
        if nulls == "default":

            def kept(*series: pd.Series) -> pd.Series:
                there = ~functools.reduce(operator.or_, (s.isna().to_numpy() for s in series))
                if there.all():  # as most batches are
                    return pd.Series(fn(*series))
                out = pd.Series([None] * len(there), dtype=object)
                if there.any():
                    out[there] = list(fn(*(s[there] for s in series)))
                return out

        kept.__annotations__ = {}
        udf = F.pandas_udf(kept, spark_type(returns, self.types), F.PandasUDFType.SCALAR)
        volatile = options is not None and not options.get("deterministic", False)
        self.spark.udf.register(name, udf.asNondeterministic() if volatile else udf)
        return self._record("scalar", name, returns=returns, flags=("volatile",) if volatile else ())

    def table(self, name: str, udtf) -> int:
        """A Python UDTF (decorated with pyspark.sql.functions.udtf)."""
        checked(name)
        self.spark.udtf.register(name, udtf)
        return self._record("table", name)

    def aggregate(self, name: str, build: Callable[..., Column]) -> int:
        """An aggregate over Columns (see operators.aggregates), for bench.agg(name, ...)."""
        self.aggregates[name] = build
        return self._record("aggregate", name)

    def agg(self, name: str, *args, **modifiers) -> Column:
        if name not in self.aggregates:
            raise InvalidState(f"no aggregate {name}")
        return self.aggregates[name](*args, **modifiers)

    def alias(self, alias: str, target: str, namespace: str | None = None) -> int:
        """alias for a function of the session, and namespace.alias too; that one may stand for one target only."""
        name = f"{namespace}.{alias}"
        if namespace and any(r.kind == "alias" and r.name == name and r.arguments != (target,) for r in self.records.values()):
            raise InvalidState(f"{name} already stands for another function")
        self.aliases.add(alias, target)
        if namespace:
            self.aliases.add(alias, target, namespace)
        return self._record("alias", f"{namespace}.{alias}" if namespace else alias, (target,))

    def macro(self, name: str, arguments: dict[str, str], body: str) -> int:
        """A scalar macro; "name type" arguments may carry defaults in their type text."""
        checked(name, *arguments)
        params = ", ".join(f"{a} {t}" for a, t in arguments.items())
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURN {body}")
        return self._record("macro", name, arguments.items())

    def table_macro(self, name: str, arguments: dict[str, str], columns: dict[str, str], body: str) -> int:
        checked(name, *arguments)
        params = ", ".join(f"{a} {t}" for a, t in arguments.items())
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS TABLE({', '.join(f'{a} {t}' for a, t in columns.items())}) RETURN {body}")
        return self._record("table macro", name, arguments.items())

    # types and casts -------------------------------------------------------------------------------------------

    def type_alias(self, name: str, physical: str) -> int:
        checked(name)
        spark_type(physical, self.types)
        self.types[name.lower()] = physical
        return self._record("type", name, returns=physical)

    def enum(self, name: str, members: list[str]) -> int:
        if len(set(members)) < len(members) or not members:
            raise InvalidArgument("an enum has different members, at least one")
        self.enums[name] = members
        self.types[name.lower()] = "text"
        return self._record("enum", name, members)

    def enum_order(self, name: str, c: Column) -> Column:
        return enum_ordinal(c, self.enums[name])

    def cast(self, source: str, target: str, build: Callable[[Column], Column], kind: str = "explicit", cost: int | None = None) -> int:
        """A cast for bench.convert. cost: none is 100, -1 makes it explicit whatever the kind."""
        if kind not in ("implicit", "assignment", "explicit"):
            raise InvalidArgument(f"unknown kind of cast: {kind}")
        cost = 100 if cost is None else cost
        self.casts[source.lower(), target.lower()] = (null_safe(build), "explicit" if cost == -1 else kind, cost)
        return self._record("cast", f"{source} -> {target}")

    def convert(self, c: Column, source: str, target: str) -> Column:
        found = self.casts.get((source.lower(), target.lower()))
        return found[0](c) if found else cast_to(c, target, self.types)

    # settings, pragmas, log sinks ------------------------------------------------------------------------------

    def setting(self, name: str, description: str, kind: str, default: str | None, changed: Callable | None = None) -> int:
        if kind not in ("boolean", "varchar", "bigint", "double"):
            raise InvalidArgument(f"unknown kind of setting: {kind}")
        self.settings[name] = Setting(name, description, kind, default, changed)
        return self._record("setting", name, returns=kind)

    def option(self, name: str) -> Any:
        """A setting's value, of its kind; its default if it isn't set."""
        s = self.settings[name]
        text = self.spark.conf.get(f"loomkit.{name}", s.default)
        if text is None:
            return None
        if s.kind == "boolean":
            if text.lower() not in ("true", "false"):
                raise InvalidArgument(f"{name} is true or false")
            return text.lower() == "true"
        return {"varchar": str, "bigint": int, "double": float}[s.kind](text)

    def set_option(self, name: str, value: Any) -> None:
        before = self.spark.conf.get(f"loomkit.{name}", None)
        self.spark.conf.set(f"loomkit.{name}", str(value).lower() if isinstance(value, bool) else str(value))
        try:
            checked_value = self.option(name)
        except ValueError:
            self.spark.conf.unset(f"loomkit.{name}") if before is None else self.spark.conf.set(f"loomkit.{name}", before)
            raise
        if self.settings[name].changed:
            self.settings[name].changed(name, checked_value)
        self.event("setting", None, name)

    def config(self, key: str, kind: Callable[[str], Any] = str) -> Any:
        """A value of the session's configuration; None if it is absent."""
        text = self.spark.conf.get(key, None)
        return None if text is None else [p.strip() for p in text.split(",")] if kind is list else kind(text)

    def pragma(self, name: str, handler: Callable[..., str]) -> int:
        self.pragmas[name] = handler
        return self._record("pragma", name)

    def run_pragma(self, name: str, *args) -> DataFrame | None:
        """Runs the statements that the handler gives, and returns the last one's result."""
        if name not in self.pragmas:
            raise InvalidState(f"no pragma {name}")
        out = None
        for statement in re.split(r";\s*(?:\n|$)", self.pragmas[name](*args)):
            if statement.strip():
                out = self.spark.sql(statement)
        return out

    def log_sink(self, name: str, take: Callable[[Row], None]) -> int:
        self.sinks[name] = take
        return self._record("log sink", name)

    def log_handler(self, name: str) -> logging.Handler:
        take = self.sinks[name]

        class Handler(logging.Handler):
            def emit(self, record: logging.LogRecord) -> None:
                take(Row(level=record.levelname, message=record.getMessage(), tags=getattr(record, "tags", None), ts_micros=int(record.created * 1e6)))

        return Handler()

    # files -----------------------------------------------------------------------------------------------------

    def replacement(self, suffix: str, reader: Callable[[SparkSession, str], DataFrame]) -> int:
        self.readers[suffix.lower().lstrip(".")] = reader
        return self._record("replacement", suffix)

    def read(self, path: str) -> DataFrame:
        """The reader of the path's suffix; an unknown one is an error."""
        suffix = path.rstrip("/").rpartition(".")[2].lower()
        if suffix in self.readers:
            return self.readers[suffix](self.spark, path)
        if suffix in ("parquet", "orc", "json", "csv"):
            return self.spark.read.options(**({"header": "true"} if suffix == "csv" else {})).format(suffix).load(path)
        raise Unsupported(f"no reader for {path}")

    # live queries and start ------------------------------------------------------------------------------------

    def query(self, sql: str) -> list[list[str]]:
        """Rows as text, null as empty text, all at once: for small results; query_rows() takes any."""
        return list(self.query_rows(sql))

    def query_rows(self, sql: str) -> Iterator[list[str]]:
        """The same, with a partition at a time on the driver. Only the driver may ask."""
        if TaskContext.get() is not None:
            raise InvalidState("a task can't run queries")
        df = self.spark.sql(sql)
        rows = df.select(*(F.col(f"`{c}`").cast("string") for c in df.columns)).toLocalIterator()
        return (["" if v is None else v for v in row] for row in rows)

    def version(self) -> str:
        return f"loomkit {__version__}"

    def preload(self, text: str | None = None) -> list[str]:
        """Loads the modules that preloads() names: Python files whose Module subclasses are loaded in their order."""
        for name, path in preloads(text):
            found = importlib.util.spec_from_file_location(f"loomkit_preload_{name}", path)
            if found is None or not os.path.exists(path):
                raise Io(f"no module at {path}")
            code = importlib.util.module_from_spec(found)
            found.loader.exec_module(code)
            for kind in [v for v in vars(code).values() if isinstance(v, type) and issubclass(v, Module) and v.__module__ == code.__name__]:
                self.load(kind())
        return list(self.modules)

    def sql_functions(self, docs: DataFrame) -> None:
        """loom_version(), loom_help(name) and loom_search(query) for SQL, over docs (see plans.catalog.docs)."""
        docs.createOrReplaceTempView("loom_docs")
        self.scalar("loom_version", f"'{self.version()}'", {}, "VARCHAR")
        hit = " + ".join(f"{weight} * cast(contains(lower(coalesce({field}, '')), w) AS bigint)" for field, weight in WEIGHTS.items())
        columns = {"module": "STRING", "function": "STRING", "summary": "STRING", "score": "BIGINT"}
        score = f"aggregate(filter(split(lower(loom_search.query), ' '), w -> w <> ''), 0L, (a, w) -> a + {hit})"
        self.table_macro("loom_search", {"query": "STRING"}, columns, f"SELECT * FROM (SELECT module, function, summary, {score} AS score FROM loom_docs) WHERE score > 0")
        part = lambda c: f"nullif({c}, '')"
        self.table_macro("loom_help", {"name": "STRING"}, {"help": "STRING"}, f"SELECT concat_ws('\\n\\n', '## ' || signature, {part('summary')}, {part('description')}) FROM loom_docs WHERE function = loom_help.name OR module = loom_help.name")


def preloads(text: str | None = None) -> list[tuple[str, str]]:
    """name and path of modules to load at start: `name=path` or `path`, separated by colons."""
    text = os.environ.get("LOOMKIT_PRELOAD", "") if text is None else text
    out = []
    for part in filter(None, text.split(":")):
        name, eq, path = part.partition("=")
        out.append((name, path) if eq else (os.path.splitext(os.path.basename(part))[0], part))
    return out
