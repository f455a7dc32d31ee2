"""Addresses and JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from loomkit.errors import InvalidArgument

#: Public suffixes of two labels that are told apart here (a short list; longer ones can be passed).
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "com.br", "co.nz", "co.in", "com.cn", "co.za", "com.mx")


def host(c: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def public_suffix(c: Column, suffixes: tuple = SUFFIXES) -> Column:
    h = host(c)
    two = F.substring_index(h, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(h, ".", -1))


def registrable_domain(c: Column, suffixes: tuple = SUFFIXES) -> Column:
    """The public suffix and the label before it; null for a host that is a suffix alone or has one label."""
    h, two = host(c), F.substring_index(host(c), ".", -2)
    n = F.when(two.isin(*suffixes), 3).otherwise(2)
    labels = F.split(h, r"\.")
    return F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), "."))


def domain_label(c: Column, suffixes: tuple = SUFFIXES) -> Column:
    return F.substring_index(registrable_domain(c, suffixes), ".", 1)


def subdomain(c: Column, suffixes: tuple = SUFFIXES) -> Column:
    """What stands before the registrable domain; empty if nothing does."""
    h, d = host(c), registrable_domain(c, suffixes)
    return F.when(d.isNotNull(), F.when(h == d, F.lit("")).otherwise(F.substr(h, F.lit(1), F.length(h) - F.length(d) - 1)))


def _pattern(pattern: str) -> tuple[str, list[str]]:
    names = re.findall(r":(\w+)", pattern)
    out = "".join("([^/]+)" if p.startswith(":") else ".*" if p == "*" else re.escape(p).replace("\\/", "/") for p in re.split(r"(:\w+|\*)", pattern))
    return f"^{out}$", names


def url_pattern_test(c: Column, pattern: str) -> Column:
    """Whether a path has the form of a pattern with :names (one part) and * (anything)."""
    return c.rlike(_pattern(pattern)[0])


def url_pattern_match(c: Column, pattern: str) -> Column:
    """The named parts as a map; null where the pattern doesn't fit."""
    regex, names = _pattern(pattern)
    if not names:
        raise InvalidArgument("the pattern has no names")
    pairs = [x for i, n in enumerate(names, 1) for x in (F.lit(n), F.regexp_extract(c, regex, i))]
    return F.when(c.rlike(regex), F.create_map(*pairs))


@pandas_udf(T.StringType())
def _yaml(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else _to_yaml(json.loads(t)).rstrip("\n"))


def _to_yaml(x, depth: int = 0) -> str:
    pad = "  " * depth
    if isinstance(x, dict) and x:
        return "".join(f"{pad}{k}:" + (f"\n{_to_yaml(v, depth + 1)}" if isinstance(v, (dict, list)) and v else f" {_to_yaml(v)}") for k, v in x.items())
    if isinstance(x, list) and x:
        return "".join(f"{pad}- {_to_yaml(v)}" if not (isinstance(v, (dict, list)) and v) else f"{pad}-\n{_to_yaml(v, depth + 1)}" for v in x)
    return json.dumps(x, ensure_ascii=False) + "\n"


def json_to_yaml(c: Column) -> Column:
    """Block style, scalars as JSON writes them (which YAML reads); runs in Python."""
    return _yaml(c)


def json_schema_errors(c: Column, schema: dict) -> Column:
    """An array of what is wrong with a JSON text under a schema: type, required, properties, items, enum, bounds. In Python."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}

    def check(x, s: dict, at: str) -> list[str]:
        out, kind = [], s.get("type")
        number = isinstance(x, (int, float)) and not isinstance(x, bool)
        ok = {"integer": number and float(x).is_integer(), "number": number}.get(kind, isinstance(x, kinds[kind]) if kind in kinds else True)
        if not ok:
            return [f"{at}: not of type {kind}"]
        if "enum" in s and x not in s["enum"]:
            out.append(f"{at}: not one of the allowed values")
        if number and x < s.get("minimum", x):
            out.append(f"{at}: under {s['minimum']}")
        if number and x > s.get("maximum", x):
            out.append(f"{at}: over {s['maximum']}")
        if isinstance(x, dict):
            out += [f"{at}: {k} is missing" for k in s.get("required", ()) if k not in x]
            out += [e for k, t in s.get("properties", {}).items() if k in x for e in check(x[k], t, f"{at}.{k}")]
        if isinstance(x, list) and "items" in s:
            out += [e for i, v in enumerate(x) for e in check(v, s["items"], f"{at}[{i}]")]
        return out

    @pandas_udf(T.ArrayType(T.StringType()))
    def run(c: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str] | None:
            if t is None:
                return None
            try:
                return check(json.loads(t), schema, "$")
            except ValueError:
                return ["$: not JSON"]

        return c.map(one)

    return run(c)


def json_schema_valid(c: Column, schema: dict) -> Column:
    return F.size(json_schema_errors(c, schema)) == 0
