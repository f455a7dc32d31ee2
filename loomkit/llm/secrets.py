"""Secrets in texts, found by one automaton for all rules in a single pass over their bytes.

The combined automaton says after which bytes some rule's match ends. A match's start is found by the rule's own automaton
read backwards from there, as far left as it goes but not into the rule's match before, and its end by the forward one,
as far right as it goes: the leftmost longest matches that don't overlap, for each rule by itself.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.llm.automata import Scanner, combined, compiled
from loomkit.llm.common import annotate, named


class Rule(NamedTuple):
    kind: str
    pattern: str
    head: str = ""  # of a match; what follows it must have `least` characters, else the match counts for nothing
    least: int = 0


#: The rules' patterns (fixed values): the first three are the base ones. Long least lengths are checked on the match, as
#: counting them would multiply the automaton's states.
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
RULES = [
    Rule("assign", ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+", ASSIGN_HEAD, 12),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA", 14),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]+", r"gh[opsru]_", 36),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-", 10),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY( BLOCK)?-----"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", r"[rs]k_(live|test)_", 16),
    Rule("npm", r"npm_[A-Za-z0-9]+", r"npm_", 36),
]
BASE = ("assign", "access", "hex")
#: Bytes of texts that are scanned together.
BLOCK = 4 << 20
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

Span = tuple[str, int, int]
_detectors: dict[tuple, Detector] = {}


class Detector:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.scanner = Scanner(combined([r.pattern for r in rules]))
        self.forward = [compiled(r.pattern) for r in rules]
        self.backward = [compiled(r.pattern, backward=True) for r in rules]
        self.heads = [compiled(r.head) if r.head else None for r in rules]

    def scan(self, texts: list[str | None]) -> list[list[Span]]:
        """For each text its spans (code points, end exclusive), by start and then the order of the rules."""
        out: list[list[Span]] = []
        block, size = [], 0
        for text in texts:
            block.append(text.encode() if text else b"")
            size += len(block[-1])
            if size >= BLOCK:
                out += self.block(block)
                block, size = [], 0
        return out + self.block(block)

    def block(self, datas: list[bytes]) -> list[list[Span]]:
        places, bits = self.scanner.ends(b"".join(d + b"\n" for d in datas))
        edges = np.cumsum([0, *(len(d) + 1 for d in datas)])
        cuts = np.searchsorted(places, edges)
        out = []
        for i, data in enumerate(datas):
            a, b = cuts[i], cuts[i + 1]
            out.append(self.spans(data, places[a:b] - edges[i], bits[a:b]) if b > a else [])
        return out

    def spans(self, data: bytes, places: np.ndarray, bits: np.ndarray) -> list[Span]:
        found = []
        for k, rule in enumerate(self.rules):
            ends, low, i = (places[(bits >> k) & 1 == 1] + 1).tolist(), 0, 0
            while i < len(ends):
                back = self.backward[k].run(data[low : ends[i]], backward=True)
                if back < 0:  # it would begin within the match before
                    i += 1
                    continue
                start = ends[i] - back
                size = self.forward[k].run(memoryview(data)[start:])
                low = start + size
                if not rule.head or size - self.heads[k].run(data[start:low]) >= rule.least:
                    found.append((start, k, low))
                i = bisect_right(ends, low)
        if not found:
            return []
        found.sort()
        points = sorted({p for s, _, e in found for p in (s, e)})
        at, chars, before = {}, 0, 0
        for p in points:
            chars += len(data[before:p].decode())
            at[p], before = chars, p
        return [(self.rules[k].kind, at[s], at[e]) for s, k, e in found]


def detector(rules: list[Rule]) -> Detector:
    key = tuple(rules)
    if key not in _detectors:
        _detectors[key] = Detector(rules)
    return _detectors[key]


def find_secrets(df: DataFrame, rules: list[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """df with secrets: an array of (kind, start, end) in code points, end exclusive, by start and the rules' order.

    A null or empty text has none; very long ones are scanned whole. Rows are kept one for one; a column of df named secrets,
    in whatever case, is replaced. One map, no shuffle; the automaton is built once and broadcast (its size depends on the
    rules alone).
    """
    spread = df.sparkSession.sparkContext.broadcast(detector(list(rules)))
    fields = [f.name for f in SPANS.elementType]

    def make():
        return lambda texts: [([dict(zip(fields, s)) for s in spans],) for spans in spread.value.scan(texts)]

    return annotate(df, text_col, make, T.StructType([T.StructField("secrets", SPANS)]))


def redact(df: DataFrame, rules: list[Rule] = RULES, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """df with each maximal run of secret characters replaced by mark; other columns as they are, nulls and empty texts too."""
    spread = df.sparkSession.sparkContext.broadcast(detector(list(rules)))

    def make():
        def one(text: str | None, spans: list[Span]) -> tuple:
            if not spans:
                return (text,)
            out, at = [], 0
            for _, start, end in spans:
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, end)
            return ("".join(out) + text[at:],)

        return lambda texts: [one(t, s) for t, s in zip(texts, spread.value.scan(texts))]

    return annotate(df, text_col, make, T.StructType([T.StructField(text_col, T.StringType())])).select(*map(named, df.columns))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the hash of their spans, and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(of(*BASE)), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def base_sha256(spans: list[Span]) -> str:
    """The hash that digest() gives, of a list of spans."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in BASE).encode()).hexdigest()
