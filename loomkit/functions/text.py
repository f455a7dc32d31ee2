"""Text: ciphers, slugs, distances, templates, markup."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

LOWER = "abcdefghijklmnopqrstuvwxyz"


def rot13(c: Column) -> Column:
    turned = LOWER[13:] + LOWER[:13]
    return F.translate(c, LOWER + LOWER.upper(), turned + turned.upper())


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def indel(a: Column, b: Column) -> Column:
    """Insertions and deletions from a to b: lengths less twice the longest common subsequence (row by row, in arrays)."""
    xs, ys = F.split(a, ""), F.split(b, "")
    zero = F.transform(F.concat(F.array(F.lit("")), ys), lambda _: F.lit(0))

    def row(above: Column, x: Column) -> Column:
        cell = lambda done, i: F.concat(done, F.array(F.when(F.element_at(ys, i) == x, F.element_at(above, i) + 1).otherwise(F.greatest(F.element_at(above, i + 1), F.element_at(done, -1)))))
        return F.aggregate(F.sequence(F.lit(1), F.size(ys)), F.array(F.lit(0)), cell)

    common = F.element_at(F.aggregate(xs, zero, row), -1)
    n, m = F.length(a), F.length(b)
    return F.when(a.isNull() | b.isNull(), None).when((n == 0) | (m == 0), n + m).otherwise(n + m - 2 * common)


def fuzz_ratio(a: Column, b: Column) -> Column:
    """100 (1 - indel / total length); 100 for two empty texts."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(100.0 * (1 - indel(a, b) / total))


def _edits(a: str, b: str, again: bool) -> int:
    """Edit distance with swaps of neighbours; again: swapped letters may be edited further."""
    if not again:
        two, one = [], list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y)))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    now[-1] = min(now[-1], two[j - 2] + 1)
            two, one = one, now
        return one[-1]
    far, last = len(a) + len(b), {}
    d = {(-1, -1): far} | {(i, -1): far for i in range(len(a) + 1)} | {(-1, j): far for j in range(len(b) + 1)}
    d |= {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                match = j
            d[i, j] = min(d[i - 1, j - 1] + (x != y), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[len(a), len(b)]


def _pairwise(again: bool):
    @pandas_udf(T.IntegerType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _edits(x, y, again) for x, y in zip(a, b)], dtype="Int32")

    return distance


def osa(a: Column, b: Column) -> Column:
    """Optimal string alignment distance; runs in Python over Arrow batches."""
    return _pairwise(False)(a, b)


def damerau_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance with swaps; runs in Python over Arrow batches."""
    return _pairwise(True)(a, b)


def html_to_text(c: Column) -> Column:
    """Without scripts, styles, comments and tags; the five basic entities decoded; white space made single spaces."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


@pandas_udf(T.StringType())
def md_to_html(c: pd.Series) -> pd.Series:
    """Headings, emphasis, code, links, lists and paragraphs of Markdown; runs in Python."""

    def inline(t: str) -> str:
        t = html.escape(t, quote=False)
        for pattern, to in ((r"`([^`]+)`", r"<code>\1</code>"), (r"\*\*([^*]+)\*\*", r"<strong>\1</strong>"), (r"\*([^*]+)\*", r"<em>\1</em>"), (r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>')):
            t = re.sub(pattern, to, t)
        return t

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        out = []
        for block in re.split(r"\n\s*\n", t.strip("\n")):
            if head := re.match(r"(#{1,6}) +(.*)", block):
                out.append(f"<h{len(head[1])}>{inline(head[2])}</h{len(head[1])}>")
            elif all(x.startswith(("- ", "* ")) for x in block.splitlines()) and block:
                out.append("<ul>" + "".join(f"<li>{inline(x[2:])}</li>" for x in block.splitlines()) + "</ul>")
            elif block:
                out.append(f"<p>{inline(block)}</p>")
        return "\n".join(out)

    return c.map(one)


def template_render(template: str, values: dict[str, Column]) -> Column:
    """A template with {{ name }} for each value; a name without value is an error when the expression is built."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    return F.concat(*(F.lit(p) if i % 2 == 0 else values[p].cast("string") for i, p in enumerate(parts)))


def template_valid(c: Column) -> Column:
    """Whether a text is a template of the form that template_render takes: every brace pair holds a name."""
    return ~F.regexp_replace(c, r"\{\{\s*\w+\s*\}\}", "").rlike(r"\{\{|\}\}|\{%|%\}")


def md_to_text(c: Column) -> Column:
    """Markdown without its marks: headings, emphasis, code, links (their text stays), quotes and list signs."""
    for pattern, to in ((r"(?m)^\s{0,3}(#{1,6}|>|[-*+]|\d+\.)\s+", ""), (r"!?\[([^\]]*)\]\([^)\s]*\)", "$1"), (r"```\w*\n?|`", ""), (r"(\*\*|__)(.+?)\1", "$2"), (r"(?<!\w)([*_])(.+?)\1(?!\w)", "$2")):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def wordwrap(c: Column, width: int) -> Column:
    """The words of a text in lines of at most `width` letters, as many to a line as go in; a longer word has its own line."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")

    def add(done: Column, word: Column) -> Column:
        fits = F.length(done["line"]) + 1 + F.length(word) <= width
        line = F.when(done["line"] == "", word).when(fits, F.concat_ws(" ", done["line"], word)).otherwise(word)
        full = F.when((done["line"] == "") | fits, done["lines"]).otherwise(F.concat(done["lines"], F.array(done["line"])))
        return F.struct(full.alias("lines"), line.alias("line"))

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))
    return F.aggregate(words, start, add, lambda d: F.array_join(F.concat(d["lines"], F.array(d["line"])), "\n"))


def bars(c: Column, width: int = 20) -> Column:
    """An array of numbers as lines of blocks, the greatest one `width` long; negative ones and nulls have none."""
    top = F.greatest(F.array_max(c).cast("double"), F.lit(0.0))
    size = lambda x: F.when((top > 0) & (x > 0), F.round(x / top * width).cast("int")).otherwise(0)
    return F.array_join(F.transform(c, lambda x: F.repeat(F.lit("█"), F.coalesce(size(x), F.lit(0)))), "\n", "")


def sparkline(c: Column) -> Column:
    """An array of numbers as eight heights of bars; equal numbers are the lowest."""
    low, high = F.array_min(c), F.array_max(c)
    step = lambda x: F.when(high == low, 1).otherwise(F.floor((x - low) / (high - low) * 7) + 1).cast("int")
    return F.array_join(F.transform(c, lambda x: F.substring(F.lit("▁▂▃▄▅▆▇█"), step(x), F.lit(1))), "")


def fst_contains(words: Column, x: Column) -> Column:
    return F.array_contains(words, x)


def fst_prefix(words: Column, prefix: Column) -> Column:
    return F.array_sort(F.filter(words, lambda w: F.startswith(w, prefix)))


def fst_count(words: Column) -> Column:
    return F.size(F.array_distinct(words))
