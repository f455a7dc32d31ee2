"""Benchmark passages in documents, by Wu-Manber search over words.

A test string is a window of SIZE consecutive words of a benchmark item (all words of a shorter one). Two neighbouring
words are a block. The shift table says how far a search may move on after a block: to where the block could next end a
window. Where the shift is 0 the bucket of that block, by the window's first block too, gives the windows to compare.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.llm.common import annotate, named, private, words

SIZE = 10
#: Bytes of benchmark texts that are broadcast at once; a larger benchmark is searched for block by block.
BLOCK_BYTES = 16 << 20
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


class Group:
    """The windows of one length."""

    def __init__(self, length: int):
        self.length = length
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, dict[tuple, set]]] = defaultdict(lambda: defaultdict(dict))

    def add(self, window: tuple, item) -> None:
        width = min(2, self.length)
        for end in range(width, self.length + 1):
            block, far = window[end - width : end], self.length - end
            if far < self.shift.get(block, self.length):
                self.shift[block] = far
        self.buckets[window[-width:]][window[:width]].setdefault(window, set()).add(item)

    def search(self, text: list[bytes]) -> list[tuple[int, set]]:
        """Where windows start, and the items that have them."""
        found, size, n = [], self.length, len(text)
        width = min(2, size)
        shift, far = self.shift.get, size - width + 1
        end = size
        if width == 1:
            for i, word in enumerate(text):
                if (word,) in self.buckets:
                    found.append((i, self.buckets[(word,)][(word,)][(word,)]))
            return found
        while end <= n:
            move = shift((text[end - 2], text[end - 1]), far)
            if move:
                end += move
                continue
            start = end - size
            near = self.buckets[text[end - 2], text[end - 1]].get((text[start], text[start + 1]))
            if near:
                items = near.get(tuple(text[start:end]))
                if items:
                    found.append((start, items))
            end += 1
        return found


class Matcher:
    def __init__(self, items: list[tuple], size: int = SIZE):
        self.groups: dict[int, Group] = {}
        for item, text in items:
            found = words(text)
            if not found:
                continue
            length = min(size, len(found))
            group = self.groups.setdefault(length, Group(length))
            for i in range(len(found) - length + 1):
                group.add(tuple(found[i : i + length]), item)

    def match(self, text: str | None) -> tuple[int, list[tuple[int, int]], list]:
        """Words of the text; its maximal runs of words inside windows; the items they belong to, sorted."""
        found, spans, items = words(text), [], set()
        for group in self.groups.values():
            for start, owners in group.search(found):
                spans.append((start, start + group.length))
                items |= owners
        merged: list[tuple[int, int]] = []
        for start, end in sorted(spans):
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
        return len(found), merged, sorted(x for x in items if x is not None)


_matchers: dict[tuple, Matcher] = {}


def matcher(rows, size: int) -> Matcher:
    """The worker's matcher for a broadcast block: it outlives a task, the latest few are kept."""
    key = (rows._path or id(rows), size) if hasattr(rows, "_path") else (id(rows), size)
    if key not in _matchers:
        while len(_matchers) >= 2:
            del _matchers[next(iter(_matchers))]
        _matchers[key] = Matcher(rows.value, size)
    return _matchers[key]


def find_passages(df: DataFrame, benchmark: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """df with n_words, hits (runs of words, from 0, end exclusive) and items (ids of the items whose windows occur, sorted).

    Null and empty texts, of either side, have no words and match nothing; items without id count in hits only. Repeated
    rows and items change nothing, very long texts are searched whole. Columns of df with these names, in whatever case, are
    replaced. Distinct benchmark texts, with their ids, are broadcast in blocks of about block_bytes (a longer text is a
    block of its own), one map over df for each; df is never shuffled.
    """
    spark, item_type = df.sparkSession, benchmark.schema[item_col].dataType
    items = benchmark.where(named(item_text_col).isNotNull()).groupBy(named(item_text_col).alias("text")).agg(F.collect_set(named(item_col)).alias("ids"))
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    names = [(private(df, f"_hits{b}"), private(df, f"_items{b}")) for b in range(blocks)]
    out = df
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = spark.sparkContext.broadcast([(item, text) for text, ids in part.collect() for item in ids or [None]])

        def make(rows=rows):
            match = matcher(rows, size).match
            spans_of = lambda spans: [{"start": s, "end": e} for s, e in spans]
            return lambda texts: [(n, spans_of(spans), items) for n, spans, items in map(match, texts)]

        hits, found = names[b]
        fields = T.StructType([T.StructField("n_words", T.LongType()), T.StructField(hits, T.ArrayType(SPAN)), T.StructField(found, T.ArrayType(item_type))])
        out = annotate(out, text_col, make, fields)
    hits, found = F.col(names[0][0]), F.col(names[0][1])
    if blocks > 1:
        hits, found = joined_runs(F.array_sort(F.concat(*(h for h, _ in names)))), F.array_sort(F.array_distinct(F.concat(*(i for _, i in names))))
    own = {n for pair in names for n in pair}
    kept = [named(c) for c in out.columns if c not in own and c.lower() not in ("hits", "items")]
    return out.select(*kept, hits.alias("hits"), found.alias("items"))


def joined_runs(spans):
    """Sorted runs with overlapping and touching ones made one."""

    def add(done, x):
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]), longer).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.array().cast(T.ArrayType(SPAN)), add)


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: The same by a join of windows, for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, list_slice(w, i, i + least(10, len(w)) - 1) AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS win FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, dw.i, bw.k FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
