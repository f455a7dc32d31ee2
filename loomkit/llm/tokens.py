"""Token counts by a two-tier lookup that never shuffles a pre-token.

A pre-token is a run of spaces and what follows it up to the next space. No piece of the vocabulary has a space after
another character, so the count of a text is the sum over its pre-tokens.

Tier 1 is a table of the lengths of the corpus's FREQUENT most frequent pre-tokens. They are counted in a pass of their own:
each task counts all its texts' pre-tokens, letting go of the rarer half whenever it holds more than HELD, and sends its
FREQUENT most frequent ones, so what is shuffled depends on the number of tasks, not on the corpus. The table is encoded
once on the driver and broadcast; it has FREQUENT entries of LONGEST characters at most. Tier 2 is a cache in each Python
worker: a pre-token that the table lacks is encoded by the library once and remembered, up to CACHE entries; beyond that
it is encoded each time. Both tiers only save work: every text is counted whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.llm.common import annotate, named

#: Entries of a worker's cache, and the longest pre-token that it or the table keeps.
CACHE, LONGEST = 1_000_000, 64
#: Entries of the table of frequent pre-tokens, and pre-tokens that a task counts at once.
FREQUENT, HELD = 20_000, 200_000
SPACE = "▁"
COUNTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

_processors: dict[str, sentencepiece.SentencePieceProcessor] = {}


def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _processors:
        _processors[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _processors[path]


def frequent(df: DataFrame, text_col: str = "text") -> list[str]:
    """The most frequent pre-tokens of all texts (without their space), the most frequent one first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(text.split(" "))
                if len(counts) > HELD:
                    counts = Counter(dict(counts.most_common(HELD // 2)))
        top = [(t, n) for t, n in counts.most_common(FREQUENT) if t and len(t) <= LONGEST and SPACE not in t]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["token", "n"])

    found = df.select(named(text_col)).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return [r.token for r in found.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()]


def lengths(path: str, tokens: Iterable[str]) -> dict[str, int]:
    """The table of tier 1."""
    tokens = list(tokens)
    return dict(zip(tokens, map(len, processor(path).encode(tokens, num_threads=1)))) if tokens else {}


class Lengths(dict):
    """Token counts by pre-token (without its first space)."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__(table)
        self.sp, self.most = processor(path), len(self) + CACHE

    def __missing__(self, key: str) -> int:
        n = len(self.sp.encode(key))
        if len(key) <= LONGEST and len(self) < self.most:
            self[key] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if text[0] != " " and text[-1] != " " and "  " not in text and SPACE not in text:
            return sum(map(self.__getitem__, text.split(" ")))
        runs, total = (SPACE + text.replace(" ", SPACE)).split(SPACE)[1:], 0
        gap = 0  # further spaces before the next run
        for run in runs:
            if run:
                total += self[" " * gap + run] if gap else self[run]
                gap = 0
            else:
                gap += 1
        # the text ends in spaces: they are a pre-token of their own
        return total + (self[" " * (gap - 1)] if gap > 1 else self.lone if gap else 0)

    @property
    def lone(self) -> int:
        """Tokens of a single space at the end of a text."""
        return len(self.sp.encode("a ")) - len(self.sp.encode("a"))


_worker: dict[str, tuple] = {}


def _lengths(path: str, spread) -> Lengths:
    """The worker's counts for a model: they outlive a task as long as the table is the same one."""
    held = _worker.get(path)
    if held is None or held[0] is not spread.value:
        held = _worker[path] = spread.value, Lengths(path, spread.value)
    return held[1]


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """df with n_bytes (of the text as UTF-8) and n_tokens (as the sentencepiece model gives them, nothing added).

    A null text counts as empty: 0 and 0; very long ones are counted whole. Rows are kept one for one, repeated ones too;
    columns of df named n_bytes or n_tokens, in whatever case, are replaced. The work is two maps over the input, of which
    the first sends each task's frequent pre-tokens.
    """
    spread = df.sparkSession.sparkContext.broadcast(lengths(model_path, frequent(df, text_col)))

    def make():
        found = _lengths(model_path, spread)
        return lambda texts: [(len(t.encode()), found.count(t)) if t else (0, 0) for t in texts]

    return annotate(df, text_col, make, COUNTS)


def over_limit(counts: DataFrame, limit: int = 4096) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
