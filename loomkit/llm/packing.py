"""Bounded-space online packing of documents into training sequences.

Each task keeps a fixed number of open windows. A document is cut into full windows and a rest; the rest goes to the open
window where it fits best. If it fits in none, the fullest window is emitted: its gap is first filled with the head of the
rest, unless the gap is under MIN_CUT ids, which stay padding. At the end of a task its open windows are poured into each
other, so that it leaves less than one window; these leftovers are merged across tasks in groups of MERGE, and what
remains of a group is dealt to sequences whose lengths are powers of two, which need no padding.

State: at most open_windows * length ids in a task, MERGE * length ids in a merge; no document is ever gathered with others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.llm.common import cut
from loomkit.llm.encode import encoder, packed

MIN_CUT, MERGE = 32, 256
#: Sequence ids: the task in the upper bits, its sequences in the lower 33; merged leftovers from MERGED on.
SHIFT, MERGED = 33, 1 << 62

Piece = tuple  # (doc_id, start, ids as bytes, doc_tokens)


class Windows:
    """The open windows of one task. emit(pieces) is called for each window that is done."""

    def __init__(self, length: int, most: int, emit: Callable[[list[Piece]], None]):
        self.length, self.most, self.emit = length, most, emit
        self.open: list[tuple[int, list[Piece]]] = []  # (gap, pieces)

    def add(self, doc_id, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.length:
            self.emit([(doc_id, start, ids[4 * start : 4 * (start + self.length)], total)])
            start += self.length
        while start < total:
            left = total - start
            fits = [i for i, (gap, _) in enumerate(self.open) if gap >= left]
            if fits:
                i = min(fits, key=lambda k: self.open[k][0])
                gap, pieces = self.open.pop(i)
                pieces.append((doc_id, start, ids[4 * start :], total))
                if gap == left:
                    self.emit(pieces)
                else:
                    self.open.append((gap - left, pieces))
                return
            if len(self.open) < self.most:
                self.open.append((self.length - left, [(doc_id, start, ids[4 * start :], total)]))
                return
            i = min(range(len(self.open)), key=lambda k: self.open[k][0])
            gap, pieces = self.open.pop(i)
            if gap >= MIN_CUT:
                pieces.append((doc_id, start, ids[4 * start : 4 * (start + gap)], total))
                start += gap
            self.emit(pieces)


def poured(pieces: Iterator[Piece], length: int) -> Iterator[list[Piece]]:
    """The pieces one after another, cut wherever a window of length ids is full; the last one may be shorter."""
    window, room = [], length
    for doc_id, start, ids, total in pieces:
        while ids:
            head, ids = ids[: 4 * room], ids[4 * room :]
            window.append((doc_id, start, head, total))
            start, room = start + len(head) // 4, room - len(head) // 4
            if not room:
                yield window
                window, room = [], length
    if window:
        yield window


def powers(window: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces of a short window dealt to sequences with powers of two as lengths, longest first."""
    left = sum(len(p[2]) for p in window) // 4
    rest = window
    while left:
        size = 1 << (left.bit_length() - 1)
        first, *others = poured(iter(rest), size)
        yield first
        rest = [p for w in others for p in w]
        left -= size


def rows(sequence: int, window: list[Piece]) -> Iterator[tuple]:
    at = 0
    for doc_id, start, ids, total in window:
        yield doc_id, start, len(ids) // 4, total, ids, sequence, at
        at += len(ids) // 4


def pack(df: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, open_windows: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, start, length, doc_tokens, ids (little-endian 32-bit), sequence_id, offset.

    Every document is its ids and end_id; each id lies in exactly one piece, and a sequence's pieces follow each other
    without gaps. A null text is empty: its document is end_id alone; a very long one
    fills many sequences. Rows are packed one by one, whatever their ids, so
    repeated rows are documents of their own and a null id stays null. Other columns of df play no part. An empty df
    gives no rows. The pieces are written once to the shared folder, from where the leftovers are merged.
    """
    id_type = df.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), *(T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens")), T.StructField("ids", T.BinaryType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    schema = T.StructType(fields)
    placed = T.StructType([*fields, T.StructField("task", T.IntegerType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, end = to_arrow_schema(placed), packed([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, count = TaskContext.get().partitionId(), [], 0
        encode = encoder(tokenizer_path).encode

        def emit(window: list[Piece], of=None) -> None:
            nonlocal count
            out.extend((*r, of) for r in rows((task << SHIFT) + count, window))
            count += 1

        windows = Windows(length, open_windows, emit)
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                windows.add(doc_id, encode(text) + end)
                if len(out) >= 2000:
                    yield flush()
                    out.clear()
        left = [p for gap, pieces in sorted(windows.open, key=lambda w: w[0]) for p in pieces]
        for window in poured(iter(left), length):
            emit(window, None if sum(len(p[2]) for p in window) == 4 * length else task)
        if out:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        found = table.sort_by([("task", "ascending"), ("offset", "ascending")]).to_pylist()
        base, made = MERGED + (found[0]["task"] // MERGE << SHIFT), []
        for window in poured(((r[id_col], r["start"], r["ids"], r["doc_tokens"]) for r in found), length):
            full = sum(len(p[2]) for p in window) == 4 * length
            for one in [window] if full else powers(window):
                made.append((base + len(made), one))
        made = [r for sequence, window in made for r in rows(sequence, window)]
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made), arrow)], schema=to_arrow_schema(schema))

    done = cut(df.select(id_col, text_col).mapInArrow(run, placed), "packed")
    merged = done.where("task IS NOT NULL").groupBy(F.expr(f"task div {MERGE}")).applyInArrow(merge, schema)
    return done.where("task IS NULL").drop("task").unionByName(merged)


def pieces_digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
