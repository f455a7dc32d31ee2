"""Removal of long repeats across documents: exact substrings of LENGTH bytes, by suffix arrays of shards.

Which byte strings must meet is found by winnowing: of the GRAM-byte grams in a window of LENGTH bytes the one with the least
hash is its fingerprint, so equal windows have equal fingerprints wherever they stand, and a fingerprint seen in one
document only can't lead to a repeat. Consecutive windows with one fingerprint form a context: the bytes that they cover.
Equal contexts are counted once, with their least document. The contexts of fingerprints that two documents share are
dealt to shards by fingerprint; each shard's text gets a suffix array by induced sorting and permuted common prefixes, of
which runs of LENGTH or more are equal windows. A window whose run has a smaller document is removed.

Texts are dealt out once, to a bucketed table that all later steps read where it lies. Nothing is gathered without bound:
a task asks once for each fingerprint that several of its documents have, a frequent context is one row, and the contexts
of a fingerprint that has very many are halved by where the fingerprint stands in the window, again and again, into keys
that fit shards. Contexts of one fingerprint are told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.llm.common import cut, dealt_once, forget, named
from loomkit.llm.suffixes import permuted_prefixes, suffix_array

LENGTH, GRAM = 50, 20
#: Places of the fingerprint in a window, and the first and last ones of some stretches of them.
PLACES = LENGTH - GRAM + 1
STANDS = [(k, min(k + 4, PLACES) - 1) for k in range(0, PLACES, 4)]
#: Bytes that are hashed at once, fingerprints that a task reduces at once, contexts of a shard.
PIECE, FLUSH, SHARD = 1 << 20, 1 << 20, 16_000
#: Contexts of a fingerprint that still go to one shard.
CROWD = 8_000
#: Bits of a fingerprint; two that agree by chance only cost a needless comparison. Bits of a document's number in a task.
PRINT, DOC_BITS = 46, 17
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Contexts(NamedTuple):
    prints: np.ndarray
    texts: np.ndarray  # the number of the text
    first: np.ndarray  # the first byte in it
    windows: np.ndarray
    gram: np.ndarray  # where the fingerprint's gram stands in the first window


def contexts(datas: list[bytes]) -> Contexts:
    """The contexts of texts, in order."""
    nothing = Contexts(*(np.empty(0, np.int64),) * 5)
    sizes = np.array([len(d) for d in datas], np.int64)
    data = np.frombuffer(b"".join(datas), np.uint8)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return nothing
    h, power, width = data.astype(np.uint64) + np.uint64(1), FACTOR, 1
    four = None
    while width < 16:  # grams of 16 bytes by doubling, and of 20 from those
        h = h[:-width] * power + h[width:]
        width *= 2
        power = np.uint64(int(power) ** 2 & (1 << 64) - 1)
        if width == 4:
            four, fourth = h, power
    h = h[:-4] * fourth + four[16:]
    h ^= h >> np.uint64(32)
    h *= FACTOR
    key = (h & ~np.uint64(63)) | (np.arange(len(h), dtype=np.uint64) & np.uint64(63))
    width, least = 1, key
    while width * 2 <= PLACES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < PLACES:
        least = np.minimum(least[: len(least) - (PLACES - width)], least[PLACES - width :])
    ends = np.repeat(np.cumsum(sizes), sizes)
    places = np.flatnonzero(ends[:n] - np.arange(n) >= LENGTH)
    chosen = least[places]
    if not len(places):
        return nothing
    owner = places + ((chosen & np.uint64(63)).astype(np.int64) - places & 63)
    text_of = np.repeat(np.arange(len(sizes)), sizes)[places]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (places[1:] != places[:-1] + 1) | (text_of[1:] != text_of[:-1])))
    texts = text_of[first]
    windows = np.diff(np.append(first, len(places)))
    return Contexts((chosen[first] >> np.uint64(64 - PRINT)).astype(np.int64), texts, places[first] - (np.cumsum(sizes) - sizes)[texts], windows, (owner - places)[first])


def lists(column: pa.Array) -> list[np.ndarray]:
    """A column of lists of numbers as arrays; null as an empty one."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[tuple, int, bytes]]]:
    """(_id, _row and what follows _text) of rows, and their texts' bytes with the place they begin at, some PIECE bytes at a time.

    A text of more than PIECE bytes comes in parts that share LENGTH - 1 bytes, so each window is in one part.
    """
    held, size = [], 0
    for batch in batches:
        others = [lists(c) if pa.types.is_list(c.type) else c.to_pylist() for c in (batch.column(k) for k in range(batch.num_columns) if k != 2)]
        for text, *row in zip(batch.column(2).to_pylist(), *others):
            data = text.encode()
            for at in range(0, max(1, len(data) - LENGTH + 1), PIECE):
                held.append((row, at, data[at : at + PIECE + LENGTH - 1]))
                size += len(held[-1][2])
                if size >= PIECE:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def batch_of(columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()], names=list(columns))


def told_fingerprints(docs: DataFrame) -> DataFrame:
    """_id, _row and _told: of each document (not null, LENGTH bytes at least) the fingerprints that others have too.

    A task sorts the fingerprints of its documents, FLUSH at a time. Those of one document there are asked for; for those
    of several, which know already, one asks so that others learn of it. Questions are dealt by fingerprint and sorted, and
    a fingerprint that is asked for twice is told, row by row. Of equal texts only the one with the least id asks: the
    others are removed whole, or told by what other tasks find.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        keys, size, seen = [], 0, {}

        def flush() -> pa.RecordBatch:
            ids, marks = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
            found = np.sort(np.concatenate(keys))
            found = found[np.append(True, found[1:] != found[:-1])]
            p, d = found >> DOC_BITS, found & (1 << DOC_BITS) - 1
            first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            sizes = np.diff(np.append(first, len(p)))
            several = sizes > 1
            asks = np.concatenate([np.where(np.repeat(several, sizes), -1 - p, p * 2), p[first][several] * 2 + 1])
            who = np.concatenate([d, d[first][several]])
            return batch_of({"_ask": asks, "_id": ids[who], "_row": marks[who]})

        for held in pieces(batches):
            used = []
            for row, at, data in held:
                mark = xxhash.xxh3_128_digest(data)
                if mark in seen and at == 0 and seen[mark] <= row[0] and len(data) < PIECE:
                    continue
                seen[mark] = min(row[0], seen.get(mark, row[0]))
                if not rows or rows[-1] is not row:
                    rows.append(row)
                used.append((len(rows) - 1, data))
            found = contexts([data for _, data in used])
            keys.append(found.prints << DOC_BITS | np.array([k for k, _ in used] or [0], np.int64)[found.texts])
            size += len(found.prints)
            if size >= FLUSH or len(rows) + PIECE // LENGTH >= 1 << DOC_BITS:
                if size:
                    yield flush()
                rows, keys, size, seen = [], [], 0, {}
        if size:
            yield flush()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = -1, None  # the last fingerprint, and its one question if that was all so far
        for batch in batches:
            asks, ids, rows = (batch.column(k).to_numpy() for k in range(3))
            known = asks < 0
            out = [(ids[known], rows[known], -1 - asks[known])]
            p, sure, ids, rows = asks[~known] >> 1, (asks[~known] & 1) == 1, ids[~known], rows[~known]
            if len(p):
                first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
                sizes = np.diff(np.append(first, len(p)))
                shared = (sizes > 1) | np.logical_or.reduceat(sure, first)
                if p[0] == before:
                    shared[0] = True
                    if held:
                        out.append(tuple(np.array([x]) for x in held))
                last = first[-1]
                before, held = p[last], None if shared[-1] or sure[last] else (ids[last], rows[last], p[last])
                told = np.repeat(shared, sizes) & ~sure
                out.append((ids[told], rows[told], p[told]))
            ids, rows, prints = (np.concatenate([o[k] for o in out]) for k in range(3))
            if len(ids):
                yield batch_of({"_id": ids, "_row": rows, "_print": prints})

    asked = docs.select("_id", "_row", "_text").mapInArrow(ask, "_ask long, _id long, _row long")
    place = F.when(F.col("_ask") < 0, F.xxhash64("_id")).otherwise(F.shiftright("_ask", 1))
    told = asked.repartition(place).sortWithinPartitions("_ask").mapInArrow(tell, "_id long, _row long, _print long")
    return told.groupBy("_id", "_row").agg(F.collect_list("_print").alias("_told"))


#: _place: the first byte, the number of windows and where the gram stands in the first one, in 5 bits each of the last two.
CONTEXT = "_id long, _row long, _print long, _name long, _place long"


def shared_contexts(docs: DataFrame, told: DataFrame, copies: DataFrame) -> DataFrame:
    """The contexts with fingerprints that their document was told of; copies of a document have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in pieces(batches):
            found = contexts([data for _, _, data in held])
            told_of = np.concatenate([k << PRINT | row[2] for k, (row, _, _) in enumerate(held)])
            mine = np.isin(found.texts << PRINT | found.prints, told_of)
            own, first, windows, gram = (x[mine] for x in found[1:])
            names = np.fromiter((xxhash.xxh3_64_intdigest(held[t][2][f : f + w + LENGTH - 1]) for t, f, w in zip(own.tolist(), first.tolist(), windows.tolist())), np.uint64, len(own))
            begins, ids, marks = (np.array(x, np.int64)[own] for x in ([at for _, at, _ in held], [r[0] for r, _, _ in held], [r[1] for r, _, _ in held]))
            yield batch_of({"_id": ids, "_row": marks, "_print": found.prints[mine], "_name": names.view(np.int64), "_place": begins + first << 10 | windows << 5 | gram})

    here = docs.join(told, ["_id", "_row"]).join(copies, ["_id", "_row"], "left_anti")
    return here.select("_id", "_row", "_text", "_told").mapInArrow(run, CONTEXT)


#: Contexts, or parts of them, that are to be compared: _key is what equal windows have in common, _at the part's first byte
#: in its context, _low and _high where the fingerprint stands in its windows, at least and at most.
PART = "_key long, _print long, _name long, _least long, _at int, _low int, _high int, _gram int, _bytes binary"


def with_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The contexts wanted (_print, _name, _count; _id, _row and _place where one stands) as parts, with _count."""
    of = wanted.groupBy("_id", "_row").agg(F.collect_list(F.struct("_print", "_name", "_place", "_count")).alias("_of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            ends = column.offsets.to_numpy()
            prints, names, places, counts = (x.slice(ends[0], ends[-1] - ends[0]) for x in column.values.flatten())
            at = places.to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            datas = [text.encode() for text in batch.column(1).to_pylist()]
            begins = at >> 10
            cuts = [datas[k][x:y] for k, x, y in zip(owner.tolist(), begins.tolist(), (begins + (at >> 5 & 31) + LENGTH - 1).tolist())]
            n = len(cuts)
            yield batch_of({"_key": prints, "_print": prints, "_name": names, "_least": batch.column(0).to_numpy()[owner], "_at": np.zeros(n, np.int32), "_low": np.zeros(n, np.int32), "_high": np.full(n, PLACES - 1, np.int32), "_gram": (at & 31).astype(np.int32), "_bytes": pa.array(cuts, pa.binary()), "_count": counts})

    return docs.join(of, ["_id", "_row"]).select("_id", "_text", "_of").mapInArrow(run, PART + ", _count long")


def halved(part: dict) -> Iterator[tuple]:
    """A part as parts whose windows have the fingerprint in the left or the right half of the places that it had there.

    If it stands at `middle` at least, equal windows have as many bytes before it in common; else, the bytes after it that
    all such windows hold. Where the gram stands more than once, its first place in the window counts.
    """
    data, low, high = part["_bytes"], part["_low"], part["_high"]
    gram, middle = data[part["_gram"] : part["_gram"] + GRAM], (low + high + 1) // 2
    runs: list[list] = []  # key, first window, last window, place of the gram
    for k in range(len(data) - LENGTH + 1):
        at = data.index(gram, k)
        right = at - k >= middle
        key = (at, right)
        if runs and runs[-1][0] == key:
            runs[-1][2] = k
        else:
            runs.append([key, k, k])
    for (at, right), first, last in runs:
        common = data[at - middle : at] if right else data[at + GRAM : at + GRAM + PLACES - middle]
        key = xxhash.xxh3_64_intdigest(b"%d %d " % (part["_key"], right) + gram + common)
        bounds = (middle, high) if right else (low, middle - 1)
        yield (key - (key >> 63 << 64), part["_print"], part["_name"], part["_least"], part["_at"] + first, *bounds, at - first, data[first : last + LENGTH])


def alone(keys: list[int], datas: list[bytes], grams: list[int]) -> np.ndarray:
    """Of a shard's parts those that can't share a window with another one of their key.

    Equal windows in which the gram stands at first to last have the bytes in common that all such windows hold around it. A
    part that has the gram more than once may be read in more ways than one, and is not judged.
    """
    sides: dict[tuple, int] = {}
    own = []
    for key, data, at in zip(keys, datas, grams):
        gram = data[at : at + GRAM]
        if data.find(gram) < at or data.find(gram, at + 1) >= 0:
            own.append(None)
            continue
        mine = [(key, first, data[at - first : at + LENGTH - last]) for first, last in STANDS if first <= at <= len(data) - LENGTH + last]
        for side in mine:
            sides[side] = sides.get(side, 0) + 1
        own.append(mine)
    return np.array([mine is not None and all(sides[side] == 1 for side in mine) for mine in own], bool)


def repeated_windows(datas: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of bytes of a shard's parts in windows that a part with a smaller least document has too: part, first byte, length."""
    sizes = np.array([len(d) + 1 for d in datas], np.int64)
    flat = np.frombuffer(b"\0".join(datas) + b"\0" * (LENGTH + 9), np.uint8)
    total = int(sizes.sum())
    letters = flat[:total].astype(np.int16) + 1
    letters[np.cumsum(sizes) - 1] = 0  # between parts
    sa = suffix_array(letters, 257)
    of = np.repeat(np.arange(len(datas)), sizes)
    starts = np.cumsum(sizes) - sizes
    sa = sa[(starts + sizes - 1)[of[sa]] - sa >= LENGTH]
    common = permuted_prefixes(flat, sa, LENGTH)[sa]
    heads = np.flatnonzero(np.append(True, common[1:] < LENGTH))
    owner = least[of[sa]]
    smallest = np.repeat(np.minimum.reduceat(owner, heads), np.diff(np.append(heads, len(sa))))
    gone = np.sort(sa[smallest < owner])
    begins = np.flatnonzero(np.append(True, (np.diff(gone) > LENGTH) | (np.diff(of[gone]) > 0))) if len(gone) else np.empty(0, np.int64)
    first, last = gone[begins], gone[np.append(begins[1:], len(gone)) - 1] if len(gone) else gone
    return of[first], first - starts[of[first]], last - first + LENGTH


#: Spans travel as one number: first byte in the upper 32 bits, bytes in the lower ones.
GONE = "_print long, _name long, _gone long"


def by_shards(parts: DataFrame, shards: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        datas = table.column("_bytes").to_pylist()
        met = np.flatnonzero(~alone(table.column("_key").to_pylist(), datas, table.column("_gram").to_pylist()))
        prints, names, begin, least = (table.column(c).to_numpy()[met] for c in ("_print", "_name", "_at", "_least"))
        part, first, size = repeated_windows([datas[i] for i in met.tolist()], least) if len(met) else (met, met, met)
        return pa.table({"_print": pa.array(prints[part]), "_name": pa.array(names[part]), "_gone": pa.array(begin[part] + first << 32 | size)})

    return parts.select("_print", "_name", "_at", "_least", "_bytes", "_key", "_gram").groupBy(F.pmod("_key", F.lit(shards))).applyInArrow(run, GONE)


def marks(parts: DataFrame, shards: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """_print, _name and _gone: spans of contexts that a smaller document has too; most: the largest _count of parts.

    And the tables that it reads.

    Keys with few parts are compared in shards. Parts of the others are halved; those whose windows have the fingerprint at
    one place are equal wherever their keys are, and their least document is a plain minimum.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for part in batch.to_pylist() for x in halved(part)]
            if rows:
                kinds = (*(pa.int64(),) * 4, *(pa.int32(),) * 4, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in PART.split(", ")])

    done, used = [], []
    while most > CROWD:
        parts = cut(parts, "parts")
        done.append(by_shards(parts.where(F.col("_count") <= CROWD), shards))
        narrower = cut(parts.where(F.col("_count") > CROWD).mapInArrow(split, PART), "parts")
        at_one = narrower.where("_low = _high")
        least = at_one.groupBy("_key").agg(F.min("_least").alias("_smallest"))
        span = F.shiftleft(F.col("_at").cast("long"), 32) + F.octet_length("_bytes")
        done.append(at_one.join(least, "_key").where("_smallest < _least").select("_print", "_name", span.alias("_gone")))
        counts = cut(narrower.where("_low < _high").groupBy("_key").agg(F.count(F.lit(1)).alias("_count")).where("_count > 1"), "counts")
        used += [parts, narrower, counts]
        parts = narrower.where("_low < _high").join(counts, "_key")
        most = counts.agg(F.max("_count")).head()[0] or 0
    return reduce(DataFrame.unionByName, [*done, by_shards(parts, shards)]), used


REMOVED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, removed (maximal runs of bytes, end exclusive) and kept (the other bytes), a row per row of df.

    A byte is removed if a LENGTH-byte string that covers it also starts in a row with a smaller id (of an integer type,
    else it's an error), as the texts are in df. Null texts are empty; rows with a null id neither lose bytes nor make
    others lose any; rows of one id don't count for each other, equal ones included. Very long texts are read in parts. An
    empty df gives no rows; other columns play no part. The result reads two tables of the shared folder: the texts as
    dealt out, and their spans.
    """
    id_type = df.schema[id_col].dataType
    if not isinstance(id_type, T.IntegralType):
        raise TypeError(f"{id_col} must be of an integer type: documents are compared by it, and it is {id_type.simpleString()}")
    docs = df.select(named(id_col).cast("long").alias("_id"), F.coalesce(named(text_col), F.lit("")).alias("_text"))
    total = docs.agg(F.sum(F.octet_length("_text").cast("long"))).head()[0] or 0
    repeated = bool(docs.groupBy("_id").count().where("count > 1 AND _id IS NOT NULL").head(1))
    mark = F.xxhash64("_text")  # tells rows of one id apart
    docs = docs.withColumn("_row", mark if repeated else F.when(F.col("_id").isNull(), mark).otherwise(F.lit(0).cast("long")))
    if repeated:
        docs = docs.groupBy("_id", "_row").agg(F.first("_text").alias("_text"), F.count(F.lit(1)).alias("_times"))
    docs = dealt_once(docs, ["_id", "_row"], total)
    long_ones = docs.where(F.col("_id").isNotNull() & (F.octet_length("_text") >= LENGTH))
    equal = F.md5("_text").alias("_same")
    firsts = long_ones.groupBy(equal).agg(F.min("_id").alias("_least"))
    copies = cut(long_ones.select("_id", "_row", F.octet_length("_text").alias("_size"), equal).join(firsts, "_same").where("_id > _least").drop("_same", "_least"), "copies")
    told = cut(told_fingerprints(long_ones), "told")
    found = cut(shared_contexts(long_ones, told, copies.select("_id", "_row")), "contexts")
    forget(told)
    where = F.min_by(F.struct("_row", "_place"), "_id") if repeated else F.struct(F.lit(0).cast("long").alias("_row"), F.min_by("_place", "_id").alias("_place"))
    distinct = found.groupBy("_print", "_name").agg(F.min("_id").alias("_id"), where.alias("_where"))
    distinct = cut(distinct.select("_print", "_name", "_id", "_where._row", "_where._place"), "distinct-contexts")
    counts = cut(distinct.groupBy("_print").agg(F.count(F.lit(1)).alias("_count")).where("_count > 1"), "counts")  # a lone context has nothing to be compared with
    known, most = counts.agg(F.sum("_count"), F.max("_count")).head()
    gone, used = marks(with_bytes(long_ones, distinct.join(counts, "_print")), max(1, (known or 0) // SHARD), most or 0)
    gone = cut(gone, "gone")
    forget(*used)
    names = cut(distinct.select("_print", "_name", F.col("_id").alias("_least")).join(gone, ["_print", "_name"], "left"), "names")  # by itself, so that the next join can split a hot name
    placed = found.join(names, ["_print", "_name"])
    whole, first, windows = F.col("_id") > F.col("_least"), F.shiftright("_place", 10), F.shiftright("_place", 5).bitwiseAND(31)
    span = F.shiftleft(first, 32) + F.when(whole, windows + (LENGTH - 1)).otherwise(F.col("_gone"))
    spans = placed.where(whole | F.col("_gone").isNotNull()).select("_id", "_row", span.alias("_span"))
    spans = spans.unionByName(copies.select("_id", "_row", F.col("_size").cast("long").alias("_span")))
    spans = cut(spans.groupBy("_id", "_row").agg(F.collect_list("_span").alias("_spans")), "spans")
    forget(copies, found, distinct, counts, gone, names)
    both = docs.join(spans, ["_id", "_row"], "left").select("_id", F.col("_times") if repeated else F.lit(1).alias("_times"), "_text", "_spans")
    schema = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_times", T.LongType()), *REMOVED.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, spans in zip(batch.column(2).to_pylist(), lists(batch.column(3))):
                data = text.encode()
                sizes.append(len(data))
                spans = np.sort(spans)
                first = spans >> 32
                end = np.maximum.accumulate(first + (spans & 0xFFFFFFFF))
                heads = np.flatnonzero(np.append(True, first[1:] > end[:-1])) if len(spans) else np.empty(0, np.int64)
                starts, ends = first[heads].tolist(), end[np.append(heads[1:], len(spans)) - 1].tolist() if len(spans) else []
                removed.append([{"start": a, "end": b} for a, b in zip(starts, ends)])
                kept.append(b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), *(pa.array(c, arrow.field(n).type) for c, n in ((sizes, "n_bytes"), (removed, "removed"), (kept, "kept")))], schema=arrow)

    done = both.mapInArrow(cut_out, schema)
    if repeated:
        done = done.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return done.select(F.col("_id").cast(id_type).alias(id_col), *REMOVED.fieldNames())


def digest(removed: DataFrame) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
