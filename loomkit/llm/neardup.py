"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Texts are sequences of words. A shingle is five consecutive words with its occurrence number (the how-manieth of its kind
in the text; a shorter text is one shingle). For each of BANDS orders a sketch is the DEPTH smallest shingles, kept in the
order of the text, so that it tells texts apart that have the same shingles in another order. Two texts are similar if
their edit similarity over words, 1 - distance / words of the longer one, is SIMILARITY or more.

Five-word shingles lose pairs whose edits are spread, so SMALL_BANDS further orders have sketches of SMALL-word shingles, and
texts of up to SHORT words get keys that no similar pair can evade (segments, by the pigeonhole principle).

Texts that are equal word for word form one node. Nodes that share a key meet in a bucket, and are compared in three turns:
1. each with the least node of its bucket, the same for all buckets that it is in;
2. each with nodes that come first in DRAWS other orders, of which each bucket uses one, if their classes still differ: a
   large group of near copies is one class by now;
3. all pairs of a bucket that are still in different classes. A bucket of more than CROWD nodes would make too many: its
   nodes, mostly unlike texts with one passage in common, are dealt anew, by length, and those of about one length are
   compared if they share one of the words that are rarest among them. Similar texts share one of the rarest fifth of their
   words for certain (a prefix filter), so no pair is lost by that. Before, those nodes go of which too many short runs of
   words stand in no other class: each such run takes an edit of its own.
So any two similar texts that share a key end in one class, through whatever turn. Lengths and counts of words rule out
pairs before their texts are fetched; links that alignment confirms give classes by connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.llm.common import annotate, cut, dealt_once, forget, named, whole_row, words

SHINGLE, BANDS, SIMILARITY = 5, 32, 0.8
#: Shingles of a sketch.
DEPTH = 2
#: Words of the second kind of shingles, and their orders.
SMALL, SMALL_BANDS = 3, 64
#: Words of the longest texts that are compared with all similar ones for certain.
SHORT = 30
#: Counts of words by hash, 255 at most each, that rule out pairs.
BINS = 256
#: The same for nodes of crowded buckets, a multiple of BINS: their texts have much in common, so that few counts rule out little.
FINE_BINS = 2048
#: Bits that say of many pairs of crowded nodes that their counts differ by too much, a divisor of FINE_BINS.
ODD = 512
#: Nodes of a bucket from which it is dealt anew, and nodes that are compared with each other (or as many others) at once.
CROWD, BLOCK = 256, 1000
#: Nodes of a block of crowded ones, in times BLOCK. A node goes to as many tasks as its length has blocks, in rounds of
#: COPIES rows of each node in the mean, so that disk grows no faster than the crowd.
CROWD_BLOCKS, COPIES = 8, 4
#: Orders of nodes by hash for the second turn; pairs of a hub that one task compares.
DRAWS, STAR = 4, 1000
#: Counters of words by hash that say which ones are rare (their number bounds what is broadcast).
COUNTERS = 1 << 18
#: Words of the runs that tell whether other classes have a text's passages; bits by hash that say so, or which keys are
#: shared (a power of 2, which bounds what is broadcast), and those of a slice that one task merges.
RUNS, BITS, SLICE = (1, 2, 3), 1 << 26, 1 << 20
#: Pairs whose fine counts are compared at once, and pairs that are made at once.
AT_A_TIME, MADE_AT_ONCE = 1 << 10, 1 << 19
#: Hashes that are put in all orders at once (memory of a very long text).
AT_ONCE = 1 << 22
#: An odd factor for each order (from a fixed seed, so that all workers agree).
FACTORS = np.random.default_rng(20240229).integers(1, 1 << 62, BANDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SMALL_FACTORS = np.random.default_rng(20240301).integers(1, 1 << 62, SMALL_BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LETTERS = np.random.default_rng(20240302).integers(1, 1 << 62, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """An order of hashes of its own for each factor."""
    x = (x ^ (x >> np.uint64(31))) * factor
    return x ^ (x >> np.uint64(29))


def word_hashes(found: list[bytes]) -> np.ndarray:
    """Hashes of words: sums of their bytes, each times a factor of its place."""
    if not found:
        return np.empty(0, np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(found), np.uint8).astype(np.uint64) + np.uint64(1)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    h = np.add.reduceat(data * LETTERS[place & (len(LETTERS) - 1)], starts)
    return mixed(h ^ sizes.astype(np.uint64), STEP)


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words (hashes h), equal ones alike."""
    n = max(0, len(h) - size + 1)
    s = np.zeros(n, np.uint64)
    for k in range(size):
        s = (s ^ h[k : k + n]) * STEP
        s ^= s >> np.uint64(32)
    return s


def shingle_hashes(found: list[bytes], size: int = SHINGLE, h: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the shingles of `size` words with their occurrence numbers, in the order of the text; h: the words' hashes."""
    if not found:
        return np.empty(0, np.uint64)
    h = word_hashes(found) if h is None else h
    if len(found) >= size:
        s = run_hashes(h, size)
    else:
        s = np.array([xxhash.xxh64_intdigest(b" ".join(found))], np.uint64)
    ranked = np.sort(s)
    if (ranked[1:] != ranked[:-1]).all():
        return s
    order = np.argsort(s, kind="stable")
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    if len(first) < len(s):
        number = np.empty(len(s), np.uint64)
        number[order] = (np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))).astype(np.uint64)
        s = np.where(number > 0, mixed(s + number * STEP, FACTORS[BANDS]), s)
    return s


def sketches(s: np.ndarray, factors: np.ndarray = FACTORS[:BANDS], depth: int = DEPTH) -> np.ndarray:
    """By order, the hashes of the sketches of a text's shingles; equal for equal sketches of one order."""
    step, keys = max(1, AT_ONCE // len(s)), []
    base = s ^ (s >> np.uint64(31))
    for at in range(0, len(factors), step):
        here = factors[at : at + step]
        m, rows = base[None, :] * here[:, None], np.arange(len(here))  # an order of the shingles by each factor
        least = []
        for _ in range(min(depth, len(s))):
            least.append(m.argmin(1))
            m[rows, least[-1]] = ~np.uint64(0)
        key = here + np.uint64(depth)
        for column in s[np.sort(least, axis=0)]:
            key = mixed(key ^ column, STEP) * STEP + np.uint64(1)
        keys.append(key)
    return np.concatenate(keys)


def short_keys(h: np.ndarray, similarity: float = SIMILARITY) -> list[int]:
    """Keys of which a text of up to SHORT words (hashes h) shares one with each similar text of up to SHORT words.

    If a text of `longer` words has at most k edits to another, one of its k + 1 segments stands unchanged in the other one,
    and of those there is one that has moved by no more than the edits that can lie to its left and to its right.
    """
    n, keys = len(h), set()
    for longer in range(n, SHORT + 1):
        k = int((1 - similarity) * longer + 1e-9)
        extra = longer - n
        for i in range(k + 1) if 0 < k >= extra else ():
            at, end = longer * i // (k + 1), longer * (i + 1) // (k + 1)
            for start in range(max(0, at - i, at - extra - (k - i)), min(n - (end - at), at + i, at - extra + (k - i)) + 1):
                keys.add(xxhash.xxh64_intdigest(h[start : start + end - at].tobytes(), seed=longer << 8 | i))
    return np.array(sorted(keys), np.uint64).view(np.int64).tolist()


def word_bins(h: np.ndarray, bins: int = BINS) -> bytes:
    return np.minimum(np.bincount((h % np.uint64(bins)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def most_apart(a: np.ndarray, b: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """By how much counts of words of the texts numbered a and b can differ, of n words, if they are similar; negative: they can't be.

    A substitution changes the counts by 2 at most, an insertion or deletion by 1; of the latter there are at least as many as
    the lengths differ by.
    """
    most, apart = ((1 - similarity) * np.maximum(n[a], n[b]) + 1e-9).astype(np.int64), np.abs(n[a] - n[b])
    return np.where(apart <= most, 2 * most - apart, -1)


def possible(a: np.ndarray, b: np.ndarray, n: np.ndarray, bins: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the texts numbered a and b can be similar, by lengths and counts of words."""
    x, y = bins[a], bins[b]
    return (np.maximum(x, y) - np.minimum(x, y)).sum(1, dtype=np.int64) <= most_apart(a, b, n, similarity)


def odd_bits(bins: np.ndarray) -> np.ndarray:
    """ODD bits of each row of counts, as 64-bit words, of which two rows differ in no more than their counts: whether sums of counts are odd."""
    bits = np.packbits(bins & 1, axis=1).reshape(len(bins), -1, ODD // 8)
    return np.bitwise_xor.reduce(bits, axis=1).view(np.uint64)


def within(a: list[bytes], b: list[bytes], most: int) -> bool:
    """Whether the edit distance of a and b is at most `most`: bit-parallel alignment in a band of that many diagonals."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    end = 0
    while end < high - low and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[low : len(a) - end], b[low : len(b) - end]
    if not b:
        return len(a) <= most
    # rows are the words of a, columns those of b; column j holds the rows j - most to j + most
    width = 2 * most + 1
    full = (1 << width) - 1
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << (i + most)
    get, last = places.get, len(a) - len(b)
    up, down = full >> most << most, 0  # vertical steps of +1 and -1
    at, distance = 1 << (most + last), last  # the diagonal on which the alignment ends
    for j, w in enumerate(b):
        match = (get(w, 0) >> j) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right_up = down | ~(diagonal | up)
        right_down = diagonal & up
        if not diagonal & at:
            distance += 1
            if distance > most:
                return False
        shifted = diagonal >> 1
        up = (right_down | ~(shifted | right_up)) & full
        down = shifted & right_up & full
    return distance <= most


def similar(a: list[bytes], b: list[bytes], share: float = SIMILARITY) -> bool:
    return within(a, b, int((1 - share) * max(len(a), len(b)) + 1e-9))


def counted(a: list[bytes]) -> dict[bytes, int]:
    counts: dict[bytes, int] = {}
    for w in a:
        counts[w] = counts.get(w, 0) + 1
    return counts


def enough_alike(counts: dict[bytes, int], b: list[bytes], least: int) -> bool:
    """Whether a text with these counts of words and b have `least` words in common: no alignment can match more."""
    left, missing = counts.copy(), len(b) - least
    if missing < 0:
        return False
    for w in b:
        n = left.get(w, 0)
        if n:
            left[w] = n - 1
        else:
            missing -= 1
            if missing < 0:
                return False
    return True


def node_of(text: str | None, found: list[bytes]) -> bytes:
    """A 128-bit name for all texts with these words (for one without words: with this very text)."""
    return xxhash.xxh3_128_digest(b" ".join(found) if found else b"\n" + (text or "").encode())


NODE = T.StructType([T.StructField("_node", T.BinaryType())])


def with_nodes(df: DataFrame, text_col: str) -> DataFrame:
    """df with _node."""
    return annotate(df, text_col, lambda: lambda texts: [(node_of(t, words(t)),) for t in texts], NODE)


def sketch_rows(df: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """_node, _id, _n (words), _bins, _keys (of sketches and segments; none without words) and _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys, sizes, bins = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = words(text)
                nodes.append(node_of(text, found))
                h = word_hashes(found)
                own = [sketches(shingle_hashes(found, SHINGLE, h)), sketches(shingle_hashes(found, SMALL, h), SMALL_FACTORS)] if found else []
                keys.append([*np.concatenate(own).view(np.int64).tolist(), *short_keys(h, similarity)] if found else [])
                sizes.append(len(found))
                bins.append(word_bins(h))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(bins, pa.binary()), pa.array(keys, pa.list_(pa.int64())), batch.column(1)], names=["_node", "_id", "_n", "_bins", "_keys", "_text"])

    kinds = {"_node": T.BinaryType(), "_id": df.schema[id_col].dataType, "_n": T.LongType(), "_bins": T.BinaryType(), "_keys": T.ArrayType(T.LongType()), "_text": T.StringType()}
    return df.select(named(id_col), named(text_col)).mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in kinds.items()]))


def marked(keys: DataFrame) -> np.ndarray:
    """BITS bits (as bytes), of which those are set that the lowest bits of the keys (_key) name."""
    bit = F.pmod("_key", F.lit(BITS)) + 1
    slices = keys.groupBy(F.bitmap_bucket_number(bit).alias("_slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))
    bits = np.zeros(BITS // 8, np.uint8)
    for k, found in slices.collect():  # BITS bits at most
        bits[(k - 1) * len(found) : k * len(found)] = np.frombuffer(found, np.uint8)[: len(bits)]
    return bits


def shared(nodes: DataFrame) -> DataFrame:
    """The rows (_key, _node, _n) of nodes (_node, _n, _keys) whose key several nodes have.

    Most keys are of one node. Of these, bits leave the less the fewer keys are shared, so that few rows are moved in vain.
    """
    many = cut(nodes.select(F.explode("_keys").alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1").select("_key"), "many")
    spread = nodes.sparkSession.sparkContext.broadcast(marked(many))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            key, of = lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            bit = key.to_numpy().view(np.uint64) & np.uint64(BITS - 1)
            at = np.flatnonzero(spread.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
            of = pa.array(of[at])
            yield pa.RecordBatch.from_arrays([key.take(pa.array(at)), batch.column(0).take(of), batch.column(1).take(of)], names=["_key", "_node", "_n"])

    rows = nodes.select("_node", "_n", "_keys").mapInArrow(run, "_key long, _node binary, _n long")
    found = cut(rows.join(many, "_key"), "shared")
    forget(many)
    return found


def still_open(met: DataFrame, classes: DataFrame) -> DataFrame:
    """met (_key, _node, _n) with _root and _size, without the buckets that are within one class; classes has _node and _root.

    What is found of a bucket is cut before it is joined to its rows, here and in stars(): a join of two plain shuffles is one
    that Spark splits if a key is hot.
    """
    rows = met.join(classes, "_node")
    open_ = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_size"), (F.min("_root") < F.max("_root")).alias("_open")).where("_open")
    open_ = cut(open_.select("_key", "_size"), "open-keys")
    found = cut(rows.join(open_, "_key"), "open")
    forget(open_)
    return found


def stars(rows: DataFrame, draw: bool, similarity: float) -> DataFrame:
    """Distinct pairs (_hub, _node) of a node of each bucket and those of other classes and a possible length.

    rows has _key, _node, _root and _n. The hub is the bucket's least node, or (draw) the first one in the order that the bucket
    uses.
    """
    order = F.xxhash64(F.pmod("_key", F.lit(DRAWS)), "_node") if draw else F.lit(0)
    hubs = rows.groupBy("_key").agg(F.min(F.struct(order.alias("o"), F.col("_node").alias("hub"), F.col("_root").alias("root"), "_n")).alias("_first"))
    hubs = cut(hubs.select("_key", F.col("_first.hub").alias("_a"), F.col("_first.root").alias("_a_root"), F.col("_first._n").alias("_a_n")), "hubs")
    alike = F.abs(F.col("_n") - F.col("_a_n")) <= F.floor((1 - similarity) * F.greatest("_n", "_a_n") + 1e-9)
    met = rows.join(hubs, "_key").where((F.col("_root") != F.col("_a_root")) & alike)
    found = cut(met.select(F.least("_a", "_node").alias("_hub"), F.greatest("_a", "_node").alias("_node")).distinct(), "stars")
    forget(hubs)
    return found


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs that may be similar by lengths and counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if k := batch.num_rows:
                n = np.concatenate([batch.column(c).to_numpy() for c in (2, 4)])
                bins = np.frombuffer(b"".join(batch.column(3).to_pylist() + batch.column(5).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)
                ok = possible(np.arange(k), np.arange(k, 2 * k), n, bins, similarity)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["_hub", "_node"]).filter(pa.array(ok))

    sizes = nodes.select("_node", "_n", "_bins")
    both = pairs.join(sizes, "_node").join(sizes.toDF("_hub", "_hub_n", "_hub_bins"), "_hub").select("_hub", "_node", "_hub_n", "_hub_bins", "_n", "_bins")
    return both.mapInArrow(run, "_hub binary, _node binary")


def levels(n: np.ndarray, similarity: float) -> np.ndarray:
    """Levels of texts by their numbers of words; those of similar texts are the same or next to each other."""
    return (np.log(np.maximum(n, 1)) / np.log(1.0001 / similarity)).astype(np.int64)


def meeting(lists: list[np.ndarray] | None, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of n lists (the first place less) that have a number in common, about MADE_AT_ONCE at a time.

    A pair can come more than once. Without lists, or if they make no fewer, they are all pairs.
    """
    at, later = np.arange(n), np.arange(n)[::-1]  # places, and how many of those after each make a pair with it
    if lists is not None:
        held = np.repeat(at, [len(x) for x in lists])
        order = np.argsort(numbers := np.concatenate(lists), kind="stable")
        numbers, held = numbers[order], held[order]
        ends = np.flatnonzero(np.append(numbers[1:] != numbers[:-1], True)[: len(numbers)]) + 1
        after = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(len(numbers)) - 1
        if after.sum() < later.sum():
            at, later = held, after
    upto = np.cumsum(later)
    cuts = np.searchsorted(upto, np.arange(MADE_AT_ONCE, (upto[-1] if n and len(upto) else 0) + MADE_AT_ONCE, MADE_AT_ONCE)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
        count = later[low:high]
        first = np.repeat(np.arange(low, low + len(count)), count)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
        if len(first):
            yield at[first], at[second]


def rivals(met: DataFrame, similarity: float, sizes: DataFrame | None = None, part: int = 0, parts: int = 1) -> DataFrame:
    """Distinct pairs (_hub, _node) of nodes that share a key, are in different classes and may be similar.

    met has _key, _node and _root; sizes (or met) has _n and _bins (BINS or a multiple) of each _node, which are fetched only
    for buckets of several classes. A bucket of many members is dealt out by pairs of blocks of about BLOCK. If met has _before
    (by_rare_words()), only nodes that have one of these words in common make a pair, once, and blocks are CROWD_BLOCKS times as
    large. Each of the parts gives pairs of its own.
    """
    rare = "_before" in met.columns
    block = BLOCK * CROWD_BLOCKS if rare else BLOCK
    open_ = met.groupBy("_key").agg(F.count(F.lit(1)).alias("_size"), (F.min("_root") < F.max("_root")).alias("_open")).where("_open")
    blocks = F.ceil(F.col("_size") / block).cast("int")
    rows = met.join(open_, "_key")
    rows = rows if sizes is None else rows.join(sizes, "_node")
    place, held = ["_key", "_low", "_high"], ["_node", "_root", "_n", "_bins", *(["_before"] if rare else [])]
    one = rows.where(F.col("_size") <= block).select("_key", *(F.lit(0).alias(c) for c in ("_low", "_high", "_i")), *held)
    many = rows.where(F.col("_size") > block).withColumn("_i", F.pmod(F.xxhash64("_node"), blocks).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = one.unionByName(many.select("_key", F.least("_i", "_j").alias("_low"), F.greatest("_i", "_j").alias("_high"), "_i", *held))
    rows = rows if parts == 1 else rows.where(F.pmod(F.xxhash64(*place), F.lit(parts)) == part)

    def pairs(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, low, high, side, n = (group.column(c).to_numpy() for c in (*place, "_i", "_n"))
        root = group.column("_root").combine_chunks().dictionary_encode().indices.to_numpy()
        fine = np.frombuffer(b"".join(group.column("_bins").to_pylist()), np.uint8).reshape(len(n), -1)
        bins = fine.reshape(len(n), -1, BINS).sum(1, dtype=np.int16)
        if rare:
            level, odd = levels(n, similarity), odd_bits(fine)
            numbers = [np.frombuffer(x, np.uint32) for x in group.column("_before").to_pylist()]
        ends = np.flatnonzero(np.append((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]), True)) + 1
        for at, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
            made = np.empty(0, np.int64)
            for a, b in meeting(numbers[at:end] if rare else None, end - at):
                a, b = a + at, b + at
                apart = root[a] != root[b]
                if low[at] != high[at]:
                    apart &= side[a] != side[b]
                if rare:
                    apart &= np.maximum(level[a], level[b]) == key[at]  # two of one level meet in two buckets
                a, b = a[apart], b[apart]
                ok = np.abs(n[a] - n[b]) <= (1 - similarity) * np.maximum(n[a], n[b]) + 1e-9
                a, b = a[ok], b[ok]
                if rare:
                    ok = np.bitwise_count(odd[a] ^ odd[b]).sum(1, dtype=np.int64) <= most_apart(a, b, n, similarity)
                    new = np.setdiff1d(a[ok] * len(n) + b[ok], made)
                    made = np.append(made, new)
                    a, b = np.divmod(new, len(n))
                for k in range(0, len(a), 1 << 13):
                    x, y = a[k : k + (1 << 13)], b[k : k + (1 << 13)]
                    ok = possible(x, y, n, bins, similarity)
                    x, y = x[ok], y[ok]
                    if fine.shape[1] > BINS:
                        ok = [possible(x[j : j + AT_A_TIME], y[j : j + AT_A_TIME], n, fine, similarity) for j in range(0, len(x), AT_A_TIME)]
                        ok = np.concatenate([np.empty(0, bool), *ok])
                        x, y = x[ok], y[ok]
                    yield x, y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(held)
            nodes = group.column("_node").combine_chunks()
            for a, b in pairs(group):
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, bool)  # rows that begin a bucket or a pair of its blocks
            columns = [batch.column(c).to_numpy() for c in place]
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            if held:
                new[0] = any(c[0] != held[-1].column(name)[-1].as_py() for c, name in zip(columns, place))
            starts = np.flatnonzero(new)
            if len(starts):  # all before the last start is whole
                first, last = batch.slice(0, starts[-1]), batch.slice(starts[-1])
                if first.num_rows:
                    held.append(first)
                if held:
                    yield from out()
                held = [last]
            else:
                held.append(batch)
        if held:
            yield from out()

    found = rows.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "a binary, b binary")
    return found.select(F.least("a", "b").alias("_hub"), F.greatest("a", "b").alias("_node")).distinct()


def rounds(met: DataFrame) -> int:
    """Parts of rivals() of met (by_rare_words()) that make COPIES copies of each row at most, in the mean."""
    sizes = [n for _, n in met.groupBy("_key").count().collect()]  # a row for each level of length
    return max(1, -(-sum(n * -(-n // (BLOCK * CROWD_BLOCKS)) for n in sizes) // (COPIES * max(1, sum(sizes)))))


def runs_by_length(h: np.ndarray, similarity: float) -> list[np.ndarray]:
    """Places in BITS of a text's runs of each of RUNS words, in two rows, of which similar texts have one in common.

    A similar text's length is in the same level or in one next to it, so each text uses its own and the next one.
    """
    level = int(levels(np.array([len(h)]), similarity)[0])
    found = []
    for size in RUNS:
        s = run_hashes(h, size)
        found.append(np.stack([mixed(s ^ np.uint64(k), STEP) * STEP >> np.uint64(65 - BITS.bit_length()) for k in (level, level + 1)]))
    return found


def least_edits(there: list[np.ndarray]) -> int:
    """Edits at least between a text and one of another class; there: by RUNS, whether another class may have its runs.

    Of runs that no other class has and that don't overlap, each takes an edit; the most of them are found from left to right.
    """
    n = len(there[0])
    start = np.full(n, -1)  # of the shortest such run by its last word
    for size, known in reversed(list(zip(RUNS, there))):
        at = np.flatnonzero(~known)
        start[at + size - 1] = at
    ends = np.flatnonzero(start >= 0)
    edits, last = 0, -1
    for end, first in zip(ends.tolist(), start[ends].tolist()):
        if first > last:
            edits, last = edits + 1, end
    return edits


def with_chances(texts: DataFrame, similarity: float) -> DataFrame:
    """The rows of texts (_node, _root, _text) without those that can't be similar to one of another _root.

    A similar text has all runs of words that no edit touches. Which runs several classes have, BITS bits say: each task
    gives the least and greatest class of each bit that its texts use, as arrays by slices of bits, and these are merged.
    """

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            at, of = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(at)
            at, of = at[order], of[order]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            low, high, at = np.minimum.reduceat(of, first), np.maximum.reduceat(of, first), at[first].astype(np.int64)
            cuts = np.searchsorted(at, np.arange(0, BITS + 1, SLICE)).tolist()
            some = [(k, x, y) for k, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]
            several = [low[x:y] < high[x:y] for _, x, y in some]
            bits = [np.concatenate([at[x:y], at[x:y][m]]).astype(np.int32) % SLICE for (_, x, y), m in zip(some, several)]
            classes = [np.concatenate([low[x:y], high[x:y][m]]) for (_, x, y), m in zip(some, several)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in some], pa.int32()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in (bits, classes))], names=["_slice", "_at", "_of"])

        for batch in batches:
            for root, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = np.concatenate([x.ravel() for x in runs_by_length(word_hashes(words(text)), similarity)])
                held.append((at, np.full(len(at), np.frombuffer(root.ljust(8, b"\0")[:8], np.uint64)[0])))
                size += len(at)
                if size >= AT_ONCE:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, low, high = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(low < high).tobytes()], pa.binary())], names=["_slice", "_bits"])

        for batch in batches:
            for slice_, at, of in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if slice_ != now:
                    if now is not None:
                        yield out()
                    now, low, high = slice_, np.full(SLICE, ~np.uint64(0)), np.zeros(SLICE, np.uint64)
                at, of = np.frombuffer(at, np.int32), np.frombuffer(of, np.uint64)
                np.minimum.at(low, at, of)
                np.maximum.at(high, at, of)
        if now is not None:
            yield out()

    bits = np.zeros(BITS // 8, np.uint8)
    used = texts.select("_root", "_text").mapInArrow(use, "_slice int, _at binary, _of binary")
    for k, found in used.repartition("_slice").sortWithinPartitions("_slice").mapInArrow(merge, "_slice int, _bits binary").collect():  # BITS bits at most
        bits[k * SLICE // 8 : (k + 1) * SLICE // 8] = np.frombuffer(found, np.uint8)
    spread = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for text in batch.column(2).to_pylist():
                h = word_hashes(words(text))
                there = [(spread.value[(x >> np.uint64(3)).astype(np.int64)] >> (7 - (x & np.uint64(7)).astype(np.uint8)) & 1).any(0) for x in runs_by_length(h, similarity)]
                ok.append(least_edits(there) <= int((1 - similarity) / similarity * len(h) + 1e-6))
            yield batch.filter(pa.array(ok, pa.bool_()))

    return texts.select("_node", "_root", "_text").mapInArrow(run, "_node binary, _root binary, _text string")


def fine_counts(texts: DataFrame) -> DataFrame:
    """_node, _n and _bins (FINE_BINS) of texts (_node, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(text) for text in batch.column(1).to_pylist()]
            bins = [word_bins(word_hashes(w), FINE_BINS) for w in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, found), pa.int64()), pa.array(bins, pa.binary())], names=["_node", "_n", "_bins"])

    return texts.select("_node", "_text").mapInArrow(run, "_node binary, _n long, _bins binary")


def by_rare_words(texts: DataFrame, similarity: float) -> DataFrame:
    """_key, _node and _before of texts (_node, _text): a text's rarest words, as many as any similar text shares one of.

    The words of a text, with their occurrence numbers, are put in one order for all texts, rare ones first. Texts of which
    the longer one has n words are similar only if they have all but (1 - SIMILARITY) n of them in common, so the first
    (1 - SIMILARITY) n + 1 of each can't all differ. How rare a word is, COUNTERS counters say: a fixed size. _before has 32 bits
    of the hash of each of them, without those that no other text has; texts without such words have no row. _key is the
    level of the text's length or the next one: two rows a text, however many words it has.
    """

    def tokens(text: str) -> np.ndarray:
        return shingle_hashes(words(text), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(counts, (tokens(text) % np.uint64(COUNTERS)).astype(np.int64), 1)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["_counter", "_count"])

    spark, counts = texts.sparkSession, np.zeros(COUNTERS, np.int64)
    for counter, n in texts.select("_text").mapInArrow(count, "_counter long, _count long").groupBy("_counter").sum("_count").collect():  # COUNTERS rows at most
        counts[counter] = n
    spread = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys, before = [], [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = tokens(text)
                often = spread.value[(own % np.uint64(COUNTERS)).astype(np.int64)]
                rare = np.lexsort((own, often))[: int((1 - similarity) * len(own) + 1e-9) + 1]
                first = own[rare[often[rare] > 1]]  # a counter of 1 is a word of this text alone
                if len(first):
                    level = int(levels(np.array([len(own)]), similarity)[0])
                    nodes += [node, node]
                    keys += [level, level + 1]
                    before += [np.unique(first.astype(np.uint32)).tobytes()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.binary()), pa.array(before, pa.binary())], names=["_key", "_node", "_before"])

    return texts.select("_node", "_text").mapInArrow(run, "_key long, _node binary, _before binary")


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose texts are similar; texts has _node and _text, once for each node.

    The pairs of a hub come one after the other, so that its words are read once. A hub of more than STAR pairs has them
    dealt to parts, and its text goes to each part once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, a, counts = None, [], {}
        for batch in batches:
            ok = []
            for text, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if text != hub:
                    hub, a = text, words(text)
                    counts = counted(a)
                b = words(other)
                longer = max(len(a), len(b))
                most = int((1 - similarity) * longer + 1e-9)
                ok.append(abs(len(a) - len(b)) <= most and enough_alike(counts, b, longer - most) and within(a, b, most))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    large = cut(pairs.groupBy("_hub").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("_parts")).where("_parts > 1"), "large-hubs")
    others = pairs.join(texts, "_node")
    if large.isEmpty():
        both = others.join(texts.toDF("_hub", "_hub_text"), "_hub")
    else:
        parts = pairs.select("_hub").distinct().join(large, "_hub", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        hub_texts = parts.select("_hub", "_part").join(texts.toDF("_hub", "_hub_text"), "_hub")
        dealt = pairs.join(large, "_hub", "left").select("_hub", "_node", F.coalesce(F.pmod(F.xxhash64("_node"), F.col("_parts")), F.lit(0)).cast("int").alias("_part"))
        both = dealt.join(texts, "_node").join(hub_texts, ["_hub", "_part"])
    found = cut(both.select("_hub", "_node", "_hub_text", "_text").mapInArrow(run, "a binary, b binary"), "links")
    forget(large)
    return found


def components(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """node and root (the least node of its component) for all nodes of edges (a, b), and the tables that it reads.

    Large and small stars alternate: every node's neighbours are hung to its least neighbour, first the greater ones, then
    the others, until nothing changes. All steps are joins and minima; each round is cut to the shared folder.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(down, "a")
        small = hung.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        before, now = now, cut(small.distinct(), "edges")
        forget(before)
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), [now]


def node_classes(df: DataFrame, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Of each distinct text _node, _class (least id of its class) and _keeper (whether it is the node with that id); and _node and _id of all rows."""
    total = df.agg(F.sum(F.octet_length(named(text_col)).cast("long"))).head()[0] or 0
    rows = cut(with_nodes(df.select(named(id_col).alias("_id"), named(text_col).alias("_text")), "_text").select("_node", "_id"), "rows")
    sketched = sketch_rows(df, id_col, text_col, similarity)
    nodes = dealt_once(sketched.groupBy("_node").agg(F.min("_id").alias("_id"), *(F.first(c).alias(c) for c in ("_n", "_bins", "_keys", "_text"))), ["_node"], total, grouped=True)
    met = shared(nodes)
    texts = nodes.select("_node", "_text")

    def linked(classes: DataFrame, pairs: DataFrame, checked: bool = False) -> DataFrame:
        """The classes (_node, _root) after the similar ones of pairs are joined."""
        likely = cut(pairs if checked else plausible(pairs, nodes, similarity), "pairs")
        if likely.isEmpty():
            forget(likely)
            return classes
        links = confirmed(likely, texts, similarity)
        if links.isEmpty():
            forget(likely, links)
            return classes
        a, b = (classes.select(F.col("_node").alias(c), F.col("_root").alias(f"_root_{c}")) for c in "ab")
        edges = links.join(a, "a").join(b, "b").select(F.col("_root_a").alias("a"), F.col("_root_b").alias("b"))
        roots, used = components(edges)
        joined = classes.join(roots.withColumnRenamed("node", "_root"), "_root", "left")
        found = cut(joined.select("_node", F.coalesce("root", "_root").alias("_root")), "classes")
        forget(likely, links, *used)
        return found

    alone = nodes.select("_node", F.col("_node").alias("_root"))
    near = stars(met.withColumn("_root", F.col("_node")), False, similarity)
    first = linked(alone, near)
    left = still_open(met, first)
    second, used = first, []
    if not left.isEmpty():
        drawn = stars(left, True, similarity)
        second = linked(first, drawn)
        used += [left, drawn]
        left = still_open(met, second)
    crowded = left.where(F.col("_size") > CROWD).select("_node").distinct()
    pairs = rivals(left.where(F.col("_size") <= CROWD).select("_key", "_node", "_root"), similarity, nodes.select("_node", "_n", "_bins"))
    if not crowded.isEmpty():
        used.append(cut(texts.join(crowded, "_node").join(second, "_node").select("_node", "_root", "_text"), "crowded"))
        used.append(cut(with_chances(used[-1], similarity), "chances"))
        again = cut(by_rare_words(used[-1], similarity).join(used[-1].select("_node", "_root"), "_node").select("_key", "_node", "_root", "_before"), "rare")
        parts, counts = rounds(again), fine_counts(used[-1])
        rare = [rivals(again, similarity, counts, k, parts) for k in range(parts)]
        rare = rare if parts == 1 else [cut(x, "rivals") for x in rare]  # one after the other
        pairs = reduce(DataFrame.unionByName, rare, pairs).distinct()
        used += [again, *(rare if parts > 1 else [])]
    last = second if left.isEmpty() else linked(second, pairs, True)
    of = nodes.select("_node", "_id").join(last, "_node")
    least = cut(of.groupBy("_root").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_node")).alias("_least")), "least")
    classes = of.join(least, "_root").select("_node", F.col("_least._id").alias("_class"), (F.col("_node") == F.col("_least._node")).alias("_keeper"))
    classes = cut(classes, "classes")
    forget(nodes, met, near, left, least, *used, *(c for c in (first, second, last) if c is not alone))
    return classes, rows


def near_duplicates(df: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and class_id, one row per row of df: the least id of the class of near-duplicates that it belongs to.

    A null text is an empty one; texts without words are alike only if they are equal. Ties and repeated rows get the same
    class. A null id takes part, and a class has a null class_id only if all its ids are null. Very long texts are compared
    whole. An empty df gives no rows; other columns of df play no part. The result reads two small tables of the shared
    folder: ids and classes.
    """
    classes, rows = node_classes(df, similarity, id_col, text_col)
    return rows.join(classes, "_node").select(F.col("_id").alias(id_col), F.col("_class").alias("class_id"))


def one_of_each(df: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of df with the least id of each class of near-duplicates (one of them, if rows are repeated), all columns as they are.

    Nulls, empty and very long texts count as in near_duplicates(); a class of null ids alone keeps one row. The result reads a
    small table of the shared folder.
    """
    classes, rows = node_classes(df, similarity, id_col, text_col)
    forget(rows)
    keepers = classes.where("_keeper").select(F.col("_node").alias("_node2"), "_class")
    held = df.select(whole_row(df).alias("_row"), named(id_col).alias("_id"), named(text_col).alias("_text"))  # whatever df's columns are named
    match = (F.col("_node") == F.col("_node2")) & F.col("_id").eqNullSafe(F.col("_class"))
    kept = with_nodes(held, "_text").drop("_text").join(keepers, match).dropDuplicates(["_node", "_id"])
    return kept.select("_row.*")
