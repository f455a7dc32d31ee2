"""Token ids in compressed shards: one zstandard dictionary for all, each document compressed by itself.

A store is a folder of two Parquet tables, so that Spark's own commit protocol guards every write:
- dictionary: hash, bytes and width (of a serialized id: 2 or 4 bytes), one row;
- packs: rows of consecutive documents in ascending id order, with shard (ascending too), the ids of their documents,
  start_in_shard (ids of the shard before the pack), for each document its number of ids and the offset of its frame in
  the payload, and the hash of the dictionary. The ids of one document are read by decompressing its frame alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomkit.llm.common import new_path
from loomkit.llm.encode import encoder, packed

#: Documents of a pack and bytes of its payload, at which a new one begins.
PACK_DOCS, PACK_BYTES = 512, 1 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCS, SAMPLE_IDS = 400, 4096
DICTIONARY = "hash string, bytes binary, width int"


def serialized(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def restored(data: bytes, width: int) -> bytes:
    return data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def train(df: DataFrame, tokenizer_path: str, id_col: str, text_col: str, width: int, sample_docs: int) -> zstandard.ZstdCompressionDict:
    """A dictionary from the id arrays of about sample_docs documents (a bound of what the driver sees), drawn by hash.

    A document's array counts in blocks of SAMPLE_IDS ids, of which the first 4 are taken, since a dictionary only
    primes short documents. With too few samples the dictionary is empty, which zstandard takes for none.
    """
    total = df.count()
    every = max(1, total // sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [serialized(encoder(tokenizer_path).encode(t), width) for t in batch.column(0).to_pylist()]
            step = SAMPLE_IDS * width
            yield pa.record_batch([pa.array([x[i : i + step] for x in ids for i in range(0, min(len(x), 4 * step), step)], pa.binary())], ["sample"])

    drawn = df.where(F.col(text_col).isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(every)) == 0)).select(text_col).limit(4 * sample_docs)
    samples = [r[0] for r in drawn.mapInArrow(run, "sample binary").collect()]
    samples = [bytes(s) for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too little to train on
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, width: int = 2, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the ids of all documents of df, end_id after each, to a store at path (which must not exist); returns path.

    A null text is empty (its document is end_id alone), a very long one is encoded whole. Documents are range-partitioned and sorted by id, nulls first,
    ties by their text, so repeated ids and rows are kept as documents that follow each other. Other columns play no
    part. width 2 needs ids under 65,536. An empty df gives a store without packs.
    """
    spark = df.sparkSession
    trained = train(df, tokenizer_path, id_col, text_col, width, sample_docs)
    content = trained.as_bytes()
    mark = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(mark, content, width)], DICTIONARY).coalesce(1).write.parquet(f"{path}/dictionary")
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("first_id", id_type), T.StructField("last_id", id_type), T.StructField("start_in_shard", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("n_ids", T.ArrayType(T.LongType())), T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("dictionary_hash", T.StringType()), T.StructField("payload", T.BinaryType())])
    arrow, spread, end = to_arrow_schema(schema), spark.sparkContext.broadcast(content), packed([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        compress = zstandard.ZstdCompressor(level=3, dict_data=dictionary(spread.value)).compress
        encode = encoder(tokenizer_path).encode
        ids, sizes, frames, n_bytes = [], [], [], 0

        def done() -> pa.RecordBatch:
            offsets = [0, *np.cumsum([len(f) for f in frames]).tolist()]
            row = (shard, ids[0], ids[-1], before, list(ids), list(sizes), offsets, mark, b"".join(frames))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                all_ids = encode(text) + end
                ids.append(doc_id)
                sizes.append(len(all_ids) // 4)
                frames.append(compress(serialized(all_ids, width)))
                n_bytes += len(frames[-1])
                if len(ids) == PACK_DOCS or n_bytes >= PACK_BYTES:
                    yield done()
                    before += sum(sizes)
                    ids, sizes, frames, n_bytes = [], [], [], 0
        if ids:
            yield done()

    docs = df.select(id_col, text_col).repartitionByRange(F.col(id_col), F.crc32(text_col)).sortWithinPartitions(id_col, text_col)
    docs.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/packs")
    return path


def dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(content)


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id_col, start (ids of all documents before), n_tokens and ids (little-endian 32-bit) of every document of a store.

    The dictionary is broadcast (its size is a constant), and so are the sums of the shards: a row for each task of the
    writer. A pack whose dictionary hash differs is an error.
    """
    mark, content, width = spark.read.schema(DICTIONARY).parquet(f"{path}/dictionary").head()
    packs = spark.read.parquet(f"{path}/packs")
    sums = packs.groupBy("shard").agg(F.sum(F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    bases = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    id_type = packs.schema["first_id"].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow, spread = to_arrow_schema(schema), spark.sparkContext.broadcast(bytes(content))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=dictionary(spread.value)).decompress
        for batch in batches:
            for r in batch.to_pylist():
                if r["dictionary_hash"] != mark:
                    raise ValueError(f"a pack was written with dictionary {r['dictionary_hash']}, the store has {mark}")
                starts = [r["begin"], *(r["begin"] + np.cumsum(r["n_ids"])).tolist()]
                ids = [restored(expand(r["payload"][a:b]), width) for a, b in zip(r["offsets"], r["offsets"][1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((r["doc_ids"], starts[:-1], r["n_ids"], ids), arrow)], schema=arrow)

    begun = packs.join(F.broadcast(bases), "shard").withColumn("begin", F.col("base") + F.col("start_in_shard"))
    return begun.select("doc_ids", "n_ids", "offsets", "dictionary_hash", "payload", "begin").mapInArrow(run, schema)


def read_document(spark: SparkSession, path: str, doc_id) -> list[bytes]:
    """The ids of the documents with this id: Parquet's statistics skip other packs, and only their frames are expanded."""
    _, content, width = spark.read.schema(DICTIONARY).parquet(f"{path}/dictionary").head()
    expand = zstandard.ZstdDecompressor(dict_data=dictionary(bytes(content))).decompress
    found = spark.read.parquet(f"{path}/packs").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("doc_ids", "offsets", "payload").collect()
    return [restored(expand(bytes(r.payload)[r.offsets[i] : r.offsets[i + 1]]), width) for r in found for i, x in enumerate(r.doc_ids) if x == doc_id]


def stored(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """df written to a new store in the shared folder and read back."""
    return read(df.sparkSession, write(df, new_path(df.sparkSession, "ids"), tokenizer_path))
