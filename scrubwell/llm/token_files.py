"""Token-ID output: fixed-width packed blocks with offsets, written in document order, read in any order.

A token set is a folder of Parquet rows. ``blocks`` holds one row per block: its shard and number, the position of
its first id inside the shard, the bits of an id, the packed ids and, per document, id and length. ``shards`` holds
the position of each shard's first id in the whole set. A block is closed by the first document that fills it, so
documents never straddle blocks. Ids are packed least significant bit first into the fewest bits that hold the
vocabulary, so one ``numpy`` call unpacks a block, and id *i* of a block starts at bit ``i * bits``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubwell.llm.batches import ids_and_texts, pieces, texts
from scrubwell.llm.tokenizer import encoder, read_spec, vocabulary_size

BLOCKS = (
    "shard int, block int, first bigint, n_ids bigint, bits int, doc_ids array<bigint>, lengths array<bigint>, payload binary"
)
_BLOCKS = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary()),
    ]
)
SHARDS = "shard int, n_ids bigint, n_docs bigint, start bigint"
BLOCK_IDS = 1 << 16


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each, least significant first, the last byte filled with zeros."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, n: int, skip: int = 0) -> np.ndarray:
    """``n`` ids after the first ``skip``, as unsigned 32-bit integers; only the bytes they lie in are touched."""
    low = skip * bits // 8
    data = np.frombuffer(payload, dtype=np.uint8, offset=low, count=((skip + n) * bits + 7) // 8 - low)
    if bits in (8, 16, 32):
        return data.view(f"<u{bits // 8}").astype("<u4")
    lead = skip * bits - low * 8
    narrow = np.unpackbits(data, bitorder="little")[lead : lead + n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, :bits] = narrow
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_ids: int = BLOCK_IDS, shards: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode every whole text, end each document with ``end_id`` and write the packed set to ``path``.

    Documents are dealt by range of their id and sorted, so shard after shard the ids ascend; NULL ids come first and
    rows of one id follow each other by content. NULL and empty texts consist of the end id alone; a table without rows
    gives a set without blocks. Texts are shuffled once and encoded where their shard is written; a task that is run
    again writes the same shard. A task holds the packed ids of one block and the longest of its documents.
    """
    spark = docs.sparkSession
    spec = read_spec(tokenizer)
    bits = bits_for(max(vocabulary_size(spec), end_id + 1))
    sent = spark.sparkContext.broadcast(spec)
    end = np.array([end_id], dtype="<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(sent.value).encode_all
        shard = TaskContext.get().partitionId()
        block, first, n, parts, doc_ids, lengths = 0, 0, 0, [], [], []

        def row() -> pa.RecordBatch:
            payload = pack(np.concatenate(parts), bits)
            values = [shard, block, first, n, bits, doc_ids, lengths, payload]
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, _BLOCKS, strict=True)], schema=_BLOCKS)

        for batch in pieces(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode_all(texts(batch)), strict=True):
                parts += [ids, end]
                doc_ids.append(doc_id)
                lengths.append(len(ids) + 1)
                n += len(ids) + 1
                if n >= block_ids:
                    yield row()
                    block, first, n, parts, doc_ids, lengths = block + 1, first + n, 0, [], [], []
        if n:
            yield row()

    source = ids_and_texts(docs, id_col, text_col)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = source.repartitionByRange(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    blocks = dealt.sortWithinPartitions(*order, F.col("text").asc_nulls_first()).mapInArrow(encode, BLOCKS)
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    sent.unpersist()
    written = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("shard").agg(
        F.sum("n_ids").alias("n_ids"), F.sum(F.size("doc_ids")).cast("bigint").alias("n_docs")
    )  # a row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{path}/shards")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the position of their first id in the whole set."""
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards").select("shard", F.col("start").alias("__start"))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    joined = blocks.join(F.broadcast(shards), "shard")  # a row per shard, which the writer's argument bounds
    return joined.select(*blocks.columns, (F.col("__start") + F.col("first")).alias("start"))


def read_documents(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """A row per document: ``doc_id``, ``start`` (ids before it), ``n_tokens`` (with the end id), ``ids_crc32`` (over its
    ids as little-endian unsigned 32-bit integers) and, if asked for, the ids."""
    schema = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(schema + [("ids", pa.list_(pa.int64()))] * ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            block = batch.to_pylist()[0]
            lengths = np.array(block["lengths"], dtype=np.int64)
            ends = np.cumsum(lengths)
            values = unpack(block["payload"], block["bits"], block["n_ids"])
            own = [values[end - n : end] for n, end in zip(lengths, ends, strict=True)]
            columns = [block["doc_ids"], block["start"] + ends - lengths, lengths, [zlib.crc32(v.tobytes()) for v in own]]
            columns += [[v.astype(np.int64) for v in own]] * ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    wanted = read_blocks(spark, path).select("doc_ids", "lengths", "payload", "bits", "n_ids", "start")
    ddl = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    return wanted.mapInArrow(read, ddl)


def read_range(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """The ids from position ``start`` on, ``n`` at most, from the blocks that hold them alone."""
    blocks = read_blocks(spark, path)
    hit = blocks.filter((F.col("start") < start + n) & (F.col("start") + F.col("n_ids") > start)).orderBy("start")
    parts = []
    for b in hit.select("start", "n_ids", "bits", "payload").toLocalIterator():
        low, high = max(start, b["start"]), min(start + n, b["start"] + b["n_ids"])
        parts.append(unpack(bytes(b["payload"]), b["bits"], high - low, low - b["start"]))
    return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
