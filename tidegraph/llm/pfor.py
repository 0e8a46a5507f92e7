"""Token ids in a binary format: patched frame-of-reference blocks.

A segment holds the ids of some documents, in ascending order of the document key:

    magic "TGPF", version u16, ids per block u16, documents u32, blocks u32, ids u64
    tokens of each document u32[documents]
    start of each block, from the first block's first byte on, u64[blocks]
    blocks: minimum u32, width u8, exceptions u8, packed low bits, positions u8[exceptions], excesses u32[exceptions]

Each block subtracts its minimum and packs at the width that a percentile of its values needs; larger values keep
their low bits in place and stand whole in the exception list.  Segments are binary values of a Parquet table in
the shared folder, written and read by Spark, so that any store will do and a lost task is simply run again.

Defined results: null text is the empty text, which still holds its end id; null keys sort first; rows that share a
key follow one another, equal texts or not; an empty table has no segments; very long texts make segments
longer than the others; an id column named like an output column raises ValueError, other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.llm.common import no_clash, stage, tidy
from tidegraph.llm.tokens import END_ID, encoder, vocabulary_path

BLOCK = 128
HEAD = struct.Struct("<4sHHIIQ")
BLOCK_HEAD = 6


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack(ids: np.ndarray, lengths: np.ndarray, percentile: float = 90.0) -> bytes:
    """A segment of ``ids`` (uint32), split into documents of ``lengths`` ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    head = HEAD.pack(b"TGPF", 1, BLOCK, len(lengths), blocks, n) + lengths.astype("<u4").tobytes()
    if not n:
        return head
    grid = np.empty(blocks * BLOCK, np.uint32)
    grid[:n] = ids
    grid[n:] = ids[-1]
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    delta = grid - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(percentile / 100 * BLOCK)) - 1)
    width = _bit_length(np.partition(delta, rank, axis=1)[:, rank])
    over = (delta.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    n_over = over.sum(axis=1)
    packed = width * (BLOCK // 8)
    sizes = BLOCK_HEAD + packed + 5 * n_over
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    out = np.zeros(int(sizes.sum()), np.uint8)
    for i, b in enumerate(low.astype("<u4").view(np.uint8).reshape(blocks, 4).T):
        out[starts + i] = b
    out[starts + 4], out[starts + 5] = width, n_over
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            bits = np.unpackbits(delta[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
            body = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            out[(starts[rows] + BLOCK_HEAD)[:, None] + np.arange(body.shape[1])] = body
    row, col = np.nonzero(over)
    if len(row):
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(n_over)[:-1]])[row]
        at = starts[row] + BLOCK_HEAD + packed[row]
        out[at + nth] = col
        at = at + n_over[row] + 4 * nth
        for i, b in enumerate(delta[row, col].astype("<u4").view(np.uint8).reshape(-1, 4).T):
            out[at + i] = b
    return head + starts.astype("<u8").tobytes() + out.tobytes()


def unpack(segment: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, tokens of each document) of a segment."""
    magic, version, block, docs, blocks, n = HEAD.unpack_from(segment)
    if (magic, version, block) != (b"TGPF", 1, BLOCK):
        raise ValueError("not a segment of this format")
    at = HEAD.size
    lengths = np.frombuffer(segment, "<u4", docs, at)
    at += 4 * docs
    starts = np.frombuffer(segment, "<u8", blocks, at).astype(np.int64)
    raw = np.frombuffer(segment, np.uint8, offset=at + 8 * blocks)
    if not blocks:
        return np.empty(0, np.uint32), lengths
    four = lambda where: sum(raw[where + i].astype(np.uint32) << np.uint32(8 * i) for i in range(4))
    low, width, n_over = four(starts), raw[starts + 4].astype(np.int64), raw[starts + 5].astype(np.int64)
    delta = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            body = raw[(starts[rows] + BLOCK_HEAD)[:, None] + np.arange(w * BLOCK // 8)]
            bits = np.zeros((len(rows), BLOCK, 32), np.uint8)
            bits[:, :, :w] = np.unpackbits(body, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            delta[rows] = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
    total = int(n_over.sum())
    if total:
        row = np.repeat(np.arange(blocks), n_over)
        nth = np.arange(total) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        at = starts[row] + BLOCK_HEAD + width[row] * (BLOCK // 8)
        delta[row, raw[at + nth]] = four(at + n_over[row] + 4 * nth)
    return (delta + low[:, None]).reshape(-1)[:n], lengths


def write_segments(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", path: str | None = None, end_id: int | None = END_ID, ids_per_segment: int = 1 << 18) -> DataFrame:
    """The staged table (part, seg, n_ids, keys, segment): ids of all documents in ascending key order.

    Texts are dealt out by ranges of the key, so part and seg in order are the keys in order; what crosses the
    network is the text, once.
    """
    path = path or vocabulary_path()
    key = docs.schema[id_column].dataType
    ranged = docs.select(F.col(id_column).alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key")
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seg", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("keys", T.ArrayType(key)), T.StructField("segment", T.BinaryType())])

    def write(batches):
        from pyspark import TaskContext

        part, seg, encode = TaskContext.get().partitionId(), 0, encoder(path)
        held: list[tuple] = []  # (keys, ids, ids of each document) of the segment under way
        size = 0

        def flush():
            keys, ids, sizes = (list(x) for x in zip(*held, strict=True))
            keys, sizes = pa.concat_arrays(keys), np.concatenate(sizes)
            listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            body = pack(np.concatenate(ids), sizes.astype(np.uint32))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([int(sizes.sum())], pa.int64()), listed, pa.array([body], pa.binary())], names=schema.names)

        for batch in batches:
            for row, ids, sizes in encode(batch.column(1), end_id):
                ends, doc = np.cumsum(sizes), 0
                while doc < len(sizes):
                    done = int(ends[doc - 1]) if doc else 0
                    stop = min(len(sizes), int(np.searchsorted(ends, done + ids_per_segment - size)) + 1)
                    held.append((batch.column(0).slice(row + doc, stop - doc), ids[done : ends[stop - 1]], sizes[doc:stop]))
                    size += int(ends[stop - 1]) - done
                    doc = stop
                    if size >= ids_per_segment:
                        yield flush()
                        held, size, seg = [], 0, seg + 1
        if held:
            yield flush()

    return stage(ranged.mapInArrow(tidy(write), schema), "pfor-segments")


def read_documents(segments: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the stored segments."""
    no_clash([id_column], ["part", "seg", "local", "base", "start", "n_tokens", "ids_crc32"])
    key = segments.schema["keys"].dataType.elementType
    index = segments.select("part", "seg", "n_ids")
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    within = Window.partitionBy("part").orderBy("seg")
    bases = index.withColumn("own", F.sum("n_ids").over(within) - F.col("n_ids")).join(parts.select("part", "base"), "part")
    bases = bases.select("part", "seg", (F.col("base") + F.col("own")).alias("base"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seg", T.IntegerType()), T.StructField(id_column, key), T.StructField("local", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def decode(batches):
        for batch in batches:
            for part, seg, keys, body in zip(*[batch.column(i) for i in range(4)], strict=True):
                ids, lengths = unpack(body.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                view = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                size = len(lengths)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * size, pa.int32()), pa.array([seg.as_py()] * size, pa.int32()), keys.values, pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=schema.names)

    read = segments.select("part", "seg", "keys", "segment").mapInArrow(tidy(decode), schema)
    out = read.join(bases, ["part", "seg"])
    return out.select(id_column, (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, **options) -> DataFrame:
    id_column = options.get("id_column", "doc_id")
    return read_documents(write_segments(docs, **options), id_column=id_column)
