"""Packing documents into sequences: shortest-pack-first over the length histogram.

1. Each document becomes token ids and is cut into pieces of at most ``capacity`` ids.  A piece carries its number
   among those of its length in its task.
2. The histogram of piece lengths (at most ``capacity`` rows) goes to the driver.  Lengths are placed longest
   first, each into the pack with the most room, in groups: a group is a packing pattern with a count.
3. The patterns (at most two groups for each length) go to all executors; a piece finds its pattern, sequence and
   offset by its rank among the pieces of its length, by a binary search.
4. Sequences are numbered in a scattered order, so that those of one pattern don't follow one another.

Defined results: null text is the empty text, one end id long; a document of no ids (without end id) has no piece;
rows that share an id are documents of their own; an empty table has no sequences; texts longer than a sequence
fill whole sequences first, whatever their length; pieces of equal length are ranked by task and order in it; an id
column named like an output column raises ValueError, other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.llm.common import no_clash, stage, tidy
from tidegraph.llm.tokens import END_ID, encoder, vocabulary_path

CAPACITY = 4096


def cut_documents(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", path: str | None = None, end_id: int | None = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The staged pieces: (id, start, length, ids_crc32, doc_tokens, part, nth)."""
    path = path or vocabulary_path()
    key = docs.schema[id_column].dataType
    names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
    schema = T.StructType([T.StructField(n, key if n == id_column else T.LongType()) for n in names])

    def cut(batches):
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(path)
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far
        for batch in batches:
            for row, ids, sizes in encode(batch.column(1), end_id):
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                first = 4 * ((np.cumsum(sizes) - sizes)[doc] + start)
                view = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(view[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
                columns = [start, length, np.array(crc, np.int64), sizes[doc], np.full(len(doc), part), nth_of_kind(length, seen)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + doc)), *[pa.array(c.astype(np.int64)) for c in columns]], names=names)

    return stage(docs.select(F.col(id_column), F.col(text)).mapInArrow(tidy(cut), schema), "pieces")


def nth_of_kind(kinds: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """For each item, how many of its kind came before it; ``seen`` holds the counts so far and is carried on."""
    order = np.argsort(kinds, kind="stable")
    new, first, count = np.unique(kinds[order], return_index=True, return_counts=True)
    out = np.empty(len(kinds), np.int64)
    out[order] = np.arange(len(kinds)) - np.repeat(first, count) + np.repeat(seen[new], count)
    seen[new] += count
    return out


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns and their counts: a pattern is a list of (length, how many)."""
    packs: list[tuple[int, int, tuple | None, int]] = []  # (-room, serial, chain of lengths, count)
    serial = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if packs and -packs[0][0] >= length:
                room, _, chain, count = heapq.heappop(packs)
                room = -room
                used = min(count, left)
                if count > used:
                    serial += 1
                    heapq.heappush(packs, (-room, serial, chain, count - used))
                # fill a pack of this group with as many as fit while the others are no emptier
                times = 1
                if used == count and left >= 2 * used:
                    next_room = -packs[0][0] if packs else 0
                    times = max(1, min((room - max(next_room, 0)) // length, left // used, room // length))
            else:
                room, chain, used, times = capacity, None, left, 1
            left -= used * times
            serial += 1
            heapq.heappush(packs, (-(room - length * times), serial, (chain, length, times), used))
    out = []
    for _, _, chain, count in packs:
        pattern: dict[int, int] = {}
        while chain is not None:
            chain, length, times = chain
            pattern[length] = pattern.get(length, 0) + times
        out.append((sorted(pattern.items(), reverse=True), count))
    return out


def scatter(n: int) -> int:
    """A factor without a common divisor with ``n``, near 0.618 n: i -> i * factor mod n scatters neighbours."""
    factor = max(1, int(min(n, 1 << 29) * 0.618))
    while math.gcd(factor, n) > 1:
        factor += 1
    return factor


def place(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: where its pieces go.  Sorted by (length, first rank)."""
    rows, next_rank, sequence = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for length, times in pattern:
            for _ in range(times):
                rank = next_rank.get(length, 0)
                rows.append((length, rank, sequence, offset))
                next_rank[length] = rank + count
                offset += length
        sequence += count
    rows.sort()
    length, rank, first, offset = (np.array([r[i] for r in rows], np.int64) for i in range(4))
    return {"length": length, "rank": rank, "first": first, "offset": offset}


def pack(docs: DataFrame, *, id_column: str = "doc_id", capacity: int = CAPACITY, **options) -> DataFrame:
    """A row for each piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    no_clash([id_column], ["start", "length", "ids_crc32", "doc_tokens", "part", "nth", "sequence_id", "offset"])
    pieces = cut_documents(docs, id_column=id_column, capacity=capacity, **options)
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    patterns = shortest_pack_first(histogram, capacity)
    sequences = max(1, sum(count for _, count in patterns))
    factor = scatter(sequences)
    table = pieces.sparkSession.sparkContext.broadcast(place(patterns))
    first = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = pieces.join(first, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    names = [id_column, "start", "length", "ids_crc32", "doc_tokens"]
    schema = T.StructType([*[pieces.schema[n] for n in names], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def assign(batches):
        runs = table.value
        shift = 1 << 48
        keys = runs["length"] * shift + runs["rank"]
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            where = (runs["first"][at] + rank - runs["rank"][at]) * factor % sequences
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(where), pa.array(runs["offset"][at])], names=schema.names)

    return ranked.select(*names, "rank").mapInArrow(assign, schema)
