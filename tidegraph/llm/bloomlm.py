"""LM scoring with a log-frequency Bloom filter.

Training counts n-grams (orders 1 and 2) of hashed tokens.  The filter holds each n-gram once for each level of its
quantised count: 1, 2, 3, 4, 6, 8, 12, 16, 24, ... rounded down.  Scoring probes level after level until one is
missing; the last level found gives the quantised count q, never above the true one but by filter error.

The model, over the training tokens and one unknown class, is proper for every previous token h:

    p1(w) = (q(w) + 1) / (sum of q + V + 1)        p(w | h) = (q(h, w) + K p1(w)) / (c(h) + K)

c(h) is h's exact training count, K the mean number of distinct tokens that follow a token (Dirichlet smoothing).  As
q is rounded down, the sum over w falls short of 1 by what rounding took away, (c(h) - sum of q(h, w)) / (c(h) + K);
that rest belongs to an event that no text holds, so no probability is unearned.  Filter error: an n-gram that is not
held passes with probability (1 - exp(-PROBES / BITS_PER_ENTRY)) ** PROBES at most, some 3e-13 a probe, which adds at
most V times that, over c(h) + K, to a sum.

How it scales: texts are staged in blocks.  Each block sends its distinct n-grams, with their training counts, as
sorted hashes to the owners of their order and hash prefix, so no key is hot; there are more prefixes where there are
more blocks.  An owner adds the counts up, builds its own part of the filter, sized by the part's entries, probes it
for the n-grams of every block and answers with levels and, for tokens, exact counts.  Block and answers meet by block
number.  No n-gram is left out at any size of corpus; nothing of the filter is broadcast, as its size grows with the
corpus, and nothing but a few sums reaches the driver.

Tokens are the words of the text with A-Z in lower case, then one end token; 64-bit hashes stand for tokens, 60-bit
hashes or longer ones for bigrams.  Defined results: null text counts as empty and has the end token only; with no
training document every count is 0 and every score too; rows that share an id are scored each, equal texts alike; an
empty table gives an empty result; very long texts are blocks of their own; an id or flag column named like an output
column raises ValueError, other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.llm.common import no_clash, stage, tidy

#: A key is an order and a prefix of a hash, of at least MIN_PREFIX_BITS.
KEY_SHIFT = 26
MIN_PREFIX_BITS = 12
#: Blocks whose n-grams of one prefix an owner holds for each bit less: 2 ** 15 blocks have the least prefixes.
BLOCKS_AT_LEAST_BITS = 1 << 15
PROBES = 12
BITS_PER_ENTRY = 128
#: Bytes of a hash that are kept beside its prefix: all of a token's, 60 bits or more in all of a bigram's.
KEPT = {1: 7, 2: 6}
_M1, _M2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)

END = xxhash.xxh64_intdigest(b"\n")  # no word holds a line end


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def token_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all token hashes, each text's ended by END; the number of tokens of each text); null is the empty text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    real = pc.binary_length(words).to_numpy() > 0  # the split leaves empty words at the ends of texts
    ends = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = words.filter(pa.array(real)).dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
    sizes = np.diff(ends) + 1
    out = np.full(len(coded) + len(sizes), END, np.uint64)
    own = np.ones(len(out), bool)
    own[np.cumsum(sizes) - 1] = False
    out[own] = hashes[coded.indices.to_numpy()]
    return out, sizes


def bigrams(tokens: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it; before a text stands END."""
    before = np.concatenate([np.array([END], np.uint64), tokens[:-1]])
    return mix(before * _STEP + (tokens ^ (tokens >> np.uint64(31))))


def shorten(h: np.ndarray, order: int, bits: int) -> np.ndarray:
    """What of a hash survives packing: its prefix and its last bytes."""
    low = np.uint64((1 << (8 * KEPT[order])) - 1)
    return h >> np.uint64(64 - bits) << np.uint64(64 - bits) | (h & low)


def pack_hashes(h: np.ndarray, order: int) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEPT[order]]).tobytes()


def unpack_hashes(body: bytes, order: int, prefix: int, bits: int) -> np.ndarray:
    kept = KEPT[order]
    out = np.zeros((len(body) // kept, 8), np.uint8)
    out[:, :kept] = np.frombuffer(body, np.uint8).reshape(-1, kept)
    return out.reshape(-1).view("<u8") | (np.uint64(prefix) << np.uint64(64 - bits))


def rows_by_prefix(h: np.ndarray, order: int, learn: np.ndarray, bits: int) -> list[tuple[int, bytes, bytes]]:
    """(key, packed hashes, packed counts) of one block of n-grams, sorted; ``learn`` marks those that count."""
    values, at = np.unique(shorten(h, order, bits), return_inverse=True)
    counts = np.bincount(at[learn], minlength=len(values)).astype("<u4")
    prefixes = (values >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(prefixes, prepend=-1))
    packed, kept = pack_hashes(values, order), KEPT[order]
    small = counts.max(initial=0) < 256
    body = counts.astype(np.uint8 if small else "<u4").tobytes()
    width = 1 if small else 4
    stops = np.append(starts[1:], len(values))
    return [(order << KEY_SHIFT | p, packed[a * kept : b * kept], body[a * width : b * width]) for p, a, b in zip(prefixes[starts].tolist(), starts.tolist(), stops.tolist(), strict=True)]


def part_counts(hashes: bytes, counts: bytes, order: int) -> np.ndarray:
    """The counts of one row of :func:`rows_by_prefix`, packed in one byte or four each."""
    return np.frombuffer(counts, np.uint8 if len(counts) * KEPT[order] == len(hashes) else "<u4").astype(np.int64)


def level_of(c: np.ndarray) -> np.ndarray:
    """The level of a count: 0 to 3 themselves, then two for each power of two."""
    c = np.asarray(c, np.int64)
    e = np.frexp(np.maximum(c, 2).astype(np.float64))[1].astype(np.int64) - 1
    return np.where(c < 4, c, 2 * e + (c >> (e - 1) & 1))


def quantised(level: np.ndarray) -> np.ndarray:
    """The least count of a level."""
    level = np.asarray(level, np.int64)
    return np.where(level < 4, level, (2 + level % 2) << np.maximum(level // 2 - 1, 0))


def probe_bits(h: np.ndarray, level: np.ndarray | int, size: int) -> np.ndarray:
    """(n, PROBES) bit positions in a part of ``size`` bits, a power of two."""
    key = h + np.asarray(level, np.uint64) * _STEP
    out = np.empty((len(h), PROBES), np.int64)
    low = np.uint64(0xFFFFFFFF)
    for k in range(0, PROBES, 2):
        g = mix(key ^ np.uint64((k + 1) * 0x517CC1B727220A95 % 2**64))
        out[:, k], out[:, k + 1] = g & low, g >> np.uint64(32)
    return out & (size - 1)


def part_size(entries: int) -> int:
    """Bits of a filter's part: a power of two of at least BITS_PER_ENTRY an entry."""
    return 1 << max(9, (entries * BITS_PER_ENTRY - 1).bit_length())


def fill(h: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
    """A part's bits (uint8) with each n-gram held at the levels 1 to ``q``."""
    part = np.zeros(size, bool)
    for at in range(0, len(h), 1 << 16):
        own = q[at : at + (1 << 16)]
        level = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + 1
        part[probe_bits(np.repeat(h[at : at + (1 << 16)], own), level, size).ravel()] = True
    return np.packbits(part, bitorder="little")


def probe(bits: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    """How many levels from 1 on hold each n-gram, until one misses."""
    out = np.zeros(len(h), np.int64)
    live, level = np.arange(len(h)), 0
    while len(live):
        level += 1
        at = probe_bits(h[live], level, size)
        live = live[((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)]
        out[live] = level
    return out


def pack_blocks(rows: DataFrame, *, bytes_per_block: int = 8 << 20) -> DataFrame:
    """The staged blocks: (block, body); a body is a compressed Arrow stream of consecutive ``rows``, whose third column is text."""

    def pack(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def row():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "body"])

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                done = int(ends[start - 1]) if start else 0
                stop = min(int(np.searchsorted(ends, done + bytes_per_block - size)) + 1, batch.num_rows)
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - done
                start = stop
                if size >= bytes_per_block:
                    yield row()
                    held, size, block = [], 0, block + 1
        if held:
            yield row()

    return stage(rows.mapInArrow(tidy(pack), "block bigint, body binary"), "lm-blocks")


def answers(blocks: DataFrame, bits: int) -> DataFrame:
    """The staged answers: (block, key, counts, levels) of the sorted n-grams of each block, order and prefix.

    Rows of no block hold, for each key, the sums ``total`` of counts and ``held`` of quantised counts, and the number of ``distinct`` n-grams.
    """

    def ask(batches):
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts = pa.ipc.open_stream(body.as_buffer()).read_all().combine_chunks()
                tokens, sizes = token_arrays(texts.column(2).combine_chunks())
                learn = np.repeat(texts.column("learn").to_numpy(), sizes)
                asks = block if pc.any(texts.column("ask")).as_py() else None
                del texts
                for order in KEPT:
                    h, counts = tokens if order == 1 else bigrams(tokens), learn
                    if asks is None:
                        h, counts = h[learn], np.ones(int(learn.sum()), bool)
                    rows = rows_by_prefix(h, order, counts, bits)
                    for at in range(0, len(rows), 1024):
                        keys, a, b = zip(*rows[at : at + 1024], strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([asks] * len(keys), pa.int64()), pa.array(keys, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["block", "key", "hashes", "counts"])

    def answer(batches):
        names = ["block", "key", "counts", "levels", "total", "held", "distinct"]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

        def reply(key: int, parts: list[tuple[int | None, bytes, bytes]]):
            order, prefix = key >> KEY_SHIFT, key & ((1 << KEY_SHIFT) - 1)
            h = np.concatenate([unpack_hashes(a, order, prefix, bits) for _, a, _ in parts])
            c = np.concatenate([part_counts(a, b, order) for _, a, b in parts])
            distinct, at = np.unique(h, return_inverse=True)
            c = np.bincount(at, c, len(distinct)).astype(np.int64)  # exact below 2 ** 53
            q = level_of(c)
            size = part_size(int(q.sum()))
            levels = probe(fill(distinct, q, size), distinct, size).astype(np.uint8)
            rows = [(None, key, None, None, int(c.sum()), int(quantised(q).sum()), int((c > 0).sum()))]
            end = 0
            for block, a, _ in parts:
                start, end = end, end + len(a) // KEPT[order]
                if block is not None:
                    own = at[start:end]
                    rows.append((block, key, c[own].astype("<i8").tobytes() if order == 1 else None, levels[own].tobytes(), 0, 0, 0))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        now, parts = None, []
        for batch in batches:
            for block, key, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != now:
                    if parts:
                        yield reply(now, parts)
                    now, parts = key, []
                parts.append((block, a, b))
        if parts:
            yield reply(now, parts)

    rows = blocks.mapInArrow(tidy(ask), "block bigint, key int, hashes binary, counts binary")
    by_key = rows.repartition("key").sortWithinPartitions("key")
    return stage(by_key.mapInArrow(tidy(answer), "block bigint, key int, counts binary, levels binary, total bigint, held bigint, distinct bigint"), "lm-answers")


def score(docs: DataFrame, train: DataFrame | Column, *, id_column: str = "doc_id", text: str = "text", flag: str) -> DataFrame:
    """(id, flag, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``train`` holds the texts to learn from in column ``text``, or is a condition on the rows of ``docs``, which saves
    a pass; ``flag`` is a boolean column of ``docs``.
    """
    no_clash([id_column, flag], ["n_tokens", "n_known", "train_tokens", "base_score", "score"])
    own = [F.col(id_column).alias("id"), F.col(flag).alias("flag"), F.col(text).alias("text")]
    if isinstance(train, Column):
        rows = docs.select(*own, F.coalesce(train, F.lit(False)).alias("learn"), F.lit(True).alias("ask"))
    else:
        none = [F.lit(None).cast(docs.schema[c].dataType).alias(n) for c, n in ((id_column, "id"), (flag, "flag"))]
        rows = docs.select(*own, F.lit(False).alias("learn"), F.lit(True).alias("ask")).unionAll(train.select(*none, F.col(text).alias("text"), F.lit(True).alias("learn"), F.lit(False).alias("ask")))
    blocks = pack_blocks(rows)
    bits = min(KEY_SHIFT - 2, MIN_PREFIX_BITS + max(0, math.ceil(blocks.count() / BLOCKS_AT_LEAST_BITS) - 1).bit_length())
    replies = answers(blocks, bits)
    found = {r["order"]: r for r in replies.groupBy(F.shiftright("key", KEY_SHIFT).alias("order")).agg(*[F.sum(c).alias(c) for c in ("total", "held", "distinct")]).collect()}
    tokens, held, distinct = (found[1][c] for c in ("total", "held", "distinct")) if 1 in found else (0, 0, 0)
    norm = math.log10(tokens + distinct + 1)
    prior = found[2]["distinct"] / distinct if distinct else 1.0
    schema = T.StructType([
        T.StructField("id", docs.schema[id_column].dataType), T.StructField("flag", docs.schema[flag].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def per_block(batches):
        def scored(body: bytes, replies: dict[int, list[tuple[bytes, bytes]]]):
            texts = pa.ipc.open_stream(body).read_all().combine_chunks()
            flat, sizes = token_arrays(texts.column(2).combine_chunks())
            starts = np.cumsum(sizes) - sizes
            at = np.unique(shorten(flat, 1, bits), return_inverse=True)[1]
            c = np.frombuffer(b"".join(a for a, _ in replies[1]), "<i8")
            base = np.add.reduceat(np.log10(c + 1.0)[at], starts) - sizes * norm
            n_known = np.add.reduceat((c > 0).astype(np.int64)[at], starts)
            # the model: n-gram counts from the filter only
            single = quantised(np.frombuffer(b"".join(b for _, b in replies[1]), np.uint8))
            p1 = ((single + 1) / (held + distinct + 1))[at]
            pairs = np.unique(shorten(bigrams(flat), 2, bits), return_inverse=True)[1]
            pair = quantised(np.frombuffer(b"".join(b for _, b in replies[2]), np.uint8))[pairs]
            before = np.concatenate([c[at[sizes[0] - 1 : sizes[0]]], c[at[:-1]]])
            scores = np.add.reduceat(np.log10((pair + prior * p1) / (before + prior)), starts)
            table = pa.table([texts.column(0), texts.column(1), pa.array(sizes), pa.array(n_known), pa.array(base), pa.array(scores)], names=schema.names)
            return table.combine_chunks().to_batches()

        body, replies = None, {}
        for batch in batches:
            for _, key, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key < 0:  # a block's texts come before its answers
                    if body is not None:
                        yield from scored(body, replies)
                    body, replies = a, {1: [], 2: []}
                else:
                    replies[key >> KEY_SHIFT].append((a or b"", b))
        if body is not None:
            yield from scored(body, replies)

    asked = replies.filter("block is not null").select("block", "key", F.col("counts").alias("a"), F.col("levels").alias("b"))
    bodies = blocks.select("block", F.lit(-1).alias("key"), F.col("body").alias("a"), F.lit(None).cast("binary").alias("b"))
    asking = bodies if isinstance(train, Column) else bodies.join(asked.select("block").distinct(), "block", "left_semi")
    whole = asking.unionAll(asked).repartition("block").sortWithinPartitions("block", "key")
    out = whole.mapInArrow(tidy(per_block), schema)
    return out.select(F.col("id").alias(id_column), F.col("flag").alias(flag), "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score")
