"""N-gram Jaccard join with Bayesian candidate pruning.

Documents whose sets of word n-grams have a Jaccard similarity of at least ``threshold`` are linked:

1. Rows with equal texts become one node; a node has a MinHash signature.
2. Nodes that share a band of their signature are candidates.  A bucket's nodes are first held against its least
   node.  Buckets whose nodes then still lie apart are compared in full, in blocks.
3. A comparison looks at the signatures step by step and drops a pair as soon as the posterior probability that its
   similarity reaches the threshold (uniform prior) is below ``tolerance``.
4. What remains forms groups.  Inside a group all pairs are pruned in the same way and the rest verified exactly,
   block against block; only counts and a spanning forest leave a task.  Where only classes are wanted
   (:func:`keep_one`), each block is held against itself and the group's least node, which is linear in the group;
   only groups that then still lie apart are compared block against block, but for pairs of one class.
5. Exact links form the classes.

A group or bucket of any size is dealt out in blocks of bounded size, so no task holds a whole one, and no list of
all pairs is ever made.  Nodes are 128-bit digests.

Defined results: columns other than id and text may have any names; texts may be of any length; a text of fewer than ``n`` words has one n-gram, all its words; a null or wordless text has none and
is in a class of its own, unlinked; a row's class is the least id in it (rows of null id: the least id of the class,
null if there is none); ``n_links`` counts the other rows, equal texts included, that are linked to the row; rows
that share an id are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.llm.common import no_clash, stage, tidy
from tidegraph.llm.tokens import slices
from tidegraph.llm.components import components
from tidegraph.llm.idfilter import mark

BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
STEP = 25
#: Nodes, and n-grams, that a block holds at most (of one very long text: more n-grams).
BLOCK_NODES, BLOCK_GRAMS = 256, 1 << 20
#: Parts that a group's members are dealt to before its size is joined.
SALTS = 32
_MIX = np.uint64(0xC4CEB9FE1A85EC53)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words; where each text's begin, and the end of the last)."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    real = pc.binary_length(words).to_numpy() > 0  # the split leaves empty words at the ends of texts
    ends = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = words.filter(pa.array(real)).dictionary_encode()
    names = coded.dictionary.to_pylist()
    return np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))[coded.indices.to_numpy()], ends


def grams_of(w: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams, from those of its words."""
    if not len(w):
        return np.empty(0, np.uint64)
    if len(w) < n:
        w = np.concatenate([w, np.full(n - len(w), len(w), np.uint64)])
    m = len(w) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = (h ^ w[k : k + m]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _multipliers() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(g: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of a set."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(g), 1024):
        np.minimum(out, (g[at : at + 1024] * multipliers[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, least matches to go on): below, P(similarity >= threshold | matches) < tolerance.

    With a uniform prior the posterior is a Beta distribution, whose upper tail at the threshold is the chance of at
    most ``matches`` successes in one trial more than were compared.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out.append((n, m))
                break
    return out


def prune(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """For row-aligned signatures: which pairs survive?  Each step compares STEP more values of those left."""
    live, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, least in steps:
        matches = matches + (a[live, n - STEP : n] == b[live, n - STEP : n]).sum(axis=1)
        go = matches >= least
        live, matches = live[go], matches[go]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def prune_all(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Pairs (i, j) of two blocks that survive, as an (n, 2) array."""
    out = []
    rows = max(1, (1 << 21) // (max(len(b), 1) * STEP))
    n, least = steps[0]
    for at in range(0, len(a), rows):
        matches = (a[at : at + rows, None, :n] == b[None, :, :n]).sum(axis=2)
        i, j = np.nonzero(matches >= least)
        keep = prune(a[at + i], b[j], steps)
        out.append(np.stack([at + i[keep], j[keep]], axis=1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """(len(a), len(b)) sizes of the intersections of sorted sets, by products of membership matrices in slices."""
    left, right = np.concatenate(a), np.concatenate(b)
    left_row = np.repeat(np.arange(len(a)), [len(x) for x in a])
    right_row = np.repeat(np.arange(len(b)), [len(x) for x in b])
    shared = np.intersect1d(left, right)
    out = np.zeros((len(a), len(b)), np.float32)

    def columns(values, rows):
        at = np.searchsorted(shared, values)
        good = at < len(shared)
        good[good] = shared[at[good]] == values[good]
        at, rows = at[good], rows[good]
        order = np.argsort(at, kind="stable")
        return at[order], rows[order]

    lc, lr = columns(left, left_row)
    rc, rr = columns(right, right_row)
    for start in range(0, len(shared), 8192):
        stop = min(start + 8192, len(shared))
        x, y = np.zeros((len(a), stop - start), np.float32), np.zeros((len(b), stop - start), np.float32)
        s, e = np.searchsorted(lc, [start, stop])
        x[lr[s:e], lc[s:e] - start] = 1
        s, e = np.searchsorted(rc, [start, stop])
        y[rr[s:e], rc[s:e] - start] = 1
        out += x @ y.T
    return out


class Forest:
    """Union-find over n items."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def spanning(pairs: np.ndarray, n: int, offset: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph of ``pairs`` (i, j) over items 0..n-1, where j stands for item ``offset`` + j."""
    forest, out = Forest(n), []
    if not len(pairs):
        return out
    for i, j in pairs.tolist():
        if forest.link(i, offset + j):
            out.append((i, offset + j))
    return out


def _nodes(docs: DataFrame, id_column: str, text: str, n: int) -> DataFrame:
    """(id, node, size, sig) of every row, staged."""
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("node", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("sig", T.BinaryType())])

    def compute(batches):
        multipliers = _multipliers()
        for whole in batches:
            for start, stop in slices(whole.column(1), 4 << 20):
                texts = pc.fill_null(whole.column(1).slice(start, stop - start), "")
                words, ends = word_hashes(texts)
                node, size, sig = [], [], []
                for body, a, b in zip(texts.cast(pa.binary()), ends[:-1], ends[1:], strict=True):
                    g = grams_of(words[a:b], n)
                    node.append(hashlib.md5(body.as_buffer()).digest())
                    size.append(len(g))
                    sig.append(signature(g, multipliers).tobytes() if len(g) else b"")
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(start, stop - start), pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array(sig, pa.binary())], names=schema.names)

    return stage(docs.select(F.col(id_column), F.col(text)).mapInArrow(tidy(compute), schema), "minhash")


def _bands(nodes: DataFrame) -> DataFrame:
    """(bucket, node): BANDS rows for each node."""

    def compute(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX, (len(sig), 1))
            for k in range(ROWS):
                h = (h ^ sig[:, :, k]) * _MIX
                h ^= h >> np.uint64(31)
            at = np.repeat(np.arange(len(sig)), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), batch.column(0).take(pa.array(at))], names=["bucket", "node"])

    return nodes.select("node", "sig").mapInArrow(compute, "bucket bigint, node binary")


def _pairs_pass(pairs: DataFrame, signatures: DataFrame, steps) -> DataFrame:
    """Of (a, b) pairs, those that pruning leaves."""
    both = pairs.join(signatures.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(signatures.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")

    def test(batches):
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, HASHES) for k in (2, 3))
            keep = pa.array(prune(sa, sb, steps))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(test, "a binary, b binary")


def _units(members: DataFrame, sizes: DataFrame, *, pivots: bool = False) -> DataFrame:
    """Deal the members of each group out to pairs of blocks.

    members: (grp, node, ...); sizes: (grp, blocks) of the groups of two or more blocks.  Adds unit (a hash of the
    group and its block pair), and side: 0 if the node is of the pair's first block, else 1; in a pair of a block with
    itself all are of side 0.  With ``pivots`` there are only pairs of a block with itself, and the node that names
    the group is in all of them.
    """
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["grp", "salt"], "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint"))).withColumn("own", F.pmod(F.xxhash64("node", "grp"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    if pivots:
        rows = rows.withColumn("other", F.explode(F.when(F.col("node") == F.col("grp"), every).otherwise(F.array("own"))))
        return rows.withColumn("unit", F.xxhash64("grp", "other")).withColumn("side", F.lit(0)).drop("own", "other", "blocks", "salt")
    rows = rows.withColumn("other", F.explode(every))
    return rows.withColumn("unit", F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other"))).withColumn("side", (F.col("own") > F.col("other")).cast("int")).drop("own", "other", "blocks", "salt")


def _by_unit(units: DataFrame, columns: list[str], handle, schema: str, names: list[str], types: list) -> DataFrame:
    """Run ``handle(first, second)`` on each unit's rows (second is None for a block with itself); it gives rows."""
    dealt = units.select("unit", "side", *columns).repartition("unit").sortWithinPartitions("unit", "side")

    def run(batches):
        now, held = None, ([], [])
        out: list[tuple] = []

        def done():
            if held[0] and (len(held[0]) > 1 or held[1]):
                out.extend(handle(held[0], held[1] or None))

        def batch_of(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            for unit, side, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if unit != now:
                    done()
                    now, held = unit, ([], [])
                held[side].append(rest)
            if len(out) > 5000:
                yield batch_of(out)
                out.clear()
        done()
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(tidy(run), schema)


def _apart(units: DataFrame, columns: list[str], handle) -> DataFrame:
    return stage(_by_unit(units, columns, handle, "a binary, b binary, links bigint", ["a", "b", "links"], [pa.binary(), pa.binary(), pa.int64()]), "links")


def _kinds(first: list, other: list, found: np.ndarray) -> np.ndarray:
    """Of the pairs ``found``, those whose components, at place 1 of each row, differ."""
    names = [x[1] for x in first], [x[1] for x in other]
    ids = {c: i for i, c in enumerate(dict.fromkeys([*names[0], *names[1]]))}
    a, b = (np.array([ids[c] for c in n], np.int64) for n in names)
    return found[a[found[:, 0]] != b[found[:, 1]]]


def _signatures(side: list) -> np.ndarray:
    return np.frombuffer(b"".join([x[2] for x in side]), np.uint32).reshape(-1, HASHES)


def _classify(docs: DataFrame, id_column: str, text: str, n: int, threshold: float, tolerance: float, counts: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """rows (id, node, size, sig), nodes (node, least, copies, size, sig), classes (node, component) and, if ``counts``, links (node, links)."""
    steps = least_matches(threshold, tolerance)
    rows = _nodes(docs, id_column, text, n)
    nodes = rows.filter("size > 0").groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("size").alias("size"), F.min("sig").alias("sig"))
    nodes = stage(nodes, "nodes")

    # candidates: buckets of two or more nodes; of buckets with the same nodes, one
    bands = _bands(nodes)
    buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot"), F.bit_xor(F.xxhash64("node")).alias("same"))
    buckets = buckets.filter("n > 1").groupBy("n", "pivot", "same").agg(F.min("bucket").alias("bucket"))
    members = stage(bands.join(buckets.select("bucket", "n", "pivot"), "bucket"), "buckets")
    pairs = members.filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    edges = stage(_pairs_pass(pairs, nodes, steps), "edges")
    groups = components(edges)

    # buckets that still lie apart after that, and hold more than the one pair that was compared
    labelled = members.filter("n > 2").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
    apart = apart.filter("lo != hi").select(F.col("bucket").alias("grp"), F.ceil(F.col("n") / BLOCK_NODES).cast("bigint").alias("blocks"))
    loose = stage(labelled.select(F.col("bucket").alias("grp"), "node", "component").join(apart, "grp"), "apart")
    if loose.limit(1).count():

        def compare(first, second):
            other, offset = second or first, 0 if second is None else len(first)
            found = _kinds(first, other, prune_all(_signatures(first), _signatures(other), steps))
            every = [x[0] for x in first] + ([x[0] for x in second] if second else [])
            return [(every[i], every[j], 0) for i, j in spanning(found, len(every), offset)]

        units = _units(loose.drop("blocks").join(nodes.select("node", "sig"), "node"), loose.filter("blocks > 1").select("grp", "blocks").distinct())
        more = _apart(units, ["node", "component", "sig"], compare)
        if more.limit(1).count():
            groups = components(edges.union(more.select("a", "b")))

    # exact verification inside the groups, block against block
    member = stage(groups.select("node", F.col("component").alias("grp")), "groups").join(nodes, "node")
    sizes = member.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("bigint").alias("blocks"))
    sizes = stage(sizes.filter("blocks > 1"), "sizes")

    def with_texts(wanted: DataFrame) -> DataFrame:
        """(node, component, copies, sig, body, grp) of the wanted nodes; only their texts move."""
        marked = mark(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("body")), "id", wanted.select("least"))
        source = marked.filter("maybe").select("row.*").withColumn("digest", F.unhex(F.md5(F.coalesce("body", F.lit("")))))
        whole = source.join(wanted, source["id"].eqNullSafe(wanted["least"]) & (F.col("digest") == F.col("node")))
        return whole.select("node", "component", "sig", "copies", "body", "grp")

    def verify(first, second):
        def load(side):
            held = {x[0]: x for x in side}  # rows that share id and text are one node
            side = list(held.values())
            words, ends = word_hashes(pa.array([x[4] or "" for x in side], pa.string()))
            return side, _signatures(side), [grams_of(words[a:b], n) for a, b in zip(ends[:-1], ends[1:], strict=True)]

        a, sa, ga = load(first)
        b, sb, gb = load(second) if second else (a, sa, ga)
        found = prune_all(sa, sb, steps)
        if second is None:
            found = found[found[:, 0] < found[:, 1]]
        if not counts:
            found = _kinds(a, b, found)
        if not len(found):
            return []
        rows_a, rows_b = np.unique(found[:, 0]), np.unique(found[:, 1])
        shared = overlaps([ga[i] for i in rows_a], [gb[j] for j in rows_b])
        both = shared[np.searchsorted(rows_a, found[:, 0]), np.searchsorted(rows_b, found[:, 1])].astype(np.int64)
        la, lb = np.array([len(x) for x in ga]), np.array([len(x) for x in gb])
        union = la[found[:, 0]] + lb[found[:, 1]] - both
        found = found[both >= threshold * union - 1e-9]
        offset = 0 if second is None else len(a)
        every = a + (b if second else [])
        out = []
        if counts:
            copies = np.array([x[3] for x in every], np.int64)
            links = np.zeros(len(every), np.int64)
            np.add.at(links, found[:, 0], copies[offset + found[:, 1]])
            np.add.at(links, offset + found[:, 1], copies[found[:, 0]])
            out = [(every[i][0], None, int(links[i])) for i in np.flatnonzero(links).tolist()]
        return out + [(every[i][0], every[j][0], 0) for i, j in spanning(found, len(every), offset)]

    columns = ["node", "component", "sig", "copies", "body"]
    wanted = stage(member.select("node", "grp", "copies", "sig", "least", F.col("node").alias("component")), "members")
    exact = _apart(_units(with_texts(wanted), sizes, pivots=not counts), columns, verify)
    classes = components(exact.filter("b is not null").select("a", "b"))
    if counts:
        return rows, nodes, classes, exact.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    # groups of several blocks that the least node does not hold together
    split = wanted.drop("component").join(sizes, "grp").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = split.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("grp")
    rest = stage(split.join(rest, "grp"), "apart")
    if rest.limit(1).count():
        more = _apart(_units(with_texts(rest.drop("blocks")), rest.select("grp", "blocks").distinct()), columns, verify)
        classes = components(exact.select("a", "b").union(more.select("a", "b")))
    return rows, nodes, classes, None


def join(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """(id, class_id, n_links) for every row of ``docs``; an id column of one of the other names raises ValueError."""
    no_clash([id_column], ["class_id", "n_links"])
    rows, nodes, classes, links = _classify(docs, id_column, text, n, threshold, tolerance, True)
    named = nodes.select("node", "least", "copies").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("least").alias("class_id"))
    table = named.join(ids, "component").join(links, "node", "left").select("node", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("id", "node", "size").join(table, "node", "left")
    return out.select(F.col("id").alias(id_column), F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """The rows of ``docs`` that stand for their class, with all their columns; wordless rows all stay.

    Of a class one row stays: that of the least id (null comes last), and of rows that share it, that of the least
    digest of the text; of repeated rows with the same id and text any one.
    """
    rows, nodes, classes, _ = _classify(docs, id_column, text, n, threshold, tolerance, False)
    several = nodes.select("node", "least", "copies").join(classes, "node", "left").filter("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "node"))
    first = several.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("first"))
    named = several.select("node", "component").join(first, "component").select("node", "first")
    # counted before the join, which then ends its stage: a text of very many copies may be split there
    counted = rows.filter("size > 0").groupBy("id", "node").agg(F.count(F.lit(1)).alias("n"))
    judged = counted.join(named, "node").withColumn("stays", (F.col("node") == F.col("first.node")) & F.col("id").eqNullSafe(F.col("first.least")))
    doubtful = stage(judged.filter("not stays or n > 1").select(F.col("id").alias("key"), "node", "stays"), "doubtful")
    # documents that surely stay do not move; the others are looked up
    marked = mark(docs, id_column, doubtful.select("key"))
    rest = marked.filter("maybe").select("row", F.col("row")[id_column].alias("id"), F.unhex(F.md5(F.coalesce(F.col("row")[text], F.lit("")))).alias("digest"))
    looked = rest.join(doubtful, rest["id"].eqNullSafe(doubtful["key"]) & (F.col("digest") == F.col("node")), "left")
    kept = marked.filter("not maybe").select("row").union(looked.filter("stays is null").select("row"))
    if doubtful.filter("stays").limit(1).count():
        kept = kept.union(looked.filter("stays").dropDuplicates(["id", "digest"]).select("row"))
    return kept.select("row.*")
