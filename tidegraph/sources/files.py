"""File sources: CSV, Parquet, ordered chunks with a Merkle root, partitioned datasets, and their digests."""

from __future__ import annotations

import hashlib
import json
import struct
from dataclasses import asdict, dataclass, field
from datetime import date, datetime, timedelta
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.operators.base import Operator, operation
from tidegraph.plans.storage import Store
from tidegraph.plans.types import FrameSignature
from tidegraph.sources.s3 import location, scan_options


class SourceError(ValueError):
    """A source that isn't what its declaration says."""


def _store(spark: SparkSession, path: str) -> tuple[Store, str]:
    """The store of a path's folder, and the name in it."""
    folder, _, name = str(path).rstrip("/").rpartition("/")
    return Store(spark, folder or "."), name


def listed(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[tuple[str, str]]:
    """(name, full path) of a file, or of a folder's files in lexicographic order."""
    store, name = _store(spark, path)
    fs, at = store._at(name)
    if not fs.exists(at):
        raise SourceError(f"there is nothing at {path}")
    if fs.getFileStatus(at).isFile():
        return [(name, str(path))]
    inner = Store(spark, str(path))
    return [(n, f"{str(path).rstrip('/')}/{n}") for n, _ in inner.files("", suffix)]


def sha256_file(spark: SparkSession, path: str) -> str:
    store, name = _store(spark, path)
    return store.sha256(name)


def sha256_source(spark: SparkSession, path: str) -> str:
    """Digest of a file; of several, a tagged digest over their names and digests in order."""
    files = listed(spark, path)
    digests = [(n, sha256_file(spark, p)) for n, p in files]
    if len(digests) == 1 and digests[0][0] == PurePosixPath(str(path)).name:
        return digests[0][1]
    return combined_sha256(digests)


def combined_sha256(digests: list[tuple[str, str]]) -> str:
    total = hashlib.sha256(b"tidegraph-files\0")
    for name, digest in digests:
        body = name.encode()
        total.update(struct.pack(">Q", len(body)) + body + bytes.fromhex(digest))
    return total.hexdigest()


def coerce(df: DataFrame, signature: FrameSignature) -> DataFrame:
    """The declared columns in their declared types.

    Time units and strings become timestamps (text that is none raises), lists of one width arrays; other types must fit exactly.
    """
    columns = []
    for wanted in signature.spark().fields:
        if wanted.name not in df.columns:
            raise SourceError(f"column {wanted.name!r} is missing")
        x, have = F.col(f"`{wanted.name}`"), df.schema[wanted.name].dataType
        if have == wanted.dataType:
            pass
        elif isinstance(wanted.dataType, T.TimestampNTZType | T.TimestampType) and isinstance(have, T.StringType | T.TimestampNTZType | T.TimestampType | T.DateType):
            x = x.cast(wanted.dataType) if not isinstance(have, T.StringType) else F.to_timestamp_ntz(x).cast(wanted.dataType) if isinstance(wanted.dataType, T.TimestampNTZType) else F.to_timestamp(x)
        elif isinstance(wanted.dataType, T.ArrayType) and isinstance(have, T.ArrayType) and have.elementType == wanted.dataType.elementType:
            pass
        else:
            raise SourceError(f"column {wanted.name!r} is {have.simpleString()}, not {wanted.dataType.simpleString()}")
        if isinstance(wanted.dataType, T.ArrayType):
            width = signature[wanted.name].width
            x = F.when(x.isNull() | (F.size(x) == width), x).otherwise(F.raise_error(F.lit(f"column {wanted.name} must have {width} elements")).cast(wanted.dataType))
        columns.append(x.alias(wanted.name))
    keep = [F.col("__seq")] if "__seq" in df.columns else []
    return df.select(*columns, *keep)


def scan(spark: SparkSession, paths: list[str], order: list[str] | None = None, **options) -> DataFrame:
    """Parquet files with ``__seq``: their place in ``order``, then the row in the file."""
    df = spark.read.options(**scan_options(), **options).parquet(*map(location, paths))
    rank = (F.lit("") if len(df.inputFiles()) == 1 else F.col("_metadata.file_path")) if order is None else F.coalesce(*[F.when(F.endswith(F.col("_metadata.file_path"), F.lit(o)), F.lit(f"{i:012d}")) for i, o in enumerate(order)], F.col("_metadata.file_path"))
    return df.select("*", F.struct(rank.alias("f"), F.col("_metadata.row_index").alias("r")).alias("__seq"))


@dataclass(frozen=True)
class _Source(Operator):
    """``repeats`` says which rows of one time are kept: the "last" in source order, or "all" of them, in that order."""

    def inputs(self):
        return []

    def outputs(self, given):
        return self.signature()

    def _check_repeats(self) -> None:
        if self.repeats not in ("last", "all"):
            raise SourceError('repeats is "last" or "all"')

    def signature(self) -> FrameSignature:
        own = self.output_signature
        declared = own if own is not None else self.schema
        if declared is None:
            raise SourceError("a source needs a schema")
        return declared if isinstance(declared, FrameSignature) else FrameSignature.parse(declared)

    def read(self, spark: SparkSession) -> tuple[DataFrame, str | None]:
        raise NotImplementedError


def verify_digest(found: str, wanted: str, path: str) -> None:
    if found != wanted.lower():
        raise SourceError(f"{path} has digest {found}, not {wanted}")


@operation("source", "0.2.0")
@dataclass(frozen=True)
class CSVSource(_Source):
    """A CSV file with a header and a pinned digest."""

    path: str
    content_sha256: str
    schema: dict | None = None
    output_signature: FrameSignature | None = None
    separator: str = ","
    repeats: str = "last"

    #: The place is no part of the identity; the content's digest is.
    EXCLUDED = ("path",)

    def __post_init__(self):
        object.__setattr__(self, "path", str(self.path))
        self._check_repeats()
        if len(self.separator.encode()) != 1:
            raise SourceError("the separator must be one byte")
        if any(c.shape for c in self.signature().columns):
            raise SourceError("CSV has no shaped columns")

    def read(self, spark):
        verify_digest(sha256_file(spark, self.path), self.content_sha256, self.path)
        own = self.signature()
        header = spark.read.options(**scan_options()).option("header", True).option("sep", self.separator).csv(location(self.path))
        if missing := [n for n in own.spark().names if n not in header.columns]:
            raise SourceError(f"columns {missing} are missing")
        kinds = {f.name: f.dataType for f in own.spark().fields}
        full = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header.columns])
        df = spark.read.schema(full).options(**scan_options()).option("header", True).option("sep", self.separator).option("enforceSchema", False).option("mode", "FAILFAST").csv(location(self.path))
        # one file: splits in order of their place in it, rows in order inside a split
        seq = F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r"))
        return coerce(df.withColumn("__seq", seq), own), "__seq"


@operation("source", "0.4.0")
@dataclass(frozen=True)
class ParquetSource(_Source):
    """A Parquet file, or a folder's files in lexicographic order, with a pinned digest."""

    path: str
    content_sha256: str
    schema: dict | None = None
    output_signature: FrameSignature | None = None
    repeats: str = "last"

    EXCLUDED = ("path",)

    def __post_init__(self):
        object.__setattr__(self, "path", str(self.path))
        self._check_repeats()

    def read(self, spark):
        verify_digest(sha256_source(spark, self.path), self.content_sha256, self.path)
        return coerce(scan(spark, [p for _, p in listed(spark, self.path)]), self.signature()), "__seq"


# ordered chunks


def _leaf(key: str, sha256: str) -> bytes:
    return hashlib.sha256(b"\0" + struct.pack(">Q", len(key.encode())) + key.encode() + bytes.fromhex(sha256)).digest()


def merkle_root(chunks: list[tuple[str, str]]) -> str:
    """Root over (key, sha256) of chunks in order: pairs are hashed level by level, an odd one moves up as it is."""
    level = [_leaf(k, d) for k, d in chunks]
    if not level:
        return hashlib.sha256(b"\2").hexdigest()
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0].hex()


def build_manifest(spark: SparkSession, root: str, write: bool = True) -> dict:
    """The manifest of a folder of Parquet chunks; digests are made where the bytes are, by Spark tasks."""
    store = Store(spark, root)
    sizes = dict(store.files("", ".parquet"))
    base = str(root).rstrip("/")
    files = spark.read.options(**scan_options()).format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(base)
    digests = {r["path"]: r["d"] for r in files.select("path", F.sha2("content", 256).alias("d")).collect()}  # a row per chunk
    rows = {r["p"]: r["n"] for r in spark.read.options(**scan_options()).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(base).groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    at = lambda table, key: next((v for k, v in table.items() if k.endswith("/" + key)), 0)
    chunks = [{"key": k, "sha256": at(digests, k), "size": n, "rows": at(rows, k)} for k, n in sorted(sizes.items())]
    manifest = {"format": "tidegraph.chunks", "version": "0.1.0", "merkle": {"algorithm": "sha256", "tree": "balanced-binary", "root": merkle_root([(c["key"], c["sha256"]) for c in chunks])}, "chunks": chunks}
    if write:
        store.write("manifest.json", json.dumps(manifest, indent=1).encode())
    return manifest


def merkle_sha256_source(spark: SparkSession, root: str) -> str:
    return build_manifest(spark, root, write=False)["merkle"]["root"]


@operation("source", "0.2.0")
@dataclass(frozen=True)
class StreamingParquetSource(_Source):
    """An ordered list of Parquet chunks named by ``manifest.json``, read lazily; the Merkle root may be pinned."""

    path: str
    merkle_sha256: str | None = None
    schema: dict | None = None
    output_signature: FrameSignature | None = None
    verify_layout: bool = False
    repeats: str = "last"

    EXCLUDED = ("path", "verify_layout")

    def __post_init__(self):
        object.__setattr__(self, "path", str(self.path).rstrip("/"))
        self._check_repeats()

    def read(self, spark):
        store = Store(spark, self.path)
        manifest = json.loads(store.read("manifest.json"))
        chunks = manifest["chunks"]
        root = merkle_root([(c["key"], c["sha256"]) for c in chunks])
        if root != manifest["merkle"]["root"]:
            raise SourceError("the manifest's root does not match its chunks")
        if self.merkle_sha256 is not None:
            verify_digest(root, self.merkle_sha256, self.path)
        if self.verify_layout:
            sizes = dict(store.files("", ".parquet"))
            if wrong := [c["key"] for c in chunks if sizes.get(c["key"]) != c["size"]]:
                raise SourceError(f"chunks {wrong} are missing or of another size")
        keys = [c["key"] for c in chunks]
        return coerce(scan(spark, [f"{self.path}/{k}" for k in keys], [f"/{k}" for k in keys]), self.signature()), "__seq"


def _bound(value, end: bool) -> tuple[datetime, bool]:
    """A bound as naive UTC time, and whether it is included; a bare end date covers its whole day."""
    if isinstance(value, str):
        value = date.fromisoformat(value) if len(value) == 10 else datetime.fromisoformat(value)
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            from datetime import UTC

            value = value.astimezone(UTC).replace(tzinfo=None)
        return value, True
    start = datetime(value.year, value.month, value.day)
    return (start + timedelta(days=1), False) if end else (start, True)


@operation("source", "0.3.0")
@dataclass(frozen=True)
class DatasetSource(_Source):
    """A folder or glob of Parquet files, partitioned by ``key=value`` folders or not, within an inclusive time range.

    The range is a plain filter: Spark prunes partitions and row groups by it.
    """

    path: str
    schema: dict | None = None
    output_signature: FrameSignature | None = None
    time_range: tuple | None = None
    data_version: str | None = None
    repeats: str = "last"

    EXCLUDED = ("path",)

    def __post_init__(self):
        object.__setattr__(self, "path", str(self.path))
        self._check_repeats()
        if self.time_range is not None:
            lo, hi = self.time_range
            object.__setattr__(self, "time_range", (lo, hi))
            if lo is not None and hi is not None and _bound(lo, False)[0] > _bound(hi, True)[0]:
                raise SourceError("the time range ends before it begins")

    def read(self, spark):
        own = self.signature()
        options = {"basePath": self.path.split("*")[0].rpartition("/")[0]} if "*" in self.path else {}
        df = scan(spark, [self.path], **options)
        t = F.col(own.time.column)
        if self.time_range is not None:
            lo, hi = self.time_range
            kind = own.spark()[own.time.column].dataType
            # tz-aware axes are instants: bounds are read in UTC, whatever the session's zone
            lit = lambda d: F.lit(d).cast(kind) if isinstance(kind, T.TimestampNTZType) else F.lit(d.isoformat() + "Z").cast(kind)
            if lo is not None:
                df = df.filter(t >= lit(_bound(lo, False)[0]))
            if hi is not None:
                at, closed = _bound(hi, True)
                df = df.filter(t <= lit(at) if closed else t < lit(at))
        return coerce(df, own), "__seq"


@dataclass(frozen=True)
class DatasetManifest:
    """What is known of a dataset, as JSON."""

    id: str
    name: str
    path: str
    schema: dict = field(default_factory=dict)
    description: str = ""
    rows: int | None = None
    start: str | None = None
    end: str | None = None
    metadata: dict = field(default_factory=dict)

    def dumps(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, indent=1)

    @classmethod
    def loads(cls, text: str) -> DatasetManifest:
        data = json.loads(text)
        names = set(cls.__dataclass_fields__)
        if unknown := set(data) - names:
            raise SourceError(f"unknown manifest fields: {sorted(unknown)}")
        return cls(**data)
