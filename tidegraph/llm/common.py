"""Shared pieces: staging in the cluster's shared folder, word rules, row hashing."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words, as a Java/Python character class body and as a string.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


@functools.cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tidegraph-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode, where one machine is all, a folder of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local") or "cluster" in spark.conf.get("spark.master"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


def no_clash(given, made) -> None:
    """Raise ValueError where a caller's column is named, in any case, like a column that an operator makes."""
    if clash := {c.lower() for c in given} & {c.lower() for c in made}:
        raise ValueError(f"columns clash with those of the operator: {sorted(clash)}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete the table behind what :func:`stage` gave, when nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(function):
    """For mapInArrow: ``function``, and when a task is done, freed memory given back, as the worker lives on for others."""

    def run(batches):
        yield from function(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim is not None:
            trim(0)

    return run


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` may use it many times and it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_mod(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


def hash_unit(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5; plain enough to be repeated in any SQL engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
