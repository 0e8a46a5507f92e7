"""Rows whose id may be in a set, without moving them: a bitmap of hashed ids, sent to all executors.

The bitmap has 16 bits or more for each id of the set, and 2^28 bits, 32 MB, at most; a row that isn't marked is surely
not of the set, and only marked rows need to go through a join for an exact answer.  Past 2^24 ids more rows than need
be are marked, which costs time but no result.  Null is an id like any other.  Rows are carried in a struct, so their
columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
PART = 1 << 15  # bits that one bitmap row holds


def bits_for(ids: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * ids).bit_length()))


def mark(rows: DataFrame, id_column: str, ids: DataFrame) -> DataFrame:
    """(row, maybe): maybe is false where the row's id is surely not among those of ``ids`` (its one column)."""
    bits = bits_for(ids.count())

    def place(column):
        h = F.pmod(F.xxhash64(column), F.lit(bits))
        return F.floor(h / PART).cast("int"), (h % PART).cast("int")

    part, bit = place(F.col(ids.columns[0]))
    bitmaps = ids.select(part.alias("part"), bit.alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("map"))
    part, bit = place(F.col(f"`{id_column}`"))
    placed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), part.alias("own"), bit.alias("bit"))
    held = placed.join(F.broadcast(bitmaps), placed["own"] == bitmaps["part"], "left")
    byte = F.conv(F.hex(F.substring("map", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return held.select("row", F.coalesce(F.getbit(byte, F.col("bit") % 8) == 1, F.lit(False)).alias("maybe"))
