"""Marked rows: none of the set is missed, and nearly no other row is marked."""

from tidegraph.llm import idfilter
from tidegraph.llm.idfilter import mark


def test_marks(spark):
    ids = spark.createDataFrame([(i,) for i in range(0, 3000, 3)] + [(None,)], "id long")
    rows = spark.createDataFrame([(i, "t", 1, 2, 3) for i in range(5000)] + [(None, "t", 1, 2, 3)], "x long, maybe string, row int, part int, `a.b` int")
    out = mark(rows, "x", ids)
    assert out.columns == ["row", "maybe"] and out.select("row.*").columns == rows.columns
    got = {r["row"]["x"]: r["maybe"] for r in out.collect()}
    assert all(got[i] for i in range(0, 3000, 3)) and got[None]
    assert sum(got[i] for i in range(3000, 5000)) < 20
    assert mark(rows, "x", ids.limit(0)).filter("maybe").count() == 0


def test_size_follows_the_ids():
    assert idfilter.bits_for(0) == idfilter.bits_for(1000) == idfilter.LEAST_BITS
    assert 16 * 10**6 <= idfilter.bits_for(10**6) <= 32 * 10**6 and idfilter.bits_for(10**12) == idfilter.MOST_BITS
