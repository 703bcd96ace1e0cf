"""Checks of outputs: the same rows as often."""

from maskloom.operators import verify


def test_same_rows_reads_each_side_once(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def twice(self, other):
        raise AssertionError("computes both sides, and again for the other direction")

    monkeypatch.setattr(DataFrame, "exceptAll", twice)
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "`a.b` int, c string")
    assert verify.same_rows(a, a.repartition(3))
    assert not verify.same_rows(a, a.distinct())
    assert not verify.same_rows(a.limit(0), a) and verify.same_rows(a.limit(0), a.limit(0))
