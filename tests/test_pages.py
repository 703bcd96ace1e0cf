"""Functions of whole pages: many pages a batch, odd rows, no call of pandas for each page."""

import pytest

from maskloom.operators import spatial as S
from maskloom.plans import registry


@pytest.mark.parametrize("name", ["context_candidates", "context_candidates_by_pattern", "rows_of_lines", "deduped_candidates"])
def test_pages_share_batches(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_pages_cut_by_batches_and_null_numbers(spark):
    rows = [("f", p, b, 0, 50.0 * b, 10.0 * b, 50.0 * b + 40, 10.0 * b + 10) for p in range(20) for b in range(3)] + [("f", None, 0, 0, 0.0, None, 1.0, 1.0), (None, 1, None, 0, 0.0, 0.0, 1.0, 9.0)]
    lines = spark.createDataFrame(rows, "file_id string, page int, block int, line int, x0 double, y0 double, x1 double, y1 double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = S.visual_rows(lines).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(rows)
    assert all(r.vrow == (r.block or 0) for r in got)
    assert [r.y0 for r in got if r.page is None] == [None]
