"""Rectangles that cover one another: cells decide nothing, boxes with one rectangle meet once, signatures tell tables apart."""

from itertools import product
from math import inf, nan

from pyspark.sql import functions as F

from maskloom.operators import evaluate, verify
from maskloom.plans import evaluation_queries

KEYS = ["page", "kind"]


def test_cells_find_all_matches(spark):
    sizes = [(0.0, 0.0, 40.0, 10.0), (-1.0, 0.0, 40.0, 10.0), (39.0, 19.0, 41.0, 21.0), (30.0, 15.0, 50.0, 25.0), (-700.0, -700.0, 700.0, 700.0), (-660.0, -330.0, -620.0, -320.0),
             (640.0, 320.0, 680.0, 330.0), (40.0, 10.0, 0.0, 0.0), (5.0, 5.0, 5.0, 5.0), (1e13, 0.0, 1e13 + 40, 10.0), (-inf, -inf, inf, inf), (nan, 0.0, 40.0, 10.0), (None, 0.0, 40.0, 10.0), (0.0, None, 40.0, 10.0)]
    rows = [(p, k, i, *s) for (p, k), (i, s) in product([(1, "a"), (1, "b"), (None, "a")], enumerate(sizes))]
    t, c = (spark.createDataFrame(rows, f"page int, kind string, {n} int, x0 double, y0 double, x1 double, y1 double") for n in ("truth_id", "cand_id"))
    pairs = evaluate._side(t, "t_", KEYS, "truth_id").join(evaluate._side(c, "c_", KEYS, "cand_id"), KEYS)
    for least in (0.3, 0.51, 0.85, 1.0):
        want = pairs.filter(evaluate.coverage("t_", "c_") >= least).select(*KEYS, "truth_id", "cand_id")
        got = evaluate.rectangle_matches(t, c, KEYS, least).select(*KEYS, "truth_id", "cand_id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert ("__cell" in got._jdf.queryExecution().optimizedPlan().toString()) == (least > 0.5)


def test_determinism_check_meets_copies_of_a_rectangle_once(spark, sf, tmp_path, monkeypatch):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_orderkey < 100")
    copies = li.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("l_orderkey", F.col("l_orderkey") + 150_000 * F.col("k"))
    copies.drop("k").write.parquet(str(tmp_path / "lineitem.parquet"))
    met, plain = [], evaluate.rectangle_matches
    monkeypatch.setattr(evaluate, "rectangle_matches", lambda *a, **k: met.append(plain(*a, **k)) or met[-1])
    assert [r[0] for r in evaluation_queries.determinism_check(spark, str(tmp_path)).collect()] == [True]
    boxes = copies.select("l_orderkey", "l_linenumber").distinct().count()
    assert len(met) == 2 and 0 < met[0].count() == met[1].count() <= boxes / 20 * 2


def test_determinism_check_sees_a_difference(spark, sf, monkeypatch):
    plain, calls = evaluate.rectangle_matches, []

    def loses_one(*a, **k):
        calls.append(1)
        m = plain(*a, **k)
        return m if len(calls) == 1 else m.filter(F.to_json("truth_id") != m.agg(F.min(F.to_json("truth_id"))).first()[0])

    monkeypatch.setattr(evaluate, "rectangle_matches", loses_one)
    assert [r[0] for r in evaluation_queries.determinism_check(spark, sf).collect()] == [False]


def test_signature(spark):
    def of(*rows):
        return [tuple(r) for r in verify.signature(spark.createDataFrame(rows, "g int, a int, `b.c` int"), ["g"]).orderBy("g").collect()]

    rows = [(1, 1, None), (1, 1, None), (1, 2, 3), (None, 4, 5)]
    assert of(*rows) == of(*rows[::-1])
    for others in ([(1, None, 1), *rows[1:]], rows[1:], [*rows, rows[2]], [(1, 2, 3), (1, 2, 3), (1, 1, None), (None, 4, 5)], [(2, 1, None), *rows[1:]]):
        assert of(*rows) != of(*others)
