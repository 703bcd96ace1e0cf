"""Literals and texts meet by rare pieces, and nothing of either side is broadcast."""

from maskloom.operators import dictionary as D

WORD = "file_id string, literal string, single boolean, label string, alias string, ord int"


def test_literals_that_begin_alike_meet_only_their_texts(spark):
    words = spark.createDataFrame([("f", f"Customer#{i:09}", False, "氏名", f"a{i}", i) for i in range(50)] + [("g", "山田", False, "氏名", "b", 0), ("f", "森", True, "氏名", "c", 51)], WORD)
    rows = [("f", i, f"Ask CUSTOMER#{i:09} today") for i in range(50)] + [("f", 50, "担当の森です"), ("g", 51, "山田と森さん"), ("f", 52, ""), ("f", 53, None), ("f", 54, "Customer#")]
    hits = D.literal_hits(spark.createDataFrame(rows, "file_id string, id int, text string"), words, ["file_id", "id"])
    assert "Broadcast" not in hits._jdf.queryExecution().executedPlan().toString()
    got = {r.id: [(h.start, h.text, h.alias) for h in r.hits] for r in hits.collect()}
    want = {i: [(4, f"CUSTOMER#{i:09}", f"a{i}")] for i in range(50)} | {50: [(3, "森", "c")], 51: [(0, "山田", "b")], 52: [], 53: [], 54: []}
    assert got == want
