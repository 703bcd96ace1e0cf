"""Rules, offsets, resolution, masking on small texts; results do not depend on how rows are dealt."""

import re

from pyspark.sql import functions as F

from maskloom.operators.alias import first_appearances, merge_books, number_aliases
from maskloom.operators.detect import detect, match_offsets
from maskloom.operators.resolve import apply_edits, greedy
from maskloom.operators.rules import PROFILES
from maskloom.plans.detection_queries import _FOUND, _JAPANESE, japanese_spans
from maskloom.plans.flagship import mask_texts


def test_offsets_equal_those_of_a_scan(spark):
    texts = ["", "a1b22c333", "é😀12 x", "99", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: [(m.start, m.text) for m in r.m] if r.m is not None else [] for r in df.select("id", match_offsets(F.col("text"), "[0-9]+").alias("m")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [(m.start(), m[0]) for m in re.finditer("[0-9]+", t or "")]


def test_japanese_rules(spark, sf):
    got = {(r.id, r.label, r.start, r.end) for r in japanese_spans(spark, sf).collect()}
    assert got == set(_FOUND)
    by_text = {r[0]: r[1] for r in _JAPANESE}
    for r in japanese_spans(spark, sf).collect():
        assert by_text[r.id][r.start : r.end] == r.value


def test_greedy_prefers_score_then_length(spark):
    rows = [(0, 5, 0.5), (3, 9, 0.9), (9, 12, 0.1), (8, 12, 0.1)]
    item = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("c").alias("category"), F.lit(s).alias("score")) for a, b, s in rows])
    got = spark.range(1).select(greedy(item).alias("g")).first().g
    assert [(x.start, x.end) for x in got] == [(3, 9), (9, 12)]


def test_edits(spark):
    e = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("replacement")) for a, b, t in ((0, 1, "X"), (3, 3, "+"), (4, 6, ""))])
    assert spark.range(1).select(apply_edits(F.lit("abcdéf"), e).alias("t")).first().t == "Xbc+d"


def test_aliases_follow_first_appearance(spark):
    v = spark.createDataFrame([("name", "b", 1), ("name", "a", 2), ("name", "b", 3), ("ip", "z", 4)], "kind string, norm_key string, ord long")
    book = number_aliases(first_appearances(v, []), [], range_size=2)
    assert {(r.kind, r.norm_key, r.alias) for r in book.collect()} == {("name", "b", "個人001"), ("name", "a", "個人002"), ("ip", "z", "IP001")}
    more = merge_books(book, spark.createDataFrame([("name", "c", 9), ("name", "a", 8)], "kind string, norm_key string, ord long"), [])
    assert {(r.norm_key, r.alias_no) for r in more.filter("kind = 'name'").collect()} == {("b", 1), ("a", 2), ("c", 3)}


def test_masking_is_the_same_however_rows_are_dealt(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = {tuple(r) for r in mask_texts(docs).collect()}
    assert a == {tuple(r) for r in mask_texts(docs.repartition(7)).collect()}


def test_blank_and_null_texts_have_no_spans(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "")], "id int, text string")
    assert all(len(r.spans) == 0 for r in detect(df, PROFILES["japanese"]).collect())
