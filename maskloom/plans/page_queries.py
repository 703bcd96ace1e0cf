"""Queries on pages, paragraphs and slides made of orders by arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as Y
from ..operators import profiles as P
from ..operators import spatial as S
from .label_queries import orders, pick

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# (x0, y0, x1, y1, text, block, line): labels with a value beside and below, a table, a section with a value in two parts
LAYOUT = (
    (10, 10, 50, 20, "会社名", 0, 0), (80, 10, 200, 20, "北方{c}商事株式会社", 0, 0), (10, 50, 50, 60, "所在地", 1, 0), (12, 65, 120, 75, "東京都港区芝{c}丁目", 1, 1),
    (10, 100, 40, 110, "氏名", 2, 0), (110, 100, 140, 110, "住所", 2, 0), (12, 130, 34, 140, "山田", 2, 1), (36, 130, 60, 140, "太郎", 2, 1), (100, 130, 200, 140, "大阪市北区梅田{c}", 2, 1),
    (10, 200, 60, 210, "仕入先", 3, 0), (12, 225, 120, 235, "株式会社東部{c}", 4, 0), (12, 250, 50, 260, "東北", 5, 0), (12, 265, 90, 275, "電機工業所", 5, 1),
)


def layouts(spark, sf_dir):
    """Words of one page an order, moved by some points."""
    o = orders(spark, sf_dir).withColumn("dx", (F.col("c") % 7).cast("double")).withColumn("dy", (F.col("c") % 5).cast("double"))
    rows = [(float(a), float(b), float(c), float(d), t, k, n, i) for i, (a, b, c, d, t, k, n) in enumerate(LAYOUT)]
    w = F.broadcast(spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double, t string, block int, line int, word_no int"))
    moved = [(F.col(a) + F.col("dx")).alias(a) for a in ("x0", "x1")] + [(F.col(a) + F.col("dy")).alias(a) for a in ("y0", "y1")]
    size = [F.lit(v).alias(f"page_{n}") for n, v in (("x0", 0.0), ("y0", 0.0), ("x1", 600.0), ("y1", 800.0))]
    text = F.replace(F.col("t"), F.lit("{c}"), (F.col("c") % 9 + 1).cast("string"))
    return o.crossJoin(w).select(F.lit("f").alias("file_id"), F.col("id").cast("int").alias("page"), *moved, text.alias("text"), "block", "line", "word_no", *size)


O = "(SELECT o_orderkey::INTEGER AS page, (o_custkey % 7)::DOUBLE AS dx, (o_custkey % 5)::DOUBLE AS dy, (o_custkey % 9 + 1)::VARCHAR AS c FROM orders)"


@query(f"""SELECT page, 'label_value:corporate_name' AS rule, '会社名' AS kind, '北方' || c || '商事株式会社' AS norm, 'HIGH' AS confidence, round(78 + dx, 6) AS x0, round(8.2 + dy, 6) AS y0, round(202 + dx, 6) AS x1, round(21.8 + dy, 6) AS y1 FROM {O}
  UNION ALL SELECT page, 'label_value:address', '住所', '東京都港区芝' || c || '丁目', 'HIGH', round(4.3 + dx, 6), round(60.76 + dy, 6), round(127.7 + dx, 6), round(79.24 + dy, 6) FROM {O}
  UNION ALL SELECT page, 'label_value:address', '住所', '山田太郎大阪市北区梅田' || c, 'HIGH', round(4.3 + dx, 6), round(125.76 + dy, 6), round(207.7 + dx, 6), round(144.24 + dy, 6) FROM {O}
  UNION ALL SELECT page, 'table_column:person_name', '氏名', '山田太郎', 'HIGH', round(greatest(0, dx - 3.4), 6), round(126.32 + dy, 6), round(75.4 + dx, 6), round(143.68 + dy, 6) FROM {O}
  UNION ALL SELECT page, 'pattern:corporate_marker', '会社名', '株式会社東部' || c, 'LOW', round(10 + dx, 6), round(223.2 + dy, 6), round(122 + dx, 6), round(236.8 + dy, 6) FROM {O}
  UNION ALL SELECT page, 'section_block:business_partner', '会社名', '電機工業所', 'MEDIUM', round(greatest(0, dx - 0.4), 6), round(255.04 + dy, 6), round(102.4 + dx, 6), round(284.96 + dy, 6) FROM {O}""")
def context_candidates(spark, sf_dir):
    """Values beside and below labels, under headers, below headings and alone, one of each place."""
    c = Y.context_candidates(layouts(spark, sf_dir))
    return c.select("page", "rule", "kind", "norm", "confidence", *[F.round(x, 6).alias(x) for x in ("x0", "y0", "x1", "y1")])


@query(f"SELECT page, 'pattern:corporate_marker' AS rule, norm FROM {O}, (VALUES (0), (1)) AS t(i), LATERAL (SELECT CASE i WHEN 0 THEN '会社名北方' || c || '商事株式会社' ELSE '株式会社東部' || c END AS norm)\n  UNION ALL SELECT page, 'pattern:address', '東京都港区芝' || c || '丁目' FROM {O}")
def context_candidates_by_pattern(spark, sf_dir):
    """With all families but one switched off."""
    return Y.context_candidates(layouts(spark, sf_dir), ("pattern",)).select("page", "rule", "norm")


@query(f"SELECT o_orderkey::INTEGER AS page, round(({'+'.join(f'({c}-{a})*({d}-{b})' for a, b, c, d, *_ in LAYOUT)}) / 480000.0, 9) AS area_ratio FROM orders")
def text_area_ratios(spark, sf_dir):
    return Y.text_area_ratio(layouts(spark, sf_dir)).select("page", F.round("area_ratio", 9).alias("area_ratio"))


@query("""SELECT page, block, line, dense_rank() OVER (PARTITION BY page ORDER BY r) - 1 AS vrow FROM (SELECT o_orderkey::INTEGER AS page, block, line, CASE WHEN moved THEN 0 ELSE block END AS r
  FROM (SELECT o_orderkey, b.block, 0 AS line, b.block = 1 AND o_custkey % 4 < 2 AS moved FROM orders, (VALUES (0), (1), (2)) AS b(block)))""")
def rows_of_lines(spark, sf_dir):
    """Three lines a page: the second is on the first one's row where its centre is at most 5.5 points lower, not at 6."""
    o = orders(spark, sf_dir)
    b = o.select(F.col("id").cast("int").alias("page"), (F.col("c") % 4).alias("m"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("block"))
    y0 = F.when(F.col("block") == 0, 10.0).when(F.col("block") == 1, F.element_at(F.array(F.lit(14.0), F.lit(15.5), F.lit(16.0), F.lit(30.0)), (F.col("m") + 1).cast("int"))).otherwise(60.0)
    lines = b.select(F.lit("f").alias("file_id"), "page", "block", F.lit(0).alias("line"), (F.col("block") * 50.0).alias("x0"), y0.alias("y0"), (F.col("block") * 50.0 + 40).alias("x1"), (y0 + 10).alias("y1"))
    return S.visual_rows(lines).select("page", "block", "line", F.col("vrow").cast("long"))


@query("""SELECT o_orderkey::INTEGER AS page, cand_id FROM orders, (VALUES (1), (2), (3), (4), (5)) AS t(cand_id)
  WHERE cand_id = CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 1 END OR cand_id = 4 OR (cand_id = 5 AND o_custkey % 3 = 0)""")
def deduped_candidates(spark, sf_dir):
    """Of five: 2 takes the place of 1 where its rank is higher, 3 has the place of 1, 4 is of another kind, and 5 overlaps
    1 but goes only where its text is the same."""
    o = orders(spark, sf_dir)
    c = o.select(F.col("id").cast("int").alias("page"), "c", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("cand_id"))
    i = F.col("cand_id")
    rows = c.select(
        F.lit("f").alias("file_id"), "page", "cand_id", F.when(i == 4, "住所").otherwise("氏名").alias("kind"), F.when((i == 5) & (F.col("c") % 3 == 0), "別の値").otherwise("山田").alias("norm"),
        F.when(i == 2, F.when(F.col("c") % 2 == 0, 4).otherwise(2)).otherwise(3).alias("rank"), F.when(i == 5, 0.0).when(i == 2, 1.0).otherwise(0.0).alias("x0"), F.lit(0.0).alias("y0"),
        F.when(i == 5, 100.0).when(i == 2, 11.0).otherwise(10.0).alias("x1"), F.lit(10.0).alias("y1"),
    )
    return S.spatial_dedupe(rows).select("page", "cand_id")


@query("""WITH o AS (SELECT o_orderkey::INTEGER AS page, (o_custkey % 9)::DOUBLE AS dx, lpad((o_custkey % 10000)::VARCHAR, 4, '0') AS d FROM orders)
  SELECT page, '電話番号' AS category, '090-' || d || '-2222' AS text, round(182 + dx - 18 / 1.4 * 13 * 0.52, 6) AS x0, 6.0::DOUBLE AS y0, round(182 + dx, 6) AS x1, 24.0::DOUBLE AS y1 FROM o
  UNION ALL SELECT page, 'メールアドレス', 'u' || d || '@e.org', 19.2, 33.0, 102.0, 57.0 FROM o""")
def page_candidate_rects(spark, sf_dir):
    """A phone number behind a colon in another word, and an address alone: widened, tightened, on the page."""
    o = orders(spark, sf_dir).select(F.col("id").cast("int").alias("page"), (F.col("c") % 9).cast("double").alias("dx"), F.lpad((F.col("c") % 10000).cast("string"), 4, "0").alias("d"))
    word = lambda x0, x1, y0, t, n, b: F.struct((F.lit(x0) + F.col("dx") * int(b == 0)).alias("x0"), F.lit(y0).alias("y0"), (F.lit(x1) + F.col("dx") * int(b == 0)).alias("x1"), F.lit(y0 + 10).alias("y1"), t.alias("text"), F.lit(b).alias("block"), F.lit(0).alias("line"), F.lit(n).alias("word_no"))
    items = F.array(word(10.0, 50.0, 10.0, F.lit("TEL:"), 0, 0), word(50.0, 180.0, 10.0, F.concat(F.lit("090-"), "d", F.lit("-2222")), 1, 0), word(200.0, 240.0, 10.0, F.lit("宛先"), 2, 0), word(20.0, 100.0, 40.0, F.concat(F.lit("u"), "d", F.lit("@e.org")), 0, 1))
    words = o.select(F.lit("f").alias("file_id"), "page", F.explode(items).alias("w")).select("file_id", "page", "w.*")
    pages = o.select(F.lit("f").alias("file_id"), "page", *[F.lit(v).alias(f"page_{n}") for n, v in (("x0", 0.0), ("y0", 0.0), ("x1", 600.0), ("y1", 800.0))])
    r = P.candidate_rects(P.detect_in_pages(S.ocr_lines(words)), words, pages)
    return r.select("page", "category", "text", *[F.round(x, 6).alias(x) for x in ("x0", "y0", "x1", "y1")])


TEXTS = ("会社名：北方{c}商事", "株式会社東{c}です", "山田 太郎様と{c}", "東京都港区芝{c}丁目1-2 みなとビル5階。", "mail user{c}@example.com now", "住所：北町", "担当者：田中一郎")
_TEXT = "list_extract(['" + "', '".join(TEXTS) + "'], CAST(o_custkey % 7 AS INT) + 1)"


def _texts(spark, sf_dir):
    return orders(spark, sf_dir).select("id", F.replace(pick(TEXTS, F.col("c")), F.lit("{c}"), F.col("id").cast("string")).alias("text"))


def _expected(company: str, address: str) -> str:
    return f"""SELECT id, category, value FROM (SELECT o_orderkey AS id, o_custkey % 7 AS m, list_extract(['会社名', '会社名', '氏名', '住所', 'メールアドレス', NULL, '氏名'], CAST(o_custkey % 7 AS INT) + 1) AS category,
  CASE o_custkey % 7 WHEN 0 THEN '北方' || o_orderkey || '商事' WHEN 1 THEN {company} WHEN 2 THEN '山田 太郎' WHEN 3 THEN {address} WHEN 4 THEN 'user' || o_orderkey || '@example.com' WHEN 6 THEN '田中一郎' END AS value FROM orders) WHERE category IS NOT NULL"""


@query(_expected("'株式会社東' || o_orderkey", "'東京都港区芝' || o_orderkey || '丁目1-2 みなとビル5階'"))
def document_spans(spark, sf_dir):
    """Paragraphs by the rules of documents and of all texts: sentence ends cut, buildings taken in, weak addresses left."""
    d = P.detect_in_paragraphs(_texts(spark, sf_dir), direct=True)
    return d.select("id", F.explode("spans").alias("x")).select("id", "x.category", F.col("x.text").alias("value"))


@query(_expected("'株式会社東' || o_orderkey || 'です'", "'東京都港区芝' || o_orderkey || '丁目1-2'"))
def slide_spans(spark, sf_dir):
    """The same texts by the rules of slides."""
    d = P.detect_in_slides(_texts(spark, sf_dir))
    return d.select("id", F.explode("spans").alias("x")).select("id", "x.category", F.col("x.text").alias("value"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'JP_NAME' ELSE 'JP_EMAIL' END AS category,
  CASE WHEN o_custkey % 2 = 0 THEN 'Ann Lee' ELSE 'a' || o_orderkey || '@e.org' END AS value FROM orders""")
def text_layer_spans(spark, sf_dir):
    o = orders(spark, sf_dir)
    text = F.when(F.col("c") % 2 == 0, "Name: Ann Lee").otherwise(F.concat(F.lit("a"), F.col("id").cast("string"), F.lit("@e.org")))
    d = P.detect_in_text_layer(o.select("id", text.alias("text")))
    return d.select("id", F.explode("spans").alias("x")).select("id", "x.category", F.col("x.text").alias("value"))


@query("""SELECT o_orderkey AS id, kind, value FROM (SELECT o_orderkey, 'Address' AS kind, '東京都港区芝' || o_orderkey AS value FROM orders WHERE o_custkey % 2 = 0
  UNION ALL SELECT o_orderkey, 'Address', '東京都港区芝' || o_orderkey FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_orderkey, 'Name', '山田　太郎' FROM orders WHERE o_custkey % 2 = 1)""")
def legacy_candidates(spark, sf_dir):
    """The older rules: an address by prefecture and by city, a name by its label."""
    text = F.when(F.col("c") % 2 == 0, F.concat(F.lit("東京都港区芝"), F.col("id").cast("string"))).otherwise("氏名：山田　太郎")
    return orders(spark, sf_dir).select("id", F.explode(P.legacy_candidates(text)).alias("x")).select("id", "x.kind", "x.value")

