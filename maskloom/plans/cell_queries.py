"""Queries on workbooks made of customers: one file a nation, one sheet a market segment, one row a customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import dictionary as D
from ..operators.structured import column_types, typed_cells
from ..storage import materialize
from .tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


HEADERS = ("氏名", "氏名カナ", "電話番号", "固定電話", "生年月日", "内容")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def workbooks(spark, sf_dir):
    """Cells of all customers; every third has no landline, every seventh birth date is a formula."""
    tail = F.concat(F.lit("-"), F.lpad((F.floor(F.col("c_custkey") / 10000) % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))
    c = table(spark, sf_dir, "customer").withColumn("c_phone", F.concat((F.col("c_nationkey") + 10).cast("string"), F.lit("-555"), tail))
    n = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")).cast("int")
    note = F.concat(F.lit("Ask "), F.upper("c_name"), F.lit(" or "), F.col("c_phone"), F.lit(" today; mail x"), F.col("c_name"), F.lit("@e.org"))
    land = F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("03-1111-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")))
    born = F.concat((1950 + F.col("c_custkey") % 50).cast("string"), F.lit("-01-02"))
    values = [F.col("c_name"), F.concat(F.lit("カナ"), F.col("c_custkey").cast("string")), F.col("c_phone"), land, born, note]
    body = c.select(
        F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("file_id"), F.concat(F.lit("0"), n.cast("string"), F.lit("_"), F.col("c_mktsegment")).alias("sheet"), n.alias("sheet_ord"),
        (F.col("c_custkey") + 2).cast("int").alias("row"), (F.col("c_custkey") % 7 == 0).alias("odd"), F.posexplode(F.array(*values)).alias("i", "value"),
    )
    body = body.select("file_id", "sheet", "sheet_ord", "row", (F.col("i") + 1).alias("col"), "value", (F.col("odd") & (F.col("i") == 4)).alias("is_formula"))
    heads = body.select("file_id", "sheet", "sheet_ord").distinct().select("*", F.posexplode(F.array(*map(F.lit, HEADERS))).alias("i", "value"))
    heads = heads.select("file_id", "sheet", "sheet_ord", F.lit(1).alias("row"), (F.col("i") + 1).alias("col"), "value", F.lit(False).alias("is_formula"))
    return heads.unionByName(body)


BASE = """WITH c AS (SELECT *, (10 + c_nationkey)::VARCHAR || '-555-' || lpad((c_custkey // 10000 % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS c_phone,
  list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) AS n FROM customer),
  a AS (SELECT *, 'f' || c_nationkey AS file_id, '0' || n || '_' || c_mktsegment AS sheet, n = 3 AS elsewhere,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY n, c_custkey) AS k FROM c),
  b AS (SELECT *, '個人' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS person,
    split_part(c_phone, '-', 1) || '-XXX-' || split_part(c_phone, '-', 4) AS masked FROM a)"""


@query(BASE + " SELECT file_id, sheet, c_custkey + 2 AS row, col, person AS alias FROM b, (VALUES (1), (2)) AS t(col)")
def seeded_name_aliases(spark, sf_dir):
    """Names and the kana beside them share an alias; on the sheet of people from elsewhere each name has its own."""
    known = typed_cells(workbooks(spark, sf_dir)).filter("kind IS NOT NULL")
    _, aliases = D.seed_aliases(known)
    return aliases.filter("col <= 2").select("file_id", "sheet", F.col("row").cast("long"), "col", "alias")


@query("""WITH c AS (SELECT *, list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) AS n FROM customer),
  v AS (SELECT *, CASE WHEN c_custkey % 3 <> 0 THEN '03-1111-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END AS land FROM c),
  firsts AS (SELECT c_nationkey, land, min((n * 10000000 + c_custkey)) AS o FROM v WHERE land IS NOT NULL GROUP BY 1, 2
    UNION ALL SELECT c_nationkey, NULL, n * 10000000 + c_custkey FROM v WHERE land IS NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY o) AS k FROM firsts)
  SELECT 'f' || v.c_nationkey AS file_id, c_custkey + 2 AS row, '固定電話' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS alias
  FROM v JOIN k ON k.c_nationkey = v.c_nationkey AND k.land = v.land""")
def blank_landlines_use_numbers(spark, sf_dir):
    cells = workbooks(spark, sf_dir)
    kinds = column_types(cells)
    known = typed_cells(cells).filter("kind IS NOT NULL")
    _, aliases = D.seed_aliases(known, D.blank_landlines(cells, kinds))
    return aliases.filter("col = 4").select("file_id", F.col("row").cast("long"), "alias")


@query(BASE + """ SELECT file_id, c_custkey + 2 AS row, 4 AS start, upper(c_name) AS text, person AS alias FROM b WHERE NOT elsewhere
  UNION ALL SELECT file_id, c_custkey + 2, length(c_name) + 8, c_phone, masked FROM b""")
def dictionary_hits(spark, sf_dir):
    """Known names in any case and phone numbers in notes; not the name within the e-mail address."""
    from ..functions.generalise import replacement

    typed = materialize(typed_cells(workbooks(spark, sf_dir)), "cells-typed")
    known = typed.filter("kind IS NOT NULL")
    _, aliases = D.seed_aliases(known)
    words = D.dictionary(known, aliases, F.when(F.col("kind") == "name", F.col("alias")).otherwise(replacement(F.col("kind"), F.col("value"), F.col("alias"))))
    texts = typed.filter("kind IS NULL").withColumn("text", F.col("value"))
    hits = D.literal_hits(texts, words, D.PLACE)
    return hits.select("file_id", F.col("row").cast("long"), F.explode("hits").alias("h")).select("file_id", "row", "h.start", "h.text", "h.alias")


@query(BASE + """ SELECT file_id, c_custkey + 2 AS row, '列単位' AS detection, '見出し「生年月日」 / 分析継続用のため' || CASE WHEN c_custkey % 7 = 0 THEN '数式セルは維持' ELSE '型と値を維持' END AS reason,
  ((1950 + c_custkey % 50) // 10 * 10)::VARCHAR || '年代' AS replacement, FALSE AS enabled FROM b""")
def preserved_columns(spark, sf_dir):
    """Findings in columns whose type and value an analysis keeps, with the reason."""
    found = C.scan_cells(workbooks(spark, sf_dir)).filter("kind = 'birth_date'")
    return found.select("file_id", F.col("row").cast("long"), "detection", "reason", "replacement", "enabled")


@query(BASE + """ SELECT file_id, c_custkey + 2 AS row, person AS name, person AS kana, masked AS phone, (1950 + c_custkey % 50)::VARCHAR || '-01-02' AS born,
  'Ask ' || CASE WHEN elsewhere THEN upper(c_name) ELSE person END || ' or ' || masked || ' today; mail x' || c_name || '@e.org' AS note FROM b""")
def converted_workbooks(spark, sf_dir):
    """Cells after all findings were applied, one row of the sheet a row."""
    cells = workbooks(spark, sf_dir)
    done = C.apply_findings(cells, C.scan_cells(cells)).filter("row > 1")
    at = lambda i, n: F.max(F.when(F.col("col") == i, F.col("new_value"))).alias(n)
    return done.groupBy("file_id", F.col("row").cast("long").alias("row")).agg(at(1, "name"), at(2, "kana"), at(3, "phone"), at(5, "born"), at(6, "note"))


@query("""SELECT c_custkey AS id, count(*) AS n FROM customer, (VALUES (1), (2), (3), (4), (5), (6)) AS t(col)
  WHERE NOT (c_custkey % 5 = 0 AND col BETWEEN 2 AND 1 + c_custkey % 4 AND c_custkey % 10 = 0) GROUP BY 1""")
def cells_outside_table_headers(spark, sf_dir):
    """Every tenth customer heads a table of its own that starts in the second column; every fifth one without a header."""
    cells = workbooks(spark, sf_dir).filter("row > 1")
    tables = cells.filter("col = 1 AND (row - 2) % 5 = 0").select("file_id", "sheet", F.col("row").alias("top"), F.lit(2).alias("left"), (1 + (F.col("row") - 2) % 4).alias("right"), F.when((F.col("row") - 2) % 10 == 0, 1).otherwise(0).alias("header_rows"))
    tables = tables.filter("right >= left")
    return C.without_table_headers(cells, tables).groupBy((F.col("row") - 2).cast("long").alias("id")).agg(F.count("*").alias("n"))


FAMILY = ("森", "林", "原", "関")


@query("""WITH o AS (SELECT o_orderkey, list_extract(['森', '林', '原', '関'], CAST(o_orderkey % 4 AS INT) + 1) AS f, o_orderkey % 3 AS m FROM orders)
  SELECT o_orderkey AS id, CASE m WHEN 0 THEN 3 WHEN 1 THEN 0 END::INTEGER AS start, CASE m WHEN 0 THEN f ELSE f || 'さん' END AS text FROM o WHERE m < 2""")
def single_family_names(spark, sf_dir):
    """Family names of one character count after の and before です, or with さん, and nowhere else."""
    f = F.element_at(F.array(*map(F.lit, FAMILY)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    m = F.col("o_orderkey") % 3
    text = F.when(m == 0, F.concat(F.lit("担当の"), f, F.lit("です。"))).when(m == 1, F.concat(f, F.lit("さんへ"))).otherwise(F.concat(f, F.lit("を抜ける")))
    texts = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 97).cast("string").alias("file_id"), "o_orderkey", text.alias("text"))
    words = spark.createDataFrame([(x, i) for i, x in enumerate(FAMILY)], "literal string, i int")
    words = texts.select("file_id").distinct().crossJoin(F.broadcast(words)).select("file_id", "literal", F.lit(True).alias("single"), F.lit("氏名").alias("label"), F.concat(F.lit("個人"), F.col("i").cast("string")).alias("alias"), F.col("i").alias("ord"))
    hits = D.literal_hits(texts, words, ["file_id", "o_orderkey"])
    return hits.select(F.col("o_orderkey").alias("id"), F.explode("hits").alias("h")).select("id", "h.start", "h.text")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 2 = 0 THEN '個人' || lpad((o_custkey % 100)::VARCHAR, 3, '0') END AS known FROM orders),
  k AS (SELECT *, coalesce(known, 'N' || o_custkey) AS key FROM o), f AS (SELECT key, row_number() OVER (ORDER BY min(o_orderkey)) AS n FROM k GROUP BY 1)
  SELECT o_orderkey AS id, '個人候補' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END || 'さん' AS mask FROM k JOIN f USING (key)""")
def candidate_masks(spark, sf_dir):
    """Doubtful names as numbered candidates that keep their honorific."""
    known = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("個人"), F.lpad((F.col("o_custkey") % 100).cast("string"), 3, "0")))
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("N"), F.col("o_custkey").cast("string"), F.lit("さん")).alias("original"), known.alias("alias"))
    return D.candidate_masks(found, []).select("id", "mask")


@query("""WITH v AS (SELECT c_custkey AS id, 'u' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '@' ELSE '' END AS value FROM customer),
  b AS (SELECT c_custkey AS k, 'メール' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS alias FROM customer WHERE c_custkey % 4 = 0),
  r AS (SELECT id, value, row_number() OVER (ORDER BY id) AS n FROM v LEFT JOIN b ON k = id WHERE alias IS NULL)
  SELECT v.id, 'mail候補' || coalesce(right(alias, 3), CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE right(n::VARCHAR, 3) END) || '@example.invalid' AS mask
  FROM v LEFT JOIN b ON k = id LEFT JOIN r ON r.id = v.id""")
def incomplete_emails(spark, sf_dir):
    """Addresses without a domain: every fourth is known at example.jp and, with another number, at example.org."""
    c = table(spark, sf_dir, "customer")
    at = F.when(F.col("c_custkey") % 2 == 0, "@").otherwise("")
    user = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    values = c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), F.concat(user, at).alias("value"))
    known = c.filter("c_custkey % 4 = 0")
    number = F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0")
    book = known.select(F.lit("email").alias("kind"), F.concat(user, F.lit("@example.jp")).alias("norm_key"), F.concat(F.lit("メール"), number).alias("alias"))
    book = book.unionByName(known.select(F.lit("email").alias("kind"), F.concat(user, F.lit("@example.org")).alias("norm_key"), F.lit("メール999").alias("alias")))
    return D.incomplete_emails(values, book, [], True).select("id", "mask")
