"""Queries that compare: outputs with sources, truths with candidates, runs, states. Inputs are made by arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as K
from .label_queries import orders, pick
from .tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


O = "(SELECT o_orderkey AS id, o_custkey AS c FROM orders)"
_CAUSES = f"""WITH t AS (SELECT id AS loc, CASE c % 2 WHEN 0 THEN '氏名' ELSE '住所' END AS category, 10 + c % 5 AS s, 20 + c % 5 AS e FROM {O}),
  k AS (SELECT id AS loc, CASE c % 3 WHEN 0 THEN '氏名' ELSE '住所' END AS category, 10 + id % 13 AS s, 18 + id % 7 AS e FROM {O} WHERE id % 4 <> 0)"""


def _causes_sql(rows: str, others: str, missed: bool) -> str:
    short, long_ = ("x.s > r.s OR x.e < r.e", "x.s < r.s OR x.e > r.e") if missed else ("r.s > x.s OR r.e < x.e", "r.s < x.s OR r.e > x.e")
    hit = "(r.s < x.e AND x.s < r.e)"
    none, rest = (K.NO_CANDIDATE, "その他") if missed else (K.NO_TRUTH, "重複候補")
    return f"""{_CAUSES} SELECT r.loc, CASE WHEN NOT coalesce(bool_or({hit}), FALSE) THEN '{none}' WHEN bool_or({hit} AND x.category <> r.category) THEN 'カテゴリ誤分類'
      WHEN bool_or({hit} AND ({short})) THEN 'span不足' WHEN bool_or({hit} AND ({long_})) THEN 'span過大' ELSE '{rest}' END AS cause, count(x.loc) AS related
      FROM {rows} r LEFT JOIN {others} x ON x.loc = r.loc GROUP BY r.loc, r.category, r.s, r.e"""


def _truths_and_found(spark, sf_dir):
    o = orders(spark, sf_dir)
    c, i = F.col("c"), F.col("id")
    t = o.select(i.alias("loc"), F.when(c % 2 == 0, "氏名").otherwise("住所").alias("category"), (10 + c % 5).alias("start"), (20 + c % 5).alias("end"))
    k = o.filter("id % 4 <> 0").select(i.alias("loc"), F.when(c % 3 == 0, "氏名").otherwise("住所").alias("category"), (10 + i % 13).alias("start"), (18 + i % 7).alias("end"))
    return t, k


@query(_causes_sql("t", "k", True))
def missed_causes(spark, sf_dir):
    t, k = _truths_and_found(spark, sf_dir)
    return K.error_causes(t, k, ["loc"], True).select("loc", "cause", "related")


@query(_causes_sql("k", "t", False))
def false_positive_causes(spark, sf_dir):
    t, k = _truths_and_found(spark, sf_dir)
    return K.error_causes(k, t, ["loc"], False).select("loc", "cause", "related")


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place, count(*) OVER (PARTITION BY l_orderkey) AS total FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
  r AS (SELECT k, n * 10 AS m, row_number() OVER (PARTITION BY k ORDER BY n) AS place, count(*) OVER (PARTITION BY k) AS total FROM l WHERE NOT (k % 3 = 0 AND n = 1))
  SELECT coalesce(l.k, r.k) AS k, coalesce(l.place, r.place)::INTEGER AS place, n, m, coalesce(l.total = r.total, FALSE) AS same_count FROM l FULL JOIN r ON l.k = r.k AND l.place = r.place""")
def rows_side_by_side(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).distinct()
    right = left.filter("NOT (k % 3 = 0 AND n = 1)").select("k", (F.col("n") * 10).alias("m"))
    both = K.side_by_side(left, right.withColumn("n", F.col("m")), ["k"], "n")
    return both.select("k", "place", F.col("left.n").alias("n"), F.col("right.m").alias("m"), "same_count")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'UNIT_MISSING' ELSE 'TEXT_CHANGED' END AS problem FROM documents WHERE length(text) >= 6 AND (doc_id % 5 = 0 OR (doc_id % 7 = 0 AND text[2:4] <> 'xxx'))""")
def stale_candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.length("text") >= 6)
    original = F.when(F.col("doc_id") % 7 == 0, "xxx").otherwise(F.substring("text", 2, 3))
    cands = d.select("doc_id", F.lit(1).alias("start"), F.lit(4).alias("end"), original.alias("original"))
    return K.stale_candidates(cands, d.filter("doc_id % 5 <> 0").select("doc_id", "text"), ["doc_id"]).select("doc_id", "problem")


@query("""SELECT o_orderkey AS cell, CASE WHEN o_custkey % 2 = 0 THEN o_custkey::DOUBLE END AS x0 FROM orders""")
def located_findings(spark, sf_dir):
    o = orders(spark, sf_dir)
    f = o.select(F.lit("f").alias("file_id"), F.lit("ページ1").alias("sheet"), F.col("id").alias("cell"), F.col("c").cast("string").alias("original"))
    x = F.col("c").cast("double")
    places = o.filter("c % 2 = 0").select(F.lit("f").alias("file_id"), F.lit("ページ1").alias("sheet"), F.col("id").alias("cell"), F.col("c").cast("string").alias("original"), x.alias("x0"), x.alias("y0"), x.alias("x1"), x.alias("y1"))
    return K.located(f, places).select("cell", "x0")


@query("""SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 1 ELSE 0 END::INTEGER AS start, CASE o_custkey % 2 WHEN 0 THEN '佐藤様' ELSE '田中さん' END AS value, CASE o_custkey % 2 WHEN 0 THEN '個人002' ELSE '個人001' END AS alias
  FROM orders WHERE o_orderkey >= 100 AND o_custkey % 3 < 2""")
def surname_mentions(spark, sf_dir):
    """Family names met on page 100 are found with an honorific on later pages, not on earlier ones and not alone."""
    o = orders(spark, sf_dir)
    name = F.when(F.col("c") % 2 == 0, "佐藤").otherwise("田中")
    tail = F.when(F.col("c") % 2 == 0, "様").otherwise("さん")
    text = F.when(F.col("c") % 3 == 0, F.concat(F.lit("の"), name, tail, F.lit("へ"))).when(F.col("c") % 3 == 1, F.concat(name, tail)).otherwise(name)
    spans = o.select((F.col("id") % 17).cast("string").alias("file_id"), "id", F.col("id").alias("ord"), text.alias("text"))
    names = spark.createDataFrame([("田中", "個人001"), ("佐藤", "個人002"), ("藤", "個人003")], "surname string, alias string")
    names = spans.select("file_id").distinct().crossJoin(F.broadcast(names)).withColumn("ord", F.lit(99))
    return K.surname_mentions(spans, names, ["file_id", "id"]).select("id", "start", "value", "alias")


@query("""WITH f AS (SELECT o_custkey % 50 AS file, o_orderkey AS page, 'Corp' || (o_custkey % 50) || 'x' AS literal FROM orders WHERE o_orderkey % 3 = 0)
  SELECT DISTINCT o_custkey % 50 AS file, o_orderkey AS page, literal FROM orders JOIN (SELECT DISTINCT file, literal FROM f) g ON g.file = o_custkey % 50 WHERE o_orderkey % 3 = 1""")
def propagated_literals(spark, sf_dir):
    """A company found on every third page of a file stands on the next one too, and not on the one after."""
    o = orders(spark, sf_dir)
    lit = F.concat(F.lit("Corp"), (F.col("c") % 50).cast("string"), F.lit("x"))
    texts = o.select((F.col("c") % 50).alias("file_id"), F.col("id").alias("page"), F.when(F.col("id") % 3 < 2, F.concat(F.lit("to "), lit, F.lit("!"))).otherwise("nothing").alias("text"))
    found = o.filter("id % 3 = 0").select((F.col("c") % 50).alias("file_id"), F.col("id").alias("page"), lit.alias("original"), F.lit("会社名").alias("category"), F.lit("法人001").alias("replacement"), F.col("id").alias("ord"))
    return K.propagate(found, texts).select(F.col("file_id").alias("file"), "page", "literal")


@query("""SELECT o_custkey % 40 AS file_id, count(*) FILTER (WHERE o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0) AS formulas_kept, count(*) FILTER (WHERE o_orderkey % 8 = 0) AS formulas_changed,
  count(*) FILTER (WHERE o_orderkey % 4 = 1 AND o_orderkey % 5 = 0) AS numbers_changed, count(*) FILTER (WHERE o_orderkey % 4 = 2 AND o_orderkey % 7 = 0) AS dates_changed FROM orders GROUP BY 1""")
def workbook_checks(spark, sf_dir):
    """Every fourth cell is a formula, the next a number, then a date, then text; some come out changed."""
    o = orders(spark, sf_dir)
    i = F.col("id")
    kind = pick(("number", "number", "date", "string"), i)
    src = o.select((F.col("c") % 40).alias("file_id"), "id", i.cast("string").alias("value"), kind.alias("value_type"), F.when(i % 4 == 0, F.concat(F.lit("=A"), i.cast("string"))).alias("formula"))
    lost = ((i % 4 == 1) & (i % 5 == 0)) | ((i % 4 == 2) & (i % 7 == 0))
    out = src.withColumn("value_type", F.when(lost, "string").otherwise(F.col("value_type"))).withColumn("formula", F.when(i % 8 == 0, F.lit(None)).otherwise(F.col("formula")))
    return K.workbook_check(src, out, ["file_id", "id"])


@query("""SELECT o_orderkey AS file_id, CASE o_custkey % 4 WHEN 0 THEN 'removed' WHEN 1 THEN 'rows,tables' WHEN 2 THEN 'added' END AS problems FROM orders WHERE o_custkey % 4 < 3""")
def shape_checks(spark, sf_dir):
    o = orders(spark, sf_dir)
    m = F.col("c") % 4
    src = o.filter(m != 2).select(F.col("id").alias("file_id"), F.lit("s").alias("sheet"), "c", F.lit(5).alias("rows"), F.lit(3).alias("cols"), F.lit(1).alias("tables"), F.lit(None).cast("int").alias("formats"), F.lit(0).alias("validations"))
    out = o.filter(m != 0).select(F.col("id").alias("file_id"), F.lit("s").alias("sheet"), F.when(m == 1, 6).otherwise(5).alias("rows"), F.lit(3).alias("cols"), F.when(m == 1, 0).otherwise(1).alias("tables"), F.lit(0).alias("formats"), F.lit(0).alias("validations"))
    return K.shape_check(src.drop("c"), out).select("file_id", F.array_join("problems", ",").alias("problems"))


@query("""SELECT o_orderkey AS finding_id FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 2 = 0 OR o_custkey % 3 = 2 AND o_orderkey % 2 = 0""")
def residuals_in_rects(spark, sf_dir):
    """What stands within a finding's own rectangle counts, or on its page where it has none; not the kept one beside it."""
    o = orders(spark, sf_dir)
    i, m = F.col("id"), F.col("c") % 3
    f = o.select(F.lit("f").alias("file_id"), i.alias("page"), i.alias("finding_id"), F.lit("LCS Co").alias("original"), (i % 2 == 0).alias("enabled"),
                 F.when(m < 2, 10.0).alias("x0"), F.when(m < 2, 10.0).alias("y0"), F.when(m < 2, 60.0).alias("x1"), F.when(m < 2, 20.0).alias("y1"))
    at = F.when(m == 0, 11.0).otherwise(200.0)
    w = o.select(i.alias("page"), at.alias("at"), F.posexplode(F.array(F.lit("LCS"), F.lit("Co"))).alias("word_no", "text"))
    x = F.col("at") + F.col("word_no") * 25
    words = w.select(F.lit("f").alias("file_id"), "page", x.alias("x0"), F.lit(10.0).alias("y0"), (x + 20).alias("x1"), F.lit(20.0).alias("y1"), "text", F.lit(0).alias("block"), F.lit(0).alias("line"), "word_no")
    return K.residual_in_rects(f, words).select("finding_id")


@query("""SELECT o_orderkey AS file_id, CASE WHEN o_custkey % 2 = 0 THEN 'keep' ELSE 'delete' END AS outside, CASE WHEN o_custkey % 2 = 0 THEN 'keep' ELSE 'warn' END AS inside,
  o_custkey % 2 + o_custkey % 2 AS left_over, o_custkey % 3 = 0 AS title_removed FROM orders""")
def released_outputs(spark, sf_dir):
    """Outputs with values left in them are deleted for outside use and warned of inside; titles are emptied."""
    o = orders(spark, sf_dir).withColumnRenamed("id", "file_id")
    left = o.filter("c % 2 = 1").select("file_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("x"))
    meta = o.select("file_id", F.explode(F.array(F.struct(F.lit("format").alias("name"), F.lit("PDF").alias("value")), F.struct(F.lit("title").alias("name"), F.when(F.col("c") % 3 == 0, "t").otherwise("").alias("value")))).alias("m")).select("file_id", "m.*")
    title = K.sanitised(meta).filter("name = 'title' AND value = ''").select("file_id", F.col("removed").alias("title_removed"))
    out, inn = K.release_outputs(o.select("file_id"), left, True), K.release_outputs(o.select("file_id"), left, False)
    return out.select("file_id", "left_over", F.col("action").alias("outside")).join(inn.select("file_id", F.col("action").alias("inside")), "file_id").join(title, "file_id")


_M = """SELECT o_custkey AS run, count(*) AS truths, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS matched, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS false_positive,
  avg(CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS recall, avg((o_orderkey % 10) / 10.0)::DOUBLE AS average_coverage FROM orders GROUP BY 1"""


def _metrics(spark, sf_dir, odd: int = 0):
    i = F.col("id") + odd
    return orders(spark, sf_dir).groupBy(F.col("c").alias("run")).agg(
        F.count("*").alias("truths"), F.count_if(i % 2 == 0).alias("matched"), F.count_if(i % 3 == 0).alias("false_positive"), F.avg(F.when(i % 2 == 0, 1.0).otherwise(0.0)).alias("recall"),
        F.avg((i % 10) / 10.0).alias("average_coverage"),
    )


@query(f"""WITH m AS ({_M}) SELECT run, 'truths' AS "check", run % 2 = 0 OR truths - matched = 0 AS ok FROM m UNION ALL SELECT run, 'candidates', TRUE FROM m UNION ALL SELECT run, 'recall', TRUE FROM m
  UNION ALL SELECT run, 'candidate_precision', run % 5 <> 0 FROM m""")
def metric_integrity(spark, sf_dir):
    """Every other run has lost its missed truths, every fifth one has no precision."""
    m = _metrics(spark, sf_dir)
    missed = F.when(F.col("run") % 2 == 0, F.col("truths") - F.col("matched")).otherwise(0)
    return K.metric_integrity(m.withColumns({"missed": missed, "true_positive": F.col("matched"), "candidates": F.col("matched") + F.col("false_positive"), "candidate_precision": F.when(F.col("run") % 5 != 0, 0.5)}))


@query(f"""WITH b AS ({_M}), a AS ({_M.replace('o_orderkey', '(o_orderkey + 1)')})
  SELECT run, a.matched >= b.matched AND a.false_positive <= b.false_positive AND a.recall >= b.recall AND a.average_coverage >= b.average_coverage - 0.01 AS accepted, a.matched::DOUBLE - b.matched AS difference, a.matched <> b.matched AS changed
  FROM a JOIN b USING (run)""")
def accepted_runs(spark, sf_dir):
    """A later run against the one before: accepted or not, the difference in matches, and whether they are reproduced."""
    before, after = (_metrics(spark, sf_dir, odd).withColumn("candidate_precision", F.col("recall")) for odd in (0, 1))
    diff = K.compare_runs(before, after, ["run"], ["matched"]).select("run", "difference")
    changed = K.not_reproduced(before, after, ["run"], ["matched"]).select("run", F.lit(True).alias("changed"))
    out = K.accepted(before, after, ["run"]).join(diff, "run").join(changed, "run", "left")
    return out.select("run", "accepted", "difference", F.coalesce("changed", F.lit(False)).alias("changed"))


@query("""SELECT o_orderkey AS truth_id, o_custkey AS page, list_extract(['確認待ち', '座標要修正', '対象外', '確認済み', '不明'], CAST(o_orderkey % 5 AS INT) + 1) AS status FROM orders WHERE o_orderkey % 5 <> 3
  ORDER BY CASE o_orderkey % 5 WHEN 4 THEN 99 ELSE o_orderkey % 5 END, o_custkey, o_orderkey LIMIT 50""")
def review_queue(spark, sf_dir):
    """The first fifty to look at."""
    o = orders(spark, sf_dir)
    records = o.select(F.col("id").alias("truth_id"), F.col("c").alias("page"), pick(("確認待ち", "座標要修正", "対象外", "確認済み", "不明"), F.col("id")).alias("status"))
    return K.review_queue(records, first=50)


@query("""SELECT page, condition FROM (SELECT o_custkey AS page, o_orderkey AS condition, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 DESC, o_orderkey % 7 DESC, o_orderkey % 5, o_orderkey) AS n FROM orders) WHERE n = 1""")
def best_conditions(spark, sf_dir):
    i = F.col("id")
    c = orders(spark, sf_dir).select(F.col("c").alias("page"), i.alias("condition"), (i % 3).alias("exact_hits"), (i % 7).alias("correct_chars"), (i % 5).alias("false_positives"), i.cast("double").alias("seconds"))
    return K.best_condition(c, ["page"])


@query("""SELECT o_orderkey AS page, CASE o_custkey % 6 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'VERIFICATION_FAILED' WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'FAILED_UNRESOLVED' ELSE 'UNREVIEWED' END
  WHEN 4 THEN 'REVIEWED_WITH_REDACTIONS' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'FAILED_UNRESOLVED' ELSE 'UNREVIEWED' END END AS state FROM orders""")
def page_states(spark, sf_dir):
    """Pages after none to three events; a page nobody looked at cannot be completed."""
    o = orders(spark, sf_dir)
    m = F.col("c") % 6
    steps = F.when(m == 0, "no_sensitive_data,written").when(m == 1, "redacted,written").when(m == 2, "redacted,verification_failed,written").when(m == 3, "written").when(m == 4, "no_sensitive_data,redacted").otherwise("")
    events = o.select(F.col("id").alias("page"), F.posexplode(F.split(steps, ",")).alias("seq", "event")).filter("event <> ''").withColumn("seq", F.col("seq").cast("long"))
    pages = o.select(F.col("id").alias("page"), F.when(F.col("id") % 2 == 0, "FAILED").otherwise("PASS").alias("quality"))
    return K.page_states(pages, events, ["page"]).select("page", "state")


@query("""SELECT o_orderkey * 10 AS finding_id, '氏名' AS category, 0.0::DOUBLE AS x0, CASE WHEN o_custkey % 2 = 0 THEN 30.0 ELSE 10.0 END::DOUBLE AS x1, TRUE AS enabled FROM orders
  UNION ALL SELECT o_orderkey * 10 + 1, CASE WHEN o_custkey % 3 = 0 THEN '住所' ELSE '会社名' END, 20.0, 30.0, o_custkey % 2 <> 0 FROM orders
  UNION ALL SELECT o_orderkey * 10 + 2, '手動追加', 50.0, 60.0, TRUE FROM orders WHERE o_custkey % 5 <> 0""")
def manual_edits(spark, sf_dir):
    """A manual finding is added and, every fifth time, deleted; another is renamed twice, and merged into the first."""
    o = orders(spark, sf_dir)
    b = F.col("id") * 10
    row = lambda i, cat, x: F.struct((b + i).alias("finding_id"), F.lit(cat).alias("category"), F.lit("r").alias("replacement"), F.lit(x).alias("x0"), F.lit(0.0).alias("y0"), F.lit(x + 10).alias("x1"), F.lit(10.0).alias("y1"), F.lit(True).alias("enabled"), F.lit(False).alias("manual"))
    found = o.select(F.explode(F.array(row(0, "氏名", 0.0), row(1, "会社名", 20.0))).alias("r")).select("r.*")
    none = F.lit(None).cast("double")

    def edit(seq, action, at, into=None, cat=None, x=None):
        box = [F.lit(v).cast("double").alias(n) if x is not None else none.alias(n) for n, v in (("x0", x), ("y0", 0.0), ("x1", (x or 0) + 10), ("y1", 10.0))]
        return F.struct(F.lit(seq).alias("seq"), F.lit(action).alias("action"), (b + at).alias("finding_id"), (F.lit(None).cast("long") if into is None else b + into).alias("into"), F.lit(cat).cast("string").alias("category"), F.lit(None).cast("string").alias("replacement"), *box)

    c = F.col("c")
    edits = F.array(edit(1, "add", 2, x=50.0), F.when(c % 5 == 0, edit(2, "delete", 2)), F.when(c % 5 == 0, edit(3, "delete", 0)), F.when(c % 3 == 0, edit(4, "edit", 1, cat="電話番号")), F.when(c % 3 == 0, edit(5, "edit", 1, cat="住所")), F.when(c % 2 == 0, edit(6, "merge", 1, into=0)))
    edits = o.select(F.explode(F.filter(edits, lambda x: x.isNotNull())).alias("e")).select("e.*")
    return K.apply_manual_edits(found, edits).select("finding_id", "category", "x0", "x1", "enabled")


@query("""SELECT o_orderkey AS id, round(greatest(least(100.0, 60 + o_custkey % 50) - (o_custkey % 90), 0) * 300 / 72, 6) AS width_px,
  CASE WHEN least(100.0, 60 + o_custkey % 50) - (o_custkey % 90) <= 0 THEN 'EMPTY' WHEN (least(100.0, 60 + o_custkey % 50) - (o_custkey % 90)) * 300 / 72 < 30 THEN 'TOO_SMALL' ELSE '' END AS warning FROM orders""")
def rect_pixels(spark, sf_dir):
    c = F.col("c")
    r = orders(spark, sf_dir).select("id", (c % 90).cast("double").alias("x0"), F.lit(-5.0).alias("y0"), (60 + c % 50).cast("double").alias("x1"), F.lit(500.0).alias("y1"), F.lit(100.0).alias("page_width"), F.lit(200.0).alias("page_height"))
    return K.rect_pixels(r, least=30).select("id", F.round("width_px", 6).alias("width_px"), "warning")


@query("""SELECT 3 - o_custkey % 3 AS page, o_orderkey AS word_no, (o_orderkey % 100) * 2.0::DOUBLE AS x0 FROM orders WHERE o_custkey % 3 < 2""")
def derived_pages(spark, sf_dir):
    """Two of three pages, the other way round and twice as large."""
    i, x = F.col("id"), (F.col("id") % 100).cast("double")
    words = orders(spark, sf_dir).select((F.col("c") % 3).alias("page"), i.alias("word_no"), x.alias("x0"), x.alias("y0"), x.alias("x1"), x.alias("y1"))
    order = spark.createDataFrame([(0, 3), (1, 2)], "page long, new_page long")
    return K.derived_pages(words, order, 2.0).select("page", "word_no", "x0")
