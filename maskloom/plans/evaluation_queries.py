"""Queries of detection quality, review states and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import review as R
from ..operators.structured import PRESERVED_KINDS, default_enabled
from ..operators.verify import same_rows, signature
from .tables import CANDIDATES, MATCHES, candidate_boxes, inline, table, truth_boxes, values_sql

QUERIES, ORACLES = {}, {}
KEYS = ["page", "kind"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _boxes(spark, sf_dir):
    t, c = truth_boxes(spark, sf_dir), candidate_boxes(spark, sf_dir)
    return t, c, E.rectangle_matches(t, c, KEYS)


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


def _metrics_sql(true: str) -> str:
    return f"""WITH {MATCHES}, tp AS (SELECT DISTINCT cand_id FROM {true}), n AS (
  SELECT (SELECT count(*) FROM truths) AS truths, (SELECT count(*) FROM cands) AS candidates, (SELECT count(*) FROM best) AS matched, (SELECT count(*) FROM tp) AS true_positives)
  SELECT truths, candidates, matched, truths - matched AS missed, true_positives, candidates - true_positives AS false_positives,
    round(matched / truths, 9) AS recall, round(true_positives / candidates, 9) AS precision, (SELECT round(avg(coverage), 9) FROM best) AS avg_coverage,
    (SELECT round(min(coverage), 9) FROM best) AS min_coverage, (SELECT round(max(excess_by_candidate), 9) FROM best) AS max_excess FROM n"""


@query(_metrics_sql("matches"))
def spatial_match_any(spark, sf_dir):
    t, c, m = _boxes(spark, sf_dir)
    return _rounded(E.match_metrics(t, c, m, best_only=False), "recall", "precision", "avg_coverage", "min_coverage", "max_excess")


@query(_metrics_sql("best"))
def spatial_match_best(spark, sf_dir):
    t, c, m = _boxes(spark, sf_dir)
    return _rounded(E.match_metrics(t, c, m, best_only=True), "recall", "precision", "avg_coverage", "min_coverage", "max_excess")


@query(f"WITH {MATCHES} SELECT truth_id, cand_id, round(excess_by_candidate, 9) AS excess_by_candidate, round(excess_by_truth, 9) AS excess_by_truth FROM best")
def excess_both_ways(spark, sf_dir):
    _, _, m = _boxes(spark, sf_dir)
    return _rounded(E.best_matches(m), "excess_by_candidate", "excess_by_truth").select("truth_id", "cand_id", "excess_by_candidate", "excess_by_truth")


@query(f"""WITH {MATCHES}, rules AS (SELECT DISTINCT rule FROM cands), kept AS (SELECT r.rule AS dropped, c.* FROM rules r JOIN cands c ON c.rule <> r.rule),
  hit AS (SELECT dropped, count(DISTINCT m.truth_id) AS matched, count(DISTINCT k.cand_id) AS tp FROM kept k JOIN matches m USING (cand_id) GROUP BY 1)
  SELECT dropped, matched, n - tp AS false_positives, n AS candidates, round(matched / (SELECT count(*) FROM truths), 9) AS recall
  FROM (SELECT dropped, count(*) AS n FROM kept GROUP BY 1) JOIN hit USING (dropped)""")
def rule_ablation(spark, sf_dir):
    t, c, m = _boxes(spark, sf_dir)
    return _rounded(E.rule_ablation(t, c, m, c.select("rule").distinct()), "recall")


def _summary_sql(by: str) -> str:
    return f"""WITH {MATCHES}, b AS (SELECT {by}, count(*) AS candidates, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.cand_id = c.cand_id)) AS false_positives FROM cands c GROUP BY 1),
  d AS (SELECT {by}, count(DISTINCT truth_id) AS detected FROM matches JOIN cands USING (cand_id) GROUP BY 1)
  SELECT {by}, candidates, false_positives, coalesce(detected, 0) AS detected, round((candidates - false_positives) / candidates, 9) AS precision,
    CASE WHEN false_positives > 0 AND coalesce(detected, 0) = 0 THEN '停止候補' WHEN false_positives > 3 * coalesce(detected, 0) THEN '縮小' ELSE '維持' END AS decision
  FROM b LEFT JOIN d USING ({by})"""


@query(_summary_sql("rule"))
def rule_summary(spark, sf_dir):
    _, c, m = _boxes(spark, sf_dir)
    return _rounded(E.rule_summary(c, m), "precision")


@query(_summary_sql("confidence"))
def confidence_summary(spark, sf_dir):
    _, c, m = _boxes(spark, sf_dir)
    return _rounded(E.rule_summary(c, m, "confidence"), "precision")


@query(f"""WITH c AS ({CANDIDATES}) SELECT DISTINCT a.cand_id FROM c a JOIN c b ON a.page = b.page AND a.kind = b.kind AND a.cand_id <> b.cand_id
  WHERE greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / 410.0 >= 0.8""")
def duplicate_across_rules(spark, sf_dir):
    return E.duplicates_across(candidate_boxes(spark, sf_dir), KEYS)


@query("""WITH t AS (SELECT DISTINCT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS category FROM labels),
  c AS (SELECT DISTINCT doc_id, CASE WHEN n_chars > 800 THEN 'good' ELSE 'poor' END AS category FROM documents WHERE doc_id % 3 <> 0),
  j AS (SELECT coalesce(t.category, c.category) AS category, t.doc_id IS NOT NULL AS a, c.doc_id IS NOT NULL AS b FROM t FULL JOIN c ON t.doc_id = c.doc_id AND t.category = c.category),
  n AS (SELECT category, count(*) FILTER (WHERE a) AS truths, count(*) FILTER (WHERE b) AS candidates, count(*) FILTER (WHERE a AND b) AS true_positives,
    count(*) FILTER (WHERE a AND NOT b) AS missed, count(*) FILTER (WHERE b AND NOT a) AS false_positives FROM j GROUP BY 1)
  SELECT *, round(true_positives / truths, 9) AS recall, round(true_positives / candidates, 9) AS precision FROM n""")
def truth_candidate_metrics(spark, sf_dir):
    t = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("category"))
    c = table(spark, sf_dir, "documents").filter("doc_id % 3 <> 0").select("doc_id", F.when(F.col("n_chars") > 800, "good").otherwise("poor").alias("category"))
    return _rounded(E.key_metrics(t, c, ["doc_id"], "category"), "recall", "precision")


@query("""WITH p AS (SELECT d.source AS file_id, d.doc_id AS page, CASE WHEN d.n_chars < 30 AND coalesce(l.quality, 0) = 0 THEN 'FAILED_UNRESOLVED'
    WHEN l.quality = 1 AND l.toxic = 1 THEN 'REVIEWED_WITH_REDACTIONS' WHEN l.quality = 1 THEN 'REVIEWED_NO_REDACTION' ELSE 'UNREVIEWED' END AS review_state FROM documents d LEFT JOIN labels l USING (doc_id)),
  c AS (SELECT file_id, count(*) AS pages, count(*) FILTER (WHERE review_state = 'UNREVIEWED') AS unreviewed, count(*) FILTER (WHERE review_state = 'FAILED_UNRESOLVED') AS failed FROM p GROUP BY 1)
  SELECT *, concat_ws(';', CASE WHEN unreviewed > 0 THEN 'unreviewed_pages' END, CASE WHEN failed > 0 THEN 'failed_pages' END) AS reasons, unreviewed = 0 AND failed = 0 AS ok FROM c""")
def final_output_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    state = R.page_state(F.when(F.col("n_chars") < 30, "FAILED").otherwise("PASS"), F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce("toxic", F.lit(0)))
    return R.output_gate(d.select(F.col("source").alias("file_id"), F.col("doc_id").alias("page"), state.alias("review_state")))


@query("""SELECT doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN '除外' WHEN quality = 1 AND doc_id % 5 = 0 THEN '手動追加' WHEN quality = 1 AND doc_id % 4 < 3 AND toxic = 1 THEN '承認済み'
  WHEN quality = 1 AND doc_id % 4 < 3 THEN '承認済み' WHEN quality = 1 THEN '自動採用' WHEN doc_id % 4 < 3 THEN '要確認' ELSE '無効' END AS status FROM labels""")
def status_derivation(spark, sf_dir):
    on, out = F.col("quality") == 1, (F.col("toxic") == 1) & (F.col("quality") == 0)
    review = R.requires_review((F.col("doc_id") % 4) * 0.25, F.lit("body"))
    return table(spark, sf_dir, "labels").select("doc_id", R.status(on, out, review, F.col("doc_id") % 5 == 0).alias("status"))


_CASES = [(i, k, d, f) for i, (k, d, f) in enumerate([("name", "column", False), ("name", "column", True), ("rating", "column", False), ("name", "nlp", False), ("birth_date", "pattern", False), ("email", "pattern", False)])]


@query("SELECT id, detection <> 'nlp' AND NOT (kind IN (" + ", ".join(f"'{k}'" for k in PRESERVED_KINDS) + ") OR is_formula) AS analysis, detection <> 'nlp' AS external FROM " + values_sql(_CASES, "id, kind, detection, is_formula"))
def default_enabled_cases(spark, sf_dir):
    c = inline(spark, _CASES, "id int, kind string, detection string, is_formula boolean")
    on = lambda analysis: default_enabled(F.col("kind"), F.col("detection"), F.col("is_formula"), F.lit(True), analysis)
    return c.select("id", on(True).alias("analysis"), on(False).alias("external"))


@query("""WITH s AS (SELECT doc_id, quality FROM labels WHERE doc_id % 2 = 0) SELECT d.doc_id, coalesce(s.quality = 1, d.n_chars > 100) AS enabled,
  CASE WHEN s.doc_id IS NULL THEN 'fresh' ELSE 'saved' END AS replacement FROM documents d LEFT JOIN s USING (doc_id)""")
def review_state_restore(spark, sf_dir):
    key = F.sha2(F.col("doc_id").cast("string"), 256).alias("state_id")
    fresh = table(spark, sf_dir, "documents").select("doc_id", key, (F.col("n_chars") > 100).alias("enabled"), F.lit("fresh").alias("replacement"))
    saved = table(spark, sf_dir, "labels").filter("doc_id % 2 = 0").select(key, (F.col("quality") == 1).alias("enabled"), F.lit("saved").alias("replacement"))
    return R.restore(fresh, saved).select("doc_id", "enabled", "replacement")


@query("""WITH p AS (SELECT source AS file_id, doc_id AS page, n_chars < 200 AS unresolved FROM documents)
  SELECT file_id, page, coalesce(min(CASE WHEN unresolved THEN page END) OVER (PARTITION BY file_id ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
    min(CASE WHEN unresolved THEN page END) OVER (PARTITION BY file_id)) AS next_page FROM p""")
def next_unresolved_page(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), F.col("doc_id").alias("page"), (F.col("n_chars") < 200).alias("unresolved"))
    return R.next_unresolved(p).select("file_id", "page", "next_page")


@query("""WITH e AS (SELECT user_id AS finding_id, max_by(event_type = 'click', event_id) AS approve FROM events GROUP BY 1)
  SELECT c_custkey AS finding_id, CASE WHEN c_nationkey = 3 THEN TRUE ELSE coalesce(e.approve, c_acctbal > 0) END AS enabled FROM customer LEFT JOIN e ON e.finding_id = c_custkey""")
def review_events(spark, sf_dir):
    f = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("finding_id"), (F.col("c_acctbal") > 0).alias("enabled"), F.lit(False).alias("excluded"), (F.col("c_nationkey") == 3).alias("manual"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("finding_id"), (F.col("event_type") == "click").alias("approve"), F.col("event_id").alias("seq"))
    return R.apply_events(f, e).select("finding_id", "enabled")


@query("""SELECT * FROM (VALUES ('unreviewed', (SELECT count(*) FROM labels WHERE doc_id % 4 < 3 AND quality = 0 AND toxic = 0 AND doc_id % 6 <> 0), TRUE), ('hyperlink', (SELECT count(*) FROM labels WHERE doc_id % 6 = 0 AND quality = 1), TRUE),
  ('unsupported', 10, TRUE), ('nothing_selected', (SELECT count(*) FROM labels WHERE quality = 1), FALSE)) AS t(gate, n, blocks)""")
def decision_gates(spark, sf_dir):
    on = F.col("quality") == 1
    d = table(spark, sf_dir, "labels").select(((F.col("doc_id") % 4) * 0.25).alias("score"), F.when(F.col("doc_id") % 6 == 0, "hyperlink").otherwise("body").alias("source"), on.alias("enabled"), (F.col("toxic") == 1).alias("excluded"))
    u = table(spark, sf_dir, "region").select(F.lit(2).alias("count"))
    return R.decision_gates(d, u, external=True)


@query("SELECT TRUE AS deterministic")
def determinism_check(spark, sf_dir):
    """The same matches twice, all of them: from the boxes as they come, and dealt anew and met by cells of another size.

    A rectangle that many boxes of a page and kind have stands for all of them, by the signature of their numbers, so
    the two runs have the same matches exactly if pairs of rectangles and signatures are the same.
    """
    t, c = truth_boxes(spark, sf_dir), candidate_boxes(spark, sf_dir)
    once = E.rectangle_matches(E.by_rectangle(t, KEYS, "truth_id"), E.by_rectangle(c, KEYS, "cand_id"), KEYS)
    t, c = t.repartition("truth_id"), c.repartition("cand_id")
    again = E.rectangle_matches(E.by_rectangle(t, KEYS, "truth_id"), E.by_rectangle(c, KEYS, "cand_id"), KEYS, cell=(32.0, 20.0))
    return spark.range(1).select(F.lit(same_rows(signature(once, KEYS), signature(again, KEYS))).alias("deterministic"))
