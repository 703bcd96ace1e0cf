"""Queries that detect, mask and locate: texts, addresses of layouts, page quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import class_counts
from ..operators import spatial as S
from ..operators.detect import detect, kind_of, label_of, match_offsets
from ..operators.profiles import detect_in_pages, detect_in_paragraphs, span_rects
from ..operators.rules import PROFILES, Rule
from .flagship import mask_texts
from .tables import inline, table, values_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ASCII_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+[.][A-Za-z]{2,}"
ASCII_IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"

PLAIN = (Rule("JP_EMAIL", ASCII_EMAIL, 0.94, flags="", needs="@"), Rule("JP_IP_ADDRESS", ASCII_IPV4, 0.90, flags="", needs=r"\d\.\d"))


def _spans_sql(pattern: str, source: str, key: str, text: str) -> str:
    return f"""WITH m AS (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS m, regexp_split_to_array({text}, '{pattern}') AS s FROM {source}),
      i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)
      SELECT {key}, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start, m[i] AS value FROM i"""


def _located(spark, sf_dir, name, key, text, rule):
    found = table(spark, sf_dir, name).filter(F.col(text).rlike(rule.needs))
    return found.select(key, F.explode(match_offsets(F.col(text), rule.pattern)).alias("x")).select(key, F.col("x.start").cast("int").alias("start"), F.col("x.text").alias("value"))


@query(_spans_sql(ASCII_EMAIL, "documents", "doc_id", "text"))
def detect_email_spans(spark, sf_dir):
    return _located(spark, sf_dir, "documents", "doc_id", "text", PLAIN[0])


@query(_spans_sql(ASCII_IPV4, "documents", "doc_id", "text"))
def detect_ip_spans(spark, sf_dir):
    return _located(spark, sf_dir, "documents", "doc_id", "text", PLAIN[1])


@query(_spans_sql(ASCII_EMAIL, "pages", "page_id", "html"))
def detect_email_spans_in_pages(spark, sf_dir):
    return _located(spark, sf_dir, "pages", "page_id", "html", PLAIN[0])


@query(f"""SELECT lang, category, count(*) AS n FROM (SELECT lang, 'JP_EMAIL' AS category, unnest(regexp_extract_all(text, '{ASCII_EMAIL}')) FROM documents
  UNION ALL SELECT lang, 'JP_IP_ADDRESS', unnest(regexp_extract_all(text, '{ASCII_IPV4}')) FROM documents) GROUP BY 1, 2""")
def span_counts(spark, sf_dir):
    d = detect(table(spark, sf_dir, "documents"), PLAIN)
    return d.select("lang", F.explode("spans.category").alias("category")).groupBy("lang", "category").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(text, '{ASCII_EMAIL}', '<JP_EMAIL>', 'g'), '{ASCII_IPV4}', '<JP_IP_ADDRESS>', 'g') AS masked FROM documents""")
def redact_documents(spark, sf_dir):
    """Spans replaced by their category, in one pass over each text."""
    from ..operators.resolve import apply_edits

    d = detect(table(spark, sf_dir, "documents"), PLAIN)
    edits = F.transform("spans", lambda x: F.struct(x["start"], x["end"], F.concat(F.lit("<"), x["category"], F.lit(">")).alias("replacement")))
    return d.select("doc_id", apply_edits(F.col("text"), edits).alias("masked"))


@query()
def mask_documents(spark, sf_dir):
    """The flagship: detect, resolve, pseudonymise and mask."""
    return mask_texts(table(spark, sf_dir, "documents"))


_JAPANESE = [
    (1, "氏名：山田 太郎様 住所：東京都港区芝公園1-2-3に資料を送付。電話 090-1234-5678"),
    (2, "担当は佐藤です。口座番号は1234567、パスワードはabc123。"),
    (3, "鈴木さんへ 2月3日10時に大阪工場で打合せ。"),
    (4, None),
    (5, "  "),
    (6, "〒100-0001 番号123412341234 tok_abcdef12"),
]
_FOUND = [
    (1, "氏名", 0, 8), (1, "住所", 13, 26), (1, "電話番号", 36, 49), (2, "氏名", 3, 5), (2, "銀行口座", 13, 20), (2, "パスワード", 27, 33),
    (3, "氏名", 0, 2), (3, "予定日時", 6, 13), (6, "郵便番号", 0, 9), (6, "個人番号", 12, 24), (6, "APIキー", 25, 37),
]


@query()
def japanese_spans(spark, sf_dir):
    d = detect(inline(spark, _JAPANESE, "id int, text string"), PROFILES["japanese"])
    x = F.col("x")
    return d.select("id", F.explode("spans").alias("x")).select("id", label_of(x["category"]).alias("label"), kind_of(x["category"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("value"))


_URLS = [(1, "https://x.example/?name=anne&x=1"), (2, "mailto:bob@example.com"), (3, "https://x.example/"), (4, "https://x.example/?q=1&user=eve#a")]


@query("SELECT id, category, value, CAST(score AS DOUBLE) AS score FROM " + values_sql([(1, "JP_NAME", "anne", 0.45), (2, "JP_EMAIL", "bob@example.com", 0.92), (4, "JP_NAME", "eve", 0.45)], "id, category, value, score"))
def url_candidates(spark, sf_dir):
    d = detect(inline(spark, _URLS, "id int, url string"), PROFILES["url"], "url", trim=False)
    return d.select("id", F.explode("spans").alias("x")).select("id", "x.category", F.col("x.text").alias("value"), "x.score")


@query("""SELECT lang, sum(length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')))::BIGINT AS alnum, sum(length(regexp_replace(text, '[^ぁ-んァ-ヶ一-龯]', '', 'g')))::BIGINT AS japanese FROM documents GROUP BY 1""")
def character_classes(spark, sf_dir):
    n = class_counts(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(n["alnum"]).cast("long").alias("alnum"), F.sum(n["japanese"]).cast("long").alias("japanese"))


@query(r"""WITH p AS (SELECT doc_id, regexp_replace(text, '\s', '', 'g') AS t, doc_id % 100 / 100000.0 AS area_ratio, doc_id % 3 / 1000.0 AS dark_ratio FROM documents),
  c AS (SELECT *, length(t) AS chars FROM p)
  SELECT doc_id, chars, concat_ws(';', CASE WHEN chars < 40 THEN 'few_chars' END, CASE WHEN area_ratio < 0.0005 THEN 'small_area' END) AS reasons,
    CASE WHEN chars < 10 AND dark_ratio >= 0.001 THEN 'FAILED' WHEN chars < 40 OR area_ratio < 0.0005 THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS verdict FROM c""")
def page_quality(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 100 / 100000.0).alias("area_ratio"), (F.col("doc_id") % 3 / 1000.0).alias("dark_ratio"))
    return S.page_quality(d).select("doc_id", "chars", "reasons", "verdict")


_WORDS = [
    ("f", 1, 10.0, 10.0, 40.0, 20.0, "代表者", 0, 0, 0), ("f", 1, 80.0, 10.0, 120.0, 20.0, "山田", 0, 1, 0), ("f", 1, 122.0, 11.0, 160.0, 20.0, "太郎", 0, 1, 1),
    ("f", 1, 10.0, 50.0, 40.0, 60.0, "住所", 1, 0, 0), ("f", 1, 12.0, 65.0, 90.0, 75.0, "東京都港区", 1, 1, 0), ("f", 1, 10.0, 90.0, 90.0, 99.0, "売上高", 2, 0, 0),
    ("f", 1, 95.0, 90.0, 150.0, 99.0, "営業利益", 2, 0, 1),
]
_WORD_SCHEMA = "file_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, block int, line int, word_no int"


@query("SELECT * FROM " + values_sql([("代表者", "氏名", "山田 太郎", "right"), ("住所", "住所", "東京都港区", "below")], "label, kind, text, place"))
def label_value_pairs(spark, sf_dir):
    lines = S.line_boxes(inline(spark, _WORDS, _WORD_SCHEMA))
    return S.label_values(lines).select("label", "kind", "text", "place")


@query("SELECT TRUE AS financial, FALSE AS explanatory, FALSE AS bank_guide")
def page_context(spark, sf_dir):
    return S.page_context(S.line_boxes(inline(spark, _WORDS, _WORD_SCHEMA))).select("financial", "explanatory", "bank_guide")


@query("SELECT * FROM " + values_sql([(1, 20), (2, 10)], "item_id, finding_id"))
def greedy_assignment(spark, sf_dir):
    schema = "file_id string, page int, kind string, {0} long, y0 double, y1 double"
    items = inline(spark, [("f", 1, "a", 1, 0.0, 10.0), ("f", 1, "a", 2, 2.0, 12.0)], schema.format("item_id"))
    found = inline(spark, [("f", 1, "a", 10, 6.0, 16.0), ("f", 1, "a", 20, 0.0, 11.0)], schema.format("finding_id"))
    return S.greedy_assignment(items, found)




_PARAGRAPHS = [
    (1, "取引先：北方商事株式会社です。担当者：田中一郎"), (2, "振込先は青空銀行です"), (3, "氏　名　：　山田 太郎"), (4, "第1条 委託業務"),
    (5, "株式会社みらい電機様"), (6, "委託先は西部研究所"), (7, None), (8, "会社名：会社"),
]


@query("SELECT * FROM " + values_sql([(1, "会社名", "北方商事株式会社"), (1, "氏名", "田中一郎"), (2, "銀行名", "青空銀行"), (3, "氏名", "山田 太郎"), (5, "会社名", "株式会社みらい電機"), (6, "会社名", "西部研究所")], "id, category, value"))
def paragraph_spans(spark, sf_dir):
    d = detect_in_paragraphs(inline(spark, _PARAGRAPHS, "id int, text string"))
    return d.select("id", F.explode("spans").alias("x")).select("id", "x.category", F.col("x.text").alias("value"))


_PAGE_WORDS = [
    ("f", 1, 0.0, 0.0, 20.0, 10.0, "電話:", 0, 0, 0), ("f", 1, 20.0, 0.0, 120.0, 10.0, "090-1111-2222", 0, 0, 1),
    ("f", 1, 0.0, 20.0, 40.0, 30.0, "氏名:山田", 0, 1, 0), ("f", 1, 0.0, 40.0, 100.0, 50.0, "住所a@b.example", 0, 2, 0),
]


@query("SELECT * FROM " + values_sql([("電話番号", "AUTO", "090-1111-2222"), ("氏名", "REVIEW_REQUIRED", "山田"), ("メールアドレス", "AUTO", "a@b.example")], "category, status, value"))
def page_spans(spark, sf_dir):
    found = detect_in_pages(S.ocr_lines(inline(spark, _PAGE_WORDS, _WORD_SCHEMA)))
    return found.select(F.explode("spans").alias("x")).select("x.category", "x.status", F.col("x.text").alias("value"))


@query("SELECT category, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM (SELECT '電話番号' AS category, 20.0::DOUBLE AS x0, 120.0::DOUBLE AS x1 UNION ALL SELECT '氏名', 24.0, 40.0 UNION ALL SELECT 'メールアドレス', 100.0 * 2 / 13, 100.0)")
def page_span_rectangles(spark, sf_dir):
    words = inline(spark, _PAGE_WORDS, _WORD_SCHEMA)
    r = span_rects(detect_in_pages(S.ocr_lines(words)), words)
    return r.select("category", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


_TABLE_WORDS = [
    ("f", 1, 10.0, 10.0, 40.0, 20.0, "氏名", 0, 0, 0), ("f", 1, 110.0, 10.0, 140.0, 20.0, "住所", 0, 0, 1), ("f", 1, 12.0, 30.0, 30.0, 40.0, "山田", 1, 0, 0),
    ("f", 1, 32.0, 30.0, 60.0, 40.0, "太郎", 1, 0, 1), ("f", 1, 100.0, 30.0, 180.0, 40.0, "大阪市北区", 1, 0, 2), ("f", 1, 12.0, 50.0, 40.0, 60.0, "12,300", 2, 0, 0),
    ("f", 1, 10.0, 100.0, 60.0, 110.0, "仕入先", 3, 0, 0), ("f", 1, 12.0, 120.0, 90.0, 130.0, "株式会社北方", 4, 0, 0), ("f", 1, 400.0, 120.0, 480.0, 130.0, "株式会社遠方", 5, 0, 0),
]


@query("SELECT * FROM " + values_sql([("氏名", "氏名", "山田 太郎"), ("住所", "住所", "大阪市北区"), ("氏名", "氏名", "株式会社北方"), ("住所", "住所", "株式会社遠方")], "header, kind, text"))
def table_column_values(spark, sf_dir):
    return S.table_columns(inline(spark, _TABLE_WORDS, _WORD_SCHEMA)).select("header", "kind", "text")


@query("SELECT * FROM " + values_sql([("仕入先", "株式会社北方")], "heading, text"))
def section_block_values(spark, sf_dir):
    return S.section_blocks(S.line_boxes(inline(spark, _TABLE_WORDS, _WORD_SCHEMA))).select("heading", "text")
