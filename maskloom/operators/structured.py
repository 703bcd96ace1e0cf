"""Tables with header rows: column kinds from headers, default decisions, dictionaries from structured columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_missing, normalize

# Column kinds with their label, headers, and whether a header may contain the word.
COLUMN_RULES = (
    ("顧客ID", "customer_id", ("顧客ID",), False), ("受付番号", "ticket_id", ("受付番号",), False), ("案件ID", "project_id", ("案件ID",), False),
    ("緊急連絡先氏名", "emergency_name", ("緊急連絡先氏名",), False), ("緊急連絡先電話", "emergency_phone", ("緊急連絡先電話",), False),
    ("氏名", "name", ("氏名", "氏名カナ", "名前", "お名前", "顧客名", "患者名", "社員名", "担当者", "緊急連絡先氏名", "名義"), False),
    ("住所", "address", ("住所", "所在地", "居所", "都道府県", "市区町村", "町名", "地番", "宛先"), False),
    ("会社名", "company", ("会社名", "顧客企業"), False), ("仕入先", "supplier", ("仕入先",), False), ("案件名", "project", ("案件名",), False),
    ("部署", "department", ("部署", "所属"), False), ("役職", "role", ("役職",), False), ("郵便番号", "postal_code", ("郵便番号",), False),
    ("固定電話", "landline_phone", ("固定電話",), False), ("携帯電話", "mobile_phone", ("携帯電話", "携帯"), False),
    ("電話番号", "phone", ("電話番号", "固定電話", "携帯電話", "電話"), True), ("メールアドレス", "email", ("メールアドレス", "メール"), False),
    ("会員番号", "member_id", ("会員番号",), False), ("社員番号", "employee_id", ("社員番号",), False),
    ("個人番号", "personal_number", ("個人番号", "マイナンバー"), True), ("銀行口座", "bank_account", ("銀行口座", "口座情報", "口座番号"), False),
    ("IPアドレス", "ip", ("サーバーIP", "IPアドレス"), False), ("APIキー", "secret", ("APIキー", "APIキー・トークン", "トークン"), True),
    ("見積金額", "estimate_amount", ("見積金額",), False), ("原価見込", "cost_amount", ("原価見込", "原価"), False),
    ("受付日時", "reception_datetime", ("受付日時",), False), ("基本給", "salary_50k", ("基本給",), False), ("賞与見込", "bonus_100k", ("賞与見込",), False),
    ("粗利率", "rate_10", ("粗利率",), False), ("生年月日", "birth_date", ("生年月日",), False), ("入社日", "hire_date", ("入社日",), False),
    ("評価ランク", "rating", ("評価ランク",), False), ("扶養家族数", "dependents", ("扶養家族数",), False),
    ("要配慮情報", "care_info", ("健康・配慮情報", "要配慮", "配慮情報"), False), ("社外秘メモ", "secret_memo", ("社外秘メモ",), False),
    ("社内限定メモ", "boss_memo", ("上司メモ",), False), ("組織名", "organization", ("組織名", "拠点名", "工場"), False),
)
HEADER_EXCLUDE = ("仕様", "説明", "期待", "結果", "備考", "担当者メモ")
HEADER_MARKS = ("。", "、", "，", ",", "→", "です", "ます")
SKIPPED_SHEETS = ("テスト仕様", "期待処理ルール")
IGNORED_HEADERS = ("想定", "期待", "注意点", "出力例", "推奨")
PRESERVED_KINDS = (
    "estimate_amount", "cost_amount", "salary_50k", "bonus_100k", "rate_10", "birth_date", "hire_date", "rating", "dependents",
    "reception_datetime", "schedule", "secret_memo", "boss_memo",
)


def column_rules(spark: SparkSession) -> DataFrame:
    """The fixed, short dimension table of column kinds."""
    rows = [(i, label, kind, list(headers), contains) for i, (label, kind, headers, contains) in enumerate(COLUMN_RULES)]
    return spark.createDataFrame(rows, "rule_ord int, label string, kind string, headers array<string>, contains boolean")


def _any(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def is_likely_header(header: Column) -> Column:
    return (header != "") & (F.length(header) <= 24) & ~_any(header, HEADER_EXCLUDE) & ~_any(header, HEADER_MARKS)


def is_ignored_header(header: Column) -> Column:
    return _any(header, IGNORED_HEADERS)


def scanned_sheets(cells: DataFrame) -> DataFrame:
    return cells.filter(~_any(F.col("sheet"), SKIPPED_SHEETS))


def infer_kinds(headers: DataFrame, key: list[str], header: str = "header") -> DataFrame:
    """(key, header, label, kind): exact headers before contained words, the first rule of each."""
    rules = F.broadcast(column_rules(headers.sparkSession))
    h = F.col(header)
    exact = F.array_contains("headers", h)
    inner = F.col("contains") & F.exists("headers", lambda x: h.contains(x))
    found = headers.filter(is_likely_header(h)).join(rules, exact | inner)
    rank = Window.partitionBy(*key).orderBy(F.when(exact, 0).otherwise(1), "rule_ord")
    return found.withColumn("__n", F.row_number().over(rank)).filter("__n = 1").select(*key, header, "label", "kind")


def column_types(cells: DataFrame, header_rows: int = 1) -> DataFrame:
    """(file_id, sheet, col, kind, label) from the header rows of each sheet, ignored columns left out."""
    heads = cells.filter((F.col("row") <= header_rows) & F.col("value").isNotNull()).select("file_id", "sheet", "col", normalize(F.col("value")).alias("header"))
    heads = heads.filter(~is_ignored_header(F.col("header")))
    return infer_kinds(heads, ["file_id", "sheet", "col"])


def typed_cells(cells: DataFrame, header_rows: int = 1) -> DataFrame:
    """Body cells with the kind of their column; the column table is a few rows a sheet."""
    kinds = column_types(cells, header_rows)
    body = scanned_sheets(cells).filter((F.col("row") > header_rows) & F.col("value").isNotNull() & ~is_missing(F.col("value")))
    return body.join(kinds, ["file_id", "sheet", "col"], "left")


def category_cells(cells: DataFrame, category_col: int, input_col: int) -> DataFrame:
    """Rows whose kind is data: the input cell with the category of its row and hints from the next three columns."""
    at = lambda c, name: cells.filter(F.col("col") == c).select("file_id", "sheet", "row", F.col("value").alias(name))
    hints = cells.filter(F.col("col").between(input_col + 1, input_col + 3)).groupBy("file_id", "sheet", "row").agg(F.min_by("value", "col").alias("hint"))
    return at(input_col, "value").join(at(category_col, "category"), ["file_id", "sheet", "row"]).join(hints, ["file_id", "sheet", "row"], "left")


def default_enabled(kind: Column, detection: Column, is_formula: Column, base: Column, analysis: bool) -> Column:
    """Whether a finding starts enabled: never on formulas or preserved kinds in analysis, never for model findings."""
    on = base & (detection != "nlp")
    return on & ~(kind.isin(*PRESERVED_KINDS) | is_formula) if analysis else on


def literals(cells: DataFrame) -> DataFrame:
    """(file_id, literal, kind, ord): dictionary of values in structured columns, the first place of each."""
    named = typed_cells(cells).filter(F.col("kind").isin("name", "company", "email", "phone", "supplier", "organization"))
    ord_ = F.struct("sheet", "row", "col")
    return named.groupBy("file_id", F.col("value").alias("literal"), "kind").agg(F.min(ord_).alias("ord"))
