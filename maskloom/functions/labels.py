"""What a finding is called: statuses, reasons, locations, and small values parsed out of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nfkc

# Statuses, the texts added to reasons, guard messages with their tags, labels of places.
REVIEW_SUFFIXES = {
    "ハイパーリンク対象外": " / ハイパーリンクURLの置換は未対応のため対象外",
    "要確認・承認済み": " / 要確認候補を利用者が確認のうえ承認",
    "要確認(未処理)": " / 要確認候補が未承認のため対象外",
    "確認済み(除外)": " / 要確認候補を利用者が確認のうえ除外(原文を維持)",
    "維持(手動)": " / 利用者が対象を解除し原文を維持",
}
PDF_STATUSES = {
    "確認候補": "確認候補", "要確認": "確認候補", "利用者承認": "利用者承認", "利用者解除": "利用者解除", "自動確定": "自動確定", "手動追加": "手動追加",
}
GUARDS = (
    ("先に検査を実行してください。", "not_scanned"), ("ハイパーリンクURLの置換は未対応です。", "hyperlink_target_guard"),
    ("未確認候補が", "review_required_guard"), ("未対応領域が検出されたため外部共有用の出力を停止しました。", "unsupported_features_guard_external"),
    ("構造が変化しました。再スキャンしてください。", "integrity_guard"), ("検出候補の範囲が重複しています", "overlap_guard"),
    ("の検出候補の範囲が重複しています。", "overlap_guard_property"),
    ("内部XML残存検査で匿名化対象の原文が検出されたため外部共有用の出力を停止しました。", "residual_guard_external"),
)
LIGATURE_NOTE = "先頭または末尾の1文字はOCRが「㈱」等の合字を別の漢字に誤認識した可能性があります。原本で確認してください"
PRESERVE_REASONS = {
    "formula": " / 分析継続用のため数式セルは維持", "type": " / 分析継続用のため型と値を維持", "secret": " / 分析継続用のため企業機密項目を維持",
}
INCOMPLETE_DOMAINS = ("example.com", "example.jp", "example.net", "example.org")


def lookup(key: Column, values: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], otherwise)


def sheet_status(enabled: Column, excluded: Column, detection: Column) -> Column:
    """Of a cell's finding: set aside, to be looked at, found by a model, changed or kept."""
    return (
        F.when(excluded, "確認済み(除外)").when(detection == "確認候補", "確認候補").when(detection == "AI候補", "AI候補").when(enabled, "自動変換").otherwise("維持")
    )


def document_status(enabled: Column, excluded: Column, review: Column, source: Column | None = None) -> Column:
    """Of a paragraph's finding; with ``source`` links are set aside first (text documents, not slides)."""
    plain = (
        F.when(enabled & review, "要確認・承認済み").when(enabled, "自動変換").when(excluded, "確認済み(除外)").when(review, "要確認(未処理)").otherwise("維持(手動)")
    )
    return plain if source is None else F.when(source == "hyperlink_target", "ハイパーリンク対象外").otherwise(plain)


def page_status(detection: Column, enabled: Column) -> Column:
    return lookup(detection, PDF_STATUSES, F.when(enabled, "自動変換").otherwise("除外"))


def finding_reason(rule: Column, confidence: Column, status: Column) -> Column:
    return F.concat(F.format_string("%s(信頼度%.2f)", rule, confidence), lookup(status, REVIEW_SUFFIXES, F.lit("")))


def preserve_reason(kind: Column, is_formula: Column, preserved, secrets, analysis: bool, transform_secrets: bool = False) -> Column:
    """Why a cell keeps its value; empty where nothing keeps it."""
    if not analysis:
        return F.lit("")
    secret = kind.isin(*secrets) & F.lit(not transform_secrets)
    return F.when(is_formula, PRESERVE_REASONS["formula"]).when(kind.isin(*preserved), PRESERVE_REASONS["type"]).when(secret, PRESERVE_REASONS["secret"]).otherwise("")


def paragraph_location(u: dict[str, Column]) -> Column:
    """Of story, variant, section, container, table, row, cell, cell_para, para and property; counted from 1 in the text."""
    kind = F.coalesce(u["variant"], F.lit("default"))
    story = F.when(u["story"] == "body", "本文").when(u["story"] == "header", F.concat(F.lit("ヘッダー("), kind, F.lit(")")))
    story = story.when(u["story"] == "footer", F.concat(F.lit("フッター("), kind, F.lit(")"))).otherwise(u["story"])
    section = F.when(u["section"] > 0, F.concat(F.lit(" セクション"), (u["section"] + 1).cast("string"))).otherwise("")
    one = lambda c: (F.coalesce(c, F.lit(0)) + 1).cast("string")
    inner = F.when(u["cell_para"] > 0, F.concat(F.lit(" 段落"), (u["cell_para"] + 1).cast("string"))).otherwise("")
    cell = F.concat(story, section, F.lit(" 表"), one(u["table"]), F.lit(" 行"), one(u["row"]), F.lit("列"), one(u["cell"]), inner)
    para = F.concat(story, section, F.lit(" 段落"), (u["para"] + 1).cast("string"))
    return F.when(u["story"] == "document_property", property_location(u["property"])).when(u["container"] == "table_cell", cell).otherwise(para)


def property_location(name: Column) -> Column:
    return F.concat(F.lit("文書プロパティ("), F.coalesce(name, F.lit("")), F.lit(")"))


def slide_location(u: dict[str, Column]) -> Column:
    """Of property, slide, container, shape, shape_name, row, cell and para."""
    slide = F.concat(F.lit("スライド"), (u["slide"] + 1).cast("string"))
    para = F.concat(F.lit(" 段落"), (u["para"] + 1).cast("string"))
    one = lambda c: (F.coalesce(c, F.lit(0)) + 1).cast("string")
    return (
        F.when(u["property"].isNotNull(), property_location(u["property"]))
        .when(u["container"] == "notes", F.concat(slide, F.lit(" スピーカーノート"), para))
        .when(u["container"] == "table_cell", F.concat(slide, F.lit(" 表(図形"), u["shape"].cast("string"), F.lit(") 行"), one(u["row"]), F.lit("列"), one(u["cell"])))
        .otherwise(F.concat(slide, F.lit(" "), u["shape_name"], para))
    )


def is_unresolved(kind: Column, status: Column, detection: Column, enabled: Column, excluded: Column) -> Column:
    """By kind of file (docx, pptx, xlsx, pdf): whether a finding still has to be looked at."""
    sheet = detection.isin("確認候補", "AI候補") & ~enabled & ~excluded
    return F.when(kind.isin("docx", "pptx"), status == "要確認(未処理)").when(kind == "xlsx", sheet).when(kind == "pdf", detection.isin("要確認", "確認候補")).otherwise(False)


def is_formal_location(location: Column, stories=("body", "header", "footer")) -> Column:
    return F.substring_index(location, ":", 1).isin(*stories) & location.contains(":")


def is_formal_unit(story: Column, container: Column, stories=("body", "header", "footer")) -> Column:
    return story.isin(*stories) & container.isin("paragraph", "table_cell")


def is_cross_domain_sheet(sheet: Column) -> Column:
    return sheet.startswith("03_")


def address_strength(text: Column) -> Column:
    return text.rlike("[0-9０-９]|丁目|番地|番|号|〒")


def is_weak_address(text: Column) -> Column:
    """Without numbers or their words, or a phrase about addresses."""
    return ~address_strength(F.trim(text)) | text.rlike("制度|政策|説明|について")


def is_weak_slide_address(text: Column) -> Column:
    return ~text.rlike("[0-9０-９]|丁目|番地|号|〒") | text.rlike("制度|政策|説明|について")


def inside_identifier(text: Column, start: Column, end: Column) -> Column:
    """Whether a span touches an ASCII letter or digit, or its word holds an at sign."""
    before, after = F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.length(text))
    word = F.concat(F.regexp_extract(before, r"(?U)(\S*)$", 1), F.regexp_extract(after, r"(?U)^(\S*)", 1))
    inner = F.substring(text, start + 1, end - start)
    return before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]") | F.concat(word, inner).contains("@")


def surname(text: Column) -> Column:
    """The first word of a name; null where there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)^(\S+)", 1), F.lit(""))


def page_index(label: Column) -> Column:
    """Of a label with the page's number: the page from 0; 0 without a number."""
    n = F.regexp_extract(label, r"(?U)(\d+)", 1)
    return F.when(n == "", 0).otherwise(nfkc(n).cast("int") - 1)


def parse_rect(text: Column) -> Column:
    """struct<x0, y0, x1, y1> of four numbers with commas; null where there are not four."""
    p = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    ok = (F.size(p) == 4) & ~F.exists(p, lambda x: x.isNull())
    return F.when(ok, F.struct(*[F.get(p, F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]))


def rule_of(reason: Column) -> Column:
    """The rule in front of the colon or bracket of a reason."""
    return F.regexp_extract(reason, r"^([^:(]+(?::[a-z_]+)?)", 1)


def confidence_of(reason: Column) -> Column:
    return F.nullif(F.regexp_extract(reason, "信頼度=(HIGH|MEDIUM|LOW)", 1), F.lit(""))


def japanese_ratio(text: Column) -> Column:
    """Share of kana and common ideographs in what is not white space."""
    solid = F.regexp_count(text, F.lit(r"(?U)\S"))
    return F.when(solid > 0, F.regexp_count(text, F.lit(r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]")) / solid).otherwise(0.0)


def guard_tag(message: Column) -> Column:
    tag = F.lit("unknown_guard")
    for part, name in reversed(GUARDS):
        tag = F.when(message.contains(part), name).otherwise(tag)
    return tag


def false_positive_cause(value: Column, entity: Column, rule: Column) -> Column:
    """Why a rectangle's candidate is wrong, by its text."""
    value_of_label = F.regexp_replace(value, "^[ :：|/・\\-ー−－]+|[ :：|/・\\-ー−－]+$", "")
    headers = ("会社名", "法人名", "住所", "所在地", "氏名", "代表者", "取引銀行", "金融機関", "仕入先", "販売先", "外注先", "取引先", "株主", "役職")
    full = value.rlike("(?:都|道|府|県).*(?:市|区|町|村)")
    return (
        F.when(value_of_label.isin(*headers, ""), "見出しや項目名そのものを候補にした")
        .when(value.rlike(r"^[0-9０-９,.\-ー−－%％①-⑳\s]+$"), "数字や割合を機密情報と誤認した")
        .when(F.length(value) <= 3, "文字列が短すぎる")
        .when(F.length(value) > 60, "文字列が長すぎる")
        .when(value.isin("株式会社", "有限会社", "合同会社", "(株)", "(有)"), "法人表記だけを候補にした")
        .when((entity == "住所") & ~full, "住所の一部分だけを候補にした")
        .when(rule.startswith("table_column"), "表の列ずれ")
        .when(rule.startswith("label_value"), "隣接セルの誤取得")
        .when(rule.startswith("section_block") & value.rlike("製品|設計|仕入|仕上|対象会社"), "一般語を会社名や氏名と誤認した")
        .when(value.rlike("[0OIl|_]") & value.rlike(r"[\x{3040}-\x{9FFF}]"), "OCR誤認識")
        .otherwise("その他")
    )


def miss_cause(entity: Column, structure: Column, coverage: Column, in_text: Column) -> Column:
    """A letter from A to H: why a truth was missed, by what was found near it and where it stands."""
    many = structure.rlike("主な仕入先|外注先|主な販売先")
    unread = F.when(entity == "氏名", "B").when(structure.contains("写真"), "A").when(many, "C").when(structure.contains("列"), "D").when(structure.contains("説明文"), "E").otherwise("A")
    read = F.when(structure.contains("列"), "D").when(structure.rlike("説明文|代表者|所在地"), "E").when(structure.rlike("主な|一覧|構成"), "F").otherwise("H")
    return F.when(coverage > 0, "G").when(~in_text, unread).otherwise(read)


def ligature_note(text: Column, entity: Column) -> Column:
    """A warning where a company's first or last character, one ideograph beside kana, may be a misread ligature."""
    t = F.regexp_replace(text, "^[・\\-*•. 　]+|[・\\-*•. 　]+$", "")
    odd = t.rlike("^[一-龠々][ァ-ヶーぁ-ん]{2,}") | t.rlike("[ァ-ヶーぁ-ん]{2,}[一-龠々]$")
    return F.when((entity == "会社名") & odd, LIGATURE_NOTE).otherwise("")


def shortened(text: Column, limit: int = 36) -> Column:
    """One line for display."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, max(limit - 1, 1)), F.lit("...")))


def cleanup_address_tail(text: Column) -> Column:
    """Building and floor behind a city or ward are dropped."""
    from .generalise import PREFECTURE

    place = f"(?:{PREFECTURE})[一-龯ぁ-んァ-ヶー]+?(?:市[一-龯ぁ-んァ-ヶー]+?区|市|区)"
    tail = r"(?U:[\s　]+)[一-龯ぁ-んァ-ヶーA-Za-z0-9０-９一二三四五六七八九十百千]+(?:ビル|タワー|マンション)[一二三四五六七八九十0-9０-９]*(?:階|F|f)"
    return F.regexp_replace(text, f"({place}){tail}", "$1")


def cleanup_alias_notes(text: Column) -> Column:
    """Notes on former names and on spellings that are one alias now."""
    t = F.regexp_replace(text, "旧姓は[^。]+。", "旧姓情報あり。")
    t = F.regexp_replace(t, r"(個人[0-9]{3})(?:、\1)+(?:、\1)?の表記あり。", "$1の表記ゆれあり。")
    return F.regexp_replace(t, r"(個人[0-9]{3})(?:、\1)+、[A-Za-z]+の表記あり。", "$1の表記ゆれあり。")


def quick_ratio(left: Column, right: Column) -> Column:
    """An upper bound of the similarity of two texts: twice their common characters, counted, over both lengths."""
    chars = F.filter(F.array_distinct(F.split(left, "")), lambda c: c != "")
    count = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    both = F.aggregate(chars, F.lit(0), lambda n, c: n + F.least(count(left, c), count(right, c)))
    total = F.length(left) + F.length(right)
    return F.when(total > 0, 2.0 * both / total).otherwise(1.0)
