"""Queries on names of findings: statuses, reasons, places, causes, small parsers. Inputs are made of orders by arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from .tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pick(values, by):
    """One of some values by the remainder of a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def pick_sql(values, by: str) -> str:
    lit = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{lit}], CAST({by} % {len(values)} AS INT) + 1)"


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"))


O = "(SELECT o_orderkey AS id, o_custkey AS c FROM orders)"
DETECTIONS = ("確認候補", "AI候補", "自動確定", "利用者承認", "利用者解除", "手動追加", "列単位")
KINDS = ("docx", "pptx", "xlsx", "pdf", "txt")


@query(f"""WITH o AS (SELECT id, c % 2 = 0 AS on_, c % 3 = 0 AS out_, c % 5 < 2 AS rev, c % 7 = 0 AS link, {pick_sql(DETECTIONS, 'c')} AS d, {pick_sql(KINDS, 'id')} AS k FROM {O}),
  s AS (SELECT *, CASE WHEN out_ THEN '確認済み(除外)' WHEN d IN ('確認候補', 'AI候補') THEN d WHEN on_ THEN '自動変換' ELSE '維持' END AS sheet,
    CASE WHEN on_ AND rev THEN '要確認・承認済み' WHEN on_ THEN '自動変換' WHEN out_ THEN '確認済み(除外)' WHEN rev THEN '要確認(未処理)' ELSE '維持(手動)' END AS slide,
    CASE WHEN d IN ('確認候補', '自動確定', '利用者承認', '利用者解除', '手動追加') THEN d WHEN on_ THEN '自動変換' ELSE '除外' END AS page FROM o),
  t AS (SELECT *, CASE WHEN link THEN 'ハイパーリンク対象外' ELSE slide END AS paragraph FROM s)
  SELECT id, sheet, paragraph, slide, page,
    'rule' || (id % 4) || '(信頼度' || list_extract(['0.50', '0.74', '0.75', '1.00'], CAST(id % 4 AS INT) + 1) || ')' || CASE paragraph WHEN 'ハイパーリンク対象外' THEN ' / ハイパーリンクURLの置換は未対応のため対象外'
      WHEN '要確認・承認済み' THEN ' / 要確認候補を利用者が確認のうえ承認' WHEN '要確認(未処理)' THEN ' / 要確認候補が未承認のため対象外'
      WHEN '確認済み(除外)' THEN ' / 要確認候補を利用者が確認のうえ除外(原文を維持)' WHEN '維持(手動)' THEN ' / 利用者が対象を解除し原文を維持' ELSE '' END AS reason,
    CASE WHEN k IN ('docx', 'pptx') THEN paragraph = '要確認(未処理)' WHEN k = 'xlsx' THEN d IN ('確認候補', 'AI候補') AND NOT on_ AND NOT out_ WHEN k = 'pdf' THEN d = '確認候補' ELSE FALSE END AS unresolved FROM t""")
def finding_statuses(spark, sf_dir):
    """Statuses of cells, paragraphs, slides and pages, the reason, and whether a finding is unresolved."""
    o = orders(spark, sf_dir)
    on, out, rev = F.col("c") % 2 == 0, F.col("c") % 3 == 0, F.col("c") % 5 < 2
    d, k = pick(DETECTIONS, F.col("c")), pick(KINDS, F.col("id"))
    source = F.when(F.col("c") % 7 == 0, "hyperlink_target").otherwise("text")
    paragraph = L.document_status(on, out, rev, source)
    reason = L.finding_reason(F.concat(F.lit("rule"), (F.col("id") % 4).cast("string")), pick((0.50, 0.74, 0.75, 1.0), F.col("id")), paragraph)
    return o.select(
        "id", L.sheet_status(on, out, d).alias("sheet"), paragraph.alias("paragraph"), L.document_status(on, out, rev).alias("slide"), L.page_status(d, on).alias("page"),
        reason.alias("reason"), L.is_unresolved(k, paragraph, d, on, out).alias("unresolved"),
    )


STORIES = ("body", "header", "footer", "footnote", "document_property")


@query(f"""WITH o AS (SELECT id, c, {pick_sql(STORIES, 'c')} AS story, CASE WHEN id % 4 = 0 THEN NULL ELSE 'first' END AS variant, c % 3 AS section, id % 2 = 0 AS cell FROM {O}),
  s AS (SELECT *, CASE story WHEN 'body' THEN '本文' WHEN 'header' THEN 'ヘッダー(' || coalesce(variant, 'default') || ')' WHEN 'footer' THEN 'フッター(' || coalesce(variant, 'default') || ')' ELSE story END
    || CASE WHEN section > 0 THEN ' セクション' || (section + 1) ELSE '' END AS place FROM o)
  SELECT id, CASE WHEN story = 'document_property' THEN '文書プロパティ(title)' WHEN cell THEN place || ' 表' || (id % 5 + 1) || ' 行' || (id % 7 + 1) || '列' || (c % 4 + 1) || CASE WHEN c % 2 > 0 THEN ' 段落2' ELSE '' END
      ELSE place || ' 段落' || (id % 11 + 1) END AS paragraph,
    CASE WHEN c % 6 = 0 THEN '文書プロパティ(title)' WHEN c % 6 = 1 THEN 'スライド' || (id % 9 + 1) || ' スピーカーノート 段落' || (id % 11 + 1)
      WHEN c % 6 = 2 THEN 'スライド' || (id % 9 + 1) || ' 表(図形' || c || ') 行' || (id % 7 + 1) || '列' || (c % 4 + 1) ELSE 'スライド' || (id % 9 + 1) || ' Title 1 段落' || (id % 11 + 1) END AS slide,
    story IN ('body', 'header', 'footer') AS formal, c % 2 = 0 AND story IN ('body', 'header', 'footer') AS formal_unit, c % 4 = 3 AS elsewhere FROM s""")
def finding_places(spark, sf_dir):
    """Where a finding stands, in words, and whether the place counts in evaluations."""
    o = orders(spark, sf_dir)
    c, i, story = F.col("c"), F.col("id"), pick(STORIES, F.col("c"))
    u = {"story": story, "variant": F.when(i % 4 != 0, "first"), "section": c % 3, "container": F.when(i % 2 == 0, "table_cell").otherwise("paragraph"), "table": i % 5, "row": i % 7,
         "cell": c % 4, "cell_para": c % 2, "para": i % 11, "property": F.lit("title")}
    v = {"property": F.when(c % 6 == 0, "title"), "slide": i % 9, "container": F.when(c % 6 == 1, "notes").when(c % 6 == 2, "table_cell").otherwise("shape_text"), "shape": c,
         "shape_name": F.lit("Title 1"), "row": i % 7, "cell": c % 4, "para": i % 11}
    container = F.when(c % 2 == 0, "table_cell").otherwise("text_box")
    return o.select(
        "id", L.paragraph_location(u).alias("paragraph"), L.slide_location(v).alias("slide"), L.is_formal_location(F.concat(story, F.lit(":0:1"))).alias("formal"),
        L.is_formal_unit(story, container).alias("formal_unit"), L.is_cross_domain_sheet(pick(("01_a", "02_b", "x03_", "03_人"), c)).alias("elsewhere"),
    )


ADDRESSES = ("東京都港区芝1-2", "大阪市北区三丁目", "住所制度について1", "北町", "第１号棟", "京都府　政策2", "〒100")


@query(f"""SELECT id, NOT regexp_matches(a, '[0-9０-９]|丁目|番|号|〒') OR regexp_matches(a, '制度|政策|説明|について') AS weak,
  NOT regexp_matches(a, '[0-9０-９]|丁目|番地|号|〒') OR regexp_matches(a, '制度|政策|説明|について') AS weak_slide,
  regexp_replace(t, '(東京都港区|大阪府大阪市北区) +[ぁ-んァ-ヶ一-龯A-Za-z0-9]+(ビル|タワー)[0-9]*階', '\\1', 'g') AS cut,
  CASE WHEN id % 3 = 0 THEN replace(n, '旧姓は山田。', '旧姓情報あり。') WHEN id % 3 = 1 THEN '個人001の表記ゆれあり。' ELSE n END AS note
  FROM (SELECT id, {pick_sql(ADDRESSES, 'c')} AS a, {pick_sql(('東京都港区 芝ビル3階です', '大阪府大阪市北区  梅田タワー12階', '東京都港区芝ビル3階', '北区 ビル'), 'c')} AS t,
    {pick_sql(('旧姓は山田。', '個人001、個人001、個人001の表記あり。', '個人001、個人002の表記あり。'), 'id')} AS n FROM {O})""")
def address_strength(spark, sf_dir):
    """Weak addresses, tails behind a city, notes on spellings."""
    c, i = F.col("c"), F.col("id")
    a, t = pick(ADDRESSES, c), pick(("東京都港区 芝ビル3階です", "大阪府大阪市北区  梅田タワー12階", "東京都港区芝ビル3階", "北区 ビル"), c)
    n = pick(("旧姓は山田。", "個人001、個人001、個人001の表記あり。", "個人001、個人002の表記あり。"), i)
    return orders(spark, sf_dir).select("id", L.is_weak_address(a).alias("weak"), L.is_weak_slide_address(a).alias("weak_slide"), L.cleanup_address_tail(t).alias("cut"), L.cleanup_alias_notes(n).alias("note"))


REASONS = ("label_value: 信頼度=HIGH", "table_column: x 信頼度=LOW", "pattern: 信頼度=none")


@query(f"""WITH o AS (SELECT id, c, 'ページ' || (id % 300 + 1) AS label, (c % 10) || ', ' || (id % 7 + 0.5) || ',30,' || CASE WHEN id % 5 = 0 THEN 'x' ELSE '40.25' END AS r, {pick_sql(REASONS, 'id')} AS reason,
    {pick_sql(('Anna Bell', ' 山田　太郎', '佐藤', '   '), 'c')} AS name, 'a' || repeat('bc ', CAST(c % 20 AS INT)) || 'd' AS long_ FROM {O})
  SELECT id, id % 300 AS page, CASE WHEN id % 5 <> 0 THEN (c % 10)::DOUBLE END AS x0, CASE WHEN id % 5 <> 0 THEN id % 7 + 0.5::DOUBLE END AS y0, CASE WHEN id % 5 <> 0 THEN 40.25::DOUBLE END AS y1,
    split_part(reason, ':', 1) AS rule, nullif(regexp_extract(reason, '信頼度=(HIGH|MEDIUM|LOW)', 1), '') AS confidence,
    nullif(regexp_extract(name, '^[ 　]*([^ 　]+)', 1), '') AS family, CASE WHEN length(long_) <= 36 THEN long_ ELSE long_[1:35] || '...' END AS short FROM o""")
def parsed_values(spark, sf_dir):
    """Pages of labels, rectangles of texts, rules and confidences of reasons, family names, texts for display."""
    c, i = F.col("c"), F.col("id")
    reason = pick(REASONS, i)
    rect = F.concat((c % 10).cast("string"), F.lit(", "), (i % 7 + 0.5).cast("string"), F.lit(",30,"), F.when(i % 5 == 0, "x").otherwise("40.25"))
    long_ = F.concat(F.lit("a"), F.repeat(F.lit("bc "), (c % 20).cast("int")), F.lit("d"))
    o = orders(spark, sf_dir).withColumn("r", L.parse_rect(rect))
    return o.select(
        "id", L.page_index(F.concat(F.lit("ページ"), (i % 300 + 1).cast("string"))).cast("long").alias("page"), "r.x0", "r.y0", "r.y1", F.regexp_replace(L.rule_of(reason), ":.*", "").alias("rule"),
        L.confidence_of(reason).alias("confidence"), L.surname(pick(("Anna Bell", " 山田　太郎", "佐藤", "   "), c)).alias("family"), L.shortened(long_).alias("short"),
    )


@query(f"""WITH o AS (SELECT doc_id AS id, text, regexp_replace(coalesce(text, ''), '\\s', '', 'g') AS t FROM documents)
  SELECT id, CASE WHEN length(t) > 0 THEN round(length(regexp_replace(t, '[^\\x{{3040}}-\\x{{30FF}}\\x{{4E00}}-\\x{{9FFF}}]', '', 'g'))::DOUBLE / length(t), 9) ELSE 0.0 END AS ratio FROM o""")
def japanese_ratios(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.round(L.japanese_ratio(F.coalesce("text", F.lit(""))), 9).alias("ratio"))


MESSAGES = tuple(m for m, _ in L.GUARDS[:6]) + ("表の検出候補の範囲が重複しています。", "別の文")


@query(f"""SELECT id, CASE WHEN contains(m, '先に検査を実行してください。') THEN 'not_scanned' WHEN contains(m, 'ハイパーリンクURLの置換は未対応です。') THEN 'hyperlink_target_guard'
    WHEN contains(m, '未確認候補が') THEN 'review_required_guard' WHEN contains(m, '未対応領域が検出されたため外部共有用の出力を停止しました。') THEN 'unsupported_features_guard_external'
    WHEN contains(m, '構造が変化しました。') THEN 'integrity_guard' WHEN contains(m, '範囲が重複しています') THEN 'overlap_guard' ELSE 'unknown_guard' END AS tag FROM (SELECT id, {pick_sql(MESSAGES, 'c')} AS m FROM {O})""")
def guard_tags(spark, sf_dir):
    return orders(spark, sf_dir).select("id", L.guard_tag(pick(MESSAGES, F.col("c"))).alias("tag"))


VALUES = ("会社名：", "12,300", "山田", "北方商事株式会社製品部", "東京", "港区芝", "東京都港区芝一丁目", "株式会社", "北0社のもの")
RULES = ("table_column:x", "label_value:y", "section_block:z", "pattern:p")
STRUCTURES = ("写真の中", "主な仕入先", "一覧の列", "説明文", "代表者", "役員構成", "本文")


@query(f"""WITH o AS (SELECT id, c, {pick_sql(VALUES, 'id')} AS v, {pick_sql(('住所', '会社名', '氏名'), 'c')} AS e, {pick_sql(RULES, 'c')} AS r, {pick_sql(STRUCTURES, 'id')} AS s, c % 4 = 0 AS near, id % 3 = 0 AS read_ FROM {O})
  SELECT id, CASE WHEN v = '会社名：' THEN '見出しや項目名そのものを候補にした' WHEN v = '12,300' THEN '数字や割合を機密情報と誤認した' WHEN length(v) <= 3 THEN '文字列が短すぎる' WHEN v = '株式会社' THEN '法人表記だけを候補にした'
      WHEN e = '住所' AND v <> '東京都港区芝一丁目' THEN '住所の一部分だけを候補にした' WHEN r = 'table_column:x' THEN '表の列ずれ' WHEN r = 'label_value:y' THEN '隣接セルの誤取得'
      WHEN r = 'section_block:z' AND contains(v, '製品') THEN '一般語を会社名や氏名と誤認した' WHEN contains(v, '0') THEN 'OCR誤認識' ELSE 'その他' END AS wrong,
    CASE WHEN near THEN 'G' WHEN read_ THEN CASE WHEN contains(s, '列') THEN 'D' WHEN s IN ('説明文', '代表者') THEN 'E' WHEN s IN ('主な仕入先', '役員構成') THEN 'F' ELSE 'H' END
      WHEN e = '氏名' THEN 'B' WHEN contains(s, '写真') THEN 'A' WHEN contains(s, '主な仕入先') THEN 'C' WHEN contains(s, '列') THEN 'D' WHEN contains(s, '説明文') THEN 'E' ELSE 'A' END AS missed,
    CASE WHEN e = '会社名' AND id % 9 = 8 THEN '{L.LIGATURE_NOTE}' ELSE '' END AS note FROM o""")
def error_causes(spark, sf_dir):
    """Why candidates are wrong and truths missed, and warnings of misread ligatures."""
    c, i = F.col("c"), F.col("id")
    v, e = pick(VALUES, i), pick(("住所", "会社名", "氏名"), c)
    odd = pick(("北方", "カナ", "師", "山ろ", "北カ方", "㈱北", "北", "南北カナ", "師カナエ・"), i)
    return orders(spark, sf_dir).select(
        "id", L.false_positive_cause(v, e, pick(RULES, c)).alias("wrong"), L.miss_cause(e, pick(STRUCTURES, i), F.when(c % 4 == 0, 0.5).otherwise(0.0), i % 3 == 0).alias("missed"), L.ligature_note(odd, e).alias("note")
    )


@query(f"""WITH o AS (SELECT id, c, 'x' || c AS l, 'x' || (c % 100) AS r FROM {O}), ch AS (SELECT DISTINCT id, unnest(string_split(l, '')) AS ch, l, r FROM o)
  SELECT id, round(2.0 * sum(least(length(l) - length(replace(l, ch, '')), length(r) - length(replace(r, ch, '')))) / (any_value(length(l)) + any_value(length(r))), 9) AS ratio FROM ch WHERE ch <> '' GROUP BY 1""")
def quick_ratios(spark, sf_dir):
    left, right = F.concat(F.lit("x"), F.col("c").cast("string")), F.concat(F.lit("x"), (F.col("c") % 100).cast("string"))
    return orders(spark, sf_dir).select("id", F.round(L.quick_ratio(left, right), 9).alias("ratio"))


PLACES = ("東京都港区芝1", "愛知県名古屋市中区栄", "大阪市北区梅田", "Tokyo Minato-ku 1", "不明")


@query(f"""SELECT id, format('{{:,}}', (c * 1000 // 5000 * 5000)::BIGINT) || '～' || format('{{:,}}', (c * 1000 // 5000 * 5000 + 4999)::BIGINT) || '円' AS yen,
  {pick_sql(('東京都港区', '愛知県名古屋市中区', '大阪府大阪市北区', '東京都港区', ''), 'c')} AS city, {pick_sql(('東京都', '愛知県', '大阪府', '東京都', '不明'), 'c')} AS prefecture,
  CASE WHEN id % 2 = 0 THEN '金融機関001 普通 ****' ELSE '口座 ****' END || right(lpad(c::VARCHAR, 7, '0'), 3) AS account, {pick_sql(('山田', '佐藤', '田中'), 'c')} AS bare,
  c % 4 < 3 AS doubtful, CASE WHEN c % 2 = 0 THEN 8 ELSE 0 END AS roles, sha256(c::VARCHAR) AS digest FROM {O}""")
def masked_values(spark, sf_dir):
    """Ranges in yen, addresses by city and prefecture, accounts, names without honorific, doubtful names, roles, digests."""
    from ..functions import generalise as G
    from ..functions import text as T
    from ..functions.variants import role_variants

    c, i = F.col("c"), F.col("id")
    number = F.lpad(c.cast("string"), 7, "0")
    account = F.when(i % 2 == 0, F.concat(F.lit("青空銀行 普通 "), number)).otherwise(F.concat(F.lit("口座 "), number))
    place = pick(PLACES, c)
    return orders(spark, sf_dir).select(
        "id", G.yen_range((c * 1000).cast("double"), 5000).alias("yen"), G.generalise_address(place).alias("city"), G.prefecture_only(place).alias("prefecture"),
        G.mask_bank_account(account, F.lit("金融機関001")).alias("account"), T.strip_honorific(pick(("山田さん", "佐藤様", "田中"), c)).alias("bare"),
        T.is_ambiguous_name(pick(("山田さん", "やまだ", "TARO", "山田太郎"), c)).alias("doubtful"), F.size(role_variants(pick(("森", "山田太郎"), c), F.lit("個人001"))).alias("roles"),
        F.sha2(c.cast("string"), 256).alias("digest"),
    )


@query(f"""SELECT DISTINCT CASE WHEN c % 4 = 0 THEN 'ab' WHEN c % 4 = 1 THEN '個人' || lpad((c % 1000)::VARCHAR, 3, '0') ELSE 'name' || c END AS value, 'x' AS category FROM {O} WHERE c % 4 > 1""")
def sensitive_originals(spark, sf_dir):
    """Originals worth looking for: neither short nor aliases already."""
    from ..operators.verify import sensitive_values

    c = F.col("c")
    v = F.when(c % 4 == 0, "ab").when(c % 4 == 1, F.concat(F.lit("個人"), F.lpad((c % 1000).cast("string"), 3, "0"))).otherwise(F.concat(F.lit("name"), c.cast("string")))
    return sensitive_values(orders(spark, sf_dir).select(v.alias("original"), F.lit("x").alias("category")))


@query(f"SELECT id, 'AI候補' AS detection, FALSE AS enabled, '自然言語処理(信頼度0.50)' AS reason FROM {O} WHERE c % 2 = 1")
def model_findings(spark, sf_dir):
    """A model's spans count where no other finding lies, and start switched off."""
    from ..operators.cells import model_findings as found

    o = orders(spark, sf_dir).select(F.lit("f").alias("file_id"), F.lit("s").alias("sheet"), F.lit(0).alias("sheet_ord"), F.col("id").alias("row"), F.lit(1).alias("col"), "c")
    spans = o.select("file_id", "sheet", "sheet_ord", "row", "col", F.lit(3).alias("start"), F.lit(8).alias("end"), F.lit("会社名").alias("category"), F.lit("abcde").alias("text"), F.lit("法人001").alias("replacement"))
    covered = o.select("file_id", "sheet", "row", "col", F.when(F.col("c") % 2 == 0, 0).otherwise(8).alias("start"), F.when(F.col("c") % 2 == 0, 5).otherwise(9).alias("end"))
    return found(spans, covered).select(F.col("row").alias("id"), "detection", "enabled", "reason")


@query(f"SELECT c % 20 AS sheet, 'v' || (c % 7) AS original, min(id) AS ord FROM {O} GROUP BY 1, 2")
def distinct_findings(spark, sf_dir):
    """Of equal findings the first."""
    from ..operators.cells import distinct_findings as first

    f = orders(spark, sf_dir).select((F.col("c") % 20).alias("sheet"), F.concat(F.lit("v"), (F.col("c") % 7).cast("string")).alias("original"), F.col("id").alias("ord"))
    return first(f, ["sheet", "original"])


@query(f"""SELECT id, count(*) FILTER (WHERE i * 10 + 5 + c % 10 <= 50) AS n FROM {O}, (VALUES (0), (1), (2), (3), (4), (5)) AS t(i) GROUP BY 1""")
def words_in_rects(spark, sf_dir):
    """Words of a page whose centre lies in a rectangle."""
    from ..operators.spatial import words_in_rect

    o = orders(spark, sf_dir)
    w = o.select(F.lit("f").alias("file_id"), F.col("id").alias("page"), "c", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    x = F.col("i") * 10 + F.col("c") % 10
    words = w.select("file_id", "page", x.cast("double").alias("x0"), F.lit(0.0).alias("y0"), (x + 10).cast("double").alias("x1"), F.lit(10.0).alias("y1"))
    rects = o.select(F.lit("f").alias("file_id"), F.col("id").alias("page"), F.col("id").alias("rect_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(50.0).alias("x1"), F.lit(50.0).alias("y1"))
    return words_in_rect(words, rects).groupBy(F.col("rect_id").alias("id")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) >= 20 AND doc_id % 3 > 0 THEN 'text' ELSE 'ocr' END AS mode FROM documents")
def page_modes(spark, sf_dir):
    """Pages with enough text and spans are read by their text layer."""
    from ..sources.tables import page_mode

    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 3).alias("n_spans"))
    return page_mode(d).select("doc_id", "mode")
