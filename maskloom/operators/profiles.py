"""Detection in document paragraphs and recognised pages: trims, refusals and selection of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import SPAN, _resized, is_noise, label_of, match_offsets, rule_spans, trim_span
from .resolve import greedy, overlaps
from ..functions.labels import address_strength, is_weak_address, is_weak_slide_address
from .rules import DESIGNATORS, OCR, PAGE_NAMES, PROFILES, SLIDE, WORD

# Labels before values, and words that are no value.
_LABELS = {"会社名": "会社名|法人名|取引先|顧客企業", "住所": "送付先住所|住所|所在地|送付先|連絡先", "銀行名": "銀行名|金融機関|振込先|口座"}
_STOP = "です|でした|ます|ました|[。、「」,，]|(?<=[一-龯々〆ヵヶぁ-んァ-ヶーA-Za-z0-9])(?:は|を|が|に|へ|で|と)(?=[一-龯々〆ヵヶぁ-んァ-ヶー])"
_NOT_COMPANIES = (*DESIGNATORS, "会社", "会社名", "法人名", "担当", "担当者")
_NOT_BANKS = ("銀行", "銀行名", "金融機関")
_CATEGORIES = ("会社名", "氏名", "住所", "電話番号", "メールアドレス", "銀行名")
_SAME = {"組織名": "会社名", "銀行口座": "銀行名"}
_SLIDE_LABELS = {"会社名": "(?:会社名|法人名|取引先|顧客企業)[:：]", "住所": "(?:住所|所在地)[:：は]?", "銀行名": "(?:銀行名|金融機関|振込先|口座)[:：は]?"}
_BUILDING = (
    "^[ \\t　]+(?:[一-龯々〆ヵヶぁ-んァ-ヶーA-Za-z0-9０-９\\-－]{1,20}(?:ビル|マンション|号館|棟|タワー|ハイツ|レジデンス)[一-龯々〆ヵヶぁ-んァ-ヶーA-Za-z0-9０-９\\-－]*"
    "(?:[0-9０-９一二三四五六七八九十百千]+(?:階|F|Ｆ|号室))?|[0-9０-９一二三四五六七八九十百千]+(?:階|F|Ｆ|号室))"
)
_SLIDE_BUILDING = "^(?:ビル|マンション|号館|棟|タワー|ハイツ|レジデンス|階|号室)[0-9０-９A-Za-z一-龯]*"
_REJECTED = (("森を抜ける", "一般文として扱い、人名候補から除外"), ("南側の入口", "一般文として扱い、人名候補から除外"))
_NOT_NAMES = ("銀行", "支店", "会社", "法人", "研究所", "センター", "ラボ", "工場")


def _cut_start(x: Column, pattern: str | Column) -> Column:
    n = F.length(F.regexp_substr(x["text"], pattern if isinstance(pattern, Column) else F.lit(pattern)))
    n = F.coalesce(n, F.lit(0))
    return _resized(x, n, F.length(x["text"]) - n)


def _cut_end(x: Column, pattern: str) -> Column:
    n = F.length(F.regexp_extract(x["text"], pattern, 0))
    return _resized(x, F.lit(0), F.length(x["text"]) - n)


def trim_word_spans(spans: Column) -> Column:
    """Labels off the front, sentence ends and honorifics off the back, then white space and marks off both.

    Each step is a pass of its own over the array, so that no step's expression is repeated in the next one's.
    """
    lead = "^.*[ \\t　:：、。，,/／「」『』（）()はをがにへでと]"
    spans = F.transform(spans, lambda x: F.when(x["rule"] == 1, _cut_start(x, lead)).otherwise(x))
    labelled = F.lit("^$")
    label_of = lambda x: F.coalesce(*[F.when(x["category"] == n, F.lit(f"(?U)^(?:{v})[:：は\\s]*")) for n, v in _LABELS.items()], labelled)
    spans = F.transform(spans, lambda x: _cut_start(x, label_of(x)))
    stop = lambda x: F.regexp_extract(x["text"], f"^(.+?)(?:{_STOP})", 1)
    stopped = lambda x: x["category"].isin("会社名", "住所", "銀行名") & (stop(x) != "")
    spans = F.transform(spans, lambda x: F.when(stopped(x), _resized(x, F.lit(0), F.length(stop(x)))).otherwise(x))
    titled = lambda x: x["category"].isin("会社名", "氏名")
    spans = F.transform(spans, lambda x: F.when(titled(x), _cut_end(x, "(?<=.)(?:さん|様|殿|氏)$")).otherwise(x))
    spans = F.transform(spans, lambda x: _cut_start(x, "^[ \\t　:：]+"))
    return F.transform(spans, lambda x: _cut_end(x, "[ \\t　。、「」,，です]+$"))


def _any(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def is_generic(x: Column) -> Column:
    t = F.trim(x["text"])
    named = _any(t, DESIGNATORS)
    company = (x["category"] == "会社名") & (t.isin(*_NOT_COMPANIES) | (~named & t.rlike("(?:担当者?|先)$") & (F.length(t) <= 8)))
    bank = (x["category"] == "銀行名") & t.isin(*_NOT_BANKS)
    name = (x["category"] == "氏名") & _any(t, _NOT_NAMES)
    body = F.regexp_replace(t, f"^(?:{'|'.join(DESIGNATORS)})|(?:{'|'.join(DESIGNATORS)})$", "")
    designated = x["rule"].isin(0, 1) & (~named | (F.length(body) < 2))
    contextual = (x["rule"] == 2) & named
    return company | bank | name | designated | contextual


def is_form_text(x: Column, text: Column) -> Column:
    """Padded form labels and article numbers, which look like a name with a space."""
    after = F.substring(text, x["end"] + 1, F.lit(15))
    before = F.substring(text, F.greatest(F.lit(1), x["start"] - 5), F.least(F.lit(6), x["start"]))
    return (x["rule"] == 6) & (after.rlike("^[ \\t　一-龯々〆ヵヶ]*[：:]") | before.rlike("第[0-9０-９]+$"))


def select_by_category(spans: Column, model: Column | None = None) -> Column:
    """Pattern spans exclude only their own category; model spans, longest first, take only places none has."""
    taken = greedy(spans, same_category_only=True)
    if model is None:
        return taken
    free = F.filter(model, lambda m: ~F.exists(taken, lambda y: overlaps(m, y)))
    return F.array_sort(F.concat(taken, greedy(free)))


def direct_spans(text: Column) -> Column:
    """Spans by the rules for all texts in the categories of documents; their rule numbers start at 100."""
    found = F.filter(F.transform(rule_spans(text, PROFILES["japanese"]), trim_span), lambda x: ~is_noise(x, text) & (F.length(F.trim(x["text"])) >= 2))
    same = F.create_map(*[F.lit(v) for kv in _SAME.items() for v in kv])
    named = F.transform(greedy(found), lambda x: x.withField("category", F.coalesce(same[label_of(x["category"])], label_of(x["category"]))).withField("rule", x["rule"] + 100))
    return F.filter(named, lambda x: x["category"].isin(*_CATEGORIES))


def extend_addresses(spans: Column, text: Column, tail: str, reach: int, strong) -> Column:
    """Addresses with numbers take in the building or floor that follows."""

    def one(x: Column) -> Column:
        n = F.length(F.regexp_extract(F.substring(text, x["end"] + 1, F.lit(reach)), tail, 0))
        wide = F.substring(text, x["start"] + 1, x["end"] - x["start"] + n)
        more = x.withField("end", (x["end"] + n).cast("int")).withField("text", wide)
        return F.when((x["category"] == "住所") & strong(x["text"]) & (n > 0), more).otherwise(x)

    return F.transform(spans, one)


def detect_in_paragraphs(df: DataFrame, text_col: str = "text", model_spans: str | None = None, direct: bool = False) -> DataFrame:
    """Add ``spans`` of paragraphs by the document rules; ``model_spans`` names a column of spans found by a model.

    With ``direct`` the rules for all texts take part too; addresses without numbers do not count then.
    """
    text = F.col(text_col)
    spans = rule_spans(text, WORD)
    if direct:
        spans = F.concat(extend_addresses(trim_word_spans(direct_spans(text)), text, _BUILDING, 80, address_strength), trim_word_spans(spans))
        spans = F.filter(spans, lambda x: (x["category"] != "住所") | ~is_weak_address(x["text"]))
    else:
        spans = trim_word_spans(spans)
    spans = F.filter(spans, lambda x: (F.length(F.trim(x["text"])) >= 2) & ~is_generic(x) & ~is_form_text(x, text))
    none = F.array().cast(f"array<{SPAN}>")
    return df.withColumn("spans", F.coalesce(select_by_category(spans, F.col(model_spans) if model_spans else None), none))


def trim_slide_spans(spans: Column) -> Column:
    """Labels off the front, what follows a sentence's end off the back, honorifics, then white space and marks."""
    lead = "^.*[ \\t　:：、。，,/／「」『』（）()はをがにへでと]"
    spans = F.transform(spans, lambda x: F.when(x["rule"] == 1, _cut_start(x, lead)).otherwise(x))
    label = lambda x: F.coalesce(*[F.when(x["category"] == n, F.lit(f"(?U)^{v}\\s*")) for n, v in _SLIDE_LABELS.items()], F.lit("^$"))
    spans = F.transform(spans, lambda x: _cut_start(x, label(x)))
    ended = lambda x: x["category"].isin("会社名", "住所", "銀行名")
    spans = F.transform(spans, lambda x: F.when(ended(x), _resized(x, F.lit(0), F.length(F.regexp_extract(x["text"], "^[^。、,，.．!！?？\\n]*", 0)))).otherwise(x))
    spans = F.transform(spans, lambda x: F.when(x["category"].isin("会社名", "氏名"), _cut_end(x, "(?:さん|様|殿|氏)$")).otherwise(x))
    spans = F.transform(spans, lambda x: _cut_start(x, "^[ \\t　:：、。]+"))
    return F.transform(spans, lambda x: _cut_end(x, "[ \\t　:：、。]+$"))


def is_generic_on_slide(x: Column) -> Column:
    t = F.trim(x["text"])
    named = _any(t, DESIGNATORS)
    body = F.regexp_replace(t, f"^(?:{'|'.join(DESIGNATORS)})|(?:{'|'.join(DESIGNATORS)})$", "")
    short = t.rlike("(?:担当|先)$") & (F.length(t) <= 3)
    return (
        (t == "")
        | ((x["category"] == "会社名") & (t.isin(*DESIGNATORS) | short))
        | ((x["category"] == "氏名") & _any(t, _NOT_NAMES))
        | (x["rule"].isin(0, 1) & (~named | (F.length(body) < 2)))
        | ((x["rule"] == 2) & named)
    )


def detect_in_slides(df: DataFrame, text_col: str = "text", model_spans: str | None = None) -> DataFrame:
    """Add ``spans`` of the paragraphs of slides: the rules of documents with trims and refusals of their own."""
    text = F.col(text_col)
    spans = F.concat(extend_addresses(trim_slide_spans(direct_spans(text)), text, _SLIDE_BUILDING, 20, lambda t: t.rlike("[0-9０-９]|丁目|番地|号|〒")), trim_slide_spans(rule_spans(text, SLIDE)))
    spans = F.filter(spans, lambda x: (x["category"] != "住所") | (x["rule"] < 100) | ~is_weak_slide_address(x["text"]))
    spans = F.filter(spans, lambda x: (F.length(F.trim(x["text"])) >= 2) & ~is_generic_on_slide(x) & ~is_form_text(x, text))
    none = F.array().cast(f"array<{SPAN}>")
    return df.withColumn("spans", F.coalesce(select_by_category(spans, F.col(model_spans) if model_spans else None), none))


def detect_in_text_layer(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``spans`` of the text of page layers: the rules for all texts, and names after English labels."""
    text = F.col(text_col)
    found = F.filter(F.transform(rule_spans(text, PROFILES["japanese"]), trim_span), lambda x: ~is_noise(x, text))
    own = F.transform(rule_spans(text, PAGE_NAMES), lambda x: x.withField("rule", x["rule"] + 200))
    spans = F.filter(F.concat(found, own), lambda x: F.length(F.trim(x["text"])) >= 2)
    return df.withColumn("spans", F.coalesce(greedy(spans), F.array().cast(f"array<{SPAN}>")))


def rejected_phrases(text: Column) -> Column:
    """array<struct<start, text, reason>>: phrases that look like names and are none."""
    return F.concat(*[F.transform(match_offsets(text, p), lambda m, why=why: F.struct(m["start"], m["text"], F.lit(why).alias("reason"))) for p, why in _REJECTED])


def legacy_candidates(text: Column) -> Column:
    """array<struct<kind, value>>: addresses of five characters or more and names of 2 to 20, by the older rules."""
    clean = lambda x: F.regexp_replace(x["text"], r"(?U)^\s+|\s+$", "")
    found = F.transform(rule_spans(text, PROFILES["legacy"]), lambda x: F.struct(x["category"].alias("kind"), clean(x).alias("value")))
    n = lambda x: F.length(x["value"])
    return F.filter(found, lambda x: ((x["kind"] == "Address") & (n(x) >= 5)) | ((x["kind"] == "Name") & n(x).between(2, 20)))


def detect_in_pages(pages: DataFrame, norm_col: str = "norm") -> DataFrame:
    """Add ``spans`` of normalised page texts with ``status``: clear patterns are automatic, others need review."""
    spans = F.filter(rule_spans(F.col(norm_col), OCR), lambda x: F.length(x["text"]) >= 2)
    auto = F.array(*[F.lit(r.name == "auto") for r in OCR])
    with_status = F.transform(greedy(spans, same_category_only=True), lambda x: x.withField("status", F.when(F.get(auto, x["rule"]), "AUTO").otherwise("REVIEW_REQUIRED")))
    return pages.withColumn("spans", with_status)


def char_rects(words: DataFrame) -> DataFrame:
    """One row for each character of the normalised words with its share of the word's box, in reading order."""
    from ..functions.text import ocr_normalize

    w = words.withColumn("norm", ocr_normalize(F.col("text"))).filter(F.length("norm") > 0)
    chars = w.select("file_id", "page", "block", "line", "word_no", "x0", "y0", "x1", "y1", F.length("norm").alias("n"), F.posexplode(F.split("norm", "")).alias("i", "c"))
    chars = chars.filter(F.col("c") != "")
    width = (F.col("x1") - F.col("x0")) / F.col("n")
    return chars.select("file_id", "page", "block", "line", "word_no", "i", "c", (F.col("x0") + F.col("i") * width).alias("x0"), "y0", (F.col("x0") + (F.col("i") + 1) * width).alias("x1"), "y1")


def span_rects(found: DataFrame, words: DataFrame) -> DataFrame:
    """(file_id, page, start, end, category, status, text, rectangle) of page spans, from the boxes of their characters."""
    spans, hit = _placed_spans(found, words)
    return hit.groupBy(*spans.columns).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def _placed_spans(found: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    w = Window.partitionBy("file_id", "page").orderBy("block", "line", "word_no", "i")
    placed = char_rects(words).withColumn("at", F.row_number().over(w) - 1)
    same = (F.lag("block").over(w) == F.col("block")) & (F.lag("line").over(w) == F.col("line")) & (F.lag("word_no").over(w) == F.col("word_no"))
    placed = placed.withColumn("before", F.struct(F.lag("c").over(w).alias("c"), F.lag("x1").over(w).alias("x1"), same.alias("same")))
    spans = found.select("file_id", "page", F.explode("spans").alias("s")).select("file_id", "page", "s.start", "s.end", "s.category", "s.status", "s.text")
    return spans, spans.join(placed, ["file_id", "page"]).filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))


def candidate_rects(found: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """Rectangles to cover page spans: widened by kind, tightened where the kind's width is known, once each, on the page.

    A colon in front of a span lets its rectangle reach back a little. ``pages`` holds (file_id, page, page_x0, page_y0,
    page_x1, page_y1).
    """
    spans, hit = _placed_spans(found, words)
    r = hit.groupBy(*spans.columns).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min_by("before", "at").alias("b")
    ).join(pages, ["file_id", "page"])
    tall = F.col("y1") - F.col("y0")
    back = F.col("b.x1") - F.when(F.coalesce("b.same", F.lit(False)), tall * 0.25).otherwise(F.least(tall * 0.08, F.lit(2.0)))
    r = r.withColumn("x0", F.when(F.col("b.c").isin(":", "："), F.least("x0", back)).otherwise(F.col("x0")))
    tall = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    kind = F.col("category")
    pad = F.when(kind.isin("メールアドレス", "APIキー", "パスワード"), F.greatest(tall * 0.35, F.lit(7.0))).when(kind.isin("電話番号", "銀行口座"), F.greatest(tall * 0.20, F.lit(4.0))).otherwise(F.greatest(tall * 0.12, F.lit(3.0)))
    wide = {
        "x0": F.greatest("page_x0", F.col("x0") - tall * 0.08), "y0": F.greatest("page_y0", F.col("y0") - pad),
        "x1": F.least("page_x1", F.col("x1") + tall * 0.20), "y1": F.least("page_y1", F.col("y1") + pad),
    }
    r = r.withColumns(wide)
    tall, n, width = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)), F.length("text"), F.col("x1") - F.col("x0")
    short = F.when((kind == "氏名候補") & F.col("text").rlike("^[一-龯々〆ヵヶ]{1,3}さん$"), tall / 1.7 * F.greatest(n, F.lit(2)) * 1.10)
    digits = F.when((kind == "銀行口座") & F.col("text").rlike("^[0-9OIl]{7}$"), tall / 1.7 * n * 0.65)
    digits = digits.when((kind == "電話番号") & F.col("text").rlike("^[0O][0-9OIl]{1,3}[-ー−－]?[0-9OIl]{3,4}[-ー−－]?[0-9OIl]{4}$"), tall / 1.4 * n * 0.52)
    tight = {
        "x0": F.when(width > digits, F.greatest("page_x0", F.col("x1") - digits)).otherwise(F.col("x0")),
        "x1": F.when(width > short, F.least("page_x1", F.col("x0") + short)).otherwise(F.col("x1")),
    }
    r = r.withColumns(tight)
    inside = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.col("x0") >= F.col("page_x0") - 1) & (F.col("y0") >= F.col("page_y0") - 1)
    r = r.filter(inside & (F.col("x1") <= F.col("page_x1") + 1) & (F.col("y1") <= F.col("page_y1") + 1))
    place = [F.round(c, 1).alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")]
    first = r.groupBy("file_id", "page", "category", "status", "text", *place).agg(F.min_by(F.struct("start", "end", "x0", "y0", "x1", "y1"), "start").alias("v"))
    return first.select("file_id", "page", "category", "status", "text", "v.*")
