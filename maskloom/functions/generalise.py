"""Generalisation and masking of values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits, normalize, number

# Names and maps that replacements are made of.
PREFECTURE = (
    "北海道|東京都|京都府|大阪府|"
    "(?:青森|岩手|宮城|秋田|山形|福島|茨城|栃木|群馬|埼玉|千葉|神奈川|新潟|富山|石川|福井|山梨|長野|岐阜|静岡|愛知|三重|滋賀|兵庫|奈良|和歌山|鳥取|島根|岡山|広島|山口|徳島|香川|愛媛|高知|福岡|佐賀|長崎|熊本|大分|宮崎|鹿児島|沖縄)県"
)
CITY_PREFECTURES = {"名古屋市": "愛知県", "大阪市": "大阪府", "大津市": "滋賀県", "静岡市": "静岡県", "高山市": "岐阜県", "札幌市": "北海道"}
ENGLISH_ADDRESSES = {"tokyo-to minato-ku": "東京都港区", "tokyo minato-ku": "東京都港区", "minato-ku": "東京都港区"}
DEPARTMENTS = (
    ("商品開発", "商品開発"), ("研究開発", "研究開発"), ("情報システム", "情報システム"), ("海外事業", "海外事業"),
    ("Finance", "財務"), ("財務", "財務"), ("営業", "営業"), ("総務", "管理"), ("管理", "管理"), ("企画", "企画"),
    ("製造", "製造"), ("工場", "製造"),
)
EXECUTIVES = ("代表", "取締役", "CFO", "CEO", "COO")
MANAGERS = ("部長", "課長", "主任", "工場長")
RATINGS = {"A": "高評価", "B": "標準", "C": "要支援"}
_PLACE = "[一-龯ぁ-んァ-ヶー]"


def first_contained(text: Column, pairs, otherwise: Column) -> Column:
    """The replacement of the first marker that the text contains."""
    out = None
    for marker, replacement in pairs:
        hit = text.contains(marker)
        out = F.when(hit, replacement) if out is None else out.when(hit, replacement)
    return otherwise if out is None else out.otherwise(otherwise)


def contains_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def bucket_bounds(value: Column, width: Column) -> tuple[Column, Column]:
    low = (F.floor(value / width) * width).cast("long")
    return low, (low + width).cast("long")


def estimate_width(value: Column, limit: int = 5_000_000) -> Column:
    return F.when(value >= limit, F.lit(5_000_000)).otherwise(F.lit(1_000_000))


def amount_range(value: Column, limit: int) -> Column:
    """A range in units of ten thousand yen, wider from ``limit`` on."""
    low, high = bucket_bounds(value, estimate_width(value, limit))
    man = lambda x: F.format_number(F.floor(x / 10_000), 0)
    return F.when(value.isNull(), "金額範囲不明").otherwise(F.concat(man(low), F.lit("万～"), man(high), F.lit("万円")))


def yen_range(value: Column, width: int) -> Column:
    low, high = bucket_bounds(value, F.lit(width))
    whole = lambda x: F.format_number(x, 0)
    return F.when(value.isNull(), "金額範囲不明").otherwise(F.concat(whole(low), F.lit("～"), whole(high - 1), F.lit("円")))


def salary_band(value: Column, unknown: str = "給与範囲不明") -> Column:
    return F.when(value.isNull(), unknown).otherwise(F.concat((F.floor(value / 100_000) * 10).cast("string"), F.lit("万円台")))


def rate_floor(value: Column) -> Column:
    percent = F.when(value <= 1, value * 100).otherwise(value)
    return (F.floor(percent / 10) * 10).cast("long")


def rate_band(value: Column) -> Column:
    return F.when(value.isNull(), "率不明").otherwise(F.concat(rate_floor(value).cast("string"), F.lit("％台")))


def year_of(text: Column) -> Column:
    found = F.regexp_extract(normalize(text), r"((?:19|20)\d{2})", 1)
    return F.when(found != "", found.cast("int"))


def decade(year: Column, unknown: str) -> Column:
    return F.when(year.isNull(), unknown).otherwise(F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("年代")))


def week_of_month(day: Column) -> Column:
    """Weeks end on the 3rd, 10th, 17th, 24th and 31st."""
    d = F.dayofmonth(day)
    return F.when(d <= 3, 1).otherwise((F.floor((d - 4) / 7) + 2).cast("int")).cast("int")


def week_bucket(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("年"), F.month(day).cast("string"), F.lit("月第"), week_of_month(day).cast("string"), F.lit("週"))


def rating(text: Column) -> Column:
    out = F.lit("評価情報あり")
    for grade, label in RATINGS.items():
        out = F.when(F.trim(text) == grade, label).otherwise(out)
    return out


def dependents(value: Column) -> Column:
    return F.when(value > 0, "あり").otherwise("なし")


def care_info(text: Column, analysis: bool) -> Column:
    if not analysis:
        return F.when(F.trim(text) == "", "").otherwise("要配慮情報あり")
    return (
        F.when(F.trim(text) == "", "")
        .when(contains_any(text, ("育児", "短時間", "時短", "在留資格")), text)
        .when(text.contains("通院"), "通院に伴う勤務配慮あり")
        .when(contains_any(text, ("腰痛", "病", "けが", "怪我")), "身体的配慮あり")
        .otherwise("要配慮情報あり")
    )


def department(text: Column, analysis: bool) -> Column:
    t = normalize(text)
    if analysis:
        return F.when(t == "南工場", "工場").otherwise(t)
    return first_contained(t, DEPARTMENTS, F.regexp_replace(t, "(部|課|室)$", ""))


def role(text: Column) -> Column:
    t = normalize(text)
    return F.when(contains_any(t, EXECUTIVES), "経営者").when(contains_any(t, MANAGERS), "管理職").when(t == "担当", "担当者").otherwise(t)


def generalise_address(text: Column) -> Column:
    """Prefecture, city and ward; empty where none is found."""
    t = normalize(text)
    c = F.regexp_replace(t, r"(?U)\s+", "")
    whole = F.regexp_extract(c, f"(?:{PREFECTURE}){_PLACE}+?市(?:{_PLACE}+?区)?", 0)
    ward = F.regexp_extract(c, f"(?:{PREFECTURE}){_PLACE}+?区", 0)
    hint = F.lit("")
    for city, prefecture in reversed(CITY_PREFECTURES.items()):
        found = F.regexp_extract(c, f"{city}(?:{_PLACE}+?区)?", 0)
        hint = F.when(c.contains(city), F.concat(F.lit(prefecture), found)).otherwise(hint)
    out = F.when(whole != "", whole).when(ward != "", ward).otherwise(hint)
    return first_contained(F.lower(t), ENGLISH_ADDRESSES.items(), out)


def prefecture_only(text: Column) -> Column:
    t = normalize(text)
    found = F.regexp_extract(t, PREFECTURE, 0)
    rest = generalise_address(text)
    out = F.when(found != "", found).otherwise(first_contained(t, CITY_PREFECTURES.items(), F.when(rest != "", rest).otherwise(t)))
    return F.when(contains_any(F.lower(t), ENGLISH_ADDRESSES), "東京都").otherwise(out)


def mask_postal(text: Column, ascii_only: bool = False) -> Column:
    d = digits(text, ascii_only)
    return F.when(F.length(d) >= 3, F.concat(F.substring(d, 1, 3), F.lit("-XXXX"))).otherwise("XXX-XXXX")


def mask_phone(text: Column, ascii_only: bool = False) -> Column:
    """Area and last digits stay; Japanese international and mobile forms have their own shapes."""
    t, d = normalize(text, ascii_only), digits(text, ascii_only)
    national = F.regexp_replace(F.substring(d, 3, 100), "^0", "")
    last = F.right(national, F.lit(4))
    area = F.when(national.rlike("^[36]"), 1).otherwise(2)
    abroad = F.when(
        national.rlike("^[789]0") & (F.length(national) >= 10), F.concat(F.lit("+81-"), F.substring(national, 1, 2), F.lit("-XXXX-"), last)
    ).otherwise(
        F.concat(F.lit("0"), F.left(national, area), F.lit("-"), F.repeat(F.lit("X"), F.greatest(F.lit(3), F.length(national) - area - 4)), F.lit("-"), last)
    )
    parts = F.filter(F.split(t, "[^0-9+]+"), lambda p: p != "")
    n = F.size(parts)
    return (
        F.when(t.startswith("+81"), abroad)
        .when((F.length(d) == 11) & d.rlike("^0[789]0"), F.concat(F.substring(d, 1, 3), F.lit("-XXXX-"), F.right(d, F.lit(4))))
        .when(n >= 3, F.concat(F.get(parts, F.lit(0)), F.lit("-"), F.repeat(F.lit("X"), F.length(F.get(parts, n - 2))), F.lit("-"), F.get(parts, n - 1)))
        .when(F.length(d) >= 10, F.concat(F.substring(d, 1, 3), F.lit("-"), F.repeat(F.lit("X"), F.length(d) - 7), F.lit("-"), F.right(d, F.lit(4))))
        .otherwise("電話番号")
    )


def phone_class(text: Column, ascii_only: bool = False) -> Column:
    return F.when(digits(text, ascii_only).rlike("^(?:0[789]0|81[789]0)"), "mobile_phone").otherwise("landline_phone")


def mask_personal_number(text: Column, analysis: bool) -> Column:
    return F.repeat(F.lit("*"), F.greatest(F.lit(12), F.length(digits(text)))) if analysis else F.lit("非表示")


def mask_bank_account(text: Column, bank_alias: Column) -> Column:
    """Bank alias, what stands between, and the last three digits; other text loses its long digit runs."""
    t = normalize(text)
    pattern = r"(?i)^(.+?(?:銀行|信用金庫|Bank))\s*(.*?)([0-9]{4,})$"
    account = F.regexp_extract(t, pattern, 3)
    rest = F.trim(F.regexp_extract(t, pattern, 2))
    masked = F.trim(F.concat(bank_alias, F.lit(" "), rest, F.lit(" ****"), F.right(account, F.lit(3))))
    return F.when(account != "", masked).otherwise(F.regexp_replace(t, "[0-9]+(?<=[0-9])([0-9]{3})(?![0-9])", "****$1"))


def email_alias(alias: Column, analysis: bool) -> Column:
    return F.concat(F.lit("mail"), F.regexp_extract(alias, r"(\d{3})$", 1), F.lit("@example.invalid")) if analysis else alias


def replacement(kind: Column, value: Column, alias: Column, analysis: bool = True) -> Column:
    """One expression for every kind of value, given the alias of the value's own kind."""
    n = number(value)
    hidden = F.lit("非表示")
    whole = generalise_address(value)
    return (
        F.when(kind == "address", F.when(whole != "", whole).otherwise(alias) if analysis else prefecture_only(value))
        .when(kind == "emergency_name", alias if analysis else hidden)
        .when(kind == "email", email_alias(alias, analysis))
        .when(kind.isin("phone", "landline_phone", "mobile_phone"), mask_phone(value) if analysis else alias)
        .when(kind == "emergency_phone", mask_phone(value) if analysis else hidden)
        .when(kind == "postal_code", mask_postal(value) if analysis else F.lit("XXX-XXXX"))
        .when(kind == "personal_number", mask_personal_number(value, analysis))
        .when(kind == "bank_account", mask_bank_account(value, alias) if analysis else F.lit("金融情報を削除"))
        .when(kind == "ip", alias if analysis else hidden)
        .when(kind == "secret", "********")
        .when(kind == "estimate_amount", amount_range(n, 5_000_000))
        .when(kind == "cost_amount", amount_range(n, 10_000_000))
        .when(kind == "salary_50k", salary_band(n))
        .when(kind == "bonus_100k", salary_band(n, "賞与範囲不明"))
        .when(kind == "rate_10", rate_band(n))
        .when(kind == "birth_date", decade(year_of(value), "年代不明"))
        .when(kind == "hire_date", decade(year_of(value), "入社年不明"))
        .when(kind == "reception_datetime", F.coalesce(week_bucket(F.try_to_date(value)), normalize(value)))
        .when(kind == "rating", rating(value))
        .when(kind == "dependents", dependents(n))
        .when(kind == "care_info", care_info(value, analysis))
        .when(kind == "secret_memo", value if analysis else F.lit("社外秘情報を削除"))
        .when(kind == "boss_memo", value if analysis else F.lit("人事メモを削除"))
        .when(kind == "department", department(value, analysis))
        .when(kind == "role", value if analysis else role(value))
        .otherwise(alias)
    )
