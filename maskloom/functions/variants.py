"""Other ways a known value may be written, as arrays; and generic rewrites of texts after masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits, normalize

# Character pairs, designators, romanised names, suffixes.
KANJI = (("髙", "高"), ("高", "髙"), ("邊", "辺"), ("邉", "辺"), ("辺", "邊"), ("﨑", "崎"))
ROMAN = {
    "サトウ": "SATO", "ハナコ": "HANAKO", "ヤマダ": "YAMADA", "タロウ": "TARO", "タカハシ": "TAKAHASHI", "イチロウ": "ICHIRO",
    "ワタナベ": "WATANABE", "ミサキ": "MISAKI", "ミナミ": "MINAMI", "アカリ": "AKARI", "モリ": "MORI", "タカナシ": "TAKANASHI", "シズク": "SHIZUKU",
}
ROLES = ("部長", "課長", "係長", "主任", "担当", "様", "殿", "氏")
_KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
_HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))


def _distinct(*values: Column) -> Column:
    return F.array_sort(F.filter(F.array_distinct(F.array(*values)), lambda v: v.isNotNull() & (v != "")))


def kanji_variants(text: Column) -> Column:
    return F.array(text, *[F.when(text.contains(a), F.replace(text, F.lit(a), F.lit(b))) for a, b in KANJI])


def name_variants(value: Column) -> Column:
    t = normalize(value)
    c = F.regexp_replace(t, r"(?U)\s+", "")
    kana = F.translate(t, _KATAKANA, _HIRAGANA)
    tokens = F.filter(F.split(t, r"(?U)\s+"), lambda p: p != "")
    roman = F.transform(tokens, lambda p: F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])[p])
    known = ~F.exists(roman, lambda r: r.isNull()) & (F.size(roman) > 0)
    full, family = F.array_join(roman, " "), F.get(roman, F.lit(0))
    spelled = F.array(*[F.when(known, x) for x in (full, F.initcap(full), family, F.initcap(family))])
    parts = F.concat(kanji_variants(t), kanji_variants(c), kanji_variants(F.get(tokens, F.lit(0))), F.array(kana, F.regexp_replace(kana, r"(?U)\s+", "")), spelled)
    return F.array_sort(F.filter(F.array_distinct(parts), lambda v: v.isNotNull() & (v != "")))


def role_variants(value: Column, alias: Column) -> Column:
    """array<struct<literal, alias>>: short family names with a role, and the alias with the same role."""
    t = normalize(value)
    pairs = F.array(*[F.struct(F.concat(t, F.lit(s)).alias("literal"), F.concat(alias, F.lit(s)).alias("alias")) for s in ROLES])
    return F.when(t.rlike("^[一-龯々〆ヵヶ]{1,3}$"), pairs).otherwise(F.slice(pairs, F.lit(1), F.lit(0)))


def organization_variants(value: Column) -> Column:
    t = normalize(value)
    c = F.regexp_replace(t, r"(?U)\s+", "")
    bare = F.regexp_replace(c, "^(?:株式会社|有限会社|合同会社|医療法人|学校法人|社会福祉法人)", "")
    bare = F.regexp_replace(bare, r"(?i)(?:株式会社|有限会社|合同会社|Inc\.?|Co\.?,?\s*Ltd\.?)$", "")
    return F.filter(_distinct(t, c, bare), lambda v: F.length(v) >= 2)


def phone_variants(value: Column) -> Column:
    t, d = normalize(value), digits(value)
    home = F.when(d.rlike("^81[789]0"), F.concat(F.lit("0"), F.substring(d, 3, 20)))
    abroad = F.when(
        d.rlike("^0[789]0"), F.concat(F.lit("+81-"), F.substring(d, 2, 2), F.lit("-"), F.substring(d, 4, 4), F.lit("-"), F.substring(d, 8, 20))
    )
    return _distinct(t, d, home, abroad)


def email_variants(value: Column) -> Column:
    t = normalize(value)
    low = F.lower(t)
    plain = F.when(low.rlike(r"^[^@]*\+[^@]*@"), F.regexp_replace(low, r"^([^+@]*)\+[^@]*@", "$1@"))
    return _distinct(t, low, plain)


def rewrite_generic(text: Column) -> Column:
    """Customer codes, rival letters and last digits that are left in running text."""
    code = F.regexp_replace(text, r"C0(\d{3})", "顧客$1")
    code = F.regexp_replace(code, r"C(\d{4})", "顧客$1")
    code = F.regexp_replace(code, "競合[A-ZＡ-Ｚ]社", "競合企業")
    return F.regexp_replace(code, "番号は下4桁が[0-9０-９]{4}", "番号は下4桁がXXXX")
