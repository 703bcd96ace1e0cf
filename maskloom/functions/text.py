"""Text helpers as column expressions; Arrow-backed functions only where Spark has no builtin."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Character variants and suffixes that alias keys fold.
KANJI_VARIANTS = ("髙﨑邊邉", "高崎辺辺")
HONORIFICS = ("さん", "様", "殿", "氏")
ROLE_SUFFIXES = ("さん", "様", "殿", "氏", "部長", "課長", "係長", "主任")
MISSING_WORDS = ("匿名希望", "なし", "無し", "不明", "未回答", "該当なし", "-", "－", "ー", "N/A", "NA")
PLACEHOLDER_KINDS = (
    "個人", "個人候補", "法人", "案件", "案件名称", "顧客", "受付", "社員", "会員", "仕入先", "組織", "住所",
    "予定日時", "伏字", "IP", "メール", "メール候補", "固定電話", "携帯", "電話", "金融機関",
)
PLACEHOLDER_SUFFIXES = ("さん", "様", "部長", "課長", "係長", "主任", "担当", "殿", "氏")


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(text: Column, ascii_only: bool = False) -> Column:
    """NFKC form. ASCII text is its own form, so a caller that knows its text to be ASCII stays in the JVM."""
    return text if ascii_only else F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_nfkc(text))


def normalize(text: Column, ascii_only: bool = False) -> Column:
    return F.regexp_replace(nfkc(text, ascii_only), r"(?U)^\s+|\s+$", "")


def compact(text: Column, ascii_only: bool = False) -> Column:
    return F.regexp_replace(normalize(text, ascii_only), r"(?U)\s+", "")


def ocr_normalize(text: Column) -> Column:
    """Compact text with one form of at sign and dash."""
    return F.regexp_replace(F.translate(compact(text), "＠", "@"), "[‐‑‒–—―−ー－]", "-")


def digits(text: Column, ascii_only: bool = False) -> Column:
    return F.regexp_replace(nfkc(text, ascii_only), "[^0-9]", "")


def number(text: Column, ascii_only: bool = False) -> Column:
    """Grouping commas, a yen sign in words and one trailing percent sign are dropped; null where no number is left."""
    plain = F.regexp_replace(F.regexp_replace(normalize(text, ascii_only), "[,円]", ""), "%$", "")
    return plain.try_cast("double")


def stringify(value: Column, kind: str) -> Column:
    return F.date_format(value, "yyyy-MM-dd") if kind in ("date", "timestamp") else value.cast("string")


def strip_honorific(text: Column) -> Column:
    return F.regexp_replace(text, "(?:" + "|".join(HONORIFICS) + ")$", "")


def alias_key(kind: Column, value: Column, ascii_only: bool = False) -> Column:
    """The form under which two values of a kind get one alias."""
    key = normalize(value, ascii_only)
    name = F.translate(
        F.regexp_replace(F.regexp_replace(key, r"(?U)\s+", ""), "(?:" + "|".join(ROLE_SUFFIXES) + ")$", ""), *KANJI_VARIANTS
    )
    address = F.regexp_replace(F.regexp_replace(key, r"(?U)\s+", ""), "[‐-―−ー－]", "-")
    low = F.lower(key)
    local = F.substring_index(F.substring_index(low, "@", 1), "+", 1)
    email = F.when(low.contains("@"), F.concat(local, F.lit("@"), F.regexp_extract(low, "^[^@]*@(.*)$", 1))).otherwise(low)
    return (
        F.when(kind == "name", name)
        .when(kind == "address", address)
        .when(kind == "email", email)
        .when(kind.isin("company", "ip"), low)
        .otherwise(key)
    )


def is_missing(value: Column) -> Column:
    return compact(value).isin(*MISSING_WORDS)


def is_placeholder(value: Column) -> Column:
    """Values that are aliases already."""
    kinds, ends = "|".join(PLACEHOLDER_KINDS), "|".join(PLACEHOLDER_SUFFIXES)
    return F.lower(value).endswith("@example.invalid") | value.rlike(rf"^(?:{kinds})\d{{3}}(?:{ends})?$")


def is_ambiguous_name(value: Column) -> Column:
    return (
        value.rlike(r"^[一-龯々〆ヵヶ]{1,3}(?:さん|様|殿|氏)$")
        | value.rlike(r"^[ぁ-ん]+(?:[ 　]+[ぁ-ん]+)?$")
        | value.rlike(r"^[A-Z]+(?:[ 　]+[A-Z]+)?$")
    )


def class_counts(text: Column) -> dict[str, Column]:
    """Counts of Japanese, alphanumeric, symbol and garbled characters."""
    return {
        "japanese": F.regexp_count(text, F.lit("[぀-ヿ一-鿿々〆〤]")),
        "alnum": F.regexp_count(text, F.lit("[A-Za-z0-9]")),
        "symbol": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")),
        "garble": F.regexp_count(text, F.lit(r"[\x{FFFD}■□\p{Co}]")),
    }


def hmac_sha256(key: bytes):
    """A column function giving the keyed digest of a text; the key stays in the closure and is never logged."""

    @F.pandas_udf(StringType())
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(key, v.encode(), hashlib.sha256).hexdigest())

    return digest


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity of two texts by their matching blocks."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")
