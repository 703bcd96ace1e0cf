"""Detection of sensitive spans: rule tables against text, without leaving the JVM.

All matches of a pattern and the text between them come from two builtins; running lengths give the offsets, in
code points. One row per text unit holds all its matches as an array, so no shuffle is needed to resolve them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import KINDS, LABELS, NOISE_NAMES, Rule

SPAN = "struct<start:int,end:int,category:string,score:double,rule:int,text:string>"


def match_offsets(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, text>>: every match of a pattern that cannot be empty, with its start.

    Two passes over the text: the matches, and what stands between them (one piece more than matches).
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    none = F.array().cast("array<struct<start:int,text:string>>")
    step = F.aggregate(
        F.arrays_zip(found.alias("m"), F.split(text, pattern, -1).alias("b")),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.when(x["m"].isNull(), acc).otherwise(
            F.struct(
                (acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["b"])).alias("start"), x["m"].alias("text")))).alias("out"),
            )
        ),
        lambda acc: acc["out"],
    )
    return F.coalesce(step, none)


def rule_spans(text: Column, rules: Iterable[Rule]) -> Column:
    """array of spans by all rules, in the order of the rules, then of the text."""
    return F.concat(*[_spans_of(text, r, i) for i, r in enumerate(rules)])


def _spans_of(text: Column, r: Rule, number: int) -> Column:
    pattern = r.flags + r.pattern

    def one(m: Column) -> Column:
        part = m["text"] if r.group == 0 else F.regexp_extract(m["text"], pattern, r.group)
        shift = F.lit(0) if r.group == 0 or r.leads else F.length(m["text"]) - F.length(part)
        start = (m["start"] + shift).cast("int")
        return F.struct(
            start.alias("start"), (start + F.length(part)).cast("int").alias("end"), F.lit(r.category).alias("category"),
            F.lit(r.score).alias("score"), F.lit(number).alias("rule"), part.alias("text"),
        )

    found = match_offsets(text, pattern)
    if r.needs:  # a plain search spares most texts the pattern
        found = F.when(text.rlike(r.needs), found).otherwise(F.array().cast("array<struct<start:int,text:string>>"))
    return F.transform(found, one).cast(f"array<{SPAN}>")


def _resized(x: Column, skip: Column, keep: Column) -> Column:
    start = x["start"] + skip
    return F.struct(
        start.cast("int").alias("start"), (start + keep).cast("int").alias("end"), x["category"].alias("category"),
        x["score"].alias("score"), x["rule"].alias("rule"), F.substring(x["text"], skip + 1, keep).alias("text"),
    )


def trim_span(x: Column) -> Column:
    """Cut honorifics off names, labels up to the last colon off anything, and verbs and labels off addresses."""
    t, n = x["text"], F.length(x["text"])
    is_name, is_address = x["category"] == "JP_NAME", x["category"] == "JP_ADDRESS"
    honorific = F.length(F.regexp_extract(t, "(?:さん|様|殿|氏)$", 0))
    label = F.length(F.regexp_extract(t, "^.*：[ 　]*(?=[^ 　])", 0))
    label = F.when(t.contains("："), label).otherwise(F.length(F.regexp_extract(t, "^.*:[ 　]*(?=[^ 　])", 0)))
    verb = F.regexp_extract(t, "^(.+?)(?:(?:に|へ)(?:資料|見積|送|連絡|お|打合せ|打ち合わせ)|(?:で)(?:打合せ|打ち合わせ))", 1)
    lead = F.length(F.regexp_extract(t, "^(?:住所は|住所|所在地|送付先|連絡先|に)[ 　:：]*(?=.)", 0))
    return (
        F.when(is_name & (honorific > 0) & (n > honorific), _resized(x, F.lit(0), n - honorific))
        .when(label > 0, _resized(x, label, n - label))
        .when(is_address & (verb != ""), _resized(x, F.lit(0), F.length(verb)))
        .when(is_address & (lead > 0), _resized(x, lead, n - lead))
        .otherwise(x)
    )


def is_noise(x: Column, text: Column) -> Column:
    t = F.trim(x["text"])
    address = (x["category"] == "JP_ADDRESS") & (t.rlike("^[0-9]{7,}$") | t.rlike(r"(?U)^(?:0|\+81)[0-9\-\s]{8,}$"))
    told = text.rlike("さん|様|My name is|名前は|氏名は|名義は")
    name = (x["category"] == "JP_NAME") & (t.isin(*NOISE_NAMES) | ((F.length(t) > 20) & ~told))
    when = t.rlike("[0-9０-９]{1,2}月[0-9０-９]{1,2}日[0-9０-９]{1,2}時")
    place = (x["category"] == "JP_ORGANIZATION") & (when | (t.contains("銀行") & t.contains("支店")))
    return address | name | place


def detect(df: DataFrame, rules: Iterable[Rule], text_col: str = "text", out: str = "spans", trim: bool = True) -> DataFrame:
    """Add the resolved spans of each text. Null and blank texts have none."""
    from .resolve import greedy

    text = F.col(text_col)
    spans = rule_spans(text, rules)
    if trim:
        spans = F.filter(F.transform(spans, trim_span), lambda x: ~is_noise(x, text))
    spans = F.filter(spans, lambda x: F.length(F.trim(x["text"])) >= 2)
    none = F.array().cast(f"array<{SPAN}>")
    return df.withColumn(out, F.when(F.trim(text) != "", F.coalesce(greedy(spans), none)).otherwise(none))


def label_of(category: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[category], category)


def kind_of(category: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[category], F.lit("text"))
