"""Consistent pseudonyms: one alias for each key of a kind within a scope, numbered by first appearance.

Numbers need a total order of first appearances. Keys are distinct by an aggregation first; they are then ranked
within ranges of their order, so that one scope with very many keys is numbered by many tasks, and the counts of
earlier ranges, one row each, are added. Ranges come from the order's own values, so every job sees the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Prefixes of aliases.
PREFIXES = {
    "name": "個人", "name_candidate": "個人候補", "email": "メール", "email_candidate": "メール候補", "address": "住所",
    "customer_id": "顧客", "ticket_id": "受付", "company": "法人", "supplier": "仕入先", "project_id": "案件", "project": "案件名称",
    "member_id": "会員", "employee_id": "社員", "ip": "IP", "landline_phone": "固定電話", "mobile_phone": "携帯", "phone": "電話",
    "financial_institution": "金融機関", "schedule": "予定日時", "organization": "組織", "text": "伏字",
}


def alias_text(kind: Column, number: Column) -> Column:
    prefix = F.coalesce(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])[kind], F.lit("伏字"))
    return F.concat(prefix, F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))


def order_range(order: str, schema, size: int) -> Column:
    """A coarse value that ascends with an order: of whole numbers their multiple of ``size``, of times the day, of
    texts the first characters, of structs that of the first field."""
    kind, at = schema[order].dataType, F.col(order)
    while kind.typeName() == "struct":
        at, kind = at[kind.fields[0].name], kind.fields[0].dataType
    name = kind.typeName()
    if name in ("byte", "short", "integer", "long"):
        return F.floor(at / size)
    if name in ("timestamp", "timestamp_ntz", "date"):
        return F.to_date(at)
    if name == "string":
        return F.substring(at, 1, 4)
    raise TypeError(f"no ranges for an order of type {name}")


def first_appearances(values: DataFrame, scope: list[str], order: str = "ord") -> DataFrame:
    """(scope, kind, norm_key, ord): keys with the smallest order they appear at."""
    return values.groupBy(*scope, "kind", "norm_key").agg(F.min(order).alias("ord"))


def number_aliases(firsts: DataFrame, scope: list[str], extra: DataFrame | None = None, range_size: int = 1_000_000) -> DataFrame:
    """(scope, kind, norm_key, alias_no, alias). ``extra`` holds allocations (scope, kind, ord) that use up a number.

    Ranks are taken within ranges of the order, and counts of earlier ranges are added.
    """
    keys = [*scope, "kind"]
    events = firsts.select(*keys, "norm_key", "ord", F.lit(0).alias("taken"))
    if extra is not None:
        events = events.unionByName(extra.select(*keys, F.lit(None).cast("string").alias("norm_key"), "ord", F.lit(1).alias("taken")))
    ranged = events.withColumn("__r", order_range("ord", firsts.schema, range_size))
    sizes = ranged.groupBy(*keys, "__r").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy(*keys, "__r").orderBy("ord", "taken", "norm_key")
    size = sizes.withColumnRenamed("__r", "__s")
    on = [ranged[k] == size[k] for k in keys] + [ranged["__r"].eqNullSafe(size["__s"])]  # a null order is a range too
    out = ranged.withColumn("__i", F.row_number().over(own)).join(size, on).drop(*[size[k] for k in keys])
    out = out.filter(F.col("taken") == 0).withColumn("alias_no", (F.col("__before") + F.col("__i")).cast("int"))
    return out.select(*keys, "norm_key", "alias_no", alias_text(F.col("kind"), F.col("alias_no")).alias("alias"))


def with_aliases(values: DataFrame, scope: list[str], extra: DataFrame | None = None) -> DataFrame:
    """Values (scope, kind, norm_key, ord, ...) with their alias."""
    book = number_aliases(first_appearances(values, scope), scope, extra)
    return values.join(book, [*scope, "kind", "norm_key"], "left")


def merge_books(old: DataFrame, new_keys: DataFrame, scope: list[str]) -> DataFrame:
    """Grow an alias book: known keys keep their number, new ones go on from the last of their kind."""
    keys = [*scope, "kind"]
    fresh = new_keys.join(old.select(*keys, "norm_key"), [*keys, "norm_key"], "left_anti")
    last = old.groupBy(*keys).agg(F.max("alias_no").alias("__last"))
    numbered = number_aliases(fresh, scope).join(last, keys, "left")
    no = F.col("alias_no") + F.coalesce("__last", F.lit(0))
    return old.unionByName(numbered.select(*keys, "norm_key", no.cast("int").alias("alias_no"), alias_text(F.col("kind"), no).alias("alias")))
