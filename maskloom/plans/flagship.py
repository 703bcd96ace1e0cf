"""Detect, resolve, pseudonymise and mask the sensitive spans of a table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.generalise import mask_postal
from ..functions.text import alias_key
from ..operators.alias import first_appearances, number_aliases
from ..operators.detect import detect, kind_of
from ..operators.resolve import apply_edits
from ..operators.rules import PROFILES, Rule
from ..storage import materialize


def mask_texts(docs: DataFrame, rules: tuple[Rule, ...] = PROFILES["plain"], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_spans, masked_text). Aliases are numbered by (id, start); null and repeated ids are rows of their own.

    Texts are scanned once and written with their spans, because numbering needs all spans before the first mask; only
    texts with spans meet the alias book again, and the others never leave their task.
    """
    numbered = docs.select(id_col, text_col, F.monotonically_increasing_id().alias("__uid"))
    found = materialize(detect(numbered, rules, text_col), "mask-found")
    some = found.filter(F.size("spans") > 0)
    flat = some.select(id_col, "__uid", F.explode("spans").alias("x")).select(
        id_col, "__uid", "x.start", "x.end", F.col("x.text").alias("value"), kind_of(F.col("x.category")).alias("kind")
    )
    flat = flat.withColumn("norm_key", alias_key(F.col("kind"), F.col("value")))
    ordered = materialize(flat.withColumn("ord", F.struct(id_col, "__uid", "start")), "mask-spans")
    fixed = F.col("kind").isin("postal_code", "personal_number")  # masked by their digits, whatever their alias
    book = number_aliases(first_appearances(ordered, []), [])
    digits_of = F.regexp_replace("value", "[^0-9]", "")
    replacement = (
        F.when(F.col("kind") == "postal_code", mask_postal(F.col("value")))
        .when(F.col("kind") == "personal_number", F.repeat(F.lit("*"), F.greatest(F.lit(12), F.length(digits_of))))
        .otherwise(F.col("alias"))
    )
    slim = ordered.drop("ord")
    aliased = slim.filter(~fixed).join(book, ["kind", "norm_key"], "left").unionByName(slim.filter(fixed), allowMissingColumns=True)
    edits = aliased.select("__uid", "start", "end", replacement.alias("replacement"))
    edits = edits.groupBy("__uid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("edits"))
    masked = some.select("__uid", id_col, text_col).join(edits, "__uid").select(id_col, F.size("edits").alias("n_spans"), apply_edits(F.col(text_col), F.col("edits")).alias("masked_text"))
    plain = found.filter(F.size("spans") == 0).select(id_col, F.lit(0).alias("n_spans"), F.col(text_col).alias("masked_text"))
    return masked.unionByName(plain)
