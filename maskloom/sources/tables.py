"""CSV and JSON sources, and page layouts given as word tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "file_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, block int, line int, word_no int"
REVIEW_STATE = (
    "schema string, input_sha256 string, last_page int, pages array<struct<page_number:int,page_review_state:string,verification_state:string>>, "
    "findings array<struct<id:string,page_number:int,enabled:boolean,replacement:string,original_hmac_sha256:string>>"
)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text; a byte order mark does not become part of the first name."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORDS).parquet(path)


def read_review_state(spark: SparkSession, path: str, source_sha256: str) -> tuple[DataFrame, DataFrame]:
    """(pages, findings) of a saved state; rows of another source are refused."""
    doc = spark.read.schema(REVIEW_STATE).option("multiLine", True).json(path)
    ok = doc.filter(F.col("input_sha256") == source_sha256)
    if ok.isEmpty():
        raise ValueError("the saved state belongs to another source")
    return ok.select(F.explode("pages").alias("p")).select("p.*"), ok.select(F.explode("findings").alias("f")).select("f.*")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(split, page) from a JSON object of named page lists."""
    doc = spark.read.option("multiLine", True).json(path)
    lists = [f.name for f in doc.schema.fields if f.dataType.typeName() == "array"]
    parts = [doc.select(F.lit(n).alias("split"), F.explode(F.col(n).cast("array<int>")).alias("page")) for n in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def page_mode(pages: DataFrame, text: str = "text", spans: str = "n_spans", least: int = 20) -> DataFrame:
    """Pages with enough text and spans go by their text layer, others by recognised words."""
    return pages.withColumn("mode", F.when((F.length(text) >= least) & (F.col(spans) > 0), "text").otherwise("ocr"))


def quarantine(files: DataFrame, flags: list[str]) -> tuple[DataFrame, DataFrame]:
    """(usable, refused with reasons): files with any of the boolean flags set are set aside."""
    reasons = F.array_join(F.filter(F.array(*[F.when(F.col(f), f) for f in flags]), lambda r: r.isNotNull()), ";")
    marked = files.withColumn("reasons", reasons)
    return marked.filter("reasons = ''").drop("reasons"), marked.filter("reasons <> ''")
