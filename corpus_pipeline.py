"""A training corpus from ``documents`` in five stages: toxicity, line dedup, near duplicates, repeated strings, packing.

Every stage takes what its predecessor wrote, works on all of it, and returns the columns it was given (the last one
returns packed pieces). ``n_chars``, where there is such a column, follows the text.

For all stages: a null text is an empty one and stays null; no rows in give no rows out; rows with a null doc_id take
part and come before all others; extra columns are kept, whatever
their names but for those that begin with two underscores. A text of any size is one row of one
task. What a stage says on ties and repeated rows is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm.best_fit_packing import best_fit_pack, default_vocabulary
from maskloom.llm.common import discard, materialize, numbered, release
from maskloom.llm.jaccard_join import jaccard_components
from maskloom.llm.line_winnowing import MIN_WORDS, dedup_lines
from maskloom.llm.repeated_bytes import remove_repeats
from maskloom.llm.toxicity import train, with_scores

#: Bytes of a repeated string: some 50 words of four letters and a space.
REPEAT_BYTES = 250


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half, by a model of the labelled ones among them.

    Empty and null texts are scored like others; repeated rows get one score, so all stay or all go.
    """
    release(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_scores(docs, model, score_col="__toxicity").filter(F.col("__toxicity") < 0.5).drop("__toxicity")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of three lines, or of 50 words on fewer, that stand earlier in the corpus.

    Earlier is by doc_id, then by the order of rows. Documents all of whose lines stand earlier go, so of repeated rows
    one stays; those without words stay as they are.
    """
    release(spark)
    out = dedup_lines(docs, min_words=MIN_WORDS).filter((F.col("__n_lines") == 0) | (F.col("__n_removed") < F.col("__n_lines")))
    return _counted(out, docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, or of equal ones, the one with the smallest doc_id.

    Of those with one doc_id the first row stays. Texts without words are linked with nothing and all stay.
    """
    release(spark)
    keyed = numbered(docs, "__uid", "pipeline-numbered")
    slim = keyed.select(F.col("__uid").alias("doc_id"), "text")
    groups = jaccard_components(slim).select(F.col("doc_id").alias("__uid"), F.col("component_id").alias("__group"))
    ids = keyed.select("doc_id", "__uid").join(groups, "__uid")
    first = ids.groupBy("__group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__uid")).alias("__first"))
    return keyed.join(first.select(F.col("__first.__uid").alias("__uid")), "__uid", "left_semi").select(*docs.columns)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of ``REPEAT_BYTES`` bytes that stand at an earlier place too; the first place keeps them.

    Earlier is by doc_id, then by the order of rows, then within the text. Documents left without words go, so of
    repeated rows one stays; those that had no words stay as they are.
    """
    release(spark)
    words = r"(?U)\S"
    marked = docs.withColumn("__full", F.coalesce(F.col("text").rlike(words), F.lit(False)))
    out = remove_repeats(marked, length=REPEAT_BYTES, keep="first").filter(~F.col("__full") | F.col("text").rlike(words))
    return _counted(out, docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens, one piece at least for each row."""
    release(spark)
    return best_fit_pack(docs, default_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_near_copies),
    ("suffix_array_dedup", drop_repeated_strings),
    ("best_fit_packing", pack),
]

#: A kernel machine, winnowing and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again before the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
