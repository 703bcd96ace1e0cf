"""Tables written to the folder that the driver and all executors share, to be read again by later jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FILES = 100_000  # files of a table whose names are broadcast

_own_folder: dict[str, str] = {}
_open: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share, as a full URI.

    Where that setting is missing, a single machine gets a temporary folder instead; on a cluster that would lose data,
    so it is an error. Folders that results depend on stay until whoever owns the checkpoint folder clears it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder.setdefault("base", "file://" + tempfile.mkdtemp(prefix="maskloom-"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    full = path.getFileSystem(conf).makeQualified(path).toString()
    for made in _open:
        made.append(full)
    return full


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts lineage with a table that outlives any executor; nothing is kept in executor memory.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote, once all that follows from it is written too."""
    delete(df.sparkSession, df.materialized_at)


@contextmanager
def tidied(spark: SparkSession):
    """Delete at the end whatever was written within, but for the tables handed to the function this gives."""
    made: list[str] = []
    kept: set[str] = set()
    _open.append(made)

    def keep(df):
        kept.add(df.materialized_at)
        return df

    try:
        yield keep
    finally:
        _open.remove(made)
        for path in made:
            if path not in kept:
                delete(spark, path)


def _is_scan(df: DataFrame) -> bool:
    """Whether a frame has one row for each row of a scan that passes its filters."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.child()
    return node.nodeName() in ("LogicalRelation", "Relation parquet") or node.nodeName().startswith("Relation")


def numbered(df: DataFrame, uid: str, name: str) -> DataFrame:
    """``df`` with a number for each row that is the same in every job, whatever executors come and go.

    Rows of Parquet files are numbered by file and place in the file, without a copy. Other tables, and those of more
    than ``MOST_FILES`` files, are written with their numbers. The upper bits tell file or part, as ``Notes`` needs.
    """
    spark = df.sparkSession
    place: Callable = lambda: df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__nth"))
    if _is_scan(df):
        try:
            files = place().select("__file").distinct().limit(MOST_FILES + 1).collect()
        except AnalysisException:
            files = []
        if 0 < len(files) <= MOST_FILES:
            order = spark.createDataFrame([(f, i) for i, f in enumerate(sorted(r[0] for r in files))], "__file string, __n long")
            out = place().join(F.broadcast(order), "__file")
            return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.shiftleft("__n", 33) + F.col("__nth")).alias(uid))
    return materialize(df.withColumn(uid, F.monotonically_increasing_id()), name)
