"""Helpers shared by the operators of this subpackage: workers' memory, files on shared storage, notes beside tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize, numbered, scratch, tidied

__all__ = ["discard", "materialize", "numbered", "scratch", "tidied"]  # and what follows


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of plans that are no longer referenced, and executors shrink their heaps.

    A JVM seldom gives memory back by itself, so the heap that one step grew would stand beside the next one's Python
    workers. Tasks of a collection each reach all executors, as every task keeps its slot for a while.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


_held: dict[str, dict] = {}


def held(operator: str) -> dict:
    """What a Python worker keeps of an operator between partitions, until another operator's comes."""
    return _held.setdefault(operator, {})


def trim_worker(operator: str | None = None) -> None:
    """Give a Python worker's freed memory back to the system at the end of a partition; workers are used again.

    What other operators keep in the worker goes too.
    """
    import pyarrow as pa

    for name, kept in _held.items():
        if name != operator:
            kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run, rows: int | None = 1000, operator: str | None = None):
    """``run`` over a partition's batches, cut to so many rows that few texts are Python objects at a time.

    None leaves batches as they are. Only what ``operator`` keeps stays in the worker.
    """

    def cut(batches):
        for b in batches:
            step = rows or max(1, b.num_rows)
            for at in range(0, b.num_rows, step):
                yield b.slice(at, step)

    def whole(batches):
        if any(kept for name, kept in _held.items() if name != operator):
            trim_worker(operator)
        yield from run(cut(batches))
        trim_worker(operator)

    return whole


def fs_and_path(uri: str):
    """A file system that Python on any executor can open, for a shared folder given as URI or plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Notes:
    """A small table (uid, ...) laid beside a large one whose rows were numbered by ``numbered``.

    Its rows are written in folders by the partition in a number's upper bits. A task of the large table reads the
    notes of the rows it meets from the shared folder: nothing of the large table is shuffled, and nothing is broadcast.
    """

    def __init__(self, table: DataFrame, name: str):
        spark = table.sparkSession
        self.path = scratch(spark, name)
        table.withColumn("pid", F.shiftright("uid", 33)).repartition("pid").write.partitionBy("pid").parquet(self.path)
        self.columns = [c for c in table.columns if c != "uid"]
        self.materialized_at, self.sparkSession = self.path, spark  # for ``discard``

    def reader(self):
        """A function of a uid that gives its note as a tuple, None where there is none; for one task."""
        import pyarrow.parquet as pq

        columns, path, held = self.columns, self.path, {"pid": None, "rows": {}}

        def load(pid: int) -> dict:
            files, root = fs_and_path(path)
            folder, rows = f"{root}/pid={pid}", {}
            from pyarrow import fs

            for info in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if info.base_name.endswith(".parquet"):
                    with files.open_input_file(info.path) as f:
                        t = pq.read_table(f, columns=["uid", *columns])
                    rows.update(zip(t["uid"].to_pylist(), zip(*(t[c].to_pylist() for c in columns)) if columns else [()] * t.num_rows))
            return rows

        def note(uid: int):
            if uid >> 33 != held["pid"]:
                held["pid"], held["rows"] = uid >> 33, load(uid >> 33)
            return held["rows"].get(uid)

        return note

    def __getstate__(self):
        return {"path": self.path, "columns": self.columns}


def crc32_text(column) -> F.Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes, null as the empty text."""
    return F.crc32(F.encode(F.coalesce(column, F.lit("")), "UTF-8"))
