"""Line dedup by winnowing over line hashes.

The corpus is read as one sequence of non-blank lines, documents in the order of their ids. A passage of at least
``min_run`` consecutive lines of one document that also stands at an earlier place, in another document or further
up in the same one, is deleted at the later place; the first place keeps it. Lines are compared without white space
at their ends. Blank lines are skipped over when lines are compared and stay in the text.

With ``min_words``, a passage of fewer lines counts as well if it has that many words: each stretch of 1 to
``min_run`` - 1 lines with words enough is a fingerprint of its own, and from there on is treated as all others are.

Each gram of ``gram`` lines is hashed; of every ``window = min_run - gram + 1`` consecutive grams the smallest hash is
kept as fingerprint (the rightmost of equals), so any two equal runs of ``min_run`` lines hold the same fingerprint at
the same place. Only fingerprints that occur again are kept. No match is extended
line by line: each fingerprint carries the hashes of all stretches of ``min_run`` lines that chose it, and each stretch
whose fingerprint occurs again is looked up by its own hash for its first place. Overlapping later stretches make up a run, whole however long
it is. All of this is counting and taking minima by hash: no pairs are formed, and a line that very many documents
share is pre-aggregated before it is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Notes, discard, materialize, numbered, tidied, trimmed

MIN_RUN = 3
MIN_WORDS = 50
GRAM = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def split_lines(text: str) -> list[str]:
    return text.split("\n")


def line_hashes(lines: list[str]) -> np.ndarray:
    """64-bit hashes of lines without white space at their ends."""
    return np.array(
        [int.from_bytes(hashlib.blake2b(x.rstrip().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in lines],
        np.uint64,
    )


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """For every window of grams the place of its smallest, the rightmost of equals."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1)


def wordy(words: list[int], n: int, min_words: int) -> list[int]:
    """Starts of the stretches of n lines that have ``min_words`` words, given each line's."""
    upto = np.cumsum([0, *words])
    return np.flatnonzero(upto[n:] - upto[:-n] >= min_words).tolist()


def fingerprints(docs: DataFrame, min_run: int, gram: int, min_words: int | None = None) -> DataFrame:
    """(fp, doc_id, uid, stretches): chosen fingerprints with the stretches of lines (start, lines, hash) that chose them."""
    window = min_run - gram + 1

    def run(batches):
        for batch in batches:
            out = []
            ids, uids, texts = (batch.column(i).to_pylist() for i in range(3))
            for doc_id, uid, text in zip(ids, uids, texts):
                lines = [x for x in split_lines(text or "") if x.strip()]
                if len(lines) < min_run and min_words is None:
                    continue
                h = line_hashes(lines)
                grams = gram_hashes(h, gram)
                chosen, whole = winnow(grams, window), gram_hashes(h, min_run).view(np.int64)
                edge = np.flatnonzero(np.diff(chosen, prepend=-1))
                for a, b in zip(edge, [*edge[1:], len(chosen)]):
                    at = int(chosen[a])
                    out.append((int(grams[at].view(np.int64)), doc_id, uid, [{"s": int(i), "n": min_run, "h": int(whole[i])} for i in range(a, b)]))
                if min_words is not None:
                    words = [len(x.split()) for x in lines]
                    for n in range(1, min_run):
                        own = gram_hashes(h, n).view(np.int64)
                        out += [(int(own[i]), doc_id, uid, [{"s": i, "n": n, "h": int(own[i])}]) for i in wordy(words, n, min_words)]
            cols = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32()), ("h", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["fp", "doc_id", "uid", "stretches"])

    return docs.mapInArrow(trimmed(run), "fp long, doc_id long, uid long, stretches array<struct<s:int,n:int,h:long>>")


def repeated_stretches(docs: DataFrame, min_run: int = MIN_RUN, gram: int = GRAM, min_words: int | None = None) -> DataFrame:
    """(doc_id, uid, s, n): starts and lines of stretches that stand at an earlier place too."""
    fps = materialize(fingerprints(docs, min_run, gram, min_words), "lines-fingerprints")
    again = fps.groupBy("fp").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("fp")
    rows = fps.join(again, "fp").select("doc_id", "uid", F.explode("stretches").alias("x")).select("doc_id", "uid", "x.s", "x.n", "x.h")
    rows = materialize(rows, "lines-stretches")
    discard(fps)
    place = F.struct(F.col("doc_id").alias("d"), F.col("uid").alias("u"), F.col("s").alias("p"))
    first = rows.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("copies")).filter(F.col("copies") > 1)
    return rows.join(first.select("h", "first"), "h").filter(place > F.col("first")).select("doc_id", "uid", "s", "n")


def remove_lines(text: str | None, stretches: list[dict]) -> tuple[str | None, int, int, int]:
    """(kept text, non-blank lines, lines removed, runs) of one text, given stretches of its non-blank lines."""
    if text is None:
        return None, 0, 0, 0
    lines = split_lines(text)
    solid = [i for i, x in enumerate(lines) if x.strip()]
    gone = {i for x in stretches for i in range(x["s"], x["s"] + x["n"])}
    runs = sum(1 for i in gone if i - 1 not in gone)
    drop = {solid[i] for i in gone}
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), len(solid), len(gone), runs


def dedup_lines(docs: DataFrame, min_run: int = MIN_RUN, gram: int = GRAM, min_words: int | None = None) -> DataFrame:
    """All rows and columns of ``docs``, with the text without its later repeated runs.

    A run has ``min_run`` lines or, where ``min_words`` is given, that many words on however few lines.

    Columns ``__n_lines``, ``__n_removed`` and ``__n_runs`` are added. Null texts stay null; rows with a null doc_id
    come before all others; of repeated rows the first keeps its text. A document all of whose lines stand earlier
    keeps an empty text. No rows in: no rows out. Other columns pass through, but for the names
    ``__uid``, ``__starts`` and those above, which are taken. A text of any size is one row of one task.
    """
    keyed = numbered(docs, "__uid", "lines-documents")
    slim = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__uid").alias("uid"), F.col("text").cast("string"))
    with tidied(docs.sparkSession) as kept:
        starts = repeated_stretches(slim, min_run, gram, min_words).groupBy("uid").agg(F.collect_set(F.struct("s", "n")).alias("starts"))
        marks = kept(Notes(starts, "lines-repeats"))
    names, out = docs.columns, docs
    text_at, uid_at = keyed.columns.index("text"), keyed.columns.index("__uid")
    counts = ["__n_lines", "__n_removed", "__n_runs"]
    for c in counts:
        out = out.withColumn(c, F.lit(0).cast("long"))

    def cut(batches):
        mark = marks.reader()
        for batch in batches:
            uids, texts = batch.column(uid_at).to_pylist(), batch.column(text_at).to_pylist()
            got = [remove_lines(t, (mark(u) or ([],))[0]) for u, t in zip(uids, texts)]
            cols = list(zip(*got)) or [()] * 4
            columns = list(batch.columns)
            columns[text_at] = pa.array(cols[0], columns[text_at].type)
            del columns[uid_at]
            columns += [pa.array(c, pa.int64()) for c in cols[1:]]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *counts])

    return keyed.mapInArrow(trimmed(cut), out.schema)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, lines and runs removed, and the SHA-256 of the kept text."""
    return _counts(spark, sf_dir, None)


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, where runs of at least 50 words on one or two lines are removed too."""
    return _counts(spark, sf_dir, MIN_WORDS)


def _counts(spark: SparkSession, sf_dir: str, min_words: int | None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string").alias("text"))
    return dedup_lines(docs, min_words=min_words).select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_removed").alias("n_removed"),
        F.col("__n_runs").alias("n_runs"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


#: The same rule over stretches of lines as text, without fingerprints.
OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents
), solid AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE regexp_replace(line, '\s+$', '') <> ''
), w AS (
  SELECT doc_id, p, regexp_replace(line, '\s+$', '') || chr(10)
         || lead(regexp_replace(line, '\s+$', ''), 1) OVER d || chr(10)
         || lead(regexp_replace(line, '\s+$', ''), 2) OVER d AS stretch
  FROM solid WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), later AS (
  SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY stretch ORDER BY doc_id, p) AS n FROM w WHERE stretch IS NOT NULL) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, p + k AS p FROM later, (VALUES (0), (1), (2)) AS t(k)
), marked AS (
  SELECT l.doc_id, l.i, l.line, s.p, g.p IS NOT NULL AS gone,
         g.p IS NOT NULL AND g2.p IS NULL AS starts
  FROM l LEFT JOIN solid s ON s.doc_id = l.doc_id AND s.i = l.i
         LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.p = s.p
         LEFT JOIN gone g2 ON g2.doc_id = s.doc_id AND g2.p = s.p - 1
)
SELECT doc_id, CAST(count(p) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       CAST(count(*) FILTER (WHERE starts) AS BIGINT) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
