"""Best-fit decreasing packing of tokenised documents into sequences of bounded length.

Best-fit decreasing takes the pieces from long to short and puts each into the open sequence with the least room
that still holds it; a segment tree over remaining capacities finds that room in logarithmic time. Lengths are
small integers, so the whole corpus enters the decision as a histogram of at most ``capacity`` counts, and pieces
of one length, like sequences of one remaining capacity, are moved as runs. The plan that comes out is exactly the
one of the document-by-document algorithm over the whole corpus; its size is bounded by ``capacity``, not by data.

Pieces then take their places by their rank among the pieces of their length: ranks are counted in buckets dealt
by a hash of the piece, so a length that a third of all pieces share is ranked by many tasks.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, materialize, trimmed

CAPACITY = 4096
END_ID = 1
CACHED_WORDS = 600_000  # about 120 MB a worker at most
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_SEPARATORS = "\x1c\x1d\x1e\x1f"
_LATIN_1 = re.compile("[\x00-\xff]*")


class WordTokens(dict):
    """Token ids of words, encoded when first asked for, in a bounded cache of two generations.

    The vocabulary file drops white space and never merges across it, so the ids of a text are those of its words in
    turn. Python also splits at U+001C to U+001F, which the file does not take for white space: such texts go to the
    tokenizer whole. The file lower-cases too, so texts of Latin-1 characters, where this is one character for one,
    are lower-cased first, unless they may hold the name of a special token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.older: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        if text.isascii() and text.isalpha() and text.islower():  # one word that normal forms and cuts leave as it is
            return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()  # no offsets

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:  # the file separates letters from what follows, so letters and marks are encoded apart
            stem = word.rstrip(string.punctuation)
            if len(stem) < len(word) and stem.isalpha():
                ids = self[stem] + self[word[len(stem) :]]
            else:
                ids = self._encode(word)
        self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text, the end id last."""
        end = END_ID.to_bytes(4, "little")
        if any(c in text for c in _SEPARATORS):
            return self._encode(text) + end
        if len(self) > CACHED_WORDS // 2:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, _folded(text).split())) + end


def _folded(text: str) -> str:
    if "<|" in text or not (text.isascii() or _LATIN_1.fullmatch(text)):
        return text
    return text.lower()


def word_tokens(path: str) -> WordTokens:
    loaded = held("packing")
    if path not in loaded:
        loaded[path] = WordTokens(path)
    return loaded[path]


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, CRC-32 of the piece's ids."""

    def cut(batches):
        tokens = word_tokens(vocabulary)
        for batch in batches:
            rows = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for doc_id, text in zip(ids, texts):
                whole = tokens.ids(text.as_py() or "")
                for piece, a in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[a : a + 4 * capacity]
                    rows.append((doc_id, piece, a // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(cut, operator="packing"), PIECES)


class RoomTree:
    """A segment tree over remaining capacities 0..capacity that finds the least one, at least x, with open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _update(self, r: int) -> None:
        i = r + self.size
        self.some[i] = bool(self.runs[r])
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def add(self, room: int, base: int, count: int) -> None:
        if count:
            self.runs[room].append((base, count))
            self._update(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._update(room)
        return run

    def tightest(self, x: int) -> int | None:
        i = x + self.size
        if self.some[i]:
            return x
        while i > 1:  # up to the first right sibling that holds something, then down its left edge
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, pieces a sequence, offset), and the number of sequences.

    Pieces of that length from that rank on fill the sequences from the first on, so many to each, from the offset.
    """
    tree, rows, opened = RoomTree(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                base, count = opened, -(-left // each)
                opened += count
            else:
                base, count = tree.take(room)
                each = room // length
            full = min(count, left // each)
            if full:
                rows.append((length, rank, base, each, capacity - room))
                tree.add(room - each * length, base, full)
                rank, left, base, count = rank + full * each, left - full * each, base + full, count - full
            if left and count:  # fewer than one sequence takes
                rows.append((length, rank, base, left, capacity - room))
                tree.add(room - left * length, base, 1)
                rank, left, base, count = rank + left, 0, base + 1, count - 1
            tree.add(room, base, count)
    return np.array(rows, np.int64).reshape(-1, 5), opened


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to written pieces."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan, _ = best_fit_plan(counts, capacity)
    first = {int(n): i for i, n in reversed(list(enumerate(plan[:, 0])))}
    buckets = max(64, sum(counts.values()) // 50_000)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranks = dealt.withColumn("nth", F.row_number().over(own) - 1).join(sizes, ["length", "bucket"])
    ranks = ranks.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches):
        for pdf in batches:
            n, rank = pdf["length"].to_numpy(np.int64), pdf.pop("rank").to_numpy(np.int64)
            seq, off = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            for length in np.unique(n):
                at = np.flatnonzero(n == length)
                mine = plan[first[int(length)] :]
                mine = mine[: np.searchsorted(-mine[:, 0], -length, "right")]
                run = mine[np.searchsorted(mine[:, 1], rank[at], "right") - 1]
                nth = rank[at] - run[:, 1]
                seq[at] = run[:, 2] + nth // run[:, 3]
                off[at] = run[:, 4] + nth % run[:, 3] * length
            yield pdf.assign(sequence_id=seq, offset=off)

    return ranks.mapInPandas(place, PIECES + ", sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    A null or empty text is one token, the end id. A document longer than ``capacity`` is cut into pieces of that
    length, the last one shorter; no other is cut. Rows with a null doc_id and repeated rows are packed like any
    other. No rows in: no rows out. Extra columns are ignored.
    """
    return pack_pieces(materialize(cut_pieces(docs, vocabulary, capacity), "packing-pieces"), capacity)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: all documents into sequences of at most 4096 tokens."""
    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
