"""Toxicity by a subsequence-string-kernel support vector machine with Nyström landmarks.

The gap-weighted subsequence kernel counts the character subsequences of some length that two strings share, each
weighted by a decay to the power of the stretch it covers. An insult with characters put in, or with an ending it
was not trained with, still shares most of its subsequences. A text has two kernel values with a landmark: that of
its best matching word, so that one insult is as visible in a long text as in a short one, and the sum over its
distinct words up to ``ENOUGH``, since some beginnings are harmless once and telling when they recur. Words are
lower-cased and lose what is no letter or digit; single characters spelled out with spaces count as one word.

Landmarks are strings of the labelled texts' sentences, word beginnings that tell the classes apart. Kernel values
with them, whitened by the landmarks' own kernel matrix (Nyström), are the features of a linear machine with squared
hinge loss; a logistic curve over its margins gives scores between 0 and 1.

Training rows are a bounded sample (``max_train_rows``, half for each label, chosen by a hash of the id); counts of
labels are taken over all rows. The model is a few kilobytes and travels with the scoring function.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import trimmed

DECAY = 0.8
LENGTH = 4  # of the shared subsequences; shorter landmarks use one less than their own length
POWER = 3  # of kernel values, itself a kernel: near matches keep some value, faint ones hardly any
ENOUGH = 4.0
FAINT = 0.15  # weaker values count as 0: chance likenesses, of which a long text has many
SHARED = 0.7  # a word with fewer of a landmark's distinct characters has kernel value 0 with it
WIDTHS = (10, 16, 32)  # words are compared in groups of like length; longer ones in overlapping windows
SURE = 0.9
RARE = 0.003  # at most this share of the clean documents has a value of SURE or more with a telling landmark
_SENTENCE = re.compile(r"[.!?\n]+")
_DROP = re.compile(r"[\W_]+")
_SPELLED = re.compile(r"(?<!\S)\w(?:[\W_]{0,2} \w){2,}(?!\S)")


def words_of(text: str) -> set[str]:
    """Distinct words of a text, and spelled-out runs of single characters as words."""
    low = text.lower()
    out = set(low.split())
    for run in _SPELLED.findall(low):
        out.add(_DROP.sub("", run))
    return out


def _padded(words: list[str], alphabet: np.ndarray, width: int) -> np.ndarray:
    """Character numbers (1.. in the alphabet, 0 for any other) of words, one row a word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    at = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
    ids = np.where(alphabet[at] == codes, at + 1, 0).astype(np.int16)
    out = np.zeros((len(words), width), np.int16)
    row = np.repeat(np.arange(len(words)), lens)
    out[row, np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)] = ids
    return out


def subsequence_kernel(landmark: np.ndarray, words: np.ndarray, length: int, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of one string with each row of ``words`` (0 matches nothing).

    e[j] holds, for every place in the words, the weight of common subsequences that end there and at landmark
    place j; one more character is added by decayed sums over earlier places of both strings.
    """
    n, width = words.shape
    gap = np.arange(width)[None, :] - np.arange(width)[:, None] - 1
    later = np.where(gap >= 0, decay ** np.maximum(gap, 0), 0).astype(np.float32)
    match = [(words == c).astype(np.float32) * decay**2 for c in landmark]
    e = match
    for _ in range(length - 1):
        acc, nxt = np.zeros((n, width), np.float32), []
        for j in range(len(landmark)):
            nxt.append(match[j] * (acc @ later))
            acc = decay * acc + e[j]
        e = nxt
    return sum(e).sum(axis=1)


@dataclass
class Landmarks:
    """Strings with their character numbers and the kernel values of words with them, relative to their own."""

    strings: list[str]
    alphabet: np.ndarray = field(init=False)

    def __post_init__(self):
        self.alphabet = np.array(sorted({ord(c) for s in self.strings for c in s}) or [0], np.uint32)
        self.codes = [_padded([s], self.alphabet, len(s))[0] for s in self.strings]
        self.length = [min(LENGTH, len(s) - 1) for s in self.strings]
        self.own = [subsequence_kernel(c, c[None, :], p)[0] for c, p in zip(self.codes, self.length)]
        self.bits = [int(np.bitwise_or.reduce(np.uint64(1) << (c % 64).astype(np.uint64))) for c in self.codes]

    def values(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words with any value, their values): kernel values over a landmark's own, at most 1."""
        parts, owner = [], []
        for i, w in enumerate(words):
            if len(w) <= WIDTHS[-1]:
                parts.append(w)
                owner.append(i)
            else:
                for a in range(0, len(w) - WIDTHS[-1] // 2, WIDTHS[-1] // 2):
                    parts.append(w[a : a + WIDTHS[-1]])
                    owner.append(i)
        owner = np.array(owner, np.int64)
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        found_rows, found_cols, found = [], [], []
        low = 2
        for width in WIDTHS:
            at = np.flatnonzero((lens > low) & (lens <= width))
            low = width
            if not len(at):
                continue
            ids = _padded([parts[i] for i in at], self.alphabet, width)
            has = np.where(ids > 0, np.uint64(1) << (ids % 64).astype(np.uint64), np.uint64(0))
            has = np.bitwise_or.reduce(has, axis=1)
            for col, (code, p, own, bits) in enumerate(zip(self.codes, self.length, self.own, self.bits)):
                need = math.ceil(SHARED * bits.bit_count())
                near = np.flatnonzero(np.bitwise_count(has & np.uint64(bits)) >= need)
                if len(near):
                    k = np.minimum(subsequence_kernel(code, ids[near], p) / own, 1.0) ** POWER
                    some = k >= FAINT
                    found_rows.append(owner[at[near[some]]])
                    found_cols.append(np.full(int(some.sum()), col))
                    found.append(k[some])
        if not found:
            return np.zeros(0, np.int64), np.zeros((0, len(self.strings)), np.float32)
        rows, cols = np.concatenate(found_rows), np.concatenate(found_cols)
        some, place = np.unique(rows, return_inverse=True)
        out = np.zeros((len(some), len(self.strings)), np.float32)
        np.maximum.at(out, (place, cols), np.concatenate(found))
        return some, out

    def documents(self, texts: list[str], at_a_time: int = 1000) -> np.ndarray:
        """Kernel values of whole texts with each landmark: of the best word, then summed over distinct words."""
        n = len(self.strings)
        out = np.zeros((len(texts), 2 * n), np.float32)
        if not self.strings:
            return out
        for a in range(0, len(texts), at_a_time):
            sets = [words_of(t) if t else set() for t in texts[a : a + at_a_time]]
            raw = list(set().union(*sets))
            clean = [w if w.isalnum() else _DROP.sub("", w) for w in raw]
            some, values = self.values(clean)
            best = {raw[i]: values[j] for j, i in enumerate(some)}
            keys = best.keys()
            for i, words in enumerate(sets):
                hit = words & keys
                if hit:
                    got = np.array([best[w] for w in hit])
                    out[a + i, :n] = got.max(axis=0)
                    out[a + i, n:] = np.minimum(got.sum(axis=0), ENOUGH) / ENOUGH
        return out


def choose_landmarks(texts: list[str], labels: np.ndarray, count: int, least_z: float = 4.0) -> list[str]:
    """Word beginnings whose share of documents differs most between the labels, none the beginning of another."""
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    if not n1 or not n0:
        return []

    def starts(text: str) -> set[str]:
        words = {_DROP.sub("", w) for w in words_of(text)}
        return {w[:n] for w in words for n in range(4, min(len(w), 12) + 1)}

    toxic, clean = Counter(), Counter()
    for t, y in zip(texts, labels):
        if y == 1:
            toxic.update(starts(t))
    toxic = Counter({s: n for s, n in toxic.items() if n >= 3})
    for t, y in zip(texts, labels):
        if y == 0:
            clean.update(s for s in starts(t) if s in toxic)
    z = {}
    for s, n in toxic.items():
        p = (n + clean[s]) / (n1 + n0)
        z[s] = (n / n1 - clean[s] / n0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)
    chosen: list[str] = []
    gap = {s: round(toxic[s] / n1 - clean[s] / n0, 9) for s in z if z[s] >= least_z}
    for s in sorted(gap, key=lambda s: (-gap[s], -len(s), s)):
        if len(chosen) == count:
            break
        if not any(s.startswith(c) or c.startswith(s) for c in chosen):
            chosen.append(s)
    return chosen


def fit_squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Weights of the linear machine, bias last, by Newton steps on the squared hinge loss."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    reg = ridge * np.eye(x1.shape[1])
    reg[-1, -1] = 1e-6
    w, active = np.zeros(x1.shape[1]), None
    for _ in range(steps):
        now = y * (x1 @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        a, c = x1[active], weight[active]
        w = np.linalg.solve(reg + a.T @ (c[:, None] * a), a.T @ (c * y[active]))
    return w


def fit_logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic curve over margins, with a little smoothing of the labels."""
    n1, n0 = weight[y > 0].sum(), weight[y < 0].sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ab = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        g = x.T @ (weight * (p - target)) + 1e-6 * ab
        h = x.T @ ((weight * p * (1 - p))[:, None] * x) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        ab = ab - step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(max(ab[0], 0.0)), float(ab[1])


def whitened(values: np.ndarray, whiten: np.ndarray) -> np.ndarray:
    """Nyström features: each of the two blocks of kernel values by the inverse root of the landmarks' matrix."""
    n = len(whiten)
    return np.hstack([values[:, :n].astype(np.float64) @ whiten, values[:, n:].astype(np.float64) @ whiten])


@dataclass
class ToxicityModel:
    landmarks: Landmarks
    whiten: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def score(self, texts: list[str]) -> np.ndarray:
        phi = whitened(self.landmarks.documents(texts), self.whiten)
        margin = phi @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def telling_sentences(texts: list[str], rare: list[str]) -> tuple[list[str], np.ndarray]:
    """Sentences of toxic texts that hold a landmark hardly seen in clean ones, each text's with weights of sum 1.

    They are toxic by themselves. Without them an insult that comes with others in most training texts would count
    for little where it stands alone.
    """
    out, weights = [], []
    for t in texts if rare else []:
        found = []
        for s in _SENTENCE.split(t):
            if any(_DROP.sub("", w).startswith(tuple(rare)) for w in s.lower().split()):
                found.append(s)
        out += found
        weights += [1 / len(found) for _ in found]
    return out, np.array(weights)


def fit(texts: list[str], labels: np.ndarray, totals: tuple[int, int], landmarks: int = 64) -> ToxicityModel:
    """Fit on sampled rows; ``totals`` are the counts of labels 0 and 1 over all training rows."""
    marks = Landmarks(choose_landmarks(texts, labels, landmarks))
    n0, n1 = totals
    if not marks.strings:  # one class only, or nothing that tells them apart: the share of label 1
        p = min(max((n1 / (n0 + n1)) if n0 + n1 else 0.0, 1e-6), 1 - 1e-6)
        return ToxicityModel(marks, np.zeros((0, 0)), np.zeros(1), 0.0, math.log(p / (1 - p)))
    gram = np.zeros((len(marks.strings),) * 2)
    for j, (code, p, own) in enumerate(zip(marks.codes, marks.length, marks.own)):
        width = max(map(len, marks.strings))
        gram[:, j] = subsequence_kernel(code, _padded(marks.strings, marks.alphabet, width), p) / own
    gram = np.minimum((gram + gram.T) / 2, 1.0) ** POWER
    values, vectors = np.linalg.eigh(gram)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-2)) @ vectors.T
    whole = marks.documents(texts)
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, n1 / max(1, (labels == 1).sum()), n0 / max(1, (labels == 0).sum()))
    share = share / share.mean()
    rare = (whole[labels == 0, : len(marks.strings)] >= SURE).mean(axis=0) < RARE
    extra, part = telling_sentences([t for t, k in zip(texts, labels) if k == 1], [s for s, r in zip(marks.strings, rare) if r])
    phi = whitened(np.vstack([whole, marks.documents(extra)]), whiten)
    w = fit_squared_hinge(phi, np.append(y, np.ones(len(extra))), np.append(share, part * share[labels == 1].mean()))
    margin = phi[: len(texts)] @ w[:-1] + w[-1]
    slope, shift = fit_logistic(margin, y, share)
    return ToxicityModel(marks, whiten, w, slope, shift)


def held_out(doc_id) -> F.Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = 4000, max_train_chars: int = 200_000) -> ToxicityModel:
    """Fit on labelled rows outside the held-out fold.

    Rows of ``labels`` with a null id or label take no part; an id labelled twice counts as toxic if once so
    labelled. The sample has at most ``max_train_rows`` ids, half of each label, the first by a hash of the id, so it
    may be broadcast and collected; of rows with one doc_id the text that sorts first is taken, and texts of more than
    ``max_train_chars`` characters are not learnt from. Without labels of both kinds the model gives every text the
    share of label 1.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).withColumn("place", F.xxhash64("doc_id"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    half = max_train_rows // 2
    picked = [known.filter(F.col("label") == x).orderBy("place", "doc_id").limit(half) for x in (0, 1)]
    picked = picked[0].unionByName(picked[1]).select("doc_id", "label")
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.length("text") <= max_train_chars)
    rows = text.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = rows.select("doc_id", "text", "label").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit(rows["text"].to_pylist(), rows["label"].to_numpy(), (totals.get(0, 0), totals.get(1, 0)))


def with_scores(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` (one named ``score_col`` is replaced) and the score of each whole text.

    Null and empty texts get the score of a text without any landmark.
    """
    docs = docs.drop(score_col)
    text_at = docs.columns.index(text_col)
    schema = docs.withColumn(score_col, F.lit(0.0)).schema

    def score(batches):
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            got = pa.array(model.score(texts), pa.float64()) if texts else pa.array([], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(trimmed(score), schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: every whole text of ``documents``, learnt from four fifths of the labelled rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string").alias("text"))
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_scores(docs, model)
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
