"""The kernel against its definition, tolerance of inserted characters, held-out accuracy, odd rows."""

import itertools
import zlib

import numpy as np
import pytest

from maskloom.llm.toxicity import DECAY, Landmarks, fit, op10_toxicity, subsequence_kernel, train, with_scores, words_of

TYPE = "doc_id long, text string, score string, held_out int"


def kernel(s, t, p):
    total = 0.0
    for i in itertools.combinations(range(len(s)), p):
        for j in itertools.combinations(range(len(t)), p):
            if [s[a] for a in i] == [t[b] for b in j]:
                total += DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


@pytest.mark.parametrize("t", ["scum", "s-c-um", "sxcuum", "abc", "mucs", "sscumm"])
def test_kernel_is_the_gap_weighted_subsequence_kernel(t):
    codes = {c: i + 1 for i, c in enumerate("scum")}
    row = np.zeros((1, 8), np.int16)
    row[0, : len(t)] = [codes.get(c, 0) for c in t]
    assert np.isclose(subsequence_kernel(np.array([1, 2, 3, 4]), row, 3)[0], kernel("scum", t, 3), rtol=1e-5)


def test_values_prefer_near_words():
    m = Landmarks(["nastyword"])
    v = lambda t: m.documents([t])[0, 0]
    assert v("so nastyword there") == 1.0
    assert v("n a s t y w o r d now") == v("n.a.s.t.y.w.o.r.d") == 1.0
    assert 0.3 < v("nasxtyword") < 1.0
    assert v("completely other text") == v("") == 0.0
    assert v("x" * 500 + "nastyword" + "y" * 500) > 0.9


def test_spelled_words():
    assert "idle" in words_of("so i d l e now")


def sample(n, rng):
    texts, labels = [], []
    for _ in range(n):
        w = [f"word{rng.integers(200)}" for _ in range(30)]
        toxic = rng.random() < 0.2
        if toxic:
            w[rng.integers(30)] = rng.choice(["nastyword", "vileness", "grobian"])
        texts.append(" ".join(w))
        labels.append(int(toxic))
    return texts, np.array(labels)


def test_learns_and_tolerates_insertions():
    rng = np.random.default_rng(1)
    texts, y = sample(600, rng)
    m = fit(texts, y, (int((y == 0).sum()), int((y == 1).sum())))
    t, z = sample(300, rng)
    assert ((m.score(t) >= 0.5) == z).mean() > 0.98
    clean = "word1 word2 word3 %s word4"
    assert all(m.score([clean % w])[0] >= 0.5 for w in ("vileness", "vil-eness", "v i l e n e s s", "grobi.an"))
    assert m.score([clean % "word9"])[0] < 0.5


def test_one_class_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1), (2, None, "x", 1)], TYPE)
    for rows, low in (([], True), ([(1, 0), (2, 0)], True), ([(1, None), (None, 1)], True)):
        model = train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        got = [r.score for r in with_scores(docs, model).collect()]
        assert len(got) == 2 and all(0 <= s < 0.5 for s in got) == low


def test_query_columns_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op10_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    assert np.mean([p == y for p, y in held]) > 0.93


def test_empty_table(spark):
    docs = spark.createDataFrame([], TYPE)
    assert with_scores(docs, train(docs, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
