"""Sampled segmentations: exact round trips, distinct, Gumbel top-k's probabilities, odd rows."""

import math
from collections import Counter

import numpy as np
import pytest

from maskloom.llm.gumbel_segments import Lattice, Segmenter, default_vocabulary, op5_segments, sample_segmentations


@pytest.fixture(scope="module")
def segmenter():
    return Segmenter(default_vocabulary(), 0.2)


def all_paths(s, text):
    lat = Lattice(s, [text])
    out = {}

    def walk(at, ids, logp):
        if at == lat.length:
            out[tuple(ids)] = logp
        else:
            for e in np.flatnonzero(lat.place == at):
                walk(int(lat.end[e]), [*ids, int(lat.piece[e])], logp + lat.logp[e])

    walk(0, [], 0.0)
    return out


def test_probabilities_and_inclusion(segmenter):
    paths = all_paths(segmenter, "the ab")
    assert math.isclose(sum(map(math.exp, paths.values())), 1.0)
    n, first, within, weight = 6000, Counter(), Counter(), 0.0
    for seed in range(n):
        got = segmenter.sample("the ab", 3, seed)
        assert len({tuple(g[0]) for g in got}) == 3 and [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)
        first[tuple(got[0][0])] += 1
        weight += sum(math.exp(g[1]) / g[3] for g in got)
        for g in got:
            within[tuple(g[0])] += 1
            assert math.isclose(g[1], paths[tuple(g[0])], abs_tol=1e-9)
    lp = np.array(list(paths.values()))
    noisy = lp + np.random.default_rng(0).gumbel(size=(40_000, len(lp)))
    share = dict(zip(paths, np.bincount(np.argsort(-noisy, axis=1)[:, :3].ravel(), minlength=len(lp)) / 40_000))
    for p, logp in paths.items():
        assert abs(first[p] / n - math.exp(logp)) < 0.03
        assert abs(within[p] / n - share[p]) < 0.03
    assert abs(weight / n - 1) < 0.05  # inclusion scores make sums over samples unbiased


def test_fewer_paths_than_asked(segmenter):
    got = segmenter.sample("\n\n", 5, 1)
    assert len(got) == 1 and got[0][3] == 1.0
    assert len(segmenter.sample("a", 5, 1)) == len(all_paths(segmenter, "a"))


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "é中😀 x", "a\tb\n", "x" * 300, "<s> </s>", "word " * 200])
def test_round_trip(segmenter, text):
    got = segmenter.sample(text, 4, 9)
    assert got and all(segmenter.decode(g[0]) == text for g in got)


def test_rows(spark, sf):
    df = spark.createDataFrame([(1, 0, "hello there", 5), (1, 0, "hello there", 6), (2, 0, None, 7), (None, None, "hello there", 8)], "conv_id long, turn long, text string, sample int")
    got = sample_segmentations(df, default_vocabulary(), ["conv_id", "turn"], k=2).collect()
    same = Counter((r.sample, tuple(r.ids), r.perturbed) for r in got if r.conv_id == 1)
    assert set(same.values()) == {2} and len(same) == 2
    assert [(r.sample, r.ids, r.inclusion) for r in got if r.conv_id == 2] == [(1, [], 1.0)]
    assert sample_segmentations(df.limit(0), default_vocabulary(), ["conv_id", "turn"]).count() == 0
    q = op5_segments(spark, sf)
    assert q.filter("not round_trip").count() == 0
    again = {tuple(map(str, r)) for r in op5_segments(spark, sf).collect()}
    assert again == {tuple(map(str, r)) for r in q.collect()}


def test_all_documents_are_segmented(spark, sf):
    want = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_segments(spark, sf).groupBy("doc_id").agg({"sample": "max"}).collect()
    assert {r.doc_id for r in got} == want
    assert max(r["max(sample)"] for r in got) == 4


def test_texts_together_are_sampled_as_if_alone(segmenter):
    texts = ["the ab", "", "word " * 50, "é中😀 x", "", "x" * 300, "a"]
    seeds = [3, 4, 5, 6, 7, 8, 9]
    for text, seed, got in zip(texts, seeds, segmenter.samples(texts, 4, seeds)):
        alone = segmenter.sample(text, 4, seed)
        assert [(g[0].tolist(), g[1], g[2], g[3]) for g in got] == [(g[0].tolist(), g[1], g[2], g[3]) for g in alone]


def test_lattice_holds_every_piece(segmenter):
    text = "ab  the é😀word\n the"
    whole = "▁" + text.replace(" ", "▁")
    lat = Lattice(segmenter, [text])
    want = {(i, j) for i in range(len(whole)) for j in range(i + 1, len(whole) + 1) if whole[i:j] in segmenter.pieces and "▁" not in whole[i:j].lstrip("▁")}
    want |= {(i, i + 1) for i, c in enumerate(whole) if c not in segmenter.pieces}
    assert set(zip(lat.place.tolist(), lat.end.tolist())) == want


def test_very_long_text(segmenter):
    text = "long words " * 20_000
    got = segmenter.sample(text, 2, 1)
    assert len(got) == 2 and all(segmenter.decode(g[0]) == text for g in got)


def test_chunks_are_kept_across_batches(segmenter, monkeypatch):
    from maskloom.llm import gumbel_segments as G

    s = Segmenter(default_vocabulary(), 0.2)
    first = s.samples(["the word, the word. ab"], 4, [1])
    known = len(s.book.number)
    assert known == 5 and s.book.used["first"] - 1 == len("▁the▁word,.▁ab")  # each chunk once
    again = s.samples(["the ab word", "the word, the word. ab"], 4, [2, 1])
    assert len(s.book.number) == known
    monkeypatch.setattr(G, "BOOK_CHARS", 3)
    anew = s.samples(["the ab, é", "the word, the word. ab"], 4, [3, 1])  # begun anew
    for got in (again[1], anew[1]):
        assert [(g[0].tolist(), *g[1:]) for g in got] == [(g[0].tolist(), *g[1:]) for g in first[0]]


def test_siblings_far_along_a_path_are_not_lost(segmenter, monkeypatch):
    from maskloom.llm import gumbel_segments as G

    texts = ["the word " * 60, "x" * 300, "\n" * 100 + "word", "中" * 90 + "ab"]
    want = segmenter.samples(texts, 4, [1, 2, 3, 4])
    for n in (1, 10**6):  # looked at first: one place, or all
        monkeypatch.setattr(G, "FIRST_PLACES", n)
        got = segmenter.samples(texts, 4, [1, 2, 3, 4])
        assert [[(g[0].tolist(), *g[1:]) for g in x] for x in got] == [[(g[0].tolist(), *g[1:]) for g in x] for x in want]


def test_full_book_keeps_its_first_chunks(segmenter, monkeypatch):
    from maskloom.llm import gumbel_segments as G

    built = Counter()

    class Counting(Lattice):
        def __init__(self, s, texts, chunks=False):
            built.update(texts)
            super().__init__(s, texts, chunks)

    texts = ["the word, the other word", "a b c d e f g h", "the word i j k l m n", "the é q r s t"]
    want = [segmenter.sample(t, 4, 7) for t in texts]
    monkeypatch.setattr(G, "Lattice", Counting)
    monkeypatch.setattr(G, "BOOK_CHARS", 24)  # overflows from the second text on
    s = Segmenter(default_vocabulary(), 0.2)
    for t, w in [*zip(texts, want), *zip(texts, want)]:
        assert [(g[0].tolist(), *g[1:]) for g in s.sample(t, 4, 7)] == [(g[0].tolist(), *g[1:]) for g in w]
    assert built["▁the"] == built["▁word"] == 1 and built["▁b"] == 2
    for _ in range(40):  # in the end it begins anew
        s.sample("the x y z words of later texts", 1, 1)
        s.sample("u v w of other texts", 1, 1)
    assert built["▁the"] > 1


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "é中😀 x", "a\tb\n", "<s> </s>", "\x00\x7f ▁ ▁", "word " * 50])
def test_spelt_as_the_model_decodes(segmenter, text):
    got = [ids[:n] for ids, *_ in segmenter.sample(text, 4, 3) for n in (len(ids), max(0, len(ids) - 1))]
    spelt = segmenter.spelt(np.concatenate(got), np.array([len(ids) for ids in got]))
    assert spelt[::2] == [segmenter.decode(ids).encode() for ids in got[::2]]
    assert [x == text.encode() for x in spelt] == [segmenter.decode(ids) == text for ids in got]


def test_texts_are_cut_where_no_piece_reaches(segmenter):
    texts = ["  the word,the  中文!!\n", "", " ", "a▁b  ", "\ud800é😀😀x\n\n y", "..."]
    parts, which, n = segmenter.book.chunks(texts)
    assert len(set(parts)) == len(parts) and list(dict.fromkeys(which.tolist())) == list(range(len(parts)))
    whole, at = ["▁" + t.replace(" ", "▁") for t in texts], 0
    pieces = {p.lstrip("▁") for p in segmenter.pieces}
    beside = {(a, b) for p in pieces for a, b in zip(p, p[1:])}
    for t, size in zip(whole, n.tolist()):
        cut = [parts[i] for i in which[at : at + size].tolist()]
        at += size
        assert "".join(cut) == t and all("▁" not in c.lstrip("▁") for c in cut)
        assert not any((a[-1], b[0]) in beside or a[-1] == "▁" for a, b in zip(cut, cut[1:]))
    assert at == len(which) and [parts[i] for i in which[:7].tolist()] == ["▁▁▁the", "▁word", ",", "the", "▁▁中", "文", "!!"]


def test_equal_chunks_of_a_batch_are_looked_up_once(segmenter):
    s, asked = Segmenter(default_vocabulary(), 0.2), Counter()

    class Asked(dict):
        def get(self, key, *other):
            asked[key] += 1
            return super().get(key, *other)

    s.book.number = Asked()
    text = "the word " * 200
    assert [g[0].tolist() for g in s.sample(text, 2, 5)] == [g[0].tolist() for g in segmenter.sample(text, 2, 5)]
    assert asked == {"▁the": 1, "▁word": 1, "▁": 1}


def test_draws_do_not_depend_on_a_place_s_number(segmenter, monkeypatch):
    from maskloom.llm import gumbel_segments as G

    monkeypatch.setattr(G, "BITS", 58)  # a place's number before so many bits was too large from place 32 on, of 40 bits from 8,388,608 on
    for text in ("x" * 300, "the word of many places " * 20):
        s = Segmenter(default_vocabulary(), 0.2)
        got = s.sample(text, 4, 9)
        assert len({tuple(g[0].tolist()) for g in got}) == 4 and all(s.decode(g[0]) == text for g in got)
