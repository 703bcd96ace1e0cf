"""Packing: ids equal those of whole texts, the plan is best-fit decreasing, places are gapless."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from maskloom.llm.best_fit_packing import RoomTree, WordTokens, best_fit_pack, best_fit_plan, default_vocabulary


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, b in enumerate(bins) if b >= n]
        if fit:
            i = min(fit, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_equals_document_by_document(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan, opened = best_fit_plan(counts, 30)
    used = {}
    for n in counts:
        runs = [r for r in plan if r[0] == n]
        for rank in range(counts[n]):
            run = [r for r in runs if r[1] <= rank][-1]
            used.setdefault(run[2] + (rank - run[1]) // run[3], []).append((run[4] + (rank - run[1]) % run[3] * n, n))
    assert sorted(30 - sum(n for _, n in p) for p in used.values()) == plain_best_fit(lengths, 30)
    assert len(used) == opened
    for p in used.values():
        at = 0
        for off, n in sorted(p):
            assert off == at
            at += n


def test_tree_finds_the_tightest():
    t = RoomTree(100)
    for room in (7, 40, 99):
        t.add(room, 0, 1)
    assert [t.tightest(x) for x in (1, 7, 8, 41, 100)] == [7, 7, 40, 99, None]


TEXTS = ["", "Hello, World! it's 12345", "a\x1cb c d", "<|endoftext|>x", "İstanbul ΑΣ é é", "x_'s ab's. cd' e'' a1.", "!! && \n\t --", "ÀB ÖL. ß"]


def test_word_ids_equal_whole_text_ids():
    t, w = Tokenizer.from_file(default_vocabulary()), WordTokens(default_vocabulary())
    for x in TEXTS:
        assert w.ids(x) == np.array([*t.encode(x, add_special_tokens=False).ids, 1], np.uint32).tobytes()


def test_pieces_and_places(spark):
    t = Tokenizer.from_file(default_vocabulary())
    texts = [None, "", "one two three", "one two three", "word " * 50, *TEXTS]
    df = spark.createDataFrame([(i if i != 3 else None, x, "s", 9) for i, x in enumerate(texts)], "doc_id long, text string, length string, rank int")
    got = best_fit_pack(df, default_vocabulary(), capacity=16).collect()
    ids = {(i if i != 3 else None): np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], np.uint32) for i, x in enumerate(texts)}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 16 * r.piece and r.length == len(part) and zlib.crc32(part.tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in bins.values():
        at = 0
        for off, n in sorted(p):
            assert off == at
            at += n
        assert at <= 16
    assert len(bins) == len(plain_best_fit([r.length for r in got], 16))
    assert best_fit_pack(df.limit(0), default_vocabulary()).count() == 0


def test_words_are_encoded_without_offsets():
    from maskloom.llm.best_fit_packing import WordTokens, default_vocabulary

    tokens = WordTokens(default_vocabulary())
    text, whole = "Two words, \x1f é中😀 <|x|> it's 12.5\n", tokens.tokenizer

    class Fast:
        def encode_batch_fast(self, texts, **how):
            return whole.encode_batch_fast(texts, **how)

    tokens.tokenizer = Fast()  # nothing else is asked for
    for t in (text, text.replace("\x1f", "")):
        want = whole.encode(t, add_special_tokens=False).ids
        assert list(memoryview(tokens.ids(t)).cast("I")) == [*want, 1]


def test_plain_words_skip_normal_forms():
    tokens, whole = WordTokens(default_vocabulary()), Tokenizer.from_file(default_vocabulary())

    class Refuses:
        def encode_batch_fast(self, texts, **_):
            raise AssertionError(texts)

    words = ["a", "s", "ll", "the", "startoftext", "zqxjkv", "internationalization", "x" * 5000]
    want = np.array([i for w in words for i in whole.encode(w, add_special_tokens=False).ids] + [1], np.uint32).tobytes()
    tokens.tokenizer = Refuses()
    assert tokens.ids(" ".join(words)) == want and tokens.ids("  ".join(words).upper()) == want
