"""Line runs, shingle sets and repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from maskloom.llm import jaccard_join
from maskloom.llm.jaccard_join import OP6_SQL, jaccard_components, op6_jaccard, units_needed
from maskloom.llm.line_winnowing import OP2_SQL, dedup_lines, op2_lines, op2_passages
from maskloom.llm.prefix_free import SuffixOrder
from maskloom.llm.repeated_bytes import keyed_texts, kept_texts, op7_repeats, removals, remove_repeats

TYPE = "doc_id long, text string, fp string, n int, uid int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, 8) for i, t in rows], TYPE)


def words(rng, n, vocab=4000):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def test_lines_match_sql(spark, sf):
    from compare import same

    same(op2_lines(spark, sf), OP2_SQL, sf)


def test_lines_small(spark):
    run = "a\nb\nc\nd"
    rows = [(1, f"x\n{run}\ny"), (2, f"{run}"), (3, "a\nb"), (4, f"z\na \n\nb\nc"), (5, None), (6, ""), (7, "q\nq\nq\nq\nq"), (2, run)]
    got = Counter((r.doc_id, r.text, r.fp) for r in dedup_lines(frame(spark, rows)).collect())
    want = [(1, f"x\n{run}\ny"), (2, ""), (2, ""), (3, "a\nb"), (4, "z\n"), (5, None), (6, ""), (7, "q")]
    assert got == Counter((i, t, "clash") for i, t in want)
    assert dedup_lines(frame(spark, [])).count() == 0


def brute_lines(rows, min_run=3, min_words=50):
    docs = sorted((i, [x.rstrip() for x in (t or "").split("\n") if x.strip()]) for i, t in rows)
    seen, gone = set(), {i: set() for i, _ in docs}
    for i, lines in docs:
        for at in range(len(lines)):
            for n in range(1, min_run + 1):
                run = tuple(lines[at : at + n])
                if len(run) == n and (n == min_run or sum(len(x.split()) for x in run) >= min_words):
                    if run in seen:
                        gone[i] |= set(range(at, at + n))
                    seen.add(run)
    return {i: (len(lines), len(gone[i])) for i, lines in docs}


def lines_left(rows, min_run=3, min_words=50):
    """Each text by id without the lines of runs that stand earlier."""
    seen, left = set(), {}
    for doc_id, text in sorted(rows):
        lines = (text or "").split("\n")
        solid = [i for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for at in range(len(solid)):
            for n in range(1, min_run + 1):
                run = tuple(lines[i].rstrip() for i in solid[at : at + n])
                if len(run) == n and (n == min_run or sum(len(x.split()) for x in run) >= min_words):
                    if run in seen:
                        gone |= set(solid[at : at + n])
                    seen.add(run)
        left[doc_id] = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return left


def test_long_passages_on_few_lines(spark, sf):
    rng = random.Random(7)
    line, half, rest, short = (" ".join(words(rng, n)) for n in (50, 30, 20, 49))
    rows = [(1, line), (2, line), (3, f"x\n{line} \ny"), (4, f"{half}\n\n{rest}"), (5, f"u\n{half}\n{rest}"), (6, half), (7, short), (8, short)]
    got = {r.doc_id: r.text for r in dedup_lines(frame(spark, rows), min_words=50).collect()}
    assert got == {1: line, 2: "", 3: "x\ny", 4: rows[3][1], 5: "u", 6: half, 7: short, 8: short}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in op2_passages(spark, sf).collect()} == brute_lines(docs)


def components(rows):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def near_copies(rng):
    rows, n = [], 0
    for size in (1, 3, 5, 6, 7, 8, 9, 12, 20, 40, 90, 200):
        base = words(rng, size)
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + size // 12)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
            if rng.random() < 0.3:
                w = w + words(rng, rng.randrange(0, 1 + size // 6))
            rows.append((n, " ".join(w)))
            n += 1
    passage = words(rng, 60)
    for _ in range(40):
        rows.append((n, " ".join(words(rng, rng.randrange(1, 40)) + passage + words(rng, rng.randrange(1, 30)))))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, rows[0][1].upper()), (n + 4, "é É ß"), (n + 5, rows[40][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_all_pairs(spark, seed):
    rows = near_copies(random.Random(seed))
    got = sorted(tuple(r) for r in jaccard_components(frame(spark, rows)).collect())
    assert got == components(rows)


@pytest.mark.parametrize("share", [2, 8])
def test_jaccard_with_few_segments(spark, monkeypatch, share):
    """With too few segments the one-deletion neighbourhoods and the exact way for the rest must find all links."""
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    rows = [r for r in near_copies(random.Random(5)) if r[1] is None or len(r[1]) < 900]
    got = sorted(tuple(r) for r in jaccard_components(frame(spark, rows), segments=lambda band: max(1, 2**band // share)).collect())
    assert got == components(rows)


def test_jaccard_matches_sql(spark, sf):
    from compare import same

    same(op6_jaccard(spark, sf), OP6_SQL, sf)


def test_jaccard_empty(spark):
    assert jaccard_components(frame(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard_components(frame(spark, [(3, None), (None, "a b")])).collect()].__len__() == 2


def test_units_cover_the_difference():
    for s in range(1, 200):
        for y in range(s, s * 100 // 75 + 1):
            both = -(-75 * (s + y) // 175)
            assert both > s or s + y - 2 * both < units_needed(s)


def brute_bytes(rows, n=400):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for (doc_id, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if count[d[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(rng):
    text = lambda n: "".join(rng.choice("abcdefgh ééß\n") for _ in range(n))
    shared, other = text(700), text(420)
    rows = [(1, text(300) + shared + text(100)), (2, shared[50:] + text(500)), (3, text(20) + other + text(50) + other), (4, other[:380] + text(300)), (5, "a" * 1500), (6, "ab" * 350), (7, None), (8, ""), (9, text(399))]
    rows += [(10, rows[0][1]), (11, rows[0][1]), (12, shared[:399]), (13, text(10) + shared[100:560]), (14, text(3000))]
    return rows


def brute_first(rows, n):
    """Texts without what is covered by strings of n bytes that also start at an earlier place."""
    seen, out = set(), {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k)):
        d = (rows[k][1] or "").encode()
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if d[i : i + n] in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(d[i : i + n])
        out[k] = bytes(b for b, g in zip(d, gone) if not g)
    return [out[k] for k in range(len(rows))]


@pytest.mark.parametrize("seed, length, hot", [(1, 400, 2**22), (2, 250, 2**22), (3, 400, 3000), (4, 100, 500)])
def test_repeated_bytes_equal_brute_force(spark, seed, length, hot):
    """Also where nearly every anchor is split into parts."""
    rows = passages(random.Random(seed))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    keyed = keyed_texts(df, "text", "doc_id")
    ids = {r.uid: r.row.doc_id for r in keyed.collect()}
    got = kept_texts(keyed, removals(keyed, length, block_bytes=2000, hot_bytes=hot), length).collect()
    found = {ids[r.uid]: (r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got}
    want = {d: tuple(rest) for d, _, *rest in brute_bytes(rows, length) if rest[0]}
    assert found == want
    got = kept_texts(keyed, removals(keyed, length, "first", block_bytes=2000, hot_bytes=hot), length).collect()
    kept = {ids[r.uid]: bytes(r.kept) for r in got}
    assert [kept.get(d, (t or "").encode()) for d, t in rows] == brute_first(rows, length)


def test_many_contexts_of_one_passage(spark):
    """One passage with a different text before and after it in every document: its edges are split."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = text(500)
    rows = [(i, text(rng.randrange(300, 400)) + shared + text(rng.randrange(300, 400))) for i in range(60)]
    keyed = keyed_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "text", "doc_id")
    ids = {r.uid: r.row.doc_id for r in keyed.collect()}
    got = kept_texts(keyed, removals(keyed, 400, hot_bytes=6000), 400).collect()
    assert {ids[r.uid]: (r.n_removed, r.n_spans) for r in got} == {d: (w[0], w[1]) for d, _, *w in brute_bytes(rows) if w[0]}


def brute_bytes_in_order(rows):
    by = {}
    for d, *rest in brute_bytes(list(enumerate(t for _, t in rows))):
        by[d] = tuple(rest)
    return [by[i] for i in range(len(rows))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_order(seed):
    rng = random.Random(seed)
    parts = [bytes(rng.choice(b"abc \xff\0") for _ in range(rng.randrange(1, 300))) for _ in range(5)]
    strings = [b"".join(rng.choice(parts)[rng.randrange(20) :] for _ in range(rng.randrange(1, 6))) for _ in range(12)]
    order = SuffixOrder([*strings, b"a" * 500, b"", b"x"])
    raw, ends = order.data.tobytes(), {}
    for a, e in zip(order.starts.tolist(), order.ends.tolist()):
        ends |= dict.fromkeys(range(a, e), e)
    got = order.sort(np.arange(len(raw)))
    suffixes = [raw[p : ends[p]] for p in got.tolist()]
    assert suffixes == sorted(suffixes)
    places = order.sort(np.array([p for p in range(len(raw)) if p + 60 <= ends[p]]))
    want = [False, *(raw[p : p + 60] == raw[q : q + 60] for p, q in zip(places[1:], places))]
    assert order.equal_neighbours(places, 60).tolist() == want


def test_repeated_bytes_on_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op7_repeats(spark, sf).collect()) == brute_bytes(docs)


def test_texts_without_repeats_keep_their_columns(spark):
    rows = [(1, "é" * 500), (2, "x" * 10), (None, None)]
    got = {r.doc_id: (r.text, r.fp, r.uid) for r in remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: ("", "clash", 8), 2: ("x" * 10, "clash", 8), None: (None, "clash", 8)}
    assert remove_repeats(frame(spark, [])).count() == 0


def test_first_places_keep_clashing_columns(spark):
    t = "é" * 500
    df = spark.createDataFrame([(2, t, 5, "u", 1), (1, t, 6, "v", 2), (1, t, 7, "w", 3), (3, None, 8, None, 4)], "doc_id long, text string, uid long, sha string, runs int").coalesce(1)
    got = sorted((r.uid, r.text, r.sha, r.runs) for r in remove_repeats(df, length=250, keep="first").collect())
    assert [(u, (x or "")[:1], s, n) for u, x, s, n in got] == [(5, "", "u", 1), (6, "é", "v", 2), (7, "", "w", 3), (8, "", None, 4)]
    assert remove_repeats(df, length=250, keep="first").columns == df.columns
