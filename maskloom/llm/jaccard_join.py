"""Exact Jaccard join of word-shingle sets by universe partition and the pigeonhole principle.

Sets. A document's set holds the hashes of its distinct five-word shingles. Documents with one set are one class,
known by a 64-bit key that is checked to be free of collisions; everything below handles classes, so copies cost
nothing.

Universe partition. For sets of a size band (sizes from 2**b up to 2**(b+1)) the space of hashes is cut into m
segments, and a set into its segment subsets. Two sets of similarity 0.75 differ in at most H elements, so of any H+1
segments at least one is equal in both. Of all segments, a one-deletion neighbourhood (the subset less one element)
also finds subsets that differ in a single element; such a segment counts for two.

Index. A class indexes every non-empty segment subset under its own band, and small classes their one-deletion
neighbourhoods too; a class large enough to have partners in the next band also asks under that band's partition.

Allocation. Each class needs H+1 units. Subsets that no other class has are free. The rest is taken from the
subsets with the fewest partners; common passages are asked about last, and mostly not at all. A class with fewer
than H+1 non-empty segments also takes one-deletion neighbourhoods, and if even those are too few it is compared
with all classes of its sizes.

Candidates. Under a subset that few classes share, all partners are candidates. Under one that many share, a class
is first compared with one representative for each size, the one most of whose subsets others share; links found are
joined to components. Crowds that are then not of one component are compared exactly by sketches, block against block,
asking classes with all members. Candidates pass a parity sketch, whose distance
never exceeds that of the sets, and the rest are verified on the texts.

Signatures move as packed blocks of 32-bit values within hash buckets; a false collision costs a comparison and
changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, release, tidied, trim_worker, trimmed
from .components import connected_components

SHINGLE = 5
NUM, DEN = 75, 100  # a link: DEN * |both| >= NUM * |either|
SMALL = 64  # below this size sets also index one-deletion neighbourhoods
FEW = 8  # partners under one subset that are compared at once
DOCS_PER_BUCKET = 1500  # a bucket's signatures are sorted in one worker
INDEX, NEXT, DELETED, SHORT = 0, 1, 2, 3  # kinds of signatures

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    """64-bit hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, words: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text with fewer words has one, of all of them."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and ASCII white space
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, n)
    k = min(n, size)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = (out + h[i : n - k + 1 + i]) * _A
        out ^= out >> np.uint64(31)
    return np.unique(_mix(out))


def set_keys(tokens: np.ndarray, salt: int) -> tuple[int, int]:
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def band_of(size: int) -> int:
    return size.bit_length() - 1


def segments_of(band: int) -> int:
    """Segments of a band's partition: enough that a set's non-empty ones exceed H+1 with room to choose."""
    top = 2 ** (band + 1) - 1
    return 2 * top if top < 16 else top if top < 2 * SMALL else int(0.45 * top)


def units_needed(size: int) -> int:
    """H + 1 for a set of this size and any partner that is at least as large."""
    larger = size * DEN // NUM
    return (size + larger) * (DEN - NUM) // (DEN + NUM) + 1


def subsets(tokens: np.ndarray, band: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment of each non-empty subset, where it starts in the sorted tokens, its signature)."""
    m = np.uint64(segments)
    seg = ((tokens >> np.uint64(32)) * m) >> np.uint64(32)
    start = np.flatnonzero(np.diff(seg, prepend=m))
    return seg[start], start, signature(np.add.reduceat(tokens, start), seg[start], band)


def signature(content: np.ndarray, seg: np.ndarray, band: int) -> np.ndarray:
    return _mix(content + seg * _A + np.uint64(band + 1) * _C)


def one_deletions(tokens: np.ndarray, band: int, segments: int) -> np.ndarray:
    """Signatures of all subsets of at least two elements less one of them."""
    seg, start, _ = subsets(tokens, band, segments)
    n = np.diff(start, append=len(tokens))
    whole = np.repeat(np.add.reduceat(tokens, start), n)
    some = np.repeat(n, n) > 1
    return signature((whole - tokens)[some], np.repeat(seg, n)[some], band)


def parity_sketch(tokens: np.ndarray, band: int) -> bytes:
    """2**(band+2) bits (8 at least), each the parity of the elements that fall on it."""
    bits = max(8, 2 ** (band + 2))
    at = (tokens & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """A lower bound of the number of elements that only one of two sets has; longer sketches are folded."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def linked_sizes(both: int, a: int, b: int) -> bool:
    return DEN * both >= NUM * (a + b - both)


_SETS = "kind int, doc_id long, n long, k1 long, k2 long, sketch binary, bucket int, keys binary, sizes binary, slack binary, sigs binary, idx binary, kinds binary"


def scan_sets(docs: DataFrame, buckets: int, salt: int, segments: Callable[[int], int] = segments_of) -> DataFrame:
    """One pass over the texts: a row for each document (kind 0), and packed signatures of its batches (kind 1)."""
    names = [x.split()[0] for x in _SETS.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in _SETS.split(", ")]

    def table(kind: int, count: int, **cols):
        cols["kind"] = [kind] * count
        return pa.RecordBatch.from_arrays([pa.array(cols.get(c, [None] * count), t) for c, t in zip(names, kinds)], names=names)

    def scan(batches):
        words, seen = WordHashes(), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows, keys, sizes, slack, sigs, own, kind = [], [], [], [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    t = shingle_set(text.as_py(), words)
                    s = len(t)
                    if not s:
                        rows.append((doc_id, 0, None, None, None))
                        continue
                    k1, k2 = set_keys(t, salt)
                    b = band_of(s)
                    first = k1 not in seen
                    rows.append((doc_id, s, k1, k2, parity_sketch(t, b) if first else None))
                    if not first:
                        continue
                    seen.add(k1)
                    i, need, spare = len(keys), units_needed(s), []
                    for level in (b, b + 1):
                        if level > b and s * DEN // NUM < 2**level:
                            spare.append(0)
                            continue
                        _, start, sig = subsets(t, level, segments(level))
                        spare.append(len(sig) - need)
                        emit = [(sig, INDEX if level == b else NEXT)]
                        deleted = one_deletions(t, level, segments(level)) if s < SMALL or len(sig) < need else None
                        if level == b and s < SMALL:
                            emit.append((deleted, DELETED))
                        if len(sig) < need:
                            emit += [(sig, SHORT), (deleted, SHORT)]
                            pairs = np.diff(start, append=s) > 1
                            if level >= band_of(SMALL) or len(sig) + pairs.sum() < need:
                                spare[-1] = -(2**30)  # short of units: compared with all classes of its sizes
                        for x, k in emit:
                            sigs.append(x)
                            own.append(np.full(len(x), i, np.uint16))
                            kind.append(np.full(len(x), k, np.uint8))
                    keys.append(k1)
                    sizes.append(s)
                    slack.append(spare)
                if len(words) > 200_000:
                    words.clear()
                cols = list(zip(*rows))
                yield table(0, len(rows), **dict(zip(("doc_id", "n", "k1", "k2", "sketch"), cols)))
                if not keys:
                    continue
                sig, o, k = np.concatenate(sigs), np.concatenate(own), np.concatenate(kind)
                to = (sig % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                sig, o, k, to = (sig[order] >> np.uint64(32)).astype(np.uint32), o[order], k[order], to[order]
                cut = np.flatnonzero(np.diff(to, prepend=-1))
                ends = [*cut[1:], len(to)]
                ka, sa, la = np.array(keys, np.int64), np.array(sizes, np.int32), np.array(slack, np.int32)
                out = {c: [] for c in ("bucket", "keys", "sizes", "slack", "sigs", "idx", "kinds")}
                for a, e in zip(cut, ends):
                    used, idx = np.unique(o[a:e], return_inverse=True)
                    for c, v in (("bucket", int(to[a])), ("keys", ka[used].tobytes()), ("sizes", sa[used].tobytes()), ("slack", la[used].tobytes()), ("sigs", sig[a:e].tobytes()), ("idx", idx.astype(np.uint16).tobytes()), ("kinds", k[a:e].tobytes())):
                        out[c].append(v)
                yield table(1, len(cut), **out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(scan, 2000), _SETS)


_SHARED = "sig long, k1 long, size int, kind int, asks boolean, cost int, slack int"


def shared_subsets(packed: DataFrame) -> DataFrame:
    """Rows (sig, class, kind) of signatures that can link two classes; ``cost`` counts the partners under each."""

    def one(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        col = lambda c, t: [np.frombuffer(x, t) for x in table[c].to_pylist()]
        keys, sizes, slack = col("keys", np.int64), col("sizes", np.int32), col("slack", np.int32)
        sigs, idx, kinds = col("sigs", np.uint32), col("idx", np.uint16), col("kinds", np.uint8)
        base = np.cumsum([0] + [len(k) for k in keys[:-1]])
        uniq, first, cls = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        size, slack = np.concatenate(sizes)[first], np.concatenate(slack).reshape(-1, 2)[first]
        c = np.concatenate([cls[b + i.astype(np.int64)] for b, i in zip(base, idx)])
        code = np.concatenate(sigs).astype(np.uint64) << np.uint64(32) | c.astype(np.uint64) << np.uint64(2) | np.concatenate(kinds)
        code = np.unique(code)
        sig, c, kind = code >> np.uint64(32), (code >> np.uint64(2)).astype(np.int64) & (2**30 - 1), (code & np.uint64(3)).astype(np.int64)
        start = np.flatnonzero(np.diff(sig, prepend=np.uint64(2**63)))
        group = np.repeat(np.arange(len(start)), np.diff(start, append=len(sig)))
        n = np.stack([np.bincount(group, kind == k, len(start)).astype(np.int64) for k in range(4)])[:, group]
        asks = ((kind == INDEX) & (n[0] > 1)) | ((kind == NEXT) & (n[0] > 0)) | ((kind == SHORT) & (n[0] + n[2] > 0))
        target = ((kind == INDEX) & ((n[0] > 1) | (n[1] + n[3] > 0))) | ((kind == DELETED) & (n[3] > 0))
        keep = np.flatnonzero(asks | target)
        sig, c, kind, asks = sig[keep].astype(np.int64), c[keep], kind[keep], asks[keep]
        cost = n[0, keep] + np.where(kind == SHORT, n[2, keep], 0)
        trim_worker()
        return pa.table(
            {
                "sig": np.int64(bucket) << np.int64(32) | sig,
                "k1": uniq[c],
                "size": size[c],
                "kind": kind.astype(np.int32),
                "asks": asks,
                "cost": cost.astype(np.int32),
                "slack": np.where(kind == NEXT, slack[c, 1], slack[c, 0]).astype(np.int32),
            }
        )

    return packed.groupBy("bucket").applyInArrow(one, _SHARED)


def _fits(x: str, y: str):
    """y is at least as large as x and not too large for a link."""
    return (F.col(y) >= F.col(x)) & (F.col(y) * NUM <= F.col(x) * DEN)


def _size_class(size) -> F.Column:
    return F.floor(F.log(size) / F.log(F.lit(1.2))).cast("int")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, salt: int) -> DataFrame:
    """The (u, v) pairs of classes that are links: by parity sketches, then by the sets of their texts."""

    def near(batches):
        for b in batches:
            keep = []
            for sx, sy, nx, ny in zip(*(b[c].to_pylist() for c in ("sx", "sy", "nx", "ny"))):
                either = (nx + ny) * (DEN - NUM) // (DEN + NUM)
                keep.append(sketch_distance(sx, sy) <= either)
            yield pa.record_batch({c: b[c] for c in ("u", "v")}).filter(pa.array(keep, pa.bool_()))

    side = lambda a, n, s: classes.select(F.col("k1").alias(a), F.col("size").alias(n), F.col("sketch").alias(s))
    close = pairs.join(side("u", "nx", "sx"), "u").join(side("v", "ny", "sy"), "v")
    close = materialize(close.mapInArrow(near, "u long, v long"), "jaccard-close")
    used = close.select(F.explode(F.array("u", "v")).alias("k1")).distinct().join(classes.select("k1", "rep"), "k1")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(used, texts["doc_id"].eqNullSafe(used["rep"])).select("k1", "text")

    def mine(batches):  # of rows that share a doc_id, those whose text is the class's; one of each class
        words = WordHashes()
        for b in batches:
            keep = [set_keys(shingle_set(t, words), salt)[0] == k if t else False for k, t in zip(b["k1"].to_pylist(), b["text"].to_pylist())]
            if len(words) > 200_000:
                words.clear()
            yield b.filter(pa.array(keep, pa.bool_()))

    texts = materialize(texts.mapInArrow(trimmed(mine), "k1 long, text string"), "jaccard-texts").dropDuplicates(["k1"])

    def exact(batches):
        words, known = WordHashes(), {}

        def tokens(k, text):
            if k not in known:
                if len(known) > 200:
                    known.clear()
                known[k] = shingle_set(text, words)
            return known[k]

        for b in batches:
            keep = []
            for u, v, tu, tv in zip(*(b[c].to_pylist() for c in ("u", "v", "tu", "tv"))):
                x, y = tokens(u, tu), tokens(v, tv)
                keep.append(linked_sizes(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            if len(words) > 200_000:
                words.clear()
            yield pa.record_batch({c: b[c] for c in ("u", "v")}).filter(pa.array(keep, pa.bool_()))

    text = lambda a, t: texts.select(F.col("k1").alias(a), F.col("text").alias(t))
    both = close.join(text("u", "tu"), "u").join(text("v", "tv"), "v")
    return materialize(both.mapInArrow(trimmed(exact, 250), "u long, v long"), "jaccard-links")


def _sketch_words(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches folded to ``width`` bytes, one row each, as 64-bit words where that divides."""
    out = np.empty((len(sketches), width), np.uint8)
    for i, s in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, width), axis=0)
    return out.view(np.uint64) if width % 8 == 0 else out


def _near_pairs(x: dict, y: dict, rows: int = 64):
    """(u, v) of askers in block x and members of block y that sizes and sketches allow to be links."""
    nx, ny = np.array(x["sizes"]), np.array(y["sizes"])
    cx, cy = np.array(x["comps"]), np.array(y["comps"])
    kx, ky = np.array(x["keys"]), np.array(y["keys"])
    wx, wy = np.array([len(s) for s in x["sketches"]]), np.array([len(s) for s in y["sketches"]])
    for width in np.unique(wx):
        i, j = np.flatnonzero((wx == width) & np.array(x["asks"])), np.flatnonzero((wy == width) | (wy == 2 * width))
        if not len(i) or not len(j):
            continue
        a, b = _sketch_words([x["sketches"][k] for k in i], width), _sketch_words([y["sketches"][k] for k in j], width)
        for at in range(0, len(i), rows):
            p = i[at : at + rows]
            fits = (ny[None, j] >= nx[p, None]) & (ny[None, j] * NUM <= nx[p, None] * DEN) & (cx[p, None] != cy[None, j])
            r, c = np.nonzero(fits)
            for part in range(0, len(r), 200_000):
                rr, cc = r[part : part + 200_000], c[part : part + 200_000]
                apart = np.bitwise_count(a[at + rr] ^ b[cc]).sum(axis=1, dtype=np.int64)
                most = (nx[p[rr]] + ny[j[cc]]) * (DEN - NUM) // (DEN + NUM)
                ok = apart <= most
                u, v = kx[p[rr[ok]]], ky[j[cc[ok]]]
                yield np.minimum(u, v), np.maximum(u, v)


def close_in_crowds(members: DataFrame, block_rows: int = 1000) -> DataFrame:
    """Pairs that may be links within crowds not yet of one component, by sizes and sketches, block against block.

    Members (cluster, k1, comp, asks, size, sketch) are packed in blocks of bounded size. Every asker of a crowd is
    held against all its members; only pairs that pass leave a task.
    """
    open_ = members.groupBy("cluster").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n")).filter("a <> b")
    rows = members.join(open_.select("cluster", F.ceil(F.col("n") / block_rows).alias("blocks")), "cluster")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("k1"), F.col("blocks")))
    item = F.collect_list(F.struct("k1", "comp", "asks", "size", "sketch"))
    packed = materialize(rows.groupBy("cluster", "block").agg(item.alias("m"), F.first("blocks").alias("blocks"), F.max("asks").alias("some")), "jaccard-blocks")
    x = packed.filter("some").select("cluster", F.col("block").alias("bx"), F.col("m").alias("mx"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("by"))
    y = packed.select("cluster", F.col("block").alias("by"), F.col("m").alias("my"))

    def unpacked(m: list[dict]) -> dict:
        return {"keys": [r["k1"] for r in m], "comps": [r["comp"] for r in m], "asks": [r["asks"] for r in m], "sizes": [r["size"] for r in m], "sketches": [r["sketch"] for r in m]}

    def compare(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                parts = list(_near_pairs(unpacked(r["mx"]), unpacked(r["my"])))
                if parts:
                    u, v = map(np.concatenate, zip(*parts))
                    yield pa.record_batch({"u": u, "v": v})

    return x.join(y, ["cluster", "by"]).select("mx", "my").mapInArrow(compare, "u long, v long").distinct()


def class_links(shared: DataFrame, classes: DataFrame, docs: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """(links, components) between classes."""
    w = Window.partitionBy("k1", "kind")
    asked = shared.filter("asks").withColumn("rank", F.row_number().over(w.orderBy("cost", "sig"))).withColumn("matched", F.count("*").over(w))
    chosen = asked.filter((F.col("kind") == SHORT) | (F.col("rank") <= F.col("matched") - F.col("slack")))
    chosen = materialize(chosen.select("sig", F.col("k1").alias("x"), F.col("size").alias("nx"), "cost", (F.col("kind") == SHORT).alias("short")), "jaccard-chosen")
    targets = shared.filter(F.col("kind").isin(INDEX, DELETED)).select("sig", F.col("k1").alias("y"), F.col("size").alias("ny"), "cost", (F.col("kind") == DELETED).alias("deleted"))
    usable = (F.col("x") != F.col("y")) & _fits("nx", "ny") & (F.col("short") | ~F.col("deleted"))
    pair = [F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")]

    few = chosen.filter(F.col("cost") <= FEW).drop("cost").join(targets.drop("cost"), "sig").filter(usable).select(*pair)
    many = chosen.filter(F.col("cost") > FEW).drop("cost")
    busy = many.select("sig").distinct()
    crowd = targets.drop("cost").join(busy, "sig")
    # the member whose subsets most others share is nearest to the middle of its crowd: an original before its copies
    middle = shared.filter(F.col("kind") == INDEX).groupBy(F.col("k1").alias("y")).agg(F.sum(F.col("cost").cast("long")).alias("weight"))
    crowd = crowd.join(middle, "y")
    heads = crowd.groupBy("sig", _size_class(F.col("ny")).alias("class")).agg(F.max(F.struct("weight", "y", "ny", "deleted")).alias("h"))
    heads = heads.select("sig", "class", "h.weight", "h.y", "h.ny", "h.deleted")
    own = _size_class(F.col("nx"))
    stars = many.withColumn("class", F.explode(F.sequence(own, own + 2))).join(heads, ["sig", "class"]).filter(usable).select(*pair)
    # classes short of units, with all classes of their sizes
    rest = shared.filter(F.lit(False)).select(F.col("k1").alias("u"), F.col("k1").alias("v"))
    lone = classes.filter("short").select(F.col("k1").alias("x"), F.col("size").alias("nx"))
    if lone.limit(1).count():
        reach = F.sequence(_size_class(F.col("nx")), _size_class(F.col("nx")) + 2)
        every = classes.select(F.col("k1").alias("y"), F.col("size").alias("ny"), _size_class(F.col("size")).alias("class"))
        rest = lone.withColumn("class", F.explode(reach)).join(every, "class").filter((F.col("x") != F.col("y")) & _fits("nx", "ny")).select(*pair)
    first = verify(few.unionByName(stars).unionByName(rest).distinct(), classes, docs, salt)
    comps = materialize(connected_components(first, "jaccard-components"), "jaccard-components")

    # what many share: classes still in different components, within each crowd
    present = crowd.select("sig", "y").unionByName(many.select("sig", F.col("x").alias("y")))  # some ask, but are of another band
    head = heads.groupBy("sig").agg(F.max(F.struct("weight", "y")).alias("h")).select("sig", F.col("h.y").alias("v"))  # few, as the middle is shared
    # a member ties its subsets' heads together: the heads, far fewer, are what is joined to crowds
    tied = present.join(head, "sig").groupBy(F.col("y").alias("k1")).agg(F.sort_array(F.collect_set("v")).alias("heads"))
    tied = materialize(tied, "jaccard-heads")
    edges = tied.filter(F.size("heads") > 1).select(F.col("heads")[0].alias("u"), F.explode(F.slice("heads", 2, F.size("heads") - 1)).alias("v"))
    crowds = connected_components(edges.distinct(), "jaccard-crowds").withColumnRenamed("comp", "cluster")
    clusters = tied.select("k1", F.col("heads")[0].alias("v")).join(crowds, "v", "left").select("k1", F.coalesce("cluster", "v").alias("cluster"))
    askers = many.select(F.col("x").alias("k1")).distinct().withColumn("asks", F.lit(True))
    members = crowd.select(F.col("y").alias("k1")).unionByName(askers.select("k1")).distinct()
    members = members.join(clusters, "k1", "left").join(askers, "k1", "left")
    members = members.join(comps.withColumnRenamed("v", "k1"), "k1", "left").join(classes.select("k1", "size", "sketch"), "k1")
    members = materialize(members.select(F.coalesce("cluster", "k1").alias("cluster"), "k1", F.coalesce("comp", "k1").alias("comp"), F.coalesce("asks", F.lit(False)).alias("asks"), "size", "sketch"), "jaccard-crowd")
    more = close_in_crowds(members)
    second = verify(more, classes, docs, salt)
    links = first.unionByName(second).distinct()
    return links, materialize(connected_components(links, "jaccard-components"), "jaccard-components")


def jaccard_components(docs: DataFrame, segments: Callable[[int], int] = segments_of) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Two documents link when their sets have similarity 0.75 or more; ``component_id`` is the smallest doc_id
    reachable. Null and wordless texts have an empty set and are linked with nothing. A row with a null doc_id takes
    part, and has the component's smallest id, null if it has none. Repeated rows are equal documents. No rows in: no
    rows out. Extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with tidied(docs.sparkSession) as kept:
        return kept(materialize(_components(docs, segments), "jaccard-result"))


def _components(docs: DataFrame, segments: Callable[[int], int]) -> DataFrame:
    buckets, salt = max(12, docs.count() // DOCS_PER_BUCKET), 0
    while True:
        scanned = materialize(scan_sets(docs, buckets, salt, segments), "jaccard-scan")
        sets = materialize(scanned.filter("kind = 0").select("doc_id", "n", "k1", "k2", "sketch"), "jaccard-sets")
        same = sets.filter("n > 0").groupBy("k1").agg(
            F.min("k2").alias("a"), F.max("k2").alias("b"), F.min("doc_id").alias("rep"), F.first("n").alias("size"), F.max("sketch").alias("sketch")
        )
        if not same.filter("a <> b").limit(1).count():
            break
        salt += 1
    packed = scanned.filter("kind = 1").select("bucket", "keys", "sizes", "slack", "sigs", "idx", "kinds")
    shared = materialize(shared_subsets(packed), "jaccard-shared")
    short = materialize(_short_classes(packed), "jaccard-short")
    discard(scanned)
    classes = materialize(same.select("k1", "rep", "size", "sketch").join(short, "k1", "left").withColumn("short", F.coalesce("short", F.lit(False))), "jaccard-classes")
    release(docs.sparkSession)
    _, comps = class_links(shared, classes, docs, salt)
    comps = comps.select(F.col("v").alias("k1"), "comp")
    lowest = classes.join(comps, "k1").groupBy("comp").agg(F.min("rep").alias("low"))
    low = comps.join(lowest, "comp").select("k1", "low")
    reps = classes.select("k1", "rep").join(low, "k1", "left").select("k1", F.coalesce("low", "rep").alias("component"))
    out = sets.select("doc_id", "n", "k1").join(reps, "k1", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _short_classes(packed: DataFrame) -> DataFrame:
    """(k1, short): classes whose segments cannot supply the units they need."""

    def find(batches):
        for b in batches:
            for k, s in zip(b["keys"].to_pylist(), b["slack"].to_pylist()):
                bad = (np.frombuffer(s, np.int32).reshape(-1, 2) < -(2**29)).any(axis=1)
                if bad.any():
                    yield pa.record_batch({"k1": np.frombuffer(k, np.int64)[bad]})

    return packed.select("keys", "slack").mapInArrow(find, "k1 long").distinct().withColumn("short", F.lit(True))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS sh
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), both_ AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)
), edge AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS c FROM reach GROUP BY 1) m ON m.x = d.doc_id
"""
