"""Removal of long repeated byte strings, by prefix-free parsing of the corpus.

Every byte covered by a string of ``length`` bytes that also starts at another place is removed; documents are never
joined, strings are judged on the input. With ``keep="none"`` all copies go; with ``keep="first"`` a string only
counts at places after its first one, documents in the order of their ids.

Copies. Equal texts are found by digest; one of them is parsed and stands for all.

Narrowing. Triggers of the rolling hash bound the phrases, so every string of ``length`` bytes has its first boundary
within ``reach`` bytes (a place without one is a boundary itself) and then at least ``seed`` bytes of parse. Only
strings whose parse, to ``seed`` bytes, starts somewhere else too can repeat. This step compares 32-bit fingerprints
and only rules places out.

Partition. Of the 16-byte strings in the window of a place, the one with the smallest hash is its anchor. Equal
strings have equal anchors, so a partition by anchor holds all places of a string. Consecutive places of one anchor
are a slice of text, some three times its own places long. Equal slices are counted before they are shuffled. An anchor
that very many different slices share is split by how far its places stand before it and by the bytes that all of
these have in common, again and again until its parts are small.

Order. In each partition the slices are parsed into phrases; the suffix arrays of dictionary and parse combine into the
order of all places (``prefix_free``), where equal strings are neighbours. Bytes are compared, not only fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import Notes, discard, materialize, numbered, release, tidied, trim_worker, trimmed
from .prefix_free import OVERLAP, SuffixOrder, fingerprints16, join_hashes, triggers

LENGTH = 400
BLOCK_BYTES = 1 << 20
DOCS_PER_BUCKET = 4000
PARTITION_BYTES = 1 << 19
HOT_BYTES = 1 << 20  # slices of one anchor beyond which it is split


def seed_of(length: int) -> int:
    """Bytes of parse that are compared first: the largest power of two within 0.65 of the length."""
    return 2 ** int(np.log2(0.65 * length))


def fingerprints_at(h16: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the strings of ``size`` bytes (a power of two, 16 at least) at some places."""
    if size == 16:
        return h16[at]
    half = size // 2
    return join_hashes(fingerprints_at(h16, at, half), fingerprints_at(h16, at + half, half), half)


def boundaries(h16: np.ndarray, starts: np.ndarray, lens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(boundary, first of the places whose first boundary it is, their number), for all places of concatenated
    documents that have ``length`` bytes left in their own document."""
    n = len(h16)
    ends = np.repeat(starts + lens, lens)[:n]
    at = np.flatnonzero(np.arange(n) + length <= ends)
    trigger = triggers(h16)
    nxt = np.append(trigger, np.iinfo(np.int64).max)[np.searchsorted(trigger, at)]
    first = np.where(nxt - at <= length - seed_of(length), nxt, at)
    cut = np.flatnonzero(np.diff(first, prepend=-1))
    return first[cut], at[cut], np.diff(cut, append=len(first))


def deal(fp: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, new, bucket of each distinct value, occurs twice): values sorted by bucket, then value."""
    to = fp % np.uint64(buckets)
    order = np.lexsort((fp, to))
    s = fp[order]
    new = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    return order, new, to[order][start].astype(np.int32), np.diff(start, append=len(s)) > 1


def sent_rows(block: int, fp: np.ndarray, dealt, names: list[str], extra: list) -> pa.RecordBatch:
    """A row for each bucket, with the upper half of each value: enough to rule most of them out."""
    order, new, bucket, twice = dealt
    values = (fp[order][new] >> np.uint64(32)).astype(np.uint32)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*cut[1:], len(bucket)]
    n = len(cut)
    cols = {
        "block": pa.array([block] * n, pa.int64()),
        "bucket": pa.array(bucket[cut], pa.int32()),
        "values": pa.array([values[a:e].tobytes() for a, e in zip(cut, ends)], pa.binary()),
        "twice": pa.array([np.packbits(twice[a:e]).tobytes() for a, e in zip(cut, ends)], pa.binary()),
    }
    return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, t) for c, t in zip(names, extra)], names=names)


def repeated_values(sent: DataFrame) -> DataFrame:
    """(block, masks): for each block the bits of its distinct values, by bucket, that occur twice in the corpus."""

    def one(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in table["values"].to_pylist()]
        lens = np.array([len(p) for p in parts])
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(table["twice"].to_pylist(), lens)])
        v = np.concatenate(parts)
        order = np.argsort(v, kind="stable")
        s = v[order]
        same = s[1:] == s[:-1]
        hit = np.zeros(len(s), bool)
        hit[1:] |= same
        hit[:-1] |= same
        out = np.empty(len(s), bool)
        out[order] = hit
        out |= twice.astype(bool)
        masks = [np.packbits(m).tobytes() for m in np.split(out, np.cumsum(lens)[:-1])]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "mask": pa.array(masks, pa.binary()), "count": pa.array(lens, pa.int32())})

    got = sent.groupBy("bucket").applyInArrow(one, "block long, bucket int, mask binary, count int")
    return got.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "mask", "count"))).alias("masks"))


def _flags(masks: list[dict] | None) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=m["count"]) for m in masks or []]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


_PARSED = "kind int, block long, bucket int, values binary, twice binary, uids binary, lens binary, places binary, counts binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def parse(texts: DataFrame, leads: Notes, buckets: int, length: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One pass over (uid, text) of the leads: parse suffixes sent to buckets (kind 1), and the parse (2)."""
    names = [x.split()[0] for x in _PARSED.split(", ")]
    types = [_KINDS[x.split()[1]] for x in _PARSED.split(", ")]

    def flush(uids, texts):
        lens = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lens) - lens
        h16 = fingerprints16(np.frombuffer(b"".join(texts), np.uint8))
        bounds, places, counts = boundaries(h16, starts, lens, length)
        fp = fingerprints_at(h16, bounds, seed_of(length))
        dealt = deal(fp, buckets)
        batch = sent_rows(uids[0], fp, dealt, names, types)
        yield batch.set_column(0, "kind", pa.array([1] * batch.num_rows, pa.int32()))
        order = dealt[0]
        row = {"kind": 2, "block": uids[0], "uids": np.array(uids, np.int64).tobytes(), "lens": lens.tobytes(), "twice": np.packbits(dealt[1]).tobytes(),
               "places": places[order].astype(np.uint32).tobytes(), "counts": counts[order].astype(np.uint16).tobytes()}
        yield pa.RecordBatch.from_arrays([pa.array([row.get(c)], t) for c, t in zip(names, types)], names=names)

    def run(batches):
        uids, texts, size, lead = [], [], 0, leads.reader()
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lead(uid) is None:
                    continue
                data = text.as_py()
                uids.append(uid)
                texts.append(data)
                size += len(data)
                if size >= block_bytes:
                    yield from flush(uids, texts)
                    uids, texts, size = [], [], 0
        if uids:
            yield from flush(uids, texts)

    return texts.mapInArrow(trimmed(run, None), _PARSED)


def candidate_places(parsed: DataFrame, masks: DataFrame) -> DataFrame:
    """(uid, starts, ends): runs of places in a document whose parse suffix occurs elsewhere."""

    def find(batches):
        for b in batches:
            for r in b.to_pylist():
                uids, lens = np.frombuffer(r["uids"], np.int64), np.frombuffer(r["lens"], np.int64)
                places, counts = np.frombuffer(r["places"], np.uint32).astype(np.int64), np.frombuffer(r["counts"], np.uint16).astype(np.int64)
                new = np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(places)).astype(bool)
                hit = _flags(r["masks"])[np.cumsum(new) - 1] if len(places) else np.zeros(0, bool)
                order = np.argsort(places[hit])
                start = places[hit][order]
                end = start + counts[hit][order]
                if not len(end):
                    continue
                ends_of = np.cumsum(lens)
                doc = np.searchsorted(ends_of, start, "right")
                base = (ends_of - lens)[doc]
                cut = np.flatnonzero((np.append(True, start[1:] != end[:-1])) | (np.diff(doc, prepend=-1) != 0))
                last = np.append(cut[1:], len(start)) - 1
                who = doc[cut]
                first = np.flatnonzero(np.diff(who, prepend=-1))
                yield pa.record_batch(
                    {
                        "uid": uids[who[first]],
                        "starts": pa.array(np.split((start - base)[cut], first[1:])),
                        "ends": pa.array(np.split((end - base)[last], first[1:])),
                    }
                )

    blocks = parsed.filter("kind = 2").select("block", "uids", "lens", "places", "counts", "twice").join(masks, "block")
    return blocks.mapInArrow(find, "uid long, starts array<long>, ends array<long>")


def window_minima(values: np.ndarray, window: int) -> np.ndarray:
    """The smallest of every ``window`` consecutive values, by running minima of blocks from both sides."""
    n = len(values) - window + 1
    if n <= 0:
        return values[:0]
    pad = -len(values) % window
    blocks = np.append(values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)).reshape(-1, window)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[window - 1 : window - 1 + n])


_SLICE = "anchor long, d1 long, d2 long, m int, off int, text binary"
_SLICE_TYPES = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]


def digest(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def slices(rows: DataFrame, places: Notes, length: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(ord, uid, pos) and a slice: of (uid, ord, text) and notes (starts, ends), the candidate places by anchor.

    A task sends a slice's text only the first times it meets it.
    """
    window = length - OVERLAP + 1
    names = ["ord", "uid", "pos", *(x.split()[0] for x in _SLICE.split(", "))]
    types = [pa.int64()] * 3 + _SLICE_TYPES

    def flush(held, seen):
        lens = np.array([len(t) for _, _, t, _, _ in held], np.int64)
        base = np.cumsum(lens) - lens
        data = b"".join(t for _, _, t, _, _ in held)
        h16 = fingerprints16(np.frombuffer(data, np.uint8))
        least = window_minima((h16 >> np.uint64(32) << np.uint64(32)) | np.arange(len(h16), dtype=np.uint64), window)
        at = np.concatenate([np.arange(b + x, b + y) for b, (_, _, _, s, e) in zip(base, held) for x, y in zip(s, e)])
        anchor = (least[at] & np.uint64(2**32 - 1)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(anchor) != 0)))
        p0, m, anchor = at[cut], np.diff(cut, append=len(at)), anchor[cut]
        doc = np.searchsorted(base, p0, "right") - 1
        cols = [[] for _ in range(3)]
        for p, k in zip(p0.tolist(), m.tolist()):
            text = data[p : p + k - 1 + length]
            d = digest(text)
            cols[0].append(d[0])
            cols[1].append(d[1])
            cols[2].append(None if d in seen else text)
            seen.add(d)
        if len(seen) > 200_000:
            seen.clear()
        out = [np.array([h[1] for h in held])[doc], np.array([h[0] for h in held])[doc], p0 - base[doc],
               h16[anchor].view(np.int64), cols[0], cols[1], m, anchor - p0, cols[2]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    def run(batches):
        held, size, seen, place = [], 0, set(), places.reader()
        for b in batches:
            for uid, ord_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                at = place(uid)
                if at is None:
                    continue
                data = text.as_py()
                held.append((uid, ord_, data, *at))
                size += len(data)
                if size >= block_bytes:
                    yield from flush(held, seen)
                    held, size = [], 0
        if held:
            yield from flush(held, seen)

    return rows.mapInArrow(trimmed(run, None), "ord long, uid long, pos long, " + _SLICE)


_KEY = ["anchor", "d1", "d2"]


def distinct_slices(rows: DataFrame) -> DataFrame:
    """Each slice once, with its number of copies ``n`` and the first of their places."""
    return rows.groupBy(*_KEY).agg(
        F.sum("n").alias("n"), F.min(F.struct("ord", "uid", "pos")).alias("first"), F.first("m").alias("m"), F.first("off").alias("off"), F.first("text", True).alias("text")
    ).select(*_KEY, "n", "first.ord", "first.uid", "first.pos", "m", "off", "text")


def split_slices(rows: DataFrame, length: int, level: int) -> DataFrame:
    """Parts of slices by their places' distance to the anchor, each with a key of the bytes all such places share."""
    step = -(-(length - OVERLAP + 1) // 2 ** (level + 1))
    names = ["p_anchor", "p_d1", "p_d2", "base", "ord", "uid", "pos", "n", *(x.split()[0] for x in _SLICE.split(", "))]
    types = [pa.int64()] * 8 + _SLICE_TYPES

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                text, off, m = r["text"], r["off"], r["m"]
                part = (off - np.arange(m)) // step
                cut = np.flatnonzero(np.diff(part, prepend=-1))
                for i, k in zip(cut.tolist(), np.diff(cut, append=m).tolist()):
                    low = int(part[i]) * step
                    high = min(low + step - 1, length - OVERLAP)
                    shared = text[max(0, off - low) : max(0, off - high + length)]
                    key, _ = digest(shared + f"/{r['anchor']}/{level}/{low}".encode())
                    own = text[i : i + k - 1 + length]
                    out.append((r["anchor"], r["d1"], r["d2"], i, r["ord"], r["uid"], r["pos"] + i, r["n"], key, *digest(own), k, off - i, own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.mapInArrow(run, "p_anchor long, p_d1 long, p_d2 long, base long, ord long, uid long, pos long, n long, " + _SLICE)


_RUN = "array<struct<s:long,e:long>>"
_RUN_TYPE = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def runs_of(flags: np.ndarray) -> list[dict]:
    """Runs of set flags as start and end (exclusive)."""
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return [{"s": s, "e": e} for s, e in edge.reshape(-1, 2).tolist()]


def repeated_places(slices_: DataFrame, length: int, partitions: int) -> DataFrame:
    """For each slice the runs of its places whose string stands elsewhere too (``again``), or earlier (``later``)."""

    def one(table: pa.Table) -> pa.Table:
        texts = [x.as_py() for x in table["text"]]
        order = SuffixOrder(texts)
        m = table["m"].to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(m)), m)
        first = np.cumsum(m) - m
        inside = np.arange(len(owner)) - first[owner]
        places = order.starts[owner] + inside
        ordered = order.sort(places)
        same = order.equal_neighbours(ordered, length)
        back = np.searchsorted(places, ordered)  # places ascend
        group = np.cumsum(~same) - 1
        size = np.bincount(group)
        again, later = np.zeros(len(places), bool), np.zeros(len(places), bool)
        again[back] = (size > 1)[group]
        many = np.flatnonzero((size > 1)[group])
        if len(many):
            who, g = back[many], group[many]
            at = (table["pos"].to_numpy()[owner] + inside)[who]
            rank = np.lexsort((at, table["uid"].to_numpy()[owner][who], table["ord"].to_numpy()[owner][who], g))
            lead = np.append(True, np.diff(g[rank]) != 0)
            later[who[rank[~lead]]] = True
        again |= np.repeat(table["n"].to_numpy() > 1, m)
        ends = first + m
        cols = {c: table[c] for c in (*_KEY, "n", "m", "ord", "uid", "pos")}
        cols["again"] = pa.array([runs_of(again[a:b]) for a, b in zip(first, ends)], _RUN_TYPE)
        cols["later"] = pa.array([runs_of(later[a:b]) for a, b in zip(first, ends)], _RUN_TYPE)
        del order
        trim_worker()
        return pa.table(cols)

    schema = f"anchor long, d1 long, d2 long, n long, m int, ord long, uid long, pos long, again {_RUN}, later {_RUN}"
    return slices_.withColumn("part", F.pmod(F.col("anchor"), F.lit(partitions))).groupBy("part").applyInArrow(
        lambda key, table: one(table), schema
    )


def at_copies(copies: DataFrame, found: DataFrame) -> DataFrame:
    """The runs found for slices at each of their ``copies``: a copy other than the first is later throughout.

    Slices with at least a thousandth of all copies, a thousand at most, are broadcast, as their copies would be one
    task's; the others are shuffled.
    """
    bound = max(1000, copies.count() // 1000)
    common = F.broadcast(found.filter(F.col("n") >= bound))
    on = [F.col(f"c.{k}") == F.col(f"f.{k}") for k in _KEY]
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("f.m").cast("long").alias("e")))
    is_first = (F.col("c.ord") == F.col("f.ord")) & (F.col("c.uid") == F.col("f.uid")) & (F.col("c.pos") == F.col("f.pos"))
    runs = ["c.*", F.col("f.again").alias("again"), F.when(is_first, F.col("f.later")).otherwise(whole).alias("later")]
    many = copies.alias("c").join(common.alias("f"), on).select(*runs)
    rest = copies.join(common.select(*_KEY), _KEY, "left_anti").select(*copies.columns)
    return many.unionByName(rest.alias("c").join(found.filter(F.col("n") < bound).alias("f"), on).select(*runs))


def _moved(runs: str, base: str) -> F.Column:
    return F.flatten(F.collect_list(F.transform(runs, lambda r: F.struct((r["s"] + F.col(base)).alias("s"), (r["e"] + F.col(base)).alias("e")))))


def repeated_runs(texts: DataFrame, lead: DataFrame, length: int, keep: str, block_bytes: int = BLOCK_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(uid, runs): runs of places in those of the texts (uid, ord, text) that are leads whose string is to be removed."""
    buckets = max(12, lead.count() // DOCS_PER_BUCKET)
    leads = Notes(lead.select("uid"), "bytes-lead")
    parsed = materialize(parse(texts.select("uid", "text"), leads, buckets, length, block_bytes), "bytes-parsed")
    seeds = repeated_values(parsed.filter("kind = 1").select("block", "bucket", "values", "twice"))
    places = Notes(candidate_places(parsed, seeds), "bytes-places")
    discard(parsed)
    discard(leads)
    release(texts.sparkSession)
    cut = slices(texts.select("uid", "ord", "text"), places, length, block_bytes)
    rows = first = materialize(cut.withColumn("n", F.lit(1).cast("long")), "bytes-slices")
    levels, cold = [], []
    last = int(np.ceil(np.log2(length)))
    while True:
        whole = materialize(distinct_slices(rows), "bytes-distinct")
        hot = whole.groupBy("anchor").agg(F.sum(F.length("text")).alias("bytes")).filter(F.col("bytes") > hot_bytes).select("anchor")
        hot = materialize(hot, "bytes-hot")
        if len(levels) > last or hot.isEmpty():
            cold.append(whole)
            break
        cold.append(whole.join(hot, "anchor", "left_anti"))
        split = whole.join(hot, "anchor", "left_semi")
        rows = materialize(split_slices(split, length, len(levels)), "bytes-split")
        levels.append((split, rows))
    every = cold[0]
    for c in cold[1:]:
        every = every.unionByName(c)
    size = every.agg(F.sum(F.length("text"))).first()[0] or 0
    found = materialize(repeated_places(every.drop("off"), length, int(size // PARTITION_BYTES) + 1), "bytes-found")
    for split, parts in reversed(levels):  # what was found for parts, put together
        got = at_copies(parts.drop("text", "off"), found).groupBy("p_anchor", "p_d1", "p_d2")
        got = got.agg(_moved("again", "base").alias("some"), _moved("later", "base").alias("later"))
        on = [split[k] == got[f"p_{k}"] for k in _KEY]
        whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("m").cast("long").alias("e")))
        parents = split.drop("off", "text").join(got, on).drop("p_anchor", "p_d1", "p_d2")
        parents = parents.withColumn("again", F.when(F.col("n") > 1, whole).otherwise(F.col("some"))).drop("some")
        found = materialize(found.unionByName(parents), "bytes-found")
    runs = "again" if keep == "none" else "later"
    out = at_copies(first.drop("m", "off", "text", "n"), found).filter(F.size(runs) > 0)
    out = materialize(out.groupBy("uid").agg(_moved(runs, "pos").alias("runs")), "bytes-runs")
    release(texts.sparkSession)
    return out


def keyed_texts(docs: DataFrame, text_col: str, order_col: str | None) -> DataFrame:
    """(uid, ord, n, sha, text, row): rows with numbers that every job sees alike."""
    text = F.col(f"`{text_col}`").cast("string").cast("binary")
    place = F.coalesce(F.col(f"`{order_col}`").cast("long"), F.lit(-(2**63)).cast("long")) if order_col else F.lit(0).cast("long")
    rows = docs.select(
        place.alias("ord"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n"),
        F.sha2(F.coalesce(text, F.lit("").cast("binary")), 256).alias("sha"), text.alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
    )
    return numbered(rows, "uid", "bytes-documents")


def removals(keyed: DataFrame, length: int, keep: str = "none", block_bytes: int = BLOCK_BYTES, hot_bytes: int = HOT_BYTES) -> Notes:
    """Notes (whole, runs) on the rows of (uid, ord, n, sha, text) that lose something: all bytes, or those of strings
    that start in the runs."""
    with tidied(keyed.sparkSession) as kept:
        long_ = keyed.filter(F.col("n") >= length)
        lead = long_.groupBy("sha").agg(F.min(F.struct("ord", "uid")).alias("f"), F.count("*").alias("copies"))
        lead = materialize(lead.select("f.uid", "copies"), "bytes-leads")
        runs = repeated_runs(long_.select("uid", "ord", "text"), lead, length, keep, block_bytes, hot_bytes)
        copy = F.col("copies").isNull() | (F.col("copies") > (1 if keep == "none" else 2**62))
        out = long_.select("uid").join(lead, "uid", "left").join(runs, "uid", "left")
        return kept(Notes(out.select("uid", copy.alias("whole"), "runs").filter(F.col("whole") | F.col("runs").isNotNull()), "bytes-losses"))


def _spans(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """Removed bytes as maximal runs, of runs of places in any order."""
    s, e = np.array([r["s"] for r in runs]), np.array([r["e"] for r in runs]) - 1 + length
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    cut = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
    return list(zip(s[cut].tolist(), e[np.append(cut[1:], len(s)) - 1].tolist()))


def kept_texts(keyed: DataFrame, losses: Notes, length: int, hashed: bool = False) -> DataFrame:
    """(uid, kept, n_removed, n_spans) of the rows that lose something; ``hashed`` gives the digest of what is kept."""
    kind = pa.string() if hashed else pa.binary()

    def run(batches):
        loss = losses.reader()
        for b in batches:
            out = []
            for uid, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = loss(uid)
                if found is None:
                    continue
                data = text.as_py()
                spans = [(0, len(data))] if found[0] else _spans(found[1], length)
                ends = [0, *(e for _, e in spans)]
                kept = b"".join(data[x:y] for x, y in zip(ends, [*(s for s, _ in spans), len(data)]))
                out.append((uid, hashlib.sha256(kept).hexdigest() if hashed else kept, len(data) - len(kept), len(spans)))
            if out:
                types = (pa.int64(), kind, pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["uid", "kept", "n_removed", "n_spans"])

    return keyed.select("uid", "text").mapInArrow(trimmed(run), f"uid long, kept {'string' if hashed else 'binary'}, n_removed long, n_spans long")


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, keep: str = "none", order_col: str | None = "doc_id") -> DataFrame:
    """All rows and columns of ``docs``, texts without repeated strings of ``length`` bytes (32 at least).

    ``keep="first"`` leaves each string at its first place, by ``order_col`` (a whole number; null comes first), then
    by the order of rows, then within the text. Bytes are removed as they are; where that splits a character, its
    remaining bytes are dropped from the text. Null texts stay null, empty and shorter ones as they are. Of equal rows
    all are emptied, or all but one with ``keep="first"``. No rows in: no rows out. Other columns, whatever their
    names, pass through. A text of any size is one row of one task.
    """
    keyed = keyed_texts(docs, text_col, order_col if order_col in docs.columns else None)
    losses = removals(keyed, length, keep)

    def cut(batches):
        loss = losses.reader()
        for b in batches:
            out = []
            for uid, text in zip(b.column(0).to_pylist(), b.column(1)):
                found, data = loss(uid), text.as_py()
                if found is not None:
                    spans = [(0, len(data))] if found[0] else _spans(found[1], length)
                    ends = [0, *(e for _, e in spans)]
                    data = b"".join(data[x:y] for x, y in zip(ends, [*(s for s, _ in spans), len(data)]))
                out.append(None if data is None else data.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column(2)], names=["text", "row"])

    rows = keyed.select("uid", "text", "row")
    done = rows.mapInArrow(trimmed(cut), StructType([StructField("text", StringType()), rows.schema["row"]]))
    text = F.col("text").cast(docs.schema[text_col].dataType)
    return done.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents.

    Null texts are empty. Rows with a null or repeated doc_id are documents of their own. Texts under 400 bytes lose
    nothing. No rows in: no rows out. Extra columns are ignored.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    keyed = keyed_texts(docs, "text", "doc_id")
    cut = kept_texts(keyed, removals(keyed, LENGTH), LENGTH, hashed=True).withColumnRenamed("kept", "kept_sha256")
    out = keyed.select("uid", F.col("row.doc_id").cast("long").alias("doc_id"), "n", "sha").join(cut, "uid", "left")
    none = F.lit(0).cast("long")
    return out.select(
        "doc_id", F.col("n").alias("n_bytes"), F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )
