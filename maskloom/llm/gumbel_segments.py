"""Distinct sampled segmentations of texts into a vocabulary's pieces, without replacement, with inclusion scores.

A text's segmentations are the paths of a lattice: edges are the pieces of a public SentencePiece model that match
there, with byte pieces for characters it lacks. A piece of rank r has weight proportional to 1 / (r + 3), to the
power ``alpha``; a path's probability is the product of its pieces' weights over the sum of all paths', which
backward sums over the lattice give edge by edge.

Gumbel top-k: give every path's log-probability independent Gumbel noise, and the k largest are a sample without
replacement. Perturbed A* search finds them without listing paths. The root has the largest perturbed value of all
paths below it; which child attains a node's value is a draw by their probabilities, and the largest value of the
others, as one set, is Gumbel noise around the logarithm of their sum, cut off at the node's value. So expanding the
best open node follows one path to the end, which is the next sample, and leaves one set of siblings at each place it
passed. The next best open value is the threshold kappa, and 1 - exp(-exp(log p - kappa)) is the probability that the
path would be among k samples.

All noise is a hash of the row's key, the step and the edge: a row's samples depend on nothing but the row.
"""

from __future__ import annotations

import heapq
import math
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import held, trim_worker

SPACE = "▁"
BATCH_CHARS = 400_000  # of texts that are segmented together
BOOK_CHARS = 1_200_000  # of different chunks whose lattice a worker keeps, some 100 MB
BLOCK_CHARS = 30_000  # of new chunks whose lattice is built at a time, in a processor's own memory
BOOK_TURNS = 16  # times that a full book keeps its first three quarters before it begins anew
BITS = 40  # of a draw among the edges of a place
GUIDE = 2  # first bits of a draw, by which a place tells how many edges it passes for certain
EDGES = 32  # bits of an edge's number
PASSED = np.array([sum(1 << 8 * j for j in range(i, 1 << GUIDE)) for i in range((1 << GUIDE) + 1)])
FIRST_PLACES = 128  # of a path, whose siblings are looked at first
MOST_NOISE = 38.0  # Gumbel noise of 53 bits stays below
_MARK = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of some numbers, in their own place."""
    y = x >> np.uint64(30)
    for factor, bits in ((0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):
        x ^= y
        x *= np.uint64(factor)
        np.right_shift(x, np.uint64(bits), out=y)
    x ^= y
    return x


def _stream(seeds: np.ndarray, step: int) -> np.ndarray:
    """To be added to a place's number times ``_MARK`` and mixed."""
    return seeds * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(step * 0x94D049BB133111EB % 2**64)


def uniform_noise(seeds: np.ndarray, step: int, nth: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), a hash of seed, step and place."""
    x = _mixed(nth.astype(np.uint64) * _MARK + _stream(seeds, step))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start, ``size`` of them, one after the other."""
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(start - upto + size, size)


def cut_gumbel(location: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel noise around a location, given that it is at most so much; minus infinity where the location is."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(location), -np.logaddexp(-most, np.log(-np.log(u)) - location), -np.inf)


def cut_gumbel_once(location: float, most: float, u: float) -> float:
    """``cut_gumbel`` of one location."""
    a, b = -most, math.log(-math.log(u)) - location
    return -(max(a, b) + math.log1p(math.exp(-abs(a - b))))


class Trie:
    """The pieces by their characters: transitions in one open hash table, looked up for many places at once."""

    def __init__(self, pieces: dict[str, int]):
        steps: dict[tuple[int, int], int] = {}
        self.piece = [-1]
        for text, i in pieces.items():
            node = 0
            for c in text:
                nxt = steps.setdefault((node, ord(c)), len(self.piece))
                if nxt == len(self.piece):
                    self.piece.append(-1)
                node = nxt
            self.piece[node] = i
        self.piece = np.array(self.piece, np.int64)
        self.bits = max(4, (4 * len(steps)).bit_length())
        self.keys, self.to = np.full(2**self.bits, -1, np.int64), np.full(2**self.bits, -1, np.int64)
        keys = np.array([n << 21 | c for n, c in steps], np.int64)
        mask, held = 2**self.bits - 1, set()
        for key, at, to in zip(keys.tolist(), self._slot(keys).tolist(), steps.values()):
            while at in held:
                at = at + 1 & mask
            held.add(at)
            self.keys[at], self.to[at] = key, to
        self.root = np.full(max((c for n, c in steps if n == 0), default=0) + 2, -1, np.int64)  # by the first character
        for (n, c), to in steps.items():
            if n == 0:
                self.root[c] = to

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MARK) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The node each transition leads to, -1 where there is none."""
        key = nodes << 21 | chars
        at = self._slot(key)
        k = self.keys[at]
        hit = k == key
        out = np.where(hit, self.to[at], -1)
        left = np.flatnonzero(~hit & (k != -1))
        while len(left):
            at[left] = at[left] + 1 & (2**self.bits - 1)
            k = self.keys[at[left]]
            hit = k == key[left]
            out[left[hit]] = self.to[at[left[hit]]]
            left = left[~hit & (k != -1)]
        return out


class Lattice:
    """Edges of some texts, by start: ``first`` of each place, then end, piece and log-probability given the start.

    No piece reaches from one chunk, white space and what follows it, into the next, so chunks are summed up apart.
    With ``chunks`` each text is a chunk, as ``Book`` cuts them.
    """

    def __init__(self, segmenter: "Segmenter", texts: list[str], chunks: bool = False):
        joined = texts if chunks else [SPACE + t.replace(" ", SPACE) for t in texts]
        self.sizes = np.array([len(t) for t in joined], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.length = int(self.sizes.sum())
        chars = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        space = chars == ord(SPACE)
        self.heads = space & ~np.append(False, space[:-1])
        self.heads[self.ends - self.sizes] = True
        starts = np.flatnonzero(self.heads)
        stop = np.repeat(np.append(starts[1:], self.length), np.diff(starts, append=self.length))

        at, deep, found = np.arange(self.length), 0, []
        while len(at):
            node = segmenter.trie.step(node, chars[at + deep]) if deep else segmenter.trie.root.take(chars, mode="clip")
            deep += 1
            on = np.flatnonzero(node >= 0)  # numbers pick faster than truth values do
            at, node = at[on], node[on]
            piece = segmenter.trie.piece[node]
            hit = np.flatnonzero(piece >= 0)
            found.append((deep, at[hit], piece[hit]))
            on = np.flatnonzero(at + deep < stop[at])
            at, node = at[on], node[on]
        whole = np.zeros(self.length, bool)
        whole[found[0][1]] = True
        rest = np.flatnonzero(~whole)  # characters that are no piece: their bytes
        if len(rest):
            kinds, which = np.unique(chars[rest], return_inverse=True)
            found.append((1, rest, np.array([segmenter.byte_run(chr(c)) for c in kinds.tolist()])[which]))
        sizes, starts, found = zip(*found)
        start = np.concatenate(starts)
        order = np.argsort(start.astype(np.uint16) if self.length < 2**16 else start, kind="stable")  # the short ones are sorted by counting
        self.place, self.piece = start[order], np.concatenate(found)[order]
        self.end = self.place + np.repeat(sizes, [len(x) for x in starts])[order]
        count = np.bincount(self.place, minlength=self.length)
        self.first = np.cumsum(count) - count
        weight = segmenter.logw[self.piece]
        if len(rest):
            weight[self.piece < 0] = [segmenter.run_weight(r) for r in self.piece[self.piece < 0].tolist()]
        self._sum(weight, stop)

    def _sum(self, weight: np.ndarray, stop: np.ndarray) -> None:
        """Backward sums over each chunk, all chunks at once, by the distance to the chunk's end."""
        far = stop - np.arange(self.length)
        if far.max(initial=0) < 2**15:
            far = far.astype(np.int16)  # sorted by counting
        by = np.argsort(far, kind="stable")
        far, count = far[by], np.diff(self.first, append=len(weight))
        n = count[by]
        edge = _ranges(self.first[by], n)
        seg = np.append(0, np.cumsum(n))
        rank = np.empty(self.length + 1, np.int64)
        rank[by] = np.arange(self.length)
        rank[self.length] = self.length
        end = self.end[edge]
        np.putmask(end, end == np.repeat(stop[by], n), self.length)  # whose sum is that of nothing
        end = rank[end]
        x, part, whole, beta = weight[edge], np.empty(len(edge)), np.empty(self.length), np.zeros(self.length + 1)
        cut = np.flatnonzero(np.diff(far, prepend=0))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(by)).tolist()):
            i, j = int(seg[a]), int(seg[b])
            x[i:j] += beta[end[i:j]]
            of = seg[a:b] - i
            top = np.maximum.reduceat(x[i:j], of)
            np.exp(x[i:j] - np.repeat(top, n[a:b]), out=part[i:j])
            whole[a:b] = np.add.reduceat(part[i:j], of)
            beta[a:b] = top + np.log(whole[a:b])
        x -= np.repeat(beta[:-1], n)
        part *= np.repeat(2.0**BITS / whole, n)
        self.logp, share = np.empty(len(edge)), np.empty(len(edge), np.int64)
        self.logp[edge], share[edge] = x, part
        # upper ends of each edge's share of its place, as whole numbers; the last one's is the place's
        upto = np.cumsum(share)
        upto -= np.repeat(upto[self.first] - share[self.first], count)
        upto[np.append(self.first[1:], len(edge))[: self.length] - 1] = 1 << BITS
        self.shares = np.minimum(upto, 1 << BITS, out=upto)
        # a byte for each value of a draw's first bits: how many edges end at or before all such draws
        part = upto + ((1 << BITS - GUIDE) - 1) >> BITS - GUIDE
        self.guide = np.add.reduceat(PASSED[part], self.first)


class Book:
    """The lattice of the chunks that were met so far, each once.

    A book that has become large keeps the chunks it met first, which most texts use, and drops the others; after some
    turns it begins anew, as later texts may use other words.

    Characters are of one kind if a piece holds both side by side, or by way of others. A chunk is white space and
    characters of one kind behind it, a word or a mark: no piece reaches from one into the next.
    """

    def __init__(self, segmenter: "Segmenter"):
        self.segmenter = segmenter
        kind: dict[str, set[str]] = {}
        for piece in segmenter.pieces:
            chars = set(piece.lstrip(SPACE))
            if len(chars) > 1 or len(piece.lstrip(SPACE)) > 1:
                for other in [kind[c] for c in chars if c in kind]:
                    chars |= other
                kind.update(dict.fromkeys(chars, chars))
        kinds = {id(k): k - {SPACE} for k in kind.values()}.values()
        self.kinds = np.zeros(max(map(ord, [SPACE, *kind])) + 2, np.uint16)  # by character; none for those that stand alone
        for i, chars in enumerate(kinds):
            self.kinds[[*map(ord, chars)]] = 2 + i
        self.kinds[ord(SPACE)] = 1
        self.clear()

    def clear(self) -> None:
        self.number, self.turns = {}, 0
        self.held = {"first": np.zeros(1, np.int64), "edge": np.zeros(0, np.int64), "piece": np.zeros(0, np.int32), "logp": np.zeros(0),
                     "sizes": np.zeros(0, np.int64), "stops": np.zeros(0, np.int64)}
        self.used = {c: len(v) for c, v in self.held.items()}

    def _make_room(self) -> None:
        """Drop all chunks but those of the first three quarters."""
        chunks = int(np.searchsorted(self.stops, BOOK_CHARS * 3 // 4, "right"))
        if not chunks or self.turns == BOOK_TURNS or len(self.held["first"]) > 4 * BOOK_CHARS:  # one chunk may be very long
            return self.clear()
        self.turns += 1
        self.number = dict(islice(self.number.items(), chunks))  # those met first
        places = int(self.stops[chunks - 1])
        edges = int(self.first[places]) & (1 << EDGES) - 1
        self.held["first"][places] = edges
        self.used.update(first=places + 1, edge=edges, piece=edges, logp=edges, sizes=chunks, stops=chunks)

    def __getattr__(self, name: str) -> np.ndarray:
        if name in ("first", "edge", "piece", "logp", "sizes", "stops"):
            return self.held[name][: self.used[name]]
        raise AttributeError(name)

    def _put(self, name: str, new: np.ndarray) -> None:
        n = self.used[name] + len(new)
        if n > len(self.held[name]):
            self.held[name] = np.append(self.held[name][: self.used[name]], np.zeros(n + n // 4 - self.used[name], self.held[name].dtype))
        self.held[name][self.used[name] : n] = new
        self.used[name] = n

    def chunks(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different chunks of the texts as they are first met, which one each chunk is, and of how many each text is."""
        joined = SPACE.join(["", *texts]).replace(" ", SPACE)
        data = joined.encode("utf-32-le", "surrogatepass")
        kind = self.kinds.take(np.frombuffer(data, np.uint32), mode="clip")
        begin = np.cumsum([0, *(1 + len(t) for t in texts)])
        heads = np.empty(len(kind), bool)
        before, kind = kind[:-1], kind[1:]
        heads[1:] = (kind != before) & (before != 1) | (kind == 0) & (before == 0)
        heads[begin[:-1]] = True
        heads = np.append(np.flatnonzero(heads), begin[-1])
        coded = pa.Array.from_buffers(pa.large_binary(), len(heads) - 1, [None, pa.py_buffer(4 * heads), pa.py_buffer(data)]).dictionary_encode()
        which = coded.indices.to_numpy()
        one = np.empty(len(coded.dictionary), np.int64)
        one[which[::-1]] = np.arange(len(which))[::-1]  # the first of equal chunks is put last
        return [joined[a:b] for a, b in zip(heads[one].tolist(), heads[one + 1].tolist())], which, np.diff(np.searchsorted(heads, begin))

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each chunk of the texts, and of how many chunks each text is."""
        parts, which, n = self.chunks(texts)
        if self.used["first"] > BOOK_CHARS:
            self._make_room()
        number = np.fromiter(map(self.number.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(number < 0)
        number[new] = np.arange(len(self.number), len(self.number) + len(new))
        parts = [parts[i] for i in new.tolist()]
        self.number.update(zip(parts, range(len(self.number), len(self.number) + len(parts))))
        block = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // BLOCK_CHARS
        for part in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(block)) + 1):
            if len(part):
                self._add(Lattice(self.segmenter, parts[part[0] : part[-1] + 1], chunks=True))
        return number[which], n

    def _add(self, lat: Lattice) -> None:
        places, edges = self.used["first"] - 1, self.used["edge"]
        self.used["first"] -= 1  # the last one closes the edges before
        first = np.append(lat.first + (lat.guide << EDGES), len(lat.end)) + edges
        edge = (lat.shares << 62 - BITS) + lat.end - lat.place
        for name, values in (("first", first), ("edge", edge), ("piece", lat.piece), ("logp", lat.logp), ("sizes", lat.sizes), ("stops", lat.ends + places)):
            self._put(name, values)


class Chunks:
    """Some texts, one after the other, over a book of chunks.

    A place of the texts is one of the book and its chunk's ``shift``; what a chunk's edges are depends on it alone.
    """

    def __init__(self, book: Book, texts: list[str]):
        which, n = book.cut(texts)
        self.book, self.text = book, np.repeat(np.arange(len(texts)), n)
        size, self.stops = book.sizes[which], book.stops[which]  # these in the book
        self.heads = np.cumsum(size) - size
        self.shift = self.heads + size - self.stops
        self.ends = (self.heads + size)[np.cumsum(n) - 1]
        self.sizes = np.diff(self.ends, prepend=0)
        self.length = int(self.ends[-1])
        # in the book's order, so that draws that fall into one part of it follow one another
        self.order = np.argsort(which)
        self.nth = np.empty_like(self.order)  # the place there of each chunk
        self.nth[self.order] = np.arange(len(which))
        self.walked = self.text[self.order], (self.stops - size)[self.order], self.stops[self.order], self.shift[self.order]

    def shift_at(self, place: int) -> int:
        return int(self.shift[np.searchsorted(self.heads, place, "right") - 1])


class Segmenter:
    """Sampling and decoding with one vocabulary file."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        self.pieces, self.bytes = {}, {}
        for i in range(n):
            if self.model.is_byte(i):
                self.bytes[int(self.model.id_to_piece(i)[1:-1], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                self.pieces[self.model.id_to_piece(i)] = i
        rank = np.array([min(-self.model.get_score(i), n) for i in range(n)])
        weight = 1 / (rank + 3)
        self.logw = alpha * np.log(weight / weight.sum())
        self.rare = float(min(self.logw[i] for i in self.pieces.values()))
        self.trie = Trie(self.pieces)
        of_byte = {i: b for b, i in self.bytes.items()}
        self.spelling = pa.array([bytes([of_byte[i]]) if i in of_byte else self.model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)], pa.large_binary())
        self.book = Book(self)
        self.runs: list[list[int]] = []  # byte runs, numbered from -1 down
        self.run_of: dict[str, int] = {}

    def byte_run(self, char: str) -> int:
        """The number of the bytes of a character that is no piece."""
        if char not in self.run_of:
            self.run_of[char] = -1 - len(self.runs)
            self.runs.append([self.bytes[b] for b in char.encode("utf-8", "surrogatepass")])
        return self.run_of[char]

    def run_weight(self, run: int) -> float:
        return self.rare * len(self.runs[-1 - run])

    def sample(self, text: str, k: int, seed: int) -> list[tuple[np.ndarray, float, float, float]]:
        return self.samples([text], k, [seed])[0]

    def samples(self, texts: list[str], k: int, seeds: list[int]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k distinct (ids, log-probability, perturbed value, inclusion probability), best perturbed first.

        All texts take each step together; what is drawn for a text depends on its own seed only.
        """
        seeds = np.array([x % 2**64 for x in seeds], np.uint64)
        roots = -np.log(-np.log(uniform_noise(seeds, 0, np.ones(len(seeds)))))
        out: list = [[(np.zeros(0, np.int32), 0.0, float(r), 1.0)] for r in roots]
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        all_ = Chunks(self.book, [texts[i] for i in full])
        lat, begin, nothing = self.book, all_.ends - all_.sizes, np.zeros(0, np.int64)
        first, edge, edge_logp = lat.first, lat.edge, lat.logp
        # value, tie, place, log p so far, edges taken already, edges before (path, its first n)
        heaps = [[(-float(roots[i]), 0, int(b), 0.0, (), (nothing, 0))] for i, b in zip(full, begin)]
        found: list[list] = [[] for _ in full]
        for step in range(1, k + 1):
            who = [t for t, h in enumerate(heaps) if h]
            if not who:
                break
            own = seeds[[full[t] for t in who]]
            draw, again = (uniform_noise(own, 2 * step + i, np.zeros(len(who))).tolist() for i in (0, 1))
            nodes, heads = [], []
            for t, u, v in zip(who, draw, again):
                value, _, place, phi, taken, before = heapq.heappop(heaps[t])
                if taken:  # one of the siblings attains the set's value; the others stay a set
                    shift = all_.shift_at(place)
                    a, b = (first[place - shift : place - shift + 2] & (1 << EDGES) - 1).tolist()
                    edges = [(e, math.exp(p), p) for e, p in enumerate(edge_logp[a:b].tolist(), a) if e not in taken]
                    left = u * sum(x for _, x, _ in edges)
                    for e, share, logp in edges:  # the last one, if rounding left something
                        left -= share
                        if left < 0:
                            break
                    if len(edges) > 1:
                        rest = phi + math.log(max(sum(x for _, x, _ in edges) - share, 5e-324))
                        heapq.heappush(heaps[t], (-cut_gumbel_once(rest, -value, v), step * (k + 1), place, phi, (*taken, e), before))
                    nodes.append((-value, place + (int(edge[e]) & (1 << 62 - BITS) - 1), phi + logp))
                    heads.append((before[0][: before[1]], [e]))
                else:
                    nodes.append((-value, place, phi))
                    heads.append((nothing, []))
            went = self._follow(all_, np.array(who), nodes, own, step, k - step + 1)
            for t, (value, _, _), (head, e), (path, logp, siblings) in zip(who, nodes, heads, went):
                whole = np.concatenate((head, np.array(e, np.int64), path)) if e else path
                found[t].append((whole, logp, value))
                ahead = len(whole) - len(path)
                for n, (g, place, e, phi, nth) in enumerate(siblings):
                    heapq.heappush(heaps[t], (-g, step * (k + 1) + 1 + n, place, phi, (e,), (whole, ahead + nth)))
        ids, ends = self._ids([x[0] for got in found for x in got])
        a = n = 0
        for i, got, heap in zip(full, found, heaps):
            kappa = -heap[0][0] if heap else -math.inf
            out[i] = []
            for _, logp, g in got:
                p = -math.expm1(-math.exp(min(700.0, logp - kappa))) if math.isfinite(kappa) else 1.0
                out[i].append((ids[a : ends[n]], logp, g, p))
                a, n = ends[n], n + 1
        return out

    def _ids(self, paths: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
        """The pieces of some paths, one after the other, with the bytes of each run in its place; where each path ends."""
        ids = self.book.piece.take(np.concatenate(paths))
        ends = np.cumsum([len(p) for p in paths])
        at = np.flatnonzero(ids < 0)
        if len(at):
            sizes = np.array([len(r) for r in self.runs])
            runs = -1 - ids[at].astype(np.int64)
            size = np.ones(len(ids), np.int64)
            size[at] = sizes[runs]
            ends = np.append(0, np.cumsum(size))[ends]
            ids = np.repeat(ids, size)
            ids[ids < 0] = np.concatenate(self.runs)[_ranges((np.cumsum(sizes) - sizes)[runs], sizes[runs])]
        return ids.astype(np.int32, copy=False), ends.tolist()

    def _follow(self, all_: Chunks, who: np.ndarray, nodes: list[tuple], seeds: np.ndarray, step: int, keep: int) -> list[tuple]:
        """A path below each node, its log-probability, and the ``keep`` best sets of siblings it passed.

        Chunks are walked side by side, each from its own start or the node's place to its end.
        """
        lat, start, stop = self.book, np.array([n[1] for n in nodes]), all_.ends[who]
        begin = stop - all_.sizes[who]
        on = start < stop
        head = np.searchsorted(all_.heads, start[on], "right") - 1
        least = np.full(len(all_.ends), len(all_.heads))  # the first chunk of each text that is walked
        least[who[on]] = head
        owner, now, ends, shift = all_.walked
        chunk = np.flatnonzero(all_.order >= least[owner])
        owner, now, ends, shift = owner[chunk], now[chunk], ends[chunk], shift[chunk]
        now[np.searchsorted(chunk, all_.nth[head])] = start[on] - all_.shift[head]
        taken = np.full(all_.length, -1, np.int32)
        streams = np.zeros(len(all_.ends), np.uint64)  # a text's places are numbered from 1
        streams[who] = (1 - begin).astype(np.uint64) * _MARK + _stream(seeds, 2 * step)
        stream = shift.astype(np.uint64) * _MARK + streams[owner]
        first, edge, low = lat.first, lat.edge, (1 << 62 - BITS) - 1
        while len(now):
            u = now.view(np.uint64) * _MARK
            u += stream
            u = _mixed(u)
            u >>= np.uint64(64 - BITS)
            u = u.view(np.int64)
            e = first[now]
            passed = u >> BITS - GUIDE
            passed <<= 3
            passed += EDGES
            np.right_shift(e, passed, out=passed)
            passed &= 255
            e &= (1 << EDGES) - 1
            e += passed
            u <<= 62 - BITS
            u += low
            got = edge[e]
            on = np.flatnonzero(got <= u)
            while len(on):  # the first edge whose share ends above the draw
                e[on] += 1
                more = edge[e[on]]
                got[on] = more
                on = on[more <= u[on]]
            taken[now + shift] = e
            got &= low
            now += got
            on = np.flatnonzero(now < ends)
            now, ends, shift, stream = now[on], ends[on], shift[on], stream[on]
        place = np.flatnonzero(taken >= 0)  # texts follow one another
        path = taken[place]
        logp = lat.logp.take(path)
        lows, highs = np.searchsorted(place, begin), np.searchsorted(place, stop)
        value, phi = np.array([x[0] for x in nodes]), np.array([x[2] for x in nodes])

        def siblings(which, before: np.ndarray, at: np.ndarray) -> np.ndarray:
            """The values of the sets of siblings at some places of paths, given the sums before these."""
            with np.errstate(divide="ignore"):
                rest = before + np.log(-np.expm1(np.minimum(logp[at], 0.0)))
            return cut_gumbel(rest, value[which], uniform_noise(seeds[which], 2 * step + 1, place[at] - begin[which] + 1))

        # sums only fall along a path: no noise lifts a place far behind above the sets that were found before it
        sizes = np.minimum(highs - lows, FIRST_PLACES)
        nth = np.arange(sizes.max())
        real = nth < sizes[:, None]
        at = np.where(real, lows[:, None] + nth, 0)
        upto = phi[:, None] + np.cumsum(np.where(real, logp[at], 0.0), axis=1) if len(nth) else np.zeros((len(nodes), 0))
        before = np.concatenate((phi[:, None], upto), axis=1)[:, : len(nth)]
        rows = np.arange(len(nodes))[:, None]
        g = np.where(real, siblings(rows, before, at), -np.inf)
        pick = np.sort(np.argpartition(-g, keep - 1, axis=1)[:, :keep], axis=1) if len(nth) > keep else np.broadcast_to(nth, g.shape)
        g, before = g[rows, pick], before[rows, pick]
        least = np.where(np.isfinite(g).sum(axis=1) == keep, g.min(axis=1, initial=np.inf), -np.inf)
        far = (highs - lows > sizes) & (-upto[:, -1:].sum(axis=1) <= MOST_NOISE - least)
        at = lows[:, None] + pick
        out = []
        for i, (a, b, *kept) in enumerate(zip(lows.tolist(), highs.tolist(), *(x.tolist() for x in (g, place[np.where(np.isfinite(g), at, 0)], path[np.where(np.isfinite(g), at, 0)], before, pick)))):
            if far[i]:
                x = np.append(phi[i], phi[i] + np.cumsum(logp[a:b]))[:-1]
                need = int(np.searchsorted(-x, MOST_NOISE - least[i], "right"))
                more = siblings([i], x[:need], np.arange(a, a + need))
                best = np.sort(np.argpartition(-more, keep - 1)[:keep]) if need > keep else np.arange(need)
                kept = more[best].tolist(), place[a + best].tolist(), path[a + best].tolist(), x[best].tolist(), best.tolist()
            out.append((path[a:b], float(phi[i] + logp[a:b].sum()), [x for x in zip(*kept) if math.isfinite(x[0])]))
        return out

    def decode(self, ids) -> str:
        return self.model.decode(np.asarray(ids))

    def spelt(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """What each of some segmentations, one after the other, decodes to in UTF-8.

        These are the bytes of their pieces, without the space that begins every text.
        """
        _, ends, data = self.spelling.take(pa.array(ids, pa.int32())).buffers()
        cuts = np.frombuffer(ends, np.int64)[np.append(0, np.cumsum(sizes))].tolist() if len(ids) else [0] * (len(sizes) + 1)
        return [data.slice(a + 1, b - a - 1).to_pybytes() if a < b else b"" for a, b in zip(cuts, cuts[1:])]


def segmenter(path: str, alpha: float) -> Segmenter:
    loaded = held("segments")
    if (path, alpha) not in loaded:
        loaded[path, alpha] = Segmenter(path, alpha)
    return loaded[path, alpha]


def sample_segmentations(rows: DataFrame, vocabulary: str, keys: list[str], text_col: str = "text", k: int = 4, alpha: float = 0.2, seed: int = 0) -> DataFrame:
    """The key columns, then sample (from 1), ids, log_prob, perturbed, inclusion and round_trip.

    ``round_trip`` tells whether the ids decode to the text. A null or empty text has one segmentation, without
    pieces; a text with fewer than k segmentations has those, each with inclusion 1. Rows with equal keys and texts
    get equal samples; null keys are keys. No rows in: no rows out. Other columns are ignored.
    """
    slim = rows.select(*keys, F.xxhash64(F.lit(seed), *keys).alias("__seed"), F.col(text_col).cast("string").alias("__text"))
    schema = slim.select(*keys).schema
    for name, kind in (("sample", "integer"), ("ids", ArrayType(IntegerType())), ("log_prob", "double"), ("perturbed", "double"), ("inclusion", "double"), ("round_trip", "boolean")):
        schema = schema.add(name, kind)
    n = len(keys)

    def out(s: Segmenter, part: pa.RecordBatch, seeds: list[int], texts: list[str]) -> pa.RecordBatch:
        got = s.samples(texts, k, seeds)
        row = np.repeat(np.arange(len(got)), [len(g) for g in got])
        flat = [x for g in got for x in g]
        sizes = np.array([len(x[0]) for x in flat])
        joined, whole = np.concatenate([x[0] for x in flat]), [t.encode() for t in texts]
        ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(joined, pa.int32()))
        trip = [x == whole[r] for x, r in zip(s.spelt(joined, sizes), row.tolist())]
        cols = [
            pa.array([j + 1 for g in got for j in range(len(g))], pa.int32()), ids, *(pa.array([x[c] for x in flat], pa.float64()) for c in (1, 2, 3)), pa.array(trip, pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in range(n)), *cols], names=schema.names)

    def run(batches):
        s = segmenter(vocabulary, alpha)
        for b in batches:
            at = 0
            while at < b.num_rows:  # texts together up to some size; one long text may exceed it
                texts, size = [], 0
                while at + len(texts) < b.num_rows and (not texts or size < BATCH_CHARS):
                    text = b.column(n + 1)[at + len(texts)].as_py() or ""
                    if texts and len(text) > 10 * BATCH_CHARS:
                        break
                    texts.append(text)
                    size += len(text)
                part = b.slice(at, len(texts))
                yield out(s, part, part.column(n).to_pylist(), texts)
                at += len(texts)
        trim_worker("segments")

    return slim.mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four distinct segmentations of every text of ``documents``, seeded by document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sample_segmentations(docs, default_vocabulary(), ["doc_id"])
