"""Suffix order of a set of byte strings by prefix-free parsing: suffix arrays of dictionary and parse, combined.

A rolling hash of ``OVERLAP`` bytes triggers phrase boundaries, so equal text is cut alike wherever it stands. Each
phrase runs to the end of the next trigger, and consecutive phrases share those bytes; so no phrase is a prefix of
another (but for the last of a string, which ends with it). The distinct phrases are the dictionary, and the strings
as numbers of phrases the parse. Text that repeats is in the dictionary once.

Suffix ranks of both are found by prefix doubling; only places not told apart yet are sorted again. A place of the
text lies in one phrase, and its suffix is ordered by (rank of what is left of the phrase, rank of the parse from the
next phrase on): that is the order of the text itself.
"""

from __future__ import annotations

import numpy as np

OVERLAP = 16
PHRASE = 24  # mean bytes between triggers
_BYTES = np.random.default_rng(400).integers(0, 2**64, 256, dtype=np.uint64)


def join_hashes(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of a string from those of its two parts; ``size`` tells the levels apart."""
    x = left * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + right
    return x ^ (x >> np.uint64(29))


def fingerprints16(data: np.ndarray) -> np.ndarray:
    """Fingerprints of all strings of 16 bytes."""
    h = _BYTES[data]
    for k in (1, 2, 4, 8):
        h = join_hashes(h[:-k], h[k:], k) if len(h) > k else h[:0]
    return h


def triggers(h16: np.ndarray) -> np.ndarray:
    return np.flatnonzero(h16 % np.uint64(PHRASE) == 0)


def suffix_ranks(first: np.ndarray, ends: np.ndarray, known: int) -> np.ndarray:
    """Ranks of suffixes: ``first`` orders them by their ``known`` first symbols, ``ends`` is where each one's end
    mark stands (an empty suffix, ranked lowest). Equal suffixes have equal ranks."""
    n = len(first)
    order = np.argsort(first, kind="stable")
    s = first[order]
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(start, append=n)
    rank = np.empty(n, np.int32)  # a partition has far fewer than 2**31 bytes
    rank[order] = np.repeat(start.astype(np.int32), size)
    open_ = order[np.repeat(size > 1, size)]
    open_ = open_[ends[open_] - open_ >= known]
    while len(open_):
        nxt = rank[np.minimum(open_ + known, ends[open_])]
        now = rank[open_]
        order = np.lexsort((nxt, now))
        open_, now, nxt = open_[order], now[order], nxt[order]
        old = np.append(True, now[1:] != now[:-1])
        new = old | np.append(True, nxt[1:] != nxt[:-1])
        at = np.arange(len(open_))
        head = np.maximum.accumulate(np.where(old, at, 0))
        sub = np.maximum.accumulate(np.where(new, at, 0))
        rank[open_] = now + (sub - head).astype(np.int32)
        cut = np.flatnonzero(new)
        size = np.diff(cut, append=len(open_))
        known *= 2
        open_ = open_[np.repeat(size > 1, size)]
        open_ = open_[ends[open_] - open_ >= known]
    return rank


def dictionary_ranks(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(where each phrase starts, rank of the suffix at each place) of all phrases, each followed by an end mark."""
    lens = np.array([len(p) for p in phrases], np.int64)
    starts = np.cumsum(lens + 1) - (lens + 1)
    symbols = np.frombuffer(b"\0".join(phrases) + b"\0", np.uint8).astype(np.int64) + 1
    marks = starts + lens
    symbols[marks] = 0
    ends = np.repeat(marks, lens + 1)
    at = np.arange(len(symbols))
    first = np.zeros(len(symbols), np.int64)
    for k in range(7):  # 257**7 < 2**63
        first = first * 257 + symbols[np.minimum(at + k, ends)]
    return starts, suffix_ranks(first, ends, 7)


class SuffixOrder:
    """The parse of some strings, and the order of their suffixes."""

    def __init__(self, strings: list[bytes]):
        self.lens = np.array([len(s) for s in strings], np.int64)
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.h16 = fingerprints16(self.data)
        cut = triggers(self.h16)
        owner = np.searchsorted(self.ends, cut, "right")
        cut = cut[(cut + OVERLAP <= self.ends[owner]) & (cut > self.starts[owner])]  # within one string
        full = self.starts[self.lens > 0]
        self.heads = np.union1d(cut, full)  # first place of each phrase
        owner = np.searchsorted(self.ends, self.heads, "right")
        last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
        tails = np.where(last, self.ends[owner], np.append(self.heads[1:], 0) + OVERLAP)
        raw = self.data.tobytes()
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(self.heads.tolist(), tails.tolist())], np.int64)
        self.phrase_at, self.suffix = dictionary_ranks(list(number)) if number else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.ids = ids
        # the parse: phrases by rank, each string followed by an end mark
        place = np.arange(len(ids)) + np.cumsum(np.append(0, last[:-1]))  # end marks shift later strings
        total = len(ids) + int(last.sum())
        seq, ends = np.zeros(total, np.int64), np.full(total, -1, np.int64)
        seq[place] = self.suffix[self.phrase_at[ids]] + 1 if len(ids) else 0
        marks = place[last] + 1
        ends[marks] = marks
        ends = np.minimum.accumulate(np.where(ends < 0, total, ends)[::-1])[::-1]
        self.next = place + 1  # in the parse, what follows each phrase
        self.parse = suffix_ranks(seq, ends, 1)

    def sort(self, places: np.ndarray) -> np.ndarray:
        """The places in the order of the text that starts there and runs to the end of its string."""
        phrase = np.searchsorted(self.heads, places, "right") - 1
        left = self.suffix[self.phrase_at[self.ids[phrase]] + places - self.heads[phrase]]
        return places[np.lexsort((self.parse[self.next[phrase]], left))]

    def equal_neighbours(self, ordered: np.ndarray, length: int) -> np.ndarray:
        """Whether each place's string of ``length`` bytes equals that of the place before it in the order.

        Fingerprints tell which may be; the bytes of those are compared. Where the pair of the places before is equal
        too, the last byte decides.
        """
        out = np.zeros(len(ordered), bool)
        if len(ordered) < 2:
            return out
        half = 16
        h = self.h16
        while 2 * half <= length:
            h = join_hashes(h[:-half], h[half:], half) if len(h) > half else h[:0]
            half *= 2
        fp = join_hashes(h[ordered], h[ordered + length - half], 3)
        pick = np.flatnonzero(fp[1:] == fp[:-1]) + 1
        a, b = ordered[pick], ordered[pick - 1]
        order = np.argsort(a)
        pick, a, b = pick[order], a[order], b[order]
        chained = np.append(False, (a[1:] == a[:-1] + 1) & (b[1:] == b[:-1] + 1)) if len(a) else np.zeros(0, bool)
        same = self.data[a + length - 1] == self.data[b + length - 1]
        view = np.lib.stride_tricks.sliding_window_view(self.data, length)

        def compare(which):
            for at in range(0, len(which), 20_000):
                w = which[at : at + 20_000]
                same[w] = (view[a[w]] == view[b[w]]).all(axis=1)

        compare(np.flatnonzero(~chained))
        if not same.all():  # a chain may hang on a chance collision
            compare(np.arange(len(a)))
        out[pick] = same
        return out
