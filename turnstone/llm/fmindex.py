"""Substring dedup: words in a window of 35 that occurs anywhere else are removed.

Each shard (module repeats) gets a compressed FM-index of its snippets as strings of words: the Burrows-Wheeler
transform in a wavelet matrix, whose bit vectors are packed with one count per 64 bits, without the suffix array. Snippets
stand in it once, weighted by their number of places, and are all streamed against it from their last word to their
first: a backward step narrows the interval of the current match; when fewer than two places are left, the match
drops its last words up to the enclosing interval, found by the LCP array (a byte a word) and a bit vector for each
depth. The length reached at each word is its matching statistic, up to 35. Intervals of 35 words are
reported when two windows, as owned by their anchors, start in them: the text around a window also lies in the
snippets of its neighbours and must not count twice.

Cases: null text has no words; documents under 35 words lose nothing; rows that repeat doc_id and text are one
document and each get its result; kept words are joined by one space.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Kind, Part, covered, keyed, repeated, with_spans
from .textnum import U, pieces, word_hashes, word_spans

SPAN = 35
KIND = Kind(words=True, window=SPAN, gram=10)


class Bits:
    """A bit vector with rank: 64 bits and one count a word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(U)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words))[:-1]].astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits among the first i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((U(1) << (i & 63).astype(U)) - U(1)))


class Wavelets:
    """Wavelet matrix: symbols' bits from the highest down, zeros before ones on each level."""

    def __init__(self, symbols: np.ndarray):
        self.levels = []
        for bit in range(max(1, int(symbols.max(initial=0)).bit_length()) - 1, -1, -1):
            b = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(b), int(len(b) - b.sum())))
            symbols = np.concatenate([symbols[~b], symbols[b]])

    def rank(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often c occurs before lo and before hi."""
        start, lo, hi = np.zeros(len(c), np.int64), lo.copy(), hi.copy()
        for bit, bits, zeros in self.levels:
            one = (c >> bit & 1).astype(bool)
            s, x, y = bits.ones(start), bits.ones(lo), bits.ones(hi)
            start = np.where(one, zeros + s, start - s)
            lo = np.where(one, zeros + x, lo - x)
            hi = np.where(one, zeros + y, hi - y)
        return lo - start, hi - start


def suffixes(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``t`` over ``depth`` symbols at least, and the common prefixes of neighbours, up to it."""
    n = len(t)
    ranks, h = [], 1
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        ranks.append((h, rank))
        if h >= depth or rank.max(initial=0) == n:
            break
        key = (rank << 32) | np.r_[rank[h:], np.zeros(min(h, n), np.int64)][:n]
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[1, s[1:] != s[:-1]])
        h *= 2
    sa = np.argsort(rank, kind="stable")
    i, j = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(n + 1, np.int64)
    for size, r in reversed(ranks):
        r = np.r_[r, -np.arange(1, size + 1)]  # nothing beyond the end is equal
        same = (i < n) & (j < n) & (r[np.minimum(i, n)] == r[np.minimum(j, n)])
        lcp[1:n] += np.where(same, size, 0)
        i, j = np.where(same, i + size, i), np.where(same, j + size, j)
    lcp[0] = lcp[n] = 0
    return sa, lcp


class Edges:
    """For each depth d up to ``depth`` the places whose common prefix with the place before is shorter than d, as bits.

    Beside each 64 bits stand the nearest words before and after with a bit, so that an interval's ends take a few steps.
    """

    def __init__(self, lcp: np.ndarray, depth: int):
        n = len(lcp)
        padded = np.zeros((depth + 1, (n // 64 + 1) * 64), np.uint8)
        for d in range(depth + 1):
            padded[d, :n] = lcp < d
        padded[0, [0, n - 1]] = 1
        self.words = np.packbits(padded, axis=1, bitorder="little").view(U)
        at, some = np.arange(self.words.shape[1], dtype=np.int32), self.words != 0
        self.before = np.maximum.accumulate(np.where(some, at, 0), axis=1)
        self.after = np.minimum.accumulate(np.where(some, at, at[-1])[:, ::-1], axis=1)[:, ::-1]

    def around(self, d: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last edge of depth d up to i, and the first one after it."""
        w, mask = i >> 6, ~U(0) >> (63 - (i & 63)).astype(U)
        x, y = self.words[d, w] & mask, self.words[d, w] & ~mask
        v = np.where(x != 0, w, self.before[d, np.maximum(w - 1, 0)])
        x = np.where(x != 0, x, self.words[d, v])
        for shift in (1, 2, 4, 8, 16, 32):
            x = x | (x >> U(shift))
        z = np.where(y != 0, w, self.after[d, np.minimum(w + 1, self.words.shape[1] - 1)])
        y = np.where(y != 0, y, self.words[d, z])
        low = y & (~y + U(1))
        return v * 64 + np.bitwise_count(x) - 1, z * 64 + np.bitwise_count(low - U(1))


class Index:
    """FM-index of a string of symbols that stand for ``weight`` strings each, with intervals for matches of up to
    ``depth`` symbols. The suffix array is not kept, only sums of weights in its order: of all places, and of ``owned`` ones."""

    def __init__(self, t: np.ndarray, depth: int, weight: np.ndarray, owned: np.ndarray):
        self.n, self.depth = len(t), depth
        sa, lcp = suffixes(t, depth + 1)
        self.lcp = lcp.astype(np.uint8 if depth < 255 else np.int32)
        self.first = np.r_[0, np.cumsum(np.bincount(t))]
        self.bwt = Wavelets(t[sa - 1])  # the symbol before the first place is the last one, a separator
        self.mass, self.owned = (np.r_[0, np.cumsum(x[sa])] for x in (weight, owned * weight))
        self.edges = Edges(self.lcp, depth)

    def matches(self, t: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each symbol of the ranges of ``t``, the longest match from it on that occurs twice (up to depth, and
        within its range), and the interval of that match. Ranges move on side by side, from their ends."""
        length, lo_of, hi_of = (np.zeros(len(t), np.int64) for _ in range(3))
        f, stop = end - 1, begin
        lo, hi, q = np.zeros(len(f), np.int64), np.full(len(f), self.n), np.zeros(len(f), np.int64)
        live = np.flatnonzero(f >= stop)
        f, stop, lo, hi, q = f[live], stop[live], lo[live], hi[live], q[live]
        while len(f):
            c = t[f]
            a, b = self.bwt.rank(c, lo, hi)
            a, b = a + self.first[c], b + self.first[c]
            ok = self.mass[b] - self.mass[a] >= 2
            up = ~ok & (q > 0)
            # widen to the enclosing interval: the longest shorter match with more places
            d = np.maximum(self.lcp[lo], self.lcp[hi])
            q, lo, hi = np.where(ok, q + 1, np.where(up, np.minimum(d, q - 1), 0)), np.where(ok, a, lo), np.where(ok, b, hi)
            q = np.minimum(q, self.depth)
            wide = np.flatnonzero(~ok | (q == self.depth))
            lo[wide], hi[wide] = self.edges.around(q[wide], lo[wide])
            done = ~up
            at = f[done]
            length[at], lo_of[at], hi_of[at] = q[done], lo[done], hi[done]
            f = f - done
            live = f >= stop
            if not live.all():
                f, stop, lo, hi, q = f[live], stop[live], lo[live], hi[live], q[live]
        return length, lo_of, hi_of


def repeated_windows(part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = part.content
    s, e, first = word_spans(buf, part.begin)
    sizes = np.diff(first)
    ids = np.unique(word_hashes(buf, s, e), return_inverse=True)[1].astype(np.int64) + 1
    k = np.repeat(np.arange(len(sizes)), sizes)
    t = np.zeros(len(ids) + len(sizes), np.int64)  # a separator, 0, after each snippet
    where = np.arange(len(ids)) + k
    t[where] = ids
    begin = first[:-1] + np.arange(len(sizes))
    wins = sizes - SPAN + 1
    snippet = np.repeat(np.arange(len(sizes)), wins)
    shift = np.arange(len(snippet)) - np.repeat(np.cumsum(wins) - wins, wins)
    start = begin[snippet] + shift
    weight, owned = np.repeat(part.copies, sizes + 1), np.zeros(len(t), bool)
    owned[start] = True
    index = Index(t, SPAN, weight, owned)
    length, lo, hi = index.matches(t, begin, begin + sizes)
    again = (length[start] >= SPAN) & (index.owned[hi[start]] - index.owned[lo[start]] >= 2)
    a = np.flatnonzero(again & ~(np.r_[False, again[:-1]] & (shift > 0)))
    b = np.flatnonzero(again & ~(np.r_[again[1:], False] & (shift < wins[snippet] - 1)))
    return snippet[a], shift[a], shift[b]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    docs = keyed(docs)
    spans = repeated(docs.select("rid", "doc_id", "text").where("text is not null"), KIND, repeated_windows, spare_first=False)

    def apply(batches):
        for b in batches:
            n_words, n_removed, digest = [], [], []
            lists = b.column("spans")
            for i, j, buf, off in pieces(b):
                s, e, first = word_spans(buf, off)
                gone = covered(lists, i, j, first, SPAN)
                total = np.r_[0, np.cumsum(gone)]
                n_words.append(np.diff(first))
                n_removed.append(np.diff(total[first]))
                s, e = s[~gone], e[~gone]
                size = e - s + 1
                at = np.cumsum(size) - size
                out = np.full(int(size.sum()), 32, np.uint8)
                word = np.repeat(np.arange(len(s)), size - 1)
                byte = np.arange(len(word)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
                out[at[word] + byte] = buf[s[word] + byte]
                kept = out.tobytes()
                ends = np.r_[at, len(out)][first - total[first]]
                digest += [hashlib.sha256(kept[x : max(x, y - 1)]).hexdigest() for x, y in zip(ends[:-1], ends[1:], strict=True)]
            if n_words:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(n_words).astype(np.int64)), pa.array(np.concatenate(n_removed).astype(np.int64)), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_spans(docs, spans).select("doc_id", "text", "spans").mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string")
