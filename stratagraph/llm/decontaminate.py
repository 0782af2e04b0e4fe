"""Benchmark decontamination by training suffix arrays.

Each task builds suffix arrays over pieces (shards) of the training texts by naming word
runs of length 1, 2, 4 and 8 (prefix doubling); the names of the last level are
the order of the suffix array. The first n words of every benchmark suffix are found by binary
search, level by level. The places found, and the items they come from, are then put into a suffix
array of full depth, in which the neighbours of each place give its longest verbatim match: how
many words, of which item, from where. Documents with a match of n words go.

A benchmark is searched in blocks of about ``BLOCK_CHARS``; the suffix array of a piece is built
once and its blocks are loaded one after another. An item longer than a block is cut into segments
that overlap by n - 1 words, so its windows are all there and its matches end with a segment.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. A benchmark
item of fewer than ``n`` words (but not none) is one window.

Nulls: a null text has no words and is not contaminated; a null item text is no
item; a null item id is written as an empty string. Items with equal ids are one
item. Repeated documents are each returned. No benchmark: nothing is hit; no documents: no rows.
Clashing output names get underscores. Of matches equally long the item that comes first in the benchmark's block is named.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_text, fresh, map_text, stored
from .substring import subtree
from .textcore import ALNUM_WORDS, Words

U64 = np.uint64
#: Characters of benchmark text that one pass over the documents may hold.
BLOCK_CHARS = 2 << 20
#: Training text in one suffix array.
SHARD_BYTES = 2 << 20
LEVELS = (1, 2, 4, 8)


@dataclass
class Items:
    """A block of benchmark items.

    windows: length -> (distinct windows as word hashes, first, owners); owners[first[k]:first[k + 1]] are the items of window k.
    h, first, item, begin: the words of the rows, where each row's begin, its item, and the place of its first word in the item.
    """

    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    ids: list[str]
    h: np.ndarray
    first: np.ndarray
    item: np.ndarray
    begin: np.ndarray


def items_of(rows: list[tuple], n: int) -> Items:
    """Rows (item id, text) or (item id, text, place of the text's first word) as a block."""
    rows = sorted((("" if r[0] is None else str(r[0]), r[2] if len(r) > 2 else 0, r[1]) for r in rows if r[1] is not None))
    ids = sorted({r[0] for r in rows})
    at = {x: k for k, x in enumerate(ids)}
    item = np.array([at[r[0]] for r in rows], np.int64)
    data = [r[2].encode() for r in rows]
    off = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    w = Words(np.frombuffer(b"".join(data), np.uint8), off, ALNUM_WORDS, lower=True)
    h, size, out = w.hashes(), np.diff(w.first), {}
    end = np.repeat(w.first[1:], size)
    for m in np.unique(np.minimum(size, n)).tolist():
        if m:
            start = np.flatnonzero((np.arange(len(h)) + m <= end) & (size[w.doc] >= n if m == n else size[w.doc] == m))
            name = subtree(h, end, start, m) - 1
            _, lead = np.unique(name, return_index=True)
            own = np.unique(name * len(ids) + item[w.doc[start]])
            out[m] = h[start[lead][:, None] + np.arange(m)], np.searchsorted(own // len(ids), np.arange(len(lead) + 1)), own % len(ids)
    return Items(out, ids, h, w.first, item, np.array([r[1] for r in rows], np.int64))


def _name(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each entry's rank from 1, and the sorting order."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    rank = np.empty(len(s), U64)
    rank[order] = np.cumsum(new).astype(U64)
    return s[new], rank, order


def _find(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Ranks of keys among known ones by binary search; 0 if missing."""
    if not len(known):
        return np.zeros(len(keys), U64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at + 1, 0).astype(U64)


class SuffixArray:
    """Suffix array of the words of several texts, to a depth of eight words."""

    def __init__(self, h: np.ndarray, doc: np.ndarray):
        self.doc, self.known, self.rank, self.order, self.sorted = doc, {}, {}, {}, {}
        for p in LEVELS:
            if p == 1:
                keys = h
            else:
                q, prev = p // 2, self.rank[p // 2]
                keys = prev << U64(32)
                if len(h) > q:
                    same = doc[q:] == doc[:-q]
                    keys[:-q] |= np.where(same, prev[q:], 0).astype(U64)
            self.known[p], self.rank[p], order = _name(keys)
            self.order[p] = order

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window number, place) at which a window of m word hashes starts."""
        n, m = windows.shape
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.doc):
            return none
        names = {1: _find(self.known[1], windows.ravel()).reshape(n, m)}
        left, p = np.flatnonzero((names[1] > 0).all(1)), 1
        t, word = names[1][left], names[1][left]
        while 2 * p <= min(m, LEVELS[-1]):
            a, b = t[:, : t.shape[1] - p], t[:, p:]
            t = _find(self.known[2 * p], (a << U64(32) | b).ravel()).reshape(a.shape)
            p *= 2
            ok = (t[:, ::p] > 0).all(1)
            t, word, left = t[ok], word[ok], left[ok]
        if not len(left):
            return none
        rank, order = self.rank[p], self.order[p]
        if p not in self.sorted:
            self.sorted[p] = rank[order]
        lo, hi = np.searchsorted(self.sorted[p], t[:, 0]), np.searchsorted(self.sorted[p], t[:, 0], "right")
        size = hi - lo
        w = np.repeat(np.arange(len(left)), size)
        place = order[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())]
        # p words agree, in one text or up to its end; the rest is compared
        fits = place + m <= len(self.doc)
        w, place = w[fits], place[fits]
        ok = self.doc[place] == self.doc[place + m - 1]
        for k in range(p, m):
            ok &= self.rank[1][np.minimum(place + k, len(self.doc) - 1)] == word[w, k]
        return left[w[ok]], place[ok]


def _lcp(levels: list[np.ndarray], end: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words that suffixes x and y have in common, from the names of runs of 1, 2, 4, ... words."""
    got = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j, p = x + got, y + got, 1 << k
        ok = np.flatnonzero((i + p <= end[x]) & (j + p <= end[y]))
        got[ok] += p * (levels[k][i[ok]] == levels[k][j[ok]])
    return got


def longest_matches(h: np.ndarray, run: np.ndarray, items: Items, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the training runs: the longest match from there on with an item, and its place among the block's words.

    h: words; run: number of the run that each word is in (ascending); used: the items to compare with.
    """
    rows = np.flatnonzero(np.isin(items.item, used))
    size = items.first[rows + 1] - items.first[rows]
    place = np.repeat(items.first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
    text = np.concatenate([run, (run[-1] + 1 if len(run) else 0) + np.repeat(np.arange(len(rows)), size)])
    both, n = np.concatenate([h, items.h[place]]), len(h)
    cut = np.append(np.flatnonzero(np.diff(text)), len(text) - 1)
    end = np.repeat(cut + 1, np.diff(np.concatenate([[-1], cut])))
    at, levels, p = np.arange(len(both)), [_name(both)[1].astype(np.int64)], 1
    while p < (end - at).max():
        key = levels[-1] << 32
        ok = at + p < end
        key[ok] |= levels[-1][at[ok] + p]
        levels.append(_name(key)[1].astype(np.int64))
        p *= 2
    # the suffix array; the items' suffixes next to a training suffix on either side share most with it
    order = np.lexsort((at, levels[-1]))
    theirs = order >= n
    before = np.maximum.accumulate(np.where(theirs, at, -1))
    after = np.minimum.accumulate(np.where(theirs, at, len(at))[::-1])[::-1]
    best, where = np.zeros(len(both), np.int64), np.zeros(len(both), np.int64)
    for side, ok in ((before, before >= 0), (after, after < len(at))):
        x = np.flatnonzero(ok & ~theirs)
        mine, other = order[x], order[side[x]]
        got = _lcp(levels, end, mine, other)
        better = got > best[mine]
        best[mine[better]], where[mine[better]] = got[better], other[better]
    return best[:n], place[np.maximum(where[:n] - n, 0)] if len(place) else where[:n]


_MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_start", T.LongType()), T.StructField("doc_start", T.LongType()), T.StructField("words", T.LongType())]))


class Scan:
    """A piece of training text searched block after block."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.w = w = Words(raw, offsets, ALNUM_WORDS, lower=True)
        self.n, self.h = len(offsets) - 1, w.hashes()
        self.hit = np.zeros(len(w), bool)
        self.sa = SuffixArray(self.h, w.doc) if len(w) else None
        self.found: list[set[str]] = [set() for _ in range(self.n)]
        self.matches: list[tuple] = []  # (document, place in it, words, item, place in the item)

    def search(self, items: Items) -> None:
        w, hit, pairs = self.w, np.zeros(len(self.w), bool), []
        starts = np.zeros(len(w), bool)
        for m, (win, first, own) in items.windows.items() if self.sa else ():
            k, place = self.sa.search(win)
            if not len(k):
                continue
            starts[place] = True
            d = np.bincount(place, minlength=len(w) + 1) - np.bincount(place + m, minlength=len(w) + 1)
            hit |= np.cumsum(d[:-1]) > 0
            seen = np.unique(w.doc[place].astype(np.int64) * len(win) + k)
            doc, k = seen // len(win), seen % len(win)
            size = first[k + 1] - first[k]
            at = np.repeat(first[k] - np.cumsum(size) + size, size) + np.arange(size.sum())
            pairs.append(np.repeat(doc, size) * len(items.ids) + own[at])
        if not pairs:
            return
        seen = np.unique(np.concatenate(pairs))
        for x in seen.tolist():
            self.found[x // len(items.ids)].add(items.ids[x % len(items.ids)])
        self.hit |= hit
        at = np.flatnonzero(hit)
        run = np.cumsum(np.concatenate([[0], (np.diff(at) != 1) | (w.doc[at[1:]] != w.doc[at[:-1]])]))
        size, where = longest_matches(self.h[at], run, items, np.unique(seen % len(items.ids)))
        # where a window starts and the match isn't the rest of the one before
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (size[1:] != size[:-1] - 1)])
        new[1:] |= ~starts[at[:-1]]
        new &= starts[at]
        at, size, where = at[new], size[new], where[new]
        row = np.searchsorted(items.first, where, "right") - 1
        for d, i, m, o, j in zip(w.doc[at].tolist(), (at - w.first[w.doc[at]]).tolist(), size.tolist(), items.item[row].tolist(), (where - items.first[row] + items.begin[row]).tolist(), strict=True):
            self.matches.append((d, i, m, items.ids[o], j))

    def columns(self) -> list[pa.Array]:
        """Per text: words, hit words, items with an occurring window, words of the longest match, and the matches."""
        w, total = self.w, np.concatenate([[0], np.cumsum(self.hit)])
        longest, self.matches = np.zeros(self.n, np.int64), sorted(self.matches)
        doc = np.array([m[0] for m in self.matches], np.int64)
        np.maximum.at(longest, doc, np.array([m[2] for m in self.matches], np.int64))
        col = lambda k, kind=None: pa.array([m[k] for m in self.matches], kind or pa.int64())
        matches = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(self.n + 1)), pa.int32()), pa.StructArray.from_arrays([col(3, pa.string()), col(4), col(1), col(2)], ["item_id", "item_start", "doc_start", "words"]))
        return [pa.array(np.diff(w.first)), pa.array(total[w.first[1:]] - total[w.first[:-1]]), pa.array([sorted(x) for x in self.found], pa.list_(pa.string())), pa.array(longest), matches]


def segments(benchmark: DataFrame, n: int, limit: int) -> DataFrame:
    """Rows (i, t, o) of items (i, t): texts longer than ``limit`` bytes are cut, overlapping by n - 1 words; o is the place of the first word."""
    schema = T.StructType([T.StructField("i", T.StringType()), T.StructField("t", T.StringType()), T.StructField("o", T.LongType())])

    def make():
        def f(raw, off, rows):
            ids, texts, begin = [], [], []
            for k, i in enumerate(rows.column(0).to_pylist()):
                own = raw[off[k] : off[k + 1]]
                if len(own) <= limit:
                    ids.append(i), texts.append(own.tobytes().decode()), begin.append(0)
                    continue
                w = Words(own, np.array([0, len(own)]), ALNUM_WORDS)
                a = 0
                while True:
                    b = min(len(w), max(a + n, int(np.searchsorted(w.end, w.start[a] + limit)))) if len(w) else 0
                    if b:
                        ids.append(i), texts.append(own[w.start[a] : w.end[b - 1]].tobytes().decode()), begin.append(a)
                    if b >= len(w):
                        break
                    a = b - n + 1
            return [pa.array(ids, pa.string()), pa.array(texts, pa.string()), np.array(begin, np.int64)]

        return f

    return flat_text(benchmark, "t", make, schema, SHARD_BYTES)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, keep: list[str] | None = None, names: tuple[str, str, str, str, str] = ("n_words", "n_hit", "items", "longest_match", "matches")) -> DataFrame:
    """Adds, to each document: n_words, n_hit, items (ids as strings, sorted), the words of its longest match and all
    matches (item_id, item_start, doc_start, words) that are not the rest of another one.

    One pass over the documents without a shuffle, whatever the number of blocks; only one block of the
    benchmark is on the driver, or in a task, at a time.
    """
    keep = docs.columns if keep is None else keep
    bench = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    chars, longest = bench.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.coalesce(F.max(F.octet_length("t")), F.lit(0))).first()
    if longest > BLOCK_CHARS:
        bench = segments(bench, n, BLOCK_CHARS)
    else:
        bench = bench.withColumn("o", F.lit(0).cast("long"))
    blocks = -(-chars // BLOCK_CHARS) or 1
    if blocks > 1:
        bench = stored(bench)
    fields = [T.StructField(x, kind) for x, kind in zip(names, (T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.LongType(), _MATCH), strict=True)]
    sc = docs.sparkSession.sparkContext
    sent = []
    for b in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("i", "o", "t"), F.lit(blocks)) == b) if blocks > 1 else bench
        sent.append(sc.broadcast(items_of([tuple(r) for r in part.select("i", "t", "o").collect()], n)))

    def make():
        def block(b):
            # of several blocks none is kept in memory
            return b.load_from_path(b._path) if len(sent) > 1 and getattr(b, "_path", None) else b.value

        def f(raw, off, _):
            got = Scan(raw, off)
            for b in sent:
                got.search(block(b))
            return got.columns()

        return f

    return map_text(docs, text, make, fields, keep, SHARD_BYTES)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_hit_share: float = 0.0) -> DataFrame:
    """The documents without a benchmark passage, with their own columns.

    A document goes if more than ``max_hit_share`` of its words are hit.
    """
    names = tuple(fresh(docs, x) for x in ("sg_words", "sg_hit", "sg_items", "sg_longest", "sg_matches"))
    got = scan(docs, benchmark, n=n, names=names)
    return got.where(F.col(names[1]) <= max_hit_share * F.col(names[0])).select(*docs.columns)
