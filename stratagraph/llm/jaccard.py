"""N-gram Jaccard join by T-occurrence search (DivideSkip), and its classes.

Documents are sets of distinct word shingles; two link when the Jaccard similarity of
their sets is at least ``num / den``. All links between different sets are found and verified;
the result is the connected component of every document and the number of its links.

1. Equal sets are one class (a group-by on a 128-bit fingerprint of the set), so
   copies never pair up.
2. Dealing to shards, without loss. Sets are banded by size so that linked sets lie in the same or in
   neighbouring bands. On each level (two bands) the shingles are dealt by hash to
   D + 1 + E parts, D the largest symmetric difference that a linked pair of the level can
   have. Linked sets agree entirely in at least 1 + E parts, hence share the signature of a
   part that isn't empty unless both have more than E empty parts; those few sets are keyed
   by the shingles of their prefix as well. Sets with a key in common are chained (a forest,
   never pairs), and the connected components of the chains are the shards. Keys common within
   a piece of text are chained there and sent once, so hot groups shrink before the shuffle.
3. Each shard runs the T-occurrence search: inverted lists of its shingles (lists with the same members are one with a weight); for a query with
   the least overlap T, the longest lists of weight L are set aside, the short ones are merged in a heap, and
   candidates of T - L occurrences are probed in the long ones by binary search (or these are read through,
   where candidates are so many that it costs less). Every candidate is verified. Links leave a task counted by document,
   with a forest of them for the components; pairs are never rows.
4. A shard over ``shard_rows`` sets is never held by one task. Chains glue such shards together by keys that many sets have, so
   they are first parted anew without these: linked sets have ``need`` keys of a level in common, hence also one among those that
   are left of each when its need - 1 most frequent keys go (prefix filter). What stays larger is cut into blocks, and each pair of
   blocks (and each block with itself) is a cell that is searched as a shard is; blocks grow with their shard, up to a bound.

Words are [^\\x20\\x09-\\x0D]+ (A-Z lower-cased if ``lower``); a document of fewer than n words, but not none, is one shingle.
Nulls: a null or empty text has no shingle and links with nothing; ids as in
``substring.numbered``. Repeated rows are members of the same class. Empty table: no rows.
"""

from __future__ import annotations

import heapq
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, flat_text, fresh, give_back, map_text, settle, small_or_not, stored, with_group
from .substring import numbered
from .textcore import BLANK_WORDS, Words, mix, rolling, windows

U64 = np.uint64
#: Sets that one task may hold as a shard, and bytes of text behind one partition of signatures.
SHARD_ROWS = 1000
#: Sets that a task searches, on average, in shards one after another.
TASK_ROWS = 500
PART_BYTES = 8 << 20
PIECE_BYTES = 2 << 20
_MASK32 = U64(0xFFFFFFFF)


def shingles(raw: np.ndarray, off: np.ndarray, n: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash), distinct, in no order."""
    w = Words(raw, off, BLANK_WORDS, lower)
    h = w.hashes()
    start = windows(w.first, w.doc, n)
    doc, sh = [w.doc[start]], [rolling(h, n)[start]]
    size = np.diff(w.first)
    for m in range(1, n):
        few = np.flatnonzero(size == m)
        if len(few):
            doc.append(few)
            sh.append(mix(rolling(h, m)[w.first[few]] ^ U64(m)))
    doc, sh = np.concatenate(doc), np.concatenate(sh)
    key = sh ^ mix(doc.astype(U64) + U64(1))
    order = np.argsort(key)
    s = key[order]
    own = order[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else order
    return doc[own], sh[own]


def _sums(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """64-bit sums of x by number, modulo 2**64 of (high, low) sums; exact for under 2**21 terms."""
    low = np.bincount(at, (x & _MASK32).astype(np.float64), n).astype(np.int64).astype(U64)
    high = np.bincount(at, (x >> U64(32)).astype(np.float64), n).astype(np.int64).astype(U64)
    return low + (high << U64(32))


class Bands:
    """Size bands and the parts of each level for a threshold num / den."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        b = [1]
        while b[-1] <= largest:
            b.append(b[-1] * den // num + 1)
        b += [b[-1] * den // num + 1] * 2
        self.lower = np.array(b, np.int64)
        parts, spare = [], []
        for k in range(len(b) - 2):
            top = b[k + 1] - 1
            d = (den - num) * (top + top * den // num) // (den + num)
            e = 0
            while e < b[k]:
                n = d + 1 + e
                mean = n * math.exp(-b[k] / n)
                if d == 0 or mean + 4 * math.sqrt(mean) <= e:
                    break
                e += 1
            parts.append(d + 1 + e)
            spare.append(e)
        self.parts, self.spare = np.array(parts, np.int64), np.array(spare, np.int64)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lower, size, "right") - 1

    def prefix(self, size: np.ndarray) -> np.ndarray:
        """Shingles of a set that hold one of every linked set's least shingles."""
        return size - -(-size * self.num // self.den) + 1


@lru_cache(4)
def bands(num: int, den: int, bits: int) -> Bands:
    return Bands(num, den, 1 << bits)


def signatures(doc: np.ndarray, sh: np.ndarray, n: int, num: int, den: int, bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, key) and what each slot needs. A slot is 2 * text + (0: own band's level, 1: the level below).

    Linked sets have, in slots of one level, at least ``need`` keys in common. ``bits``: the slots of each text that count (3: both).
    """
    size = np.bincount(doc, minlength=n)
    b = bands(num, den, max(16, int(size.max(initial=1)).bit_length()))
    band = b.of(np.maximum(size, 1))
    slots, keys, need = [], [], np.zeros(2 * n, np.int64)
    for down in (0, 1):
        level = band - down
        ok = (level >= 0) & (size > 0)
        if bits is not None:
            ok &= (bits >> down & 1) > 0
        level = np.maximum(level, 0)
        k = np.where(ok, b.parts[level], 0)
        first = np.concatenate([[0], np.cumsum(k)])
        own = ok[doc]
        d, x = doc[own], sh[own]
        seed = mix(level.astype(U64) + U64(77))
        part = (((mix(x ^ seed[d]) >> U64(32)) * k[d].astype(U64)) >> U64(32)).astype(np.int64)
        at = first[d] + part
        total = _sums(at, mix(x + U64(0x9E3779B97F4A7C15)), int(first[-1]))
        full = np.bincount(at, minlength=int(first[-1])) > 0
        owner = np.repeat(np.arange(n), k)
        place = np.arange(first[-1]) - first[owner]
        key = mix(total ^ mix((level[owner].astype(U64) << U64(32)) + place.astype(U64)))
        slots.append(2 * owner[full] + down)
        keys.append(key[full])
        empty = k - np.bincount(owner[full], minlength=n)
        need[down::2] = np.where(ok, b.spare[level] + 1 - empty, 1)
        over = np.flatnonzero(ok & (empty > b.spare[level]))
        need[2 * over + down] = 0
        for o in over:  # few: keyed by the least shingles as well, among themselves
            least = np.sort(mix(sh[doc == o]))[: int(b.prefix(size[o]))]
            slots.append(np.full(len(least), 2 * o + down))
            keys.append(mix(least ^ mix(level[o : o + 1].astype(U64) + U64(1 << 50))))
    return np.concatenate(slots), np.concatenate(keys), need


class Forest:
    """Union-find over numbers 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def chains(key: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest (a, b) connecting the numbers d that have a key in common; and which entries are first of their key."""
    if not len(key):
        return d, d, np.zeros(0, bool)
    order = np.argsort(key)
    k, x = key[order], d[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(x, at)[np.cumsum(new) - 1]
    more = np.flatnonzero(x != least)
    kinds, pair = np.unique(np.stack([least[more], x[more]]), return_inverse=True)
    pair = pair.reshape(2, -1)
    edges = np.unique((pair[0].astype(np.int64) << 32) | pair[1])
    f = Forest(len(kinds))
    kept = np.array([e for e in edges.tolist() if f.join(e >> 32, e & 0xFFFFFFFF)], np.int64)
    first = np.zeros(len(key), bool)
    hit = x == least
    # one entry a key: the first in order among those with the least number
    lead = np.flatnonzero(hit)
    group = (np.cumsum(new) - 1)[lead]
    first[order[lead[np.concatenate([[True], group[1:] != group[:-1]])]]] = True
    return kinds[kept >> 32], kinds[kept & 0xFFFFFFFF], first


def heap_merge(runs: list[list[int]], weights: list[int], need: int) -> tuple[list[int], list[int]]:
    """Numbers whose runs weigh at least ``need`` together, ascending, and these weights: the ascending runs meet in a heap."""
    k = len(runs)
    rest = [iter(r) for r in runs]
    heap = [next(r) * k + j for j, r in enumerate(rest)]
    heapq.heapify(heap)
    now, have, found, total = -1, 0, [], []
    while heap:
        v, j = divmod(heap[0], k)
        after = next(rest[j], None)
        if after is None:
            heapq.heappop(heap)
        else:
            heapq.heapreplace(heap, after * k + j)
        if v != now:
            if have >= need:
                found.append(now)
                total.append(have)
            now, have = v, 0
        have += weights[j]
    if have >= need:
        found.append(now)
        total.append(have)
    return found, total


def inverted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, list) of each entry of the inverted lists, by set; and each list's weight: lists with the same members are one."""
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    m = int(at.max()) + 1
    a, b = (_sums(at, mix(owner.astype(U64) + U64(x)), m) for x in (1, 1 << 40))  # 128 bits name the members
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    kind = np.empty(m, np.int64)
    kind[order] = np.cumsum(new) - 1
    lead = np.zeros(m, bool)
    lead[order[new]] = True
    own = lead[at]
    return owner[own], kind[at[own]], np.bincount(kind)


def divide_skip(sets: list[np.ndarray], num: int, den: int, queries: int | None = None) -> np.ndarray:
    """All links (q, c) among sorted sets, each once; with ``queries``, all links of the first so many to the others."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n < 2:
        return np.zeros((0, 2), np.int64)
    owner, at, weight = inverted(sets)
    first = np.searchsorted(owner, np.arange(n + 1))
    order = np.lexsort((owner, at))
    if queries is not None:
        order = order[owner[order] >= queries]
    lists, begin = owner[order], np.searchsorted(at[order], np.arange(len(weight) + 1))
    plain = lists.tolist()
    code = at[order] * n + lists  # ascending: a list is probed for a set by one binary search
    left, end = begin[:-1].copy(), begin[1:]
    links = []
    mu = 0.0085  # fixed value: weight of a binary probe in the choice of the long lists
    for q in range(n if queries is None else queries):
        s = int(size[q])
        t = -(-s * num // den)  # least overlap with any set that links
        mine = at[first[q] : first[q + 1]]
        if queries is None:
            left[mine] += 1  # lists go by sets: what stands before was a query, and found its links to q
        length = end[mine] - left[mine]
        by = np.argsort(length, kind="stable")
        mine, length = mine[by], length[by]
        # the longest lists are set aside, as many as leave a candidate at least one short list
        spare = min(t - 1, int(t / (mu * math.log2(int(length[-1]) + 1) + 1)))
        heavy = np.cumsum(weight[mine[::-1]])
        n_long = int(np.searchsorted(heavy, spare, "right"))
        aside = int(heavy[n_long - 1]) if n_long else 0
        short, long = mine[: len(mine) - n_long], mine[len(mine) - n_long :]
        short = short[length[: len(short)] > 0]
        if not len(short):
            continue
        got, count = heap_merge([plain[i:j] for i, j in zip(left[short].tolist(), end[short].tolist(), strict=True)], weight[short].tolist(), t - aside)
        cand, o = np.array(got, np.int64), np.array(count, np.int64)
        near = (size[cand] * den >= s * num) & (s * den >= size[cand] * num)
        cand, o = cand[near], o[near]
        if not len(cand):
            continue
        if n_long and len(cand) * n_long * math.log2(len(code) + 2) < length[len(mine) - n_long :].sum():
            probe = (long * n)[:, None] + cand
            o = o + (weight[long][:, None] * (code[np.minimum(np.searchsorted(code, probe), len(code) - 1)] == probe)).sum(0)
        elif n_long:  # so many candidates that reading the long lists through costs less than probing them
            most = end[long] - left[long]
            o = o + np.bincount(np.concatenate([lists[i:j] for i, j in zip(left[long].tolist(), end[long].tolist(), strict=True)]), np.repeat(weight[long], most), n)[cand].astype(np.int64)
        cand = cand[o * den >= num * (s + size[cand] - o)]
        links.append(np.stack([np.full(len(cand), q), cand], 1))
    return np.concatenate(links) if links else np.zeros((0, 2), np.int64)


def spanning(links: np.ndarray, n: int) -> np.ndarray:
    """A forest out of links (q, c), grouped by q, that connects the same numbers 0..n-1."""
    label, kept = np.arange(n), [np.zeros((0, 2), np.int64)]
    cut = [0, *(np.flatnonzero(links[1:, 0] != links[:-1, 0]) + 1).tolist(), len(links)] if len(links) else [0]
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        q, c = links[i, 0], links[i:j, 1]
        roots, lead = np.unique(label[c], return_index=True)
        far = roots != label[q]
        if far.any():
            kept.append(np.stack([np.full(int(far.sum()), q), c[lead[far]]], 1))
            label[np.isin(label, roots[far])] = label[q]
    return np.concatenate(kept)


def sorted_sets(raw, off, n: int, lower: bool) -> list[np.ndarray]:
    doc, sh = shingles(raw, off, n, lower)
    order = np.lexsort((sh, doc))
    return np.split(sh[order], np.searchsorted(doc[order], np.arange(1, len(off) - 1)))


_SETS = [T.StructField("size", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType())]
_SENT = T.StructType([T.StructField("p", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("x", T.BinaryType())])
_COUNTS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("c", T.LongType())])
_SLOTS = T.StructType([T.StructField("p", T.IntegerType()), T.StructField("counts", T.BooleanType()), T.StructField("x", T.BinaryType())])
_BITS = T.StructType([T.StructField("d", T.LongType()), T.StructField("bits", T.LongType())])
#: A partial count of a document's slot (0 or 1), on its way to the partition of the document.
_COUNT = np.dtype([("d", "<i8"), ("c", "<i4"), ("slot", "u1")])
_EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _fingerprints(base: DataFrame, n: int, lower: bool, text: str, keep: list[str]) -> DataFrame:
    def task():
        def f(raw, off, _):
            doc, sh = shingles(raw, off, n, lower)
            m = len(off) - 1
            return [pa.array(np.bincount(doc, minlength=m)), pa.array(_sums(doc, mix(sh), m).view(np.int64)), pa.array(_sums(doc, mix(sh ^ U64(0xA5A5A5A5A5A5A5A5)), m).view(np.int64))]

        return f

    return map_text(base, text, task, _SETS, keep, PIECE_BYTES)


def _parts(base: DataFrame, text: str) -> int:
    return max(1, -(-(base.agg(F.sum(F.octet_length(text))).first()[0] or 0) // PART_BYTES))


def _packed(d: np.ndarray, slot: np.ndarray, c: np.ndarray, parts: int) -> tuple[np.ndarray, list[bytes]]:
    """Counts packed into one row a partition."""
    p = d % parts
    order = np.argsort(p, kind="stable")
    e = np.zeros(len(d), _COUNT)
    e["d"], e["slot"], e["c"] = d[order], slot[order], c[order]
    used, lo = np.unique(p[order], return_index=True)
    return used, [x.tobytes() for x in np.split(e, lo[1:])] if len(used) else []


def _survivors(base: DataFrame, n: int, num: int, den: int, lower: bool, text: str, d: str, bits: str | None = None) -> DataFrame:
    """(d, bits): the slots of each document that have, with all others together, as many keys as a linked pair has in common.

    A document with a passage of others has a few such keys, a near copy many.
    """
    parts = _parts(base, text)

    def task():
        def f(raw, off, rows):
            number = rows.column(1).to_numpy()
            slot, key, need = signatures(*shingles(raw, off, n, lower), len(off) - 1, num, den, rows.column(2).to_numpy() if bits else None)
            order = np.argsort(key)
            slot, key = slot[order], key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
            size = np.diff(np.append(np.flatnonzero(new), len(key)))
            many = np.repeat(size > 1, size)
            have = np.bincount(slot[many], minlength=len(need)) - need  # common within this piece
            p = (key % U64(parts)).astype(np.int64)
            lead = np.flatnonzero(new)
            lead = lead[np.lexsort((slot[lead], p[lead]))]
            slot, key, p, many = slot[lead], key[lead] // U64(parts), p[lead], many[lead]
            used = np.unique(p)
            xs = []
            for i, j in zip(np.searchsorted(p, used).tolist(), np.searchsorted(p, used, "right").tolist(), strict=True):
                own, count = np.unique(slot[i:j], return_counts=True)
                k = key[i:j]
                flag = ((k >> U64(32)) & U64(0x7F)).astype(np.uint8) | (many[i:j].astype(np.uint8) << 7)
                xs.append(np.array([len(own), j - i], "<i8").tobytes() + number[own >> 1].astype("<i8").tobytes() + count.astype("<u4").tobytes() + (k & _MASK32).astype("<u4").tobytes() + (own & 1).astype(np.uint8).tobytes() + flag.tobytes())
            live = np.flatnonzero((np.bincount(slot, minlength=len(need)) > 0) | (have + need > 0))
            to, counts = _packed(number[live >> 1], live & 1, have[live], parts)
            return [np.concatenate([used, to]).astype(np.int32), pa.array([False] * len(xs) + [True] * len(counts)), pa.array(xs + counts, pa.binary())]

        return f

    def resolve(batches):
        keys, docs, levels, counted = [], [], [], []
        for batch in batches:
            own = batch.filter(batch.column(1))
            if own.num_rows:
                yield own
            for x in batch.filter(pc.invert(batch.column(1))).column(2).to_pylist():
                m, k = (int(v) for v in np.frombuffer(x, "<i8", 2))
                number, count = np.frombuffer(x, "<i8", m, 16), np.frombuffer(x, "<u4", m, 16 + 8 * m)
                low, bit, flag = np.frombuffer(x, "<u4", k, 16 + 12 * m), np.frombuffer(x, np.uint8, m, 16 + 12 * m + 4 * k), np.frombuffer(x, np.uint8, k, 16 + 13 * m + 4 * k)
                keys.append(low.astype(U64) | ((flag & 0x7F).astype(U64) << U64(32)))
                counted.append(flag >> 7 > 0)
                docs.append(np.repeat(number, count))
                levels.append(np.repeat(bit, count))
        if not keys:
            return
        key, doc, bit, counted = map(np.concatenate, (keys, docs, levels, counted))
        del keys, docs, levels
        order = np.argsort(key)
        k = key[order]
        same = k[1:] == k[:-1]
        many = np.zeros(len(k), bool)
        many[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(k) else many
        more = np.flatnonzero(many & ~counted)
        kinds, rank = np.unique(doc[more], return_inverse=True)
        slot, c = np.unique(2 * rank.astype(np.int64) + bit[more], return_counts=True)
        to, counts = _packed(kinds[slot >> 1], slot & 1, c, parts)
        for i in range(0, len(to), 100):
            yield pa.RecordBatch.from_arrays([pa.array(to[i : i + 100], pa.int32()), pa.array([True] * len(to[i : i + 100])), pa.array(counts[i : i + 100], pa.binary())], names=["p", "counts", "x"])
        del key, doc, bit, counted, order, k, many
        give_back()

    def total(batches):
        held = [x for b in batches for x in b.column(2).to_pylist()]
        if not held:
            return
        e = np.frombuffer(b"".join(held), _COUNT)
        kinds, rank = np.unique(e["d"], return_inverse=True)
        sums = np.bincount(2 * rank.astype(np.int64) + e["slot"], e["c"], 2 * len(kinds))
        seen = np.bincount(2 * rank.astype(np.int64) + e["slot"], minlength=2 * len(kinds)) > 0
        enough = ((sums >= 0) & seen).reshape(-1, 2)
        value = enough[:, 0] + 2 * enough[:, 1]
        kinds, value = kinds[value > 0], value[value > 0]
        for i in range(0, len(kinds), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(kinds[i : i + 50_000], pa.int64()), pa.array(value[i : i + 50_000], pa.int64())], names=["d", "bits"])
        del e, held
        give_back()

    sent = flat_text(base.select(text, d, *([bits] if bits else [])), text, task, _SLOTS, PIECE_BYTES)
    got = sent.repartitionById(parts, F.col("p")).mapInArrow(resolve, _SLOTS).repartitionById(parts, F.col("p")).mapInArrow(total, _BITS)
    return got.select(F.col("d").alias(d), "bits")


def _shards(base: DataFrame, n: int, num: int, den: int, lower: bool, text: str, d: str, bits: str) -> DataFrame:
    """Edges (a, b) that connect all documents whose sets may link."""
    parts = _parts(base, text)

    def task():
        def f(raw, off, rows):
            number = rows.column(1).to_numpy()
            slot, key, _ = signatures(*shingles(raw, off, n, lower), len(off) - 1, num, den, rows.column(2).to_numpy())
            doc = slot >> 1
            a, b, first = chains(key, number[doc])
            doc, key = doc[first], key[first]
            p = (key % U64(parts)).astype(np.int64)
            order = np.lexsort((doc, p))
            doc, key, p = doc[order], key[order] // U64(parts), p[order]
            used = np.unique(p)
            lo, hi = np.searchsorted(p, used), np.searchsorted(p, used, "right")
            xs = []
            for i, j in zip(lo.tolist(), hi.tolist(), strict=True):
                own, count = np.unique(doc[i:j], return_counts=True)
                k = key[i:j]
                xs.append(np.array([len(own), j - i], "<i8").tobytes() + number[own].astype("<i8").tobytes() + count.astype("<u4").tobytes() + (k & _MASK32).astype("<u4").tobytes() + ((k >> U64(32)) & U64(0xFF)).astype(np.uint8).tobytes())
            nulls = pa.nulls(len(xs), pa.int64())
            return [np.concatenate([used, a % parts]).astype(np.int32), pa.concat_arrays([nulls, pa.array(a, pa.int64())]), pa.concat_arrays([nulls, pa.array(b, pa.int64())]), pa.array(xs + [None] * len(a), pa.binary())]

        return f

    def resolve(batches):
        keys, docs = [], []
        for batch in batches:
            own = batch.filter(batch.column(1).is_valid())
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column(1), own.column(2)], names=["a", "b"])
            for x in batch.column(3).drop_null().to_pylist():
                m, k = (int(v) for v in np.frombuffer(x, "<i8", 2))
                number, count = np.frombuffer(x, "<i8", m, 16), np.frombuffer(x, "<u4", m, 16 + 8 * m)
                low, high = np.frombuffer(x, "<u4", k, 16 + 12 * m), np.frombuffer(x, np.uint8, k, 16 + 12 * m + 4 * k)
                keys.append(low.astype(U64) | (high.astype(U64) << U64(32)))
                docs.append(np.repeat(number, count))
        if keys:
            a, b, _ = chains(np.concatenate(keys), np.concatenate(docs))
            for i in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 50_000], pa.int64()), pa.array(b[i : i + 50_000], pa.int64())], names=["a", "b"])
            del keys, docs
        give_back()

    sent = flat_text(base.select(text, d, bits), text, task, _SENT, PIECE_BYTES)
    return sent.repartitionById(parts, F.col("p")).mapInArrow(resolve, _EDGES)


_KEYS = T.StructType([T.StructField("d", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("need", T.LongType()), T.StructField("key", T.LongType())])


def _parted(large: DataFrame, n: int, num: int, den: int, lower: bool) -> DataFrame:
    """(d, g, c) for documents (t, d, bits) of large shards: new shards of two or more, chained by the rarer keys of each document.

    Linked sets have at least ``need`` keys of a slot's level in common. In one order for all (rarest first) the first of these is, in each
    of both sets, among the keys before the last need - 1: so chaining by those alone loses no link.
    """

    def task():
        def f(raw, off, rows):
            slot, key, need = signatures(*shingles(raw, off, n, lower), len(off) - 1, num, den, rows.column(2).to_numpy())
            return [rows.column(1).to_numpy()[slot >> 1], (slot & 1).astype(np.int32), np.maximum(need[slot], 1), key.view(np.int64)]

        return f

    keys = stored(flat_text(large.select("t", "d", "bits"), "t", task, _KEYS, PIECE_BYTES))
    total = keys.count()
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    met = with_group(keys, often, "key", "f", total)
    least = met.groupBy("d", "slot").agg(F.first("need").alias("need"), F.sort_array(F.collect_list(F.struct("f", "key"))).alias("l")).where(F.size("l") >= F.col("need"))
    kept = stored(least.select("d", F.explode(F.slice("l", F.lit(1), (F.size("l") - F.col("need") + 1).cast("int"))).alias("x")).select("d", F.col("x")["key"].alias("key")))
    lead = kept.groupBy("key").agg(F.min("d").alias("b"), F.count(F.lit(1)).alias("f")).where("f > 1")
    chained = with_group(kept, lead, "key", "f", total).where("d <> b").select(F.col("d").alias("a"), "b").distinct()
    shards = settle(components(chained).select(F.col("node").alias("d"), F.col("root").alias("g")))
    many = shards.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    return with_group(shards, many, "g", "c", shards.count()).select("d", "g", "c")


def _search(groups: DataFrame, rows: int, n: int, num: int, den: int, lower: bool) -> DataFrame:
    """What the links within groups come to: edges (a, b) of a forest, and (a, null, c) with c links of document a.

    Rows (g, d, q, t), so many of them: q is 1 for queries, 0 for what they are compared with, null where all are compared
    with all. A task reads its groups one after another.
    """

    def run(batches):
        def out(ds, sets, queries):
            order = sorted(range(len(ds)), key=lambda i: (queries[i] == 0, len(sets[i]), ds[i]))
            k = None if queries[0] is None else sum(queries)
            links = divide_skip([sets[i] for i in order], num, den, k)
            number = np.array(ds, np.int64)[order]
            a, b = number[spanning(links, len(ds)).T]
            count = np.bincount(links.ravel(), minlength=len(ds))
            some = np.flatnonzero(count)
            nulls = pa.nulls(len(a), pa.int64()), pa.nulls(len(some), pa.int64())
            cols = np.concatenate([a, number[some]]), pa.concat_arrays([pa.array(b), nulls[1]]), pa.concat_arrays([nulls[0], pa.array(count[some])])
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), *cols[1:]], names=["a", "b", "c"])

        from .textcore import string_buffers

        now, ds, sets, queries = None, [], [], []
        for b in batches:
            off, raw = string_buffers(b.column(3))
            if not b.num_rows:
                continue
            mine = sorted_sets(raw, off - off[0], n, lower)
            for g, d, q, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), mine, strict=True):
                if g != now:
                    if len(ds) > 1:
                        yield out(ds, sets, queries)
                    now, ds, sets, queries = g, [], [], []
                ds.append(d)
                sets.append(s)
                queries.append(q)
        if len(ds) > 1:
            yield out(ds, sets, queries)

    # by rows, not bytes: a search costs far more than the bytes that it reads
    return groups.repartition(max(1, -(-rows // TASK_ROWS)), "g").sortWithinPartitions("g", "d").mapInArrow(run, _COUNTS)


def classes(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, lower: bool = False, doc_id: str = "doc_id", text: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a document: doc_id, n_shingles, class_id (least id of its equal sets), component_id (least id reachable by links), n_links (other classes that its set links to)."""
    d = fresh(docs, "sg_d")
    got, plain = _classes(numbered(docs.select(doc_id, text), doc_id, text, d), d, n, num, den, lower, doc_id, text, shard_rows)
    if plain:
        return got.select("doc_id", "n_shingles", F.col("rep").alias("class_id"), F.col("root").alias("component_id"), "n_links")
    got = settle(got)
    ids = got.select("d", F.col("doc_id").alias("of")).dropDuplicates(["d"])
    got = got.join(ids.select(F.col("d").alias("rep"), F.col("of").alias("class_id")), "rep")
    return got.join(ids.select(F.col("d").alias("root"), F.col("of").alias("component_id")), "root").select("doc_id", "n_shingles", "class_id", "component_id", "n_links")


def _classes(own: DataFrame, d: str, n: int, num: int, den: int, lower: bool, doc_id: str, text: str, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, bool]:
    """classes() by the numbers in column ``d``: doc_id, d, n_shingles, rep, root, n_links; and whether these are the ids."""
    base = own.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), F.col(d).alias("d"))
    sets = settle(_fingerprints(base, n, lower, "t", ["doc_id", "d"]))
    reps = sets.where("size > 0").groupBy("size", "f1", "f2").agg(F.min("d").alias("rep"))
    texts = base.where("t is not null").select("d", "t")
    plain = _plain(own, doc_id, sets)
    if not plain:  # rows may repeat under one number
        texts = texts.dropDuplicates(["d"])
    # twice, since what goes in the first round was company to others; the texts that stay are kept for all that follows
    texts = stored(texts.join(small_or_not(settle(_survivors(texts, n, num, den, lower, "t", "d"))), "d").select("d", "t", "bits"))
    again = settle(_survivors(texts, n, num, den, lower, "t", "d", "bits"))
    texts = texts.drop("bits").join(small_or_not(again), "d").select("d", "t", "bits")
    shards = components(_shards(texts, n, num, den, lower, "t", "d", "bits"))
    # documents to compare: one of each class, in shards of at least two classes
    members = shards.join(reps.select(F.col("rep").alias("node")), "node", "left_semi").select(F.col("node").alias("d"), F.col("root").alias("g")).distinct()
    many = members.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = settle(with_group(members, many, "g", "c", members.count()).select("d", "g", "c"))
    large = members.where(F.col("c") > shard_rows)
    if large.limit(1).count():
        parted = _parted(texts.join(small_or_not(large), "d"), n, num, den, lower)
        members = settle(members.where(F.col("c") <= shard_rows).unionByName(parted))
    chosen = stored(texts.join(small_or_not(members), "d").select("d", "g", "c", "t"))
    one = F.lit(None).cast("int")
    links = _search(chosen.where(F.col("c") <= shard_rows).select("g", "d", one.alias("q"), "t"), members.where(F.col("c") <= shard_rows).count(), n, num, den, lower)
    large = members.where(F.col("c") > shard_rows)
    if large.limit(1).count():
        # blocks: each document goes to a cell for each block of its shard, so that every pair is in one cell
        half = max(1, shard_rows // 2)
        size = F.least(F.greatest(F.ceil(F.col("c") / 16), F.lit(half)), F.lit(4 * half))
        blocks = large.withColumn("b", F.ceil(F.col("c") / size)).withColumn("k", F.pmod(F.xxhash64("d"), F.col("b")))
        blocks = blocks.select("d", "g", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("x"))
        side = F.when(F.col("k") != F.col("x"), (F.col("k") < F.col("x")).cast("int"))
        cells = settle(blocks.select("d", F.xxhash64("g", F.least("k", "x"), F.greatest("k", "x")).alias("g"), side.alias("q")))
        rows = cells.count()
        cells = cells.join(chosen.where(F.col("c") > shard_rows).select("d", "t"), "d").select("g", "d", "q", "t")
        links = links.unionByName(_search(cells, rows, n, num, den, lower))
    links = settle(links)
    found = components(links.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "root")
    found = links.where("c is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("c").alias("n_links")).join(found, "rep")
    whole = reps.join(found, "rep", "left").select("size", "f1", "f2", "rep", F.coalesce("root", "rep").alias("root"), "n_links")
    got = sets.join(whole, ["size", "f1", "f2"], "left").select("doc_id", "d", F.col("size").alias("n_shingles"), F.coalesce("rep", "d").alias("rep"), F.coalesce("root", "d").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return got, plain


def _plain(docs: DataFrame, doc_id: str, sets: DataFrame) -> bool:
    """Whether documents are numbered by their own ids."""
    return isinstance(docs.schema[doc_id].dataType, T.LongType) and not sets.where("doc_id is null or doc_id <> d").limit(1).count()


def keep_one(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents that are the first of their component, with their own columns (of repeated rows one stays)."""
    d = fresh(docs, "sg_d")
    own = numbered(docs, "doc_id", "text", d)
    c, plain = _classes(own, d, n, num, den, lower=True, doc_id="doc_id", text="text")
    if not plain:  # rows may repeat under one number
        own = own.dropDuplicates([d])
    gone = settle(c.where("d <> root").select(F.col("d").alias(d)).distinct())
    return own.join(small_or_not(gone), d, "left_anti").select(*(F.col(f"`{x}`") for x in docs.columns))
