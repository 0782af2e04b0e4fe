"""Substring deduplication with prefix-partitioned suffix trees.

A word is removed if a window of n words that covers it starts earlier somewhere else.
Two windows are equal if their suffixes meet in a node of the suffix tree that is at least n words deep,
so every suffix is cut at n words. The tree is never built as a whole:

* Prefixes. A suffix belongs to its *anchor*, the run of ``ANCHOR`` words with the least
  hash among its first n words: equal suffixes have equal anchors, and neighbouring
  suffixes mostly share one, so that they travel together as one stretch of words. A census
  counts the anchors of all texts. Suffixes whose anchor stands nowhere else cannot meet
  another one and end there. An anchor of more than ``GROUP_LEAVES``
  suffixes is extended to all n words, which splits its group; so prefixes vary in
  length and every group fits in the memory of a task.
* Subtrees. The stretches of a group are sent, as words, to the partition of
  their prefix, where the suffixes are sorted by prefix doubling over the words
  themselves (hashes only deal, they never decide). Suffixes with one number to depth n hang from one
  deep internal node; all its leaves but the first are marked. Adjoining marks are the maximal repeats: they come back as spans.
* Each task builds the subtrees of its own piece of text before it sends anything, and of each node
  sends only the first leaf: common passages and groups of copies shrink to one
  leaf a piece. Windows with an extended prefix are, on tables of many pieces, reduced
  once more in groups of ``FAN`` pieces, so that a window in every piece makes no hot task.

Marks come back by document and are joined to the texts.

Words are [^\\x20\\x09-\\x0D]+. "Earlier" is a smaller document id, or an earlier
start in the same document. Nulls: a null text has no words; a null id comes
before all others. Rows with equal id and text are one document and get the same
result each; rows with equal ids and different texts are ordered by a hash of the text. An
empty table gives no rows. A long text is one piece, however long. Clashing output names get underscores.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blobs, flat_text, fresh, give_back, map_text, stored
from .textcore import BLANK_WORDS, Words, mix, rolling, windows

U64 = np.uint64
N = 20
ANCHOR = 6
#: Bytes of text whose suffixes one partition takes, and bytes of text treated at once.
PART_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
#: Suffixes that may meet under one anchor; beyond, the whole window decides the partition.
GROUP_LEAVES = 50_000
#: Anchors (32 bits each) that may be extended at once, for they are broadcast; with more of them all are extended.
MOST_COMMON = 1_000_000
#: Pieces of text whose leaves of one extended window may meet in a task.
FAN = 4096


def numbered(docs: DataFrame, doc_id: str, text: str, name: str) -> DataFrame:
    """Adds a long that orders documents by (id, text): the id itself where it is a unique whole number."""
    kind = docs.schema[doc_id].dataType
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        seen = docs.groupBy(doc_id).agg(F.count(F.lit(1)).alias("c")).where(F.col(doc_id).isNull() | (F.col("c") > 1))
        if not seen.limit(1).count():
            return docs.withColumn(name, F.col(doc_id).cast("long"))
    keys = docs.select(F.col(doc_id).alias("i"), F.xxhash64(text).alias("h")).distinct().orderBy("i", "h")
    rows = keys.rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    ids = docs.sparkSession.createDataFrame(rows, T.StructType([*keys.schema.fields, T.StructField(name, T.LongType())]))
    a, b = fresh(docs, "sg_i"), fresh(docs, "sg_h")
    ids = ids.select(F.col("i").alias(a), F.col("h").alias(b), name)
    return docs.join(ids, F.col(doc_id).eqNullSafe(F.col(a)) & (F.xxhash64(text) == F.col(b))).drop(a, b)


def sliding_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """For each start, the place of the least of w consecutive values (the first, if tied)."""
    m = len(v) - w + 1
    at = np.arange(len(v))
    span = 1
    while span < w:  # at[i]: place of the least of span values from i on
        step = min(span, w - span)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(v[b] < v[a], b, a)
        span += step
    return at[:m]


def anchors(w: Words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of n words: its start, the place of its anchor and the anchor's hash."""
    start = windows(w.first, w.doc, n)
    if not len(start):
        return start, start, np.zeros(0, U64)
    k = min(ANCHOR, n)
    short = rolling(h, k)
    at = sliding_argmin(short, n - k + 1)[start]
    return start, at, short[at]


def breaks(*columns: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where a stretch of consecutive starts with equal columns begins."""
    if not len(start):
        return np.zeros(0, np.int64)
    cut = np.diff(start) != 1
    for c in columns:
        cut |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate([[True], cut]))


def numbers(keys: np.ndarray) -> np.ndarray:
    """Ranks of the keys among the distinct ones, from 1."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(s), np.int64)
    out[order] = np.cumsum(new)
    return out


def subtree(h: np.ndarray, end: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """The deep node of each suffix: equal numbers for suffixes that agree in n words, in the order of the sorted suffixes.

    h: the words (in the order of their hashes); end: where each word's text ends; start: suffixes of at
    least n words. Prefix doubling: numbers to depth 2p are pairs of numbers to depth p.
    """
    name, p = numbers(h), 1
    at = np.arange(len(h))
    while 2 * p <= n:
        key = name << 32
        ok = at + p < end
        key[ok] |= name[at[ok] + p]
        name = numbers(key)
        p *= 2
    return numbers(name[start] << 32 | name[start + n - p])


def first_leaves(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each leaf is the first of its node: place is the least among equal keys."""
    order = np.argsort(key)
    s, p = key[order], place[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    least = np.minimum.reduceat(p, np.flatnonzero(new)) if len(s) else p
    first = np.empty(len(key), bool)
    first[order] = p == least[np.cumsum(new) - 1] if len(s) else first
    return first


def runs(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of consecutive sorted numbers: first and length."""
    if not len(place):
        return place, place
    cut = np.flatnonzero(np.concatenate([[True], np.diff(place) != 1]))
    return place[cut], np.diff(np.append(cut, len(place)))


def marks_by_document(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Documents with marked windows, and their (start, length) runs as little-endian int32 pairs."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    kinds, at = np.unique(doc, return_inverse=True)
    p, size = runs((at.astype(np.int64) << 32) + start)
    owner = p >> 32
    pairs = np.stack([(p & 0xFFFFFFFF).astype(np.int32), size.astype(np.int32)], 1).ravel()
    return kinds, blobs(pairs, 2 * np.searchsorted(owner, np.arange(len(kinds) + 1)))


def marked(w: Words, runs_of_texts: list, size: int = 0) -> np.ndarray:
    """Whether each word lies in one of its text's runs, given as (start, length) pairs; lengths grow by ``size``."""
    start, length = [], []
    for k, bs in enumerate(runs_of_texts):
        if bs:
            pairs = np.frombuffer(b"".join(bs), "<i4").reshape(-1, 2)
            start.append(pairs[:, 0].astype(np.int64) + w.first[k])
            length.append(pairs[:, 1].astype(np.int64) + size)
    if not start:
        return np.zeros(len(w), bool)
    a, b = np.concatenate(start), np.concatenate(length)
    return np.cumsum(np.bincount(a, minlength=len(w) + 1) - np.bincount(a + b, minlength=len(w) + 1))[:-1] > 0


def runs_by_document(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Documents and their (start, length) runs as little-endian int32 pairs."""
    order = np.lexsort((start, doc))
    doc = doc[order]
    kinds = np.unique(doc)
    pairs = np.stack([start[order].astype(np.int32), size[order].astype(np.int32)], 1).ravel()
    return kinds, blobs(pairs, 2 * np.append(np.searchsorted(doc, kinds), len(doc)))


_SENT = T.StructType([T.StructField("p", T.IntegerType()), T.StructField("d", T.LongType()), T.StructField("x", T.BinaryType())])
_MARKS = T.StructType([T.StructField("d", T.LongType()), T.StructField("x", T.BinaryType())])
#: An anchor of a piece: low bits, first stretch (document, start, windows), whether the piece holds more stretches, and all its windows here.
_ANCHOR = np.dtype([("a", "<u4"), ("d", "<i8"), ("s", "<i4"), ("c", "<i4"), ("more", "u1"), ("all", "<u4")])
#: A stretch on its way to a subtree; far: its prefix is the whole window.
_STRETCH = np.dtype([("d", "<i8"), ("s", "<i4"), ("c", "<i4"), ("far", "u1")])
_LOW = U64(0xFFFFFFFF)


def _rows(p_sent: np.ndarray, sent: list[bytes], p_own: np.ndarray, own: np.ndarray, x: pa.Array) -> list:
    """Columns of _SENT: what goes to partitions, then what goes to documents."""
    return [np.concatenate([p_sent, p_own]).astype(np.int32), pa.concat_arrays([pa.nulls(len(sent), pa.int64()), pa.array(own, pa.int64())]), pa.concat_arrays([pa.array(sent, pa.binary()), x])]


def _split(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of sorted numbers, and where each begins and ends."""
    used = np.unique(p)
    lo = np.searchsorted(p, used)
    return used, lo, np.append(lo[1:], len(p)) if len(used) else lo


def census(docs: DataFrame, n: int, text: str, number: str, parts: int, most: int) -> DataFrame:
    """Rows (d, x): runs of window starts of document d whose anchor stands elsewhere too; and with a null d, anchors of more than ``most`` windows."""

    def task():
        def f(raw, off, rows):
            d = rows.column(1).to_numpy()
            w = Words(raw, off, BLANK_WORDS)
            start, at, a = anchors(w, w.hashes(), n)
            new = breaks(at, w.doc[start], start=start)
            size = np.diff(np.append(new, len(start)))
            doc = w.doc[start[new]]
            s, a = start[new] - w.first[doc], a[new]
            kinds, lead, inv, count = np.unique(a, return_index=True, return_inverse=True, return_counts=True)
            # further stretches of an anchor are known to stand elsewhere; its first one is dealt by the anchor
            rest = np.ones(len(a), bool)
            rest[lead] = False
            own, x = runs_by_document(d[doc[rest]], s[rest], size[rest])
            e = np.zeros(len(kinds), _ANCHOR)
            e["a"], e["d"], e["s"], e["c"] = (kinds & _LOW).astype(np.uint32), d[doc[lead]], s[lead], size[lead]
            e["more"], e["all"] = count > 1, np.bincount(inv, size, len(kinds)) if len(kinds) else 0
            p = ((kinds >> U64(32)) % U64(parts)).astype(np.int64)
            order = np.argsort(p, kind="stable")
            e = e[order]
            used, lo, hi = _split(p[order])
            return _rows(used, [e[i:j].tobytes() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], own % parts, own, x)

        return f

    def resolve(batches):
        held = []
        for b in batches:
            own = b.filter(b.column(1).is_valid())
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column(1), own.column(2)], names=["d", "x"])
            held += b.filter(b.column(1).is_null()).column(2).to_pylist()
        if not held:
            return
        e = np.frombuffer(b"".join(held), _ANCHOR)
        del held
        order = np.argsort(e["a"], kind="stable")
        a = e["a"][order]
        new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        size = np.diff(np.append(new, len(a)))
        met = (size > 1) | np.logical_or.reduceat(e["more"][order] > 0, new)
        far = a[new[np.add.reduceat(e["all"][order].astype(np.int64), new) > most]]
        e = e[order[np.repeat(met, size)]]
        own, x = runs_by_document(e["d"], e["s"].astype(np.int64), e["c"].astype(np.int64))
        for i in range(0, len(own), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(own[i : i + 50_000], pa.int64()), x.slice(i, 50_000)], names=["d", "x"])
        if len(far):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([far.tobytes()], pa.binary())], names=["d", "x"])
        del e, order, a
        give_back()

    sent = flat_text(docs.select(text, number), text, task, _SENT, PIECE_BYTES)
    return sent.repartitionById(parts, F.col("p")).mapInArrow(resolve, _MARKS)


def _far_anchors(counted: DataFrame) -> np.ndarray | None:
    """The anchors to extend (low bits, sorted); None if they are too many to broadcast, and all are to be extended."""
    far = counted.where("d is null").select("x")
    if (far.agg(F.sum(F.octet_length("x"))).first()[0] or 0) > 4 * MOST_COMMON:
        return None
    return np.unique(np.frombuffer(b"".join(r.x for r in far.collect()), "<u4"))


def _stretch_texts(w: Words, start: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of runs of words, each word followed by a space, each run's last by a line feed; and where each run's text begins."""
    first = np.cumsum(words) - words
    k = np.repeat(start - first, words) + np.arange(words.sum())
    size = w.end[k] - w.start[k] + 1
    ends = np.cumsum(size)
    out = np.append(w.raw, np.uint8(0x20))[np.repeat(w.start[k] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
    out[ends - 1] = 0x20
    last = ends[first + words - 1]
    out[last - 1] = 0x0A
    return out, np.concatenate([[0], last])


def repeated_windows(docs: DataFrame, n: int = N, text: str = "text", number: str = "d", group_leaves: int = GROUP_LEAVES) -> DataFrame:
    """Rows (d, x): runs of window starts of document d that also start earlier; several rows a document."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    salts = -(-max(1, size // PIECE_BYTES) // FAN)
    counted = stored(census(docs, n, text, number, parts, group_leaves))
    sent_far = docs.sparkSession.sparkContext.broadcast(_far_anchors(counted))
    base = docs.select(text, number)
    x = fresh(base, "sg_x")
    chosen = counted.where("d is not null").groupBy(F.col("d").alias(number)).agg(F.collect_list("x").alias(x))

    def dealt(d, s, at, a, fp, w, start, one_salt: bool):
        """Blobs for the partitions of the prefixes of windows: stretches and their words."""
        extended = sent_far.value
        p = ((a >> U64(32)) % U64(parts)).astype(np.int64)
        far = np.zeros(len(a), bool)
        if extended is None or len(extended):
            low = (a & _LOW).astype(np.uint32)
            far = np.ones(len(a), bool) if extended is None else extended[np.minimum(np.searchsorted(extended, low), len(extended) - 1)] == low
            salt = np.zeros(int(far.sum()), U64) if one_salt else (d[far] % salts).astype(U64)
            p[far] = (mix(fp[far] + salt) % U64(parts)).astype(np.int64)
        order = np.argsort(p, kind="stable")
        d, s, at, far, p, start = (v[order] for v in (d, s, at, far, p, start))
        new = breaks(at, p, far, d, start=start)
        e = np.zeros(len(new), _STRETCH)
        e["d"], e["s"], e["c"], e["far"] = d[new], s[new], np.diff(np.append(new, len(p))), far[new]
        texts, cut = _stretch_texts(w, start[new], e["c"].astype(np.int64) + n - 1)
        used, lo, hi = _split(p[new])
        return used, [np.array([j - i], "<i8").tobytes() + e[i:j].tobytes() + texts[cut[i] : cut[j]].tobytes() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]

    def task():
        def f(raw, off, rows):
            d = rows.column(1).to_numpy()
            w = Words(raw, off, BLANK_WORDS)
            h = w.hashes()
            start, at, a = anchors(w, h, n)
            ok = marked(w, rows.column(2).to_pylist())[start]
            start, at, a = start[ok], at[ok], a[ok]
            doc = w.doc[start]
            s = start - w.first[doc]
            # the subtrees of this piece: later leaves are marked, whatever others hold
            rank = np.unique(d, return_inverse=True)[1] if len(d) else np.zeros(0, np.int64)
            first = _first(h, w, start, (rank[doc].astype(np.int64) << 32) + s, n)
            own, x = marks_by_document(d[doc[~first]], s[~first])
            fp = rolling(h, n)[start[first]] if len(start) else np.zeros(0, U64)
            return _rows(*dealt(d[doc[first]], s[first], at[first], a[first], fp, w, start[first], salts == 1), own % parts, own, x)

        return f

    def resolve(last: bool):
        def run(batches):
            entries, texts = [], []
            for b in batches:
                own = b.filter(b.column(1).is_valid())
                if own.num_rows:
                    yield own if not last else own.select(["d", "x"])
                for x in b.filter(b.column(1).is_null()).column(2).to_pylist():
                    k = int(np.frombuffer(x, "<i8", 1)[0])
                    entries.append(np.frombuffer(x, _STRETCH, k, 8))
                    texts.append(np.frombuffer(x, np.uint8, -1, 8 + entries[-1].nbytes))
            if not entries:
                return
            e, raw = np.concatenate(entries), np.concatenate(texts)
            del entries, texts
            w = Words(raw, np.concatenate([[0], np.flatnonzero(raw == 0x0A) + 1]), BLANK_WORDS)
            h, c = w.hashes(), e["c"].astype(np.int64)
            nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            start, d, s = np.repeat(w.first[:-1], c) + nth, np.repeat(e["d"], c), np.repeat(e["s"], c) + nth
            rank = np.unique(e["d"], return_inverse=True)[1]
            first = _first(h, w, start, (np.repeat(rank, c).astype(np.int64) << 32) + s, n)
            own, x = marks_by_document(d[~first], s[~first])
            if last:
                for i in range(0, len(own), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(own[i : i + 50_000], pa.int64()), x.slice(i, 50_000)], names=["d", "x"])
            else:  # first leaves of extended windows go on, without salt
                on = first & (np.repeat(e["far"], c) > 0)
                at, a = np.arange(on.sum()), np.zeros(int(on.sum()), U64)
                fp = rolling(h, n)[start[on]] if len(h) >= n else a
                sent = forward(d[on], s[on], at, fp, w, start[on])
                cols = _rows(*sent, own % parts, own, x)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *cols[1:]], names=["p", "d", "x"])
            del e, raw, w, h, start, d, s, first
            give_back()

        return run

    def forward(d, s, at, fp, w, start):
        p = (mix(fp) % U64(parts)).astype(np.int64)
        order = np.argsort(p, kind="stable")
        d, s, p, start = d[order], s[order], p[order], start[order]
        e = np.zeros(len(p), _STRETCH)
        e["d"], e["s"], e["c"], e["far"] = d, s, 1, 1
        texts, cut = _stretch_texts(w, start, np.full(len(p), n))
        used, lo, hi = _split(p)
        return used, [np.array([j - i], "<i8").tobytes() + e[i:j].tobytes() + texts[cut[i] : cut[j]].tobytes() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]

    sent = flat_text(base.join(chosen, number).select(text, number, x), text, task, _SENT, PIECE_BYTES)
    if salts > 1:
        sent = sent.repartitionById(parts, F.col("p")).mapInArrow(resolve(False), _SENT)
    return sent.repartitionById(parts, F.col("p")).mapInArrow(resolve(True), _MARKS)


def _first(h: np.ndarray, w: Words, start: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Whether each suffix is the first leaf of its deep node. Only the words of these suffixes are sorted."""
    if not len(start):
        return np.zeros(0, bool)
    d = np.bincount(start, minlength=len(h) + 1) - np.bincount(start + n, minlength=len(h) + 1)
    used = np.flatnonzero(np.cumsum(d[:-1]) > 0)
    to = np.zeros(len(h) + 1, np.int64)
    to[used] = np.arange(len(used))
    cut = np.flatnonzero(np.concatenate([(np.diff(used) != 1) | (w.doc[used[1:]] != w.doc[used[:-1]]), [True]]))
    end = np.repeat(cut + 1, np.diff(np.concatenate([[-1], cut])))
    return first_leaves(subtree(h[used], end, to[start], n), place)


def deduplicate(docs: DataFrame, n: int = N, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, names: tuple[str, str, str, str] = ("n_words", "n_removed", "kept", "removed_spans"), digest: str | None = None) -> DataFrame:
    """Adds n_words, n_removed, the kept text and the removed spans (start, end in words).

    The kept text is the text itself where nothing is removed, else the kept
    words joined by one space; with ``digest``, the SHA-256 of the joined words
    under that name comes instead of text and spans.
    """
    keep = docs.columns if keep is None else keep
    d, x = fresh(docs, "sg_d"), fresh(docs, "sg_x")
    base = numbered(docs.select(*dict.fromkeys([*keep, doc_id, text])), doc_id, text, d)
    marks = repeated_windows(base, n, text, d).groupBy(F.col("d").alias(d)).agg(F.collect_list("x").alias(x))
    got = base.join(marks, d, "left").select(*dict.fromkeys([*keep, text]), x)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType())]
    fields += [T.StructField(digest, T.StringType())] if digest else [T.StructField(names[2], T.StringType()), T.StructField(names[3], span)]

    def task():
        def f(raw, off, rows):
            w = Words(raw, off, BLANK_WORDS)
            m = len(off) - 1
            gone = marked(w, rows.column(x).to_pylist(), n - 1)
            total = np.concatenate([[0], np.cumsum(gone)])[w.first]
            removed = np.diff(total)
            # kept words, each with one space after it
            s, e, doc = w.start[~gone], w.end[~gone], w.doc[~gone]
            length = e - s + 1
            ends = np.concatenate([[0], np.cumsum(length)])
            src = np.repeat(s - ends[:-1], length) + np.arange(ends[-1])
            padded = np.append(raw, np.uint8(0x20))
            out = padded[np.minimum(src, len(raw))]
            out[ends[1:] - 1] = 0x20
            bounds = ends[np.searchsorted(doc, np.arange(m + 1))]
            buf = memoryview(out)
            texts = [buf[a : max(a, b - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            first = [pa.array(np.diff(w.first)), pa.array(removed)]
            if digest:
                return [*first, pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            same = [raw[off[k] : off[k + 1]].tobytes().decode() if not removed[k] else bytes(texts[k]).decode() for k in range(m)]
            nulls = rows.column(text).combine_chunks().is_null().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(gone & ~(np.concatenate([[False], gone[:-1]]) & np.concatenate([[False], np.diff(w.doc) == 0])[: len(gone)])) if len(gone) else np.zeros(0, np.int64)
            stop = np.flatnonzero(gone & ~(np.concatenate([gone[1:], [False]]) & np.concatenate([np.diff(w.doc) == 0, [False]])[: len(gone)])) + 1 if len(gone) else cut
            base_ = w.first[w.doc[cut]] if len(cut) else cut
            offs = np.searchsorted(w.doc[cut] if len(cut) else cut, np.arange(m + 1))
            spans = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.StructArray.from_arrays([pa.array(cut - base_, pa.int64()), pa.array(stop - base_, pa.int64())], ["start", "end"]))
            return [*first, pa.array(same, pa.string(), mask=nulls), spans]

        return f

    return map_text(got, text, task, fields, keep, PIECE_BYTES, (x,))


def remove_repeats(docs: DataFrame, n: int = N) -> DataFrame:
    """The documents with repeated passages removed, with their own columns; n_chars, if there, follows the text."""
    names = tuple(fresh(docs, x) for x in ("sg_words", "sg_removed", "sg_kept", "sg_spans"))
    got = deduplicate(docs, n, names=names)
    changed = F.col(names[1]) > 0
    cols = {"text": F.col(names[2])}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(changed, F.char_length(F.col(names[2]))).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return got.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in docs.columns])
