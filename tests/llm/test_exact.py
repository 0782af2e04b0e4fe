"""Operators against brute force: Jaccard classes, substring removal, benchmark scan, packing."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratagraph.llm import decontaminate, jaccard, packing, substring
from stratagraph.llm.queries import tokenizer_path
from stratagraph.llm.textcore import BLANK_WORDS, Words

BLANK = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(i, t):
    return (i is not None, i or 0)


def shingle_set(t, n):
    w = re.findall(BLANK, (t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def classes_by_hand(rows, n, num, den):
    sets = [shingle_set(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    best = {}
    for k, (i, t) in enumerate(rows):
        best[root(k)] = min(best.get(root(k), (i, t)), (i, t), key=lambda x: key(*x))
    return sorted(((i, len(sets[k]), best[root(k)][0]) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("n", "num", "den", "rows"), [(3, 90, 100, 1500), (5, 4, 5, 1500), (3, 4, 5, 3)])
def test_jaccard_classes(docs, corpus, n, num, den, rows):
    """The last case makes every shard of over three sets a large one (pivots and blocks)."""
    got = jaccard.classes(docs, n, num, den, lower=True, shard_rows=rows).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == classes_by_hand(corpus, n, num, den)


@pytest.mark.parametrize(("num", "den", "rows"), [(90, 100, 1500), (4, 5, 1500), (4, 5, 3), (1, 2, 7)])
def test_jaccard_counts_every_link(docs, corpus, num, den, rows):
    """Links of groups of three and more, in one search and over the blocks of large shards."""
    sets = [shingle_set(t, 3) for _, t in corpus]
    kinds = set(sets) - {frozenset()}
    near = {s: sum(s != o and den * len(s & o) >= num * len(s | o) for o in kinds) for s in kinds}
    assert sum(c > 1 for c in near.values()) >= 3
    got = jaccard.classes(docs, 3, num, den, lower=True, shard_rows=rows).collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=repr) == sorted(((i, near.get(s, 0)) for (i, _), s in zip(corpus, sets)), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1), min_size=2, max_size=9), st.sampled_from([(9, 10), (4, 5), (1, 2)]), st.integers(0, 9))
def test_divide_skip_gives_each_link_once(sets, t, queries):
    num, den = t
    arrays = sorted((np.array(sorted(s), np.uint64) for s in sets), key=len)
    members = [set(x.tolist()) for x in arrays]
    links = lambda pairs: sorted((a, b) for a, b in pairs if den * len(members[a] & members[b]) >= num * len(members[a] | members[b]))
    assert sorted(tuple(sorted(p)) for p in jaccard.divide_skip(arrays, num, den).tolist()) == links(itertools.combinations(range(len(arrays)), 2))
    k = min(queries, len(arrays))
    assert sorted(map(tuple, jaccard.divide_skip(arrays, num, den, k).tolist())) == links(itertools.product(range(k), range(k, len(arrays))))


def test_jaccard_plain_ids_and_chain(spark):
    """Links that only chains connect, over unique ids."""
    r = random.Random(2)
    w = ["w%d" % r.randrange(50) for _ in range(80)]
    rows = []
    for i in range(30):
        rows.append((i + 5, " ".join(w)))
        w[(7 * i) % 80] = "v%d" % i
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1500, 4):
        got = jaccard.classes(df, 3, 90, 100, shard_rows=size).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == classes_by_hand(rows, 3, 90, 100)


def test_jaccard_common_passage_glues_no_shard(spark, monkeypatch):
    """Pairs of near copies that all hold one long passage: no link is lost, and the documents don't go to cells of all pairs."""
    r = random.Random(4)
    shared, rows = ["s%d" % i for i in range(70)], []
    for i in range(30):
        w = shared + ["w%d" % r.randrange(100_000) for _ in range(80)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:-1], "x"]))]
    df, sent, search = spark.createDataFrame(rows, "doc_id long, text string"), [], jaccard._search
    monkeypatch.setattr(jaccard, "_search", lambda groups, rows, *a: (sent.append(groups.count()), search(groups, rows, *a))[1])
    got = jaccard.classes(df, 5, 4, 5, shard_rows=8).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == classes_by_hand(rows, 5, 4, 5)
    assert sum(sent) <= 2 * len(rows)


def test_jaccard_empty_and_keep_one(nothing, docs, corpus):
    assert jaccard.classes(nothing).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, n, c in classes_by_hand(corpus, 5, 4, 5)}
    got = [r.doc_id for r in kept.collect()]
    assert set(got) == want and len(got) == len(want)


def test_keep_one_goes_by_document(spark):
    """An id of a document that stays and of one that goes, and near copies without ids."""
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (2, near(a)), (2, " ".join(b)), (None, " ".join(c)), (None, near(c)), (None, "quite alone"), (3, near(b)), (3, near(b))]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    no_id = [r.text for r in got if r.doc_id is None]
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id) == [(1, " ".join(a)), (2, " ".join(b))]
    assert "quite alone" in no_id and len(no_id) == 2 and ({" ".join(c), near(c)} & set(no_id))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1), min_size=2, max_size=9), st.sampled_from([(9, 10), (4, 5), (1, 2)]))
def test_divide_skip_finds_every_link(sets, t):
    num, den = t
    arrays = sorted((np.array(sorted(s), np.uint64) for s in sets), key=len)
    f = jaccard.Forest(len(arrays))
    for a, b in jaccard.divide_skip(arrays, num, den):
        f.join(a, b)
    g = jaccard.Forest(len(arrays))
    for a, b in itertools.combinations(range(len(arrays)), 2):
        x, y = set(arrays[a].tolist()), set(arrays[b].tolist())
        if den * len(x & y) >= num * len(x | y):
            g.join(a, b)
    assert [f.root(i) for i in range(len(arrays))] == [g.root(i) for i in range(len(arrays))]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(0, 12), st.integers(0, 12), st.integers(0, 10**6), st.sampled_from([(9, 10), (4, 5)]))
def test_linked_sets_share_a_signature(common, a, b, seed, t):
    num, den = t
    r = random.Random(seed)
    x = [r.getrandbits(64) for _ in range(common + a + b)]
    one, two = x[: common + a], x[:common] + x[common + a :]
    if den * common < num * (common + a + b):
        return
    doc = np.array([0] * len(one) + [1] * len(two))
    slot, keys, need = jaccard.signatures(doc, np.array(one + two, np.uint64), 2, num, den)
    assert max(len(both := set(keys[slot == x].tolist()) & set(keys[slot == y].tolist())) - max(need[x], need[y], 1) for x in (0, 1) for y in (2, 3)) >= 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 12), min_size=1), st.integers(1, 3)), min_size=1, max_size=6), st.integers(1, 6))
def test_heap_merge(lists, need):
    want = {v: sum(w for x, w in lists if v in x) for v in range(13)}
    want = sorted((v, c) for v, c in want.items() if c >= need)
    assert list(zip(*jaccard.heap_merge([sorted(x) for x, _ in lists], [w for _, w in lists], need), strict=True)) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 9), min_size=1), min_size=2, max_size=12), st.sampled_from([(1, 2), (4, 5), (9, 10)]), st.integers(0, 5))
def test_divide_skip(sets, share, queries):
    num, den = share
    a = [np.array(sorted(x), np.uint64) for x in sorted(sets, key=len)]
    link = lambda x, y: den * len(set(a[x]) & set(a[y])) >= num * len(set(a[x]) | set(a[y]))
    pairs = {(x, y) for x in range(len(a)) for y in range(x + 1, len(a)) if link(x, y)}
    assert {tuple(sorted(p)) for p in jaccard.divide_skip(a, num, den).tolist()} == pairs
    k = min(queries, len(a))
    assert {tuple(p) for p in jaccard.divide_skip(a, num, den, k).tolist()} == {(x, y) for x in range(k) for y in range(k, len(a)) if link(x, y)}


def removal_by_hand(rows, n):
    order = sorted(set(rows), key=lambda x: key(*x))
    first, marks = {}, {}
    words = {x: re.findall(BLANK, x[1] or "") for x in order}
    for x in order:
        w = words[x]
        marks[x] = [False] * len(w)
        for s in range(len(w) - n + 1):
            g = tuple(w[s : s + n])
            if g in first:
                marks[x][s : s + n] = [True] * n
            else:
                first[g] = x
    return {x: [a for a, m in zip(words[x], marks[x]) if not m] for x in order}, {x: sum(marks[x]) for x in order}


@pytest.mark.parametrize("n", [20, 4])
def test_substring_removal(docs, corpus, n):
    kept, gone = removal_by_hand(corpus, n)
    got = substring.deduplicate(docs, n, keep=["doc_id"], digest="sha").collect()
    want = sorted(((x[0], len(re.findall(BLANK, x[1] or "")), gone[x], hashlib.sha256(" ".join(kept[x]).encode()).hexdigest()) for x in corpus), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    for r in substring.deduplicate(docs, n).collect():
        x = (r.doc_id, r.text)
        assert r.kept == (r.text if not gone[x] else " ".join(kept[x]))
        assert sum(s.end - s.start for s in r.removed_spans) == r.n_removed


@pytest.mark.parametrize("most", [0, 2, None])
def test_extended_prefixes(docs, corpus, monkeypatch, most):
    """Anchors that count as too common: all, those of over two leaves, and more than may be listed."""
    monkeypatch.setattr(substring, "PART_BYTES", 2000)
    if most is None:
        monkeypatch.setattr(substring, "MOST_COMMON", 3)
    monkeypatch.setattr(substring.repeated_windows, "__defaults__", (20, "text", "d", most or 0))
    kept, gone = removal_by_hand(corpus, 12)
    got = substring.deduplicate(docs, 12, keep=["doc_id"], digest="sha").collect()
    assert sorted(((r.doc_id, r.n_removed, r.sha) for r in got), key=repr) == sorted(((x[0], gone[x], hashlib.sha256(" ".join(kept[x]).encode()).hexdigest()) for x in corpus), key=repr)


@pytest.mark.parametrize("most", [0, 2])
def test_extended_windows_are_reduced_twice(docs, corpus, monkeypatch, most):
    """Small pieces in many groups: leaves of extended windows go through two rounds of subtrees."""
    monkeypatch.setattr(substring, "PART_BYTES", 3000)
    monkeypatch.setattr(substring, "PIECE_BYTES", 1000)
    monkeypatch.setattr(substring, "FAN", 2)
    monkeypatch.setattr(substring.repeated_windows, "__defaults__", (20, "text", "d", most))
    kept, gone = removal_by_hand(corpus, 12)
    got = substring.deduplicate(docs, 12, keep=["doc_id"], digest="sha").collect()
    assert sorted(((r.doc_id, r.n_removed, r.sha) for r in got), key=repr) == sorted(((x[0], gone[x], hashlib.sha256(" ".join(kept[x]).encode()).hexdigest()) for x in corpus), key=repr)


def test_long_windows(spark, monkeypatch):
    """Windows of 1,500 words over several partitions."""
    monkeypatch.setattr(substring, "PART_BYTES", 8000)
    r = random.Random(2)
    base = [f"v{r.randrange(300)}" for _ in range(1600)]
    rows = [(1, " ".join(base)), (2, " ".join(["a", *base[:1550], "b"])), (3, " ".join(base[200:])), (4, " ".join(base[1:1499]))]
    kept, gone = removal_by_hand(rows, 1500)
    got = {r.doc_id: r.n_removed for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), 1500, keep=["doc_id"], digest="sha").collect()}
    assert got == {x[0]: gone[x] for x in rows} and got[2] == 1550


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), max_size=4), st.integers(1, 9))
def test_subtree(texts, n):
    """Nodes are runs of equal words, whatever their hashes, numbered in the order of the suffixes."""
    h = np.array([x for t in texts for x in t], np.uint64)
    end = np.array([sum(map(len, texts[: k + 1])) for k, t in enumerate(texts) for _ in t], np.int64)
    start = np.flatnonzero(np.arange(len(h)) + n <= end)
    if len(start):
        got = substring.subtree(h, end, start, n)
        runs = [tuple(h[i : i + n].tolist()) for i in start]
        order = {x: k for k, x in enumerate(sorted(set(runs)), 1)}
        assert got.tolist() == [order[x] for x in runs]


def test_substring_plain_and_empty(nothing, spark):
    assert substring.deduplicate(nothing).count() == 0
    p = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(3, f"a {p} b", 7), (1, f"x {p}", 7), (2, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in substring.remove_repeats(df).collect()}
    assert got == {1: (f"x {p}", 7), 2: (None, None), 3: ("a b", 3)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(2, 6))
def test_sliding_argmin(v, w):
    v = np.array(v, np.uint64)
    got = substring.sliding_argmin(v, w) if len(v) >= w else []
    assert list(got) == [i + int(np.argmin(v[i : i + w])) for i in range(len(v) - w + 1)]


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def scan_by_hand(text, items, n):
    w = re.findall(ALNUM, (text or "").translate(LOWER))
    hit, found = set(), set()
    for i, t in items:
        g = re.findall(ALNUM, (t or "").translate(LOWER))
        m = min(n, len(g))
        for s in range(len(g) - m + 1) if m else ():
            for p in range(len(w) - m + 1):
                if w[p : p + m] == g[s : s + m]:
                    hit.update(range(p, p + m))
                    found.add("" if i is None else str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_benchmark_scan(spark, docs, corpus, block, monkeypatch):
    """The second case searches the benchmark in several blocks."""
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    long = corpus[4][1].split(" ")
    items = [(10, " ".join(long[2:30])), (9, "Uno!"), (11, None), (12, "..."), (13, corpus[7][1]), (13, "no such words here at all " * 4), (None, "one, two"), (14, "ha " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(docs, bench, keep=["doc_id", "text"]).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == scan_by_hand(r.text, items, 10), r.doc_id
        w, long_ = re.findall(ALNUM, (r.text or "").translate(LOWER)), 0
        for m in r.matches:
            at = [re.findall(ALNUM, (t or "").translate(LOWER)) for i, t in items if ("" if i is None else str(i)) == m.item_id]
            same = w[m.doc_start : m.doc_start + m.words]
            assert any(g[m.item_start : m.item_start + m.words] == same for g in at), (m, r.doc_id)
        for _, t in items:
            g = re.findall(ALNUM, (t or "").translate(LOWER))
            for x in range(len(w) if len(w) < 500 else 0):
                for y in range(len(g)):
                    k = 0
                    while x + k < len(w) and y + k < len(g) and w[x + k] == g[y + k]:
                        k += 1
                    long_ = max(long_, k if k >= min(10, len(g)) else 0)
        if block > 300 and len(w) < 500:
            assert r.longest_match == long_ == max((m.words for m in r.matches), default=0), r.doc_id
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not scan_by_hand(t, items, 10)[1] for _, t in corpus)


def test_longest_match_and_place(spark):
    """Matches of two items that overlap are told apart, with their places; a long item is cut without losing a window."""
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(2000)]
    glued = [*a[5:30], *b[7:30]]
    bench = spark.createDataFrame([(1, " ".join(a)), (2, " ".join([*a[20:30], *b]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x y " + " ".join(glued)), (2, " ".join(b[700:1500]))], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.scan(docs, bench).collect()}
    assert [tuple(m) for m in got[1].matches] == [("1", 5, 2, 25), ("2", 17, 27, 23)]
    assert got[1].n_hit == 48 and got[1].longest_match == 25 and got[2].longest_match == 800


def test_long_item(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1000)
    b = [f"b{i}" for i in range(2000)]
    bench = spark.createDataFrame([(2, " ".join(b))], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(b[k : k + 11])) for k in range(0, 1989, 13)] + [(5000, " ".join(b))], "doc_id long, text string")
    got = decontaminate.scan(docs, bench).collect()
    assert all(r.n_hit == r.n_words and r["items"] == ["2"] for r in got)
    for r in got:
        assert all(b[m.item_start : m.item_start + m.words] == r.text.split(" ")[m.doc_start : m.doc_start + m.words] for m in r.matches)


def test_benchmark_scan_of_nothing(nothing, docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(nothing, none).count() == 0
    assert {(r.n_hit, len(r["items"])) for r in decontaminate.scan(docs, none).collect()} == {(0, 0)}


def test_packing(docs, corpus, nothing, spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack(docs, tokenizer_path(), size=64, group_rows=20, with_ids=True).collect()
    by = {}
    for p in pieces:
        assert p.length == len(p.ids) and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        by.setdefault(p.doc_id, []).append(p)
    for i, t in corpus:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        ps = sorted(by[i], key=lambda p: p.start)
        n = sum(x[0] == i for x in corpus)
        assert [x for p in ps[::n] for x in p.ids] == ids and all(p.doc_tokens == len(ids) for p in ps)
    rows = {}
    for p in pieces:
        rows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for r in rows.values():
        at = 0
        for o, n in sorted(r):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(nothing, tokenizer_path()).count() == 0


def groups_of(frame):
    """Pieces of each task that packs."""
    return {r[0]: r["count"] for r in frame.groupBy(F.shiftright("sequence_id", 32)).count().collect()}


def test_packing_of_long_documents_and_repeated_rows(spark, monkeypatch):
    # many full windows from few documents: groups go by bytes, a full window is a sequence of its own
    monkeypatch.setattr(packing, "GROUP_BYTES", 1 << 20)
    long = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('w', id, ' of words. '), 6000)").alias("text"))
    got = packing.pack(long, tokenizer_path()).cache()
    assert len(groups_of(got)) >= 3 and got.where("length = 2048").count() > 400
    assert got.where("length = 2048").select("sequence_id").distinct().count() == got.where("length = 2048").count()
    used = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert used.where("n > 2048 or n <> m").count() == 0
    assert got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m").count() == 0
    got.unpersist()
    # one hot row of a null id and text: its copies are in several groups, each packed once
    hot = spark.range(3000, numPartitions=16).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    parts = groups_of(packing.pack(hot, tokenizer_path(), group_rows=1000))
    assert sum(parts.values()) == 3000 and len(parts) == 3 and max(parts.values()) < 2000


def test_packing_of_one_text_of_tens_of_megabytes(spark):
    one = spark.createDataFrame([(1, None)], "doc_id long, text string").withColumn("text", F.expr("repeat('a longer word and some more. ', 1000000)"))
    got = packing.pack(one, tokenizer_path()).agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"), F.count_distinct("start").alias("k"), F.count(F.lit(1)).alias("c")).first()
    assert got.n == got.m > 7_000_000 and got.k == got.c == -(-got.m // 2048)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_is_tightest(sizes):
    w, _ = packing.best_fit_decreasing(np.array(sizes, np.int64), 50)
    left = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [x for x in left if x >= sizes[i]]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - sizes[i])
        else:
            left.append(50 - sizes[i])
    assert (w.max() + 1 if sizes else 0) == len(left)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té\x00.", max_size=30), min_size=1, max_size=6))
def test_words(texts):
    data = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    w = Words(np.frombuffer(b"".join(data), np.uint8), off, BLANK_WORDS)
    got = [[] for _ in texts]
    for s, e, d in zip(w.start, w.end, w.doc):
        got[d].append(w.raw[s:e].tobytes().decode())
    assert got == [re.findall(BLANK, t) for t in texts]
    h = w.hashes()
    flat = [x for g in got for x in g]
    assert len(set(h.tolist())) == len(set(flat))


def test_clashing_names_get_underscores(docs):
    got = substring.deduplicate(docs.withColumn("N_WORDS", docs.size), digest="sha")
    assert got.columns == [*docs.columns, "N_WORDS", "n_words_", "n_removed", "sha"] and got.count() == docs.count()


def test_components_write_few_files(spark):
    """Rounds over few edges leave few files, whatever the number of shuffle partitions."""
    import glob
    from urllib.parse import urlparse

    from stratagraph.llm.common import components

    at = urlparse(spark.sparkContext.getCheckpointDir()).path
    conf = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    before = set(glob.glob(f"{at}/rdd-*"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (200, 201), (7, 7)]
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    files = sorted(len(glob.glob(f"{x}/part-*")) for x in set(glob.glob(f"{at}/rdd-*")) - before)
    # the first table holds the edges as they come; each round has two
    assert len(files) > 4 and files[-2] <= spark.sparkContext.defaultParallelism
