"""Fill-in-the-middle, mixing of sources and repair of conversations against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from stratagraph.llm import conversations, fim, mixing

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def fim_by_hand(i, t, seed=42, rate=50, spm=80):
    t = t or ""
    w = re.findall(TOKEN, t)
    x = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(w), "plain", None, None, t
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h4 % 100 < spm:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [(200, "  a  b \n"), (201, " "), (202, "x"), (203, "has <P> mark"), (204, "a < P> b <M"), (205, "é ü ß  \U0001f600 z\t"), (206, "a<"), (None, "null id here and more"), (207, "end <")]


@pytest.mark.parametrize(("chunk", "rate"), [(1, 100), (3, 100), (7, 50), (4096, 100)])
def test_fim(spark, corpus, chunk, rate):
    rows = corpus + ODD
    docs = spark.createDataFrame([(i, t, 5, "o") for i, t in rows], "doc_id long, text string, n long, OUTPUT string").repartition(3)
    got = fim.transform(docs, rate=rate, chunk=chunk)
    assert got.columns == ["doc_id", "text", "n", "OUTPUT", "n_", "form", "prefix_chars", "middle_chars", "output_"]
    got = got.withColumn("back", fim.restore("output_", "form"))
    want = sorted(((i, *fim_by_hand(i, t, rate=rate), t or "") for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_, r.form, r.prefix_chars, r.middle_chars, r.output_, r.back) for r in got.collect()), key=repr) == want


def test_fim_of_a_long_text_and_of_none(spark, nothing):
    r = random.Random(4)
    text = "".join(r.choice(["wörd", "a", " ", "\n", "  x"]) for _ in range(3_000_000))
    rows = [(7, text), (8, "b" * 5_000_000), (9, None)]
    got = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), rate=100).collect()
    assert sorted((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in got) == sorted((i, *fim_by_hand(i, t, rate=100)) for i, t in rows)
    assert fim.transform(nothing).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab é\n\t<", max_size=12), max_size=6), st.integers(1, 5), st.integers(1, 4))
def test_fim_chunks(texts, size, block):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    counted = fim.count_chunks(raw, off, size, block)
    seen = np.concatenate([[0], np.cumsum(counted[3])])
    tokens = [re.findall(TOKEN, t) for t in texts]
    assert np.diff(seen[counted[2]]).tolist() == [len(w) for w in tokens]
    at = [(d, k) for d, w in enumerate(tokens) for k in range(1, len(w) + 1)]
    doc, ranks = np.array([d for d, _ in at], np.int64), np.array([k for _, k in at], np.int64)
    assert fim.cut_places(raw, off, ranks, doc, counted, size).tolist() == [len("".join(tokens[d][:k])) for d, k in at]


def mix_by_hand(rows, weights=(1, 2, 3), most=3, seed=42):
    """{row number: (size, source size, target, taken)} of rows (id, text, source); targets by exact fractions."""
    from fractions import Fraction

    size = [len(re.findall(WORD, t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    of = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full = {}
    while True:
        left, weight = Fraction(sum(size) - sum(full.values())), sum(w[s] for s in names if s not in full)
        over = [s for s in names if s not in full and w[s] * left / weight > most * of[s]]
        if not over:
            break
        full |= {s: most * of[s] for s in over}
    goal = {s: Fraction(full[s]) if s in full else w[s] * left / weight for s in names}
    out = {}
    for s in names:
        budget = int(goal[s] + Fraction(1, 2))
        mine = sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: (hashlib.sha256(f"{seed}:{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest()[:15], rows[k][0] is not None, rows[k][0] or 0, size[k]))
        taken = dict.fromkeys(mine, 0)
        while budget and of[s]:
            for k in mine:
                n = min(size[k], budget)
                taken[k] += n
                budget -= n
        out |= {k: (size[k], of[s], float(goal[s]), taken[k]) for k in mine}
    return out


MIXES = [
    [(i, "w " * (i % 7), f"s{i % 4}") for i in range(60)],
    [(i, "w " * (1 + i % 5), "hot" if i % 3 else f"s{i}") for i in range(90)],
    [(1, "a b", "x"), (1, "a b", "x"), (1, "a b", "x"), (None, "c", None), (None, "c", None), (2, None, "y"), (3, "", "z"), (4, "é ü \U0001f600", "\U0001f600"), (5, "k " * 40, "￮"), (6, "l " * 3, "")],
    [(9, "only one source here", "s")],
    [(1, None, "a"), (2, " ", None)],
]


@pytest.mark.parametrize("rows", MIXES)
@pytest.mark.parametrize("few", [10_000, 1])
def test_mix(spark, monkeypatch, rows, few):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    docs = spark.createDataFrame([(*r, "o", 3) for r in rows], "doc_id long, text string, source string, size string, mix_docs long").repartition(3)
    got = mixing.mix(docs, keep=["doc_id", "text", "source", "size", "mix_docs"])
    assert got.columns == ["doc_id", "text", "source", "size", "mix_docs", "size_", "source_size", "target", "epochs", "part"]
    got = got.withColumn("taken", F.col("epochs") * F.col("size_") + F.col("part")).collect()
    want = mix_by_hand(rows)
    assert sorted(((r.doc_id, r.text, r.source, r.size_, r.source_size, r.target, r.taken) for r in got), key=repr) == sorted(((*rows[k], *v) for k, v in want.items()), key=repr)
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == int(mine[0].target + 0.5) if mine[0].source_size else all(r.taken == 0 for r in mine)
    assert all(r.taken <= 3 * r.size_ for r in got)


def test_mix_gives_texts(spark):
    rows = [(1, " one  two\nthree ", "a"), (2, "vier fünf", "b"), (3, "sechs", "b"), (4, None, "b")]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=["doc_id", "text"])
    plan = {r.doc_id: r for r in mixed.collect()}
    out = defaultdict(list)
    for r in mixing.emit(mixed).orderBy("copy").collect():
        out[r.doc_id].append(r.text)
    for i, t, _ in rows:
        assert out[i][: plan[i].epochs] == [t] * plan[i].epochs
        assert [len(re.findall(WORD, x)) for x in out[i][plan[i].epochs :]] == ([plan[i].part] if plan[i].part else [])
        assert all((t or "").startswith(x or "") for x in out[i])


def test_mix_spreads_a_hot_source_and_equal_rows(spark, nothing):
    """One source holds nearly all rows and one row a third of them: the sort deals both to several tasks, and a second run gives the same."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.range(30_000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "'a b c' as text", "if(id % 100 = 1, 's', 'hot') as source")
    a = mixing.mix(docs)
    sums = a.groupBy("source_size").agg(F.sum(F.col("epochs") * F.col("size") + F.col("part")).alias("n"), F.max("target").alias("t")).collect()
    assert len(sums) == 2 and all(r.n == int(r.t + 0.5) for r in sums)
    again = mixing.mix(docs)
    assert a.exceptAll(again).count() == 0 and again.exceptAll(a).count() == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    none = nothing.selectExpr("*", "'a' as source")
    assert mixing.mix(none).collect() == []


LEGAL = re.compile(r"(s?(ua)+)?")


def repair_by_hand(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of rows (turn, role, text) in order: edits one at a time, audits compared as strings."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    fault, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        fault.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    long = {"u": "user", "a": "assistant"}
    later = {q: (0, "", []) if q in "a" else None for q in ("", "s", "u", "a")}

    def inserts(best):
        """An inserted turn leads from one state to another of the same row; two are enough."""
        for _ in range(3):
            for (q, x), to in go.items():
                if x in "ua" and best[to] is not None:
                    c, a, o = best[to]
                    new = (c + 2, "I" + a, [f"{long[x]}:", *o])
                    if best[q] is None or new[:2] < best[q][:2]:
                        best[q] = new
        return best

    later = inserts(later)
    for (_, role, text), f in reversed(list(zip(rows, fault, strict=True))):
        now = {}
        for q in later:
            c, a, o = later[q]
            options = [(c + 3, "D" + a, o)]
            if f in ("", "truncated"):
                extra = f == "truncated"
                if to := go.get((q, role[:1])):
                    c, a, o = later[to]
                    options.append((c + extra, "K" + a, [f"{role}:{text}", *o]))
                for x in "ua":
                    if (to := go.get((q, x))) and x != role[:1]:
                        c, a, o = later[to]
                        options.append((c + 2 + extra, "R" + a, [f"{long[x]}:{text}", *o]))
            now[q] = min(options, key=lambda z: z[:2])
        later = inserts(now)
    c, a, o = later[""]
    return gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, c, a, o


def test_repair_by_hand_is_exhaustive():
    """The reference of these tests against all sequences of edits, for short conversations."""
    r = random.Random(2)
    for _ in range(40):
        rows = [(k, r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b", " ", "c!"])) for k in range(r.randrange(4))]
        _, _, _, _, _, cost, audit, lines = repair_by_hand(rows)
        fault, seen = [], set()
        for _, role, text in rows:
            fault.append(not text.strip() or (role, text) in seen)
            seen.add((role, text))
        best = None
        options = [[("D", 3, None)] + ([] if fault[k] else [(x, c + (text.strip()[-1] not in ".!?"), y) for x, c, y in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant"))]) for k, (_, role, text) in enumerate(rows)]
        extra = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
        for picks in itertools.product(*options):
            for ins in itertools.product(extra, repeat=len(rows) + 1):
                roles, letters, total = [], "", 0
                for k in range(len(rows) + 1):
                    roles += ins[k]
                    letters += "I" * len(ins[k])
                    total += 2 * len(ins[k])
                    if k < len(rows):
                        letters += picks[k][0]
                        total += picks[k][1]
                        roles += [picks[k][2]] if picks[k][2] else []
                if LEGAL.fullmatch("".join(x[0] for x in roles)) and (best is None or (total, letters) < best):
                    best = (total, letters)
        assert (cost, audit) == best, rows
        assert LEGAL.fullmatch("".join(x[0] for x in lines))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", " "]), st.sampled_from(["a.", "b", " ", "c!", "d?", "e.", "f.", "g."])), max_size=14))
def test_solve(turns):
    rows = [(k, *x) for k, x in enumerate(turns)]
    want = repair_by_hand(rows)
    p = conversations._Piece(0, 0)
    for t, role, text in rows:
        p.add(t, role, text, text.encode())
    x = p.facts()
    ((cost, role, audit),) = conversations.solve(x["initial"], x["fault"], conversations.AT_END)
    audit += "I" * conversations._END[role]
    assert (cost, audit) == want[5:7]
    assert [f"{t['role']}:{t['text']}" for t in conversations.turns_of(audit, 0, p.roles, p.texts)] == want[7]


def damaged_by_hand(rows):
    """{conv_id: rows in order} after the faults of the query."""
    out = {c: [] for c, _, _, _ in rows}
    word = lambda x: " " if x is None else str(x)
    for c, t, role, text in rows:
        k = zlib.crc32(f"{word(c)}:{word(t)}".encode()) % 20
        role, text = word(role), word(text)
        if k:
            x = (t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out[c] += [x, x] if k == 3 else [x]
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())) for c, x in out.items()}


def talk(seed, many=160):
    r, rows = random.Random(seed), []
    for c in [*range(many), None]:
        n = r.choice([1, 2, 3, 4, 6, 9, 40])
        texts = [f"{r.choice('abcdefgh')} {r.randrange(4)}{r.choice(['.', '!', '?', '', ' '])}" for _ in range(n)]
        for k in range(n):
            role = ["user", "assistant"][k % 2] if r.random() < 0.8 else r.choice(["user", "assistant", "system", "tool", None, ""])
            rows.append((c, None if r.random() < 0.03 else k + (k > 4) * r.randrange(3), role, None if r.random() < 0.03 else texts[k]))
    rows += [(9000, 1, "user", "the same."), (9000, 1, "user", "the same."), (9001, 5, "assistant", "x" * 100_000 + ".")]
    return rows


@pytest.mark.parametrize(("piece", "size"), [(1000, 4 << 20), (1, 4 << 20), (3, 4 << 20), (1000, 10)])
def test_conversations(spark, tmp_path, piece, size):
    """Whole pieces, and conversations cut into many pieces over several tasks."""
    rows = talk(3)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "c"))
    df = spark.read.parquet(str(tmp_path / "c"))
    want = {c: repair_by_hand(x) for c, x in damaged_by_hand(rows).items()}
    repaired = conversations.repair(conversations.damage(df), present="present", piece_rows=piece, piece_bytes=size)
    got = conversations.digests(repaired)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r.conv_id]
        assert tuple(r)[1:] == (*w[:7], hashlib.sha256("\n".join(w[7]).encode()).hexdigest()), r.conv_id
    turns = defaultdict(list)
    for r in repaired.orderBy("part").collect():
        turns[r.conv_id] += [f"{t.role}:{t.text}" for t in r.turns]
    assert dict(turns) == {c: w[7] for c, w in want.items()}
    if piece == 1:
        assert repaired.where("parts > 10").count() > 0


def test_a_hot_conversation_and_none(spark):
    """One conversation holds most rows, half of them the same text: its pieces lie in many tasks, none is large."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(30_000).selectExpr("if(id % 9 = 0, id, 5) as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "if(id % 4 = 1, 'again.', id || '.') as text")
    rows = sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])
    want = repair_by_hand([r[1:] for r in rows if r[0] == 5])
    repaired = conversations.repair(df)
    assert repaired.where("conv_id = 5").count() >= 27 and repaired.where("conv_id = 5").agg(F.max(F.length("audit"))).first()[0] < 2200
    r = conversations.digests(repaired).where("conv_id = 5").first()
    assert tuple(r)[1:] == (*want[:7], hashlib.sha256("\n".join(want[7]).encode()).hexdigest())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    none = conversations.digests(conversations.repair(df.where("turn < 0")))
    assert none.collect() == []
