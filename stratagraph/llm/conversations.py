"""Repair of the structure of conversations: which turns to keep, rerole, delete or insert so that the roles are right, at the least cost.

The roles of a repaired conversation are ``(s?(ua)+)?`` by their first letters: nothing, or pairs of user and assistant after at most one
system turn. Keeping a turn costs 0, giving it the role user or assistant 2, deleting it 3, inserting an empty turn of either 2; a truncated turn that
stays adds 1; blank and duplicate ones must go.

Retained-subsequence DP: only the turns that stay are chosen. From the last turn backwards, what it costs to go on after turn k with role r is the cost of the gap to the next retained
turn: the deletions between them, a difference of prefix sums, and the insertions, which the two roles alone determine. So for each role a running minimum
over the next turns, with the prefix sum taken off, prices all gaps at once, and a turn takes a fixed number of steps. Ties go to the
ASCII-least audit (D < I < K < R): the later next turn (more deletions first), then the one with an insertion. Two audits of one cost never differ by a mere ending.

Conversations of any length: rows are range-sorted by (conversation, turn), so a conversation may lie in several tasks, and each task works in pieces of at most PIECE_ROWS
rows and about PIECE_BYTES of text. A conversation in one piece is done there and then. Of the others (at most two a task, and the long ones) each piece gives a 4 x 4
matrix of least costs from the last role before it to the last role in it; these are put together from the end, which tells each piece what comes
after it costs; each piece is then solved for all four roles before it, and a walk over its pieces picks the one that holds. What one
task gets of a conversation as a whole is a few numbers for each thousand turns. Turns seen earlier are found by the digest of their text, first
inside pieces, then by the first places of each piece.

Rows of one conversation stand in the order of turn (null first), role, and sha256 of the text. Nulls in role or text count as one space; a null
conversation is one of its own. Role initials other than s, u and a can't be kept, only reroled. Repeated rows are duplicates. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import prepare, settle, stored

PIECE_ROWS = 1000
PIECE_BYTES = 4 << 20
#: Costs of a deletion, an insertion, a new role, and of a truncated turn that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
_BLANKS = " \t\n\v\f\r"

# roles before a gap: START, S, U, A; insertions between the role before and the next one kept (S, U, A), and at the end
START, S, U, A = range(4)
_GAP = {(START, S): 0, (START, U): 0, (START, A): 1, (S, U): 0, (S, A): 1, (U, U): 1, (U, A): 0, (A, U): 0, (A, A): 1}
_NEXT = [[(r, n) for (b, r), n in _GAP.items() if b == before] for before in range(4)]
_END = (0, 2, 1, 0)
_OVER = 1 << 60
#: What is left to pay after the last row, by the role before.
AT_END = tuple(INSERT * n for n in _END)
_INITIAL = {"s": S, "u": U, "a": A}
_NAME = {U: "user", A: "assistant"}
BLANK, DUPLICATE, CUT = 1, 2, 3


def solve(initial: list[int], fault: list[int], after: tuple[int, ...] | list[int], entries: tuple[int, ...] = (START,)) -> list[tuple[int, int, str]]:
    """For each role before the rows: (least cost, last role after them, audit).

    after: what is to pay behind the rows by the last role; insertions at the end aren't part of the audit.
    """
    n = len(initial)
    deleted = DELETE * n  # the prefix sum of deletions up to row k is DELETE * k
    least = [_OVER] * 4  # by role of the next retained turn: its cost and what follows, with the deletions before it
    place = [n] * 4
    follow: list[list | None] = [None] * n

    def best(before: int) -> tuple[int, int, int, int]:
        """(cost with the prefix sum, place, insertions, role) of the next retained turn; the place is n if there is none."""
        cost, at, many, role = deleted + after[before], n, 0, before
        for r, ins in _NEXT[before]:
            c = least[r] + INSERT * ins
            if c < cost or (c == cost and (place[r] > at or (place[r] == at and ins > many))):
                cost, at, many, role = c, place[r], ins, r
        return cost, at, many, role

    for k in range(n - 1, -1, -1):
        if fault[k] in (BLANK, DUPLICATE):
            continue
        extra = TRUNCATED if fault[k] == CUT else 0
        own, nexts, new = initial[k], [None] * 4, []
        for r in (S, U, A):
            if r == S and own != S:
                continue
            nexts[r] = best(r)
            # deletions up to row k instead of up to the next one, which is one row more than stays between
            new.append((r, nexts[r][0] - DELETE + extra + (0 if own == r else REROLE)))
        follow[k] = nexts
        for r, c in new:
            if c < least[r]:
                least[r], place[r] = c, k
    out = []
    for before in entries:
        step = best(before)
        cost, at, role, audit = step[0], 0, before, []
        while step[1] < n:
            k, ins, role = step[1], step[2], step[3]
            audit.append("D" * (k - at) + "I" * ins + ("K" if initial[k] == role else "R"))
            at, step = k + 1, follow[k][role]
        audit.append("D" * (n - at))
        out.append((cost, role, "".join(audit)))
    return out


def turns_of(audit: str, before: int, roles: list[str], texts: list[str]) -> list[dict]:
    """The turns that an audit makes of rows after a role: role, text and edit (K, R or I)."""
    out, k, now = [], 0, before
    for x in audit:
        want = A if now == U else U
        if x == "I":
            out.append({"role": _NAME[want], "text": "", "edit": x})
            now = want
            continue
        if x == "K":
            now = _INITIAL[roles[k][:1]]
            out.append({"role": roles[k], "text": texts[k], "edit": x})
        elif x == "R":
            now = want
            out.append({"role": _NAME[now], "text": texts[k], "edit": x})
        k += 1
    return out


_TURN = T.StructType([T.StructField(c, T.StringType()) for c in ("role", "text", "edit")])
_LONGS = T.ArrayType(T.LongType())
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _counts(initial: list[int], fault: list[int]) -> list[int]:
    """(blank, duplicate, truncated, illegal) of rows."""
    legal = {(S, U), (U, A), (A, U)}
    return [fault.count(BLANK), fault.count(DUPLICATE), fault.count(CUT), sum(p not in legal for p in zip(initial, initial[1:]))]


class _Piece:
    """Consecutive rows of a conversation in one task."""

    def __init__(self, conv: object, number: int):
        self.conv, self.number, self.bytes = conv, number, 0
        self.turns, self.roles, self.texts, self.digests = [], [], [], []

    def add(self, turn: int | None, role: str, text: str, digest: bytes) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.digests.append(digest)
        self.bytes += len(text)

    def facts(self) -> dict:
        seen, fault, first = set(), [], []
        for role, text, digest in zip(self.roles, self.texts, self.digests, strict=True):
            end = text.rstrip(_BLANKS)[-1:]
            key = hashlib.sha256(digest + role.encode()).digest()
            fault.append(BLANK if not end else DUPLICATE if key in seen else 0 if end in ".!?" else CUT)
            first.append(key if end and key not in seen else None)
            seen.add(key)
        known = [t for t in self.turns if t is not None]
        return {"initial": [_INITIAL.get(r[:1], 4) for r in self.roles], "fault": fault, "first": first, "turn_from": known[0] if known else None, "turn_to": known[-1] if known else None, "turns_known": len(set(known))}


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "digest", "present")), strict=True)


def _pieces(rows: DataFrame, piece_rows: int, piece_bytes: int) -> DataFrame:
    """Pieces of the sorted rows: those that are a whole conversation with their turns and audit, the others with their rows."""
    kind = rows.schema["conv_id"].dataType
    ints, strings = T.ArrayType(T.ByteType()), T.ArrayType(T.StringType())
    schema = T.StructType(
        [T.StructField("conv_id", kind), T.StructField("task", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("whole", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in [*_COUNTS, "turn_from", "turn_to", "turns_known"]]
        + [T.StructField("audit", T.StringType()), T.StructField("turns", T.ArrayType(_TURN))]
        + [T.StructField("initial", ints), T.StructField("fault", ints), T.StructField("first", T.ArrayType(T.BinaryType())), T.StructField("roles", strings), T.StructField("texts", strings)]
    )
    arrow = to_arrow_schema(schema)

    def given(p: _Piece, whole: bool, task: int) -> dict:
        x = p.facts()
        out = {"conv_id": p.conv, "task": task, "number": p.number, "whole": whole}
        if not whole:
            return out | x | {"roles": p.roles, "texts": p.texts}
        ((cost, role, audit),) = solve(x["initial"], x["fault"], AT_END)
        audit += "I" * _END[role]
        gaps = 0 if x["turn_from"] is None else x["turn_to"] - x["turn_from"] + 1 - x["turns_known"]
        return out | dict(zip(_COUNTS, [gaps, *_counts(x["initial"], x["fault"]), cost], strict=True)) | {"audit": audit, "turns": turns_of(audit, START, p.roles, p.texts)}

    def run(batches):
        task = TaskContext.get().partitionId()
        held, size, piece, convs = [], 0, None, 0
        for conv, turn, role, text, digest, present in _rows(batches):
            if piece is None or conv != piece.conv or len(piece.roles) >= piece_rows or piece.bytes >= piece_bytes:
                if piece is not None:
                    # whole if the conversation neither begins nor ends with the task, nor was cut
                    held.append(given(piece, convs > 1 and not piece.number and conv != piece.conv, task))
                    size += piece.bytes
                same = piece is not None and conv == piece.conv
                convs += not same
                piece = _Piece(conv, piece.number + 1 if same else 0)
            if present:
                piece.add(turn, role, text, digest)
            if len(held) >= 500 or size > PIECE_BYTES:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held, size = [], 0
        if piece is not None:
            held.append(given(piece, False, task))
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return rows.mapInArrow(run, schema)


def _joined(o: DataFrame) -> DataFrame:
    """(key, task, number, part, parts, counts, audit, before): pieces of conversations of several ones, solved together."""
    at = ["key", "task", "number"]
    # turns seen in an earlier piece: of each piece the first places only, so a text repeated by all turns is one row a piece
    first = o.select(*at, F.posexplode("first").alias("i", "h")).where("h is not null")
    least = first.groupBy("key", "h").agg(F.min(F.struct("task", "number")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    again = first.join(least, ["key", "h"]).where(F.struct("task", "number") > F.col("m")).groupBy(*at).agg(F.collect_list("i").alias("again"))
    ends_of = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("turn_from", "turn_to")]
    slim = o.select(*at, "initial", "fault", *ends_of, "turns_known").join(again, at, "left")
    tail = [*at, "turn_from", "turn_to", "turns_known"]
    facts = T.StructType([*[slim.schema[c] for c in tail], slim.schema["initial"], slim.schema["fault"], T.StructField("costs", _LONGS), T.StructField("counts", _LONGS)])

    def matrix(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                initial, fault = [int(x) for x in r.initial], [int(x) for x in r.fault]
                for i in [] if r.again is None else r.again:
                    fault[i] = DUPLICATE
                cost = [[c for c, _, _ in solve(initial, fault, [0 if x == end else _OVER for x in range(4)], (START, S, U, A))] for end in range(4)]
                rows.append([*(getattr(r, c) for c in tail), initial, fault, [cost[end][before] for before in range(4) for end in range(4)], _counts(initial, fault)])
            yield pd.DataFrame(rows, columns=facts.names)

    slim = settle(slim.mapInPandas(matrix, facts))

    def behind(f: pd.DataFrame) -> pd.DataFrame:
        """What comes after each piece costs, by the last role before it; and the figures of the whole conversation."""
        f = f.sort_values(["task", "number"])
        after, out = list(AT_END), []
        for m in reversed(f["costs"].tolist()):
            out.append(after)
            after = [int(min(min(m[4 * before + end] + after[end], _OVER) for end in range(4))) for before in range(4)]
        counts = np.array(f["counts"].tolist()).sum(0)
        last, lowest, highest, known = None, None, None, 0
        for a, b, n in zip(f["turn_from"], f["turn_to"], f["turns_known"], strict=True):
            if n:
                known += int(n) - (last == int(a))
                lowest, highest, last = int(a) if lowest is None else lowest, int(b), int(b)
        legal, edge, before = {(S, U), (U, A), (A, U)}, 0, None
        for x in f["ends"].tolist():
            if len(x):
                edge += before is not None and (before, int(x[0])) not in legal
                before = int(x[1])
        gaps = 0 if lowest is None else highest - lowest + 1 - known
        figures = dict(zip(_COUNTS, [gaps, *counts[:3].tolist(), int(counts[3]) + edge, after[START]], strict=True))
        return pd.DataFrame({"key": f["key"], "task": f["task"], "number": f["number"], "part": range(len(f)), "parts": len(f), "after": out[::-1], **figures})

    ends = F.when(F.size("initial") > 0, F.array(F.element_at("initial", 1), F.element_at("initial", -1))).otherwise(F.array().cast("array<tinyint>")).alias("ends")
    kinds = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in at)
    whole = slim.select(*tail, "costs", "counts", ends).groupBy("key").applyInPandas(behind, f"{kinds}, part int, parts int, after array<bigint>, {', '.join(f'{c} bigint' for c in _COUNTS)}")
    slim = slim.select(*at, "initial", "fault").join(whole, at)
    solved = T.StructType([*[slim.schema[c] for c in [*at, "part", "parts", *_COUNTS]], T.StructField("exits", T.ArrayType(T.IntegerType())), T.StructField("audits", T.ArrayType(T.StringType()))])

    def audits(frames):
        for f in frames:
            got = [solve([int(x) for x in r.initial], [int(x) for x in r.fault], [int(x) for x in r.after], (START, S, U, A)) for r in f.itertuples(index=False)]
            f = f[[*at, "part", "parts", *_COUNTS]].copy()
            f["exits"], f["audits"] = [[role for _, role, _ in g] for g in got], [[audit for _, _, audit in g] for g in got]
            yield f

    done = settle(slim.mapInPandas(audits, solved))

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        f, now, out = f.sort_values("part"), START, []
        for x in f["exits"].tolist():
            out.append(now)
            now = int(x[now])
        return pd.DataFrame({"key": f["key"], "task": f["task"], "number": f["number"], "before": out, "last": now})

    way = done.select(*at, "part", "exits").groupBy("key").applyInPandas(walk, f"{kinds}, before int, last int")
    closing = F.when(F.col("part") == F.col("parts") - 1, F.expr(f"repeat('I', element_at(array({', '.join(map(str, _END))}), last + 1))")).otherwise("")
    return done.join(way, at).select(*at, "part", "parts", *_COUNTS, F.concat(F.element_at("audits", F.col("before") + 1), closing).alias("audit"), "before")


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(conv_id, part, parts, gaps, blank, duplicate, truncated, illegal, cost, audit, turns): a row for each conversation, or for each part of a long one.

    turns are the repaired ones (role, text, edit); the counts and the cost are those of the whole conversation; audits and turns of the parts follow one another.
    A row whose ``present`` isn't true isn't a turn: it only names its conversation, which then is there even if no turn is left.
    """
    prepare(rows.sparkSession)
    clean = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        F.coalesce(F.col(present), F.lit(False)).alias("present") if present else F.lit(True).alias("present"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    dealt = clean.orderBy(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest")
    pieces = stored(_pieces(dealt, piece_rows, piece_bytes))
    whole = pieces.where("whole").select("conv_id", F.lit(0).alias("part"), F.lit(1).alias("parts"), *_COUNTS, "audit", "turns")
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key")
    o = pieces.where("not whole").select(key, "*").drop("whole", "audit", "turns", *_COUNTS)
    got = o.select("key", "task", "number", "conv_id", "roles", "texts").join(_joined(o.drop("conv_id", "roles", "texts")), ["key", "task", "number"])

    @F.arrow_udf(T.ArrayType(_TURN))
    def turns(audit: pa.Array, before: pa.Array, roles: pa.Array, texts: pa.Array) -> pa.Array:
        made = [turns_of(*x) for x in zip(audit.to_pylist(), before.to_pylist(), roles.to_pylist(), texts.to_pylist(), strict=True)]
        return pa.array(made, to_arrow_schema(T.StructType([T.StructField("x", T.ArrayType(_TURN))])).field(0).type)

    return whole.unionByName(got.select("conv_id", "part", "parts", *_COUNTS, "audit", turns("audit", "before", "roles", "texts").alias("turns")))


def lines(turns: str = "turns") -> F.Column:
    """``role:text`` of the turns, joined by new lines."""
    return F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")


def digests(repaired: DataFrame) -> DataFrame:
    """One row a conversation: the counts, the cost, the whole audit, and repaired_sha256 over its lines.

    Parts of long conversations pass by in order, a batch at a time; a task holds an audit and a hash, not the texts.
    """
    one = repaired.where("parts = 1").select("conv_id", *_COUNTS, "audit", F.sha2(lines(), 256).alias("repaired_sha256"))
    parts = repaired.where("parts > 1").select("conv_id", "part", *_COUNTS, "audit", F.size("turns").alias("many"), lines().alias("lines"))
    arrow = to_arrow_schema(one.schema)

    def run(batches):
        now, digest, audit, begun = None, None, [], False
        out = lambda: pa.RecordBatch.from_pylist([now | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema=arrow)
        for b in batches:
            for r in b.to_pylist():
                if r["part"] == 0:
                    if now is not None:
                        yield out()
                    now, digest, audit, begun = {c: r[c] for c in ("conv_id", *_COUNTS)}, hashlib.sha256(), [], False
                audit.append(r["audit"])
                if r["many"]:
                    digest.update(("\n" if begun else "").encode() + r["lines"].encode())
                    begun = True
        if now is not None:
            yield out()

    return one.unionByName(parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, one.schema))


def damage(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn`` mod 20: 0 drops the row (present is false then), 1 empties its text,
    2 takes its sentence ends away, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(k == 1, F.lit("")).when(k == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text"))
    role = F.when(k == 4, F.lit("user")).otherwise(word("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (k != 0).alias("present"), F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return out.select("conv_id", "turn", "role", "text", "present", F.explode("copies").alias("copy")).drop("copy")
