"""Language identification by prediction by partial matching (PPM).

For each language a variable-order context tree over bytes (contexts of 0 to
``ORDER`` bytes) holds frozen counts. The code length of a byte follows method C:
in a context seen n times with q different successors, a seen byte has
probability count / (n + q) and the escape q / (n + q), after which the next shorter
context is asked without the bytes already ruled out (exclusion), down to a
uniform order. Since the statistics are frozen, the exact code lengths are worked out once: each language has
a table over the contexts and bytes that it has seen itself, and all contexts seen by any language point
to the longest one that each has seen. A text then costs three look-ups a byte and language. The language with the shortest code wins.
Languages are held in groups whose tables are counted to stay under ``GROUP_BYTES``; of several groups one at a time is loaded.

Texts are lower-cased (A-Z and the letters U+00C0-U+00DE); every run of ASCII bytes that
are no letters is one space.

Training takes a bounded sample: about ``per_language`` documents of each language,
by hash of the id, of at most ``MOST_BYTES`` each (longer ones only where a language has no others). Every text is scored whole, however long. Nulls: rows with a null text, language or id don't train; a
null text, or one without a letter, is `und` with score 0. Ties go to the first language
by name. Without training rows everything is `und`. Repeated rows are each returned, an empty table gives no rows, clashing
output names get underscores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

ORDER = 3
PER_LANGUAGE = 300
MOST_BYTES = 1 << 18
#: Bytes of tables that are broadcast as one, and bytes of text coded at once.
GROUP_BYTES = 128 << 20
PIECE_BYTES = 1 << 20
#: Code length of a byte that no context of the language has seen, after all escapes.
UNKNOWN_BITS = 8.0

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def normal(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts and their offsets; each text begins with one space."""
    n = len(off) - 1
    b = _FOLD[raw]
    if len(b) > 1:
        up = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        b[1:][up] += 0x20
    space = b == 0x20
    drop = np.zeros(len(b), bool)
    drop[1:] = space[1:] & space[:-1]
    starts = off[:-1][np.diff(off) > 0]
    drop[starts] = space[starts]
    # a text's leading space is written anew
    kept = np.flatnonzero(~drop)
    size = np.diff(np.searchsorted(kept, off))
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(at[-1], 0x20, np.uint8)
    out[np.arange(len(kept)) + np.repeat(np.arange(n), size) + 1] = b[kept]
    return out, at


def _grams(x: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of n symbols, as numbers to the base ``size``, and their counts."""
    if len(x) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = np.zeros(len(x) - n + 1, np.int64)
    for k in range(n):
        g = g * size + x[k : len(x) - n + 1 + k]
    return np.unique(g, return_counts=True)


class Tree:
    """Frozen context tree of one language over its own symbols: contexts by length, and the code length of every symbol in each."""

    def __init__(self, x: np.ndarray, a: int):
        own = np.unique(x)
        self.size = len(own) + 1
        self.symbol = np.full(a, self.size - 1, np.int32)  # joint symbol -> own; the last one stands for the unseen
        self.symbol[own] = np.arange(len(own))
        self.grams = [_grams(self.symbol[x].astype(np.int64), k + 1, self.size) for k in range(ORDER + 1)]
        self.contexts = [np.unique(self.grams[k][0] // self.size) if k else np.zeros(1, np.int64) for k in range(ORDER + 1)]
        self.begin = np.concatenate([[0], np.cumsum([len(c) for c in self.contexts])])
        self.bits = np.concatenate([self._lengths(c, k) for k, c in enumerate(self.contexts)]).astype(np.float32)
        del self.grams

    def _lengths(self, rows: np.ndarray, depth: int) -> np.ndarray:
        """Bits of every symbol in contexts of ``depth`` symbols."""
        out = np.empty((len(rows), self.size))
        for lo in range(0, len(rows), 4096):
            r = rows[lo : lo + 4096]
            bits, escape, known = np.zeros((len(r), self.size)), np.zeros(len(r)), np.zeros((len(r), self.size), bool)
            for k in range(depth, -1, -1):
                g, c = self.grams[k]
                want = (r % self.size**k)[:, None] * self.size + np.arange(self.size)
                at = np.minimum(np.searchsorted(g, want), max(len(g) - 1, 0))
                c = np.where((g[at] == want) & ~known, c[at], 0) if len(g) else np.zeros(want.shape, np.int64)
                n, q, here = c.sum(1), (c > 0).sum(1), c > 0
                with np.errstate(divide="ignore"):
                    bits[here] = (escape[:, None] - np.log2(c / np.maximum(n + q, 1)[:, None]))[here]
                    escape += np.where(q > 0, -np.log2(np.maximum(q, 1) / np.maximum(n + q, 1)), 0)
                known |= here
            bits[~known] = np.broadcast_to(escape[:, None] + UNKNOWN_BITS, bits.shape)[~known]
            out[lo : lo + 4096] = bits
        return out

    def places(self, code: np.ndarray, depth: int, a: int) -> np.ndarray:
        """Where in ``bits`` the longest known suffix of each joint context of ``depth`` symbols begins."""
        out, digits = np.zeros(len(code), np.int64), [self.symbol[code // a**k % a].astype(np.int64) for k in range(depth)]
        own = np.zeros(len(code), np.int64)
        for k in range(1, depth + 1):  # the last k symbols
            own = own + digits[k - 1] * self.size ** (k - 1)
            c = self.contexts[k]
            at = np.minimum(np.searchsorted(c, own), len(c) - 1)
            found = (c[at] == own) if len(c) else np.zeros(len(own), bool)
            out[found] = self.begin[k] + at[found]
        return (out * self.size).astype(np.int32)


class Trees:
    """Context trees of several languages.

    symbol: byte -> joint symbol (the last one stands for bytes never seen); known: joint contexts of each
    length that some language has seen; places: for each language and context, the row of its table.
    """

    def __init__(self, langs: list[str], texts: list[list[bytes]]):
        self.langs = langs
        streams = []
        for t in texts:
            off = np.concatenate([[0], np.cumsum([len(x) for x in t])]).astype(np.int64)
            streams.append(normal(np.frombuffer(b"".join(t), np.uint8), off)[0])
        seen = np.unique(np.concatenate([*streams, np.array([0x20], np.uint8)])) if streams else np.array([0x20], np.uint8)
        a = self.size = len(seen) + 1
        self.symbol = np.full(256, a - 1, np.int64)
        self.symbol[seen] = np.arange(a - 1)
        ids = [self.symbol[s] for s in streams]
        self.trees = [Tree(x, a) for x in ids]
        self.known = [np.unique(np.concatenate([_grams(x, k + 1, a)[0] // a for x in ids])) if ids and k else np.zeros(1, np.int64) for k in range(ORDER + 1)]
        self.places = [np.concatenate([t.places(c, k, a) for k, c in enumerate(self.known)]) for t in self.trees]
        self.table = None

    def nbytes(self) -> int:
        return sum(t.bits.nbytes for t in self.trees) + sum(p.nbytes for p in self.places) + 4 * self.size**ORDER

    def __getstate__(self):
        return {**self.__dict__, "table": None}  # made again where it is used

    def context(self) -> np.ndarray:
        """Of each run of ORDER symbols: the number of its longest suffix among the known contexts."""
        if self.table is None:
            t, begin = np.zeros(1, np.int32), 1
            for k in range(1, ORDER + 1):
                t = np.tile(t, self.size)
                t[self.known[k]] = begin + np.arange(len(self.known[k]))
                begin += len(self.known[k])
            self.table = t
        return self.table

    def code(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code length in bits of each text in each language, and the bytes coded."""
        b, at = normal(raw, off)
        x, table = self.symbol[b], self.context()
        ctx = np.zeros(len(x), np.int64)
        for k in range(ORDER, 0, -1):
            ctx *= self.size
            ctx[k:] += x[:-k] if k <= len(x) else 0
        row = table[ctx]
        # the bytes that open a text would be coded in the context of the text before; the space is known
        first = at[:-1]
        space = self.symbol[0x20]
        for k in range(1, ORDER):
            p = first + k
            p, f = p[p < at[1:]], first[p < at[1:]]
            c = np.full(len(p), 0, np.int64)
            for j in range(ORDER, 0, -1):
                c = c * self.size + np.where(p - j >= f, x[np.maximum(p - j, 0)], space)
            row[p] = table[c]
        total = np.zeros((len(first), len(self.langs)))
        for k, (t, place) in enumerate(zip(self.trees, self.places, strict=True)):
            bits = t.bits.ravel()[place[row] + t.symbol[x]]
            bits[first] = 0
            if len(first):
                total[:, k] = np.add.reduceat(bits, first, dtype=np.float64)
        return total, np.diff(at) - 1

    def groups(self, most: int) -> list[Trees]:
        """The languages dealt to groups of at most ``most`` bytes (or of one language)."""
        if self.nbytes() <= most or len(self.langs) < 2:
            return [self]
        half = len(self.langs) // 2
        out = []
        for lo, hi in ((0, half), (half, len(self.langs))):
            part = Trees.__new__(Trees)
            part.__dict__ = {**self.__dict__, "langs": self.langs[lo:hi], "trees": self.trees[lo:hi], "places": self.places[lo:hi], "table": None}
            out += part.groups(most)
        return out


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Trees:
    """Trees from a hashed sample of about ``per_language`` documents of each language."""
    d = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where("i is not null and t is not null and l is not null")
    d = d.withColumn("short", F.octet_length("t") <= MOST_BYTES)
    counts = {r.l: (r.n, r.s) for r in d.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.count_if("short").alias("s")).collect()}
    if not counts:
        return Trees([], [])
    none = [k for k, (_, s) in counts.items() if not s]
    d = d.where(F.col("short") | F.col("l").isin(none)) if none else d.where("short")
    counts = {k: s or n for k, (n, s) in counts.items()}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int((1 << 30) * min(1.0, per_language / n))))])
    langs: dict[str, list[bytes]] = {k: [] for k in sorted(counts)}
    for r in d.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < share[F.col("l")]).select("l", "t").toLocalIterator():
        langs[r.l].append(r.t.encode())
    return Trees(list(langs), list(langs.values()))


def _letters(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter."""
    ascii_ = np.zeros(256, bool)
    ascii_[0x41:0x5B] = ascii_[0x61:0x7B] = True
    count = lambda t: np.diff(np.concatenate([[0], np.cumsum(t[raw])])[off])
    has = count(ascii_) > 0
    high = np.zeros(256, bool)
    high[0x80:] = True
    for k in np.flatnonzero(~has & (count(high) > 0)):
        has[k] = any(c.isalpha() for c in raw[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace"))
    return has


def identify(docs: DataFrame, trees: Trees, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and its share of the posterior under equal priors (per-text code lengths)."""
    sc = docs.sparkSession.sparkContext
    sent = [sc.broadcast(g) for g in trees.groups(GROUP_BYTES)]
    langs = np.array(trees.langs or ["und"], object)

    def task():
        def group(b):
            # of several groups none is kept in memory
            return b.load_from_path(b._path) if len(sent) > 1 and getattr(b, "_path", None) else b.value

        def f(raw, off, rows):
            n = len(off) - 1
            if langs[0] == "und" and len(langs) == 1 and not group(sent[0]).langs:
                return [pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n))]
            bits = np.concatenate([group(b).code(raw, off)[0] for b in sent], 1)
            best = bits.argmin(1)
            gap = np.clip((bits - bits.min(1, keepdims=True)), 0, 900)
            score = 1 / (2.0**-gap).sum(1)
            has = _letters(raw, off)
            return [pa.array(np.where(has, langs[best], "und"), pa.string()), pa.array(np.where(has, score, 0.0))]

        return f

    return map_text(docs, text, task, [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())], keep, PIECE_BYTES)
