"""Fill-in-the-middle: documents cut at two of their token boundaries and put in another order.

A token is a run of white space with the word after it, or white space at the end of a text
(``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``). So a token ends after a character if that is the last of its text,
or is no white space and the next one is: a predicate on adjacent characters, which needs no scan from the start.

Texts are decomposed into chunks of CHUNK bytes, each seeing one byte of the next, over whole batches of texts at once. Each chunk counts its
token ends and its characters; prefix sums of the counts give the tokens and characters before every chunk, route each cut rank
to the chunk that owns it, and only those chunks are scanned again for the place itself. A very long text is many chunks, handled in
blocks of bounded size, so the work besides a text itself doesn't grow with its length. There is no shuffle.

Which documents are cut, where, and in which order follows from sha256 of ``seed:doc_id``: h1 to h4 are its first four groups of eight hex
digits. The prefix ends after min(h1, h2) mod (n + 1) tokens, each taken mod first, the middle after the larger; a document stays plain if h3 mod 100
is not below ``rate``, or if it is empty or holds one of the three marks already; else it is written suffix first (spm) if h4 mod 100 is below
``spm``, prefix first (psm) if not.

Cases: a null text is an empty one (plain, n 0, output empty); a null id counts as an empty string in the hash; repeated rows are transformed alike; an empty table
gives no rows; new columns that clash with kept ones get underscores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, prepare
from .textcore import BLANK_WORDS, string_buffers

# fixed values: the marks of prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk, and chunks worked on at once.
CHUNK = 4096
BLOCK = 512


def _chunks(off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of texts at these offsets, and the number of each text's first chunk (one more at the end)."""
    many = -(-np.diff(off) // size)
    first = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(len(many)), many)
    start = off[doc] + (np.arange(first[-1]) - first[doc]) * size
    return start, np.minimum(start + size, off[doc + 1]), first


def _ends(raw: np.ndarray, lo: int, hi: int, last: np.ndarray) -> np.ndarray:
    """For the bytes lo..hi whether a token ends after them; ``last``: places of the last bytes of texts among them."""
    word = BLANK_WORDS[raw[lo : hi + 1]]  # one byte of overlap
    here = np.zeros(hi - lo, bool)
    here[: len(word) - 1] = word[:-1] & ~word[1:]
    here[last - lo] = True
    return here


def count_chunks(raw: np.ndarray, off: np.ndarray, size: int = CHUNK, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of each text's first chunk, token ends in each chunk, characters in each chunk)."""
    start, end, first = _chunks(off, size)
    tokens, chars = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    closes = off[1:][np.diff(off) > 0] - 1
    for i in range(0, len(start), block):
        k = slice(i, min(i + block, len(start)))
        lo, hi = int(start[k][0]), int(end[k][-1])
        own = closes[np.searchsorted(closes, lo) : np.searchsorted(closes, hi)]
        here = _ends(raw, lo, hi, own)
        tokens[k] = np.add.reduceat(here, start[k] - lo, dtype=np.int64)
        chars[k] = np.add.reduceat((raw[lo:hi] & 0xC0) != 0x80, start[k] - lo, dtype=np.int64)
    return start, end, first, tokens, chars


def cut_places(raw: np.ndarray, off: np.ndarray, ranks: np.ndarray, doc: np.ndarray, counted, size: int = CHUNK) -> np.ndarray:
    """Characters of a text before the end of its rank-th token, for ranks from 1 and the texts they are of."""
    start, end, first, tokens, chars = counted
    seen, passed = np.concatenate([[0], np.cumsum(tokens)]), np.concatenate([[0], np.cumsum(chars)])
    want = seen[first[doc]] + ranks
    owner = np.searchsorted(seen, want, "left") - 1  # the chunk in which that token ends
    out = passed[owner] - passed[first[doc]]
    left = want - seen[owner]
    is_last = np.zeros(len(start), bool)
    is_last[first[1:][np.diff(first) > 0] - 1] = True
    none = np.zeros(0, np.int64)
    # each owning chunk is scanned again once, whatever the number of ranks in it
    for c, at in zip(*_grouped(owner), strict=True):
        lo, hi = int(start[c]), int(end[c])
        ends = np.flatnonzero(_ends(raw, lo, hi, np.array([hi - 1]) if is_last[c] else none))
        places = ends[left[at] - 1] + 1
        before = np.concatenate([[0], np.cumsum((raw[lo:hi] & 0xC0) != 0x80)])
        out[at] += before[places]
    return out


def _grouped(x: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(x):
        return [], []
    order = np.argsort(x, kind="stable")
    v, at = np.unique(x[order], return_index=True)
    return v.tolist(), np.split(order, at[1:])


_PLACES = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "prefix", "middle")])


def _places(size: int):
    @F.arrow_udf(_PLACES)
    def places(text: pa.Array, h1: pa.Array, h2: pa.Array, plain: pa.Array) -> pa.Array:
        off, raw = string_buffers(text)
        off = off - off[0]
        counted = count_chunks(raw, off, size)
        seen = np.concatenate([[0], np.cumsum(counted[3])])
        n = np.diff(seen[counted[2]])
        a, b = h1.to_numpy(zero_copy_only=False) % (n + 1), h2.to_numpy(zero_copy_only=False) % (n + 1)
        cut = ~plain.to_numpy(zero_copy_only=False) & (n > 0)
        ranks = np.stack([np.minimum(a, b), np.maximum(a, b)])
        chars = np.zeros((2, len(n)), np.int64)
        for row in range(2):
            at = np.flatnonzero(cut & (ranks[row] > 0))
            chars[row, at] = cut_places(raw, off, ranks[row, at], at, counted, size)
        none = pa.array(~cut)
        null = pa.scalar(None, pa.int64())
        return pa.StructArray.from_arrays([pa.array(n), pa.compute.if_else(none, null, pa.array(chars[0])), pa.compute.if_else(none, null, pa.array(chars[1] - chars[0]))], fields=[pa.field(x, pa.int64()) for x in ("n", "prefix", "middle")])

    return places


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, seed: int = 42, rate: int = 50, spm: int = 80, chunk: int = CHUNK) -> DataFrame:
    """The kept columns and n, form, prefix_chars, middle_chars, output.

    The texts go to Python once and stay in the JVM besides; only three numbers a document come back, and the output is put together there.
    """
    prepare(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    t, d, h, p = (fresh(docs, x) for x in ("fim_text", "fim_digest", "fim_hash", "fim_places"))
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    base = docs.select(*keep)
    names = [fresh(base, x) for x in names]
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(t), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256).alias(d))
    group = lambda k: F.conv(F.substring(d, 8 * k + 1, 8), 16, 10).cast("long")
    df = df.withColumn(h, F.struct(*[group(k).alias(f"h{k + 1}") for k in range(4)]))
    marked = F.col(t).contains(PREFIX) | F.col(t).contains(SUFFIX) | F.col(t).contains(MIDDLE)
    plain = (F.length(t) == 0) | marked | (F.col(h)["h3"] % 100 >= rate)
    df = df.withColumn(p, _places(chunk)(F.col(t), F.col(h)["h1"], F.col(h)["h2"], plain))
    a, m = F.col(p)["prefix"], F.col(p)["middle"]
    form = F.when(a.isNull(), F.lit("plain")).when(F.col(h)["h4"] % 100 < spm, F.lit("spm")).otherwise(F.lit("psm"))
    prefix, middle, suffix = F.substr(F.col(t), F.lit(1), a.cast("int")), F.substr(F.col(t), (a + 1).cast("int"), m.cast("int")), F.substr(F.col(t), (a + m + 1).cast("int"))
    output = F.when(a.isNull(), F.col(t)).when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    return df.select(*keep, *[c.alias(x) for c, x in zip((F.col(p)["n"], form, a, m, output), names, strict=True)])


def restore(output: str | Column, form: str | Column) -> Column:
    """The text that an output of ``transform`` was made from.

    A transformed text holds each mark once: the text had none, and marks can't overlap what stands beside them.
    """
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    x = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(x[1], x[3], x[2])).when(form == "spm", F.concat(x[2], x[3], x[1])).otherwise(output)
