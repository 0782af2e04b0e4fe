"""Packing of documents into windows of ``size`` tokens by best-fit decreasing.

A document's tokens end with id 1. Documents longer than a window are first cut into
full windows, which fill a sequence each. What is left of every document
is packed by best-fit decreasing: pieces come longest first, and a segment tree
indexed by remaining capacity finds the tightest open window that still takes the
piece. Packing runs in groups dealt by a hash of the piece, of about ``group_rows`` documents and at most about
``GROUP_BYTES`` of text. Full windows pass through a group as a stream: a task holds what is left of its documents only,
so its memory doesn't grow with the input or with the length of documents, while the padding a group adds is at most part of one window.

Tokens: each distinct word of the texts is encoded once a worker and kept in a bounded
cache; words are independent under the tokenizer's own splitting, so the ids are those
of encoding the text at once. (Words with characters for which that isn't plain go
through the whole tokenizer.)

Nulls: a null text is an empty one: the single id 1; a null id stays null. Repeated rows are packed each; those that different
tasks read are dealt to different groups. Pieces of equal length are taken in the order of (hash of document, start, ids and the task that cut
them), so a repeated task gives the same numbers. An empty table gives no rows.
A long text is encoded in one piece of work, however long. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blobs, flat_text, give_back, ragged
from .textcore import BLANK_WORDS, Words

SIZE = 2048
END_ID = 1
GROUP_ROWS = 40_000
#: Pieces of a group, and rows of a batch, when they carry their ids (some kilobytes each).
GROUP_ROWS_WITH_IDS = 6_000
BATCH_WITH_IDS = 500
#: Bytes of text that a group is meant to have at most.
GROUP_BYTES = 64 << 20
#: Bytes of text encoded at once.
PIECE_BYTES = 1 << 20
#: Words whose ids a worker keeps (about 40 bytes each), and parts of words (about 150 bytes each).
CACHE_WORDS = 600_000
CACHE_PARTS = 100_000

_PLAIN = regex.compile(r"[\x21-\x7EÀ-įı-ž]+")
# fixed value: the splitting pattern of the tokenizer file
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordTokenizer:
    """Ids of whitespace-separated words, encoded once and kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.parts = Tokenizer.from_file(path)
        self.parts.normalizer = normalizers.Sequence([])
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[str, bytes] = {}
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, numbers of their words
        self.ids, self.used = np.zeros(1 << 16, np.uint16 if len(self.ends) <= 1 << 16 else np.int32), 0
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _encode_parts(self, parts: list[str]) -> None:
        for i in range(0, len(parts), 20_000):
            some = parts[i : i + 20_000]
            lines = [" ".join(some[k : k + 500]) for k in range(0, len(some), 500)]
            ids = np.array([x for e in self.parts.encode_batch_fast(lines, add_special_tokens=False) for x in e.ids], self.ids.dtype)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(some):  # a part that doesn't end as expected: one by one
                for p in some:
                    self.pieces[p] = np.array(self.parts.encode(p, add_special_tokens=False).ids, self.ids.dtype).tobytes()
            else:
                data, at = ids.tobytes(), [0, *(cut * ids.itemsize).tolist()]
                self.pieces.update((p, data[a:b]) for p, a, b in zip(some, at[:-1], at[1:], strict=True))

    def add(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encodes new words and keeps their ids under their hashes."""
        if len(self.pieces) > CACHE_PARTS:
            self.pieces = {}
        parts: list[list[str] | None] = []
        new: dict[str, None] = {}
        for w in words:
            if _PLAIN.fullmatch(w) and "<|" not in w:
                low = w.lower()
                p = [low] if low.isalpha() else _SPLIT.findall(low)
                for x in p:
                    if x not in self.pieces:
                        new[x] = None
                parts.append(p)
            else:
                parts.append(None)
        self._encode_parts(list(new))
        kind, get = self.ids.dtype, self.pieces.__getitem__
        out = [np.array(self.whole.encode(w, add_special_tokens=False).ids, kind).tobytes() if p is None else get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for w, p in zip(words, parts, strict=True)]
        size = np.fromiter(map(len, out), np.int64, len(out)) // kind.itemsize
        ids = np.frombuffer(b"".join(out), kind)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), kind)])
        self.ids[self.used : self.used + len(ids)] = ids
        number = len(self.first) + np.arange(len(words), dtype=np.int32)
        self.first = np.concatenate([self.first, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.used += len(ids)
        to = np.searchsorted(self.known, hashes)
        self.known, self.at = np.insert(self.known, to, hashes), np.insert(self.at, to, number)

    def _places(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words of these hashes; -1 if unknown."""
        if not len(self.known):
            return np.full(len(h), -1, np.int64)
        k = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[k] == h, self.at[k], -1).astype(np.int64)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each ended by END_ID, and each text's offsets among them."""
        n = len(off) - 1
        w = Words(raw, off, BLANK_WORDS)
        h, at, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(self.known) + len(h) > CACHE_WORDS:
            self.clear()
        place = self._places(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            data = raw.tobytes()
            self.add(h[new], [data[a:b].decode() for a, b in zip(w.start[at[new]].tolist(), w.end[at[new]].tolist(), strict=True)])
            place = self._places(h)
        first, size = self.first[place][back], self.size[place][back].astype(np.int64)
        # ids of a text, then END_ID
        ends = np.concatenate([[0], np.cumsum(size)])
        text = np.concatenate([[0], np.cumsum(np.diff(ends[w.first]) + 1)])
        out = np.full(text[-1], END_ID, np.int32)
        step = np.arange(ends[-1])
        out[step + np.repeat(w.doc, size)] = self.ids[step + np.repeat(first - ends[:-1], size)]
        return out, text if n else np.zeros(1, np.int64)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class OpenWindows:
    """Open windows in a segment tree over their remaining capacity."""

    def __init__(self, size: int):
        self.base = 1 << (size).bit_length()
        self.tree = bytearray(2 * self.base)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, window: int, left: int) -> None:
        if not self.at[left]:
            k = self.base + left
            while k and not self.tree[k]:
                self.tree[k] = 1
                k >>= 1
        self.at[left].append(window)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least capacity of at least ``need``, and that capacity."""
        k = self.base + need
        if not self.tree[k]:
            # up to the first right-hand sibling that holds something, then down to its left end
            while k > 1 and (k & 1 or not self.tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.base:
                k *= 2
                if not self.tree[k]:
                    k += 1
        left = k - self.base
        window = self.at[left].pop()
        if not self.at[left]:
            while k and not (self.tree[2 * k] or self.tree[2 * k + 1] if k < self.base else self.at[left]):
                self.tree[k] = 0
                k >>= 1
        return window, left


def best_fit_decreasing(sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each piece and its offset there; pieces are at most ``size`` long."""
    window, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_, used = OpenWindows(size), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        got = open_.take(n)
        if got is None:
            got, used = (used, size), used + 1
        w, left = got
        window[i], offset[i] = w, size - left
        if left > n:
            open_.put(w, left - n)
    return window, offset


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, group_rows: int | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, an array)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    kind = d.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def task():
        tok = tokenizer(tokenizer_path)

        def f(raw, off, rows):
            ids, first = tok.encode(raw, off)
            total = np.diff(first)
            pieces = -(-total // size)
            doc = np.repeat(np.arange(len(total)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
            length = np.minimum(size, total[doc] - start)
            at = first[doc] + start
            data = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
            crc = np.array([zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)], np.int64)
            own = rows.column(0).combine_chunks()
            own = pa.concat_arrays(own.chunks) if isinstance(own, pa.ChunkedArray) else own
            out = [own.take(pa.array(doc)), start, length, crc, total[doc]]
            if with_ids:
                out.append(blobs(ids.astype("<i4"), np.append(at, first[-1])))
            return out

        return f

    cut = flat_text(d, "t", task, T.StructType(fields), PIECE_BYTES)
    group_rows = group_rows or (GROUP_ROWS_WITH_IDS if with_ids else GROUP_ROWS)
    rows, size_of_all = d.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0))).first()
    groups = max(1, -(-rows // group_rows), -(-size_of_all // GROUP_BYTES))
    # ids travel as bytes and leave as an array, in the same task: one Python worker at a time
    given = [T.StructField("ids", T.ArrayType(T.IntegerType())) if f.name == "ids" else f for f in cut.schema.fields]
    schema = T.StructType([*given, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def placed(table, window, offset):
        """The rows with the places given to them, in batches."""
        table = table.append_column("sequence_id", pa.array(window)).append_column("offset", pa.array(offset))
        for b in table.to_batches(max_chunksize=BATCH_WITH_IDS if with_ids else 20_000):
            if with_ids:
                k = b.schema.get_field_index("ids")
                data = b.column(k).to_pylist()
                arrays = ragged(np.frombuffer(b"".join(data), "<i4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in data])]), pa.int32())
                b = pa.RecordBatch.from_arrays([arrays if i == k else b.column(i) for i in range(b.num_columns)], names=b.schema.names)
            yield b

    def bins(batches):
        number, held = TaskContext.get().partitionId() << 32, []
        for b in batches:
            table = pa.Table.from_batches([b]).drop_columns(["g"])
            full = pc.equal(table.column("length"), size)
            if n := pc.sum(full).as_py():
                # a full window is a sequence of its own and leaves at once
                yield from placed(table.filter(full), number + np.arange(n), np.zeros(n, np.int64))
                number += n
                table = table.filter(pc.invert(full))
            if table.num_rows:
                held.append(table)
        if held:
            table = pa.concat_tables(held)
            window, offset = best_fit_decreasing(table.column("length").to_numpy(), size)
            del held
            yield from placed(table, number + window, offset)
            del table
        give_back()

    # pieces (small rows: ids only if asked for) are dealt once; a total order makes a repeated task give the same numbers. The number of
    # the task that cut a piece is part of its key, so that equal rows don't all meet in one group
    dealt = cut.withColumn("g", F.xxhash64("doc_id", "start", "ids_crc32", F.spark_partition_id()))
    return dealt.repartition(groups, "g").sortWithinPartitions("g").mapInArrow(bins, schema)
