"""Vectorised word handling shared by the corpus operators.

Everything works on the raw UTF-8 buffer of an Arrow string column. All
separators used by the operators are ASCII, so byte tables are enough: bytes of
multi-byte characters are never separators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2, _GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
#: Odd base of the rolling polynomial over word hashes.
_BASE = 0xD1342543DE82EF95

#: Bytes of text handled at once inside a task; bounds the numpy temporaries.
CHUNK_BYTES = 4 << 20


def _table(keep) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[b for b in range(256) if keep(b)]] = True
    return t


#: Word bytes for words of the form [^\x20\x09-\x0D]+ .
BLANK_WORDS = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Word bytes for words of the form [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z).
ALNUM_WORDS = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, starting anywhere) and bytes of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    if len(off) == 0:
        off = np.zeros(1, np.int64)
    return off, raw[off[0] : off[-1]]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """Words of a run of texts.

    start, end: byte places in ``raw``; doc: index of the word's text;
    first: for each text the number of its first word (n + 1 entries).
    """

    __slots__ = ("raw", "start", "end", "doc", "first")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray, lower: bool = False):
        off = np.asarray(offsets - offsets[0], np.int64)
        if lower:
            raw = _LOWER[raw]
        self.raw = raw
        n = len(raw)
        inside = np.zeros(n + 1, bool)
        np.take(keep, raw, out=inside[:n])
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        cut = off[:-1][off[:-1] < n]
        begins = inside & ~before
        begins[cut] |= inside[cut]
        self.start = np.flatnonzero(begins)
        # a word ends where the next byte is no word byte or begins another text
        ends = before & ~inside
        ends[cut] |= before[cut]
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def starts8(self) -> np.ndarray:
        """The first eight bytes of each word and of what follows it, as little-endian numbers."""
        raw = np.zeros(len(self.raw) + 8, np.uint8)
        raw[: len(self.raw)] = self.raw
        return np.ndarray((len(self.raw) + 1,), "<u8", raw, 0, (1,))[self.start]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; a bijection on words of up to seven bytes."""
        raw = np.zeros(len(self.raw) + 8, np.uint8)
        raw[: len(self.raw)] = self.raw
        lanes = np.ndarray((len(self.raw) + 1,), "<u8", raw, 0, (1,))
        size = (self.end - self.start).astype(np.int64)
        h = size.astype(U64) * _GOLD
        todo, k = np.arange(len(size)), 0
        while len(todo):
            left = size[todo] - 8 * k
            x = lanes[self.start[todo] + 8 * k]
            short = left < 8
            x[short] &= (U64(1) << (left[short] * 8).astype(U64)) - U64(1)
            h[todo] = mix(h[todo] ^ x)
            todo = todo[left > 8]
            k += 1
        return h


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, U64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=U64)


_POW: dict[str, np.ndarray] = {}


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive entries; len(h) - n + 1 of them."""
    m = len(h)
    if m < n:
        return np.zeros(0, U64)
    if len(_POW.get("p", ())) < m:
        size = 1 << max(17, (m - 1).bit_length())
        if size > 1 << 20:  # one long piece: not kept
            return _rolled(h, n, _powers(m, _BASE), _powers(m, pow(_BASE, -1, 1 << 64)))
        _POW["p"], _POW["i"] = _powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))
    return _rolled(h, n, _POW["p"], _POW["i"])


def _rolled(h: np.ndarray, n: int, power: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    m = len(h)
    acc = np.zeros(m + 1, U64)
    np.cumsum(h * power[:m], out=acc[1:])
    return mix((acc[n:] - acc[:-n]) * inverse[: m - n + 1])


def windows(first: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Word numbers at which a run of ``n`` words of one text starts."""
    if len(doc) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])

