"""Single files that several tasks read and write: NumPy archives, zip members and files of numbers, by ranges of bytes.

Three data sources: arrays (rows of two arrays of an archive), lines (of the one member of a zip) and numbers (of a text of numbers),
each partition being a range; and a sink that writes blocks at places computed beforehand into one file of known size. Stored (not
compressed) members can be cut anywhere; a compressed one is read as a stream by one task, which holds a block of it at a time.

Files are opened by path (local or mounted) or through Arrow's file systems; ``reachable`` tells whether a path is one of these. The sink needs a path that
can be written at any place, one that all executors mount.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a partition, and of what is held at once.
RANGE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
_SPACE = b" \t\n\v\f\r"


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path to open where the store is a mounted one, else None."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at)
    return at.toUri().getPath() if at.toUri().getScheme() == "file" else None


def reachable(spark: SparkSession, path: str) -> str | None:
    """A path or address that Python can open on its own, or None."""
    if (here := local_path(spark, path)) is not None:
        return here
    try:
        _store(path)
    except Exception:  # no such store here: Spark alone reads it
        return None
    return path


def _store(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), unquote(urlparse(path).path) if path.startswith("file:") else path


def _open(path: str):
    store, at = _store(path)
    return store.open_input_file(at)


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of the files of a folder in order."""
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    if info.type == fs.FileType.File:
        return [(head + at, info.size)]
    found = store.get_file_info(fs.FileSelector(at))
    return [(head + x.path, x.size) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.base_name[0] not in "._"]


def _ranges(lo: int, hi: int, step: int) -> Iterator[tuple[int, int]]:
    for a in range(lo, hi, step):
        yield a, min(a + step, hi)


def _member_at(f, info: zipfile.ZipInfo) -> int:
    """Where the data of a member begin."""
    f.seek(info.header_offset)
    name, extra = struct.unpack("<26xHH", f.read(30))
    return info.header_offset + 30 + name + extra


class _Source(DataSource):
    def __init__(self, options):
        super().__init__(options)
        self.path, self.step = options["path"], int(options.get("range_bytes", RANGE_BYTES))


@dataclass
class Rows(InputPartition):
    path: str
    names: tuple[str, str]
    rows: int
    places: tuple[int, int] | None = None  # None: compressed, read as streams
    kinds: tuple[str, str] = ("", "")


class Arrays(_Source):
    """(src, dst) from two one-dimensional arrays of NumPy archives."""

    @classmethod
    def name(cls):
        return "stratagraph_arrays"

    def schema(self):
        return "src long, dst long"

    def reader(self, schema):
        return ArraysReader(self.path, tuple(self.options.get("names", "src,dst").split(",")), self.step)


class ArraysReader(DataSourceReader):
    def __init__(self, path: str, names: tuple[str, str], step: int):
        self.path, self.names, self.step = path, names, step

    def partitions(self):
        out = []
        for path, _ in files(self.path):
            with _open(path) as f, zipfile.ZipFile(f) as z:
                heads = [self._head(z, n) for n in self.names]
                if len({n for _, n, _ in heads}) != 1:
                    raise ValueError(f"{path}: the arrays differ in length")
                infos, rows = [z.getinfo(f"{n}.npy") for n in self.names], heads[0][1]
                if any(i.compress_type != zipfile.ZIP_STORED for i in infos):
                    out.append(Rows(path, self.names, rows))
                    continue
                at, kinds = [_member_at(f, i) + h[2] for i, h in zip(infos, heads, strict=True)], tuple(h[0] for h in heads)
                sizes = [np.dtype(k).itemsize for k in kinds]
                for a, b in _ranges(0, rows, max(1, self.step // max(sizes))):
                    out.append(Rows(path, self.names, b - a, (at[0] + a * sizes[0], at[1] + a * sizes[1]), kinds))
        return out or [Rows("", self.names, 0)]

    @staticmethod
    def _head(z: zipfile.ZipFile, name: str) -> tuple[str, int, int]:
        """(type, length, bytes of the header) of an array."""
        with z.open(f"{name}.npy") as f:
            version = np.lib.format.read_magic(f)
            shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            if len(shape) != 1 or kind.kind not in "iu":
                raise ValueError(f"array {name} is no list of integers")
            return kind.str, shape[0], f.tell()

    def read(self, p: Rows):
        if not p.rows:
            return
        if p.places is None:
            with _open(p.path) as f, _open(p.path) as g, zipfile.ZipFile(f) as y, zipfile.ZipFile(g) as z:
                kinds = [self._head(x, n)[0] for x, n in zip((y, z), p.names, strict=True)]
                with y.open(f"{p.names[0]}.npy") as a, z.open(f"{p.names[1]}.npy") as b:
                    for x in (a, b):
                        version = np.lib.format.read_magic(x)
                        (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(x)
                    yield from self._batches((a, b), kinds, p.rows)
            return
        with _open(p.path) as a, _open(p.path) as b:
            a.seek(p.places[0])
            b.seek(p.places[1])
            yield from self._batches((a, b), p.kinds, p.rows)

    @staticmethod
    def _batches(streams, kinds, rows: int):
        for lo, hi in _ranges(0, rows, BLOCK_BYTES // 8):
            got = [np.frombuffer(f.read((hi - lo) * np.dtype(k).itemsize), k).astype(np.int64) for f, k in zip(streams, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["src", "dst"])


@dataclass
class Bytes(InputPartition):
    """Bytes lo..hi of a file, or what follows the first lo bytes of a compressed member."""

    path: str
    part: int
    lo: int
    hi: int
    first: bool = False
    end: int = 0  # where the text ends, beyond which nothing is read
    member: str = ""


def _whole_words(f, p: Bytes, ends: bytes) -> Iterator[bytes]:
    """Blocks of the words (or lines) that begin in a range, cut at their ends."""
    f.seek(p.lo if p.first else p.lo - 1)
    at, held = f.tell(), b""
    skipping = not p.first  # up to the first end at or before the range
    while at < p.end:
        more = f.read(min(BLOCK_BYTES, p.end - at))
        if not more:
            break
        if skipping:
            cut = _first_of(more, ends)
            if cut < 0:
                at += len(more)
                if at >= p.hi:
                    return
                continue
            skipping = False
            if at + cut + 1 >= p.hi:
                return
            more, at = more[cut + 1 :], at + cut + 1
        held += more
        at += len(more)
        if at >= p.hi:
            # the word that begins before the end of the range may go on behind it
            own = len(held) - (at - p.hi)
            cut = own if own and held[own - 1] in ends else _first_of(held, ends, own)
            if cut >= 0 or at >= p.end:
                yield held if cut < 0 else held[:cut]
                return
        elif (cut := max(held.rfind(bytes([x])) for x in ends)) >= 0:
            yield held[: cut + 1]
            held = held[cut + 1 :]
    if held:
        yield held


def _first_of(data: bytes, ends: bytes, start: int = 0) -> int:
    return min((k for x in ends if (k := data.find(bytes([x]), start)) >= 0), default=-1)


class Numbers(_Source):
    """(part, k, value): the k-th number of each range of texts of numbers between white space; ranges and files in order."""

    @classmethod
    def name(cls):
        return "stratagraph_numbers"

    def schema(self):
        return "part int, k long, value long"

    def reader(self, schema):
        return NumbersReader(self.path, self.step)


class NumbersReader(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.path, self.step = path, step

    def partitions(self):
        cuts = [(path, lo, hi, size) for path, size in files(self.path) for lo, hi in _ranges(0, size, self.step)]
        return [Bytes(path, k, lo, hi, lo == 0, size) for k, (path, lo, hi, size) in enumerate(cuts)] or [Bytes("", 0, 0, 0)]

    def read(self, p: Bytes):
        if p.hi == p.lo:
            return
        k = 0
        with _open(p.path) as f:
            for block in _whole_words(f, p, _SPACE):
                x = np.array(block.split(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p.part, np.int32)), pa.array(np.arange(k, k + len(x))), pa.array(x)], ["part", "k", "value"])
                k += len(x)


def first_numbers(path: str, many: int) -> list[int]:
    """The first numbers of a text of them."""
    held = b""
    for at, _ in files(path):
        with _open(at) as f:
            held += f.read(1 << 12)
        if len(held.split()) > many:
            break
    return [int(x) for x in held.split()[:many]]


class Lines(_Source):
    """(kind, value): lines of the one member of zip files, kind being its extension; MatrixMarket without its head."""

    @classmethod
    def name(cls):
        return "stratagraph_lines"

    def schema(self):
        return "kind string, value string"

    def reader(self, schema):
        return LinesReader(self.path, self.step)


def only_member(path: str) -> zipfile.ZipInfo:
    with _open(path) as f, zipfile.ZipFile(f) as z:
        infos = z.infolist()
        if len(infos) != 1:
            raise ValueError(f"the archive holds {len(infos)} members, not one")
        return infos[0]


class LinesReader(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.path, self.step = path, step

    def partitions(self):
        out = []
        for path, _ in files(self.path):
            info = only_member(path)
            with _open(path) as f, zipfile.ZipFile(f) as z:
                skip = 0
                if info.filename.lower().endswith(".mtx"):
                    with z.open(info) as m:  # comments, then the size line
                        for line in m:
                            skip += len(line)
                            if line.strip() and not line.lstrip().startswith(b"%"):
                                break
                if info.compress_type != zipfile.ZIP_STORED:
                    out.append(Bytes(path, len(out), skip, info.file_size, member=info.filename))
                    continue
                start = _member_at(f, info)
                end = start + info.file_size
                out += [Bytes(path, len(out) + k, lo, hi, k == 0, end, "") for k, (lo, hi) in enumerate(_ranges(start + skip, end, self.step))]
        return out or [Bytes("", 0, 0, 0)]

    def read(self, p: Bytes):
        if p.hi == p.lo:
            return
        kind = only_member(p.path).filename.rpartition(".")[2].lower()
        with _open(p.path) as f:
            if p.member:
                with zipfile.ZipFile(f) as z, z.open(p.member) as m:
                    m.read(p.lo)
                    held = b""
                    while more := m.read(BLOCK_BYTES):
                        held += more
                        cut = held.rfind(b"\n")
                        yield self._batch(kind, held[: cut + 1])
                        held = held[cut + 1 :]
                    yield self._batch(kind, held)
                return
            for block in _whole_words(f, p, b"\n"):
                yield self._batch(kind, block)

    @staticmethod
    def _batch(kind: str, block: bytes) -> pa.RecordBatch:
        lines = block.decode("utf-8", "replace").split("\n")
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(lines), pa.string()), pa.array(lines, pa.string())], ["kind", "value"])


def crc_of_both(a: int, b: int, size: int) -> int:
    """The crc32 of two pieces one after the other, from theirs and the second one's length: zero bytes are a linear map over bits, raised by squaring."""
    times = lambda m, v: _xor(m[i] for i in range(32) if v >> i & 1)
    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        step = [times(step, step[i]) for i in range(32)]
    while size:
        if size & 1:
            a = times(step, a)
        step = [times(step, step[i]) for i in range(32)]
        size >>= 1
    return a ^ b


def _xor(values) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


@dataclass
class Written(WriterCommitMessage):
    runs: list[tuple[int, int, int]]  # place, bytes, crc32


def joined(batches: Iterator[pa.RecordBatch], size: int, starts: tuple[int, ...]) -> Iterator[tuple[int, bytes]]:
    """(place, bytes): the bytes of neighbouring rows put together, up to a block each, from batches (place, a column for each of ``starts``) sorted by place.

    starts: where row 0 of each column stands; integers take 8 bytes a place (size 8), text its own (size 1) and a line end.
    """
    held: dict[int, list] = {}  # by column: place of its first byte, its bytes, how many

    def out(k):
        at, parts, _ = held.pop(k)
        return at, b"".join(parts)

    for b in batches:
        if not b.num_rows:
            continue
        at = b.column(0).to_numpy(zero_copy_only=False)
        if size == 8:
            data = [c.to_numpy(zero_copy_only=False).astype("<i8") for c in b.columns[1:]]
            cuts = np.flatnonzero(np.diff(at) != 1) + 1
        else:
            data = [[x.encode() + b"\n" for x in c.to_pylist()] for c in b.columns[1:]]
            cuts = np.flatnonzero(np.diff(at) != [len(x) for x in data[0][:-1]]) + 1
        cuts = [0, *cuts.tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            for k, start in enumerate(starts):
                pos, raw = start + int(at[lo]) * size, data[k][lo:hi].tobytes() if size == 8 else b"".join(data[k][lo:hi])
                if k in held and held[k][0] + held[k][2] != pos:
                    yield out(k)
                own = held.setdefault(k, [pos, [], 0])
                own[1].append(raw)
                own[2] += len(raw)
                if own[2] >= BLOCK_BYTES:
                    yield out(k)
    for k in list(held):
        yield out(k)


class Blocks(_Source):
    """Sink for rows (place, columns of integers or one of text): each task puts its rows together to blocks and writes each at its place of one new file, a zip of
    stored members. A task holds a block a column, however many rows it has.

    Option members: ``name:bytes`` of each, comma-joined; a block's place counts from the start of the first member's data over all data without headers.
    Options size and starts as in ``joined``; heads: ``place:hexadecimal bytes`` that the writer puts in itself.
    The file appears under its name when all its bytes are there, and not at all otherwise.
    """

    @classmethod
    def name(cls):
        return "stratagraph_blocks"

    def schema(self):
        return "place long"

    def writer(self, schema, overwrite):
        pairs = lambda x: [y.rpartition(":")[::2] for y in self.options[x].split(",") if y]
        sizes, heads = [(n, int(s)) for n, s in pairs("members")], [(int(p), bytes.fromhex(x)) for p, x in pairs("heads")]
        return BlocksWriter(self.path, sizes, int(self.options["size"]), tuple(int(x) for x in self.options["starts"].split(",")), heads)


class BlocksWriter(DataSourceArrowWriter):
    def __init__(self, path: str, members: list[tuple[str, int]], size: int, starts: tuple[int, ...], heads: list[tuple[int, bytes]]):
        self.path, self.members, self.temporary = path, members, f"{path}.{uuid.uuid4().hex}"
        self.size, self.starts = size, starts
        self.at, data, place = [], 0, 0  # (place among the data, place in the file, header)
        for name, size in members:
            place += len(self._local(name, size, 0))
            self.at.append((data, place))
            data, place = data + size, place + size
        self.total, self.end = data, place
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(self.temporary, "wb") as f:
            f.truncate(self.end)
            self.own = self._put(f, heads)

    @staticmethod
    def _local(name: str, size: int, crc: int) -> bytes:
        extra = struct.pack("<HHQQ", 1, 16, size, size)
        return struct.pack("<4s5H3L2H", b"PK\3\4", 45, 0, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra)) + name.encode() + extra

    def _pieces(self, pos: int, data: bytes) -> Iterator[tuple[int, bytes]]:
        """(place in the file, bytes) of a block, which may go over the end of a member."""
        for k, ((start, place), (_, size)) in enumerate(zip(self.at, self.members, strict=True)):
            lo, hi = max(pos, start), min(pos + len(data), start + size)
            if lo < hi:
                yield place + lo - start, data[lo - pos : hi - pos]

    def _put(self, f, blocks) -> list[tuple[int, int, int]]:
        """Writes blocks at their places: the runs of bytes."""
        runs: list[list[int]] = []
        for pos, data in blocks:
            for place, piece in self._pieces(pos, data):
                f.seek(place)
                f.write(piece)
                own = next((r for r in runs if r[0] + r[1] == place), None)
                if own:
                    own[1:] = [own[1] + len(piece), zlib.crc32(piece, own[2])]
                else:
                    runs.append([place, len(piece), zlib.crc32(piece)])
        return [tuple(r) for r in runs]

    def write(self, iterator):
        with open(self.temporary, "r+b") as f:
            runs = self._put(f, joined(iterator, self.size, self.starts))
            f.flush()
            os.fsync(f.fileno())
        return Written(runs)

    def commit(self, messages):
        runs = sorted({*self.own, *(r for m in messages if m is not None for r in m.runs)})
        central = b""
        with open(self.temporary, "r+b") as f:
            for (name, size), (_, place) in zip(self.members, self.at, strict=True):
                crc, at = 0, place
                for lo, n, c in (r for r in runs if place <= r[0] < place + size):
                    if lo != at:
                        raise ValueError(f"{name}: bytes {at - place} to {lo - place} were not written once")
                    crc, at = crc_of_both(crc, c, n), at + n
                if at != place + size:
                    raise ValueError(f"{name}: bytes from {at - place} were not written")
                head = self._local(name, size, crc)
                f.seek(place - len(head))
                f.write(head)
                extra = struct.pack("<HHQQQ", 1, 24, size, size, place - len(head))
                central += struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45, 0, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name.encode() + extra
            f.seek(self.end)
            f.write(central)
            n = len(self.members)
            f.write(struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(central), self.end))
            f.write(struct.pack("<4sLQL", b"PK\6\7", 0, self.end + len(central), 1))
            f.write(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, n, n, len(central), 0xFFFFFFFF, 0))
        os.replace(self.temporary, self.path)

    def abort(self, messages):
        if os.path.exists(self.temporary):
            os.remove(self.temporary)


def array_head(rows: int) -> bytes:
    """The header of an array of 64-bit integers."""
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": "<i8", "fortran_order": False, "shape": (rows,)})
    return out.getvalue()


def load(spark: SparkSession, source: type[DataSource], path: str, **options) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(path=path, **options).load()


def store(rows: DataFrame, path: str, members: list[tuple[str, int]], size: int, starts: tuple[int, ...], heads: dict[int, bytes] | None = None) -> None:
    """Rows (place, columns), sorted by place in their tasks, into one file: see ``Blocks``."""
    rows.sparkSession.dataSource.register(Blocks)
    options = {"members": ",".join(f"{n}:{s}" for n, s in members), "size": size, "starts": ",".join(map(str, starts)), "heads": ",".join(f"{p}:{x.hex()}" for p, x in (heads or {}).items())}
    rows.write.format(Blocks.name()).mode("append").options(path=path, **options).save()
