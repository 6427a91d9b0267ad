"""BAM files as DataFrames: a Python data source that reads shares of a file, and a writer.

A BAM file is a chain of gzip members, each of which tells its own length (BGZF), so that a task can begin at any of
them. Which byte of the inflated data begins a record is found by looking for a chain of plausible ones. Files of plain
gzip members are read whole by one task. Tags are held as SAM text (`NM:i:1`, parted by tabs).
"""

from __future__ import annotations

import gzip
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ALIGNMENTS = "sample_id string, read_id string, flag int, ref_name string, pos long, mapq int, cigar string, query_length int, as_score int, tlen int, seq string, qual string, tags string"
HEADER = "sample_id string, ref_name string, length long"
ROWS = 10_000
AT_ONCE = 1 << 20  # inflated bytes that are decoded together
LARGE_SHARE, MOST_SHARES = 64 << 20, 2000
LOOK = 4 << 20  # inflated bytes in which a share's first record is looked for

# The format's codes.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
NUMBERS = {"c": "b", "C": "B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
_PAIRS = np.array([[ord(BASES[b >> 4]), ord(BASES[b & 15])] for b in range(256)], np.uint8)
_CODES = {c: i for i, c in enumerate(BASES)}
_ARROW = pa.schema([("sample_id", pa.string()), ("read_id", pa.string()), ("flag", pa.int32()), ("ref_name", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("query_length", pa.int32()), ("as_score", pa.int32()), ("tlen", pa.int32()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.string())])

#: A record up to its read's name.
_FRONT = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("bases", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])

FIELDS = _ARROW.names[1:]  # those of a record; the sample is the file's name


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or ":/" not in uri else uri.replace(":/", ":///", 1))


def _take(file, size: int) -> bytes:
    data = file.read(size)
    if len(data) < size:
        raise EOFError("the file ends inside a record")
    return data


def read_names(file) -> tuple[list[str], list[int]]:
    """Names and lengths of an inflated stream's dictionary; the stream is then at the first record."""
    if _take(file, 4) != b"BAM\1":
        raise ValueError("not a BAM file")
    number = lambda: struct.unpack("<i", _take(file, 4))[0]
    _take(file, number())
    names, lengths = [], []
    for _ in range(number()):
        names.append(_take(file, number())[:-1].decode())
        lengths.append(number())
    return names, lengths


def _tags(data: bytes, at: int) -> Iterator[str]:
    """The tags that begin at `at`, as SAM text."""
    while at < len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            yield f"{tag}:{kind}:{data[at:end].decode()}"
            at = end + 1
        elif kind == "A":
            yield f"{tag}:A:{chr(data[at])}"
            at += 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            form = NUMBERS[sub]
            values = struct.unpack_from(f"<{n}{form[-1]}", data, at + 5)
            yield f"{tag}:B:{','.join([sub, *map(str, values)])}"
            at += 5 + n * struct.calcsize(form)
        else:
            yield f"{tag}:{'f' if kind == 'f' else 'i'}:{struct.unpack_from(NUMBERS[kind], data, at)[0]}"
            at += struct.calcsize(NUMBERS[kind])


def _score(data: bytes, at: int) -> int | None:
    """The score among the tags that begin at `at`, stepping over the others without making text of them."""
    while at < len(data):
        name, kind = data[at : at + 2], chr(data[at + 2])
        if name == b"AS":
            return int(float(next(_tags(data, at))[5:]))
        at += 3
        if kind in "ZH":
            at = data.index(b"\0", at) + 1
        elif kind == "A":
            at += 1
        elif kind == "B":
            at += 5 + struct.unpack_from("<i", data, at + 1)[0] * struct.calcsize(NUMBERS[chr(data[at])])
        else:
            at += struct.calcsize(NUMBERS[kind])
    return None


def _stretches(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of data from each of `at` on, as binary values."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = data[np.repeat(at - ends[:-1], sizes) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])


def _of_each(values: pa.Array, make: Callable, kind: pa.DataType) -> pa.Array:
    """make(value) of every value, made once for equal ones."""
    found = values.dictionary_encode(null_encoding="encode")
    return pa.array([make(x) for x in found.dictionary.to_pylist()], kind).take(found.indices)


def _ops(data: bytes) -> list[tuple[int, str]]:
    return [(x >> 4, OPS[x & 15]) for x in struct.unpack(f"<{len(data) // 4}I", data)]


def decode(data: bytes, places: list[int], names: pa.Array, columns: list[str] = FIELDS, without_flags: int = 0) -> pa.RecordBatch:
    """The values of `columns` (of FIELDS) of the records that begin (after their sizes) at `places`, without those whose
    flags have a bit of without_flags. What isn't asked for is stepped over. names has "*" as its last."""
    held, at = np.frombuffer(data, np.uint8), np.array(places, np.int64)
    head = held[at[:, None] + np.arange(-4, 32)].view(_FRONT)[:, 0]
    keep = (head["flag"] & without_flags) == 0
    at, head = at[keep], head[keep]
    n_bases = head["bases"].astype(np.int64)
    ops = at + 32 + head["name"]
    bases = ops + 4 * head["ops"].astype(np.int64)
    quals = bases + (n_bases + 1) // 2
    tags = quals + n_bases
    cut = lambda start, size: _stretches(held, start, size)
    of_tags = lambda: cut(tags, at + head["size"] - tags)
    of_ops = lambda: cut(ops, 4 * head["ops"].astype(np.int64))

    def values(column: str) -> pa.Array:
        match column:
            case "read_id":
                return cut(at + 32, head["name"].astype(np.int64) - 1).cast(pa.string())
            case "ref_name":
                return names.take(pa.array(np.where(head["ref"] >= 0, head["ref"], len(names) - 1)))
            case "flag" | "pos" | "mapq" | "tlen":
                return pa.array(head[column]).cast(_ARROW.field(column).type)
            case "cigar":
                return _of_each(of_ops(), lambda x: "".join(f"{k}{o}" for k, o in _ops(x)) or "*", pa.string())
            case "query_length":
                return _of_each(of_ops(), lambda x: sum(k for k, o in _ops(x) if o in "MI=X"), pa.int32())
            case "as_score":
                return _of_each(of_tags(), lambda x: _score(x, 0), pa.int32())
            case "tags":
                return _of_each(of_tags(), lambda x: "\t".join(_tags(x, 0)), pa.string())
            case "seq":
                some = n_bases.any()
                seqs = _stretches(_PAIRS[held].ravel() if some else held, 2 * bases if some else bases, n_bases)
                return pc.if_else(pa.array(n_bases > 0), seqs.cast(pa.string()), "*")
            case "qual":
                known = (n_bases > 0) & (held[np.minimum(quals, len(held) - 1)] != 255)
                found = _stretches(held + np.uint8(33), quals, np.where(known, n_bases, 0))
                texts = pa.array([x.decode("latin-1") for x in found.to_pylist()], pa.string()) if known.any() else found.cast(pa.string())
                return pc.if_else(pa.array(known), texts, "*")
        raise KeyError(column)

    return pa.RecordBatch.from_arrays([values(c) for c in columns], schema=pa.schema([_ARROW.field(c) for c in columns])) if columns else pa.RecordBatch.from_struct_array(pa.array([{}] * len(at), pa.struct([])))


class _Inflated:
    """The inflated data of a stream, as far as it has been asked for."""

    border = None  # where in `held` the first byte is that belongs to another share

    def __init__(self, file):
        self.file, self.held = file, bytearray()

    def more(self) -> bool:
        """Some more data; false at the file's end."""
        data = self.file.read(AT_ONCE)
        self.held += data
        return bool(data)

    def need(self, n: int) -> bool:
        while len(self.held) < n:
            if not self.more():
                return False
        return True

    def drop(self, n: int) -> None:
        del self.held[:n]
        if self.border is not None:
            self.border -= n

    def read(self, n: int) -> bytes:
        if not self.need(n):
            raise EOFError("the file ends inside a record")
        out = bytes(self.held[:n])
        self.drop(n)
        return out


class _Blocks(_Inflated):
    """The same of BGZF blocks from the compressed offset `at` on; blocks that begin at `end` or later are another share's."""

    def __init__(self, file, at: int, end: int):
        super().__init__(file)
        self.at, self.end = at, end

    def more(self) -> bool:
        self.file.seek(self.at)
        head = self.file.read(18)
        if len(head) < 18:
            return False
        size = struct.unpack_from("<H", head, 16)[0] + 1
        body = self.file.read(size - 18)
        if self.border is None and self.at >= self.end:
            self.border = len(self.held)
        self.held += zlib.decompress(body[:-8], -15)
        self.at += size
        return True


def is_bgzf(head: bytes) -> bool:
    return len(head) >= 18 and head[:4] == b"\x1f\x8b\x08\x04" and head[12:16] == b"BC\x02\0"


def _block_from(file, at: int, end: int) -> int | None:
    """The first block that begins at `at` or later, and before `end`: its length leads to another one or to the end."""
    file.seek(at)
    data = file.read(end - at + (1 << 17))
    whole = file.size()
    i = data.find(b"\x1f\x8b\x08\x04")
    while 0 <= i < end - at:
        if is_bgzf(data[i : i + 18]):
            following = i + struct.unpack_from("<H", data, i + 16)[0] + 1
            if at + following == whole or is_bgzf(data[following : following + 18]):
                return at + i
        i = data.find(b"\x1f\x8b\x08\x04", i + 1)
    return None


def _plausible(data: bytes, at: int, lengths: list[int]) -> int | None:
    """Where the record at `at` ends, if one can begin there."""
    if at + 36 > len(data):
        return None
    size, ref, pos, name_size, _, _, n_ops, _, n_bases, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    ends = 32 + name_size + 4 * n_ops + (n_bases + 1) // 2 + n_bases
    fits = lambda r, p: -1 <= r < len(lengths) and -1 <= p and (r < 0 or p <= lengths[r])
    if not (name_size > 1 and n_bases >= 0 and ends <= size < 1 << 28 and fits(ref, pos) and fits(mate, mate_pos)):
        return None
    name = data[at + 36 : at + 36 + name_size]
    whole = len(name) == name_size
    return at + 4 + size if not whole or name[-1] == 0 and all(32 < c < 127 for c in name[:-1]) else None


def first_record(blocks: _Inflated, lengths: list[int], chain: int = 4) -> int | None:
    """The first place in inflated data from which plausible records follow each other, to their number or to the end of the
    file or of LOOK bytes. No more is inflated than that takes."""

    def seen(n: int) -> bytearray:
        while len(blocks.held) < min(n, LOOK) and blocks.more():
            pass
        return blocks.held

    i = 0
    while i < len(seen(i + 1)):
        at, n = i, 0
        while n < chain and at is not None and at + 36 <= len(seen(at + 36 + 255)):
            at, n = _plausible(blocks.held, at, lengths), n + 1
        if n and at is not None:
            return i
        i += 1
    return None


class _Share(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))


class _Reader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.columns, self.without_flags = columns, int(options.get("without_flags", 0))
        self.paths, self.header = [p for p in options.get("path", "").split(",") if p], options.get("content") == "header"
        self.share = int(options.get("share_bytes", LARGE_SHARE))

    def partitions(self):
        out, sizes = [], []
        for uri in self.paths:
            fs, path = _open(uri)
            sizes.append((uri, fs.get_file_info(path).size))
        share = max(self.share, min(LARGE_SHARE, -(-sum(size for _, size in sizes) // MOST_SHARES)))
        for uri, size in sizes:
            out += [_Share(uri, a, min(size, a + share)) for a in range(0, 1 if self.header else max(1, size), share)]
        return out

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        uri, start, end = partition.value
        fs, path = _open(uri)
        sample = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        with fs.open_input_file(path) as raw:
            if self.header:
                names, lengths = read_names(gzip.open(raw))
                yield pa.RecordBatch.from_arrays([pa.array([sample] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(lengths, pa.int64())], ["sample_id", "ref_name", "length"])
                return
            fields = [c for c in self.columns if c != "sample_id"]
            for found in _batches(raw, start, end, fields, self.without_flags):
                columns = {"sample_id": pa.repeat(sample, found.num_rows), **dict(zip(fields, found.columns, strict=True))}
                yield pa.RecordBatch.from_arrays([columns[c] for c in self.columns], schema=pa.schema([_ARROW.field(c) for c in self.columns]))


def _records(raw, start: int, end: int, columns: list[str] = FIELDS, without_flags: int = 0) -> Iterator[tuple]:
    """Rows of the records that begin in the blocks of [start, end) and have none of without_flags."""
    for found in _batches(raw, start, end, columns, without_flags):
        yield from zip(*(c.to_pylist() for c in found.columns), strict=True)


def _batches(raw, start: int, end: int, columns: list[str], without_flags: int) -> Iterator[pa.RecordBatch]:
    """The same by some thousand rows."""
    source, names = _from_first_record(raw, start, end)
    known = pa.array([*names, "*"], pa.string())
    while source is not None:
        while len(source.held) < AT_ONCE and source.border is None and source.more():
            pass
        data, at, places = bytes(source.held), 0, []
        stop = len(data) if source.border is None else source.border
        while at < stop and at + 4 <= len(data) and len(places) < ROWS:
            following = at + 4 + struct.unpack_from("<i", data, at)[0]
            if following > len(data):
                break
            places.append(at + 4)
            at = following
        if places:
            found = decode(data, places, known, columns, without_flags)
            if found.num_rows:
                yield found
            source.drop(at)
        elif stop <= 0:
            return
        else:  # a record that is longer than what is held
            whole = 4 + struct.unpack("<i", data[:4])[0] if len(data) >= 4 else 4
            if not source.need(whole):
                raise EOFError("the file ends inside a record")


def _from_first_record(raw, start: int, end: int) -> tuple[_Inflated | None, list[str]]:
    """Inflated data from the first record on that begins in the blocks of [start, end) (None: there are no such), and the
    dictionary's names."""
    if not is_bgzf(raw.read(18)):
        if start:
            return None, []
        raw.seek(0)
        source = _Inflated(gzip.open(raw))
        return source, read_names(source)[0]
    head = _Blocks(raw, 0, end)
    names, lengths = read_names(head)
    if not start:
        return head, names
    at = _block_from(raw, start, end)
    if at is None:
        return None, names
    blocks = _Blocks(raw, at, end)
    skip = first_record(blocks, lengths)
    if skip is None:
        if len(blocks.held) >= LOOK:  # else the file ends with a record of an earlier share
            raise ValueError(f"no record begins within {LOOK} bytes of offset {start}")
        return None, names
    blocks.drop(skip)
    return blocks, names


class BamSource(DataSource):
    """spark.read.format("bam").load(path[,path...]); content=header reads the sequence dictionary, share_bytes is the
    compressed size of a task's share; if shares of that size would be more than MOST_SHARES, they are larger, up to
    LARGE_SHARE. A schema given to the reader, of some of ALIGNMENTS, is all that is decoded;
    records with a bit of without_flags are passed over before anything else of them is."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return HEADER if self.options.get("content") == "header" else ALIGNMENTS

    def reader(self, schema):
        return _Reader(self.options, list(schema.fieldNames()))


def read_bam(spark: SparkSession, paths: list[str], header: bool = False, share_bytes: int = LARGE_SHARE, columns: list[str] | None = None, without_flags: int = 0) -> DataFrame:
    """ALIGNMENTS (or only `columns` of it), or HEADER, of BAM files; a sample is a file's name without its extension.

    Records whose flag has a bit of without_flags are left out while reading.
    """
    types = dict(x.split(" ") for x in ALIGNMENTS.split(", "))
    schema = HEADER if header else ", ".join(f"{c} {types[c]}" for c in columns or types)
    if not paths:
        return spark.createDataFrame([], schema)
    spark.dataSource.register(BamSource)
    read = spark.read.format("bam").schema(schema).option("content", "header" if header else "records").option("without_flags", without_flags)
    return read.option("path", ",".join(paths)).option("share_bytes", share_bytes).load()


def block(data: bytes, level: int = 6) -> bytes:
    """A BGZF block of at most 64 KB of data; that of no data ends a file."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _bins(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest bins of the format's binning (spans of 2 ** 14 bases, then 8 times as many a level) that hold both."""
    out = np.zeros(len(start), np.int64)
    for shift in (26, 23, 20, 17, 14):
        out = np.where(start >> shift == (end - 1) >> shift, ((1 << 29 - shift) - 1) // 7 + (start >> shift), out)
    return out


def _encode_tag(text: str) -> bytes:
    tag, kind, value = text.split(":", 2)
    head = tag.encode() + kind.encode()
    if kind in "ZH":
        return head + value.encode() + b"\0"
    if kind == "A":
        return head + value.encode()
    if kind == "B":
        sub, *values = value.split(",")
        number = float if sub == "f" else int
        return head + sub.encode() + struct.pack("<i", len(values)) + struct.pack(f"<{len(values)}{NUMBERS[sub][-1]}", *map(number, values))
    return head + (struct.pack("<f", float(value)) if kind == "f" else struct.pack("<i", int(value)))


def _packed_ops(cigar: str | None) -> bytes:
    n, out = 0, []
    for c in cigar if cigar and cigar != "*" else "":
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            out.append(struct.pack("<I", n << 4 | OPS.index(c)))
            n = 0
    return b"".join(out)


def _packed_bases(seq: str) -> bytes:
    codes = [_CODES.get(c.upper(), 15) for c in seq] + [0] * (len(seq) % 2)
    return bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))


def encode(row: dict, refs: dict[str, int]) -> bytes:
    """A record of a row of ALIGNMENTS, its size before it. Mates are not carried over."""
    return encode_rows(pa.RecordBatch.from_pylist([row], _ARROW), refs)[0].tobytes()


def encode_rows(rows: pa.RecordBatch, refs: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The records of rows of ALIGNMENTS, one after the other, each with its size before it, and where each begins and the
    last one ends. Mates are not carried over."""
    column = lambda c: rows.column(rows.schema.get_field_index(c))

    def numbers(values: pa.Array | np.ndarray, name: str, instead: int | None = None) -> np.ndarray:
        if isinstance(values, pa.Array):
            values = values if instead is None else values.fill_null(instead)
            if values.null_count:
                raise ValueError(f"a row has no {name}")
            values = values.to_numpy(zero_copy_only=False)
        limits = np.iinfo(_FRONT[name])
        if len(values) and not (limits.min <= values.min() and values.max() <= limits.max):
            raise ValueError(f"{name} is out of the format's range")
        return values

    if column("read_id").null_count:
        raise ValueError("a row has no read_id")
    names = column("read_id").cast(pa.binary())
    ops = _of_each(column("cigar"), _packed_ops, pa.binary())
    span = _of_each(ops, lambda x: sum(k for k, o in _ops(x) if o in "MDN=X") or 1, pa.int64()).to_numpy()
    n, seqs, quals = rows.num_rows, column("seq"), column("qual")
    if seqs.null_count == n:
        n_bases, bases = np.zeros(n, np.int64), []
    else:
        texts = ["" if x in (None, "*") else x for x in seqs.to_pylist()]
        n_bases = np.array([len(x) for x in texts], np.int64)
        scores = [bytes(ord(c) - 33 for c in q) if x and q not in (None, "*") else b"\xff" * len(x) for x, q in zip(texts, quals.to_pylist(), strict=True)]
        bases = [pa.array([_packed_bases(x) for x in texts], pa.binary()), pa.array(scores, pa.binary())]
    score = pc.binary_join_element_wise("AS:i:", column("as_score").cast(pa.string()), "")
    tags = _of_each(pc.coalesce(column("tags"), score, ""), lambda x: b"".join(_encode_tag(t) for t in x.split("\t") if t), pa.binary())

    sizes = [np.diff(_ends(x)) for x in (names, ops, *bases, tags)]
    sizes[0] = sizes[0] + 1  # the zero after the name
    front, pos = np.zeros(n, _FRONT), numbers(column("pos"), "pos")
    places = np.maximum(pos, 0)
    held = {"size": 32 + sum(sizes), "pos": pos, "name": sizes[0], "ops": sizes[1] // 4, "bases": n_bases, "bin": _bins(places, places + span)}
    held |= {c: numbers(column(c), c, instead) for c, instead in (("flag", None), ("mapq", 255), ("tlen", 0))}
    for name, values in held.items():
        front[name] = numbers(values, name)
    front["ref"] = _of_each(column("ref_name"), lambda x: refs.get(x, -1), pa.int32()).to_numpy()
    front["mate"] = front["mate_pos"] = -1
    starts = np.concatenate([[0], np.cumsum(4 + held["size"])])
    out, at = np.zeros(starts[-1], np.uint8), starts[:-1]
    out[at[:, None] + np.arange(36)] = front.view(np.uint8).reshape(n, 36)
    at = at + 36
    for part, size in zip((names, ops, *bases, tags), sizes, strict=True):
        ends = _ends(part)
        if ends[-1] > ends[0]:
            data = np.frombuffer(part.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            out[np.repeat(at - (ends[:-1] - ends[0]), np.diff(ends)) + np.arange(len(data))] = data
        at = at + size
    return out, starts


def _ends(values: pa.Array) -> np.ndarray:
    """The offsets of binary values without nulls."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)


def write_bam(alignments: DataFrame, header: DataFrame, folder: str) -> DataFrame:
    """Write `<folder>/<sample>.bam` for each sample of alignments; sample_id, file, records of each.

    The records of a sample are written by many tasks, as blocks; one task a sample then puts the dictionary before
    them and copies the blocks. header(ref_name, length) is the dictionary of all files, sorted by name; every file
    has it whole, so that it is small.
    """
    spark = alignments.sparkSession
    rows = header.groupBy("ref_name").agg(F.max("length").alias("length")).orderBy("ref_name").collect()
    refs = {r.ref_name: i for i, r in enumerate(rows)}
    known = spark.sparkContext.broadcast(refs)
    text = ("@HD\tVN:1.0\tSO:unsorted\n" + "".join(f"@SQ\tSN:{r.ref_name}\tLN:{r.length}\n" for r in rows)).encode()
    front = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(rows))
    for r in rows:
        name = r.ref_name.encode() + b"\0"
        front += struct.pack("<i", len(name)) + name + struct.pack("<i", r.length)
    fs, base = _open(folder)
    parts = f"{folder.rstrip('/')}/.parts-{uuid.uuid4().hex[:12]}"
    fs.create_dir(base)
    fs.create_dir(_open(parts)[1])
    columns = [c.split(" ")[0] for c in ALIGNMENTS.split(", ")]
    have = [F.col(c) if c in alignments.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in ALIGNMENTS.split(", "))]
    sorted_rows = alignments.select(*have).withColumn("read_id", F.col("read_id").cast("string")).repartitionByRange("sample_id", "read_id").sortWithinPartitions("sample_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, sample, out, held = TaskContext.get().partitionId(), [], None, None, bytearray()

        def close() -> None:
            if out is not None:
                if held:
                    out.write(block(bytes(held)))
                    held.clear()
                out.close()

        for batch in batches:
            samples = batch.column(0).to_pylist()
            turns = [i for i in range(len(samples)) if i == 0 or samples[i] != samples[i - 1]] + [len(samples)]
            for first, following in zip(turns, turns[1:], strict=False):
                if samples[first] != sample:
                    close()
                    sample = samples[first]
                    file = f"{parts}/{part:06d}-{len(done):04d}-{uuid.uuid4().hex[:8]}"
                    done.append([sample, file, 0])
                    fs, path = _open(file)
                    out = fs.open_output_stream(path, compression=None)
                records, starts = encode_rows(batch.slice(first, following - first), known.value)
                at = 0
                while at < len(records):  # blocks end with a record, where one fits
                    end = int(starts[np.searchsorted(starts, at + 65_000 - len(held), "right") - 1])
                    if end <= at and held:
                        out.write(block(bytes(held)))
                        held.clear()
                        continue
                    end = end if end > at else min(len(records), at + 60_000)
                    held += records[at:end].tobytes()
                    at = end
                done[-1][2] += following - first
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["sample_id", "part", "records"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        sample = pdf["sample_id"].iat[0]
        file = f"{folder.rstrip('/')}/{sample}.bam"
        fs, path = _open(file)
        half = f"{path}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(half, compression=None) as out:
            for i in range(0, len(front), 60_000):
                out.write(block(front[i : i + 60_000]))
            for part in sorted(pdf["part"]):
                with fs.open_input_stream(_open(part)[1], compression=None) as blocks:
                    while data := blocks.read(8 << 20):
                        out.write(data)
            out.write(block(b""))
        fs.move(half, path)
        return pd.DataFrame({"sample_id": [sample], "file": [file], "records": [int(pdf["records"].sum())]})

    assert columns == [f.name for f in sorted_rows.schema.fields]
    manifest = f"{parts}/manifest"
    sorted_rows.mapInArrow(write, "sample_id string, part string, records long").write.parquet(manifest)
    written = spark.read.parquet(manifest).groupBy("sample_id").applyInPandas(join, "sample_id string, file string, records long").toPandas()  # a row a sample
    fs.delete_dir(_open(parts)[1])
    return spark.createDataFrame(written, "sample_id string, file string, records long")
