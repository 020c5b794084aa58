"""Record files: length-framed binary records with masked CRC-32C, gzipped, one example message in each.

A record is its length (8 bytes, little-endian), the checksum of these, its bytes, and their checksum.
Its bytes are a message of named features, each a list of whole numbers, of floats or of byte strings,
in the wire form of protocol buffers. Tasks write a file each and say which; a list of the files that
count is written behind them, so that what a lost task has left is never read. A gzip file can't be
cut, so that files are of a bounded number of records, and are dealt over tasks.
"""

from __future__ import annotations

import gzip
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The polynomial of CRC-32C, bits reversed, and what a masked checksum has been moved by.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Records of a file, and of a batch in a task, at most.
FILE_RECORDS, BATCH = 50_000, 500
_BYTES, _FLOATS, _WHOLE = 1, 2, 3


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), c >> np.uint32(1))
    return c


_TABLE = _crc_table()


#: Bytes of a block of a checksum.
_BLOCK = 512


def _behind_zeros(n: int) -> np.ndarray:
    """What ``n`` bytes of zero make of a checksum's state, for each value of each of its four bytes."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for _ in range(n):
        state = _TABLE[state & np.uint32(0xFF)] ^ (state >> np.uint32(8))
    return state.reshape(4, 256)


_STEP = _behind_zeros(_BLOCK)


def masked_crcs(parts: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of all ``parts``: their blocks byte by byte side by side, then put together block by block.

    A part's first block may be short: zeros before a state of zero leave it so. What the state begins
    with is carried through the lengths apart.
    """
    size = np.array([len(p) for p in parts], np.int64)
    blocks = -(-size // _BLOCK)
    ends = np.cumsum(blocks) * _BLOCK
    data = np.zeros(int(blocks.sum()) * _BLOCK, np.uint8)
    for p, n, end in zip(parts, size.tolist(), ends.tolist(), strict=True):
        data[end - n : end] = np.frombuffer(p, np.uint8)
    # a state of ones is the same as a state of zeros where the first four bytes are inverted
    for i in np.flatnonzero(size >= 4).tolist():
        data[ends[i] - size[i] : ends[i] - size[i] + 4] ^= 0xFF
    own = np.zeros(int(blocks.sum()), np.uint32)
    for column in np.ascontiguousarray(data.reshape(-1, _BLOCK).T):
        own = _TABLE[(own ^ column) & np.uint32(0xFF)] ^ (own >> np.uint32(8))
    by = np.argsort(-blocks, kind="stable")
    first = (np.cumsum(blocks) - blocks)[by]
    crc = np.zeros(len(parts), np.uint32)
    for i, n in enumerate(np.searchsorted(-blocks[by], -np.arange(int(blocks.max(initial=0))), side="left").tolist()):
        head = crc[:n]
        crc[:n] = own[first[:n] + i] ^ _STEP[0][head & 0xFF] ^ _STEP[1][head >> 8 & 0xFF] ^ _STEP[2][head >> 16 & 0xFF] ^ _STEP[3][head >> 24]
    out = np.empty(len(parts), np.uint32)
    out[by] = crc
    for i in np.flatnonzero(size < 4).tolist():
        state = 0xFFFFFFFF
        for x in parts[i]:
            state = int(_TABLE[(state ^ x) & 0xFF]) ^ state >> 8
        out[i] = state
    out ^= np.uint32(0xFFFFFFFF)
    return ((out >> np.uint32(15)) | (out << np.uint32(17))) + np.uint32(MASK)


_NUMBERS = _TABLE.tolist()


def _masked_crc(data: bytes) -> int:
    """Masked CRC-32C of a few bytes."""
    crc = 0xFFFFFFFF
    for x in data:
        crc = _NUMBERS[(crc ^ x) & 0xFF] ^ crc >> 8
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in groups of seven bits, one after another."""
    v = values.astype(np.int64).view(np.uint64)
    size = np.ones(len(v), np.int64)
    for i in range(1, 10):
        size += v >> np.uint64(7 * i) > 0
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for i in range(int(size.max(initial=0))):
        own = size > i
        out[at[own] + i] = (v[own] >> np.uint64(7 * i) & np.uint64(127)) | np.where(size[own] > i + 1, np.uint64(128), np.uint64(0))
    return out.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if len(raw) and (not len(ends) or ends[-1] != len(raw) - 1):
        raise ValueError("a number breaks off")
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    step = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * step).astype(np.uint64), starts).view(np.int64) if len(ends) else np.zeros(0, np.int64)


def _field(number: int, data: bytes) -> bytes:
    return bytes([number << 3 | 2]) + _varint(len(data)) + data


#: What stands before a value of fewer than 128 bytes.
_SHORT = [bytes([10, n]) for n in range(128)]


def _values(data: bytes) -> list[bytes]:
    """The values of a list of byte strings."""
    out, at, end = [], 0, len(data)
    while at + 1 < end and data[at] == 10 and data[at + 1] < 128:
        stop = at + 2 + data[at + 1]
        out.append(data[at + 2 : stop])
        at = stop
    if at > end:
        raise ValueError("a field breaks off")
    return out + [v for _, v in _fields(data[at:])]


def encode(example: dict[str, tuple[int, object]]) -> bytes:
    """The message of an example: features by name, each a kind and a list."""
    features = b""
    for name, (kind, values) in example.items():
        if kind == _WHOLE:
            own = _field(1, _packed(np.asarray(values, np.int64))) if len(values) else b""
        elif kind == _FLOATS:
            own = _field(1, np.asarray(values, "<f4").tobytes()) if len(values) else b""
        else:
            own = b"".join([_SHORT[len(v)] + v if len(v) < 128 else _field(1, v) for v in values])
        features += _field(1, _field(1, name.encode()) + _field(2, _field(kind, own)))
    return _field(1, features)


def _fields(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Numbers and contents of a message's fields; those that aren't length-delimited come as bytes of their own."""
    at = 0

    def whole() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = whole()
        if key & 7 == 2:
            n = whole()
            if at + n > len(data):
                raise ValueError("a field breaks off")
            yield key >> 3, data[at : at + n]
            at += n
        elif key & 7 == 0:
            yield key >> 3, _varint(whole())
        elif key & 7 in (1, 5):
            n = 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"no field of a message: {key}")


def decode(data: bytes) -> dict[str, list]:
    """Features by name, each a list."""
    out: dict[str, list] = {}
    for _, features in _fields(data):
        for _, entry in _fields(features):
            parts = dict(_fields(entry))
            for kind, own in _fields(parts.get(2, b"")):
                if kind == _WHOLE:
                    values = _unpacked(b"".join(v for _, v in _fields(own))).tolist()
                elif kind == _FLOATS:
                    values = np.frombuffer(b"".join(v for _, v in _fields(own)), "<f4").tolist()
                else:
                    values = _values(own)
                out[parts[1].decode()] = values
    return out


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def framed(messages: list[bytes]) -> bytes:
    sizes = [struct.pack("<Q", len(m)) for m in messages]
    return b"".join(x for s, a, m, b in zip(sizes, map(_masked_crc, sizes), messages, masked_crcs(messages), strict=True) for x in (s, struct.pack("<I", a), m, struct.pack("<I", b)))


def unframed(file, name: str) -> Iterator[list[bytes]]:
    """The records of an open file in lists; an error if one breaks off or doesn't have its checksums."""

    def read(n: int) -> bytes:
        data = file.read(n)
        if len(data) < n:
            raise ValueError(f"{name} breaks off")
        return data

    while True:
        sizes, sums, messages = [], [], []
        while len(messages) < BATCH and (head := file.read(8)):
            rest = read(12 - len(head))
            size, told = (head + rest)[:8], (head + rest)[8:]
            if struct.pack("<I", _masked_crc(size)) != told:
                raise ValueError(f"{name}: the length of a record is damaged")
            sizes.append(size)
            messages.append(read(struct.unpack("<Q", size)[0]))
            sums.append(struct.unpack("<I", read(4))[0])
        if not messages:
            return
        if (masked_crcs(messages) != np.array(sums, np.uint32)).any():
            raise ValueError(f"{name}: a record is damaged")
        yield messages


def _kind_of(t: str) -> int:
    kinds = {"bigint": _WHOLE, "int": _WHOLE, "smallint": _WHOLE, "tinyint": _WHOLE, "float": _FLOATS, "double": _FLOATS, "string": _BYTES, "binary": _BYTES}
    if (inner := t.removeprefix("array<").removesuffix(">")) not in kinds:
        raise ValueError(f"no feature holds {t}")
    return kinds[inner]


def write_records(rows: DataFrame, folder: str, *, file_records: int = FILE_RECORDS) -> DataFrame:
    """Write ``rows`` as record files under ``folder``; (path, records) of the files, which are also listed in ``folder``/files.

    A column is a feature: numbers, floats (in single precision), strings and bytes, or arrays of
    them; a single value is a list of one, null one of none. Nulls within arrays are an error.
    """
    kinds = {c: _kind_of(t) for c, t in rows.dtypes}
    single = {c: not t.startswith("array<") for c, t in rows.dtypes}

    def values(column: pa.Array, kind: int, one: bool) -> list:
        """Of each row its list, whose values come out of the column together."""
        if one:
            found = column.to_pylist()
            return [[] if x is None else [x.encode() if isinstance(x, str) else x] for x in found]
        flat = column.flatten()
        if flat.null_count:
            raise ValueError("no feature holds null")
        own = flat.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist() if kind == _BYTES else flat.to_numpy(zero_copy_only=False)
        ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)).tolist()
        return [own[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n = None, "", 0

        def done() -> pa.RecordBatch:
            out.close()
            raw.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            step = min(BATCH, file_records)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                if out is None:
                    path, n = f"{folder}/{uuid.uuid4().hex}.tfrecord.gz", 0
                    where, name = _open(path)
                    where.create_dir(name.rpartition("/")[0], recursive=True)
                    raw = where.open_output_stream(name, compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=6, mtime=0)
                lists = [values(part.column(c), kinds[c], single[c]) for c in kinds]
                out.write(framed([encode(dict(zip(kinds, zip(kinds.values(), row, strict=True), strict=True))) for row in zip(*lists, strict=True)]))
                n += part.num_rows
                if n >= file_records:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    listed = f"{folder}/files"
    rows.mapInArrow(run, "path string, records long").write.parquet(listed)
    return rows.sparkSession.read.schema("path string, records long").parquet(listed)


def read_records(spark: SparkSession, folder: str, features: str) -> DataFrame:
    """The records that ``write_records`` has left under ``folder``; ``features``: columns and types, as in a table's schema.

    An array takes a feature's whole list, another type its first value, null if there is none. What
    features don't name is passed over. A file with another number of records than was written, or a
    damaged one, is an error.
    """
    columns = spark.createDataFrame([], features).dtypes
    schema = spark.createDataFrame([], features).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    files = spark.read.schema("path string, records long").parquet(f"{folder}/files")
    kinds = {c: (_kind_of(t), not t.startswith("array<"), "string" in t) for c, t in columns}

    def value(c: str, values: list) -> object:
        kind, one, text = kinds[c]
        values = [v.decode() for v in values] if text else values
        return (values[0] if values else None) if one else values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                where, name = _open(path)
                n = 0
                with where.open_input_file(name) as raw, gzip.GzipFile(fileobj=raw) as file:
                    for messages in unframed(file, path):
                        n += len(messages)
                        found = [decode(m) for m in messages]
                        yield pa.RecordBatch.from_pylist([{c: value(c, f.get(c, [])) for c in kinds} for f in found], arrow)
                if n != records:
                    raise ValueError(f"{path} has {n} records, {records} were written")

    n = max(1, files.count())  # a row for each file
    return files.repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "path").mapInArrow(run, schema)
