"""Media columns over archives of 8-bit image members (operator 2).

`write_archives` stores each text's bytes (padded with 0 to a positive multiple of 64) as the samples of a greyscale PNG image of 64
columns and 8 bits, losslessly compressed, many to an archive file. An archive ends with its directory (member id, offset, size), the directory's place and its sum. Files get names of
their own in each task attempt; a table of the names that committed, one folder a writing task, says which count, so a retried task leaves no second copy.

`ArchiveSource` is a Spark data source over such a folder: it plans partitions of about `range_bytes` bytes of what one task wrote, from two numbers
(how many tasks, and the most bytes of one), not from a list of archives; a range looks its archives up. It reads the
members that begin in its range, one at a time by offset, and yields Arrow batches. A member that fails is tried again alone.

Null texts count as empty; equal rows are members of their own with equal values; other columns are not read; an empty table gives no
members.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trialgrid.llm.common import lean, new_path

BLOCK = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_ENTRY = np.dtype([("member", "<i8"), ("offset", "<u8"), ("size", "<u8"), ("n_bytes", "<u8"), ("doc_id", "<i8"), ("known", "<u1")])
_TAIL = "<QQI4s"
SCHEMA = "member long, doc_id long, n_bytes long, media binary"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(payload: bytes) -> bytes:
    """A greyscale image of BLOCK columns, 8 bits a sample, rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    lines = np.zeros((len(rows), BLOCK + 1), np.uint8)  # each line begins with its filter's number
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", BLOCK, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def chunks(media: bytes) -> dict[bytes, bytes]:
    """The parts of a PNG member by kind, each checked by its own sum; ValueError where it isn't whole. Nothing is decompressed."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG member")
    at, parts = 8, {}
    while at < len(media):
        if at + 12 > len(media):
            raise ValueError("a cut PNG member")
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if media[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError("a damaged PNG member")
        parts[kind] = data
        at += 12 + size
    if b"IEND" not in parts:
        raise ValueError("a cut PNG member")
    return parts


def samples(media: bytes) -> bytes:
    """The samples of an image that `png` wrote; ValueError where it isn't whole."""
    parts = chunks(media)
    width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    try:
        lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8)
    except zlib.error as e:
        raise ValueError("a damaged PNG member") from e
    if (depth, colour) != (8, 0) or len(lines) != height * (width + 1) or lines[:: width + 1].any():
        raise ValueError("not an unfiltered greyscale image of 8 bits")
    return lines.reshape(height, width + 1)[:, 1:].tobytes()


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def _archive_writer(folder: str, archive_bytes: int):
    def run(batches):
        files, base = _file_system(folder)
        stream, entries, name, at, done = None, [], "", 0, []

        def close():
            directory = np.array(entries, _ENTRY).tobytes()
            stream.write(directory + struct.pack(_TAIL, at, len(entries), zlib.crc32(directory), b"TARC"))
            stream.close()
            done.append((name, at, len(entries)))

        for batch in batches:
            for member, doc, text in zip(*(batch.column(c).to_pylist() for c in ("member", "doc_id", "text")), strict=True):
                raw = (text or "").encode()
                media = png(raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK)))
                if stream is None:
                    name, at, entries = f"{uuid.uuid4().hex}.arc", 0, []
                    stream = files.open_output_stream(f"{base}/{name}")
                stream.write(media)
                entries.append((member, at, len(media), len(raw), doc or 0, doc is not None))
                at += len(media)
                if at >= archive_bytes:
                    close()
                    stream = None
        if stream is not None:
            close()
        if done:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(done), pa.int32()), *(pa.array(c) for c in zip(*done, strict=True))], names=["part", "archive", "bytes", "members"])

    return run


def write_archives(docs: DataFrame, archive_bytes: int = 128 << 20) -> str:
    """Write `docs` (doc_id, text) as archives into the shared folder; the path of the folder."""
    path = new_path(docs.sparkSession, "archives")
    files, base = _file_system(path)
    files.create_dir(base, recursive=True)
    rows = docs.select(F.monotonically_increasing_id().alias("member"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.mapInArrow(lean(_archive_writer(path, archive_bytes)), "part int, archive string, bytes long, members long").write.partitionBy("part").parquet(f"{path}/committed")
    return path


class ByteRange(InputPartition):
    """Bytes from low to high of the archives that one task wrote, one after another."""

    def __init__(self, part: int, low: int, high: int):
        super().__init__((part, low, high))
        self.part, self.low, self.high = part, low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.step, self.tries = int(options.get("range_bytes", 16 << 20)), int(options.get("tries", 4))
        self.parts, self.most = int(options["parts"]), int(options["most_bytes"])

    def partitions(self):
        return [ByteRange(part, low, low + self.step) for part in range(self.parts) for low in range(0, self.most, self.step)] or [ByteRange(-1, 0, 0)]

    def archives(self, part: int) -> list[tuple[str, int]]:
        """Names and sizes of the archives of one task, in one order."""
        from pyarrow import dataset, fs

        files, base = _file_system(f"{self.folder}/committed/part={part}")
        found = [f.path for f in files.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.endswith(".parquet")]
        if not found:  # it wrote nothing
            return []
        table = dataset.dataset(found, filesystem=files, format="parquet").to_table(columns=["archive", "bytes"])
        return sorted(zip(table.column("archive").to_pylist(), table.column("bytes").to_pylist(), strict=True))

    def _again(self, action):
        for left in range(self.tries - 1, -1, -1):
            try:
                return action()
            except (OSError, ValueError, struct.error):  # the last: cut short
                if not left:
                    raise
                time.sleep(0.2)

    def read(self, partition: ByteRange):
        start = 0
        for name, size in self._again(lambda: self.archives(partition.part)) if partition.part >= 0 else []:
            if start < partition.high and start + size > partition.low:
                yield from self._members(f"{self.folder}/{name}", partition.low - start, partition.high - start)
            start += size

    def _members(self, path: str, low: int, high: int):
        """Batches of the archive's members that begin from low to high."""
        files, base = _file_system(path)
        held_open: list = []

        def at(offset: int, size: int) -> bytes:
            """The file stays open between members; after a failure it is opened anew."""
            try:
                if not held_open:
                    held_open.append(files.open_input_file(base))
                return held_open[0].read_at(size, offset)
            except OSError:
                for f in held_open:
                    f.close()
                held_open.clear()
                raise

        def listed():
            start, count, total, magic = struct.unpack(_TAIL, at(size - struct.calcsize(_TAIL), struct.calcsize(_TAIL)))
            raw = at(start, count * _ENTRY.itemsize) if start + count * _ENTRY.itemsize + struct.calcsize(_TAIL) == size else b""
            if magic != b"TARC" or zlib.crc32(raw) != total:
                raise ValueError(f"{path} has no whole directory")
            return np.frombuffer(raw, _ENTRY)

        size = files.get_file_info(base).size
        directory = self._again(listed)
        own = directory[(directory["offset"].astype(np.int64) >= low) & (directory["offset"].astype(np.int64) < high)]
        rows, held = [], 0
        for e in own:
            def member(e=e):
                media = at(int(e["offset"]), int(e["size"]))
                chunks(media)
                return media

            media = self._again(member)
            rows.append((int(e["member"]), int(e["doc_id"]) if e["known"] else None, int(e["n_bytes"]), media))
            held += len(media)
            if held > 4 << 20 or len(rows) == 2000:
                yield _members(rows)
                rows, held = [], 0
        if rows:
            yield _members(rows)
        for f in held_open:
            f.close()


def _members(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["member", "doc_id", "n_bytes", "media"])


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trialgrid_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_archives(spark: SparkSession, path: str, range_bytes: int = 16 << 20, tries: int = 4) -> DataFrame:
    """Members of the archives that committed. The driver learns how many tasks wrote and the most bytes of one; a member that isn't whole after `tries` readings is an error."""
    spark.dataSource.register(ArchiveSource)
    written = spark.read.schema("archive string, bytes long, part int").parquet(f"{path}/committed").groupBy("part").agg(F.sum("bytes").alias("bytes"))
    parts, most = written.agg(F.max("part") + 1, F.max("bytes")).first()
    options = {"parts": str(parts or 0), "most_bytes": str(most or 0), "range_bytes": str(range_bytes), "tries": str(tries)}
    return spark.read.format("trialgrid_archive").options(**options).load(path)


def feature(payload: bytes) -> str:
    """Mean, deviation and share of crossings of the middle line, of samples as numbers around 0."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    return f"{x.mean(dtype=np.float64):.4f}|{x.std(dtype=np.float64):.4f}|{crossings}"


def _featured(batches):
    for batch in batches:
        out = []
        for media in batch.column("media").to_pylist():
            payload = samples(media)
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_features(members: DataFrame) -> DataFrame:
    return members.mapInArrow(lean(_featured), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
