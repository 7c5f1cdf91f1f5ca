"""Media columns: payloads stored as images in archives, and a Spark data source that reads them by byte range.

Writing: each task streams its rows into one zip archive of stored members in the shared folder, an 8-bit grey PNG image
a row (192 samples wide, lossless).  Its name is new at each attempt; the paths and sizes of the archives of successful
tasks are committed as a manifest, a Parquet table, so a lost executor or a second attempt leaves no row twice.  What a
failed attempt has left behind is deleted by itself, or, if its executor is gone, when the manifest is there.

Reading: `archive_media` plans partitions as byte ranges from the manifest (or from a folder's listing), without opening
an archive; tasks get their range and nothing else.  A task reads its archive's directory, takes the members that begin
in its range and streams them in Arrow batches of bounded bytes.  A member that can't be read, or whose checksum is
wrong, is read again on its own by its offset from a newly opened file, after a wait that doubles; after that it fails
the task, or with `onerror` = null becomes a row with a null payload and the error.

Defined cases: null text is empty; an empty text is one row of blanks; repeated rows are members of their own; null
doc_id stays; an empty table writes nothing and gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tactus.llm.common import new_path, written

WIDTH, BLANK, TAIL = 192, 32, 16
#: Bytes of an archive a partition, bytes of a batch, attempts at a member, and seconds before the second.
SPLIT, BATCH, ATTEMPTS, WAIT = 32 << 20, 8 << 20, 3, 0.2
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "archive string, offset long, doc_id long, n_bytes long, media binary, error string"


def payload(text: bytes) -> bytes:
    """Blanks up to a positive multiple of WIDTH."""
    return text.ljust(max(WIDTH, -(-len(text) // WIDTH) * WIDTH), bytes([BLANK]))


def to_png(samples: bytes) -> bytes:
    rows = np.zeros((len(samples) // WIDTH, WIDTH + 1), dtype=np.uint8)  # column 0: no filter
    rows[:, 1:] = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    chunks = (b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(rows.tobytes(), 1)), (b"IEND", b"")
    return SIGNATURE + b"".join(struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data)) for kind, data in chunks)


def from_png(media: bytes) -> bytes:
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, width, height, packed = 8, 0, 0, []
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"wrong checksum in {kind!r}")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", data)
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only images without filters are read")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean and entropy of the samples, and 64 bits that say where the mean of one of 72 parts rises to the next."""
    x = np.frombuffer(samples, dtype=np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    cuts = np.arange(72) * len(x) // 72
    means = np.add.reduceat(x.astype(np.int64), cuts) / np.diff(np.append(cuts, len(x)))
    grid = means.reshape(8, 9)
    bits = int("".join("1" if b else "0" for b in (grid[:, 1:] > grid[:, :-1]).ravel()), 2)
    return f"mean={x.mean():.4f};entropy={-(p * np.log2(p)).sum():.4f};rise={bits:016x}"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as executors need it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    return "file:///" + full[6:].lstrip("/") if full.startswith("file:/") else full


def write_archives(docs: DataFrame) -> DataFrame:
    """The manifest of the archives of the texts of docs: (path, size), a row a task that had rows."""
    spark = docs.sparkSession
    folder = qualified(spark, new_path(spark, "media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.zip"
        archive, stream, seen = None, None, 0
        try:
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if archive is None:
                        stream = store.open_output_stream(f"{root}/{name}")
                        archive = zipfile.ZipFile(_Appended(stream), "w", zipfile.ZIP_STORED)
                    raw = text.as_py() or b""
                    member = zipfile.ZipInfo(f"{seen}_{'' if doc_id is None else doc_id}_{len(raw)}.png")
                    archive.writestr(member, to_png(payload(raw)))
                    seen += 1
            if archive is not None:
                archive.close()
                size = stream.tell()
                stream.close()
        except BaseException:
            if stream is not None:
                stream.close()
                store.delete_file(f"{root}/{name}")
            raise
        if archive is not None:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], names=["path", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    manifest = written(rows.mapInArrow(run, "path string, size long"), "media-manifest")
    store, root = _open(folder)
    there = [x.path for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True))]
    if len(there) != manifest.count():  # an executor was lost, or a second attempt ran
        kept = {r["path"].rpartition("/")[2] for r in manifest.toLocalIterator()}
        for p in there:
            if p.rpartition("/")[2] not in kept:
                store.delete_file(p)
    return manifest


class _Appended:
    """A stream that can only be appended to, as zipfile takes it."""

    def __init__(self, stream: pa.NativeFile):
        self.stream = stream

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest, self.folder = options.get("manifest"), options.get("path")
        self.split, self.batch = int(options.get("split", SPLIT)), int(options.get("batch", BATCH))
        self.attempts, self.fail = int(options.get("attempts", ATTEMPTS)), options.get("onerror", "fail") != "null"

    def partitions(self) -> list[Range]:
        found = []
        if self.manifest:
            store, root = _open(self.manifest)
            table = pads.dataset(root, filesystem=store, format="parquet", schema=pa.schema([("path", pa.string()), ("size", pa.int64())])).to_table()
            files = sorted(zip(table["path"].to_pylist(), table["size"].to_pylist(), strict=True))
        else:
            store, root = _open(self.folder)
            prefix = self.folder[: len(self.folder) - len(root)] if self.folder.endswith(root) else ""
            files = [(f"{prefix}{x.path}", x.size) for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.path.endswith(".zip")]
        for path, size in files:
            found += [Range(path, a, min(a + self.split, size)) for a in range(0, size, self.split)]
        return found or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, local = _open(part.path)
        with store.open_input_file(local) as f, zipfile.ZipFile(f) as z:
            members = [(m.header_offset, m.compress_size, m.CRC, m.filename, m.compress_type) for m in z.infolist() if part.start <= m.header_offset < part.stop]
            rows, held = [], 0
            for offset, size, crc, name, kind in members:
                media, error = self.member(store, local, f, offset, size, crc if kind == zipfile.ZIP_STORED else None)
                if error and self.fail:
                    raise OSError(f"{part.path} at {offset}: {error}")
                _, doc_id, n_bytes = name.rsplit(".", 1)[0].split("_")
                rows.append((part.path, offset, int(doc_id) if doc_id else None, int(n_bytes), media, error))
                held += size
                if held >= self.batch:
                    yield _members(rows)
                    rows, held = [], 0
            if rows:
                yield _members(rows)

    def member(self, store: fs.FileSystem, local: str, f: pa.NativeFile, offset: int, size: int, crc: int | None) -> tuple[bytes | None, str | None]:
        """A member's bytes by its offset; on an error again from a file of its own."""
        error = None
        for attempt in range(self.attempts):
            try:
                if attempt:
                    time.sleep(WAIT * 2 ** (attempt - 1))
                    with store.open_input_file(local) as again:
                        return read_member(again, offset, size, crc), None
                return read_member(f, offset, size, crc), None
            except (OSError, ValueError, struct.error) as e:
                error = str(e) or type(e).__name__
        return None, error


def read_member(f: pa.NativeFile, offset: int, size: int, crc: int | None) -> bytes:
    head = f.read_at(30, offset)
    mark, *_, names, extra = struct.unpack("<4s5H3I2H", head)
    if mark != b"PK\x03\x04":
        raise ValueError("no member begins here")
    data = f.read_at(size, offset + 30 + names + extra)
    if len(data) != size or crc is None or zlib.crc32(data) != crc:
        raise ValueError("member is short, compressed or damaged")
    return data


def _members(rows: list[tuple]) -> pa.RecordBatch:
    a, o, d, n, m, e = zip(*rows, strict=True)
    arrays = [pa.array(a, pa.string()), pa.array(o, pa.int64()), pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.binary()), pa.array(e, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["archive", "offset", "doc_id", "n_bytes", "media", "error"])


class ArchiveMedia(DataSource):
    """spark.read.format("archive_media").option("manifest", a folder of Parquet).load() or .load(folder of archives)."""

    @classmethod
    def name(cls) -> str:
        return "archive_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:  # noqa: ANN001
        return ArchiveReader(self.options)


def read_archives(manifest: DataFrame, **options: str) -> DataFrame:
    """The members of the archives of a manifest that write_archives() has made."""
    spark = manifest.sparkSession
    spark.dataSource.register(ArchiveMedia)
    folders = {x.rpartition("/")[0] for x in manifest.inputFiles()}
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    reader = spark.read.format("archive_media").option("manifest", qualified(spark, folders.pop()))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(members: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, n_bytes, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                media = cell.as_py()
                samples = from_png(media)
                out.append((doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            names = [x.split()[0] for x in FEATURES.split(", ")]
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in FEATURES.split(", ")]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return members.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def op6(docs: DataFrame) -> DataFrame:
    return features(read_archives(write_archives(docs)))
