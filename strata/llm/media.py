"""Media columns: documents as 8-bit images in archives, read back by a data source over byte ranges of archives."""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import new_path, remove_path, small_batches, stage, table

#: Samples in a row of an image; payloads are padded to whole rows, one at least.
WIDTH = 64
#: Bytes after which a writer begins another archive, and bytes of an archive that one task reads.
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 32 << 20
#: Ranges that the driver plans at most; with more bytes than so many ranges hold, ranges are larger.
RANGES = 1 << 17
#: Payload bytes in an Arrow batch, but for a single larger member.
BATCH_BYTES = 4 << 20
#: Tries for each member before its row carries an error.
TRIES = 3

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(raw: bytes) -> bytes:
    """``raw`` with bytes 0 up to a positive multiple of WIDTH."""
    return raw + bytes(WIDTH * max(1, -(-len(raw) // WIDTH)) - len(raw))


def encode_image(raw: bytes) -> bytes:
    """A grey PNG of 8-bit samples, WIDTH wide, that holds pad(raw); its text chunk holds the unpadded length."""
    samples = np.frombuffer(pad(raw), np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = samples
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(rows, 3)) + _chunk(b"IEND", b"")


def decode_image(image: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of an image made by encode_image; raises ValueError on any damage."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, length, head, data = 8, -1, b"", []
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if len(body) != n or image[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("damaged chunk")
        at += 12 + n
        if kind == b"IHDR":
            head = body
        elif kind == b"tEXt":
            length = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            data.append(body)
    if head[8:] != b"\x08\0\0\0\0":
        raise ValueError("not 8-bit grey")
    width, height = struct.unpack(">II", head[:8])
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes(), length


def features(payload: bytes) -> str:
    """Rows, mean, deviation and entropy (bits) of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    values, some = np.arange(256), share[share > 0]
    mean = float(share @ values)
    return f"{len(samples) // WIDTH};{mean:.4f};{float(share @ (values - mean) ** 2) ** 0.5:.4f};{float(-(some * np.log2(some)).sum()):.4f}"


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Writer:
    """One archive of stored members, in a file that no other attempt uses."""

    def __init__(self, store: pafs.FileSystem, folder: str):
        self.name = f"{uuid.uuid4().hex}.zip"
        self.file = store.open_output_stream(f"{folder}/{self.name}")
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED)
        self.bytes = self.members = 0

    def add(self, member: str, media: bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(f"{self.members}/{member}"), media)
        self.members += 1
        self.bytes += len(media)

    def close(self) -> dict:
        self.zip.close()
        self.file.close()
        return {"archive": self.name, "members": self.members}


def write_archives(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write each text (null: empty) as an image into archives in ``folder``; returns the staged list of archives.

    Each task writes its own archives under names of its own; the list holds only those of attempts that ended
    well, so a lost executor leaves at most a file that no list names. A null key is kept as a null. Repeated rows are members
    of their own, texts of any length are one member each, and no rows give an empty list.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        out, done = None, []
        for batch in batches:
            for k, raw in zip(batch.column(0), batch.column(1), strict=True):
                out = out or _Writer(store, path)
                out.add("null" if (k := k.as_py()) is None else str(k), encode_image(raw.as_py() or b""))
                if out.bytes >= ARCHIVE_BYTES:
                    done.append(out.close())
                    out = None
        if out:
            done.append(out.close())
        yield pa.RecordBatch.from_pylist(done, pa.schema([("archive", pa.string()), ("members", pa.int64())]))

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("raw"))
    with small_batches(spark):
        rows.mapInArrow(write, "archive string, members long").write.parquet(f"{folder}/_list")
    return spark.read.schema("archive string, members long").parquet(f"{folder}/_list")


class _Range(InputPartition):
    """Members of an archive whose headers begin from ``start`` up to ``stop``."""

    def __init__(self, archive: str, start: int, stop: int):
        super().__init__((archive, start, stop))
        self.archive, self.start, self.stop = archive, start, stop


def read_member(file, info: zipfile.ZipInfo) -> bytes:
    """The stored bytes of a member, by its offset; raises on a short read or a wrong checksum."""
    file.seek(info.header_offset)
    head = file.read(30)
    if len(head) != 30 or head[:4] != b"PK\3\4":
        raise ValueError("no member here")
    name, extra = struct.unpack_from("<HH", head, 26)
    file.read(name + extra)
    data = file.read(info.compress_size)
    if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
        raise ValueError("damaged member")
    return data


def read_directory(opened) -> list[zipfile.ZipInfo]:
    """The members that an archive lists; ``opened()`` gives its file, for each of TRIES tries anew. The last failure is raised."""
    for attempt in range(TRIES):
        try:
            with opened() as file, zipfile.ZipFile(file) as z:
                return z.infolist()
        except (OSError, zipfile.BadZipFile, pa.ArrowException):
            if attempt + 1 == TRIES:
                raise
            time.sleep(0.05 * (attempt + 1))
    return []


class ArchiveReader(DataSourceReader):
    """Plans ranges from the sizes of the listed archives; each task reads its archive's directory for itself."""

    SCHEMA = pa.schema([("doc_id", pa.int64()), ("archive", pa.string()), ("member_offset", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())])

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[_Range]:
        """A row of the list for each archive reaches the driver, and at most about RANGES ranges leave it."""
        store, path = _store(self.folder)
        import pyarrow.parquet as pq

        listed = [f for f in store.get_file_info(pafs.FileSelector(f"{path}/_list")) if f.path.endswith(".parquet")]
        names = sorted({a for f in listed for a in pq.read_table(store.open_input_file(f.path), columns=["archive"]).column(0).to_pylist()})
        sizes = [f.size for f in store.get_file_info([f"{path}/{n}" for n in names])]
        step = max(self.range_bytes, -(-sum(sizes) // RANGES))
        return [_Range(n, at, at + step) for n, size in zip(names, sizes, strict=True) for at in range(0, size, step)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, path = _store(self.folder)
        where = f"{path}/{partition.archive}"
        mine = [i for i in read_directory(lambda: store.open_input_file(where)) if partition.start <= i.header_offset < partition.stop]
        rows: list[dict] = []
        held, file = 0, None
        for info in sorted(mine, key=lambda i: i.header_offset):
            row = {"doc_id": None if (k := info.filename.partition("/")[2]) == "null" else int(k), "archive": partition.archive, "member_offset": info.header_offset}
            for attempt in range(TRIES):
                try:
                    file = file or io.BufferedReader(store.open_input_file(where), 1 << 20)
                    media = read_member(file, info)
                    payload, n = decode_image(media)
                    row |= {"n_bytes": n, "payload": payload, "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": features(payload), "error": None}
                    break
                except (OSError, ValueError, zlib.error, pa.ArrowException) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                    file = None  # another try opens the archive anew
                    time.sleep(0.05 * attempt)
            rows.append(row)
            held += len(row.get("payload") or b"")
            if held >= BATCH_BYTES or len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, self.SCHEMA)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.SCHEMA)


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: a row for each member of the archives listed there.

    A member that fails TRIES times gives a row with its offset and an error, and null for what was not read;
    other members are not touched by it. Option rangebytes: bytes of an archive for each task.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, archive string, member_offset long, n_bytes long, payload binary, media_bytes long, media_sha256 string, feature string, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All members; the job fails if one could not be read, so that none is lost in silence."""
    spark.dataSource.register(ArchiveSource)
    rows = spark.read.format("media_archive").load(folder)
    sound = F.when(F.col("error").isNull(), F.col("payload")).otherwise(F.raise_error(F.concat_ws(" ", "archive", "member_offset", "error")))
    return rows.withColumn("payload", sound).drop("error")


def media_columns(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id and what its image holds after it was stored and read back.

    Any null or empty text gives a payload of WIDTH zeros, equal texts give equal values, repeated rows give
    repeated rows, no rows give none; a text of any length is one member. Extra columns are not stored. The archives
    are removed when what was read from them has been written.
    """
    folder = new_path(docs.sparkSession, "media")
    write_archives(docs, folder)
    rows = read_archives(docs.sparkSession, folder)
    tail = F.crc32(F.substring("payload", -64, 64))
    read = rows.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
    found = stage(read, "media-columns")
    remove_path(docs.sparkSession, folder)
    return found


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an image in an archive, read back."""
    return media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))
