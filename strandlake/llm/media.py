"""Media columns: content-addressed payloads in tar shards, rows that carry digest, offset and length.

A text's UTF-8 bytes, filled up with byte 255 (which UTF-8 never has) to a positive multiple of ``WIDTH``, are stored as an
8-bit grey PNG image of that width. Each task appends its images to tar shards in the shared folder, named by the digest of
the image. Equal texts are stored once overall: texts that occur once are written where they lie; of each that occurs more
often, one row's is, after a shuffle of those alone with partial aggregation, and the others take its place in the catalogue.
The catalogue has, for each row, the digest, the shard, and the offset and length of the image within it; it is
materialised, so that the shards it names are complete whatever becomes of the tasks that wrote them. A repeated task
writes shards of new names, and none of the old ones is referred to.

``with_header`` fills the metadata columns from reads of each image's first 33 bytes. ``features`` reads whole images.

Shards are opened through pyarrow's file systems by the shared folder's URI (local or mounted, or any store that pyarrow
knows). Cases: a null or empty text is one row of filling. Rows are independent: null or repeated doc_ids stay as they
are. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import cut, shared_path

WIDTH, FILL = 576, b"\xff"
SIGNATURE, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33
#: A shard is closed once it has so many bytes.
SHARD_BYTES = 256 << 20
CATALOGUE = "doc_id long, digest string, shard string, offset long, length long"
#: Of up to so many texts that occur more than once, the digests, then the places (some 250 bytes each) are sent to all
#: executors; more are joined by a shuffle.
SENT_DIGESTS = 200_000
TYPES = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}


def batch_of(ddl: str, columns: list) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    return pa.record_batch([pa.array(c, TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def filled(text: bytes) -> bytes:
    return text + FILL * (-len(text) % WIDTH or (0 if text else WIDTH))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image, one unfiltered line for each WIDTH bytes."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from an image's first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIBB", head[16:26])


def from_png(image: bytes) -> bytes:
    """The samples of an unfiltered 8-bit grey image."""
    width, height, depth, colour = png_header(image[:HEADER_BYTES])
    at, packed = 8, []
    while at < len(image):
        (size,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        data = image[at + 8 : at + 8 + size]
        if struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("not an unfiltered 8-bit grey image")
    return lines[:, 1:].tobytes()


class Shard:
    """A tar archive that is being written."""

    def __init__(self, where: str):
        from pyarrow.fs import FileSystem

        self.fs, folder = FileSystem.from_uri(where)
        self.fs.create_dir(folder, recursive=True)
        self.path = f"{where}/{uuid.uuid4().hex}.tar"
        self.out = self.fs.open_output_stream(f"{folder}/{self.path.rpartition('/')[2]}")
        self.size, self.known = 0, {}

    def put(self, digest: str, data: bytes) -> int:
        """The offset of the data in the archive."""
        if digest not in self.known:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.known[digest] = self.size + len(head)
            filling = b"\0" * (-len(data) % tarfile.BLOCKSIZE)
            self.out.write(head + data + filling)
            self.size += len(head) + len(data) + len(filling)
        return self.known[digest]

    def close(self) -> None:
        self.out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
        self.out.close()


class Ranges:
    """Range reads from shards; the last few stay open."""

    def __init__(self, keep: int = 8):
        self.files, self.keep = {}, keep

    def read(self, shard: str, offset: int, length: int) -> bytes:
        from pyarrow.fs import FileSystem

        if shard not in self.files:
            if len(self.files) >= self.keep:
                self.files.pop(next(iter(self.files))).close()
            fs, path = FileSystem.from_uri(shard)
            self.files[shard] = fs.open_input_file(path)
        return self.files[shard].read_at(length, offset)


def written(rows: DataFrame, where: str) -> DataFrame:
    """The catalogue of ``rows`` (doc_id, payload, key) and the keys, materialised; every row's image is stored."""
    ddl = f"{CATALOGUE}, key binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            out: list = [batch.column(0).to_pylist(), [], [], [], [], batch.column(2).to_pylist()]
            for text in batch.column(1):
                image = to_png(filled(text.as_py()))
                digest = hashlib.sha256(image).hexdigest()
                shard = shard or Shard(where)
                for column, value in zip(out[1:5], (digest, shard.path, shard.put(digest, image), len(image)), strict=True):
                    column.append(value)
                if shard.size >= SHARD_BYTES:
                    shard.close()
                    shard = None
            yield batch_of(ddl, out)
        if shard:
            shard.close()

    return cut(rows.select("doc_id", "payload", "key").mapInArrow(run, ddl))


def store(docs: DataFrame) -> DataFrame:
    """The catalogue of the rows' payloads, materialised: doc_id, digest, shard, offset, length."""
    where = shared_path(docs.sparkSession, "shards")
    payload = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long"), payload.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    repeated = cut(rows.groupBy("key").count().where("count > 1").select("key"))
    small = F.broadcast if repeated.count() <= SENT_DIGESTS else lambda df: df
    of_repeated = rows.join(small(repeated), "key", "left_semi")
    once = rows.join(small(repeated), "key", "left_anti")
    one_of_each = of_repeated.groupBy("key").agg(F.first("payload").alias("payload")).select(F.lit(None).cast("long").alias("doc_id"), "payload", "key")
    places = written(one_of_each, where).drop("doc_id")
    shared = of_repeated.select("doc_id", "key").join(small(places), "key")
    columns = [f.split()[0] for f in CATALOGUE.split(", ")]
    return written(once, where).select(columns).unionAll(shared.select(columns))


def with_header(catalogue: DataFrame) -> DataFrame:
    """The catalogue with width, height, depth and colour, from each image's first bytes alone."""
    ddl = f"{CATALOGUE}, width long, height long, depth int, colour int"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in rows:
            heads = [png_header(ranges.read(shard, offset, HEADER_BYTES)) for shard, offset in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch_of(ddl, [*(batch.column(i).to_pylist() for i in range(5)), *([h[k] for h in heads] for k in range(4))])

    return catalogue.mapInArrow(run, ddl)


def feature(payload: bytes, width: int, height: int) -> str:
    """Size, mean and spread of the samples, mean step between neighbours in a line, and the share of each eighth of the range."""
    x = np.frombuffer(payload, dtype=np.uint8)
    steps = np.abs(np.diff(x.reshape(height, width).astype(np.int16), axis=1)).mean()
    shares = np.bincount(x >> 5, minlength=8) / len(x)
    return f"{width}x{height} mean={x.mean():.4f} std={x.std():.4f} step={steps:.4f} shares=" + ",".join(f"{s:.4f}" for s in shares)


def features(catalogue: DataFrame) -> DataFrame:
    """Digests and features of each row's payload, read back from its shard; catalogue: ``with_header``'s."""
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in rows:
            out: list = []
            for row in batch.to_pylist():
                image = ranges.read(row["shard"], row["offset"], row["length"])
                digest = hashlib.sha256(image).hexdigest()
                if digest != row["digest"]:
                    raise ValueError(f"{row['shard']} has other bytes than {row['digest']}")
                payload = from_png(image)
                text = payload.rstrip(FILL)
                out.append((row["doc_id"], len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), digest, feature(payload, row["width"], row["height"])))
            yield batch_of(ddl, list(zip(*out, strict=True)) or [[]] * 8)

    return catalogue.mapInArrow(run, ddl)
