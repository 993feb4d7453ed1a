"""Media columns: content-addressed payloads in tar shards.

A payload is stored as a lossless grey PNG of eight-bit samples. Each task writes the media it meets into tar shards of its own, each content
once; rows carry digest, shard, offset and length. Where several tasks met one content, all rows point to
the same copy of it, the first by shard and offset. Metadata columns come from reads of the header's bytes alone; payloads are
read back by range, shard by shard in order of offset.

Shards lie in a folder that driver and executors share, in any store with an address that pyarrow's file systems know. A task that runs twice writes
another shard; only what its last run returned is referred to, as the rows are written before they are used.

Defined results: a NULL text is an empty one, which is one row of samples; equal texts share one medium; a very long text is one medium, written and read
whole; of several copies of a content the first by shard and offset counts; rows with NULL id keep their row; an empty
table gives an empty result and no shard. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import shared_dir, stored

# The PNG signature and the length of what precedes the samples.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = len(SIGNATURE) + 25
UNIT = 576
PAD = 255
REF = "digest string, shard string, offset long, length long"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, width: int = UNIT, level: int = 6) -> bytes:
    """A grey PNG, a row of samples for each ``width`` bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first bytes of a PNG."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, bits = struct.unpack(">IIB", data[16:25])
    return width, height, bits


def decode(data: bytes) -> bytes:
    width, height, _ = header(data)
    at, parts = len(SIGNATURE), []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filter that isn't written here")
    return lines[:, 1:].tobytes()


def padded(text: str | None) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return len(raw), raw + bytes([PAD]) * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


class Shards:
    """Writes media to tar shards of bounded size; a content it has just written is not written again."""

    def __init__(self, folder: str, size: int, memory: int = 500_000):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(folder)
        self.folder, self.size, self.memory = folder, size, memory
        self.seen: dict[bytes, tuple] = {}
        self.out = None

    def put(self, key: bytes, make) -> tuple:
        """(digest, shard, offset, length) of the medium of a content with hash ``key``."""
        if key in self.seen:
            return self.seen[key]
        data = make()
        if self.out is None:
            self.name, self.at = f"shard-{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}")
        digest = hashlib.sha256(data).hexdigest()
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + bytes(-len(data) % 512))
        ref = (digest, self.name, self.at + len(head), len(data))
        self.at += len(head) + len(data) + (-len(data) % 512)
        if len(self.seen) > self.memory:
            self.seen.clear()
        self.seen[key] = ref
        if self.at > self.size:
            self.close()
        return ref

    def close(self):
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def write_media(docs: DataFrame, folder: str, shard_bytes: int = 256_000_000) -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length) of each row of ``docs`` (doc_id, text); the media are in ``folder``."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        shards = Shards(folder, shard_bytes)
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n, payload = padded(t.as_py())
                rows.append((i, n, *shards.put(hashlib.blake2b(payload, digest_size=20).digest(), lambda: encode(payload))))  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds) if rows else pa.RecordBatch.from_pylist([], kinds)
        shards.close()

    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_bytes long, {REF}"))
    one = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("r")).select("digest", "r.*")
    return attached(rows.select("doc_id", "n_bytes", "digest"), one)


def attached(rows: DataFrame, info: DataFrame, most_hot: int = 10_000, hot_rows: int = 1_000) -> DataFrame:
    """``rows`` joined with ``info``, one row for each digest. What belongs to digests of very many rows is sent to all: such rows are not brought together.

    A digest is hot if it has more than ``hot_rows`` rows and more than one in ``most_hot``, so there are ``most_hot`` at most.
    """
    least = max(hot_rows, rows.count() // most_hot)
    hot = F.broadcast(stored(rows.groupBy("digest").agg(F.count("*").alias("n")).filter(F.col("n") > least).select("digest")))
    many = rows.join(F.broadcast(info.join(hot, "digest", "left_semi")), "digest")
    return many.unionByName(rows.join(hot, "digest", "left_anti").join(info.join(hot, "digest", "left_anti"), "digest"))


def _ranges(folder: str, call):
    """Runs ``call`` (open file, offset, length) over rows (digest, shard, offset, length) that stand by shard."""

    def run(batches):
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        name, file = None, None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["shard"] != name:
                    if file is not None:
                        file.close()
                    name, file = r["shard"], fs.open_input_file(f"{path}/{r['shard']}")
                rows.append({"digest": r["digest"]} | call(file, r["offset"], r["length"]))
            yield pa.RecordBatch.from_pylist(rows) if rows else b.slice(0, 0).select(["digest"])
        if file is not None:
            file.close()

    return run


def _in_order(refs: DataFrame) -> DataFrame:
    n = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A range of offsets, not a shard, is what a task reads, so one large shard is dealt over several.
    return refs.select("digest", "shard", "offset", "length").distinct().repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset")


def _metadata(file: io.IOBase, offset: int, length: int) -> dict:
    file.seek(offset)
    width, height, bits = header(file.read(min(HEADER, length)))
    return {"width": width, "height": height, "bits": bits}


def _features(file: io.IOBase, offset: int, length: int) -> dict:
    file.seek(offset)
    data = file.read(length)
    width, height, bits = header(data[:HEADER])
    payload = decode(data)
    a = np.frombuffer(payload, np.uint8)
    shares = np.bincount(a >> 5, minlength=8) * 1000 // len(a)
    feature = f"{width}x{height}x{bits};mean={int(a.sum(dtype=np.int64)) * 100 // len(a)};edges={int((a[1:] != a[:-1]).sum()) * 1000 // len(a)};levels={','.join(map(str, shares.tolist()))}"
    return {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature}


def metadata(refs: DataFrame, folder: str) -> DataFrame:
    """(digest, width, height, bits) of the media, from their headers' bytes alone."""
    return _in_order(refs).mapInArrow(_typed(_ranges(folder, _metadata), [("digest", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32())]), "digest string, width int, height int, bits int")


def features(refs: DataFrame, folder: str) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), from whole payloads read back."""
    kinds = [("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    return _in_order(refs).mapInArrow(_typed(_ranges(folder, _features), kinds), "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _typed(run, kinds):
    schema = pa.schema(kinds)

    def typed(batches):
        for b in run(batches):
            yield pa.RecordBatch.from_pylist(b.to_pylist(), schema)

    return typed


def media_folder(spark) -> str:
    return f"{shared_dir(spark)}/media"
