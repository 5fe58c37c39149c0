"""Content-addressed media payloads in tar shards.

A payload is stored once, under its digest, as a grayscale PNG (8-bit samples, 64 to a
row) in a tar shard of the shared folder; table rows carry digest, shard, offset and
length. Metadata columns come from range reads of the PNG header alone; features need
the stored samples and read them back.

Each task writes the shards of its own input split and stores a digest once, so a group
of copies is stored at most once per split and no payload is shuffled: only index rows
are, and of several places the index keeps one. Shards are named by the task's attempt;
the index names only those of attempts that succeeded, so that retries and lost executors leave nothing wrong behind. Shards
are written and read with pyarrow's file systems, found by the folder's URI.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atrisk.llm.common import new_path, small_batches, written

WIDTH = 64
BLOCK = 512
#: Bytes after which a task begins another shard.
SHARD_BYTES = 256 << 20
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
INDEX = "digest string, shard string, offset long, length long"


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + b"\0" * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with its filter, none
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits per sample from a PNG's first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode_png(media: bytes) -> bytes:
    width, height, _ = read_header(media[:HEADER])
    at, data = 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """A 16-bin histogram of the samples (shares of 255, in hex), their mean and the sign
    pattern of 64 equal segments against that mean."""
    x = np.frombuffer(payload, np.uint8)
    shares = np.bincount(x >> 4, minlength=16) * 255 // len(x)
    mean = x.mean()
    segments = np.add.reduceat(x, np.arange(64) * len(x) // 64, dtype=np.int64) / np.diff(np.arange(65) * len(x) // 64)
    return f"{shares.astype(np.uint8).tobytes().hex()}-{mean:.3f}-{np.packbits(segments > mean).tobytes().hex()}"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def store(docs: DataFrame) -> DataFrame:
    """Stores the payload of every distinct text; returns the index (digest, shard, offset,
    length), one row per payload: of the tasks that hold a copy, the first shard's."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_path(spark, "media")

    def shard(batches):
        task = TaskContext.get()
        fs, base = _filesystem(folder)
        fs.create_dir(base)
        out, count, pos = None, 0, 0
        seen: set[bytes] = set()
        try:
            for batch in batches:
                rows = []
                for text in batch.column(0).to_pylist():
                    payload = payload_of(text or "")
                    sha = hashlib.sha256(payload)
                    if sha.digest() in seen:
                        continue
                    seen.add(sha.digest())
                    digest, media = sha.hexdigest(), encode_png(payload)
                    if out is None:
                        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}-{count:04d}.tar"
                        out, count, pos = fs.open_output_stream(f"{base}/{name}"), count + 1, 0
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(media)
                    out.write(info.tobuf(tarfile.USTAR_FORMAT))
                    out.write(media + b"\0" * (-len(media) % BLOCK))
                    rows.append((digest, f"{folder}/{name}", pos + BLOCK, len(media)))
                    pos += BLOCK + -(-len(media) // BLOCK) * BLOCK
                    if pos >= SHARD_BYTES:
                        out.write(b"\0" * 2 * BLOCK)
                        out.close()
                        out = None
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["digest", "shard", "offset", "length"])
        finally:
            if out is not None:
                out.write(b"\0" * 2 * BLOCK)
                out.close()

    places = docs.select("text").mapInArrow(shard, INDEX).groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return written(places.select("digest", "at.*"), "media-index")


class _Shards:
    """Open shards of one task, the last few."""

    def __init__(self):
        self.open: dict[str, object] = {}

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard not in self.open:
            while len(self.open) >= 8:
                self.open.pop(next(iter(self.open))).close()
            fs, path = _filesystem(shard)
            self.open[shard] = fs.open_input_file(path)
        return self.open[shard].read_at(length, offset)


def headers(index: DataFrame) -> DataFrame:
    """Adds ``width, height, bits`` to an index by range reads of the headers only."""

    def run(batches):
        shards = _Shards()
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("shard", "offset", "length")}
            got = [read_header(shards.read(s, o, min(HEADER, n))) for s, o, n in zip(*cols.values(), strict=True)]
            columns = list(zip(*got, strict=True)) if got else [[]] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int32()) for c in columns)], names=[*batch.schema.names, "width", "height", "bits"])

    return index.mapInArrow(run, T.StructType(list(index.schema.fields)).add("width", "integer").add("height", "integer").add("bits", "integer"))


def read_back(index: DataFrame) -> DataFrame:
    """Adds what needs the stored samples; a payload that differs from its digest fails."""

    def run(batches):
        shards = _Shards()
        for batch in batches:
            rows = []
            for digest, s, o, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                media = shards.read(s, o, n)
                payload = decode_png(media)
                sha = hashlib.sha256(payload).hexdigest()
                if sha != digest:
                    raise ValueError(f"{s} at {o}: stored payload differs from its digest")
                rows.append((sha, zlib.crc32(payload[-64:]), hashlib.sha256(media).hexdigest(), feature_of(payload)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True))], names=[*batch.schema.names, "payload_sha256", "tail_crc32", "media_sha256", "feature"])

    schema = T.StructType(list(index.schema.fields)).add("payload_sha256", "string").add("tail_crc32", "long").add("media_sha256", "string").add("feature", "string")
    return index.mapInArrow(run, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per document: its payload's digest and place, header metadata, features.

    A null text is empty (one row of 64 zero bytes). Texts that differ only in trailing
    zero bytes may share a payload; n_bytes tells them apart. A null doc_id stays null,
    repeated rows repeat, columns besides doc_id and text are ignored.
    """
    stored = read_back(headers(store(docs)))
    raw = F.coalesce("text", F.lit("")).cast("binary")
    n = F.length(raw)
    padded = F.greatest(F.lit(WIDTH), F.ceil(n / WIDTH).cast("int") * WIDTH)
    zeros = F.substring(F.lit(bytes(WIDTH)), F.lit(1), padded - n)
    rows = docs.select("doc_id", n.cast("long").alias("n_bytes"), padded.cast("long").alias("payload_bytes"), F.sha2(F.concat(raw, zeros), 256).alias("digest"))
    return rows.join(stored, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "shard", "offset", "width", "height", "bits")
