"""Media columns: content-addressed payloads in tar shards, with digest, shard, offset and length in the rows.

A text's UTF-8 bytes, filled with blanks to a positive multiple of 192, are the samples of an 8-bit grey image 192 wide,
stored losslessly as PNG under its payload's SHA-256. Tasks stream members into ustar shards of bounded size; a shard
appears under its name only when whole. Payloads that occur once are written where they are read; only those that may
occur again are moved, one of each task, and brought together by digest. Metadata columns come from range reads of a member's tar header and first PNG chunk;
features come from reading one member at a time.

Null texts are empty and become one blank line of samples. Equal texts share one stored member, also where they are a
third of all rows. An empty table writes no shards. Other columns are kept as ``keep`` names them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from . import textbytes as tb
from .marks import MARK_BITS, bitmap, is_set

WIDTH = 192
SHARD_BYTES = 256 << 20
HELD_BYTES = 8 << 20  # encoded payloads that may occur again and wait for the open shard to end
MET_DIGESTS = 100_000
READ_BYTES = 8 << 20  # members read by one task, about
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_column(text: Column) -> Column:
    """The text's bytes with blanks up to a positive multiple of the width."""
    raw = F.coalesce(text, F.lit(""))
    n = F.octet_length(raw)
    fill = F.when(n == 0, F.lit(WIDTH)).otherwise((WIDTH - n % WIDTH) % WIDTH)
    return F.concat(raw, F.repeat(F.lit(" "), fill.cast("int")))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """A grey PNG whose samples are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_png(stored: bytes) -> np.ndarray:
    """The samples of an unfiltered 8-bit grey PNG, a row each."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, width = 8, [], 0
    while at < len(stored):
        size, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)[:, 1:]


def tar_header(name: str, size: int) -> bytes:
    """A ustar header of a regular file, the same for the same name and size."""
    head = bytearray(512)
    for at, value in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        head[at : at + len(value)] = value
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


def repeated_marks(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which every key (column h) that occurs more than once has its bit set."""
    return bitmap(keys.groupBy("h").count().where("count > 1").select(F.pmod("h", F.lit(MARK_BITS)).alias("at")))


class _Shards:
    """Streams the members of one task into shards of bounded size and notes where they went."""

    def __init__(self, prefix: str, shard_bytes: int):
        self.prefix, self.shard_bytes, self.found, self.written = prefix, shard_bytes, [], 0

    def write(self, members: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        while member := next(members, None):
            uri = f"{self.prefix}-{self.written:04d}.tar"
            store.write_file(uri, self._shard(uri, member, members))
            self.written += 1
            yield index_batch(self.found)
            self.found.clear()

    def _shard(self, uri: str, member: tuple[str, bytes] | None, rest: Iterator[tuple[str, bytes]]) -> Iterator[bytes]:
        at = 0
        while member:
            name, media = member
            self.found.append((name, uri, at + 512, len(media), None))
            yield tar_header(f"{name}.png", len(media)) + media + bytes(-len(media) % 512)
            at += 512 + len(media) + -len(media) % 512
            member = next(rest, None) if at < self.shard_bytes else None
        yield bytes(1024)


def index_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["digest", "shard", "offset", "length", "media"])


def write_shards(payloads: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stores the column ``payload`` (binary); returns digest, shard, offset and length of every distinct one.

    Payloads that occur once are written by the task that reads them. Those that may occur again, by a bitmap of fixed
    size, are met once a task and brought together by digest before they are written."""
    keyed = payloads.select(F.xxhash64("payload").alias("h"), "payload")
    marks = repeated_marks(keyed.select("h"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[str] = set()
        shared: list[tuple] = []
        state = {"held": 0, "more": True}

        def payloads() -> Iterator[tuple[bytes, bool]]:
            for batch in batches:
                data, offsets = tb.text_column(batch.column(1))
                again = is_set(marks, batch.column(0).to_numpy(zero_copy_only=False) % MARK_BITS)
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    yield data[a:b].tobytes(), bool(again[k])

        def members() -> Iterator[tuple[str, bytes]]:
            """Members of the next shards; stops early, and the open shard ends, when enough is held that is not to be written here."""
            for payload, again in read:
                digest = hashlib.sha256(payload).hexdigest()
                if not again:
                    yield digest, encode_png(payload)
                elif digest not in met:
                    if len(met) >= MET_DIGESTS:
                        met.clear()
                    met.add(digest)
                    shared.append((digest, None, None, None, encode_png(payload)))
                    state["held"] += len(shared[-1][4])
                    if state["held"] >= HELD_BYTES:
                        return
            state["more"] = False

        read, shards = payloads(), _Shards(f"{folder}/own-{TaskContext.get().partitionId():06d}", shard_bytes)
        while state["more"]:
            yield from shards.write(members())
            for k in range(0, len(shared), 1000):
                yield index_batch(shared[k : k + 1000])
            shared.clear()
            state["held"] = 0

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[tuple[str, bytes]]:
            last = None
            for batch in batches:
                for digest, media in zip(batch.column(0), batch.column(1), strict=True):
                    if (name := digest.as_py()) != last:
                        last = name
                        yield name, media.as_py()

        yield from _Shards(f"{folder}/shared-{TaskContext.get().partitionId():06d}", shard_bytes).write(members())

    schema = "digest string, shard string, offset long, length long, media binary"
    first = store.materialize(keyed.mapInArrow(own, schema), "media-own")
    rest = first.where("shard is null").select("digest", "media").repartition("digest").sortWithinPartitions("digest").mapInArrow(gathered, schema)
    return first.where("shard is not null").drop("media").unionByName(rest.drop("media"))


def by_bytes(index: DataFrame) -> DataFrame:
    """The index dealt so that tasks read about equal bytes, neighbouring members together."""
    total = index.agg(F.sum(F.col("length") + 1024)).first()[0] or 0
    near = F.floor(F.col("offset") / (READ_BYTES // 64))
    return index.repartition(max(1, -(-total // READ_BYTES)), "shard", near).sortWithinPartitions("shard", "offset")


def read_headers(index: DataFrame) -> DataFrame:
    """The index with member, width, height and bit_depth, from the first bytes of each member alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = store.RangeReader()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for uri, offset in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                head = files.read(uri, offset - 512, 512 + 33)
                width, height, depth = struct.unpack_from(">IIB", head, 512 + 16)
                for to, value in zip(out, (head[:100].rstrip(b"\0").decode(), width, height, depth), strict=True):
                    to.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=[*batch.schema.names, "member", "width", "height", "bit_depth"])
        files.close()

    return index.mapInArrow(run, "digest string, shard string, offset long, length long, member string, width long, height long, bit_depth long")


def read_features(index: DataFrame) -> DataFrame:
    """digest, and of the member as read back: payload and media sizes and digests, and a feature of the samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = store.RangeReader()
        for batch in batches:
            rows = []
            for name, uri, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                stored = files.read(uri, offset, length)
                samples = decode_png(stored)
                payload = samples.tobytes()
                rows.append((name, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        files.close()

    return index.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def feature(samples: np.ndarray) -> str:
    """Mean and deviation of the samples, and a 64-bit hash of which of 64 equal parts are brighter than the mean."""
    flat = samples.ravel().astype(np.int64)
    bounds = np.arange(65) * len(flat) // 64
    upto = np.concatenate([[0], np.cumsum(flat)])
    mean = upto[-1] / len(flat)
    parts = (upto[bounds[1:]] - upto[bounds[:-1]]) / np.diff(bounds)
    bits = int("".join("1" if b else "0" for b in parts > mean), 2)
    return f"{mean:.3f} {float(np.sqrt(max(0.0, (flat * flat).mean() - mean * mean))):.3f} {bits:016x}"


def media_columns(docs: DataFrame, folder: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(rows of ``keep``, n_bytes and digest; index of the stored members). Members are joined to rows by digest."""
    folder = folder or store.fresh(docs.sparkSession, "media")
    payload = payload_column(docs[text])
    index = store.materialize(write_shards(docs.select(payload.cast("binary").alias("payload")), folder), "media-index")
    rows = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep)), F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    return rows.toDF(*keep, "n_bytes", "digest"), index


def media_table(docs: DataFrame, **options) -> DataFrame:
    """Every row with where its payload is stored, the metadata of the header and the features read back."""
    rows, index = media_columns(docs, **options)
    index = by_bytes(index)
    described = read_headers(index).join(read_features(index), "digest")
    return rows.join(described, "digest").drop("member")


