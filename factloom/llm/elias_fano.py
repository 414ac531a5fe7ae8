"""Token ids in binary shards whose document boundaries are Elias-Fano coded.

A shard holds the ids of a range of documents in ascending doc_id order, then two Elias-Fano sequences: the ends of the
documents in ids, and the doc_ids themselves (as differences to the least one). Each value's low bits are packed, its
high bits stand in unary, and 32-bit counts of ones for every 512 bits let ``select`` jump to any value; there is no
table of 64-bit offsets. Shards do not overlap, so the ids before a shard are the sum of the shards before it.

Null texts hold the end id alone; null doc_ids come first and are counted in the footer; equal doc_ids keep one entry a
row, ordered by a digest of the text, and may spread over shards; an empty table writes shards without documents. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textbytes as tb
from .tokenids import encoder

_FOOT = "<8sIqqqqqqq"
_FOOT_BYTES = struct.calcsize(_FOOT)
_MAGIC = b"EFTOKEN1"
_BLOCK = 512


class EliasFano:
    """A monotone sequence of non-negative integers in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = np.zeros(n + (top >> low_bits) + 1, np.uint8)
        bits[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        bits = np.concatenate([bits, np.zeros(-len(bits) % _BLOCK, np.uint8)])
        ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, _BLOCK).sum(1, dtype=np.int64))]).astype(np.uint32)
        low = np.zeros(0, np.uint8)
        if low_bits:
            each = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(each.ravel(), bitorder="little")
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones)

    def to_bytes(self) -> bytes:
        head = struct.pack("<qiqqq", self.n, self.low_bits, len(self.low), len(self.high), len(self.ones))
        return head + self.low.tobytes() + self.high.tobytes() + self.ones.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack_from("<qiqqq", raw)
        at = struct.calcsize("<qiqqq")
        body = np.frombuffer(raw, np.uint8)
        return cls(n, low_bits, body[at : at + a], body[at + a : at + a + b], np.frombuffer(raw, "<u4", c, at + a + b))

    def select(self, first: int, last: int) -> np.ndarray:
        """Values first..last-1."""
        if last <= first:
            return np.zeros(0, np.int64)
        lo = int(np.searchsorted(self.ones, first, side="right")) - 1
        hi = int(np.searchsorted(self.ones, last - 1, side="right"))
        bits = np.unpackbits(self.high[lo * _BLOCK // 8 : hi * _BLOCK // 8], bitorder="little")
        place = np.flatnonzero(bits) + lo * _BLOCK
        skip = first - int(self.ones[lo])
        high = place[skip : skip + last - first] - np.arange(first, last)
        if not self.low_bits:
            return high
        a, b = first * self.low_bits, last * self.low_bits
        own = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a].reshape(-1, self.low_bits)
        return (high << self.low_bits) | (own.astype(np.int64) << np.arange(self.low_bits)).sum(1)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes a shard for each range of doc_ids; returns shard, path, n_docs, n_tokens of each, for one use only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        path, e = f"{folder}/shard-{shard:06d}.ids", encoder(tokenizer)
        width, state = np.dtype(e.type).itemsize, {"ends": [], "ids": [], "nulls": 0, "total": 0}

        def parts() -> Iterator[bytes]:
            for batch in batches:
                data, offsets = tb.text_column(batch.column(1))
                for i, j in tb.slices(offsets):
                    flat, n = e.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    ends = np.cumsum(n)
                    flat = np.insert(flat, ends, np.asarray(end_id, e.type)) if len(n) else flat
                    state["ends"].append(state["total"] + ends + np.arange(1, len(n) + 1))
                    state["total"] += len(flat)
                    yield flat.astype(flat.dtype.newbyteorder("<")).tobytes()
                state["nulls"] += batch.column(0).null_count
                state["ids"].append(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
            ids = np.concatenate([*state["ids"], np.zeros(0, np.int64)])
            least = int(ids[0]) if len(ids) else 0
            ends = EliasFano.of(np.concatenate([*state["ends"], np.zeros(0, np.int64)])).to_bytes()
            names = EliasFano.of(ids - least).to_bytes()
            state["docs"] = len(ids) + state["nulls"]
            yield ends
            yield names
            yield struct.pack(_FOOT, _MAGIC, width, state["docs"], state["total"], len(ends), len(names), least, state["nulls"], 0)

        store.write_file(path, parts())
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([path]), pa.array([state["docs"]]), pa.array([state["total"]])], names=["shard", "path", "n_docs", "n_tokens"])

    # rows that share an id, or have none, are split among ranges by a digest of their text and, where equal, by place
    tie = (F.xxhash64(docs[text]), F.monotonically_increasing_id())
    keyed = docs.select(docs[doc_id].cast("long").alias("d"), F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("b"), tie[0].alias("h"), tie[1].alias("at"))
    ranged = keyed.repartitionByRange("d", "h", "at").sortWithinPartitions("d", "h", "at").select("d", "b")
    return ranged.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long")


def read_shards(shards: DataFrame, block_docs: int = 4096) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files. ``shards`` has a row a file."""
    spark = shards.sparkSession
    rows = sorted(shards.collect())  # a row for each file, not for each document
    before, listed = 0, []
    for shard, path, _, n_tokens in rows:
        listed.append((shard, path, before))
        before += n_tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not listed:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = store.RangeReader()
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                size = files.size(path)
                magic, width, n_docs, total, a, b, least, nulls, _ = struct.unpack(_FOOT, files.read(path, size - _FOOT_BYTES, _FOOT_BYTES))
                if magic != _MAGIC:
                    raise ValueError(f"{path} is not a shard of token ids")
                ends = EliasFano.from_bytes(files.read(path, total * width, a))
                names = EliasFano.from_bytes(files.read(path, total * width + a, b))
                last = 0
                for i in range(0, n_docs, block_docs):
                    j = min(i + block_docs, n_docs)
                    stop = ends.select(i, j)
                    start = np.concatenate([[last], stop[:-1]])
                    crc = np.zeros(j - i, np.int64)
                    for k, m in tb.slices(np.concatenate([start, stop[-1:]]) * width, 8 << 20):
                        raw = np.frombuffer(files.read(path, int(start[k]) * width, int(stop[m - 1] - start[k]) * width), f"<u{width}").astype("<u4")
                        view = memoryview(raw).cast("B")
                        for d in range(k, m):
                            crc[d] = zlib.crc32(view[4 * int(start[d] - start[k]) : 4 * int(stop[d] - start[k])])
                    own = pa.array(np.concatenate([np.zeros(max(0, min(nulls, j) - i), np.int64), names.select(max(0, i - nulls), max(0, j - nulls)) + least]), mask=np.arange(i, j) < nulls)
                    yield pa.RecordBatch.from_arrays([own, pa.array(start + base), pa.array(stop - start), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    last = int(stop[-1])
        files.close()

    plan = spark.createDataFrame(listed, "shard long, path string, before long").repartitionByRange(len(listed), "shard")
    return plan.mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Writes the corpus and reads its documents back."""
    folder = folder or store.fresh(docs.sparkSession, "token-ids")
    return read_shards(store.materialize(write_shards(docs, folder, tokenizer, end_id), "token-shards"))
