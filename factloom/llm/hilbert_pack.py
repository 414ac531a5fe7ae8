"""Packing along a Hilbert curve: neighbouring documents share sequences.

Each document's ids are hashed into a small signed vector, which a fixed projection takes to a few dimensions; its place
on the Hilbert curve through these is the document's key. Documents are range-sorted by key, laid end to end in that
order, and the stream of ids is cut every ``length`` ids, so that only the last sequence of the corpus is padded.
Offsets come from a running sum inside every range and the ranges' totals (a number for each partition, not for each
document).

Null and empty texts are the end id alone. Equal keys are ordered by the row's place in the encoded table; repeated rows
are packed one after the other; null doc_ids are kept. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

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

BUCKETS, DIMENSIONS, BITS = 64, 4, 12


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (one row each) in [0, 2**bits)."""
    axes = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i, axis in enumerate(axes):
            upper = (axis >> level) & 1 == 1
            swap = np.where(upper, 0, (axes[0] ^ axis) & low)
            axes[0] = axes[0] ^ np.where(upper, low, swap)
            axes[i] = axes[i] ^ swap if i else axes[0]
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> level) & 1)
    return key


def _tables(vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = tb.seeds(vocabulary, 21)
    bucket = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    spread = np.where(tb.seeds(BUCKETS * DIMENSIONS, 22) >> np.uint64(63), 1.0, -1.0).reshape(BUCKETS, DIMENSIONS)
    return bucket, sign, spread


def document_keys(ids: np.ndarray, counts: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Hilbert key of each document from its ids (end to end)."""
    bucket, sign, spread = tables
    n = len(counts)
    cell = np.repeat(np.arange(n) * BUCKETS, counts) + bucket[ids]
    v = np.bincount(cell, weights=sign[ids], minlength=n * BUCKETS).reshape(n, BUCKETS)
    v = np.sign(v) * np.sqrt(np.abs(v))
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    x = (v / np.where(norm > 0, norm, 1)) @ spread
    unit = 1 / (1 + np.exp(-1.7 * x))
    return hilbert_key(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """A table of row, doc_id, key, n and the ids of every document, with its end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        tables = _tables(max(e.tokenizer.get_vocab_size(), end_id + 1))
        for batch in batches:
            data, offsets = tb.text_column(batch.column(1))
            for i, j in tb.slices(offsets):
                ids, n = e.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = np.insert(ids, np.cumsum(n), np.asarray(end_id, e.type))
                n = n + 1
                at = np.concatenate([[0], np.cumsum(n)]) * ids.itemsize
                blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(document_keys(ids, n, tables)), pa.array(n), blob], names=["doc_id", "key", "n", "ids"])

    source = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("b"))
    encoded = source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, key long, n long, ids binary")
    return store.materialize(encoded.select(F.monotonically_increasing_id().alias("row"), "*"), "packed-ids")


def stream_offsets(rows: DataFrame) -> DataFrame:
    """row and at (ids before it) of each row of (row, key, n), in the order of key and row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False)
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part)), pa.array(ends - n), batch.column(2)], names=["row", "part", "local", "n"])
            total = int(ends[-1]) if len(ends) else total

    ranged = rows.select("row", "key", "n").repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    local = store.materialize(ranged.mapInArrow(run, "row long, part long, local long, n long"), "stream-offsets")
    before, bases = 0, []
    for part, total in sorted(tuple(r) for r in local.groupBy("part").agg(F.sum("n")).collect()):  # a row for each partition
        bases.append((part, before))
        before += total
    base = rows.sparkSession.createDataFrame(bases, "part long, before long")
    return local.join(F.broadcast(base), "part").select("row", (F.col("before") + F.col("local")).alias("at"))


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            pieces = (at + n - 1) // length - at // length + 1
            of = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = at[of] // length + nth
            begin = np.maximum(sequence * length, at[of])
            stop = np.minimum((sequence + 1) * length, (at + n)[of])
            start = begin - at[of]
            blob, where = tb.text_column(batch.column(3))
            width = int((where[1] - where[0]) // n[0]) if len(n) else 2
            first = where[:-1][of] + start * width
            crc = np.zeros(len(of), np.int64)
            for k, (a, b) in enumerate(zip(first.tolist(), (first + (stop - begin) * width).tolist(), strict=True)):
                crc[k] = zlib.crc32(blob[a:b].view(f"<u{width}").astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *map(pa.array, (start, stop - begin, crc, n[of], sequence, begin - sequence * length))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    encoded = encode_documents(docs, tokenizer, end_id, doc_id, text)
    offsets = stream_offsets(encoded)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    laid = encoded.select("row", "doc_id", "n", "ids").join(offsets, "row").select("doc_id", "at", "n", "ids")
    return laid.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
