"""Token counts of whole texts by sentencepiece, without keeping ids.

Texts go to the library in batches of bounded bytes. A long text is cut before single blanks that stand between
characters that are not blanks: no piece of a vocabulary whose pieces begin at blanks spans such a place, and the blank
itself is what the library puts before the next part. Null texts are empty and count 0. Repeated rows are counted like
any other row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

LONG_BYTES = 32_768
BATCH_BYTES = 1 << 20

_models: dict[str, object] = {}


def _model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def spans_blanks(path: str) -> bool:
    """Whether some piece holds a blank after another character, so that no cut would be safe."""
    model = _model(path)
    return any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))


def safe_parts(text: bytes, limit: int) -> list[bytes]:
    """The text cut at safe blanks into parts of about ``limit`` bytes; the blank at a cut is dropped."""
    parts, start = [], 0
    while len(text) - start > limit:
        at = start + limit
        while (at := text.find(b" ", at)) > 0 and (text[at - 1] == 0x20 or at + 1 >= len(text) or text[at + 1] == 0x20 or text[at - 3 : at] == b"\xe2\x96\x81" or text[at + 1 : at + 4] == b"\xe2\x96\x81"):
            at += 1
        if at < 0:
            break
        parts.append(text[start:at])
        start = at + 1
    return [*parts, text[start:]]


def count_batch(path: str, data: np.ndarray, offsets: np.ndarray, long_bytes: int = LONG_BYTES) -> np.ndarray:
    """Tokens of each text of a slice."""
    model, parts, owner = _model(path), [], []
    for k in range(len(offsets) - 1):
        own = safe_parts(data[offsets[k] : offsets[k + 1]].tobytes(), long_bytes)
        parts += own
        owner += [k] * len(own)
    sizes = [len(x) for x in model.encode([p.decode("utf-8", "replace") for p in parts], num_threads=1)]
    return np.bincount(np.array(owner, np.int64), weights=np.array(sizes, float), minlength=len(offsets) - 1).astype(np.int64)


def token_counts(docs: DataFrame, model_path: str, text: str = "text", limit: int = 4096, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with n_bytes, n_tokens and over_limit of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = not spans_blanks(model_path)
        for batch in batches:
            data, offsets = tb.text_column(batch.column(batch.num_columns - 1))
            counts = [count_batch(model_path, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], LONG_BYTES if whole else 1 << 62) for i, j in tb.slices(offsets, BATCH_BYTES)]
            tokens = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], names=[*(f"k{i}" for i in range(len(keep))), "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep)), _bytes(docs[text]).alias("b"))
    schema = ", ".join([*(f"k{i} {source.schema[i].dataType.simpleString()}" for i in range(len(keep))), "n_bytes long", "n_tokens long", "over_limit boolean"])
    return source.mapInArrow(run, schema).toDF(*keep, "n_bytes", "n_tokens", "over_limit")


def _bytes(column: Column) -> Column:
    return F.coalesce(column.cast("binary"), F.lit(b""))
