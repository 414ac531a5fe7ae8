"""A filter of fixed size that keeps most rows out of a shuffle.

Keys that need a join set bits of a bitmap, one megabyte at any size of the data. Rows whose bit is not set surely have no
match and skip the join; the rest are joined as usual. A full bitmap only costs the saving, never a row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

MARK_BITS = 1 << 23


def place(*columns: Column | str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(MARK_BITS))


def _words(places: DataFrame) -> DataFrame:
    """word and bits of the bitmap of the column ``at``: MARK_BITS / 64 rows at most."""
    return places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))


def bitmap(places: DataFrame) -> np.ndarray:
    """The bitmap of the column ``at``."""
    marks = np.zeros(MARK_BITS // 64, np.int64)
    for word, bits in _words(places).collect():
        marks[word] = bits
    return marks


def is_set(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (marks[at >> 6] >> (at & 63)) & 1 == 1


def marked(frame: DataFrame, keys: DataFrame, *columns: str, hit: str = "hit") -> DataFrame:
    """``frame`` with a boolean ``hit`` that holds for all rows that could match a key of the same columns.

    The bitmap's words are broadcast and looked up by a join, so a stage that reads texts starts no Python worker for it."""
    words = store.materialize(_words(keys.select(place(*columns).alias("at"))), "marks")
    words = F.broadcast(words.select(F.col("word").alias("mark_word"), F.col("bits").alias("mark_bits")))
    at = place(*(frame[c] for c in columns))
    bit = F.getbit("mark_bits", at.bitwiseAND(F.lit(63)).cast("int"))
    return frame.join(words, F.shiftright(at, 6) == F.col("mark_word"), "left").select(*(frame[c] for c in frame.columns), F.coalesce(bit == 1, F.lit(False)).alias(hit))
