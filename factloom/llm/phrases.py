"""Phrase collocations: shards mined at lowered support, candidates united and counted exactly, then scored.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and into words at blanks and tabs; everything is per
lang (null: ``und``). Documents are dealt into ``shards``, each spread over tasks. A phrase of ``support`` occurrences
reaches, in some shard, the support times that shard's share of all words (else its occurrences would not add up), so the
phrases that are frequent in a shard hold every frequent one. Shards are mined level by level: pairs of frequent words, then
triples of frequent pairs, by 62-bit hashes that are summed in tasks before they are shuffled. The united phrases go to all
tasks as a bitmap of fixed size; phrases that only share a bit with one, or only a hash, are counted too and fall out by
their exact count. The last pass counts all candidates over the whole corpus by their words; in tasks by 128 bits of hash.

Scores are computed with decimals of 38 digits, exact below 10^16 occurrences. Null texts hold no words; repeated rows
count again; an empty table gives no rows; only lang, text and (to deal shards) doc_id are read. Long texts are cut behind
the ends of pieces, which no phrase reaches over; sums of a task are sent on whenever they pass ``HELD`` keys or
``HELD_BYTES`` of words, and Spark sums a task's keys before they are shuffled. So work space does not follow the corpus, only
an Arrow batch, which holds whole texts, and the longest piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store, textbytes
from .textbytes import U64, mix64

SUPPORT, SHARDS, TOP, COVER_PERCENT = 10, 3, 2000, 50
MARK_BITS = 1 << 24
HELD, HELD_BYTES = 1 << 17, 1 << 23
#: Arrow batches that go into Python: bytes.
BATCH = "2m"
#: A lang's best rows are found among those of this many parts first.
PARTS = 16
#: Bytes that end pieces, and bytes between words.
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"

_kind = np.zeros(256, np.uint8)
_kind[list(BREAKS)], _kind[list(GAPS)] = 2, 1
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_A, _B, _LANG = (U64(int(x) | 1) for x in textbytes.seeds(3, 13))


class Words:
    """The words of a batch's slice: where they stand, their hashes with the lang's, and whether the next stands in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, shard: np.ndarray) -> None:
        low, high = offsets[0], offsets[-1]
        self.data = _lower[data[low:high]]
        at = offsets - low
        kind = _kind[self.data]
        word = kind == 0
        before = np.empty_like(word)
        before[1:], before[:1] = word[:-1], False
        first = at[:-1][at[:-1] < at[1:]]
        before[first] = False
        after = np.empty_like(word)
        after[:-1], after[-1:] = word[1:], False
        after[first[1:] - 1] = False
        self.start, self.end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        row = np.searchsorted(at, self.start, side="right") - 1
        piece = np.cumsum(kind == 2)[self.start] if len(self.start) else self.start
        self.lang, self.shard = lang[row], shard[row].astype(U64)
        self.joined = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        self.hash = textbytes.span_hashes(self.data, self.start, self.end)

    def second(self) -> np.ndarray:
        """Another hash of each word: of its bytes turned round the table, by the same sums."""
        return textbytes.span_hashes((self.data.astype(np.uint16) * 167 + 13).astype(np.uint8), self.start, self.end)

    def starts(self, words: int) -> np.ndarray:
        """Where phrases of so many words start."""
        if words == 1:
            return np.arange(len(self.start))
        return np.flatnonzero(self.joined if words == 2 else self.joined[:-1] & self.joined[1:])

    def keys(self, at: np.ndarray, words: int, hashes: np.ndarray | None = None) -> np.ndarray:
        """64-bit keys of the phrases, with their lang."""
        h = self.hash if hashes is None else hashes
        with np.errstate(over="ignore"):
            key = self.lang[at] * _LANG + h[at]
            for k in range(1, words):
                key = mix64(key * _A) + h[at + k] * _B
        return mix64(key)

    def texts(self, at: np.ndarray, words: int) -> pa.Array:
        """The phrases, words joined by a blank."""
        body = np.concatenate([self.data, np.frombuffer(b" ", np.uint8)])
        begin = np.full((len(at), 2 * words - 1), len(self.data), np.int64)
        size = np.ones_like(begin)
        for k in range(words):
            begin[:, 2 * k], size[:, 2 * k] = self.start[at + k], self.end[at + k] - self.start[at + k]
        ends = np.concatenate([[0], np.cumsum(size.sum(axis=1))]).astype(np.int64)
        chars = body[textbytes.ragged(begin.ravel(), size.ravel())]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(chars)))


def _cut(data: np.ndarray, offsets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of parts, the row of each): texts over ``limit`` bytes are cut behind ends of pieces, a longer piece stands alone."""
    cuts = []
    for row in np.flatnonzero(np.diff(offsets) > limit):
        at, end = int(offsets[row]), int(offsets[row + 1])
        ends = np.flatnonzero(_kind[data[at:end]] == 2) + at + 1
        while end - at > limit and len(ends) and at < ends[-1]:
            k = int(np.searchsorted(ends, at + limit, side="right")) - 1
            if k < 0 or ends[k] <= at:
                k += 1
            at = int(ends[k])
            cuts.append(at)
    if not cuts:
        return offsets, np.arange(len(offsets) - 1)
    parts = np.sort(np.concatenate([offsets, cuts]))
    return parts, np.minimum(np.searchsorted(offsets[1:], parts[:-1], side="right"), len(offsets) - 2)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Words of bounded parts of the batches (lang, shard, text)."""
    for batch in batches:
        data, offsets = textbytes.text_column(batch.column(2))
        shard = batch.column(1).to_numpy(zero_copy_only=False)
        codes = batch.column(0).dictionary_encode()
        names = codes.dictionary.to_pylist()
        hashes = np.array([int.from_bytes(_blake(x), "little") for x in names], U64) if names else np.zeros(0, U64)
        own = hashes[codes.indices.to_numpy(zero_copy_only=False)] if len(batch) else hashes
        parts, rows = _cut(data, offsets, textbytes.SHORT_SLICE)
        for i, j in textbytes.slices(parts, textbytes.SHORT_SLICE):
            words = Words(data, parts[i : j + 1], own[rows[i:j]], shard[rows[i:j]])
            words.names = dict(zip(hashes.tolist(), names, strict=True))
            yield words


def _blake(name: str) -> bytes:
    return hashlib.blake2b(name.encode(), digest_size=8).digest()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their sums, for each a place where it stands)."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[head], np.add.reduceat(counts[order], head) if len(s) else counts, order[head]


def _inputs(docs: DataFrame, shards: int, doc_id: str, lang: str, text: str) -> DataFrame:
    shard = F.pmod(F.xxhash64(docs[doc_id]), F.lit(shards)).cast("int")
    return docs.select(F.coalesce(docs[lang], F.lit("und")).alias("lang"), shard.alias("shard"), docs[text].alias("text"))


def _mined(inputs: DataFrame, words: int, may: Callable[[Words, np.ndarray], np.ndarray]) -> DataFrame:
    """(code, n) of the phrases of so many words that ``may`` be frequent; a code is 62 bits of key and 2 of shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            held.clear()
            keys, counts, _ = _summed(keys, counts)
            for i in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 18)].view(np.int64)), pa.array(counts[i : i + (1 << 18)])], names=["code", "n"])

        for w in _slices(batches):
            at = w.starts(words)
            at = at[may(w, at)]
            keys, counts, _ = _summed((w.keys(at, words) & ~U64(3)) | w.shard[at], np.ones(len(at), np.int64))
            held.append((keys, counts))
            size += len(keys)
            if size > HELD:
                yield from flush()
                size = 0
        if held:
            yield from flush()
        textbytes.release()

    return inputs.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _counted(inputs: DataFrame, sizes: tuple[int, ...], may: Callable[[Words, np.ndarray, int], np.ndarray]) -> DataFrame:
    """(lang, words, phrase, n) of the phrases that ``may`` count, summed over the corpus by their words."""
    schema = "lang string, words int, phrase string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = chars = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, second, counts = (np.concatenate([x[k] for x in held]) for k in range(3))
            names = pa.concat_arrays([x[3] for x in held])
            number = np.concatenate([x[4] for x in held])
            phrases = pa.concat_arrays([x[5] for x in held])
            held.clear()
            for found in _exact(keys, second):
                distinct, sums, place = _summed(keys[found], counts[found])
                take = found[place]
                for i in range(0, len(take), 1 << 17):
                    own = pa.array(take[i : i + (1 << 17)])
                    yield pa.RecordBatch.from_arrays([names.take(own).cast(pa.string()), pa.array(number[take[i : i + (1 << 17)]]), phrases.take(own).cast(pa.string()), pa.array(sums[i : i + (1 << 17)])], names=["lang", "words", "phrase", "n"])

        for w in _slices(batches):
            other = w.second()
            listed = list(w.names)
            for words in sizes:
                at = w.starts(words)
                at = at[may(w, at, words)]
                key, two = w.keys(at, words), w.keys(at, words, other)
                for found in _exact(key, two):
                    keys, counts, place = _summed(key[found], np.ones(len(found), np.int64))
                    own = at[found[place]]
                    name = pa.array([w.names[x] for x in listed], pa.large_string()).take(pa.array(_index(np.array(listed, U64), w.lang[own])))
                    held.append((keys, two[found[place]], counts, name, np.full(len(own), words, np.int32), w.texts(own, words)))
                    size += len(own)
                    chars += held[-1][5].nbytes
            if size > HELD or chars > HELD_BYTES:
                yield from flush()
                size = chars = 0
        if held:
            yield from flush()
        textbytes.release()

    return inputs.mapInArrow(run, schema).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def _index(listed: np.ndarray, values: np.ndarray) -> np.ndarray:
    order = np.argsort(listed)
    return order[np.searchsorted(listed[order], values)] if len(listed) else np.zeros(0, np.int64)


def _exact(key: np.ndarray, second: np.ndarray) -> Iterator[np.ndarray]:
    """Places in groups in which equal first keys have equal second keys: all at once unless first keys collide."""
    rest = np.arange(len(key))
    while len(rest):
        distinct, place, back = np.unique(key[rest], return_index=True, return_inverse=True)
        same = second[rest] == second[rest][place][back]
        yield rest[same]
        rest = rest[~same]


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the column ``key``, in MARK_BITS / 64 words at any size of the data."""
    at = keys.select(F.col("key").bitwiseAND(F.lit(MARK_BITS - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    marks = np.zeros(MARK_BITS // 64, np.int64)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return marks


def _is_set(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bits of 62-bit keys are set."""
    at = (keys >> U64(2)).astype(np.int64) & (64 * len(marks) - 1)
    return (marks[at >> 6] >> (at & 63)) & 1 == 1


def _word_keys(words: DataFrame) -> DataFrame:
    """The keys that tasks give to the words of (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, phrase = batch.column(0).to_pylist(), batch.column(1)
            data, offsets = textbytes.text_column(phrase)
            low = offsets[0]
            hashes = textbytes.span_hashes(data[low : offsets[-1]], offsets[:-1] - low, offsets[1:] - low)
            own = {x: int.from_bytes(_blake(x), "little") for x in set(lang)}
            with np.errstate(over="ignore"):
                key = mix64(np.array([own[x] for x in lang], U64) * _LANG + hashes)
            yield pa.RecordBatch.from_arrays([pa.array((key >> U64(2)).astype(np.int64))], names=["key"])

    return words.select("lang", "phrase").mapInArrow(run, "key long")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, n) of all phrases of 1 to 3 words with n >= support, (lang, n) with the number of all words)."""
    if not 1 <= shards <= 4:
        raise ValueError("shards is 1 to 4: their support is a whole number of occurrences")
    with store.batches(docs.sparkSession, BATCH):
        return _frequent(_inputs(docs, shards, doc_id, lang, text), support, shards)


def _frequent(inputs: DataFrame, support: int, shards: int) -> tuple[DataFrame, DataFrame]:
    spark = inputs.sparkSession
    sizes = store.materialize(_counted(inputs, (1,), lambda w, at, words: np.ones(len(at), bool)), "words")
    totals = sizes.groupBy("lang").agg(F.sum("n").alias("n"))
    words = sizes.where(F.col("n") >= support)
    share = dict(_shard_sizes(inputs).collect())  # a row a shard
    whole = sum(share.values())
    floors = F.create_map(*(F.lit(x) for k in range(shards) for x in (k, -(-support * share.get(k, 0) // max(1, whole))))) if whole else F.create_map(F.lit(0), F.lit(support))

    def sent(keys: DataFrame):
        return spark.sparkContext.broadcast(bitmap(keys))

    def locally(mined: DataFrame) -> DataFrame:
        shard = F.col("code").bitwiseAND(F.lit(3)).cast("int")
        return mined.where(F.col("n") >= F.element_at(floors, shard)).select(F.shiftrightunsigned("code", 2).alias("key"))

    known = sent(_word_keys(words))

    def pair_may(w: Words, at: np.ndarray) -> np.ndarray:
        fine = _is_set(known.value, w.keys(np.arange(len(w.start)), 1))
        return fine[at] & fine[at + 1]

    pairs = sent(locally(_mined(inputs, 2, pair_may)))

    def is_pair(w: Words) -> np.ndarray:
        """For each word, whether it and the next are a candidate."""
        fine = np.zeros(len(w.start), bool)
        at = w.starts(2)
        fine[at] = _is_set(pairs.value, w.keys(at, 2))
        return fine

    def triple_may(w: Words, at: np.ndarray) -> np.ndarray:
        fine = is_pair(w)
        return fine[at] & fine[at + 1]

    triples = sent(locally(_mined(inputs, 3, triple_may)))

    def may(w: Words, at: np.ndarray, words: int) -> np.ndarray:
        return _is_set((pairs if words == 2 else triples).value, w.keys(at, words))

    candidates = _counted(inputs, (2, 3), may).where(F.col("n") >= support)
    return store.materialize(words.unionByName(candidates), "phrases"), totals


def _shard_sizes(inputs: DataFrame) -> DataFrame:
    """(shard, bytes of text): what shares are taken of; any shares that add up to one serve."""
    return inputs.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("n"))


def scored(phrases: DataFrame, cover_percent: int = COVER_PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of several words that no longer one covers."""
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("count"))
    many = phrases.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cut = many.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    cut = cut.join(counts.withColumnsRenamed({"lang": "lang_l", "part": "part_l", "count": "l"}), (F.col("lang") == F.col("lang_l")) & (F.col("left") == F.col("part_l")))
    cut = cut.join(counts.withColumnsRenamed({"lang": "lang_r", "part": "part_r", "count": "r"}), (F.col("lang") == F.col("lang_r")) & (F.col("right") == F.col("part_r")))
    score = F.expr("(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * cast(1000000 as decimal(38,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = many.where("words = 3").select("lang", F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " "))).alias("inner"), "a")
    covers = inner.groupBy("lang", "inner").agg(F.max("a").alias("longest")).withColumnRenamed("lang", "lang_c")
    free = best.join(covers, (F.col("lang") == F.col("lang_c")) & (F.col("phrase") == F.col("inner")), "left").where(F.coalesce(100 * F.col("longest") < cover_percent * F.col("a"), F.lit(True)))
    return free.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, **options) -> DataFrame:
    """Each lang's best phrases: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent_phrases(docs, support, **options)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    found = scored(phrases).withColumn("part", part)
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
