"""Fill-in-the-middle over texts that are kept as seekable compressed frames.

``write_frames`` stores each text as independent zstandard frames of ``FRAME_UNITS`` code points in shard files and returns an
index: for every frame its place in the shard and the units up to its end. Where a text is cut follows from its id and its
number of units alone, so ``arrange`` reads the index and no text. An arranged text is then a list of whole frames, parts of
the frames that hold a cut, and control strings; ``Arranged`` reads it frame by frame, from any unit on. Digests of it, and
of the text that is rebuilt from it and its form, stream through one frame at a time.

A task writes shards under names of its own and its index rows name them, so a task that runs again, or twice at once,
leaves unused files but never rows that point into another attempt's file. Null texts are empty; a null id draws like an
empty one; repeated rows are stored again; an empty table gives an empty index; a text that holds a control string, or is
empty, stays as it is. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, textbytes

FRAME_UNITS = 1 << 16
SHARD_BYTES = 1 << 28
LEVEL = 6
#: Bytes that a task of ``by_bytes`` reads on large inputs, and at least.
READ_BYTES, LEAST_BYTES = 128 << 20, 1 << 20
PREFIX, SUFFIX, MIDDLE = CONTROLS = ("<P>", "<S>", "<M>")
INDEX = "doc_id {id}, n_units long, has_control boolean, n_bytes long, shard string, first long, frames array<struct<length:int,upto:long>>"


class _Shard:
    """Appends frames to files that roll over between texts; every attempt of a task has names of its own."""

    def __init__(self, folder: str) -> None:
        self.folder, self.file, self.uri, self.size = folder, None, None, 0

    def place(self) -> tuple[str, int]:
        if self.file is None or self.size >= SHARD_BYTES:
            self.close()
            self.uri, self.size = f"{self.folder}/{uuid.uuid4().hex}.zst", 0
            self.file = store.open_output(self.uri)
        return self.uri, self.size

    def append(self, frame: bytes) -> None:
        self.file.write(frame)
        self.size += len(frame)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.file = None


def write_frames(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all texts: doc_id, n_units, has_control, n_bytes, shard, first (offset) and frames (length, units up to its end)."""
    folder = folder or store.fresh(docs.sparkSession, "frames")
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("length", pa.int32()), ("upto", pa.int64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, packer = _Shard(folder), zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for value in batch.column(1):
                whole = value.as_py() or ""
                (uri, first), frames = shard.place(), []
                for at in range(0, len(whole), FRAME_UNITS):
                    part = whole[at : at + FRAME_UNITS]
                    frame = packer.compress(part.encode())
                    shard.append(frame)
                    frames.append({"length": len(frame), "upto": at + len(part)})
                for to, x in zip(out, (len(whole), any(c in whole for c in CONTROLS), sum(f["length"] for f in frames), uri, first, frames), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], names=["doc_id", "n_units", "has_control", "n_bytes", "shard", "first", "frames"])
        shard.close()
        textbytes.release()

    return store.materialize(rows.mapInArrow(run, INDEX.format(id=rows.schema["doc_id"].dataType.simpleString())), "frame-index")


def draws(doc_id: Column) -> list[Column]:
    """Four numbers of 32 bits from the digest of an id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def arrange(index: DataFrame, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """The index with form (plain, psm or spm), cut_1 and cut_2, the units at which prefix and middle end."""
    h1, h2, h3, h4 = draws(F.col("doc_id"))
    n = F.col("n_units") + 1
    plain = (F.col("n_units") == 0) | F.col("has_control") | (h3 % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    return index.withColumns({"form": form, "cut_1": F.least(h1 % n, h2 % n), "cut_2": F.greatest(h1 % n, h2 % n)})


def by_bytes(index: DataFrame) -> DataFrame:
    """The index dealt so that tasks read about equal bytes, neighbouring texts together."""
    spark, total = index.sparkSession, index.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(-(-total // READ_BYTES), min(4 * spark.sparkContext.defaultParallelism, -(-total // LEAST_BYTES)), 1)
    near = F.floor(F.col("first") / max(1, total // (16 * tasks)))
    return index.repartition(tasks, "shard", near).sortWithinPartitions("shard", "first")


class Frames:
    """Reads frames of shards; the last two that were read are kept, as neighbouring parts share the frame of a cut."""

    def __init__(self) -> None:
        self.files, self.kept, self.unpack = store.RangeReader(), {}, zstandard.ZstdDecompressor()

    def text(self, shard: str, offset: int, length: int) -> str:
        key = (shard, offset)
        if key not in self.kept:
            if len(self.kept) > 1:
                del self.kept[next(iter(self.kept))]
            self.kept[key] = self.unpack.decompress(self.files.read(shard, offset, length)).decode()
        return self.kept[key]

    def close(self) -> None:
        self.files.close()


class Arranged:
    """An arranged text: parts in order, each a control string or units ``low`` to ``high`` of a frame."""

    def __init__(self, frames: Frames, shard: str, first: int, lengths: list[int], upto: list[int], form: str, cut_1: int, cut_2: int) -> None:
        self.frames, self.shard, self.parts, self.size = frames, shard, [], 0
        n, starts = upto[-1] if upto else 0, [0, *upto][:-1]
        offsets = [first]
        for x in lengths:
            offsets.append(offsets[-1] + x)
        prefix, middle, suffix = (0, cut_1), (cut_1, cut_2), (cut_2, n)
        order = {"plain": [(0, n)], "psm": [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle], "spm": [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle]}[form]
        for x in order:
            if isinstance(x, str):
                self._add(x, 0, len(x))
                continue
            for k, (begin, end) in enumerate(zip(starts, upto, strict=True)):
                if max(x[0], begin) < min(x[1], end):
                    self._add((offsets[k], lengths[k]), max(x[0], begin) - begin, min(x[1], end) - begin)

    def _add(self, what, low: int, high: int) -> None:
        self.parts.append((self.size, what, low, high))
        self.size += high - low

    def stream(self, start: int = 0, end: int | None = None) -> Iterator[str]:
        """Units ``start`` to ``end``, a frame's part at a time; frames outside are not read."""
        end = self.size if end is None else end
        for at, what, low, high in self.parts:
            a, b = max(start, at), min(end, at + high - low)
            if a < b:
                whole = what if isinstance(what, str) else self.frames.text(self.shard, *what)
                yield whole[low + a - at : low + b - at]

    def find(self, control: str, start: int) -> int:
        """The first unit from ``start`` on at which a control string stands."""
        tail, at = "", start
        for part in self.stream(start):
            seen = tail + part
            if (k := seen.find(control)) >= 0:
                return at - len(tail) + k
            at += len(part)
            tail = seen[-(len(control) - 1) :]
        raise ValueError(f"{control} is not there")


def restored(arranged: Arranged, form: str) -> Iterator[str]:
    """The text, rebuilt from what was arranged and its form: control strings are looked up, then its parts are read in order."""
    if form == "plain":
        yield from arranged.stream()
        return
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a = arranged.find(first, 0) + len(first)
    b = arranged.find(second, a)
    c = arranged.find(MIDDLE, b + len(second))
    one, two, middle = (a, b), (b + len(second), c), (c + len(MIDDLE), arranged.size)
    for part in (one, middle, two) if form == "psm" else (two, middle, one):
        yield from arranged.stream(*part)


def _digest(parts: Iterator[str]) -> str:
    sha = hashlib.sha256()
    for x in parts:
        sha.update(x.encode())
    return sha.hexdigest()


def _read(arranged_index: DataFrame, give, kinds: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """doc_id, form and what ``give(arranged, form)`` returns for each row of an index with cuts."""
    rows = arranged_index.select("doc_id", "form", "cut_1", "cut_2", "shard", "first", "frames")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = Frames()
        for batch in batches:
            out = []
            for form, cut_1, cut_2, shard, first, listed in zip(*(batch.column(k).to_pylist() for k in range(1, 7)), strict=True):
                out.append(give(Arranged(frames, shard, first, [f["length"] for f in listed], [f["upto"] for f in listed], form, cut_1, cut_2), form))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, (_, t) in zip(columns, kinds.values(), strict=True))], names=["doc_id", "form", *kinds])
        frames.close()
        textbytes.release()

    return rows.mapInArrow(run, f"doc_id {kind}, form string, " + ", ".join(f"{k} {s}" for k, (s, _) in kinds.items()))


def arranged_texts(index: DataFrame, **percents) -> DataFrame:
    """doc_id, form and text of every arranged text."""
    return _read(by_bytes(arrange(index, **percents)), lambda x, form: ("".join(x.stream()),), {"text": ("string", pa.string())})


def fim_digests(docs: DataFrame, **percents) -> DataFrame:
    """Of every text: units, form, units of prefix and middle (null if plain), digests of what was arranged and of what is rebuilt from it."""
    index = by_bytes(arrange(write_frames(docs), **percents))
    long, text = ("long", pa.int64()), ("string", pa.string())

    def give(x: Arranged, form: str):
        n = x.size - (0 if form == "plain" else sum(map(len, CONTROLS)))
        sizes = [None, None] if form == "plain" else [sum(high - low for _, _, low, high in x.parts[k:m]) for k, m in _spans(x, form)]
        return (n, *sizes, _digest(x.stream()), _digest(restored(x, form)))

    found = _read(index, give, {"n": long, "prefix_chars": long, "middle_chars": long, "output_sha256": text, "restored_sha256": text})
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def _spans(x: Arranged, form: str) -> list[tuple[int, int]]:
    """Where the parts of prefix and of middle stand in the list."""
    controls = [k for k, (_, what, _, _) in enumerate(x.parts) if isinstance(what, str)]
    prefix = (controls[0] + 1, controls[1]) if form == "psm" else (controls[1] + 1, controls[2])
    return [prefix, (controls[2] + 1, len(x.parts))]
