"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over ``TRIGGER``-byte windows picks, in every string of ``length`` bytes, the window of least hash: its
trigger, a function of the string alone. The strings of a document that share a trigger form a phrase, the bytes from
the first of them to the end of the last; phrases overlap, so no string reaches over its phrase's end, and the parse is
the list of a document's phrases. Equal strings have equal triggers, so the corpus order of strings need only be settled
among phrases with the same trigger:

1. Phrases are sorted by trigger, phrase and place in the corpus. All but a phrase's first occurrence repeat it whole; the
   first ones are the dictionary. Occurrences that repeat one of the same slice of texts are settled before the shuffle.
2. Dictionary phrases whose trigger stands in other phrases too are read again, and the suffix array of each range of the
   dictionary - the phrases of a trigger - is built over their bytes. Suffixes that agree in ``length`` bytes are
   neighbours there; the place of their phrase in the parse orders them, and all but the first are repeats. A suffix array
   of the whole parse would only order what follows a phrase's end, which no string reaches.
3. Each document loses the bytes its repeated strings cover.

A trigger that stands often in a slice is hot: its phrases are dealt by phrase instead of by trigger, and one row a slice
tells the trigger's own place. Triggers with more than ``HOT_PHRASES`` dictionary phrases are cut into their strings, which
are dealt by content, so that no task holds all phrases of a trigger. Of strings that a task sent lately it sends only the
starts of those that stand later in the corpus, and a range that is held is thinned to the first of each string, so that a
string that stands everywhere is a row a task and few bytes where it is settled. Whether a trigger is hot changes only where its rows
meet. Phrases count as equal when trigger and phrase agree in 64-bit hashes each and in 17 bits of a third; strings of
different phrases are compared by their bytes.

Places are ordered by doc_id (null first), then by a 64-bit digest of the text for rows that repeat an id, then by
position. Rows equal in id and text are one document and get the same result. Null texts are empty; texts shorter than
``length`` are kept; strings never reach over a document's end, and are judged on the texts as given. An empty table gives
an empty result. Other columns are carried by ``remove_repeats`` and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from . import textbytes as tb
from .marks import marked

TRIGGER = 32
HOT_IN_SLICE = 16
HOT_PHRASES = 2000
KNOWN_STRINGS = 1 << 16  # strings of hot triggers that a task remembers to have sent
PART_ROWS = 2000  # rows whose strings are ordered at a time, whole ranges each
HELD_ROWS = 8000  # rows of one range held before they are thinned
BATCH = "2m"  # Arrow batches until the runs are written
PARSE_BYTES = 1 << 18  # the hashes of a slice take about a hundred times its bytes
KEEP_BYTES = 1 << 20  # texts sent back at a time
_LOW = 14  # bits of a place below the start: trigger and last string, 7 bits each
_START = 31
_PLACE = (1 << (_START + _LOW)) - 1
_CHECK = tb.seeds(256, 8)
REPEAT, OPEN, HOT, TELLS = range(4)
_ROW = "g long, x long, d long, th long, place long, kind long"


def trigger_phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, trigger's place, first and last string's start, trigger hash, phrase hash, check bits) of every phrase."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64), none
    up, down = tb._power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tb._BYTE[data] * up[: len(data)], out=total[1:])
    rolling = tb.mix64((total[TRIGGER:] - total[:-TRIGGER]) * down[: len(data) - TRIGGER + 1])
    least = (rolling >> np.uint64(32)).astype(np.uint32)
    where = np.arange(len(least), dtype=np.int32)
    reach, span = 1, length - TRIGGER + 1
    while reach < span:  # the leftmost least hash of every window, by doubling
        by = min(reach, span - reach)
        m = len(least) - by
        later = least[by:] < least[:m]
        where = np.where(later, where[by:], where[:m])
        least = np.where(later, least[by:], least[:m])
        reach += by
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(text[: len(where)] == text[length - 1 : length - 1 + len(where)])
    if not len(start):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64), none
    at, own = where[start].astype(np.int64), text[start]
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1])]))
    first, last = start[head], start[np.append(head[1:], len(start)) - 1]
    end = last + length
    x = tb.mix64((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64) * tb._STEP)
    np.cumsum(_CHECK[data] * up[: len(data)], out=total[1:])
    check = tb.mix64((total[end] - total[first]) * down[first]) >> np.uint64(64 - 17)
    return own[head], at[head], first, last, rolling[at[head]], x, check.astype(np.int64)


def pack_place(check: np.ndarray, first: np.ndarray, trigger: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One word for a phrase's extent, with check bits above that ``_PLACE`` masks; without them it sorts by start."""
    return (check << (_START + _LOW)) | (first << _LOW) | ((trigger - first) << 7) | (last - first)


def unpack_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = (place >> _LOW) & ((1 << _START) - 1)
    return first, first + ((place >> 7) & 127), first + (place & 127)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """All columns as one, with d (the id, least for null), th (a digest of the text) and b (the bytes)."""
    raw = F.coalesce(docs[text].cast("binary"), F.lit(b""))
    d = F.coalesce(docs[doc_id].cast("long"), F.lit(-(1 << 63)))
    return docs.select(d.alias("d"), F.xxhash64(raw).alias("th"), raw.alias("b"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))


def _batch(columns: list[np.ndarray], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names.split())


def settle_slice(rows: np.ndarray) -> np.ndarray:
    """Phrases (g, x, d, th, place) of a slice with a kind each: repeats of one in the slice, others, and hot triggers with a row that tells of them."""
    g = rows[:, 0]
    _, inverse, count = np.unique(g, return_inverse=True, return_counts=True)
    kind = np.full(len(rows), OPEN)
    again = np.flatnonzero(count[inverse] > 1)
    if not len(again):
        return np.column_stack([rows, kind])
    part = rows[again]
    order = np.lexsort((part[:, 4] & _PLACE, part[:, 3], part[:, 2], part[:, 4] >> (_START + _LOW), part[:, 1], part[:, 0]))
    at, part = again[order], part[order]
    same = np.concatenate([[False], (part[1:, :2] == part[:-1, :2]).all(1) & (part[1:, 4] >> (_START + _LOW) == part[:-1, 4] >> (_START + _LOW))])
    twice = np.concatenate([[False], (part[1:] == part[:-1]).all(1)])  # rows that repeat an id and text are one document
    kind[at[same]] = REPEAT
    fresh = np.bincount(inverse[at[~same]], minlength=len(count))
    hot = fresh >= HOT_IN_SLICE
    kind[(kind == OPEN) & hot[inverse]] = HOT
    out = np.column_stack([rows, kind])
    keep = np.ones(len(rows), bool)
    keep[at[twice]] = False
    tells = np.zeros((int(hot.sum()), 6), np.int64)
    first = np.zeros(len(count), np.int64)
    first[inverse] = g
    tells[:, 0], tells[:, 5] = first[hot], TELLS
    return np.concatenate([out[keep], tells])


def _scan_phrases(keyed: DataFrame, length: int) -> DataFrame:
    """g, d, th, place and kind of every phrase that is a repeat or may share its strings with other phrases."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = tb.text_column(batch.column(2))
            for i, j in tb.slices(offsets, PARSE_BYTES):
                own, at, first, last, g, x, check = trigger_phrases(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                base = (offsets[i:j] - offsets[i])[own]
                place = pack_place(check, first - base, at - base, last - base)
                rows = settle_slice(np.column_stack([g.view(np.int64), x.view(np.int64), d[i:j][own], th[i:j][own], place]))
                yield _batch(list(rows.T), "g x d th place kind")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior: np.ndarray | None = None  # the row before
        head: np.ndarray | None = None  # the first row of its trigger, until it is known to be shared
        told = False  # whether the last trigger is hot
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if not len(rows):
                continue
            settled = rows[:, 5] == REPEAT
            passed, rows = rows[settled], rows[~settled]
            out = [(passed, REPEAT)]
            if len(rows):
                before = np.concatenate([rows[:1] if prior is None else prior[None], rows[:-1]])
                check, check_before = rows[:, 4] >> (_START + _LOW), before[:, 4] >> (_START + _LOW)
                same_g = rows[:, 0] == before[:, 0]
                if prior is None:
                    same_g[0] = False
                plain = (rows[:, 5] != TELLS) & (before[:, 5] != TELLS)
                same_x = same_g & plain & (rows[:, 1] == before[:, 1]) & (check == check_before)
                again = same_x & (rows[:, 2:5] == before[:, 2:5]).all(1)
                heads = np.flatnonzero(~same_g)
                group = np.cumsum(~same_g)  # 0: the trigger of the batch before
                hot = np.zeros(int(group[-1]) + 1, bool)
                hot[0] = told
                hot[group[rows[:, 5] >= HOT]] = True
                shared = np.zeros(len(hot), bool)
                distinct = same_g & ~same_x
                shared[group[distinct]] = True
                shared |= hot
                open_ = ~same_x & shared[group] & (rows[:, 5] != TELLS)
                if not hot[0]:
                    open_[(group == 0) & same_g] = (distinct & (group == 0))[(group == 0) & same_g]
                out += [(rows[same_x & ~again], REPEAT), (rows[open_], OPEN)]
                if head is not None and shared[0]:
                    out.append((head[None], OPEN))
                    head = None
                if len(heads):
                    last = int(heads[-1])
                    head = None if shared[-1] else rows[last]
                told = bool(hot[-1])
                prior = rows[-1]
            for part, kind in out:
                yield _batch([part[:, 0], part[:, 2], part[:, 3], part[:, 4] & _PLACE, np.full(len(part), kind)], "g d th place kind")

    phrases = keyed.select("d", "th", "b").mapInArrow(parse, _ROW)
    home = F.when(F.col("kind") == REPEAT, F.xxhash64("d", "th", "place")).when(F.col("kind") == HOT, F.xxhash64("g", "x")).otherwise(F.col("g"))
    dealt = phrases.repartition(home).sortWithinPartitions("g", F.desc(F.col("kind") == TELLS), "x", "d", "th", "place")
    return dealt.mapInArrow(settle, "g long, d long, th long, place long, kind long")


def _open_phrases(keyed: DataFrame, scanned: DataFrame, length: int) -> DataFrame:
    """p, d, th, place, body and from of the phrases whose order is open, read again from the texts.

    ``p`` is the trigger; of a trigger with very many phrases every string is a row of its own, under a hash of its bytes, and
    strings that repeat one of their batch come without body, with ``from`` as their start."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = "p d th place body from"
        known: dict[bytes, tuple[int, int, int]] = {}  # strings sent and where they stand
        for batch in batches:
            data, offsets = tb.text_column(batch.column(2))
            counts = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column(3).flatten()
            places, hot = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(batch.num_rows), counts)
            d, th = (batch.column(i).to_numpy(zero_copy_only=False)[of] for i in (0, 1))
            base = offsets[:-1][of]
            first, at, last = unpack_place(places)

            def blob(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
                body = data[tb.ragged(begin, size)]  # noqa: B023
                ends = np.concatenate([[0], np.cumsum(size)])
                return body, ends, pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body.tobytes())])

            size = last - first + length
            whole = np.flatnonzero(~hot)
            for i, j in tb.slices(np.concatenate([[0], np.cumsum(size[whole])]), PARSE_BYTES):
                k = whole[i:j]
                body, ends, bodies = blob(base[k] + first[k], size[k])
                g = tb.span_hashes(body, ends[:-1] + (at - first)[k], ends[:-1] + (at - first)[k] + TRIGGER)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(d[k]), pa.array(th[k]), pa.array(places[k]), bodies, pa.array(first[k])], names=names.split())
            split = np.flatnonzero(hot)
            for i, j in tb.slices(np.concatenate([[0], np.cumsum((last - first + 1)[split] * length)]), 4 * PARSE_BYTES):
                k = split[i:j]
                body, ends, _ = blob(base[k] + first[k], size[k])
                n = (last - first + 1)[k]
                row, begin = np.repeat(k, n), tb.ragged(ends[:-1], n)
                start = tb.ragged(first[k], n)
                _, rank = suffix_order(body, begin, length)
                order = np.lexsort((start, th[row], d[row], rank))
                same = np.concatenate([[False], rank[order[1:]] == rank[order[:-1]]])
                d_, th_ = d[row], th[row]
                one = np.concatenate([[False], (d_[order[1:]] == d_[order[:-1]]) & (th_[order[1:]] == th_[order[:-1]]) & (start[order[1:]] == start[order[:-1]])])
                order, same = order[~(same & one)], same[~(same & one)]  # rows that repeat an id and text are one document
                place = pack_place(np.zeros(len(row), np.int64), start, start, start)
                fresh = order[~same]
                strings = body[tb.ragged(begin[fresh], np.full(len(fresh), length))].tobytes()
                later = np.zeros(len(fresh), bool)
                for m, at_ in enumerate(zip(d_[fresh].tolist(), th_[fresh].tolist(), start[fresh].tolist(), strict=True)):
                    string = strings[m * length : (m + 1) * length]
                    sent = known.get(string)
                    if sent is not None and sent < at_:
                        later[m] = True
                    else:
                        if len(known) >= KNOWN_STRINGS:
                            known.clear()
                        known[string] = at_
                again, fresh = np.concatenate([order[same], fresh[later]]), fresh[~later]
                p = tb.span_hashes(body, begin, begin + length).view(np.int64)
                for own, bare in ((fresh, False), (again, True)):
                    if bare:
                        where, bodies = tb.mix64((th[row[own]] ^ start[own]).view(np.uint64)).view(np.int64), pa.nulls(len(own), pa.binary())
                    else:
                        where, (_, _, bodies) = p[own], blob(base[row[own]] + start[own], np.full(len(own), length))
                    yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(d[row[own]]), pa.array(th[row[own]]), pa.array(place[own]), bodies, pa.array(start[own])], names=names.split())

    open_ = scanned.where(F.col("kind") == OPEN)
    crowded = store.materialize(open_.groupBy("g").count().where(F.col("count") > HOT_PHRASES).select("g"), "pfp-hot")
    split = marked(open_, crowded, "g", hit="hot")
    wanted = split.select("d", "th", F.struct("place", "hot").alias("phrase")).groupBy("d", "th").agg(F.collect_set("phrase").alias("phrases"))
    wanted = store.materialize(wanted, "pfp-open")
    texts = marked(keyed.select("d", "th", "b"), wanted, "d", "th").where("hit")
    joined = texts.join(wanted, ["d", "th"]).select("d", "th", "b", "phrases")
    return joined.mapInArrow(cut, "p long, d long, th long, place long, body binary, from long")


def suffix_order(data: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array of the places ``begin`` to a depth of ``length`` bytes, rank of each place); equal ranks are equal bytes.

    Ranks of 8 bytes are doubled, as every place has ``length`` bytes before the end of its phrase."""
    n = len(data)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = np.zeros(n, np.uint64)
    for k in range(8):
        wide[: n - k] |= data[k:].astype(np.uint64) << np.uint64(8 * (7 - k))
    rank, depth = np.unique(wide, return_inverse=True)[1].astype(np.int64), 8
    while depth < length:
        by = min(depth, length - depth)
        after = np.append(rank[by:], np.full(by, -1))
        pair = rank * (n + 2) + after + 1
        if depth + by == length:
            pair = pair[begin]
        rank, depth = np.unique(pair, return_inverse=True)[1].astype(np.int64), depth + by
    return np.argsort(rank, kind="stable"), rank


def thinned(range_: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """(a range's rows without the strings that stand alone in a row and in an earlier one, runs of those); rows are in corpus order."""
    first, _, last = unpack_place(range_.column(3).to_numpy(zero_copy_only=False))
    seen: set[bytes] = set()
    gone = np.zeros(range_.num_rows, bool)
    alone = np.flatnonzero(first == last)
    for k, body in zip(alone.tolist(), range_.column(4).take(pa.array(alone)).to_pylist(), strict=True):
        gone[k] = body in seen
        seen.add(body)
    d, th = (range_.column(i).to_numpy(zero_copy_only=False)[gone] for i in (1, 2))
    return range_.filter(pa.array(~gone)), _batch([d, th, first[gone], first[gone]], "d th from to")


def _settle_strings(phrases: DataFrame, length: int) -> DataFrame:
    """d, th, from and to: runs of starts of repeated strings."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def repeats(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in parts(table):
                data, offsets = tb.text_column(part.column(4))
                data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
                p, d, th, place = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                first, _, last = unpack_place(place)
                count = last - first + 1
                begin, row = tb.ragged(offsets[:-1], count), np.repeat(np.arange(len(p)), count)
                start = begin - offsets[:-1][row] + first[row]
                array, rank = suffix_order(data, begin, length)
                # rows come in corpus order, which the stable sort keeps among equal strings; only those of one range meet
                array = array[np.argsort(p[row[array]], kind="stable")]
                same = np.concatenate([[False], (rank[array[1:]] == rank[array[:-1]]) & (p[row[array[1:]]] == p[row[array[:-1]]])])
                seen = np.zeros(len(rank), bool)
                seen[array] = same
                head = np.flatnonzero(seen & np.concatenate([[True], ~seen[:-1] | (row[1:] != row[:-1])]))
                tail = np.flatnonzero(seen & np.concatenate([~seen[1:] | (row[1:] != row[:-1]), [True]]))
                yield _batch([d[row[head]], th[row[head]], start[head], start[tail]], "d th from to")
            tb.release()

        def parts(table: pa.RecordBatch, rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
            """The rows in parts of about ``rows``, whole ranges each."""
            p = table.column(0).to_numpy(zero_copy_only=False)
            ends = np.append(np.flatnonzero(p[1:] != p[:-1]) + 1, len(p)) if len(p) else np.zeros(0, np.int64)
            at = 0
            while at < len(p):
                k = int(ends[min(np.searchsorted(ends, at + rows), len(ends) - 1)])
                yield table.slice(at, k - at)
                at = k

        prior: tuple | None = None
        limit = HELD_ROWS
        for batch in batches:
            settled = batch.column(4).is_null().to_numpy(zero_copy_only=False)
            if settled.any():
                own = batch.filter(pa.array(settled))
                start = own.column(5).to_numpy(zero_copy_only=False)
                yield _batch([own.column(1).to_numpy(zero_copy_only=False), own.column(2).to_numpy(zero_copy_only=False), start, start], "d th from to")
                batch = batch.filter(pa.array(~settled))
            if not batch.num_rows:
                continue
            # rows that repeat an id and text give the same phrases, which stand side by side; one of each stays
            four = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            twice = np.concatenate([[prior is not None and tuple(four[0]) == prior], (four[1:] == four[:-1]).all(1)])
            prior = tuple(four[-1])
            if twice.any():
                batch, four = batch.filter(pa.array(~twice)), four[~twice]
                if not batch.num_rows:
                    continue
            held.append(batch)
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            p = whole.column(0).to_numpy(zero_copy_only=False)
            cut = len(p) - int(np.argmax(p[::-1] != p[-1])) if (p != p[-1]).any() else 0
            if cut:
                yield from repeats(whole.slice(0, cut))
                limit = HELD_ROWS
            held = [whole.slice(cut)]
            if held[0].num_rows > limit:
                kept, gone = thinned(held[0])
                yield gone
                held, limit = [kept], max(HELD_ROWS, 2 * kept.num_rows)
        if held:
            yield from repeats(held[0])

    spread = phrases.repartition("p").sortWithinPartitions("p", "d", "th", "place")
    return spread.mapInArrow(settle, "d long, th long, from long, to long")


def repeated_runs(keyed: DataFrame, length: int) -> DataFrame:
    """d, th and runs (from, to): starts of the repeated strings of every document that has some."""
    scanned = store.materialize(_scan_phrases(keyed, length), "pfp-phrases")
    low: Column = F.shiftright("place", _LOW)
    whole = scanned.where(F.col("kind") == REPEAT).select("d", "th", low.alias("from"), (low + F.col("place").bitwiseAND(127)).alias("to"))
    runs = whole.unionByName(_settle_strings(_open_phrases(keyed, scanned, length), length))
    return store.materialize(runs.groupBy("d", "th").agg(F.collect_list(F.struct("from", "to")).alias("runs")), "pfp-runs")


def covered(n: int, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [start, stop)."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    head = np.concatenate([[True], start[1:] > stop[:-1]])
    return start[head], np.append(stop[:-1][head[1:]], stop[-1])


def _whole_characters(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs without the characters they cut."""
    tail = np.append((data & 0xC0) == 0x80, False)
    start, stop = start.copy(), stop.copy()
    for _ in range(3):
        start += tail[start]
        stop -= tail[np.minimum(stop, len(data))]
    keep = stop > start
    return start[keep], stop[keep]


def remove_repeats(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", whole_characters: bool = False) -> DataFrame:
    """row (the document's columns), n_bytes, n_removed, n_spans and kept (bytes) of every document."""
    if not 2 * TRIGGER <= length <= TRIGGER + 127:
        raise ValueError(f"length must be from {2 * TRIGGER} to {TRIGGER + 127}")
    keyed = _keyed(docs, doc_id, text)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = tb.text_column(whole.column(1))[1]
            for i, j in tb.slices(sizes, KEEP_BYTES):
                yield keep(whole.slice(i, j - i))

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = tb.text_column(batch.column(1))
        lists, counts = batch.column(2), batch.column(2).fill_null([]).value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        begin, end = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)) if len(flat) else (np.zeros(0, np.int64),) * 2
        at = np.concatenate([[0], np.cumsum(counts)])
        removed, spans, kept = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
        for k in range(batch.num_rows):
            body = data[offsets[k] : offsets[k + 1]]
            start, stop = covered(len(body), begin[at[k] : at[k + 1]], end[at[k] : at[k + 1]] + length)
            if whole_characters and len(start):
                start, stop = _whole_characters(body, start, stop)
            removed[k], spans[k] = (stop - start).sum(), len(start)
            if len(start):
                edge = np.zeros(len(body) + 1, np.int8)
                np.add.at(edge, start, 1)
                np.add.at(edge, stop, -1)
                body = body[np.cumsum(edge[:-1]) == 0]
            kept.append(body.tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary())], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])

    with store.batches(docs.sparkSession, BATCH):
        runs = repeated_runs(keyed, length)
        seen = marked(keyed, runs, "d", "th")
    touched = seen.where("hit").join(runs, ["d", "th"], "left").select("row", "b", "runs")
    clean = seen.where("not hit").select("row", "b", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
    schema = f"row {keyed.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"
    return touched.mapInArrow(finish, schema).unionByName(clean.mapInArrow(finish, schema))


def kept_digests(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is kept."""
    out = remove_repeats(docs.select("doc_id", "text"), length)
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


