"""MinHash near-dedup by chosen paths: a set similarity join over recursively branched documents.

A document is its set of word shingles; documents with the same set form a class. Every class carries ``POSITIONS``
minwise values. In each tree a node picks one or two positions from its own key, and its classes move to the children
named by their values there, so similar classes stay together along some path. Nodes of bounded size are compared
exhaustively; larger ones compare all classes with one of theirs (a star) and branch on while they hold classes that the
links found so far do not connect and comparing those would take too many steps. Trees differ by their root key and their number follows from the wanted recall.
Below the starting depth nodes branch twice, which holds that recall at any depth; ``DEEPER`` levels down, where unrelated
documents have parted, what is left is compared in blocks whatever a node's size.
Comparisons first match two bits of each minwise value, then every pair that could still connect two components is
confirmed on full sets of 64-bit shingle hashes, those of a large node block by block in the task that holds both blocks' sets; nothing is dropped
for its node's size.

The depth to which all nodes branch before they are counted follows from the number of classes, so that unrelated
documents seldom share a node. Texts are split at bytes 0x20 and 0x09-0x0D after lower-casing A-Z. Null and empty texts
and texts without words have an empty set and link with nothing; with fewer words than a shingle the whole sequence is
the one shingle. Rows with equal text share a class, repeated doc_ids stay rows of their own, a null doc_id counts as the
last; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from . import textbytes as tb
from .components import connected_components
from .marks import marked

POSITIONS = 64
LEAF = 64
BLOCK = 2048  # classes of a large node compared in one task
DEEPER = 3  # levels below the starting depth, each of which makes a class's rows in large nodes 2.5 times as many
NODE_BLOCKS = 256  # pairs of blocks of one large node; beyond, it branches first
COLUMNS = 1024  # shared elements counted at a time, for up to two blocks of classes
MATCHES = 36  # of 64; at similarity 0.8 54 agree on average, with a deviation under 3
_AGAIN = tb.seeds(2, 37)  # a node that branches below the starting depth does so twice
_EVEN = 0x5555555555555555
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_ODD = tb.seeds(POSITIONS, 31) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of each text's distinct shingles, sorted, end to end; number of each text)."""
    n = len(offsets) - 1
    low = data.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    inside = ~_IS_SPACE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets[offsets < len(low)]] = True
    prior = np.concatenate([[False], inside[:-1]]) if len(low) else inside
    start = np.flatnonzero(inside & (~prior | edge[:-1]))
    following = np.concatenate([inside[1:], [False]]) if len(low) else inside
    end = np.flatnonzero(inside & (~following | edge[1:])) + 1
    w = tb.span_hashes(low, start, end)
    text = np.searchsorted(offsets, start, side="right") - 1
    per_text = np.bincount(text, minlength=n)
    first = np.cumsum(per_text) - per_text
    with np.errstate(over="ignore"):
        h = np.full(max(0, len(w) - words + 1), words, np.uint64)
        for k in range(words):
            h = tb.mix64(h * _FOLD + w[k : len(w) - words + 1 + k])
        whole = text[: len(h)] == text[words - 1 :] if len(h) else np.zeros(0, bool)
        h, owner = h[whole], text[: len(h)][whole]
        short = np.flatnonzero((per_text > 0) & (per_text < words))
        if len(short):
            one = per_text[short].astype(np.uint64)
            for k in range(words - 1):
                more = per_text[short] > k
                one[more] = tb.mix64(one[more] * _FOLD + w[first[short[more]] + k])
            h, owner = np.concatenate([h, one]), np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            h, owner = h[order], owner[order]
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    if len(h):
        fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[fresh], np.bincount(owner[fresh], minlength=n)


def signatures(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of each set as two words, its minwise values, two bits of each value as two words). Empty sets have zeros."""
    n, full = len(sizes), np.flatnonzero(sizes)
    key, sig, bits = np.zeros((n, 2), np.uint64), np.zeros((n, POSITIONS), np.uint32), np.zeros((n, 2), np.uint64)
    if not len(full):
        return key, sig, bits
    at = (np.cumsum(sizes) - sizes)[full]
    with np.errstate(over="ignore"):
        for k in range(2):
            key[full, k] = tb.mix64(np.add.reduceat(tb.mix64(h ^ tb.seeds(2, 33)[k]), at) + sizes[full].astype(np.uint64))
        for k in range(POSITIONS):
            low = np.minimum.reduceat((h * _ODD[k]) >> np.uint64(32), at)
            sig[full, k] = low
            two = tb.mix64(low + _ODD[k]) & np.uint64(3)
            bits[full, k // 32] |= two << np.uint64(2 * (k % 32))
    return key, sig, bits


def branch(keys: np.ndarray, row: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes for the classes that stand in them: one position always, a second one for a node in four."""
    first = (keys >> np.uint64(58)).astype(np.int64)
    other = np.flatnonzero(((keys >> np.uint64(40)) & np.uint64(3)) == 0)
    second = ((keys[other] >> np.uint64(52)) & np.uint64(63)).astype(np.int64)
    second = np.where(second == first[other], (second + 1) % POSITIONS, second)
    keys, at, row = np.concatenate([keys, keys[other]]), np.concatenate([first, second]), np.concatenate([row, row[other]])
    with np.errstate(over="ignore"):
        value = sig[row, at].astype(np.uint64) * _FOLD + at.astype(np.uint64)
        return tb.mix64(keys ^ tb.mix64(value)), row


def missed(depth: int, similarity: float) -> float:
    """Chance that a pair shares no path of a tree at a depth, nor at any level below it, where every node branches twice."""
    q = 0.0
    for _ in range(100):  # converges from below: no number of further levels exceeds it
        x = 1 - similarity + similarity * q
        q = (0.75 * x + 0.25 * x * x) ** 2
    for _ in range(depth):
        x = 1 - similarity + similarity * q
        q = 0.75 * x + 0.25 * x * x
    return q


def forest(classes: int, similarity: float = 0.8, miss: float = 1e-7) -> tuple[int, int]:
    """(depth, trees): nodes of unrelated classes stay small, a pair at the threshold is missed with chance ``miss`` at any depth."""
    depth = max(2, math.ceil(math.log(max(classes, 2)) / math.log(70)))
    return depth, math.ceil(math.log(miss) / math.log(missed(depth, similarity)))


def _sketch(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """row, doc_id, digest of the text, number of shingles, key of the set, sketch and minwise values of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.text_column(batch.column(1))
            for i, j in tb.slices(offsets, tb.SHORT_SLICE):
                h, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                key, sig, bits = signatures(h, sizes)
                blob = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((np.arange(j - i + 1) * 4 * POSITIONS).astype(np.int32)), pa.py_buffer(sig.tobytes())])
                longs = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (key[:, 0], key[:, 1], bits[:, 0], bits[:, 1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(sizes.astype(np.int64)), *longs, blob], names=["doc_id", "digest", "n_shingles", "k0", "k1", "s0", "s1", "sig"])

    source = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("b"), F.xxhash64(docs[text]).alias("digest"))
    kind = source.schema[0].dataType.simpleString()
    rows = source.mapInArrow(run, f"doc_id {kind}, digest long, n_shingles long, k0 long, k1 long, s0 long, s1 long, sig binary")
    return store.materialize(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "path-rows")


def _nodes(classes: DataFrame, depth: int, trees: int) -> DataFrame:
    """node, id and sketch of every class in every node at a depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(tb.text_column(batch.column(3))[0], np.uint32)
            at = tb.text_column(batch.column(3))[1][0] // 4
            sig = sig[at : at + batch.num_rows * POSITIONS].reshape(-1, POSITIONS)
            for k in range(0, batch.num_rows, 2048):
                part = sig[k : k + 2048]
                row = np.tile(np.arange(len(part)), trees)
                keys = np.repeat(tb.seeds(trees, 35), len(part))
                for _ in range(depth):
                    keys, row = branch(keys, row, part)
                pick = pa.array(row + k)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(batch.column(c).take(pick) for c in range(3))], names=["node", "id", "s0", "s1"])
        tb.release()

    return classes.select("id", "s0", "s1", "sig").mapInArrow(run, "node long, id long, s0 long, s1 long")


def _compare(nodes: DataFrame) -> DataFrame:
    """Pairs of each node that may be similar; of a node over ``LEAF``, those with its first class. kind 1 marks such nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "kind"]
        kept = np.zeros((0, 4), np.int64)  # the last node's first rows, LEAF + 1 at most
        open_node: int | None = None  # a node already known to be large
        pivot = np.zeros(4, np.int64)

        def emit(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            x = np.bitwise_xor(a[:, 2:], b[:, 2:]).view(np.uint64)
            agree = 64 - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(_EVEN)).sum(1)
            ok = (agree >= MATCHES) & (a[:, 1] != b[:, 1])
            p, q = a[ok, 1], b[ok, 1]
            both = np.unique(np.stack([np.maximum(p, q), np.minimum(p, q)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.zeros(len(both), np.int64))], names=names)

        def small(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for step in range(1, LEAF):
                if len(rows) <= step:
                    return
                same = np.flatnonzero(rows[step:, 0] == rows[:-step, 0])
                if not len(same):
                    return
                yield emit(rows[same], rows[same + step])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            if open_node is not None:
                more = int(np.searchsorted(rows[:, 0] != open_node, True)) if (rows[:, 0] != open_node).any() else len(rows)
                if more:
                    yield emit(rows[:more], np.broadcast_to(pivot, (more, 4)))
                rows = rows[more:]
                if not len(rows):
                    continue
                open_node = None
            rows = np.concatenate([kept, rows])
            if not len(rows):
                continue
            heads = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            sizes = np.diff(np.append(heads, len(rows)))
            last = len(heads) - 1
            large = [k for k in np.flatnonzero(sizes > LEAF).tolist()]
            for k in large:
                own = rows[heads[k] : heads[k] + sizes[k]]
                yield emit(own[1:], np.broadcast_to(own[0], (len(own) - 1, 4)))
                yield pa.RecordBatch.from_arrays([pa.array([int(own[0, 0])]), pa.array([0]), pa.array([1])], names=names)
            if large and large[-1] == last:
                open_node, pivot = int(rows[heads[last], 0]), rows[heads[last]].copy()
                kept = np.zeros((0, 4), np.int64)
                done = np.ones(len(rows), bool)
            else:
                kept = rows[heads[last] :].copy()
                done = np.arange(len(rows)) < heads[last]
            done &= np.repeat(sizes <= LEAF, sizes)
            yield from small(rows[done])
        yield from small(kept)
        tb.release()

    spread = nodes.withColumn("order", F.xxhash64("id")).repartition("node").sortWithinPartitions("node", "order").select("node", "id", "s0", "s1")
    return spread.mapInArrow(run, "a long, b long, kind long")


def _set_table(docs: DataFrame, wanted: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """id and the packed set of the classes in ``wanted`` (id, doc_id, digest, k0, k1), from the whole texts.

    Texts are found by doc_id and digest, so that rows without id or of one id do not meet each other; those that surely
    are not wanted stay out of the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.text_column(batch.column(3))
            k0 = batch.column(1).to_numpy(zero_copy_only=False)
            k1 = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in tb.slices(offsets, tb.SHORT_SLICE):
                h, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                key = signatures(h, sizes)[0].view(np.int64) if j > i else np.zeros((0, 2), np.int64)
                at = np.concatenate([[0], np.cumsum(sizes)])
                keep = np.flatnonzero((key[:, 0] == k0[i:j]) & (key[:, 1] == k1[i:j]))
                sets = [h[at[r] : at[r + 1]].astype("<u8").tobytes() for r in keep]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(keep)), pa.array(sets, pa.binary())], names=["id", "set"])

    source = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("digest"), F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("b"))
    source = marked(source, wanted, "doc_id", "digest").where("hit").drop("hit").toDF("d", "h", "b")
    joined = source.join(wanted, source["d"].eqNullSafe(wanted["doc_id"]) & (source["h"] == wanted["digest"])).select("id", "k0", "k1", "b")
    return store.materialize(joined.mapInArrow(run, "id long, set binary").dropDuplicates(["id"]), "path-sets")


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u8")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = unpack(x.as_py()), unpack(y.as_py())
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    good.append(100 * both >= percent * (len(p) + len(q) - both))
                else:
                    good.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))
        tb.release()

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return store.materialize(both.mapInArrow(run, "a long, b long"), "path-links")


def _across(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose ends stand in different components."""
    p = pairs.join(parts.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(parts.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    return p.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _blocks(members: DataFrame, extra: list[str]) -> DataFrame:
    """Rows of large nodes dealt to blocks: every class outside the node's main component meets all of the node's classes.

    ``seeks`` marks the former where they stand for that. A node of one block has each class once."""
    n_all, n_odd = F.ceil(F.col("all") / BLOCK), F.ceil(F.col("odd") / BLOCK)
    own_all, own_odd = F.pmod(F.xxhash64("id"), n_all), F.pmod(F.xxhash64(F.lit(1), "id"), n_odd)
    odd = F.col("component") != F.col("main")
    columns = ["node", "id", "component", "s0", "s1", *extra]
    met = members.select(*columns, own_all.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), n_odd - 1)).alias("j"), (odd & (n_all == 1)).alias("seeks"))
    seek = members.where(odd & (n_all > 1)).select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), n_all - 1)).alias("i"), own_odd.alias("j"), F.lit(True).alias("seeks"))
    return met.unionByName(seek).select(F.xxhash64("node", "i", "j").alias("block"), *columns[1:], "seeks")


def _may_match(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For every row of p and q (two sketch words each) whether they could be similar."""
    x0, x1 = p[:, None, 0] ^ q[None, :, 0], p[:, None, 1] ^ q[None, :, 1]
    even = np.uint64(_EVEN)
    apart = np.bitwise_count((x0 | (x0 >> np.uint64(1))) & even) + np.bitwise_count((x1 | (x1 >> np.uint64(1))) & even)
    return apart <= 64 - MATCHES


def similar_rows(p: list[np.ndarray], q: list[np.ndarray], percent: int) -> np.ndarray:
    """Exact: whether each set of p and of q is similar enough. Shared elements are counted by products of 0/1 columns."""
    size_p, size_q = (np.array([len(x) for x in y], np.int64) for y in (p, q))
    flat_p, flat_q = np.concatenate([*p, np.zeros(0, np.uint64)]), np.concatenate([*q, np.zeros(0, np.uint64)])
    shared = np.intersect1d(flat_p, flat_q)
    both = np.zeros((len(p), len(q)), np.float32)
    at_p, at_q = np.searchsorted(shared, flat_p), np.searchsorted(shared, flat_q)
    in_p, in_q = (at < len(shared) for at in (at_p, at_q))
    in_p[in_p] = shared[at_p[in_p]] == flat_p[in_p]
    in_q[in_q] = shared[at_q[in_q]] == flat_q[in_q]
    row_p, row_q = np.repeat(np.arange(len(p)), size_p)[in_p], np.repeat(np.arange(len(q)), size_q)[in_q]
    at_p, at_q = at_p[in_p], at_q[in_q]
    by_p, by_q = np.argsort(at_p), np.argsort(at_q)
    at_p, row_p, at_q, row_q = at_p[by_p], row_p[by_p], at_q[by_q], row_q[by_q]
    for k in range(0, len(shared), COLUMNS):
        one, two = np.zeros((len(p), COLUMNS), np.float32), np.zeros((len(q), COLUMNS), np.float32)
        own = slice(*np.searchsorted(at_p, [k, k + COLUMNS]))
        one[row_p[own], at_p[own] - k] = 1
        own = slice(*np.searchsorted(at_q, [k, k + COLUMNS]))
        two[row_q[own], at_q[own] - k] = 1
        both += one @ two.T
    n = both.astype(np.int64)
    return 100 * n >= percent * (size_p[:, None] + size_q[None, :] - n)


def _by_block(rows: DataFrame, work, schema: str) -> DataFrame:
    """Runs ``work`` on the whole rows of each block; a block has a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[not held or held[-1].column(0)[-1].as_py() != key[0]], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            at = 0
            for k in [*starts.tolist(), len(key)]:
                if k > at:
                    held.append(batch.slice(at, k - at))
                if k < len(key) and held:
                    yield work(pa.Table.from_batches(held))
                    held = []
                at = k
        if held:
            yield work(pa.Table.from_batches(held))
            held = []
        tb.release()

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def _words(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")], 1)


def _involved(blocks: DataFrame) -> DataFrame:
    """block and id of the classes that could match one of another component."""

    def work(table: pa.Table) -> pa.RecordBatch:
        w, ids, part = _words(table), table.column("id").to_numpy(), table.column("component").to_numpy()
        seek, hit = np.flatnonzero(table.column("seeks").to_numpy(zero_copy_only=False)), np.zeros(len(ids), bool)
        for k in range(0, len(seek), 64):
            s = seek[k : k + 64]
            ok = _may_match(w[s], w) & (part[s][:, None] != part[None, :])
            hit |= ok.any(0)
            hit[s] |= ok.any(1)
        found = np.unique(ids[hit])
        return pa.RecordBatch.from_arrays([pa.array(found)], names=["id"])

    return store.materialize(_by_block(blocks, work, "id long").distinct(), "path-involved")


def _block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of a block's classes, by exact comparison; as few as that takes."""

    def work(table: pa.Table) -> pa.RecordBatch:
        w, ids = _words(table), table.column("id").to_numpy()
        part = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        sets = [unpack(x) for x in table.column("set").to_pylist()]
        seek, out = np.flatnonzero(table.column("seeks").to_numpy(zero_copy_only=False)), []
        for k in range(0, len(seek), 128):
            s = seek[k : k + 128]
            ok = _may_match(w[s], w) & (part[s][:, None] != part[None, :])
            cols = np.flatnonzero(ok.any(0))
            if not len(cols):
                continue
            if ok.sum() * 8 > len(s) + len(cols):
                good = ok[:, cols] & similar_rows([sets[r] for r in s], [sets[c] for c in cols], percent)
                rows, at = np.nonzero(good)
                pairs = zip(s[rows].tolist(), cols[at].tolist(), strict=True)
            else:
                pairs = [(int(s[r]), int(c)) for r, c in zip(*np.nonzero(ok), strict=True) if similar_rows([sets[s[r]]], [sets[c]], percent)[0, 0]]
            for a, b in pairs:
                if part[a] != part[b]:
                    out.append((max(ids[a], ids[b]), min(ids[a], ids[b])))
                    part[part == part[a]] = part[b]
        found = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return store.materialize(_by_block(blocks, work, "a long, b long").distinct(), "path-links")


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, digest, n_shingles, component_id and kept of every document; one row of each component is kept."""
    spark = docs.sparkSession
    rows = _sketch(docs, words, doc_id, text)
    full = rows.where("n_shingles > 0")
    classes = store.materialize(full.groupBy("k0", "k1").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("id"), F.min("doc_id").alias("doc_id"), F.min_by("digest", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("digest"), F.first("s0").alias("s0"), F.first("s1").alias("s1"), F.first("sig").alias("sig")), "path-classes")
    depth, trees = forest(classes.count(), percent / 100)
    nodes, parts = _nodes(classes, depth, trees), spark.createDataFrame([], "id long, component long")
    links: list[DataFrame] = []

    def sets_of(ids: DataFrame) -> DataFrame:
        return _set_table(docs, classes.join(ids, "id").select("id", "doc_id", "digest", "k0", "k1"), words, doc_id, text)

    def connect(found: DataFrame) -> DataFrame:
        links.append(found)
        return store.materialize(connected_components(reduce(DataFrame.unionByName, links)), "path-parts")

    for level in count():
        found = store.materialize(_compare(nodes), "path-pairs")
        pairs = store.materialize(_across(found.where("kind = 0").select("a", "b").distinct(), parts), "path-candidates")
        if not pairs.isEmpty():
            ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
            parts = connect(_confirm(pairs, sets_of(ends), percent))
        large = found.where("kind = 1").select(F.col("a").alias("node")).distinct()
        if large.isEmpty():
            break
        # a large node is done when its classes are one component; else those outside its largest one are compared with
        # all of it in blocks, or the node branches first where that is too many blocks
        members = nodes.join(large, "node").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
        members = store.materialize(members, "path-members")
        per = members.groupBy("node", "component").agg(F.count("*").alias("n"))
        state = per.groupBy("node").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("odd")).where("odd > 0")
        state = store.materialize(state.withColumn("few", (F.ceil(F.col("odd") / BLOCK) * F.ceil(F.col("all") / BLOCK) <= NODE_BLOCKS) | F.lit(level >= DEEPER)), "path-state")
        open_ = store.materialize(members.join(state.where("few"), "node"), "path-open")
        involved = _involved(_blocks(open_, []))
        if not involved.isEmpty():
            kept = open_.join(involved, "id", "left_semi").join(sets_of(involved), "id")
            parts = connect(_block_links(_blocks(kept, ["set"]), percent))
        many = state.where("not few")
        if many.isEmpty():
            break
        nodes = store.materialize(_branch_on(members.join(many.select("node"), "node").join(classes.select("id", "sig"), "id")), "path-deeper")
    named = classes.select("k0", "k1", "id", "doc_id").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = store.materialize(named, "path-named")
    first = store.materialize(named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min_by("id", F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("chosen")), "path-first")
    labels = store.materialize(named.select("k0", "k1", "component").join(first, "component").drop("component"), "path-labels")
    joined = full.select("row", "doc_id", "digest", "n_shingles", "k0", "k1").join(labels, ["k0", "k1"]).select("row", "doc_id", "digest", "n_shingles", "component_id", (F.col("row") == F.col("chosen")).alias("kept"))
    alone = rows.where("n_shingles = 0").select("row", "doc_id", "digest", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return joined.unionByName(alone)


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without all but one of each component; documents without words all stay."""
    found = near_components(docs, words, percent, doc_id, text)
    verdict = found.groupBy("doc_id", "digest").agg(F.sum(F.col("kept").cast("int")).alias("keep"), F.count("*").alias("n")).where("keep < n")
    verdict = store.materialize(verdict.select(F.col("doc_id").alias("v_id"), F.col("digest").alias("v_digest"), "keep"), "path-dropped")
    keyed = docs.select(docs[doc_id].alias("v_id"), F.xxhash64(docs[text]).alias("v_digest"), F.struct(*(docs[c] for c in docs.columns)).alias("doc"))
    keyed = marked(keyed, verdict, "v_id", "v_digest")
    v = verdict.toDF("d_id", "d_digest", "keep")
    touched = keyed.where("hit").join(v, keyed["v_id"].eqNullSafe(v["d_id"]) & (keyed["v_digest"] == v["d_digest"]), "left")
    # a row whose equals in id and text are kept fewer times than they occur stays that often
    again = F.row_number().over(Window.partitionBy("v_id", "v_digest").orderBy(F.lit(0)))
    stays = touched.where("keep is null or keep > 0").withColumn("nth", again).where("keep is null or nth <= keep")
    return stays.select("doc.*").unionByName(keyed.where("not hit").select("doc.*"))


def _branch_on(members: DataFrame) -> DataFrame:
    """The children of large nodes, by two independent branchings, so that no pair is the likelier lost the deeper it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = tb.text_column(batch.column(4))
            sig = body[at[0] : at[-1]].view(np.uint32).reshape(-1, POSITIONS)
            node = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, row = branch(np.concatenate([tb.mix64(node ^ k) for k in _AGAIN]), np.tile(np.arange(batch.num_rows), len(_AGAIN)), sig)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(batch.column(c).take(pa.array(row)) for c in (1, 2, 3))], names=["node", "id", "s0", "s1"])

    return members.select("node", "id", "s0", "s1", "sig").mapInArrow(run, "node long, id long, s0 long, s1 long").distinct()
