"""Embedding near-dedup over a robust-pruned flat graph.

Vectors are compared only within a label. Vectors are scaled by powers of two; equal ones form a class. Classes are dealt to overlapping cluster shards of
bounded size: a group above the bound is split around pivots drawn from it, and a class between two pivots goes to both,
until every group fits. A group above the bound whose pivots are all near each other, or that splitting hardly made
smaller, is dense: splitting it would part neighbours, so all its pairs are compared, in blocks of bounded size spread over
tasks. For the others a task builds the graph of a shard - each class linked to near ones, but not to one that a nearer
neighbour already covers - and the adjacency lists of all shards are united. Every class then searches the united graph:
greedily with a beam from the medoid of each of its shards, then on through all neighbours in range; where a class in range
also stands in a shard that the query does not, the query goes on from it there as a guest, until no query enters a new
shard. Found pairs are confirmed by their cosine in double precision and hold for both ends. An audit compares a bounded
set of classes in shards with all rows of their labels and, while its recall is below the target, shards around other
pivots are added to the graph. If the last audit is still below it, every label is compared in blocks, whole.

Comparisons in blocks give each class its number of links and the block's classes a spanning forest, never a row a pair.

Vectors that are null, empty, zero or hold null or not finite components, and vectors without label or id, link with
nothing and keep their own id as component (null stays null). Vectors of one label but different lengths are never
compared. Rows with equal vectors link without being expanded into pairs; rows that repeat an id count as vectors of
their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .components import connected_components

SHARD = 1500
PIVOTS = 16
TOO_NEAR = 0.8
HARDLY = 0.9
BLOCK = 1024
DEGREE, CANDIDATES, BEAM, ALPHA = 24, 64, 32, 1.2
MARGIN = 0.15
AUDIT = 128
EXPAND = 8192
GUESTS = 1500  # queries that enter a shard together
WALK = 0.04  # guests also pass through nodes so little out of range


def classes_of(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows as vec_id, grp, v; classes as id, grp, v, n). ``v`` is the vector in double precision, scaled.

    Scaling is by the power of two that brings the greatest component near one: it changes no cosine, loses no bit, and keeps
    squares of very small and very large vectors in range. A generator keeps Spark from working the factor out again for
    every component."""
    e = F.transform(embedding, lambda x: x.cast("double"))
    fine = F.col(label).isNotNull() & F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()
    rows = vectors.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.struct(F.col(label).alias("label"), F.size(embedding).alias("dim")).alias("grp"), e.alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    size = F.log2(F.array_max(F.transform("v", F.abs)))
    rows = _once(rows, factor=F.pow(F.lit(2.0), -F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), F.floor(size).cast("double")))))
    rows = rows.select("vec_id", "grp", F.transform("v", lambda x: x * F.col("factor")).alias("v"))
    classes = rows.groupBy("grp", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    return rows, store.materialize(classes.select("id", F.xxhash64("grp").alias("grp"), "v", "n"), "graph-classes")


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """The rows with columns that are computed once a row."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _units(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, at unit length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def deal_shards(classes: DataFrame, seed: int, shard: int = SHARD) -> DataFrame:
    """gid, id, v of every class in each of its shards; ``dense`` marks groups above the bound that must not be split."""
    waiting = classes.select(F.xxhash64(F.lit(seed), "grp").alias("gid"), "id", "v", F.lit(None).cast("long").alias("above"))
    done: DataFrame | None = None
    for level in range(24):
        sizes = store.materialize(waiting.groupBy("gid").agg(F.count("*").alias("size"), F.max("above").alias("above")), "graph-sizes")
        stuck = (F.col("size") > shard) & F.coalesce(F.col("size") > HARDLY * F.col("above"), F.lit(False))
        settled = sizes.where((F.col("size") <= shard) | stuck).select("gid", stuck.alias("dense"))
        own = waiting.join(settled, "gid").select("gid", "id", "v", "dense")
        done = own if done is None else done.unionByName(own)
        big = sizes.where((F.col("size") > shard) & ~stuck).select("gid", "size")
        if big.isEmpty():
            break
        members = waiting.drop("above").join(big, "gid")
        draw = F.xxhash64(F.lit(seed), F.lit(level), "id")
        # about four times as many rows as pivots, by chance, so that choosing them gathers a bounded number of rows
        drawn = members.where(F.pmod(draw, F.lit(1 << 30)) < F.lit(float(4 * PIVOTS * (1 << 30))) / F.col("size"))
        pivots = drawn.groupBy("gid").agg(F.slice(F.array_sort(F.collect_list(F.struct(draw.alias("draw"), F.col("id").alias("pivot"), F.col("v").alias("pv")))), 1, PIVOTS).alias("p"))
        # one pivot for vectors that are near each other, so that a dense group stays together; one in all: all of it is dense
        spread = F.aggregate("p", F.slice("p", 1, 1), lambda kept, x: F.when(F.exists(kept, lambda y: _cosine(y["pv"], x["pv"]) >= TOO_NEAR), kept).otherwise(F.concat(kept, F.array(x))))
        pivots = pivots.withColumn("p", spread).select("gid", F.explode("p").alias("p"), (F.size("p") == 1).alias("dense")).select("gid", "p.pivot", "p.pv", "dense")
        pivots = store.materialize(pivots, "graph-pivots")
        done = done.unionByName(members.join(pivots.where("dense").select("gid", "dense"), "gid").select("gid", "id", "v", "dense"))
        waiting = store.materialize(_nearest(members, pivots.where("not dense")), "graph-level")
    else:
        done = done.unionByName(waiting.select("gid", "id", "v", F.lit(True).alias("dense")))
    return store.materialize(done, "graph-shards")


def _cosine(a: Column, b: Column) -> Column:
    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _nearest(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """Every member under its nearest pivot of its group, and under the second one if that is about as near; ``above`` is the group's size."""
    m = members.join(pivots, "gid").select("gid", "id", "pivot", _cosine(F.col("v"), F.col("pv")).alias("c"))
    two = m.groupBy("gid", "id").agg(F.max(F.struct("c", "pivot")).alias("one"), F.collect_list(F.struct("c", "pivot")).alias("all"))
    second = F.array_max(F.filter("all", lambda x: x["pivot"] != F.col("one.pivot")))
    chosen = F.filter(F.array(F.col("one"), second), lambda x: x.isNotNull() & (x["c"] >= F.col("one.c") - MARGIN))
    placed = two.select("gid", "id", F.explode(F.transform(chosen, lambda x: x["pivot"])).alias("pivot"))
    return placed.join(members, ["gid", "id"]).select(F.xxhash64("gid", "pivot").alias("gid"), "id", "v", F.col("size").alias("above"))


def pruned_graph(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each unit vector: nearest first, skipping what a chosen neighbour covers, and the reverse links."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    s = x @ x.T
    np.fill_diagonal(s, -2)
    width = min(CANDIDATES, n - 1)
    near = np.argpartition(-s, width - 1, axis=1)[:, :width]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
    away = 2 - 2 * np.take_along_axis(s, near, 1)
    alive, every = np.ones(near.shape, bool), np.arange(n)
    source, target = [], []
    for _ in range(DEGREE):
        any_left = alive.any(1)
        if not any_left.any():
            break
        at = alive.argmax(1)
        pick = near[every, at]
        source.append(every[any_left])
        target.append(pick[any_left])
        between = 2 - 2 * s[pick[:, None], near]
        alive &= (ALPHA * between > away) & any_left[:, None]
        alive[every, at] = False
    a, b = np.concatenate(source), np.concatenate(target)
    code = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.split(code % n, np.searchsorted(code // n, np.arange(1, n)))


def build(shards: DataFrame) -> DataFrame:
    """id and neighbours, united over all shards of a class."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        lists = pruned_graph(_units(table.column("v")))
        return pa.table({"id": ids, "nbrs": pa.array([ids[k] for k in lists], pa.list_(pa.int64()))})

    lists = shards.where("not dense").groupBy("gid").applyInArrow(run, "id long, nbrs array<long>")
    return store.materialize(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs")), "graph-lists")


def search_all(x: np.ndarray, lists: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, found) of all pairs in range that searches for every vector meet; ``lists`` is padded with -1."""
    n = len(x)
    seen = np.zeros((n, n), bool)
    every = np.arange(n)
    medoid = int(np.argmax(x @ x.mean(0)))
    beam = np.full((n, BEAM), -1)
    score = np.full((n, BEAM), -np.inf)
    open_ = np.zeros((n, BEAM), bool)
    beam[:, 0], score[:, 0], open_[:, 0] = medoid, x @ x[medoid], True
    seen[:, medoid] = True
    inside: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbours not yet seen of node at[k] for query q[k], with their cosine."""
        nodes = lists[at]
        q = np.repeat(q, lists.shape[1])
        nodes = nodes.ravel()
        q, nodes = q[nodes >= 0], nodes[nodes >= 0]
        fresh = ~seen[q, nodes]
        code = np.unique(q[fresh] * n + nodes[fresh])
        q, nodes = code // n, code % n
        seen[q, nodes] = True
        c = np.einsum("ij,ij->i", x[q], x[nodes])
        good = c >= threshold
        inside.append((q[good], nodes[good]))
        return q, nodes, c

    start = score[:, 0] >= threshold
    inside.append((every[start], np.full(int(start.sum()), medoid)))
    if lists.shape[1]:
        while open_.any():
            q = np.flatnonzero(open_.any(1))
            best = np.where(open_[q], score[q], -np.inf).argmax(1)
            at = beam[q, best]
            open_[q, best] = False
            qs, nodes, c = meet(q, at)
            if not len(qs):
                continue
            new = np.bincount(qs, minlength=n)
            place = np.arange(len(qs)) - np.repeat(np.cumsum(new) - new, new)
            room = np.full((n, int(new.max())), -1)
            room_score = np.full(room.shape, -np.inf)
            room[qs, place], room_score[qs, place] = nodes, c
            own = np.flatnonzero(new)
            nodes2 = np.concatenate([beam[own], room[own]], 1)
            score2 = np.concatenate([score[own], room_score[own]], 1)
            open2 = np.concatenate([open_[own], room[own] >= 0], 1)
            keep = np.argsort(-score2, axis=1, kind="stable")[:, :BEAM]
            beam[own], score[own], open_[own] = (np.take_along_axis(y, keep, 1) for y in (nodes2, score2, open2))
        # range expansion: every node in range passes the search on to its neighbours
        q, nodes = (np.concatenate(y) for y in zip(*inside, strict=True))
        while len(q):
            more: list[tuple[np.ndarray, np.ndarray]] = []
            for k in range(0, len(q), EXPAND):  # a dense shard has very many pairs in range at once
                qs, found, c = meet(q[k : k + EXPAND], nodes[k : k + EXPAND])
                more.append((qs[c >= threshold], found[c >= threshold]))
            q, nodes = (np.concatenate(y) for y in zip(*more, strict=True))
    q, nodes = (np.concatenate(y) for y in zip(*inside, strict=True))
    return q, nodes


def _padded(ids: np.ndarray, lists: pa.ChunkedArray) -> np.ndarray:
    """Neighbours as places in the sorted ``ids``, those that are not among them left out; filled up with -1."""
    column = lists.combine_chunks()
    flat, of = column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
    here = ids[at] == flat
    at, of = at[here], of[here]
    count = np.bincount(of, minlength=len(ids))
    out = np.full((len(ids), int(count.max()) if len(ids) else 0), -1)
    out[of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)] = at
    return out


def search(shards: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b), b < a, of classes in range that searches from the medoids of their shards meet."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, x = table.column("id").to_numpy(), _units(table.column("v"))
        q, found = search_all(x, _padded(ids, table.column("nbrs")), threshold)
        q, found = q[q != found], found[q != found]
        pairs = np.unique(np.stack([np.maximum(ids[q], ids[found]), np.minimum(ids[q], ids[found])], 1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    joined = shards.where("not dense").join(lists, "id").select("gid", "id", "v", "nbrs")
    return store.materialize(joined.groupBy("gid").applyInArrow(run, "a long, b long").distinct(), "graph-pairs")


def expand_from(x: np.ndarray, lists: np.ndarray, guests: np.ndarray, entry: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(guest, node) of all nodes in range that guests meet on their way from their entries through nodes about in range."""
    seen = np.zeros((len(guests), len(x)), bool)
    q, nodes = np.repeat(np.arange(len(guests)), entry.shape[1]), entry.ravel()
    q, nodes = q[nodes >= 0], nodes[nodes >= 0]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(q):
        more: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(0, len(q), EXPAND):
            code = np.unique(q[k : k + EXPAND] * len(x) + nodes[k : k + EXPAND])
            who, at = code // len(x), code % len(x)
            fresh = ~seen[who, at]
            who, at = who[fresh], at[fresh]
            seen[who, at] = True
            c = np.einsum("ij,ij->i", guests[who], x[at])
            found.append((who[c >= threshold], at[c >= threshold]))
            who, at = who[c >= threshold - WALK], at[c >= threshold - WALK]
            following = lists[at]
            who, following = np.repeat(who, lists.shape[1]), following.ravel()
            who, following = who[following >= 0], following[following >= 0]
            fresh = ~seen[who, following]
            more.append((who[fresh], following[fresh]))
        q, nodes = (np.concatenate(y) for y in zip(*more, strict=True))
    return tuple(np.concatenate([*(f[i] for f in found), np.zeros(0, np.int64)]) for i in range(2))


def walk_on(shards: DataFrame, lists: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs and those that searches find which go on into the other shards of classes in range."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        own, guest = table.filter(pa.compute.is_null(table.column("entry"))), table.filter(pa.compute.is_valid(table.column("entry")))
        if not own.num_rows or not guest.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        ids, x = own.column("id").to_numpy(), _units(own.column("v"))
        asked, entry = guest.column("id").to_numpy(), np.searchsorted(ids, np.stack([guest.column(c).to_numpy() for c in ("entry", "other")], 1))
        q, found = expand_from(x, _padded(ids, own.column("nbrs")), _units(guest.column("v")), entry, threshold)
        p, q = asked[q], ids[found]
        p, q = p[p != q], q[p != q]
        both = np.unique(np.stack([np.maximum(p, q), np.minimum(p, q)], 1), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    members = store.materialize(shards.where("not dense").join(lists, "id").select("gid", "id", "v", "nbrs"), "graph-members")
    stands = members.select("gid", "id").distinct()
    vectors = members.select("id", "v").dropDuplicates(["id"])
    visited, new = stands, pairs
    while True:
        both = new.unionByName(new.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # both ends of what a query enters a shard by; classes in dense groups alone are not in the graph
        enters = both.join(stands.withColumnRenamed("id", "b"), "b").groupBy("gid", F.col("a").alias("id")).agg(F.min("b").alias("entry"), F.max("b").alias("other"))
        guests = store.materialize(enters.join(visited, ["gid", "id"], "left_anti").join(vectors, "id"), "graph-guests")
        if guests.isEmpty():
            return pairs
        visited = store.materialize(visited.unionByName(guests.select("gid", "id")), "graph-visited")
        chunks = store.materialize(guests.groupBy("gid").agg(F.ceil(F.count("*") / GUESTS).alias("chunks")), "graph-chunks")
        none = F.lit(None)
        asked = guests.join(chunks, "gid").select("gid", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"), "id", "v", none.cast("array<long>").alias("nbrs"), "entry", "other")
        hosts = members.join(chunks, "gid").select("gid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "id", "v", "nbrs", none.cast("long").alias("entry"), none.cast("long").alias("other"))
        found = asked.unionByName(hosts).groupBy("gid", "chunk").applyInArrow(run, "a long, b long").distinct()
        new = store.materialize(found.join(pairs, ["a", "b"], "left_anti"), "graph-pairs")
        pairs = pairs.unionByName(new)


def spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (ids of rows, ids of columns) that connect whatever the matrix connects: steps of the least id through it."""
    label = {"l": left.copy(), "r": right.copy()}
    a, b = [], []
    moved = True
    while moved:
        moved = False
        for matrix, own, other, ids, far in ((near, "l", "r", left, right), (near.T, "r", "l", right, left)):
            seen = np.where(matrix, label[other][None, :], np.iinfo(np.int64).max)
            at = seen.argmin(1)
            least = seen[np.arange(len(ids)), at]
            lower = np.flatnonzero(least < label[own])
            if len(lower):
                a.append(ids[lower])
                b.append(far[at[lower]])
                label[own][lower] = least[lower]
                moved = True
    return tuple(np.concatenate([*x, np.zeros(0, np.int64)]) for x in (a, b))


def block_links(groups: DataFrame, threshold: float) -> DataFrame:
    """id, others (rows linked) and link of all pairs in range within each group (gid, id, v, n, gids).

    A task holds two blocks of a group. Pairs that stand together in several groups count in that of least gid alone."""

    def run(table: pa.Table) -> pa.Table:
        ids, own, n, x = *(table.column(c).to_numpy() for c in ("id", "own", "n")), _units(table.column("v"))
        gid, same = table.column("gid")[0].as_py(), table.column("lo")[0] == table.column("hi")[0]
        left, right = np.flatnonzero(own == table.column("lo")[0].as_py()), np.flatnonzero(own == table.column("hi")[0].as_py())
        near = x[left] @ x[right].T >= threshold
        if same:
            np.fill_diagonal(near, False)
        groups_of = table.column("gids").to_pylist()
        for h in {g for gs in groups_of for g in gs if g < gid}:
            inside = np.array([h in gs for gs in groups_of])
            near[np.ix_(inside[left], inside[right])] = False
        sides = [(ids[left], near @ n[right])] if same else [(ids[left], near @ n[right]), (ids[right], n[left] @ near)]
        a, b = spanning(near, ids[left], ids[right])
        who, total = (np.concatenate(y) for y in zip(*sides, strict=True))
        who, total = who[total > 0], total[total > 0]
        return pa.table({"id": np.concatenate([who, a]), "others": np.concatenate([total, np.zeros(len(a), np.int64)]).astype(np.int64), "link": pa.array(np.concatenate([who, b]))})

    blocks = groups.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = groups.join(store.materialize(blocks, "graph-blocks"), "gid").withColumn("own", F.pmod(F.xxhash64(F.lit(9), "id"), F.col("blocks")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("gid", "id", "v", "n", "gids", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return store.materialize(rows.groupBy("gid", "lo", "hi").applyInArrow(run, "id long, others long, link long"), "graph-blocks")


def together(pairs: DataFrame, dense: DataFrame) -> DataFrame:
    """The pairs whose ends stand in one dense group."""
    stands = dense.select("gid", "id").distinct()
    first = pairs.join(stands.withColumnRenamed("id", "a"), "a")
    return first.join(stands.withColumnRenamed("id", "b"), ["b", "gid"], "left_semi").select("a", "b").distinct()


def exact_pairs(classes: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """Pairs of each of a bounded set of classes with all classes of its label, by comparing blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids, groups = _units(batch.column(2)), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            a, b = [], []
            for qid, grp, v in asked:
                c = np.flatnonzero((groups == grp) & (ids != qid))
                c = c[x[c] @ v >= threshold] if len(c) else c
                a += [qid] * len(c)
                b += ids[c].tolist()
            both = np.array([a, b], np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(both.max(0) if len(a) else both[0]), pa.array(both.min(0) if len(a) else both[1])], names=["a", "b"])

    asked = []
    for r in queries.collect():  # AUDIT rows at most
        v = np.array(r.v)
        v = v / np.abs(v).max()
        asked.append((r.id, r.grp, v / np.sqrt((v * v).sum())))
    parts = [classes.where(F.size("v") == d).select("id", "grp", "v").mapInArrow(run, "a long, b long") for d in sorted({len(v) for _, _, v in asked})]
    out = parts[0] if parts else classes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def audit_recall(classes: DataFrame, pairs: DataFrame, threshold: float, seed: int = 5, among: DataFrame | None = None, exact: DataFrame | None = None) -> float:
    """Share of the exact pairs of ``AUDIT`` classes (of ``among``) that were found; classes with pairs first, else by chance.

    ``exact``: dense groups, whose own pairs were compared whole and are left out."""
    among = classes if among is None else among
    linked = pairs.select(F.col("a").alias("id")).distinct()
    half = among.join(linked, "id", "left_semi").orderBy(F.xxhash64(F.lit(seed), "id")).limit(AUDIT // 2)
    queries = half.unionByName(among.orderBy(F.xxhash64(F.lit(seed + 1), "id")).limit(AUDIT // 2)).dropDuplicates(["id"])
    wanted = store.materialize(exact_pairs(classes, store.materialize(queries.select("id", "grp", "v"), "graph-audit"), threshold), "graph-exact")
    if exact is not None:
        wanted = store.materialize(wanted.join(together(wanted, exact), ["a", "b"], "left_anti"), "graph-exact")
    total = wanted.count()
    return wanted.join(pairs, ["a", "b"], "left_semi").count() / total if total else 1.0


def near_links(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.98, rounds: int = 4, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows, classes = classes_of(vectors, vec_id, embedding, label)
    sizes = classes.select("id", "n")
    shards = lists = blocks = None
    for k in range(rounds):
        more = deal_shards(classes, seed=101 + k)
        own = build(more)
        shards = more if shards is None else store.materialize(shards.unionByName(more), "graph-shards")
        lists = own if lists is None else store.materialize(lists.unionByName(own).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs")), "graph-lists")
        pairs = walk_on(shards, lists, search(shards, lists, threshold), threshold)
        dense = shards.where("dense")
        crowded = not dense.isEmpty()
        if audit_recall(classes, pairs, threshold, among=classes.join(shards.where("not dense"), "id", "left_semi"), exact=dense if crowded else None) >= recall:
            if crowded:
                pairs = store.materialize(pairs.join(together(pairs, dense), ["a", "b"], "left_anti"), "graph-pairs")
                own_groups = dense.groupBy("id").agg(F.sort_array(F.collect_set("gid")).alias("gids"))
                blocks = block_links(dense.dropDuplicates(["gid", "id"]).select("gid", "id", "v").join(own_groups, "id").join(sizes, "id"), threshold)
            break
    else:
        pairs = classes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
        blocks = block_links(classes.select(F.col("grp").alias("gid"), "id", "v", "n", F.expr("cast(array() as array<long>)").alias("gids")), threshold)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(sizes.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), F.col("n").alias("others"))
    if blocks is not None:
        linked = linked.unionByName(blocks.select("id", "others"))
        pairs = pairs.unionByName(blocks.where("id <> link").select(F.col("id").alias("a"), F.col("link").alias("b")))
    linked = linked.groupBy("id").agg(F.sum("others").alias("others"))
    parts = connected_components(pairs)
    facts = classes.join(linked, "id", "left").join(parts, "id", "left").select("grp", "v", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    facts = store.materialize(facts, "graph-facts")
    good = rows.select("vec_id", F.xxhash64("grp").alias("grp"), "v").join(facts, ["grp", "v"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    e = F.transform(embedding, lambda x: x.cast("double"))
    whole = F.col(label).isNotNull() & F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    rest = vectors.where(~F.coalesce(whole, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(vec_id).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return good.unionByName(rest)
