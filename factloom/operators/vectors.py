"""Exact nearest vectors by cosine, with most comparisons ruled out by pivots.

At unit length cosine and distance order vectors alike, and distances obey the triangle inequality. Each vector is placed by
its nearest pivot and by the band of its distance to it; how near a cell (pivot, band) can come to a query follows from the
query's distance to the pivot alone. A query first searches its own cell and the two beside it. Its k-th best distance there
bounds what it still needs: only cells that can come as near are searched after that."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import staging

#: Pivots (of each length of vectors), bands of a pivot's distances from 0 to 2, vectors of a cell that a task holds at once.
PIVOTS, BANDS, CHUNK = 64, 16, 4096
#: Queries that a task compares at once with a chunk or with the pivots, and rows of what it gives at once.
ASKED, GIVEN = 128, 4096
#: What rounding may move a distance by.
SLACK = 1e-7


def _usable(rows: DataFrame, row_id: str, payload: str | None) -> DataFrame:
    """id, grp, dim and v in double precision of the rows that can be compared: with id (and payload) and a finite vector that is not zero."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    grp = F.col(payload).cast("string") if payload else F.lit("")
    rows = rows.select(F.col(row_id).alias("id"), grp.alias("grp"), v.alias("v")).where("id is not null and grp is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).select("id", "grp", F.size("v").alias("dim"), "v")


def _units(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """The vectors of least hash, ``pivots`` of each length, at unit length."""
    order = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id", "v")
    drawn = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= pivots).select("dim", "v").toArrow()
    out: dict[int, np.ndarray] = {}
    for dim in set(drawn.column("dim").to_pylist()):
        own = drawn.filter(pc.equal(drawn.column("dim"), dim)).column("v").combine_chunks()
        out[dim] = np.unique(_units(own, dim), axis=0)
    return out


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column(batch.schema.get_field_index("dim"))
    for dim in pc.unique(dims).to_pylist():
        yield dim, batch.filter(pc.equal(dims, dim))


def place(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """The rows at unit length, with pivot and band."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, batch in _by_dim(whole):
                x = _units(batch.column(3), dim)
                d = _distances(x, pivots[dim])
                nearest = d.argmin(1)
                band = np.minimum(d[np.arange(len(d)), nearest] * BANDS / 2, BANDS - 1).astype(np.int32)
                unit = pa.ListArray.from_arrays(np.arange(0, x.size + 1, dim, dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], unit, pa.array(nearest.astype(np.int32)), pa.array(band)], names=["id", "grp", "dim", "v", "pivot", "band"])

    return rows.mapInArrow(run, f"id {kind}, grp string, dim int, v array<double>, pivot int, band int")


def _best(ids: np.ndarray, x: np.ndarray, query_ids: list, q: np.ndarray, k: int, counter: Accumulator | None = None) -> Iterator[tuple]:
    """(query, id, cosine) of the best k of each query among unit vectors, ``ASKED`` queries at a time."""
    for start in range(0, len(q), ASKED):
        own = q[start : start + ASKED]
        for query, one, near in zip(query_ids[start : start + ASKED], own, own @ x.T, strict=True):
            other = ids != query
            if counter is not None:
                counter.add(int(other.sum()))
            if not other.any():
                continue
            near = np.where(other, near, -2.0)
            least = np.partition(near, -k)[-k] if len(near) > k else -1.5
            found = np.flatnonzero((near >= least - SLACK) & other)
            cosine = (x[found] * one).sum(1)  # summed alike wherever a vector stands, so equal vectors tie
            order = np.lexsort((ids[found], -cosine))[:k]
            yield from ((query, ids[found[i]], float(cosine[i])) for i in order)


def _compare(vectors: DataFrame, asked: DataFrame, k: int, counter: Accumulator | None) -> DataFrame:
    """(query_id, vec_id, cosine): the best k of a query in each chunk of the cells it is asked in.

    A chunk's vectors come first and are held, at most about ``CHUNK``; its queries stream past them."""
    key = ["grp", "dim", "pivot", "band", "chunk"]
    kind = asked.schema["id"].dataType.simpleString()
    both = vectors.select(*key, F.lit(0).alias("side"), "id", "v").unionByName(asked.select(*key, F.lit(1).alias("side"), "id", "v"))
    dealt = both.repartition(*key).sortWithinPartitions(*key, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, joined = None, [], [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            rows: list[tuple] = []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                *cell, side = keys[i]
                own = batch.column(7).slice(i, j - i).flatten().to_numpy(zero_copy_only=False).reshape(j - i, cell[1])
                if cell != now:
                    now, ids, held, joined = cell, [], [], None
                if side == 0:
                    ids += batch.column(6).slice(i, j - i).to_pylist()
                    held.append(own)
                elif held:
                    joined = joined or (np.array(ids), np.concatenate(held))
                    rows += _best(*joined, batch.column(6).slice(i, j - i).to_pylist(), own, k, counter)
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(6).type), pa.array([x.item() if hasattr(x, "item") else x for x in columns[1]], batch.column(6).type), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "cosine"])

    return dealt.mapInArrow(run, f"query_id {kind}, vec_id {kind}, cosine double")


def _within(batch: pa.RecordBatch, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The queries (id, grp, dim, v, bound) of one length, with each cell that can hold a vector within their bound; ``GIVEN`` rows at most at a time."""
    low, high = np.arange(BANDS) * 2 / BANDS, (np.arange(BANDS) + 1) * 2 / BANDS
    high[-1] = 2.1
    for start in range(0, batch.num_rows, ASKED):
        own = batch.slice(start, ASKED)
        d = _distances(own.column(3).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1), pivots)[:, :, None]
        bound = own.column(4).to_numpy(zero_copy_only=False)[:, None, None]
        row, pivot, band = (x.astype(np.int32) for x in np.nonzero(np.maximum(low - d, d - high) <= bound + SLACK))
        for i in range(0, len(row), GIVEN):
            taken = own.take(pa.array(row[i : i + GIVEN]))
            yield pa.RecordBatch.from_arrays([*taken.columns[:4], pa.array(pivot[i : i + GIVEN]), pa.array(band[i : i + GIVEN])], names=["id", "grp", "dim", "v", "pivot", "band"])


def _cells_within(queries: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """For each query (id, grp, dim, v, bound) the cells (pivot, band) that can hold a vector within its bound."""
    kind = queries.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, batch in _by_dim(whole):
                yield from _within(batch, pivots[dim])

    return queries.select("id", "grp", "dim", "v", "bound").mapInArrow(run, f"id {kind}, grp string, dim int, v array<double>, pivot int, band int")


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, payload: str | None = None, pivots: int = PIVOTS, counter: Accumulator | None = None) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k nearest vectors, within equal ``payload`` if one is named; ties by vec_id.

    Rows are vectors (vec_id, embedding) and queries (query_id, embedding); a vector of the query's own id is not a
    neighbour. Vectors that are null, empty, zero or hold null or non-finite components, and rows without id or payload,
    neither find nor are found; vectors of other lengths are not compared. Rows that repeat an id count as rows of their own as vectors,
    once as queries. ``counter`` adds up the comparisons.

    Cells of any size are cut into chunks, which are dealt over tasks; the pivots, and nothing else, go to all tasks."""
    rows = _usable(vectors, "vec_id", payload)
    chosen = choose_pivots(rows, pivots)
    asked = _usable(queries, "query_id", payload).dropDuplicates(["id"])
    asked = asked.where(F.col("dim").isin(*chosen)) if chosen else asked.where("false")
    cell = ["grp", "dim", "pivot", "band"]
    placed = staging.materialize(place(rows, chosen), "placed-vectors")
    cells = staging.materialize(placed.groupBy(*cell).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "vector-cells")
    held = placed.join(cells, cell).withColumn("chunk", F.pmod(F.xxhash64("id", "v"), F.col("chunks")).cast("int"))

    def into_chunks(wanted: DataFrame) -> DataFrame:
        return wanted.join(cells, cell).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    home = staging.materialize(place(asked, chosen), "placed-queries")
    near = home.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    first = staging.materialize(_compare(held, into_chunks(near), k, counter), "near-vectors")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.sqrt(F.greatest(2 - 2 * F.col("cosine"), F.lit(0.0))).alias("bound"))
    bounded = home.join(kth, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(2.1)))
    own = near.select("id", "pivot", "band")
    rest = _cells_within(bounded, chosen).join(own, ["id", "pivot", "band"], "left_anti")
    found = first.unionByName(_compare(held, into_chunks(rest), k, counter))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "cosine", "rank")
