"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Sources share a budget of words by weight; a target stops at a multiple of its source's size and the excess is shared
again, which is a water level found with two running sums over the sources. A document's expected copies are its source's
target over its size; whole copies are certain, and the rest f is the chance of one more. That last copy goes to the
documents of least u/(1-u) * (1-f)/f, for u drawn from a digest of the row, until their words meet what the whole copies
leave open. The place where they do is found by sums over buckets of the rank, twice, so that only the rows of one narrow
bucket a source are ever sorted.

Null and empty texts have size 0 and are never in demand; a null source is a source of its own, the last; equal rows have
equal ranks and are interchangeable; an empty table gives an empty result. Other columns are kept by ``mix`` on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

WEIGHTS = (3.0, 1.0, 2.0)
_BUCKETS = 1024
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, stop: float = 2.0) -> DataFrame:
    """target of each source of (source, source_size): one row a source in, one row a source out."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank + 1).cast("int")))
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share)).withColumn("most", F.col("source_size") * F.lit(stop))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.withColumn("full", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("budget") - F.col("full")) / F.col("left"))
    s = s.withColumn("level", F.max(F.when(F.col("most") / F.col("w") >= F.col("level"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.coalesce(F.least(F.col("most"), F.col("w") * F.col("level")), F.col("most")).alias("target"))


def document_draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of a digest of the row."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text.cast("binary"), F.lit(b"")))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def sample_copies(rows: DataFrame, targets: DataFrame, most: int = 2) -> DataFrame:
    """copies of every row of (row, source, size, u) for its source's target."""
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    t = targets.select(F.col("source").alias("src"), "source_size", "target", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("f"))
    t = t.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    # a row a source: sent to all tasks while they are few, else joined by source with skew left to the engine
    hint = F.broadcast if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else lambda d: d
    q = rows.join(hint(t), F.col("source").eqNullSafe(F.col("src"))).drop("src")
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("f")) / F.col("f"))
    q = q.withColumn("rank", F.when(F.col("f") > 0, odds / (1 + odds)))
    q = q.withColumn("b1", F.floor(F.col("rank") * _BUCKETS)).withColumn("b2", F.floor(F.col("rank") * _BUCKETS * _BUCKETS))

    def boundary(part: DataFrame, bucket: str, base: str | None) -> DataFrame:
        """The bucket of each source in which the words meet the need, and the words before it."""
        sums = part.groupBy("source", bucket).agg(F.sum("size").alias("words"), F.first("need").alias("need"), *([F.first(base).alias("base")] if base else [F.lit(0).alias("base")]))
        upto = Window.partitionBy("source").orderBy(bucket)
        sums = sums.withColumn("upto", F.col("base") + F.sum("words").over(upto))
        return sums.where(F.col("upto") > F.col("need")).groupBy("source").agg(F.min_by(F.struct(F.col(bucket).alias("edge"), (F.col("upto") - F.col("words")).alias("before")), F.col(bucket)).alias("e")).select(F.col("source").alias("src"), F.col("e.edge").alias(f"edge_{bucket}"), F.col("e.before").alias(f"before_{bucket}"))

    drawn = q.where("rank is not null")
    first = hint(boundary(drawn, "b1", None))
    q = q.join(first, q["source"].eqNullSafe(first["src"]), "left").drop("src")
    second = hint(boundary(q.where("b1 = edge_b1"), "b2", "before_b1"))
    q = q.join(second, q["source"].eqNullSafe(second["src"]), "left").drop("src")
    narrow = q.where("b1 = edge_b1 and b2 = edge_b2")
    order = Window.partitionBy("source").orderBy("rank", "row").rowsBetween(Window.unboundedPreceding, -1)
    narrow = narrow.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("before_b2"))
    plain = q.where("not coalesce(b1 = edge_b1 and b2 = edge_b2, false)")
    plain = plain.withColumn("more", F.when(F.col("rank").isNotNull() & (F.col("edge_b1").isNull() | (F.col("b1") < F.col("edge_b1")) | ((F.col("b1") == F.col("edge_b1")) & (F.col("edge_b2").isNull() | (F.col("b2") < F.col("edge_b2"))))), 1).otherwise(0))
    narrow = narrow.withColumn("more", F.when(F.col("before") + F.col("size") / 2 <= F.col("need"), 1).otherwise(0))
    kept = [*rows.columns, "source_size", "target", (F.col("whole") + F.col("more")).alias("copies")]
    return plain.select(*kept).unionByName(narrow.select(*kept))


def mix(docs: DataFrame, seed: int = 20, keep: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", text: str = "text", source: str = "source", **shares) -> DataFrame:
    """``keep`` columns with size, source_size, target, copies and taken of every document."""
    carried = [docs[c].alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*carried, docs[source].alias("source"), word_count(docs[text]).alias("size"), document_draw(docs[doc_id], docs[text], seed).alias("u"))
    rows = store.materialize(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "mix-rows")
    targets = store.materialize(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), **shares), "mix-targets")
    sampled = sample_copies(rows, targets)
    return sampled.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_copies(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents' own rows, each as often as it is taken."""
    mixed = mix(docs, keep=tuple(docs.columns), **options)
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)
