"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only.

A line's key is the line stripped and with A-Z lower-cased; keys of at least ``LEAST_CHARS`` code points count. A run is a
table bucketed and sorted by the two 64-bit hashes of its keys: how many documents of the batch hold a key, and the largest
doc_id among them. ``LineRuns.add`` takes a batch: keys that the runs have settled (enough documents, so nothing that can
come changes them) are taken off by a merge anti join, which reads runs in order and does not shuffle them; the rest
becomes a run of level 0. When a level has ``FANOUT`` runs, they are merged into one of the next level and removed.

Batches are added from the largest ids to the smallest, so the first batch that holds a key holds its last document. With
all batches added, lines whose key stands in ``least_docs`` documents or more are dropped from all but the last of them.
Only hashes are shuffled to find them; texts move once, by document. Keys are told apart by 128 bits.

Rows of one doc_id are one document; a null doc_id is a document before all others. A null or empty text is one empty line.
Repeated rows get equal results, columns of any name are kept in ``row``, an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

LEAST_CHARS, LEAST_DOCS, BATCHES, FANOUT = 40, 5, 4, 2
BLANKS, UPPER, LOWER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
#: Starts the second hash, which is then one of another seed.
SALT = 7


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of all lines whose key is long enough."""
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("text_hash"), F.posexplode(F.split(docs[text], "\n")).alias("pos", "line"))
    # a key is no longer than its line, so short lines are left out before anything is done to them
    keyed = rows.where(F.length("line") >= least_chars).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= least_chars)
    return keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(SALT), "key").alias("h2"))


class LineRuns:
    """Runs by level, in tables under the shared folder; the driver holds their names alone."""

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.least_docs, self.fanout = spark, least_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        """A run of rows that are dealt by key into as many partitions as there are buckets, a file a bucket."""
        name, path = f"line_run_{uuid.uuid4().hex}", store.fresh(self.spark, "line-run")
        rows.select("h1", "h2", "n_docs", "last_doc").write.option("path", path).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append((name, path))

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """Runs as one, by full merge joins: counts added up, the last document kept. No union: Spark 4.1 takes one of bucketed
        tables for partitioned by their buckets, though its partitions hold one table's bucket each, and sums wrongly."""
        rows = self.spark.table(runs[0][0])
        for name, _ in runs[1:]:
            more = self.spark.table(name).withColumnsRenamed({"n_docs": "more", "last_doc": "later"}).hint("merge")
            rows = rows.join(more, KEY, "full").select(*KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc"))
        return rows

    @property
    def runs(self) -> list[tuple[str, str]]:
        return [r for level in self.levels for r in level]

    def settled(self) -> DataFrame:
        """(h1, h2, last_doc) of keys in enough documents, over all runs."""
        return self._merged(self.runs).where(F.col("n_docs") >= self.least_docs).select(*KEY, "last_doc")

    def unsettled(self, own: DataFrame) -> DataFrame:
        """Rows of a batch whose keys the runs do not have in enough documents: merge joins with each run in turn, then the anti condition."""
        rows = own.withColumn("before", F.lit(0).cast("long"))
        for name, _ in self.runs:
            held = self.spark.table(name).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("n_docs").alias("held")).hint("merge")
            rows = rows.join(held, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left").withColumn("before", F.col("before") + F.coalesce("held", F.lit(0))).drop("r1", "r2", "held")
        return rows.where(F.col("before") < self.least_docs).drop("before")

    def add(self, lines: DataFrame) -> None:
        """Adds the keys of a batch (doc_id, h1, h2), no document of which is in an earlier or a later one."""
        own = lines.select(*KEY, "doc_id").distinct().groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        self._write(self.unsettled(own.repartition(self.buckets, *KEY)), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self._write(self._merged(old).repartition(self.buckets, *KEY), level + 1)
            self.levels[level] = []
            self.remove(old)
            level += 1

    def remove(self, runs: list[tuple[str, str]]) -> None:
        """Takes merged runs out of the catalog and deletes their files."""
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def close(self) -> None:
        for level in self.levels:
            self.remove(level)
        self.levels = []


def batch_number(docs: DataFrame, doc_id: str, batches: int) -> Column:
    """0 for the largest ids, up to ``batches`` - 1 for the smallest and null, about equally many rows each."""
    number = F.lit(batches - 1)
    if batches > 1:
        bounds = docs.agg(F.percentile_approx(docs[doc_id], [1 - k / batches for k in range(1, batches)], 1000)).first()[0] or []
        for k, bound in reversed(list(enumerate(bounds))):
            number = F.when(F.col("doc_id") > bound, F.lit(k)).otherwise(number)
    return number


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, text_hash, dropped): sorted numbers of the lines that a document loses; documents that lose none are left out."""
    number = batch_number(docs, doc_id, batches)
    lines = store.materialize(lines_of(docs, doc_id, text, least_chars).withColumn("batch", number), "lines")
    runs = LineRuns(docs.sparkSession, least_docs)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k))
    frequent = store.materialize(runs.settled(), "frequent-lines")
    runs.close()
    hit = lines.join(frequent, KEY).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return hit.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def remove_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """row (all columns of docs), n_lines (before), n_dropped and kept, the lines that stay joined by newlines.

    What stays is cut out as the stretches between dropped lines, so its cost follows the text's length."""
    lost = dropped_lines(docs, doc_id, text, **options).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "dropped")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[doc_id].alias("_id"), F.xxhash64(docs[text]).alias("_hash"))
    rows = rows.join(lost, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left")
    rows = rows.withColumn("_lines", F.split(F.coalesce(F.col(f"row.`{text}`"), F.lit("")), "\n"))
    n = F.size("_lines")
    starts = F.concat(F.array(F.lit(0)), F.transform("dropped", lambda p: p + 1))
    ends = F.concat("dropped", F.array(n))
    stretches = F.zip_with(starts, ends, lambda a, b: F.slice("_lines", a + 1, b - a))
    kept = F.when(F.col("dropped").isNull(), F.coalesce(F.col(f"row.`{text}`"), F.lit(""))).otherwise(F.array_join(F.flatten(stretches), "\n"))
    return rows.select("row", n.cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def kept_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what stays."""
    out = remove_repeated_lines(docs.select(docs[doc_id], docs[text]), doc_id, text, **options)
    return out.select(F.col(f"row.`{doc_id}`").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
