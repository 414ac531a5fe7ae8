"""Streams of documents and run events."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources import staging


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def stream_dedupe(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 day") -> DataFrame:
    """Drops deliveries of the same keys again within ``delay``; state is bounded by the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


#: Events after which a run is finished.
FINAL_EVENTS = ("completed", "failed", "partial_success")
RUN_STATE = "at long, event_id long, step string, event_type string, n_events long"
RUN_CHANGE = "run_id string, step string, event_type string, n_events long, n_new long, at long"


class RunState(StatefulProcessor):
    """Keeps each run's last event; a run that is finished is dropped once the watermark has passed its last event by ``delay``."""

    def __init__(self, delay: timedelta) -> None:
        self.delay = int(delay.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", RUN_STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.last.get() if self.last.exists() else None
        newest, n = before, 0
        for r in rows:
            n += 1
            if newest is None or (r.at, r.event_id) > (newest[0], newest[1]):
                newest = (r.at, r.event_id, r.step, r.event_type)
        total = (before[4] if before else 0) + n
        self.last.update((*newest[:4], total))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if newest[3] in FINAL_EVENTS:
            self.handle.registerTimer(max(newest[0] // 1000 + self.delay, timerValues.getCurrentWatermarkInMs() + 1))
        yield Row(run_id=key[0], step=newest[2], event_type=newest[3], n_events=total, n_new=n, at=newest[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_run_changes(events: DataFrame, delay: timedelta = timedelta(days=1), late: str = "1 hour") -> DataFrame:
    """A row for each run and micro-batch that has events of it: its last step and event, its events so far and those of the batch.

    State is one row a run and goes ``delay`` after a run's final event, by timers on event time; events that come later than
    ``late`` behind the newest are dropped. After that a run that goes on starts counting anew, so ``n_new`` adds up to all
    events while ``n_events`` is since the state was made. Rows without run or time have no state and are left out."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.where("run_id is not null and created_at is not null").select("run_id", "created_at", F.unix_micros("created_at").alias("at"), "event_id", "step", "event_type").withWatermark("created_at", late)
    changes = rows.groupBy("run_id").transformWithState(statefulProcessor=RunState(delay), outputStructType=RUN_CHANGE, outputMode="Update", timeMode="EventTime")
    return changes.select("run_id", "step", "event_type", "n_events", "n_new", F.timestamp_micros("at").alias("changed_at"))


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last state of every run from its changes, with all its events."""
    last = F.max_by(F.struct("step", "event_type"), F.struct("changed_at", "n_events"))
    return changes.groupBy("run_id").agg(last.alias("s"), F.sum("n_new").alias("n_events")).select("run_id", "s.step", "s.event_type", "n_events")


def stream_run_state(events: DataFrame) -> DataFrame:
    """Latest step and event type of every run, for update or complete mode."""
    last = F.max_by(F.struct("step", "event_type"), F.struct("created_at", "event_id"))
    return events.groupBy("run_id").agg(last.alias("s"), F.count("*").alias("n_events")).select("run_id", "s.step", "s.event_type", "n_events")


def stream_step_metrics(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events of each step in tumbling windows of event time, for update or append mode, in which windows that the watermark
    has passed leave the state (complete mode would keep all)."""
    w = events.withWatermark("created_at", delay).groupBy(F.window("created_at", width), "step")
    return w.agg(F.count("*").alias("n_events"), F.sum("value").alias("total_value")).select(F.col("window.start").alias("window_start"), "step", "n_events", "total_value")


def stream_documents(docs: DataFrame, process: Callable[[DataFrame], DataFrame], upsert: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Processes every new document once; ``upsert`` must give the same table when a batch is delivered again."""
    return docs.writeStream.foreachBatch(lambda batch, n: upsert(process(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last whole snapshot under ``path``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    last = max(int(s.getPath().getName().removeprefix("v=")) for s in found if s.getPath().getName().startswith("v="))
    return spark.read.parquet(f"{path}/v={last}")


def write_batches(stream: DataFrame, path: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Writes what each micro-batch gives to a snapshot of its own; in complete mode the last one holds everything."""
    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={n}")

    return stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What a stream in update mode wrote under ``path``, by the last micro-batch that has a row of the keys."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "v")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "v").alias("_last")).select(*keys, "_last.*")


class BucketedTable:
    """A table by key in hash buckets, of which an upsert rewrites only those its rows fall into.

    ``path``/data/v=N/bucket=K holds a bucket as batch N left it, ``path``/manifest/v=N (a row a bucket) says which version
    of each bucket is current after batch N. The manifest is written last and counts only when whole, so a batch that is
    delivered again, or half done, is done anew on what the batch before it left. ``buckets`` stays as it was at first."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _files(self, place: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _versions(self, part: str) -> list[int]:
        files, at = self._files(f"{self.path}/{part}")
        found = files.listStatus(at) if files.exists(at) else []
        names = [x.getPath().getName() for x in found]
        return sorted(int(n.removeprefix("v=")) for n in names if n.startswith("v=") and (part != "manifest" or files.exists(self._files(f"{self.path}/manifest/{n}/_SUCCESS")[1])))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> version after the last batch (before batch ``before``)."""
        done = [v for v in self._versions("manifest") if before is None or v < before]
        return dict(self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/v={done[-1]}").collect()) if done else {}  # a row a bucket

    def read(self, schema=None, only: list[int] | None = None, before: int | None = None) -> DataFrame | None:
        """The rows as the last batch left them; of some buckets if named; None without any."""
        places = [f"{self.path}/data/v={v}/bucket={k}" for k, v in self.manifest(before).items() if only is None or k in only]
        if not places:
            return None
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(*places)

    def upsert(self, rows: DataFrame, n: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Batch ``n``: ``merge(stored, rows)`` over the buckets that the rows fall into, the others stay as they are."""
        rows = staging.materialize(rows, "batch")
        touched = [r.bucket for r in rows.select(self.bucket().alias("bucket")).distinct().collect()]  # a row a bucket at most
        current = self.manifest(n)
        if touched:
            stored = self.read(rows.schema, touched, n)
            merged = merge(rows.limit(0) if stored is None else stored, rows).withColumn("bucket", self.bucket())
            merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={n}")
        after = sorted((current | dict.fromkeys(touched, n)).items())
        self.spark.createDataFrame(after, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={n}")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes versions of buckets that none of the last ``keep`` manifests names; returns the folders."""
        done = self._versions("manifest")
        used = {f"v={v}/bucket={k}" for m in done[-keep:] for k, v in self.spark.read.parquet(f"{self.path}/manifest/v={m}").collect()}
        gone = []
        for v in self._versions("data"):
            files, at = self._files(f"{self.path}/data/v={v}")
            for x in files.listStatus(at):
                name = f"v={v}/{x.getPath().getName()}"
                if x.getPath().getName().startswith("bucket=") and name not in used and done and v <= done[-1]:
                    files.delete(x.getPath(), True)
                    gone.append(name)
        return gone


def upsert_buckets(table: BucketedTable, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """An upsert for ``stream_documents`` into a bucketed table."""
    return lambda rows, n: table.upsert(rows, n, merge)
