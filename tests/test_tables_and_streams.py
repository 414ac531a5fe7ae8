"""Upserts with maps and by buckets, run state with timers, sketches and totals."""

import datetime as dt

import numpy as np
from factloom.operators import prefilter, records
from factloom.plans import document_queries
from factloom.streaming import streams
from pyspark.sql import functions as F

CHUNK = "run_id string, chunk_hash string, seq long, id long, text string, facts map<string,double>"


def test_upserts_take_maps(spark, sf):
    stored = spark.createDataFrame([("r", "h1", 1, 10, "old", {"a": 1.0}), ("r", None, 1, 11, "null key", None)], CHUNK)
    new = spark.createDataFrame([("r", "h1", 5, 12, "new", {"a": 2.0}), ("r", "h1", 5, 13, "newer", {"b": 3.0}), ("r", "h2", 2, 14, "own", {}), ("r", None, 2, 15, "again", {"x": None})], CHUNK)
    got = {r.chunk_hash: (r.id, r.text, r.facts) for r in records.upsert_chunks(stored, new).collect()}
    assert got == {"h1": (10, "newer", {"b": 3.0}), "h2": (14, "own", {}), None: (11, "again", {"x": None})}
    scored = prefilter.score_chunks(document_queries.turns(spark, sf)).select("run_id", F.col("chunk_id").alias("chunk_hash"), F.col("chunk_index").alias("seq"), F.col("chunk_index").alias("id"), "match_counts", "feature_breakdown")
    assert records.upsert_chunks(scored.limit(0), scored).count() == scored.select("run_id", "chunk_hash").distinct().count()
    versions = spark.createDataFrame([(1, 2, {"a": 1}), (1, 2, {"b": 1}), (1, 1, None)], "document_id long, version_number long, meta map<string,int>")
    assert records.latest_version(versions).collect()[0].meta == {"b": 1}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    table = streams.BucketedTable(spark, str(tmp_path / "t"), ["run_id", "chunk_hash"], 8)
    rows = lambda ids, text: spark.createDataFrame([(f"r{i}", "h", i, i, text, {"n": float(i)}) for i in ids], CHUNK)
    assert table.read() is None
    table.upsert(rows(range(60), "one"), 0, records.upsert_chunks)
    before = {r.run_id: r.f for r in table.read().select("run_id", F.input_file_name().alias("f")).collect()}
    table.upsert(rows([3, 100], "two"), 1, records.upsert_chunks)
    after = {r.run_id: (r.text, r.f) for r in table.read().select("run_id", "text", F.input_file_name().alias("f")).collect()}
    touched = {r.b for r in rows([3, 100], "").select(table.bucket().alias("b")).collect()}
    bucket = {r.run_id: r.b for r in table.read().select("run_id", table.bucket().alias("b")).collect()}
    assert len(after) == 61 and after["r3"][0] == after["r100"][0] == "two" and after["r5"][0] == "one"
    for run, name in before.items():
        assert (after[run][1] == name) == (bucket[run] not in touched)
    table.upsert(rows([3, 100], "two"), 1, records.upsert_chunks)  # delivered again
    assert {r.run_id: r.text for r in table.read().collect()} == {k: v[0] for k, v in after.items()}
    table.upsert(rows([], ""), 2, records.upsert_chunks)
    assert table.read().count() == 61
    gone = table.vacuum(keep=1)
    assert sorted(gone) == sorted(f"v=0/bucket={k}" for k in touched if k in {bucket[r] for r in before}) and table.read().count() == 61


def test_run_state_is_dropped_after_its_delay(spark, tmp_path):
    at = lambda day, hour=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)
    schema = "run_id string, created_at timestamp, event_id long, step string, event_type string"
    batches = [
        [("a", at(0), 1, "parse", "started"), ("a", at(0, 1), 2, "parse", "completed"), ("b", at(0), 3, "parse", "started"), (None, at(0), 9, "x", "started"), ("z", None, 9, "x", "started")],
        [("b", at(5), 4, "chunk", "started"), ("c", at(5), 5, "parse", "failed")],
        [("b", at(9), 6, "chunk", "started")],
        [("a", at(9, 2), 7, "parse", "started")],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        (tmp_path / "in" / f"b{k}" / "_SUCCESS").unlink()
    seen, held = [], []
    stream = streams.read_stream(spark, str(tmp_path / "in" / "*"), schema, files_per_trigger=1)
    changes = streams.stream_run_changes(stream, dt.timedelta(days=1), "1 hour")
    query = changes.writeStream.foreachBatch(lambda df, n: seen.append({r.run_id: (r.step, r.event_type, r.n_events, r.n_new) for r in df.collect()})).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    found = [s for s in seen if s]
    assert found == [{"a": ("parse", "completed", 2, 2), "b": ("parse", "started", 1, 1)}, {"b": ("chunk", "started", 2, 1), "c": ("parse", "failed", 1, 1)}, {"b": ("chunk", "started", 3, 1)}, {"a": ("parse", "started", 1, 1)}]
    assert max(held) > min(held[1:]) and held[-1] <= max(held)  # a and c went when the watermark passed them by a day
    every = spark.createDataFrame([(run, *v, at(0)) for s in found for run, v in s.items()], "run_id string, step string, event_type string, n_events long, n_new long, changed_at timestamp")
    assert {r.run_id: r.n_events for r in streams.latest_changes(every).collect()} == {"a": 3, "b": 3, "c": 1}


def test_sketches_merge_within_their_error(spark):
    rng = np.random.default_rng(1)
    values = np.exp(rng.normal(3, 1, 20_000))
    rows = spark.createDataFrame([("s", int(k % 24), float(v)) for k, v in enumerate(values)] + [("one", 0, 5.0), ("one", 1, None)], "step string, hour int, latency_ms double")
    parts = records.latency_sketches(rows, ("step", "hour"), 200)
    q = {r.step: r for r in records.sketch_quantiles(records.merge_sketches(parts), (0.5, 0.95, 0.999)).collect()}
    s = q["s"]
    assert (s.n, s.least, s.greatest) == (20_000, values.min(), values.max()) and abs(s.mean - values.mean()) < 1e-6
    for p, got in ((0.5, s.p50), (0.95, s.p95), (0.999, s.p99_9)):
        assert abs((values <= got).mean() - p) < 0.03
    assert (q["one"].n, q["one"].p50, q["one"].p95) == (1, 5.0, 5.0)
    assert records.sketch_quantiles(records.merge_sketches(parts.limit(0))).collect() == []


def test_totals_of_runs_and_calls(spark):
    e = spark.createDataFrame([("a", "parse", "failed"), ("a", "parse", "retried"), ("a", "validate", "failed"), ("b", "chunk", "failed"), (None, "parse", "started")], "run_id string, step string, event_type string")
    calls = spark.createDataFrame([("a", 10, 1), ("a", 20, None)], "run_id string, input_tokens long, output_tokens long")
    r = records.run_totals(e, calls).first()
    assert (r.n_runs, r.n_events, r.n_parse_failures, r.n_validation_failures, r.n_calls, r.n_input_tokens, r.n_output_tokens) == (3, 5, 1, 1, 2, 30, 1)
    assert r.mean_events == 5 / 3 and r.mean_calls == 2 / 3
    none = records.run_totals(e.limit(0)).first()
    assert none.n_runs == none.n_events == 0 and none.mean_events is None
