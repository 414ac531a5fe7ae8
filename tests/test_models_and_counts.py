"""Counting of paths against their enumeration; models keyed by file, there and back."""

import json

import numpy as np
import pytest
from factloom.operators import graph, paths
from factloom.plans import queries
from factloom.sources import ingest, staging
from pyspark.sql import functions as F

MODEL = "run_id string, action string, init_states array<string>, final_states array<string>, b_value int"


def counted(spark, rows, targets=None):
    m = spark.createDataFrame(rows, MODEL)
    t = spark.createDataFrame(targets or [(r[0], r[1]) for r in rows], "run_id string, target string")
    got = {(r.run_id, r.target): int(r.n_paths) for r in paths.count_paths(m, t, staging.materialize).collect()}
    want = {(r.run_id, r.target): r.n for r in paths.enumerate_paths(m, t, save=staging.materialize).groupBy("run_id", "target").agg(F.count("*").alias("n")).collect()}
    return got, want


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_equal_the_enumeration(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for run in range(12):  # some with cycles, states without producer and actions that many paths share
        n = int(rng.integers(2, 8))
        for a in range(n):
            needs = sorted({f"s{int(x)}" for x in rng.integers(0, n if run % 3 else max(a, 1), int(rng.integers(0, 3)))}) if a or run % 3 else []
            rows.append((f"r{run}", f"a{a}", needs, sorted({f"s{int(x)}" for x in (a, rng.integers(0, n))}) if run % 3 else [f"s{a}"], 1))
    got, want = counted(spark, rows)
    assert got == want and len(want) > 10


def test_repeats_and_cycles_are_enumerated(spark):
    rows = [("r", "base", [], ["b"], 1), ("r", "x", ["b"], ["x"], 1), ("r", "y", ["b"], ["y"], 1), ("r", "z", ["b"], ["z"], 1), ("r", "two", ["x", "y"], ["t"], 1), ("r", "three", ["x", "y", "z"], ["u"], 1), ("r", "alt", [], ["b"], 1), ("c", "p", ["q"], ["p"], 1), ("c", "q", ["p"], ["q"], 1), ("c", "start", [], ["p"], 1), ("c", "end", ["q"], ["e"], 1), ("n", "lost", ["nothing"], ["l"], 1)]
    got, want = counted(spark, rows)
    assert got == want
    assert got[("r", "two")] == 4 and got[("r", "three")] == 6 and ("n", "lost") not in got  # three times base or alt is too often


def test_counts_of_joint_processes_and_without_a_path_row(spark, sf, monkeypatch):
    model, targets = queries.joint_model(spark, sf)
    want = {(r.run_id, r.target): r.n for r in paths.enumerate_paths(model, targets, save=staging.materialize).groupBy("run_id", "target").agg(F.count("*").alias("n")).collect()}
    got = {(r.run_id, r.target): int(r.n_paths) for r in paths.count_paths(model, targets, staging.materialize).collect()}
    assert got == want and len(want) > 500
    wide = [("w", f"a{k}_{i}", [f"s{k - 1}"] if k else [], [f"s{k}"], 1) for k in range(40) for i in range(10)]
    monkeypatch.setattr(paths, "enumerate_paths", None)  # 10^40 paths
    m = spark.createDataFrame(wide, MODEL)
    t = spark.createDataFrame([("w", "a20_0"), ("w", "a39_9")], "run_id string, target string")
    assert {r.target: r.n_paths and int(r.n_paths) for r in paths.count_paths(m, t, staging.materialize).collect()} == {"a20_0": 10**20, "a39_9": None}
    assert paths.count_paths(m, t.limit(0), staging.materialize).collect() == []


def test_models_of_equal_ids_stay_apart(spark, tmp_path):
    for name, verb in (("one", "open"), ("two", "shut")):
        model = {"model_actions": [{"action_id": "a1", "action_actor": "u", "action_action": verb, "action_place": ""}], "model_objects": [{"object_id": "o1", "object_name": f"door {name}", "resource_state": [{"state_id": "s1", "state_name": "done"}]}], "model_connections": [{"connection_out": "a1", "connection_in": "o1s1"}]}
        (tmp_path / f"{name}.json").write_text(json.dumps(model))
    got = graph.model_v2_to_v1(*ingest.read_action_model_v2(spark, str(tmp_path)), keys=("model",)).collect()
    assert sorted((r.model.rpartition("/")[2], r.action, r.init_states, r.final_states) for r in got) == [("one.json", "u open", [], ["door one done"]), ("two.json", "u shut", [], ["door two done"])]


def test_models_come_back_from_files(spark, tmp_path):
    rows = [("r1", "send form", ["form__draft", "plain"], ["form__sent", "form__draft"], 1), ("r1", "read", [], ["plain"], 1), ("r2", "send form", ["x__y__z"], [], 1), ("r2", "nothing", [], [], 1)]
    m = spark.createDataFrame(rows, MODEL)
    actions, states, links = graph.model_v1_to_v2(m)
    assert {(r.run_id, r.object_key, r.state_name) for r in states.collect()} == {("r1", "form", "form__draft"), ("r1", "form", "form__sent"), ("r1", "", "plain"), ("r2", "x", "x__y__z")}
    assert {r.action_id for r in actions.collect()} == {"a00001", "a00002"}
    graph.model_files(actions, states, links).write.partitionBy("run_id").json(str(tmp_path / "m"))
    back = graph.model_v2_to_v1(*ingest.read_action_model_v2(spark, str(tmp_path / "m")), keys=("model",))
    got = sorted((r.run, r.action, r.init_states, r.final_states, r.b_value) for r in back.withColumn("run", F.regexp_extract("model", "run_id=([^/]*)", 1)).collect())
    assert got == sorted(rows)
    assert graph.model_v1_to_v2(m.limit(0))[2].collect() == []
