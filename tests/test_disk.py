"""What the models and collisions send over disk: tables that look small in files are not broadcast, rows are shuffled once."""

import os
import time

from factloom.operators import graph, normalize
from factloom.sources import staging

MODEL = "run_id string, action string, init_states array<string>, final_states array<string>, b_value int"
ROWS = [("r1", "send", ["form__draft", "plain"], ["form__sent", "form__draft"], 1), ("r1", "read", [], ["plain"], 1), ("r2", "send", ["x__y__z"], [], 1)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_round_trip_broadcasts_nothing(spark):
    parts = graph.model_v1_to_v2(spark.createDataFrame(ROWS, MODEL))
    stored = [staging.materialize(x, "v2") for x in parts]
    assert "Broadcast" not in plan(graph.model_v2_to_v1(*stored, keys=("run_id",)))


def test_connections_shuffle_a_model_once(spark):
    links = graph.model_v1_to_v2(spark.createDataFrame(ROWS, MODEL))[2]
    assert plan(links).count("Exchange hashpartitioning") == 1 and "Join" not in plan(links)
    got = sorted((r.run_id, r.pos, r.out_id, r.in_id) for r in links.collect())
    assert got == [("r1", 1, "a00001", "o00001s00001"), ("r1", 2, "o00002s00001", "a00002"), ("r1", 3, "o00001s00001", "a00002"), ("r1", 4, "a00002", "o00002s00002"), ("r1", 5, "a00002", "o00002s00001"), ("r2", 1, "o00001s00001", "a00001")]


RECORDS = "run_id string, seq long, action_canonical string, form_list array<string>, surface_forms map<string,string>"


def test_only_keys_that_collide_make_rows_of_forms(spark):
    rows = [("r", k, f"once_{k}", ["a", "b"], {}) for k in range(50)]
    rows += [("r", 60, "twice", ["b", "a"], {"action_label": "l"}), ("r", 59, "twice", ["a"], {}), ("r", 70, "bare", [], {}), ("r", 71, "bare", None, {}), ("s", 72, "twice", ["c"], {})]
    df = normalize.action_collisions(spark.createDataFrame(rows, RECORDS))
    got = sorted((r.run_id, r.action_canonical, r.n_records, r.surface_forms) for r in df.collect())
    assert got == [("r", "bare", 2, ["bare", "bare"]), ("r", "twice", 2, ["a", "b", "l"])]
    text = plan(df)
    assert "LeftSemi" in text and text.index("Generate") < text.index("LeftSemi")  # printed from the top


def test_materialize_leaves_no_shuffle_files(spark):
    found = lambda: {f for d, _, names in os.walk(spark.conf.get("spark.local.dir")) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    before, was = found(), spark.conf.get(staging.CLEANUP)
    out = staging.materialize(spark.range(1000).repartition(7, "id").groupBy("id").count(), "counts")
    for _ in range(50):  # they are removed in the background
        if not found() - before:
            break
        time.sleep(0.1)
    assert not found() - before
    assert out.count() == 1000 and spark.conf.get(staging.CLEANUP) == was
