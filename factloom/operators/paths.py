"""Paths that reach an action: all states before it made, each by some action, no action more than twice.

A row is a partial path with a stack of goals. A round pops the first state goal of every open row and joins its producers,
which push the states they need and a mark that they are done; marks on top are taken off in the same projection, each
appending its action to the path. So a round is one join with the model, and their number is that of the states along a
path. An action never stands above itself, so rounds end. ``trail`` holds the producers' places, by which finished paths
are ordered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

REPEATS = 2


def choose_producers(model: DataFrame, mode: str = "ALL", seed: int = 42) -> DataFrame:
    """(run_id, state, pos, producer): all producers, the one of greatest b_value (QG), or one drawn by b_value (RANDOM)."""
    made = model.select("run_id", F.posexplode(F.array("action")).alias("_", "producer"), "b_value", "pos", F.explode("final_states").alias("state")).drop("_")
    made = made.distinct()
    if mode == "ALL":
        return made.select("run_id", "state", "pos", "producer")
    if mode == "QG":
        order = [F.desc("b_value"), F.col("pos")]
    elif mode == "RANDOM":
        drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("run_id").cast("string"), "state", "producer"))
        u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
        order = [-F.log(u) / F.col("b_value"), F.col("pos")]
    else:
        raise ValueError("mode is ALL, QG or RANDOM")
    nth = F.row_number().over(Window.partitionBy("run_id", "state").orderBy(*order))
    return made.withColumn("nth", nth).where("nth = 1").select("run_id", "state", "pos", "producer")


def _goal(kind: str, name: Column, above: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"), above.alias("above"))


def _pushed(states: Column, action: Column, above: Column) -> Column:
    """Goals of an action: the states it needs, then the mark that it is done."""
    below = F.array_union(above, F.array(action))
    none = F.expr("cast(array() as array<string>)")
    return F.concat(F.transform(states, lambda s: _goal("S", s, below)), F.array(_goal("E", action, none)))


def _settle(rows: DataFrame) -> DataFrame:
    """Takes the marks on top of each stack off into the path; rows that repeat an action too often go.

    What came off is found once a row, and only that is looked up in the path: the rest did not repeat before."""
    n = F.coalesce(F.nullif(F.array_position(F.transform("stack", lambda g: g["kind"]), "S"), F.lit(0)) - 1, F.size("stack")).cast("int")
    rows = t.once(rows, {"_n": n})
    done = F.transform(F.slice("stack", F.lit(1), F.col("_n")), lambda g: g["name"])
    rows = t.once(rows, {"_done": done, "_path": F.concat("path", done)})
    rows = rows.where(~F.exists("_done", lambda x: F.size(F.filter("_path", lambda y: y == x)) > REPEATS))
    return rows.withColumns({"path": F.col("_path"), "stack": F.slice("stack", F.col("_n") + 1, F.size("stack") - F.col("_n"))}).drop("_n", "_done", "_path")


def enumerate_paths(model: DataFrame, targets: DataFrame, mode: str = "ALL", seed: int = 42, max_rounds: int | None = None, max_paths: int | None = None, save=None) -> DataFrame:
    """(run_id, target, path_index, path, truncated) for (run_id, target) rows.

    ``model``: run_id, action, init_states, final_states, b_value; ``pos`` orders actions, by name if it is missing.
    A state without producer ends the branch that needs it. By default every path is given. Beyond ``max_paths`` open rows
    of a target or after ``max_rounds`` the target is given as far as it came, with truncated set. ``save`` writes a table
    and reads it back."""
    if "pos" not in model.columns:
        model = model.withColumn("pos", F.row_number().over(Window.partitionBy("run_id").orderBy("action")))
    save = save or (lambda df: df.checkpoint())
    none = F.expr("cast(array() as array<string>)")
    needs = model.select(F.col("run_id").alias("r"), F.col("action").alias("name"), "init_states")
    makers = choose_producers(model, mode, seed).withColumnRenamed("run_id", "r").join(needs.withColumnRenamed("name", "producer"), ["r", "producer"])
    makers = save(makers)
    rows = targets.join(needs, (F.col("r") == F.col("run_id")) & (F.col("name") == F.col("target")))
    stack = _pushed(F.col("init_states"), F.col("target"), none)
    open_ = rows.select("run_id", "target", none.alias("path"), stack.alias("stack"), F.expr("cast(array() as array<int>)").alias("trail"), F.lit(False).alias("truncated"))
    open_ = save(_settle(open_))
    finished, rounds = [open_.where(F.size("stack") == 0)], 0
    open_ = open_.where(F.size("stack") > 0)
    while not open_.isEmpty() and (max_rounds is None or rounds < max_rounds):
        top, rest = F.col("stack")[0], F.slice("stack", 2, F.size("stack") - 1)
        step = open_.join(makers, (F.col("r") == F.col("run_id")) & (F.col("state") == top["name"]) & ~F.array_contains(top["above"], F.col("producer")))
        step = t.once(step, {"_next": F.concat(_pushed(F.col("init_states"), F.col("producer"), top["above"]), rest)})
        step = step.select("run_id", "target", "path", F.col("_next").alias("stack"), F.concat("trail", F.array(F.col("pos").cast("int"))).alias("trail"), "truncated")
        step = _settle(step)
        if max_paths is not None:
            count = Window.partitionBy("run_id", "target")
            step = step.withColumn("_n", F.count("*").over(count)).withColumn("_k", F.row_number().over(count.orderBy("trail", "path"))).where(F.col("_k") <= max_paths)
            step = step.withColumn("truncated", F.col("truncated") | (F.col("_n") > max_paths)).drop("_n", "_k")
        step = save(step)
        finished.append(step.where(F.size("stack") == 0))
        open_, rounds = step.where(F.size("stack") > 0), rounds + 1
    out = reduce(DataFrame.unionByName, finished).select("run_id", "target", "path", "trail", "truncated")
    per = Window.partitionBy("run_id", "target")
    cut = F.max("truncated").over(per)
    if max_rounds is not None:
        left = open_.select("run_id", "target").distinct().withColumn("_cut", F.lit(True))
        out, cut = out.join(left, ["run_id", "target"], "left"), cut | F.coalesce("_cut", F.lit(False))
    return out.select("run_id", "target", F.row_number().over(per.orderBy("trail", "path")).alias("path_index"), "path", cut.alias("truncated"))


def count_paths(model: DataFrame, targets: DataFrame, save=None, max_rounds: int | None = None) -> DataFrame:
    """(run_id, target, n_paths) of the targets that have a path: what ``enumerate_paths`` in mode ALL gives, counted.

    An action has as many paths as the product over the states it needs of the sum over each state's producers. Actions are
    settled from those that need nothing upwards, a level a round; the rounds are the depth of the model, however many
    paths there are. Two kinds of target are enumerated: those that a cycle keeps from settling, and those in whose paths an
    action may stand more than ``REPEATS`` times, found by the same rounds over the greatest number of times that each
    action can stand below another (only where some action of the run needs several states). Counts are
    decimals of 38 digits, null where they have more."""
    save = save or (lambda df: df.checkpoint())
    dec = "decimal(38,0)"
    own = model.join(targets.select("run_id").distinct(), "run_id", "left_semi")
    needs = save(own.select("run_id", "action", F.size("init_states").alias("n_needs"), F.explode("init_states").alias("state")))
    makers = choose_producers(own if "pos" in own.columns else own.withColumn("pos", F.lit(0))).select("run_id", "state", "producer")
    makers = save(makers.withColumn("n_makers", F.count("*").over(Window.partitionBy("run_id", "state"))))
    settled = save(own.where(F.size("init_states") == 0).select("run_id", "action", F.lit(1).cast(dec).alias("n")).distinct())
    # states with the paths that are known so far, of how many producers, and the round that brought the last
    got = needs.select("run_id", "state").distinct().join(makers.select("run_id", "state"), ["run_id", "state"], "left_anti")
    got = save(got.select("run_id", "state", F.lit(0).cast(dec).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("n_makers"), F.lit(1).alias("last")))
    fresh, rounds = settled, 0
    while not fresh.isEmpty() and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        more = makers.join(fresh.withColumnRenamed("action", "producer"), ["run_id", "producer"]).select("run_id", "state", "n", F.lit(1).cast("long").alias("k"), "n_makers", F.lit(rounds).alias("last"))
        got = save(got.unionByName(more).groupBy("run_id", "state").agg(F.when(F.count_if(F.col("n").isNull()) == 0, F.try_sum("n").cast(dec)).alias("n"), F.sum("k").alias("k"), F.max("n_makers").alias("n_makers"), F.max("last").alias("last")))
        full = got.where("k = n_makers").select("run_id", "state", "n", "last")
        product = F.aggregate(F.collect_list(F.struct("n")), F.lit(1).cast(dec), lambda x, y: F.try_multiply(x, y["n"]).cast(dec))
        done = needs.join(full, ["run_id", "state"]).groupBy("run_id", "action", "n_needs").agg(product.alias("n"), F.count("*").alias("k"), F.max("last").alias("last"))
        fresh = save(done.where(F.expr("k = n_needs") & (F.col("last") == rounds)).select("run_id", "action", "n"))
        settled = settled.unionByName(fresh)
    counts = targets.join(settled.withColumnRenamed("action", "target"), ["run_id", "target"])
    often = _stand_often(needs, makers.drop("n_makers"), settled, rounds, save)
    if often is not None:
        counts = counts.join(often.withColumnRenamed("action", "target"), ["run_id", "target"], "left_anti")
    counts = save(counts)
    rest = save(targets.join(counts.select("run_id", "target"), ["run_id", "target"], "left_anti"))
    if not rest.isEmpty():
        listed = enumerate_paths(own, rest, save=save).groupBy("run_id", "target").agg(F.count("*").cast(dec).alias("n"))
        counts = counts.unionByName(listed)
    return counts.where("n > 0 or n is null").select("run_id", "target", F.col("n").alias("n_paths"))


def _stand_often(needs: DataFrame, makers: DataFrame, settled: DataFrame, rounds: int, save) -> DataFrame | None:
    """(run_id, action) of settled actions in a path to which some action may stand more than ``REPEATS`` times; None if no action needs several states."""
    joint = save(needs.where("n_needs > 1").select("run_id").distinct())
    if joint.isEmpty():
        return None
    own = lambda df: df.join(joint, "run_id", "left_semi")
    itself = save(own(settled).select("run_id", "action", F.col("action").alias("below"), F.lit(1).cast("long").alias("times")))
    needs, makers, times = own(needs), own(makers), itself
    for _ in range(rounds):
        most = makers.join(times.withColumnRenamed("action", "producer"), ["run_id", "producer"]).groupBy("run_id", "state", "below").agg(F.max("times").alias("times"))
        under = needs.join(most, ["run_id", "state"]).select("run_id", "action", "below", "times").join(itself.select("run_id", "action"), ["run_id", "action"], "left_semi")
        times = save(under.unionByName(itself).groupBy("run_id", "action", "below").agg(F.least(F.sum("times"), F.lit(REPEATS + 1)).alias("times")))
    return times.where(F.col("times") > REPEATS).select("run_id", "action").distinct()


def step_channel(passage: str, index, total):
    """The channel of a step by passage: API, UI, MANUAL or null."""
    fixed = {"API": "API", "UI_FULL": "UI", "MANUAL_FULL": "MANUAL"}
    if passage in fixed:
        return F.lit(fixed[passage])
    if passage in ("UI", "MANUAL"):
        return F.when(index == total - 1, F.lit(passage)).otherwise(F.lit("API"))
    return F.lit(None).cast("string")


def render_scenarios(paths: DataFrame, model: DataFrame, structure: str = "LEAF", passage: str = "NONE", words: tuple[str, str, str] = ("Scenario", "When", "Then")) -> DataFrame:
    """(run_id, scenario, version, line_no, line): a scenario for each path, or for each final state under LEAF."""
    scenario, when, then = words
    per_run = Window.partitionBy("run_id").orderBy("target", "path_index")
    finals = model.select("run_id", F.col("action").alias("target"), "final_states")
    cases = paths.withColumn("scenario", F.row_number().over(per_run)).join(finals, ["run_id", "target"])
    total = F.size("path")

    def said(word: str, text, index):
        channel = step_channel(passage, index, total)
        return F.concat(F.lit(f"{word} "), text, F.when(channel.isNotNull(), F.concat(F.lit(" ("), channel, F.lit(")"))).otherwise(F.lit("")))

    steps = F.transform("path", lambda s, i: said(when, s, i))
    checks = F.transform("final_states", lambda v: said(then, v, total - 1))
    title = F.concat(F.lit(f"{scenario} "), F.col("scenario").cast("string"))
    if structure == "LEAF":
        c = cases.select("*", F.posexplode("final_states").alias("v", "final"))
        lines = F.concat(F.array(F.concat(title, F.lit("."), (F.col("v") + 1).cast("string"), F.lit(" "), F.col("target"), F.lit(' "'), F.col("final"), F.lit('"'))), steps, F.array(said(then, F.col("final"), total - 1)))
        c = c.select("run_id", "scenario", (F.col("v") + 1).alias("version"), lines.alias("lines"))
    elif structure == "BRANCH":
        c = cases.select("run_id", "scenario", F.lit(0).alias("version"), F.concat(F.array(F.concat(title, F.lit(" "), F.col("target"))), steps, checks).alias("lines"))
    elif structure == "TREE":
        each = cases.select("run_id", "scenario", "target", "final_states", "path", F.posexplode("path").alias("i", "step")).join(model.select("run_id", F.col("action").alias("step"), F.col("final_states").alias("after")), ["run_id", "step"], "left")
        own = F.when(F.col("i") < total - 1, F.transform(F.coalesce("after", F.expr("cast(array() as array<string>)")), lambda v: said(then, v, F.col("i")))).otherwise(F.expr("cast(array() as array<string>)"))
        block = F.concat(F.array(said(when, F.col("step"), F.col("i"))), own)
        g = each.withColumn("checks", checks).groupBy("run_id", "scenario", "target").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", block.alias("b")))), lambda x: x["b"])).alias("body"), F.first("checks").alias("checks"))
        c = g.select("run_id", "scenario", F.lit(0).alias("version"), F.concat(F.array(F.concat(title, F.lit(" "), F.col("target"))), "body", "checks").alias("lines"))
    else:
        raise ValueError("structure is LEAF, BRANCH or TREE")
    return c.select("run_id", "scenario", "version", F.posexplode("lines").alias("line_no", "line"))


def scenario_counts(counted: DataFrame, model: DataFrame, structure: str = "LEAF") -> DataFrame:
    """Scenarios of each target of (run_id, target, n_paths): its final states for every path under LEAF, else its paths."""
    finals = model.select("run_id", F.col("action").alias("target"), F.size("final_states").alias("n_finals"))
    each = F.col("n_finals") if structure == "LEAF" else F.lit(1)
    return counted.join(finals, ["run_id", "target"]).select("run_id", "target", "n_paths", (F.col("n_paths") * each).alias("n_scenarios"))
