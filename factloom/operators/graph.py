"""Action graphs and action models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

EMPTY_LABEL = "(none)"


def graph_key(name: str):
    return F.when(t.is_blank(F.col(name)), F.lit(EMPTY_LABEL)).otherwise(t.strip(F.col(name)))


def actor_object_edges(actions: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Edges between actors and objects with their number of actions and the distinct action keys."""
    e = actions.select(*keys, graph_key("primary_actor_key").alias("actor"), graph_key("primary_object_key").alias("object"), "action_canonical")
    return e.groupBy(*keys, "actor", "object").agg(F.count("*").alias("n_actions"), F.array_sort(F.collect_set("action_canonical")).alias("actions"))


def graph_nodes(actions: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    sides = [actions.select(*keys, F.lit(kind).alias("kind"), graph_key(c).alias("name")) for kind, c in (("actor", "primary_actor_key"), ("object", "primary_object_key"))]
    return sides[0].unionByName(sides[1]).distinct()


def filter_actions(actions: DataFrame, actor: str | None = None, object_: str | None = None) -> DataFrame:
    if actor is not None:
        actions = actions.where(graph_key("primary_actor_key") == actor)
    return actions.where(graph_key("primary_object_key") == object_) if object_ is not None else actions


def model_from_actions(actions: DataFrame, keys: tuple[str, ...] = ("run_id",), exclude: str | None = None) -> DataFrame:
    """Action model: sorted distinct states before and after each named action. ``exclude``: a suffix of states to leave out."""
    name = t.strip(F.coalesce(F.nullif("action_label", F.lit("")), "action_canonical"))

    def state(c: str):
        s = F.when(~t.is_blank(F.col(c)), t.strip(F.col(c)))
        return F.when(~F.endswith(s, F.lit(exclude)), s) if exclude else s

    named = actions.select(*keys, name.alias("action"), state("input_state_key").alias("i"), state("output_state_key").alias("f")).where("coalesce(action, '') <> ''")
    return named.groupBy(*keys, "action").agg(F.array_sort(F.collect_set("i")).alias("init_states"), F.array_sort(F.collect_set("f")).alias("final_states"), F.lit(1).alias("b_value"))


def model_v2_to_v1(actions: DataFrame, states: DataFrame, connections: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(action_id, actor, action, place), (object_id, object_name, state_id, state_name), (pos, out_id, in_id) -> model.

    ``keys`` are columns of all three that tell models apart, such as ``model`` where several files are read: ids count
    within a model only, and the result has these columns. States stand in the order of their first connection. Empty
    names fall back to ids; actions of one name are one; rows without id, and connections to what is not there, give nothing."""
    shown = lambda *cs: t.strip(F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in cs)))
    a = actions.where("coalesce(action_id, '') <> ''").select(*keys, F.col("action_id").alias("own_id"), F.coalesce(F.nullif(shown("actor", "action", "place"), F.lit("")), "action_id").alias("name"))
    key = F.concat("object_id", "state_id")
    s = states.select(*keys, key.alias("state_key"), F.coalesce(F.nullif(shown("object_name", "state_name"), F.lit("")), key).alias("state"))
    c = connections.select(*keys, "pos", "out_id", "in_id")

    def linked(action_side: str, state_side: str, side: str) -> DataFrame:
        # shuffled whatever their files' size: ids and names that repeat take a few bytes a row there, and many times as much in a driver that broadcasts them
        found = c.join(a.withColumnRenamed("own_id", action_side).hint("merge"), [*keys, action_side]).join(s.withColumnRenamed("state_key", state_side).hint("merge"), [*keys, state_side])
        return found.select(*keys, "name", "state", "pos", F.lit(side).alias("side"))

    first = linked("out_id", "in_id", "f").unionByName(linked("in_id", "out_id", "i")).groupBy(*keys, "name", "state", "side").agg(F.min("pos").alias("pos"))
    ordered = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "state")))), lambda x: x["state"])
    sides = first.groupBy(*keys, "name").agg(ordered("i").alias("init_states"), ordered("f").alias("final_states"))
    none = F.expr("cast(array() as array<string>)")
    return a.select(*keys, "name").distinct().join(sides.hint("merge"), [*keys, "name"], "left").select(*keys, F.col("name").alias("action"), F.coalesce("init_states", none).alias("init_states"), F.coalesce("final_states", none).alias("final_states"), F.lit(1).alias("b_value"))


#: Stands between the object and the state of a key; digits of an id.
DIVIDER, DIGITS = "__", 5


def model_v1_to_v2(model: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(actions, states, connections) as ``model_v2_to_v1`` takes them with the same keys, which gives the model back.

    Ids count up within a model in the order of names: actions a00001, objects o00001, states of an object s00001. A state key
    ``object__state`` is the state of that object; one without divider is a state of the object without name. Names are kept
    whole in state_name, so that they come back as they were, and the object's name is in object_key. Connections are numbered
    so that each action's states keep their order. Models are keyed, so several, with equal ids, may be in one table."""
    nth = lambda *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    label = lambda letter, n: F.concat(F.lit(letter), F.lpad(n.cast("string"), DIGITS, "0"))
    m = model.select(*keys, "action", "init_states", "final_states", nth("action").alias("n"))
    actions = m.select(*keys, label("a", F.col("n")).alias("action_id"), F.lit("").alias("actor"), "action", F.lit("").alias("place"))
    side = lambda k, c: F.transform(c, lambda state, at: F.struct(F.lit(k).alias("side"), at.alias("at"), state.alias("state")))
    object_key = F.when(F.contains("state", F.lit(DIVIDER)), F.substring_index("state", DIVIDER, 1)).otherwise(F.lit(""))
    used = m.select(*keys, "n", F.inline(F.concat(side(0, "init_states"), side(1, "final_states")))).withColumn("object_key", object_key)
    # a state's ranks are taken where it is used, so that a model's rows are shuffled once and not joined with its states
    within = F.dense_rank().over(Window.partitionBy(*keys, "object_key").orderBy("state"))
    objects = F.dense_rank().over(Window.partitionBy(*keys).orderBy("object_key"))
    used = used.withColumn("state_id", label("s", within)).withColumn("object_id", label("o", objects))
    states = used.select(*keys, "object_id", F.lit("").alias("object_name"), "state_id", F.col("state").alias("state_name"), "object_key").distinct()
    linked = used.dropna(subset=[*keys, "state"]).select(*keys, "n", "side", "at", F.concat("object_id", "state_id").alias("state_key"))
    action_id, out = label("a", F.col("n")), F.col("side") == 1
    connections = linked.select(*keys, nth("n", "side", "at").cast("long").alias("pos"), F.when(out, action_id).otherwise(F.col("state_key")).alias("out_id"), F.when(out, F.col("state_key")).otherwise(action_id).alias("in_id"))
    return actions, states, connections


def model_files(actions: DataFrame, states: DataFrame, connections: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """A row a model (keys and the three nested lists of a model file), ready to be written as JSON and read by ``read_action_model_v2``."""
    listed = lambda order, **fields: F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*(F.col(c).alias(k) for k, c in fields.items())).alias("x")))), lambda r: r["x"])
    a = actions.groupBy(*keys).agg(listed("action_id", action_id="action_id", action_actor="actor", action_action="action", action_place="place").alias("model_actions"))
    o = states.groupBy(*keys, "object_id", "object_name").agg(listed("state_id", state_id="state_id", state_name="state_name").alias("resource_state"))
    o = o.groupBy(*keys).agg(listed("object_id", object_id="object_id", object_name="object_name", resource_state="resource_state").alias("model_objects"))
    c = connections.groupBy(*keys).agg(listed("pos", connection_out="out_id", connection_in="in_id").alias("model_connections"))
    return a.join(o, list(keys), "left").join(c, list(keys), "left")


def state_producers(model: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Actions that end in each state, in the order of their names."""
    made = model.select(*keys, "action", F.explode("final_states").alias("state"))
    return made.groupBy(*keys, "state").agg(F.array_sort(F.collect_set("action")).alias("producers"))


def impact_actions(model: DataFrame, changed: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Actions that share a state with a changed action (same keys and action), which are among them."""
    touched = model.select(*keys, "action", F.explode(F.array_union("init_states", "final_states")).alias("state"))
    states = touched.join(changed.select(*keys, "action"), [*keys, "action"], "left_semi").select(*keys, "state").distinct()
    near = touched.join(states, [*keys, "state"], "left_semi").select(*keys, "action")
    return near.unionByName(changed.select(*keys, "action")).distinct()
