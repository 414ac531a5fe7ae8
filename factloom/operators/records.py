"""Upserts and reads of the record tables, for all runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

#: Stored run status, public status.
PUBLIC_STATUS = {"pending": "queued", "queued": "queued", "running": "running", "completed": "succeeded", "succeeded": "succeeded", "failed": "failed", "partial_success": "partial_success", "partial": "partial_success", "cancelled": "cancelled"}
#: Error codes after which a run may be tried again.
RETRYABLE = ("retryable_external", "storage_error", "connection_error", "timeout")
ACTIVE = ("pending", "queued", "running")


def _told_apart(columns: list[str]) -> Column:
    """Something to order rows by that tie otherwise; a text, as columns may be of kinds that have no order, such as maps."""
    return F.to_json(F.struct(*columns)) if columns else F.lit("")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str, identity: str) -> DataFrame:
    """The stored table after incoming rows: on ``keys`` the last by ``order`` wins, the first ``identity`` stays.

    One aggregate that combines before its shuffle; stored rows count as older than all incoming ones. Rows of one key and one
    ``order`` are told apart by their values as text, so the result does not depend on how rows are dealt. Columns may be of
    any kind, maps included; null keys are keys."""
    values = [c for c in stored.columns if c not in keys and c != identity]
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.select(*stored.columns).withColumn("_new", F.lit(1)))
    last = F.max_by(F.struct(*values), F.struct("_new", order, _told_apart([c for c in values if c != order]).alias("_tie")))
    first = F.min_by(identity, F.struct("_new", order, identity))
    merged = both.groupBy(*keys).agg(first.alias(identity), last.alias("_v"))
    return merged.select(*(F.col(c) if c in keys or c == identity else F.col(f"_v.{c}").alias(c) for c in stored.columns))


def upsert_chunks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, ["run_id", "chunk_hash"], "seq", "id")


def upsert_actions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, ["run_id", "action_canonical"], "seq", "id")


def build_actions(records: DataFrame) -> DataFrame:
    """Action rows of normalised records: label or key, cut to the widths of the table, empty keys null."""
    label = F.element_at("surface_forms", "action_label")
    shown = F.when(~t.is_blank(label), t.strip(label)).otherwise(F.col("action_canonical"))
    wide = lambda c: F.nullif(F.substring(F.col(c), 1, 256), F.lit(""))
    return records.select("run_id", "seq", F.substring(shown, 1, 512).alias("action_label"), F.substring("action_canonical", 1, 512).alias("action_canonical"), *(wide(c).alias(c) for c in ("primary_actor_key", "primary_object_key", "input_state_key", "output_state_key")), F.nullif("normalization_version", F.lit("")).alias("normalization_version"))


def build_evidence(actions: DataFrame, snippet: str, path: str, refs: str, used: int = 500, cap: int = 2000) -> DataFrame:
    """At most one evidence row an action: the text's beginning, else the label's; none without text, path and refs."""
    text = F.substring(F.col(snippet), 1, min(used, cap))
    has = (F.coalesce(text, F.lit("")) != "") | (F.size(F.coalesce(path, F.array())) > 0) | (F.size(F.coalesce(refs, F.array())) > 0)
    return actions.where(has).select("run_id", "action_canonical", "seq", F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.substring("action_label", 1, 500)).alias("snippet"), F.col(path).alias("section_path"), F.col(refs).alias("page_refs"))


def replace_evidence(stored: DataFrame, evidence: DataFrame) -> DataFrame:
    """Stored evidence of actions that were written again is replaced as a whole."""
    keys = ["run_id", "action_canonical"]
    return stored.join(evidence.select(*keys).distinct(), keys, "left_anti").unionByName(evidence)


def list_by_run(rows: DataFrame, order: str, offset: int = 0, limit: int = 20, run: str = "run_id") -> DataFrame:
    """A page of every run's rows; ``limit`` is 1 to 500."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be from 1 to 500 and offset 0 or more")
    nth = F.row_number().over(Window.partitionBy(run).orderBy(order))
    return rows.withColumn("nth", nth).where((F.col("nth") > offset) & (F.col("nth") <= offset + limit))


def count_by_run(rows: DataFrame, run: str = "run_id") -> DataFrame:
    return rows.groupBy(run).agg(F.count("*").alias("n"))


def chunks_by_decision(chunks: DataFrame, decision: str) -> DataFrame:
    return chunks.where(F.col("decision") == decision)


def latest_version(versions: DataFrame) -> DataFrame:
    """The version with the greatest number of every document."""
    rest = [c for c in versions.columns if c != "document_id"]
    return versions.groupBy("document_id").agg(F.max_by(F.struct(*rest), F.struct("version_number", _told_apart([c for c in rest if c != "version_number"]).alias("_tie"))).alias("v")).select("document_id", "v.*")


def eligible_for_run(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest versions of documents without a run that waits or works."""
    active = runs.where(F.col("status").isin(*ACTIVE)).select("document_id")
    return latest_version(versions).join(active, "document_id", "left_anti")


def public_run_status(runs: DataFrame) -> DataFrame:
    table = F.create_map(*(F.lit(x) for kv in PUBLIC_STATUS.items() for x in kv))
    return runs.withColumn("public_status", F.coalesce(F.element_at(table, F.lower(t.strip(F.coalesce("status", F.lit(""))))), F.lit("unknown")))


def run_event_timeline(events: DataFrame) -> DataFrame:
    """Events with their place in the run."""
    return events.withColumn("nth", F.row_number().over(Window.partitionBy("run_id").orderBy("created_at", "event_id")))


def step_latency(events: DataFrame) -> DataFrame:
    """Milliseconds from each start of a step to the completion that follows it at once."""
    w = Window.partitionBy("run_id", "step").orderBy("created_at", "event_id")
    e = events.where(F.col("event_type").isin("started", "completed"))
    e = e.withColumn("prior", F.lag("event_type").over(w)).withColumn("began", F.lag("created_at").over(w))
    done = e.where("event_type = 'completed' and prior = 'started'")
    return done.select("run_id", "step", "event_id", "created_at", ((F.unix_micros("created_at") - F.unix_micros("began")) / 1000).alias("latency_ms"))


def latency_sketches(latencies: DataFrame, keys: tuple[str, ...] = ("step",), k: int = 200, column: str = "latency_ms") -> DataFrame:
    """keys, sketch, n, least and greatest: a KLL sketch of each group's latencies, of bounded size, with exact counters.

    Sketches of any split of the rows merge (``merge_sketches``) into one of the same error; greater ``k``, smaller error."""
    value = F.col(column).cast("double")
    return latencies.where(value.isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(value, k).alias("sketch"), F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.sum(value).alias("total"))


def merge_sketches(sketches: DataFrame, keys: tuple[str, ...] = ("step",)) -> DataFrame:
    """Sketches of parts (hours, shards, days) as one a group of ``keys``."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("total").alias("total"))


def sketch_quantiles(sketches: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The sketches' rows with the mean and a column p<percent> for each quantile, which none but ``least`` and ``greatest`` can pass."""
    out = sketches.withColumn("mean", F.col("total") / F.col("n"))
    at = {f"p{q * 100:g}".replace(".", "_"): F.greatest("least", F.least("greatest", F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))))) for q in quantiles}
    return out.withColumns(at).drop("sketch", "total")


#: Steps whose failures are counted as failures of parsing, and of validation.
PARSE_STEPS, VALIDATION_STEPS = ("parse", "parsing"), ("validate", "validation", "normalize")


def run_metrics(events: DataFrame) -> DataFrame:
    """Counters of each step over all runs."""
    of = lambda kind: F.count_if(F.col("event_type") == kind).alias(f"n_{kind}")
    return events.groupBy("step").agg(F.count_distinct("run_id").alias("n_runs"), *(of(k) for k in ("started", "completed", "failed", "partial_success", "retried")))


def run_totals(events: DataFrame, calls: DataFrame | None = None, parse_steps: tuple[str, ...] = PARSE_STEPS, validation_steps: tuple[str, ...] = VALIDATION_STEPS) -> DataFrame:
    """One row over all runs: runs, events, failures of parsing and of validation, and means a run, of calls (run_id, ...) too if given.

    Counters are summed by run first, which combines before its shuffle, then over runs; an empty table gives zeros and null means."""
    failed = F.col("event_type") == "failed"
    per = events.groupBy("run_id").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "retried").alias("retries"), F.count_if(failed & F.col("step").isin(*parse_steps)).alias("parse_failures"), F.count_if(failed & F.col("step").isin(*validation_steps)).alias("validation_failures"))
    names = ["events", "retries", "parse_failures", "validation_failures"]
    if calls is not None:
        own = calls.groupBy("run_id").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
        per, names = per.join(own, "run_id", "left").fillna(0, ["calls", "input_tokens", "output_tokens"]), [*names, "calls", "input_tokens", "output_tokens"]
    return per.agg(F.count("*").alias("n_runs"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in names), *(F.avg(c).alias(f"mean_{c}") for c in names))


def call_metrics(calls: DataFrame) -> DataFrame:
    """Counters of model calls: hits, tokens, cost, latency."""
    return calls.groupBy("model").agg(F.count("*").alias("n_calls"), F.count_if("cache_hit").alias("n_hits"), (F.count_if("cache_hit") / F.count("*")).alias("hit_rate"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("estimated_cost_usd").alias("cost_usd"), F.avg("latency_ms").alias("mean_latency_ms"))


def failure_summary(runs: DataFrame) -> DataFrame:
    """Failed runs by step and error code, and whether such a run may be tried again."""
    failed = runs.where("status = 'failed'").groupBy("current_step", "error_code").agg(F.count("*").alias("n_runs"))
    return failed.withColumn("retryable", F.coalesce(F.col("error_code").isin(*RETRYABLE), F.lit(False)))
