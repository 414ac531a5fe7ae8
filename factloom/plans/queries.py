"""Registered queries: each operator over the driver's tables, with its SQL where that is practical."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import graph, normalize, paths, records
from ..sources import ingest, staging, terms
from . import adapters as a

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CONFIG = normalize.NormalizeConfig(a.ALIASES, frozenset(a.RESERVED), "fixture_v1")


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = a.duck(sql)
        return f

    return register


def joined(column, by: str = "|"):
    return F.array_join(column, by)


# --- terms ---------------------------------------------------------------------------------------------------------

_TERM_LINES = "SELECT " + "CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(terms.CATEGORIES)) + """ END AS category, CASE WHEN p_partkey % 4 = 0 THEN '_ru.txt' ELSE '.txt' END AS ending,
 CASE WHEN p_partkey % 5 = 0 THEN concat('# ', p_name) WHEN p_partkey % 7 = 0 THEN '  ' ELSE concat('  ', upper(p_name), ' ') END AS value FROM {part}"""


@query(f"SELECT DISTINCT category, lower(trim(value)) AS term FROM ({_TERM_LINES}) WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#')")
def read_term_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as terms, with comments and blank lines, in the files of nine categories."""
    path = staging.folder(spark, "terms")
    a.select(spark, sf_dir, _TERM_LINES).select(F.concat("category", "ending").alias("file"), "value").write.partitionBy("file").text(path)
    return terms.term_tables(spark, path)


# --- uploads -------------------------------------------------------------------------------------------------------

_EXT = "CASE WHEN contains(filename, '.') THEN lower(string_split(filename, '.')[-1]) ELSE '' END"
_MEDIA = "lower(trim(string_split(coalesce(content_type, ''), ';')[1]))"


def _case(table: dict[str, str], key: str, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.select(spark, sf_dir, a.UPLOADS)


@query(f"SELECT document_id, CASE WHEN {_MEDIA} = 'application/octet-stream' THEN {_case(ingest.TYPE_OF, _EXT, 'content_type')} WHEN coalesce(content_type, '') = '' THEN 'application/octet-stream' ELSE content_type END AS inferred FROM ({a.UPLOADS})")
def infer_content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads(spark, sf_dir).select("document_id", ingest.infer_content_type(F.col("filename"), F.col("content_type")).alias("inferred"))


@query(f"""SELECT document_id, CASE WHEN trim(filename) = '' THEN 'filename is required' WHEN size_bytes > 20000 THEN 'file too large'
 WHEN {_EXT} NOT IN ('md','txt','pdf','doc','docx') THEN 'extension not allowed: ' || CASE WHEN {_EXT} = '' THEN '(none)' ELSE {_EXT} END
 WHEN {_MEDIA} <> '' AND {_MEDIA} NOT IN ({', '.join(f"'{v}'" for v in ingest.TYPE_OF.values())}) THEN 'content type not allowed: ' || content_type END AS reject_reason FROM ({a.UPLOADS})""")
def validate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.validate_uploads(uploads(spark, sf_dir), 20_000).select("document_id", "reject_reason")


_KEY_EXT = _case(ingest.EXTENSION_OF, _MEDIA, "'bin'")
_SAFE = "CASE WHEN trim(filename) = '' THEN 'unnamed' ELSE string_split(filename, '/')[-1] END"


@query(f"SELECT document_id AS id, {_SAFE} AS original_filename, content_type, CAST(strlen(body) AS BIGINT) AS size_bytes, sha256(body) AS checksum_sha256, 'raw/' || document_id || '/' || version_id || '/source.' || {_KEY_EXT} AS storage_key, version_id, 1 AS version_number FROM ({a.UPLOADS})")
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest_documents(uploads(spark, sf_dir))


_PARTS = f"SELECT CAST(doc_id - doc_id % 12 AS STRING) AS document_id, version_id, doc_id % 12 AS part_index, filename, content_type, body FROM ({a.UPLOADS})"


@query(f"""SELECT document_id AS id, version_id, count(*) AS n_parts, CASE WHEN count(*) = 1 THEN min({_SAFE}) ELSE 'Multi-file document' END AS original_filename, CAST(sum(strlen(body)) AS BIGINT) AS size_bytes,
 arg_min(sha256(body), part_index) AS checksum_sha256, string_agg('raw/' || document_id || '/' || version_id || '/part_' || part_index || '.' || {_KEY_EXT}, '|' ORDER BY part_index) AS part_keys, CASE WHEN count(*) > 3 THEN 'too many parts' END AS reject_reason FROM ({_PARTS}) GROUP BY 1, 2""")
def ingest_multipart(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ingest.ingest_multipart(a.select(spark, sf_dir, _PARTS), most=3)
    return p.select("id", "version_id", "n_parts", "original_filename", "size_bytes", "checksum_sha256", joined(F.transform("source_parts", lambda x: x["storage_key"])).alias("part_keys"), "reject_reason")


# --- normalisation -------------------------------------------------------------------------------------------------


def _slug(e: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({e})), '[\s\-.,;:!/()]+', '_', 'g'), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')"


def _key(field: str) -> tuple[str, str]:
    slug, fallback, kind = _slug(field), normalize.FALLBACKS[field], normalize.KINDS[field]
    resolved = _case(a.ALIASES[kind], slug, slug)
    held = f"({resolved}) IN ({', '.join(repr(r) for r in sorted(a.RESERVED))})"
    blank = f"coalesce(trim({field}), '') = ''"
    value = f"CASE WHEN {blank} OR {slug} = '' OR {held} THEN '{fallback}' ELSE {resolved} END"
    note = f"CASE WHEN {blank} THEN '{field} was empty; using fallback ''{fallback}''' WHEN {slug} = '' THEN '{field} normalized to empty; using fallback ''{fallback}''' WHEN {held} THEN '{field} ''' || {resolved} || ''' is reserved; using fallback ''{fallback}''' END"
    return value, note


_FORMS = "list_filter([" + ", ".join(f"nullif(trim({c}), '')" for c in ("input_state", "output_state", "verb", "primary_object", "primary_actor")) + "], lambda x: x IS NOT NULL)"
_K = {f: _key(f) for f in normalize.FIELDS}
RECORDS = f"""keyed AS (SELECT *, {', '.join(f'{_K[f][0]} AS k_{f}' for f in normalize.FIELDS)}, array_to_string(list_filter([{', '.join(_K[f][1] for f in normalize.FIELDS)}], lambda x: x IS NOT NULL), '|') AS warnings, {_FORMS} AS forms, nullif(trim(action_label), '') AS label FROM ({a.DRAFTS})),
records AS (SELECT run_id, seq, k_verb || '_' || k_primary_object AS action_canonical, k_primary_actor AS primary_actor_key, k_primary_object AS primary_object_key, k_primary_object || '__' || k_input_state AS input_state_key, k_primary_object || '__' || k_output_state AS output_state_key, warnings, forms, label, CASE WHEN label IS NULL THEN forms ELSE list_append(forms, label) END AS all_forms FROM keyed)"""


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_drafts(a.select(spark, sf_dir, a.DRAFTS), CONFIG)


def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised drafts for queries that read them more than once."""
    return staging.materialize(normalized(spark, sf_dir).select("run_id", "seq", "action_canonical", "form_list", "surface_forms"), "records")


@query(f"WITH {RECORDS} SELECT run_id, seq, action_canonical, primary_actor_key, primary_object_key, input_state_key, output_state_key, array_to_string(forms, '|') AS aliases, warnings, coalesce(label, '') AS label FROM records")
def normalize_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).select("run_id", "seq", "action_canonical", "primary_actor_key", "primary_object_key", "input_state_key", "output_state_key", joined(F.col("form_list")).alias("aliases"), joined(F.col("warnings")).alias("warnings"), F.coalesce(F.element_at("surface_forms", "action_label"), F.lit("")).alias("label"))


@query(f"SELECT DISTINCT p_name AS name, {_slug('p_name')} AS slug, {_slug('concat(p_type, \' (x) - \', p_brand)')} AS type_slug FROM part")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_name").alias("name"), t.slugify(F.col("p_name")).alias("slug"), t.slugify(F.concat("p_type", F.lit(" (x) - "), "p_brand")).alias("type_slug")).distinct()


@query(f"""WITH {RECORDS}, hit AS (SELECT run_id, action_canonical, count(*) AS n_records FROM records GROUP BY 1, 2 HAVING count(*) > 1),
 used AS (SELECT run_id, action_canonical, seq, unnest(all_forms) AS form, generate_subscripts(all_forms, 1) AS i FROM records),
 first AS (SELECT run_id, action_canonical, form, min((seq, i)) AS place FROM used GROUP BY 1, 2, 3)
 SELECT run_id, action_canonical, n_records, string_agg(form, '|' ORDER BY place, form) AS surface_forms, false AS merged FROM hit JOIN first USING (run_id, action_canonical) GROUP BY 1, 2, 3""")
def action_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.action_collisions(stored_records(spark, sf_dir)).withColumn("surface_forms", joined(F.col("surface_forms")))


# --- records -------------------------------------------------------------------------------------------------------

_ACTIONS = f"{RECORDS}, actions AS (SELECT run_id, seq, left(coalesce(label, action_canonical), 512) AS action_label, left(action_canonical, 512) AS action_canonical, nullif(left(primary_actor_key, 256), '') AS primary_actor_key, nullif(left(primary_object_key, 256), '') AS primary_object_key, nullif(left(input_state_key, 256), '') AS input_state_key, nullif(left(output_state_key, 256), '') AS output_state_key, 'fixture_v1' AS normalization_version FROM records)"


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.build_actions(normalized(spark, sf_dir))


@query(f"WITH {_ACTIONS} SELECT * FROM actions")
def build_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir)


@query(f"""WITH {_ACTIONS} SELECT run_id, action_canonical, coalesce(min(seq) FILTER (seq % 10 <= 3), min(seq)) AS id,
 coalesce(arg_max(action_label, seq) FILTER (seq % 10 > 3), arg_max(action_label, seq)) AS action_label, coalesce(max(seq) FILTER (seq % 10 > 3), max(seq)) AS seq FROM actions GROUP BY 1, 2""")
def upsert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = built(spark, sf_dir).select("run_id", "action_canonical", "action_label", "seq", F.col("seq").alias("id"))
    return records.upsert_actions(rows.where("seq % 10 <= 3"), rows.where("seq % 10 > 3"))


_CHUNK_ROWS = "SELECT CAST(conv_id AS STRING) AS run_id, sha256(concat(role, CAST(length(text) % 7 AS STRING))) AS chunk_hash, turn AS seq, turn AS id, text FROM {conversations}"


@query(f"SELECT run_id, chunk_hash, min(id) AS id, max(seq) AS seq, sha256(arg_max(text, seq)) AS text_sha FROM ({_CHUNK_ROWS}) GROUP BY 1, 2")
def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.select(spark, sf_dir, _CHUNK_ROWS.replace("sha256(concat(role, CAST(length(text) % 7 AS STRING)))", "sha2(concat(role, CAST(length(text) % 7 AS STRING)), 256)"))
    out = records.upsert_chunks(rows.where("seq < 2"), rows.where("seq >= 2"))
    return out.select("run_id", "chunk_hash", "id", "seq", F.sha2("text", 256).alias("text_sha"))


@query(f"WITH {_ACTIONS} SELECT run_id, action_canonical, seq, left(action_label, 500) AS snippet FROM actions WHERE seq % 2 = 0 UNION ALL SELECT run_id, action_canonical, seq, left(input_state_key, 500) FROM actions WHERE seq % 2 = 1")
def build_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = built(spark, sf_dir).withColumn("text", F.when(F.col("seq") % 2 == 1, F.col("input_state_key"))).withColumn("path", F.array("primary_object_key")).withColumn("refs", F.array(F.lit(1)))
    return records.build_evidence(rows, "text", "path", "refs").select("run_id", "action_canonical", "seq", "snippet")


@query(f"WITH {_ACTIONS}, n AS (SELECT run_id, seq, action_canonical, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS nth FROM actions) SELECT * FROM n WHERE nth > 5 AND nth <= 10")
def list_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.list_by_run(built(spark, sf_dir).select("run_id", "seq", "action_canonical"), "seq", 5, 5)


@query(f"WITH {_ACTIONS} SELECT run_id, count(*) AS n FROM actions GROUP BY 1")
def count_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.count_by_run(built(spark, sf_dir))


_VERSIONS = "SELECT o_custkey AS document_id, o_orderkey AS version_id, (o_orderkey * 7919) % 1000003 AS version_number FROM {orders}"


@query(f"SELECT document_id, max(version_number) AS version_number, arg_max(version_id, version_number) AS version_id FROM ({_VERSIONS}) GROUP BY 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.latest_version(a.select(spark, sf_dir, _VERSIONS)).select("document_id", "version_number", "version_id")


@query(f"SELECT document_id, max(version_number) AS version_number FROM ({_VERSIONS}) WHERE document_id NOT IN (SELECT document_id FROM ({a.RUNS}) WHERE status IN ('pending', 'queued', 'running')) GROUP BY 1")
def eligible_for_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.eligible_for_run(a.select(spark, sf_dir, _VERSIONS), a.select(spark, sf_dir, a.RUNS)).select("document_id", "version_number")


@query(f"SELECT run_id, {_case(records.PUBLIC_STATUS, 'lower(trim(status))', repr('unknown'))} AS public_status FROM ({a.RUNS})")
def public_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.public_run_status(a.select(spark, sf_dir, a.RUNS)).select("run_id", "public_status")


@query(f"SELECT run_id, event_id, step, event_type, row_number() OVER (PARTITION BY run_id ORDER BY created_at, event_id) AS nth FROM ({a.EVENTS})")
def run_event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.run_event_timeline(a.select(spark, sf_dir, a.EVENTS)).select("run_id", "event_id", "step", "event_type", "nth")


@query(f"""WITH e AS (SELECT *, lag(event_type) OVER w AS prior, lag(created_at) OVER w AS began FROM ({a.EVENTS}) WHERE event_type IN ('started', 'completed') WINDOW w AS (PARTITION BY run_id, step ORDER BY created_at, event_id))
 SELECT run_id, step, event_id, round((epoch_us(created_at) - epoch_us(began)) / 1000.0, 3) AS latency_ms FROM e WHERE event_type = 'completed' AND prior = 'started'""")
def step_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.step_latency(a.select(spark, sf_dir, a.EVENTS)).drop("created_at").withColumn("latency_ms", F.round("latency_ms", 3))


_LATENCY = f"""WITH e AS (SELECT *, lag(event_type) OVER w AS prior, lag(created_at) OVER w AS began FROM ({a.EVENTS}) WHERE event_type IN ('started', 'completed') WINDOW w AS (PARTITION BY run_id, step ORDER BY created_at, event_id)),
 d AS (SELECT step, (epoch_us(created_at) - epoch_us(began)) / 1000.0::DOUBLE AS ms FROM e WHERE event_type = 'completed' AND prior = 'started')"""


@query(f"{_LATENCY} SELECT step, count(*) AS n, round(min(ms), 3) AS least, round(max(ms), 3) AS greatest, round(avg(ms), 1) AS mean, true AS near FROM d GROUP BY 1")
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of hours, merged to one a step; ``near``: the median's exact rank is within three hundredths of a half."""
    done = staging.materialize(records.step_latency(a.select(spark, sf_dir, a.EVENTS)), "latencies")
    hours = records.latency_sketches(done.withColumn("hour", F.date_trunc("hour", "created_at")), ("step", "hour"), k=800)
    q = records.sketch_quantiles(records.merge_sketches(hours))
    ranks = done.join(q.select("step", "p50"), "step").groupBy("step").agg((F.count_if(F.col("latency_ms") < F.col("p50")) / F.count("*")).alias("below"), (F.count_if(F.col("latency_ms") <= F.col("p50")) / F.count("*")).alias("upto"))
    near = (F.col("below") <= 0.53) & (F.col("upto") >= 0.47)
    return q.join(ranks, "step").select("step", "n", F.round("least", 3).alias("least"), F.round("greatest", 3).alias("greatest"), F.round("mean", 1).alias("mean"), near.alias("near"))


_PER_RUN = f"SELECT run_id, count(*) AS events, count(*) FILTER (event_type = 'retried') AS retries, count(*) FILTER (event_type = 'failed' AND step IN ('parse', 'parsing')) AS pf, count(*) FILTER (event_type = 'failed' AND step IN ('validate', 'extract')) AS vf FROM ({a.EVENTS}) GROUP BY 1"


@query(f"SELECT count(*) AS n_runs, sum(events)::BIGINT AS n_events, sum(retries)::BIGINT AS n_retries, sum(pf)::BIGINT AS n_parse_failures, sum(vf)::BIGINT AS n_validation_failures, round(avg(events), 6) AS mean_events, round(avg(retries), 6) AS mean_retries, round(avg(pf), 6) AS mean_parse_failures, round(avg(vf), 6) AS mean_validation_failures FROM ({_PER_RUN})")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records.run_totals(a.select(spark, sf_dir, a.EVENTS), validation_steps=("validate", "extract"))
    return m.withColumns({c: F.round(c, 6) for c in m.columns if c.startswith("mean_")})


@query(f"SELECT step, count(DISTINCT run_id) AS n_runs, {', '.join(f'count(*) FILTER (event_type = {k!r}) AS n_{k}' for k in ('started', 'completed', 'failed', 'partial_success', 'retried'))} FROM ({a.EVENTS}) GROUP BY 1")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.run_metrics(a.select(spark, sf_dir, a.EVENTS))


@query(f"SELECT model, count(*) AS n_calls, count(*) FILTER (cache_hit) AS n_hits, round(count(*) FILTER (cache_hit) / count(*), 6) AS hit_rate, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(estimated_cost_usd), 4) AS cost_usd, round(avg(latency_ms), 4) AS mean_latency_ms FROM ({a.CALLS}) GROUP BY 1")
def call_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records.call_metrics(a.select(spark, sf_dir, a.CALLS))
    return m.withColumns({"hit_rate": F.round("hit_rate", 6), "cost_usd": F.round("cost_usd", 4), "mean_latency_ms": F.round("mean_latency_ms", 4)})


@query(f"SELECT current_step, error_code, count(*) AS n_runs, coalesce(error_code IN ('retryable_external', 'storage_error', 'connection_error', 'timeout'), false) AS retryable FROM ({a.RUNS}) WHERE status = 'failed' GROUP BY 1, 2")
def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.failure_summary(a.select(spark, sf_dir, a.RUNS))


# --- graph and models ----------------------------------------------------------------------------------------------


@query(f"WITH {_ACTIONS} SELECT run_id, primary_actor_key AS actor, primary_object_key AS object, count(*) AS n_actions, array_to_string(list_sort(list(DISTINCT action_canonical)), '|') AS actions FROM actions GROUP BY 1, 2, 3")
def actor_object_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.actor_object_edges(built(spark, sf_dir)).withColumn("actions", joined(F.col("actions")))


@query(f"WITH {_ACTIONS} SELECT DISTINCT run_id, 'actor' AS kind, primary_actor_key AS name FROM actions UNION SELECT DISTINCT run_id, 'object', primary_object_key FROM actions")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_nodes(built(spark, sf_dir))


@query(f"WITH {_ACTIONS} SELECT run_id, seq, action_canonical FROM actions WHERE primary_actor_key = 'consumer' AND primary_object_key = 'ring'")
def filter_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.filter_actions(built(spark, sf_dir), "consumer", "ring").select("run_id", "seq", "action_canonical")


_MODEL = f"{_ACTIONS}, model AS (SELECT run_id, trim(action_label) AS action, coalesce(list_sort(list(DISTINCT input_state_key) FILTER (input_state_key IS NOT NULL)), []) AS init_states, coalesce(list_sort(list(DISTINCT output_state_key) FILTER (output_state_key IS NOT NULL)), []) AS final_states, 1 AS b_value FROM actions WHERE trim(action_label) <> '' GROUP BY 1, 2)"


def modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.model_from_actions(built(spark, sf_dir))


def stored_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model for queries that read it more than once."""
    return staging.materialize(modelled(spark, sf_dir), "model")


@query(f"WITH {_MODEL} SELECT run_id, action, array_to_string(init_states, '|') AS init_states, array_to_string(final_states, '|') AS final_states, b_value FROM model")
def model_from_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelled(spark, sf_dir).withColumns({c: joined(F.col(c)) for c in ("init_states", "final_states")})


@query(f"WITH {_MODEL}, m AS (SELECT run_id, action, unnest(final_states) AS state FROM model) SELECT run_id, state, array_to_string(list_sort(list(DISTINCT action)), '|') AS producers FROM m GROUP BY 1, 2")
def state_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.state_producers(modelled(spark, sf_dir)).withColumn("producers", joined(F.col("producers")))


@query(f"""WITH {_MODEL}, t AS (SELECT DISTINCT run_id, action, unnest(list_concat(init_states, final_states)) AS state FROM model), c AS (SELECT run_id, action FROM model WHERE starts_with(action, '1-'))
 SELECT DISTINCT t.run_id, t.action FROM t JOIN (SELECT DISTINCT run_id, state FROM t JOIN c USING (run_id, action)) s USING (run_id, state) UNION SELECT run_id, action FROM c""")
def impact_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored_model(spark, sf_dir)
    return graph.impact_actions(m, m.where("startswith(action, '1-')"))


_V2 = f"""{_MODEL}, ids AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY action) AS nth FROM model),
 u AS (SELECT run_id, nth, 0 AS side, unnest(init_states) AS state, generate_subscripts(init_states, 1) AS i FROM ids UNION ALL SELECT run_id, nth, 1, unnest(final_states), generate_subscripts(final_states, 1) FROM ids),
 k AS (SELECT *, string_split(state, '__')[1] AS object_key FROM (SELECT DISTINCT run_id, state FROM u)),
 st AS (SELECT run_id, 'o' || lpad(CAST(dense_rank() OVER (PARTITION BY run_id ORDER BY object_key) AS VARCHAR), 5, '0') AS object_id, 's' || lpad(CAST(row_number() OVER (PARTITION BY run_id, object_key ORDER BY state) AS VARCHAR), 5, '0') AS state_id, state AS state_name, object_key FROM k)"""


@query(f"""WITH {_V2} SELECT u.run_id, row_number() OVER (PARTITION BY u.run_id ORDER BY nth, side, i) AS pos,
 CASE side WHEN 1 THEN 'a' || lpad(CAST(nth AS VARCHAR), 5, '0') ELSE object_id || state_id END AS out_id, CASE side WHEN 0 THEN 'a' || lpad(CAST(nth AS VARCHAR), 5, '0') ELSE object_id || state_id END AS in_id FROM u JOIN st ON st.run_id = u.run_id AND st.state_name = u.state""")
def model_v1_to_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.model_v1_to_v2(stored_model(spark, sf_dir))[2]


@query(f"WITH {_V2} SELECT run_id, object_id, state_id, state_name, object_key FROM st")
def model_v2_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and their states of the models as they are written."""
    return graph.model_v1_to_v2(stored_model(spark, sf_dir))[1].drop("object_name")


@query(f"WITH {_MODEL} SELECT run_id, action, array_to_string(init_states, '|') AS init_states, array_to_string(final_states, '|') AS final_states FROM model")
def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of all runs, to ids and back; the ids of every run are the same."""
    m = graph.model_v2_to_v1(*(staging.materialize(x, "v2") for x in graph.model_v1_to_v2(stored_model(spark, sf_dir))), keys=("run_id",))
    return m.select("run_id", "action", *(joined(F.col(c)).alias(c) for c in ("init_states", "final_states")))


#: Two models of equal ids and different names.
_V2A = " UNION ALL ".join(f"SELECT '{m}' AS model, concat('a', CAST(s_suppkey AS STRING)) AS action_id, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE concat('actor {m} ', CAST(s_nationkey AS STRING)) END AS actor, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_name END AS action, '' AS place FROM {{supplier}}" for m in ("m0", "m1"))
_V2S = " UNION ALL ".join(f"SELECT '{m}' AS model, concat('o', CAST(n_nationkey AS STRING)) AS object_id, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE {name} END AS object_name, concat('s', CAST(n_regionkey AS STRING)) AS state_id, CASE WHEN n_nationkey % 8 = 0 THEN '' ELSE concat('in ', CAST(n_regionkey AS STRING)) END AS state_name FROM {{nation}}" for m, name in (("m0", "n_name"), ("m1", "lower(n_name)")))
_V2C = "SELECT concat('m', CAST(l_orderkey % 2 AS STRING)) AS model, l_orderkey * 100000 + l_partkey AS pos, CASE WHEN l_linenumber % 2 = 0 THEN concat('a', CAST(l_suppkey AS STRING)) ELSE concat('o', CAST(l_partkey % 25 AS STRING), 's', CAST(l_partkey % 5 AS STRING)) END AS out_id, CASE WHEN l_linenumber % 2 = 1 THEN concat('a', CAST(l_suppkey AS STRING)) ELSE concat('o', CAST(l_partkey % 25 AS STRING), 's', CAST(l_partkey % 5 AS STRING)) END AS in_id FROM {lineitem}"


@query(f"""WITH a AS (SELECT model, action_id, coalesce(nullif(trim(concat_ws(' ', nullif(actor, ''), nullif(action, ''), nullif(place, ''))), ''), action_id) AS name FROM ({_V2A})),
 s AS (SELECT model, object_id || state_id AS k, coalesce(nullif(trim(concat_ws(' ', nullif(object_name, ''), nullif(state_name, ''))), ''), object_id || state_id) AS state FROM ({_V2S})), c AS ({_V2C}),
 u AS (SELECT c.model, name, state, min(pos) AS pos, 'f' AS side FROM c JOIN a ON out_id = action_id AND a.model = c.model JOIN s ON in_id = k AND s.model = c.model GROUP BY 1, 2, 3
  UNION ALL SELECT c.model, name, state, min(pos), 'i' FROM c JOIN s ON out_id = k AND s.model = c.model JOIN a ON in_id = action_id AND a.model = c.model GROUP BY 1, 2, 3),
 g AS (SELECT model, name, string_agg(state, '|' ORDER BY pos, state) FILTER (side = 'i') AS i, string_agg(state, '|' ORDER BY pos, state) FILTER (side = 'f') AS f FROM u GROUP BY 1, 2)
 SELECT n.model, n.name AS action, coalesce(i, '') AS init_states, coalesce(f, '') AS final_states, 1 AS b_value FROM (SELECT DISTINCT model, name FROM a) n LEFT JOIN g ON g.model = n.model AND g.name = n.name""")
def model_v2_to_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = graph.model_v2_to_v1(*(a.select(spark, sf_dir, x) for x in (_V2A, _V2S, _V2C)), keys=("model",))
    return m.withColumns({c: joined(F.col(c)) for c in ("init_states", "final_states")})


#: Processes of orders: each line, by its place among the order's line numbers, moves the order from one step to the next;
#: lines of one number are ways to the same step. The check of a line's status is what the joint process needs besides.
_STEPS = """SELECT run_id, action, concat('s', CAST(line - 1 AS STRING)) AS before_state, concat('s', CAST(line AS STRING)) AS after_state, CAST(line AS INT) AS line, b_value, last_line FROM (
 SELECT l_orderkey AS run_id, concat(l_returnflag, CAST(l_linenumber AS STRING)) AS action, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS line, l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last_line, b_value FROM (
 SELECT l_orderkey, l_returnflag, l_linenumber, CAST(1 + max(l_suppkey) % 10 AS INT) AS b_value FROM {lineitem} GROUP BY 1, 2, 3) lines) steps"""
_STATUS = "SELECT l_orderkey AS run_id, concat(l_returnflag, CAST(l_linenumber AS STRING)) AS action, max(l_linestatus) AS status, max(l_suppkey) % 3 = 0 AS audited FROM {lineitem} GROUP BY 1, 2"


def process_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.materialize(a.select(spark, sf_dir, _STEPS), "steps")


def process_model(steps: DataFrame) -> DataFrame:
    return steps.selectExpr("run_id", "action", "case when line = 1 then cast(array() as array<string>) else array(before_state) end as init_states", "array(after_state) as final_states", "b_value")


_PATHS = f"""WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY action) AS pos FROM ({_STEPS})),
 p AS (SELECT run_id, action AS target, action AS head, before_state AS need, line = 1 AS done, [action] AS path, CAST([] AS BIGINT[]) AS trail FROM m WHERE last_line
 UNION ALL SELECT p.run_id, target, m.action, m.before_state, m.line = 1, list_prepend(m.action, path), list_append(trail, m.pos) FROM p JOIN m ON m.run_id = p.run_id AND m.after_state = p.need WHERE NOT done)"""
_BEST = _PATHS.replace("JOIN m ON", "JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY run_id, after_state ORDER BY b_value DESC, pos) = 1) m ON")


#: A producer of each state drawn by b_value: the least of exponential draws.
_DRAWN = _PATHS.replace("JOIN m ON", "JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY run_id, after_state ORDER BY -ln((('0x' || left(md5('42:' || run_id || ':' || after_state || ':' || action), 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / b_value, pos) = 1) m ON")


def process_paths(steps: DataFrame, mode: str) -> DataFrame:
    """Paths to the actions of each order's last line."""
    targets = steps.where("last_line").select("run_id", F.col("action").alias("target"))
    return paths.enumerate_paths(process_model(steps), targets, mode, save=staging.materialize)


@query(f"{_PATHS} SELECT run_id, target, row_number() OVER (PARTITION BY run_id, target ORDER BY trail, path) AS path_index, array_to_string(path, '>') AS path, false AS truncated FROM p WHERE done")
def paths_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_paths(process_steps(spark, sf_dir), "ALL").withColumn("path", joined(F.col("path"), ">"))


@query(f"""WITH RECURSIVE m AS (SELECT * FROM ({_STEPS}) JOIN ({_STATUS}) USING (run_id, action)), c AS (SELECT DISTINCT run_id, status, 'check_' || status AS name FROM m UNION SELECT DISTINCT run_id, status, 'audit_' || status FROM m WHERE audited),
 p AS (SELECT run_id, line, last_line, action, [c.name, action] AS path FROM m JOIN c USING (run_id, status) WHERE line = 1
 UNION ALL SELECT m.run_id, m.line, m.last_line, m.action, p.path || [c.name, m.action] FROM p JOIN m ON m.run_id = p.run_id AND m.line = p.line + 1 JOIN c ON c.run_id = m.run_id AND c.status = m.status WHERE len(list_filter(p.path, lambda x: x = c.name)) < 2)
 SELECT run_id, action AS target, array_to_string(path, '>') AS path FROM p WHERE last_line""")
def paths_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line needs the step before it and a check of its status, by either of two actions, none of them more than twice."""
    found = paths.enumerate_paths(*joint_model(spark, sf_dir), save=staging.materialize)
    return found.select("run_id", "target", joined(F.col("path"), ">").alias("path"))


def joint_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(model, targets) of processes whose lines need a check besides the step before."""
    steps = staging.materialize(a.select(spark, sf_dir, _STEPS).join(a.select(spark, sf_dir, _STATUS), ["run_id", "action"]), "steps")
    ok = F.concat(F.lit("ok_"), F.col("status"))
    lines = steps.select("run_id", "action", F.when(F.col("line") == 1, F.array(ok)).otherwise(F.array(F.col("before_state"), ok)).alias("init_states"), F.array("after_state").alias("final_states"), "b_value")
    none = F.expr("cast(array() as array<string>)").alias("init_states")
    checks = [rows.select("run_id", F.concat(F.lit(kind), F.col("status")).alias("action"), none, F.array(ok).alias("final_states"), F.lit(1).alias("b_value")).distinct() for kind, rows in (("check_", steps), ("audit_", steps.where("audited")))]
    return lines.unionByName(checks[0]).unionByName(checks[1]), steps.where("last_line").select("run_id", F.col("action").alias("target"))


@query(f"{_BEST} SELECT run_id, target, array_to_string(path, '>') AS path FROM p WHERE done")
def paths_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_paths(process_steps(spark, sf_dir), "QG").select("run_id", "target", joined(F.col("path"), ">").alias("path"))


@query(f"{_DRAWN} SELECT run_id, target, array_to_string(path, '>') AS path FROM p WHERE done")
def paths_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_paths(process_steps(spark, sf_dir), "RANDOM").select("run_id", "target", joined(F.col("path"), ">").alias("path"))


_NUMBERED = "n AS (SELECT run_id, target, path, row_number() OVER (PARTITION BY run_id ORDER BY target, trail, path) AS scenario FROM p WHERE done)"


@query(f"""{_PATHS}, {_NUMBERED},
 l AS (SELECT run_id, scenario, list_concat(['Scenario ' || scenario || '.1 ' || target || ' "s' || len(path) || '"'], list_transform(path, lambda s, i: 'When ' || s || CASE WHEN i = len(path) THEN ' (UI)' ELSE ' (API)' END), ['Then s' || len(path) || ' (UI)']) AS lines FROM n)
 SELECT run_id, scenario, 1 AS version, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM l""")
def render_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = process_steps(spark, sf_dir)
    out = paths.render_scenarios(process_paths(steps, "ALL"), process_model(steps), "LEAF", "UI")
    return out.withColumn("line_no", F.col("line_no").cast("long"))


@query(f"""{_BEST}, {_NUMBERED},
 l AS (SELECT run_id, scenario, list_concat(['Scenario ' || scenario || ' ' || target], flatten(list_transform(path, lambda s, i: ['When ' || s || ' (API)', 'Then s' || i || ' (API)']))) AS lines FROM n)
 SELECT run_id, scenario, 0 AS version, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM l""")
def render_scenarios_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = process_steps(spark, sf_dir)
    out = paths.render_scenarios(process_paths(steps, "QG"), process_model(steps), "TREE", "API")
    return out.withColumn("line_no", F.col("line_no").cast("long"))


@query(f"{_PATHS} SELECT run_id, target, count(*) AS n_paths, count(*) AS n_scenarios FROM p WHERE done GROUP BY 1, 2")
def scenario_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = process_steps(spark, sf_dir)
    targets = steps.where("last_line").select("run_id", F.col("action").alias("target"))
    out = paths.scenario_counts(paths.count_paths(process_model(steps), targets, staging.materialize), process_model(steps))
    return out.withColumns({c: F.col(c).cast("long") for c in ("n_paths", "n_scenarios")})


@query(f"SELECT run_id, action, CASE WHEN last_line THEN 'UI' ELSE 'API' END AS channel FROM ({_STEPS})")
def step_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel of each action of an order at its place among the order's steps: the last by the interface."""
    s = a.select(spark, sf_dir, _STEPS).withColumn("total", F.max("line").over(Window.partitionBy("run_id")))
    return s.select("run_id", "action", paths.step_channel("UI", F.col("line") - 1, F.col("total")).alias("channel"))


# --- pieces of normalisation ----------------------------------------------------------------------------------------


@query(f"SELECT p_partkey, {_case(a.ALIASES['object'], _slug('p_name'), _slug('p_name'))} AS canonical FROM part")
def resolve_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", normalize.resolve_aliases(t.slugify(F.col("p_name")), a.ALIASES["object"]).alias("canonical"))


#: An alias for every part's name: its brand and the name's first word.
_ALIAS_ROWS = "SELECT DISTINCT 'object' AS kind, p_name AS alias, concat(p_brand, ' ', substring(p_name, 1, 3)) AS canonical FROM {part} WHERE p_partkey % 3 = 0"


@query(f"""WITH t AS (SELECT alias, min(canonical) AS canonical FROM (SELECT {_slug('alias')} AS alias, {_slug('canonical')} AS canonical FROM ({_ALIAS_ROWS})) GROUP BY 1)
 SELECT l_orderkey, l_linenumber, p_partkey, coalesce(canonical, {_slug('p_name')}) AS canonical FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN t ON alias = {_slug('p_name')}""")
def resolve_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object of every line by a table of aliases."""
    rows = a.select(spark, sf_dir, "SELECT l_orderkey, l_linenumber, p_partkey, p_name FROM {lineitem} JOIN {part} ON p_partkey = l_partkey")
    table = staging.materialize(normalize.alias_table(a.select(spark, sf_dir, _ALIAS_ROWS), "object"), "aliases")
    out = normalize.resolve_by_table(rows.withColumn("slug", t.slugify(F.col("p_name"))), "slug", table, "canonical")
    return out.select("l_orderkey", "l_linenumber", "p_partkey", "canonical")


_HELD = "lower(c_mktsegment) IN ('machinery', 'widget')"


@query(f"SELECT c_custkey, CASE WHEN {_HELD} THEN 'unknown_actor' ELSE lower(c_mktsegment) END AS final, CASE WHEN {_HELD} THEN concat('primary_actor ''', lower(c_mktsegment), ''' is reserved; using fallback ''unknown_actor''') ELSE '' END AS warning FROM customer")
def apply_reserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, note = normalize.normalize_field(F.col("c_mktsegment"), "primary_actor", normalize.NormalizeConfig(reserved=frozenset(a.RESERVED)))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", value.alias("final"), F.coalesce(note, F.lit("")).alias("warning"))


@query(f"SELECT p_partkey, lower(p_type) || '_' || {_slug('p_name')} AS action_canonical, {_slug('p_name')} || '__' || {_slug('p_brand')} AS input_state_key FROM part")
def build_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = normalize.build_keys(F.lower("p_type"), t.slugify(F.col("p_name")), F.lit("actor"), t.slugify(F.col("p_brand")), F.lit("state"))
    return p.select("p_partkey", *(k[c].alias(c) for c in ("action_canonical", "input_state_key")))


def _plain(e: str) -> str:
    for char, plain in t.SEVERAL.items():
        e = f"replace({e}, '{char}', '{plain}')"
    return f"translate({e}, '{t.SIMPLE_FROM}', '{t.SIMPLE_TO}')"


@query(f"SELECT doc_id, sha256({_plain('lower(text)')}) AS plain_sha FROM documents")
def transliterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.sha2(t.transliterate(F.lower("text")), 256).alias("plain_sha"))


# --- files ---------------------------------------------------------------------------------------------------------


@query("SELECT lang, count(*) AS n_docs, sum(strlen(text) + 1)::BIGINT AS size FROM documents GROUP BY 1")
def read_raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.folder(spark, "raw")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d.select("text", "lang").write.partitionBy("lang").text(path)
    files = ingest.read_raw_documents(spark, path, "*.txt")
    read = files.groupBy(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang")).agg(F.sum("size").alias("size"))
    return read.join(d.groupBy("lang").agg(F.count("*").alias("n_docs")), "lang")


_OF_REGION = "SELECT n_regionkey, n_name, s_name, 'a' || row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) AS action_id FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"


@query(f"SELECT n_regionkey AS region, n_name || ' ' || s_name AS action, n_name || ' supplied' AS final_states FROM ({_OF_REGION})")
def read_action_model_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model file a region: its suppliers' actions, its nations' states; ids begin anew in each file."""
    path = staging.folder(spark, "models")
    rows = a.select(spark, sf_dir, _OF_REGION)
    nation = F.dense_rank().over(Window.partitionBy("n_regionkey").orderBy("n_name"))
    rows = rows.withColumn("object_id", F.concat(F.lit("o"), nation.cast("string")))
    actions = rows.select("n_regionkey", "action_id", F.col("n_name").alias("actor"), F.col("s_name").alias("action"), F.lit("").alias("place"))
    states = rows.select("n_regionkey", "object_id", F.col("n_name").alias("object_name"), F.lit("s1").alias("state_id"), F.lit("supplied").alias("state_name")).distinct()
    links = rows.select("n_regionkey", F.lit(1).alias("pos"), F.col("action_id").alias("out_id"), F.concat("object_id", F.lit("s1")).alias("in_id"))
    graph.model_files(actions, states, links, ("n_regionkey",)).write.partitionBy("n_regionkey").json(path)
    m = graph.model_v2_to_v1(*ingest.read_action_model_v2(spark, path), keys=("model",))
    return m.select(F.regexp_extract("model", r"n_regionkey=(\d+)", 1).cast("int").alias("region"), "action", joined(F.col("final_states")).alias("final_states"))


#: Answers made of events: valid lists, and each way to be wrong; with the verdict in SQL.
_ANSWER = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN '[]' WHEN 1 THEN concat('[{{"verb": "', event_type, '", "primary_object": null}}]') WHEN 2 THEN concat('[{{"verb": "a"}}, {{"action_label": "', event_type, '"}}]')
 WHEN 3 THEN props WHEN 4 THEN '  ' WHEN 5 THEN concat('[{{"verb": "', event_type) WHEN 6 THEN '["text"]' WHEN 7 THEN '[{{"verb": "a", "odd": "b"}}]' ELSE concat('[{{"verb": ', CAST(user_id AS STRING), '}}]') END AS raw_response FROM {events}"""
DRAFTS_JSON = (
    _ANSWER,
    "SELECT event_id, event_id % 9 < 3 AS valid, CASE event_id % 9 WHEN 3 THEN 'not_array' WHEN 4 THEN 'empty' WHEN 5 THEN 'not_json' WHEN 6 THEN 'item_not_object' WHEN 7 THEN 'unknown_key' WHEN 8 THEN 'not_string' END AS error_kind, CASE event_id % 9 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END::BIGINT AS n_drafts FROM events",
)
