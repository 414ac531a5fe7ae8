"""The driver's tables as inputs of the operators. Each input is one SELECT that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")

LARGE = ("lineitem", "events", "documents", "pages", "conversations")

DRAFTS = """
SELECT concat('run_', CAST(o_custkey AS STRING)) AS run_id,
       l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate, l_quantity, l_extendedprice) AS seq,
       CASE WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN NULL WHEN l_returnflag = 'R' THEN concat('  ', o_orderpriority, ' ') ELSE o_orderpriority END AS verb,
       CASE WHEN l_linenumber = 6 AND l_returnflag = 'N' THEN '   ' ELSE p_name END AS primary_object,
       c_mktsegment AS primary_actor,
       CASE WHEN l_linenumber = 5 THEN NULL ELSE o_orderstatus END AS input_state,
       concat('Ship / ', l_linestatus) AS output_state,
       CASE WHEN l_linenumber = 4 THEN '' ELSE concat(o_orderpriority, ' ', p_name) END AS action_label
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey JOIN {customer} ON c_custkey = o_custkey
"""

UPLOADS = """
SELECT CAST(doc_id AS STRING) AS document_id, concat('v', CAST(doc_id % 3 AS STRING)) AS version_id, doc_id,
       CASE WHEN doc_id % 11 = 0 THEN ' ' WHEN doc_id % 7 = 0 THEN concat('in/dir/', source, '.exe') WHEN doc_id % 5 = 0 THEN concat(source, '.MD') WHEN doc_id % 3 = 0 THEN concat('a/', source, '.pdf') WHEN doc_id % 13 = 1 THEN source ELSE concat(source, '.txt') END AS filename,
       CASE WHEN doc_id % 6 = 0 THEN 'application/octet-stream' WHEN doc_id % 6 = 1 THEN 'Text/Markdown; charset=utf-8' WHEN doc_id % 6 = 2 THEN 'image/png' WHEN doc_id % 6 = 3 THEN '' ELSE 'text/plain' END AS content_type,
       text AS body, n_chars AS size_bytes
FROM {documents}
"""

EVENTS = """
SELECT event_id, CAST(user_id AS STRING) AS run_id, CASE WHEN event_id % 3 = 0 THEN 'parse' WHEN event_id % 3 = 1 THEN 'chunk' ELSE 'extract' END AS step,
       CASE event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial_success' ELSE 'retried' END AS event_type,
       CAST(ts AS TIMESTAMP) AS created_at, value
FROM {events}
"""

RUNS = """
SELECT o_orderkey AS run_id, o_custkey AS document_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'failed' WHEN '2-HIGH' THEN ' Running' WHEN '3-MEDIUM' THEN 'completed' WHEN '5-LOW' THEN 'queued' ELSE 'archived' END AS status,
       CASE o_orderstatus WHEN 'F' THEN 'parse' WHEN 'O' THEN 'chunk' ELSE 'extract' END AS current_step,
       CASE WHEN o_orderkey % 5 = 0 THEN 'timeout' WHEN o_orderkey % 5 = 1 THEN 'storage_error' WHEN o_orderkey % 5 = 2 THEN 'parsing_error' WHEN o_orderkey % 5 = 3 THEN 'config_error' ELSE NULL END AS error_code
FROM {orders}
"""

CALLS = """
SELECT l_returnflag AS model, l_linenumber % 2 = 0 AS cache_hit, CAST(l_quantity AS BIGINT) AS input_tokens, CAST(l_linenumber AS BIGINT) AS output_tokens, l_tax AS estimated_cost_usd, l_quantity AS latency_ms
FROM {lineitem}
"""

#: Lines of a text are blocks: every seventh opens a section, at level 1 and 2 by turns.
UNIT_RULE = """
SELECT doc_id, unit_index, text,
       CASE WHEN unit_index % 7 = 0 THEN 'heading' WHEN unit_index % 7 = 3 OR unit_index % 7 = 4 THEN 'list' WHEN unit_index % 7 = 5 THEN 'table' ELSE 'paragraph' END AS block_type,
       CASE WHEN unit_index % 14 = 0 THEN text END AS h1, CASE WHEN unit_index % 14 = 7 THEN unit_index END AS i2, CASE WHEN unit_index % 14 = 7 THEN text END AS h2, CASE WHEN unit_index % 14 = 0 THEN unit_index END AS i1
FROM ({lines})
"""

#: Alias and reserved words of the queries.
ALIASES = {"object": {"small_ring": "ring", "red_widget": "widget"}, "verb": {"5_low": "defer", "1_urgent": "expedite"}, "role": {"household": "consumer"}, "state": {"f": "finished", "o": "open", "p": "pending"}}
RESERVED = ("machinery", "widget")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as read; one of fewer splits than there are cores, as small files give, is dealt to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in LARGE and df.rdd.getNumPartitions() < cores else df


def frames(spark: SparkSession, sf_dir: str, text: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}


def select(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A SELECT over the tables it names in braces."""
    return spark.sql(text, **frames(spark, sf_dir, text))


def duck(text: str) -> str:
    """The same SELECT for views of those names."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text.strip()


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents: lines that are not empty, with paths of one or two headings."""
    lines = table(spark, sf_dir, "documents").selectExpr("doc_id", "posexplode(split(text, '\\n')) as (unit_index, text)").where("text <> ''")
    rows = spark.sql(UNIT_RULE.replace("({lines})", "{lines}"), lines=lines)
    over = "over (partition by doc_id order by unit_index rows between unbounded preceding and current row)"
    rows = rows.selectExpr("*", f"last(h1, true) {over} as t1", f"last(h2, true) {over} as t2", f"last(i1, true) {over} as p1", f"last(i2, true) {over} as p2")
    path = "case when p2 > coalesce(p1, -1) then case when t1 is null then array(t2) else array(t1, t2) end when t1 is null then cast(array() as array<string>) else array(t1) end"
    return rows.selectExpr("doc_id", "unit_index", f"{path} as section_path", "block_type", "text")


UNITS_SQL = """
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit_index FROM documents),
typed AS (""" + UNIT_RULE.replace("({lines})", "lines") + """ WHERE text <> ''),
opened AS (SELECT *, last_value(h1 IGNORE NULLS) OVER w AS t1, last_value(h2 IGNORE NULLS) OVER w AS t2, last_value(i1 IGNORE NULLS) OVER w AS p1, last_value(i2 IGNORE NULLS) OVER w AS p2
  FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY unit_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
units AS (SELECT doc_id, unit_index, block_type, text, CASE WHEN p2 > coalesce(p1, -1) THEN CASE WHEN t1 IS NULL THEN [t2] ELSE [t1, t2] END WHEN t1 IS NULL THEN CAST([] AS VARCHAR[]) ELSE [t1] END AS section_path FROM opened)
"""
