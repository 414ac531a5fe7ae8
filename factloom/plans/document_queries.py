"""Registered queries over documents, pages, conversations, embeddings and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import batching, chunks, parsing, prefilter, records, responses, vectors
from ..sources import ingest
from ..sources.staging import folder, materialize
from ..streaming import streams
from . import adapters as a
from .queries import DRAFTS_JSON, QUERIES, SQL, joined, query  # noqa: F401

W = prefilter.Weights(accept=0.12, gray=0.06, top_gray=2, terms=prefilter.DEFAULT_TERMS | {
    "action_verbs": ["the", "la", "der", "el"], "object_domain_terms": ["tion", "eau", "heit", "ción"], "role_nouns": ["ing", "elle", "keit", "mente"],
    "state_indicators": ["and", "qui", "und", "que"], "heading_relevant_terms": ["th", "ch"],
}, queries=["the and of", "la le de", "der die und", "el que los"])
MAX_TOKENS = 200


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.units(spark, sf_dir)


# --- chunks --------------------------------------------------------------------------------------------------------

_NEXT = "n.block_type <> 'heading' AND ((f.prior = 'heading' AND n.block_type IN ('paragraph', 'list', 'table')) OR (f.prior = 'table' AND n.block_type = 'paragraph') OR (f.prior = 'list' AND n.block_type = 'list') OR (f.prior_path = n.section_path AND f.prior = n.block_type)) AND list_slice(n.section_path, 1, len(f.head)) = f.head"
_GROUP = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit_index) AS nth FROM units),
fold AS (SELECT doc_id, nth, unit_index, section_path AS head, block_type AS prior, section_path AS prior_path, 0 AS group_id FROM numbered WHERE nth = 1
 UNION ALL SELECT n.doc_id, n.nth, n.unit_index, CASE WHEN {_NEXT} THEN f.head ELSE n.section_path END, n.block_type, n.section_path, CASE WHEN {_NEXT} THEN f.group_id ELSE f.group_id + 1 END FROM fold f JOIN numbered n ON n.doc_id = f.doc_id AND n.nth = f.nth + 1),
grouped AS (SELECT units.*, group_id FROM units JOIN fold USING (doc_id, unit_index)),
groups AS (SELECT doc_id, group_id, arg_min(section_path, unit_index) AS section_path, string_agg(text, chr(10) || chr(10) ORDER BY unit_index) AS text, count(*) AS n_units, bool_or(block_type = 'table') AS has_table, bool_or(block_type = 'list') AS has_list,
 arg_max(text, unit_index) FILTER (block_type = 'heading') AS heading FROM grouped GROUP BY 1, 2),
noted AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS note FROM groups),
prefixed AS (SELECT * EXCLUDE (text), CASE WHEN note IS NOT NULL THEN '[Context: ' || left(note, 80) || ']' || chr(10) || chr(10) || text ELSE text END AS text FROM noted)"""
GROUPED = f"{a.UNITS_SQL}, {_GROUP}"
_R = "WITH RECURSIVE "
_REPR = "'[' || array_to_string(list_transform(section_path, lambda x: CASE WHEN contains(x, '''') AND NOT contains(x, '\"') THEN '\"' || replace(x, '\\', '\\\\') || '\"' ELSE '''' || replace(replace(x, '\\', '\\\\'), '''', '\\''') || '''' END), ', ') || ']'"
_TOKENS = "CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE greatest(1, CAST(floor(length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) / 4) AS INT)) END"


def _cut(width: int, start: str) -> str:
    """End of the part of l.text that begins at ``start``: after the last blank line within the width, if there is one."""
    shown = f"substr(l.text, {start} + 1, {width} + 1)"
    back = f"strpos(reverse({shown}), chr(10) || chr(10))"
    return f"CASE WHEN {start} + {width} >= length(l.text) THEN length(l.text) WHEN {back} BETWEEN 1 AND length({shown}) - 2 THEN {start} + length({shown}) - {back} + 1 ELSE {start} + {width} END"


def _split(tokens: int) -> str:
    """CTEs after ``groups`` and ``noted``: parts of groups, and chunks of parts."""
    return f"""large AS (SELECT doc_id, group_id, text FROM groups WHERE {_TOKENS} > {tokens}),
cut AS (SELECT doc_id, group_id, CAST(0 AS BIGINT) AS s, CAST({_cut(4 * tokens, "0")} AS BIGINT) AS e FROM large l UNION ALL SELECT l.doc_id, l.group_id, c.e, CAST({_cut(4 * tokens, "c.e")} AS BIGINT) FROM cut c JOIN large l ON l.doc_id = c.doc_id AND l.group_id = c.group_id WHERE c.e < length(l.text)),
pieces AS (SELECT doc_id, group_id, s, trim(substr(text, s + 1, e - s), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM cut JOIN large USING (doc_id, group_id)),
parts AS (SELECT doc_id, group_id, row_number() OVER (PARTITION BY doc_id, group_id ORDER BY s) - 1 AS part, text FROM pieces WHERE text <> '' UNION ALL SELECT doc_id, group_id, 0, text FROM groups WHERE {_TOKENS} <= {tokens}),
texts AS (SELECT p.doc_id, p.group_id, p.part, section_path, CASE WHEN note IS NOT NULL THEN '[Context: ' || left(note, 80) || ']' || chr(10) || chr(10) || p.text ELSE p.text END AS text FROM parts p JOIN noted n ON n.doc_id = p.doc_id AND n.group_id = p.group_id),
numbered_parts AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY group_id, part) - 1 AS chunk_index FROM texts),
chunks AS (SELECT doc_id, chunk_index, section_path, text, sha256({_REPR} || ':' || text || ':' || chunk_index) AS chunk_id, {_TOKENS} AS estimated_tokens FROM numbered_parts)"""


SPLIT = f"{GROUPED}, {_split(MAX_TOKENS)}"


@query(f"SELECT doc_id, {_TOKENS} AS estimated_tokens FROM documents")
def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", t.estimate_tokens(F.col("text")).alias("estimated_tokens"))


@query(f"{_R}{GROUPED} SELECT doc_id, unit_index, group_id FROM grouped")
def group_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.group_units(units(spark, sf_dir)).select("doc_id", F.col("unit_index").cast("long").alias("unit_index"), "group_id")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.assemble_groups(chunks.group_units(units(spark, sf_dir)))


@query(f"{_R}{GROUPED} SELECT doc_id, group_id, array_to_string(section_path, '/') AS path, sha256(text) AS text_sha, n_units, heading FROM groups")
def assemble_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).select("doc_id", "group_id", joined(F.col("section_path"), "/").alias("path"), F.sha2("text", 256).alias("text_sha"), "n_units", "heading")


@query(f"{_R}{GROUPED} SELECT doc_id, group_id, has_table, has_list, len(section_path) AS section_depth FROM groups")
def structural_chunk_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).select("doc_id", "group_id", "has_table", "has_list", F.col("section_depth").cast("long").alias("section_depth"))


@query(f"{_R}{SPLIT} SELECT doc_id, group_id, part, length(text) AS n_chars, sha256(text) AS text_sha FROM parts")
def split_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.split_oversize(groups(spark, sf_dir), MAX_TOKENS).select("doc_id", "group_id", "part", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha"))


@query(f"{_R}{GROUPED} SELECT doc_id, group_id, sha256(text) AS text_sha FROM prefixed")
def context_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.context_prefix(groups(spark, sf_dir).withColumn("part", F.lit(0))).select("doc_id", "group_id", F.sha2("text", 256).alias("text_sha"))


@query(f"{_R}{SPLIT} SELECT doc_id, chunk_index, chunk_id, estimated_tokens FROM chunks")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks.assemble_chunks(units(spark, sf_dir), MAX_TOKENS)
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", "estimated_tokens")


@query(f"{_R}{GROUPED} SELECT doc_id, group_id, sha256('Document: doc ' || doc_id || chr(10) || chr(10) || CASE WHEN len(section_path) > 0 THEN 'Section: ' || array_to_string(section_path, ' / ') || chr(10) || chr(10) ELSE '' END || text) AS llm_sha FROM groups")
def chunk_llm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(spark, sf_dir).withColumn("title", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    return g.select("doc_id", "group_id", F.sha2(chunks.chunk_llm_text("title", "section_path", "text"), 256).alias("llm_sha"))


# --- prefilter: turns of conversations are chunks, roles their sections -----------------------------------------------

_TURNS = "SELECT CAST(conv_id AS STRING) AS run_id, CAST(turn AS INT) AS chunk_index, role, coalesce(text, '') AS chunk_text, turn % 4 = 1 AS has_table, turn % 4 = 2 AS has_list, CAST(1 + turn % 6 AS INT) AS section_depth FROM {conversations}"
_TURN_SQL = a.duck(_TURNS)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.select(spark, sf_dir, _TURNS).withColumn("section_path", F.array(F.lit("chat"), F.col("role"))).withColumn("estimated_tokens", t.estimate_tokens(F.col("chunk_text"))).withColumn("chunk_id", F.sha2(F.concat("run_id", F.lit("/"), F.col("chunk_index").cast("string")), 256))


@query(f"SELECT run_id, chunk_index, CASE WHEN contains('chat ' || role, 'th') OR contains('chat ' || role, 'ch') THEN 1.0 ELSE 0.0 END AS heading_relevant, CASE WHEN has_table OR has_list THEN 1.0 ELSE 0.0 END AS has_table_list, round(least(section_depth / 5.0, 1.0), 6) AS depth_score, 0.0 AS appendix_penalty FROM ({_TURN_SQL})".replace("1.0 ELSE 0.0 END", "1.0::DOUBLE ELSE 0.0::DOUBLE END").replace("0.0 AS appendix", "0.0::DOUBLE AS appendix"))
def structural_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter.structural_score(turns(spark, sf_dir), W).select("run_id", "chunk_index", "heading_relevant", "has_table_list", F.round("depth_score", 6).alias("depth_score"), "appendix_penalty")


def _phrases() -> list[str]:
    return list(dict.fromkeys(x for terms in W.terms.values() for x in terms))


_LEX = "list_filter([" + ", ".join("'" + x + "'" for x in _phrases()) + r"], lambda x: contains(regexp_replace(lower('chat ' || role || ' ' || chunk_text), '\s+', ' ', 'g'), x))"


@query(f"SELECT run_id, chunk_index, array_to_string({_LEX}, '|') AS matched_terms, len({_LEX}) AS n FROM ({_TURN_SQL})")
def lexicon_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = prefilter.lexicon_match(turns(spark, sf_dir), W)
    return m.select("run_id", "chunk_index", joined(F.col("matched_terms")).alias("matched_terms"), F.size("matched_terms").cast("long").alias("n"))


def _patterns(source: str) -> str:
    """Names of patterns by place, over rows with chunk_text whose only verbs after must and may are those of ``_MODAL_TURNS``."""
    rules = {
        "obligation_must_verb": r"\bmust\s+submit\b", "permission_may_verb": r"\bmay\s+delete\b", "prohibition_shall_not": r"\b(?:shall|must)\s+not\b",
        "condition_if_when": r"\b(?:if|when|unless)\b", "role_modal": rf"\b(?:{'|'.join(prefilter.ROLES)})\s+(?:{'|'.join(prefilter.MODALS)})\b",
    }
    text = "lower(chunk_text)"
    found = ", ".join(f"{{place: CASE WHEN regexp_matches({text}, '{rule}') THEN length(regexp_extract({text}, '(?s)^(.*?){rule}', 1)) ELSE -1 END, name: '{name}'}}" for name, rule in rules.items())
    return f"SELECT run_id, chunk_index, list_transform(list_sort(list_filter([{found}], lambda x: x.place >= 0)), lambda x: x.name) AS patterns FROM ({source})"


#: Turns with what the patterns look for in the place of frequent words: modals before verbs, and before other words.
_MODAL_TURNS = f"SELECT run_id, chunk_index, replace(replace(replace(replace(chunk_text, ' the ', ' user must submit the '), ' la ', ' we may delete the '), ' of ', ' if not '), ' der ', ' must the ') AS chunk_text FROM ({_TURNS})"


@query(f"SELECT run_id, chunk_index, array_to_string(patterns, '|') AS patterns FROM ({_patterns(a.duck(_MODAL_TURNS))})")
def token_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter.token_patterns(a.select(spark, sf_dir, _MODAL_TURNS)).select("run_id", "chunk_index", joined(F.col("patterns")).alias("patterns"))


def _mask(k: int, names: tuple[str, ...]) -> str:
    words = [x for n in names for x in W.terms[n] if " " not in x]
    return f"CASE WHEN {' OR '.join(f'contains(tok, {x!r})' for x in words)} THEN {1 << k} ELSE 0 END"


def _rounded(value: Column, digits: int = 6) -> Column:
    """Rounded as the SQL does it: halves of the scaled double. Spark's own round goes by the double's decimal digits, which parts values next to a half."""
    return F.round(value * 10.0**digits) / 10.0**digits


_MASKS = " | ".join(_mask(k, n) for k, n in enumerate((("action_verbs",), ("object_domain_terms",), ("permission_terms", "restriction_terms"), ("role_nouns",), ("state_indicators",))))
_CONTEXT = f"""tokens AS (SELECT run_id, chunk_index, unnest(regexp_extract_all(lower(chunk_text), '[a-z0-9а-яё]+')) AS tok, generate_subscripts(regexp_extract_all(lower(chunk_text), '[a-z0-9а-яё]+'), 1) AS i FROM ({_TURN_SQL})),
 masked AS (SELECT run_id, chunk_index, i, bit_or({_MASKS}) OVER (PARTITION BY run_id, chunk_index ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS m, count(*) OVER (PARTITION BY run_id, chunk_index) AS n FROM tokens),
 hits AS (SELECT run_id, chunk_index, n, sum(((m & 3) = 3)::INT + ((m & 12) = 12)::INT + ((m & 18) = 18)::INT) AS h FROM masked WHERE i < n GROUP BY 1, 2, 3)"""


@query(f"WITH {_CONTEXT} SELECT run_id, chunk_index, round(coalesce(least(3.0 * h / (n - 1), 1.0), 0.0), 6) AS context_boost FROM ({_TURN_SQL}) LEFT JOIN hits USING (run_id, chunk_index)")
def context_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter.context_cooccurrence(turns(spark, sf_dir), W).select("run_id", "chunk_index", _rounded(F.col("context_boost")).alias("context_boost"))


_TFIDF = f"""asked AS (SELECT * FROM (VALUES {', '.join(f'({-k - 1}, {q!r})' for k, q in enumerate(W.queries))}) v(chunk_index, chunk_text)),
 texts AS (SELECT run_id, chunk_index, chunk_text FROM ({_TURN_SQL}) UNION ALL SELECT run_id, chunk_index, chunk_text FROM (SELECT DISTINCT run_id FROM ({_TURN_SQL})), asked),
 tf AS (SELECT run_id, chunk_index, term, count(*) AS tf FROM (SELECT run_id, chunk_index, unnest(regexp_extract_all(lower(chunk_text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM texts) GROUP BY 1, 2, 3),
 size AS (SELECT run_id, count(*) AS n FROM texts GROUP BY 1),
 vocab AS (SELECT run_id, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT run_id, term, count(*) AS df, row_number() OVER (PARTITION BY run_id ORDER BY sum(tf) DESC, term) AS rank FROM tf GROUP BY 1, 2) JOIN size USING (run_id) WHERE rank <= 5000),
 x AS (SELECT run_id, chunk_index, term, tf * idf AS x FROM tf JOIN vocab USING (run_id, term)),
 norms AS (SELECT run_id, chunk_index, sqrt(sum(x * x)) AS norm FROM x GROUP BY 1, 2),
 dots AS (SELECT c.run_id, c.chunk_index, q.chunk_index AS query, sum(c.x * q.x) AS dot FROM x c JOIN x q ON c.run_id = q.run_id AND c.term = q.term WHERE c.chunk_index >= 0 AND q.chunk_index < 0 GROUP BY 1, 2, 3),
 best AS (SELECT d.run_id, d.chunk_index, max(dot / (a.norm * b.norm)) AS s FROM dots d JOIN norms a ON a.run_id = d.run_id AND a.chunk_index = d.chunk_index JOIN norms b ON b.run_id = d.run_id AND b.chunk_index = d.query GROUP BY 1, 2)"""


@query(f"WITH {_TFIDF} SELECT run_id, chunk_index, round(least(greatest(coalesce(s, 0.0), 0.0), 1.0), 9) AS lexical_score FROM ({_TURN_SQL}) LEFT JOIN best USING (run_id, chunk_index)")
def tfidf_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter.tfidf_relevance(turns(spark, sf_dir), W)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter.score_chunks(turns(spark, sf_dir), W)


_WEIGHED = f"""WITH {_CONTEXT}, {_TFIDF}, found AS ({_patterns(_TURN_SQL)}),
 facts AS (SELECT t.run_id, t.chunk_index, CASE WHEN contains('chat ' || role, 'th') OR contains('chat ' || role, 'ch') THEN 1.0 ELSE 0.0 END AS heading, CASE WHEN has_table OR has_list THEN 1.0 ELSE 0.0 END AS table_list, least(section_depth / 5.0::DOUBLE, 1.0::DOUBLE) AS depth,
  least(len({_LEX}), 5) AS n_exact, least(len(patterns), 3) AS n_pattern, coalesce(least(3.0::DOUBLE * h / (n - 1), 1.0::DOUBLE), 0.0::DOUBLE) AS boost, round(least(greatest(coalesce(s, 0.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE), 9) AS lex
  FROM ({_TURN_SQL}) t LEFT JOIN hits ON hits.run_id = t.run_id AND hits.chunk_index = t.chunk_index LEFT JOIN best ON best.run_id = t.run_id AND best.chunk_index = t.chunk_index JOIN found ON found.run_id = t.run_id AND found.chunk_index = t.chunk_index),
 weighed AS (SELECT run_id, chunk_index, {W.heading}::DOUBLE * heading::DOUBLE + {W.table_list}::DOUBLE * table_list::DOUBLE + {W.depth}::DOUBLE * depth AS structural, {W.exact}::DOUBLE * n_exact / 5.0::DOUBLE AS exact_match, {W.pattern}::DOUBLE * n_pattern / 3.0::DOUBLE AS pattern, {W.context}::DOUBLE * boost AS context_boost, {W.lexical}::DOUBLE * lex AS lexical FROM facts),
 decided AS (SELECT *, CASE WHEN prefilter_score >= {W.accept}::DOUBLE THEN 'keep' WHEN prefilter_score >= {W.gray}::DOUBLE THEN 'gray' ELSE 'reject' END AS decision FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, structural + exact_match + pattern + context_boost + lexical)) AS prefilter_score FROM weighed)),
 ranked AS (SELECT *, coalesce(lag(decision) OVER o, '') = 'keep' OR coalesce(lead(decision) OVER o, '') = 'keep' AS near, row_number() OVER (PARTITION BY run_id, decision ORDER BY prefilter_score DESC, chunk_index) AS r FROM decided WINDOW o AS (PARTITION BY run_id ORDER BY chunk_index))"""


@query(f"{_WEIGHED} SELECT run_id, chunk_index, round(prefilter_score, 6) AS prefilter_score, decision, decision = 'keep' OR (decision = 'gray' AND (near OR r <= {W.top_gray})) AS selected_for_llm FROM ranked")
def score_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("run_id", "chunk_index", _rounded(F.col("prefilter_score")).alias("prefilter_score"), "decision", "selected_for_llm")


@query(f"{_WEIGHED} SELECT run_id, chunk_index, round(prefilter_score, 6) AS prefilter_score, round(structural, 6) AS structural, round(exact_match, 6) AS exact_match, round(pattern, 6) AS pattern, round(context_boost, 6) AS context_boost, round(lexical, 6) AS lexical FROM ranked")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return s.select("run_id", "chunk_index", _rounded(F.col("prefilter_score")).alias("prefilter_score"), *(_rounded(F.element_at("feature_breakdown", k)).alias(k) for k in ("structural", "exact_match", "pattern", "context_boost", "lexical")))


#: Scores that need no text, so that decision and selection have SQL.
_SCORE = f"SELECT *, CAST((length(chunk_text) * 37 + chunk_index * 11) % 1000 AS DOUBLE) / 1000 AS prefilter_score FROM ({_TURNS})"
_DECIDED = f"decided AS (SELECT *, CASE WHEN prefilter_score >= 0.7 THEN 'keep' WHEN prefilter_score >= 0.3 THEN 'gray' ELSE 'reject' END AS decision FROM ({a.duck(_SCORE)}))"
_CHOSEN = f"{_DECIDED}, ranked AS (SELECT *, coalesce(lag(decision) OVER o, '') = 'keep' OR coalesce(lead(decision) OVER o, '') = 'keep' AS near, row_number() OVER (PARTITION BY run_id, decision ORDER BY prefilter_score DESC, chunk_index) AS r FROM decided WINDOW o AS (PARTITION BY run_id ORDER BY chunk_index)), chosen AS (SELECT *, decision = 'keep' OR (decision = 'gray' AND (near OR r <= 1)) AS selected_for_llm FROM ranked)"
W2 = prefilter.Weights(accept=0.7, gray=0.3, top_gray=1)


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter.threshold_decision(a.select(spark, sf_dir, _SCORE), W2)


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter.gray_zone_selection(decided(spark, sf_dir), W2)


@query(f"WITH {_DECIDED} SELECT run_id, chunk_index, decision FROM decided")
def threshold_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("run_id", "chunk_index", "decision")


@query(f"WITH {_CHOSEN} SELECT run_id, chunk_index, decision, selected_for_llm FROM chosen")
def gray_zone_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir).select("run_id", "chunk_index", "decision", "selected_for_llm")


@query(f"WITH {_CHOSEN} SELECT run_id, count(*) FILTER (decision = 'keep') AS accepted, count(*) FILTER (decision = 'reject') AS rejected, count(*) FILTER (decision = 'gray' AND selected_for_llm) AS gray_accepted, count(*) FILTER (decision = 'gray' AND NOT selected_for_llm) AS gray_rejected FROM chosen GROUP BY 1")
def prefilter_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter.prefilter_verdicts(chosen(spark, sf_dir))


@query(f"WITH {_CHOSEN} SELECT run_id, chunk_index FROM chosen WHERE decision = 'keep' OR (decision = 'gray' AND selected_for_llm)")
def select_for_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.select_for_extraction(chosen(spark, sf_dir)).select("run_id", "chunk_index")


@query(f"WITH {_DECIDED} SELECT run_id, chunk_index FROM decided WHERE decision = 'gray'")
def chunks_by_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.chunks_by_decision(decided(spark, sf_dir), "gray").select("run_id", "chunk_index")


# --- batches -------------------------------------------------------------------------------------------------------

_NESTED = "SELECT run_id, chunk_index, length(chunk_text) % 3 AS d, length(chunk_text) % 5 = 0 AS selected FROM ({0})"
_PATHED = "SELECT run_id, chunk_index, selected, CASE d WHEN 0 THEN ['a'] WHEN 1 THEN ['a', 'b'] ELSE ['a', 'b', 'c'] END AS section_path FROM (" + _NESTED.format(_TURN_SQL) + ")"


@query(f"WITH c AS ({_PATHED}), w AS (SELECT run_id, chunk_index, section_path[1:len(section_path) - k] AS parent FROM c, (VALUES (1), (2)) v(k) WHERE selected AND k <= len(section_path)), p AS (SELECT w.run_id, max(c.chunk_index) AS chunk_index FROM w JOIN c ON c.run_id = w.run_id AND c.section_path = w.parent AND c.chunk_index < w.chunk_index GROUP BY w.run_id, w.chunk_index, w.parent) SELECT run_id, chunk_index FROM c WHERE selected UNION SELECT run_id, chunk_index FROM p")
def expand_parent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = a.select(spark, sf_dir, _NESTED.format(_TURNS)).withColumn("section_path", F.expr("slice(array('a', 'b', 'c'), 1, cast(d + 1 as int))"))
    return batching.expand_parent_context(c, 2).select("run_id", "chunk_index")


_PACKED = f"""nth AS (SELECT run_id, chunk_index, chunk_text AS text, sha256(run_id || '/' || chunk_index) AS chunk_id, row_number() OVER (PARTITION BY run_id ORDER BY chunk_index) AS k, 'chat > ' || role AS path FROM ({_TURN_SQL})),
 sized AS (SELECT *, {_TOKENS} AS tok FROM nth),
 pack AS (SELECT run_id, k, tok AS used, 0 AS batch_index FROM sized WHERE k = 1 UNION ALL SELECT s.run_id, s.k, CASE WHEN p.used + s.tok > 400 THEN s.tok ELSE p.used + s.tok END, CASE WHEN p.used + s.tok > 400 THEN p.batch_index + 1 ELSE p.batch_index END FROM pack p JOIN sized s ON s.run_id = p.run_id AND s.k = p.k + 1),
 packed AS (SELECT s.*, batch_index FROM sized s JOIN pack USING (run_id, k)),
 glued AS (SELECT run_id, batch_index, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index) AS text, CAST(sum(tok) AS BIGINT) AS estimated_tokens, 'glued_' || left(sha256(array_to_string(list_sort(list(chunk_id)), ',')), 58) AS batch_id, array_to_string(list_sort(list(chunk_id)), ',') AS ids, arg_min(path, chunk_index) AS path FROM packed GROUP BY 1, 2)"""


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.pack_token_batches(turns(spark, sf_dir), 500)


def glued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.glue_batches(packed(spark, sf_dir))


@query(f"{_R}{_PACKED} SELECT run_id, chunk_index, batch_index FROM packed")
def pack_token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).select("run_id", "chunk_index", "batch_index")


@query(f"{_R}{_PACKED} SELECT run_id, batch_index, batch_id, sha256(text) AS text_sha, estimated_tokens FROM glued")
def glue_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glued(spark, sf_dir).select("run_id", "batch_index", "batch_id", F.sha2("text", 256).alias("text_sha"), "estimated_tokens")


@query(f"{_R}{_PACKED} SELECT run_id, batch_index, batch_id FROM glued")
def batch_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = packed(spark, sf_dir).groupBy("run_id", "batch_index").agg(F.collect_list("chunk_id").alias("ids"))
    return c.select("run_id", "batch_index", batching.batch_hash(F.col("ids")).alias("batch_id"))


@query(f"{_R}{_PACKED} SELECT run_id, batch_index, sha256('Chunk ID: ' || batch_id || chr(10) || 'Section path: ' || path || chr(10) || 'Estimated tokens: ' || estimated_tokens || chr(10) || 'Prompt version: v1' || chr(10) || 'Schema version: v1' || chr(10) || chr(10) || 'Extract actions from the chunk below.' || chr(10) || 'Return JSON only.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text) AS user_sha FROM glued")
def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.build_prompts(glued(spark, sf_dir), "Extract.").select("run_id", "batch_index", F.sha2("user_text", 256).alias("user_sha"))


@query(f"{_R}{_PACKED} SELECT run_id, batch_index, sha256('m|v1|v1|' || ids || '|v1') AS key_sha FROM glued")
def extraction_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.extraction_cache_key(glued(spark, sf_dir), "m").select("run_id", "batch_index", F.sha2("cache_key", 256).alias("key_sha"))


@query(f"{_R}{_PACKED} SELECT run_id, batch_index, batch_index % 2 = 0 AS cache_hit FROM glued")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = materialize(batching.extraction_cache_key(glued(spark, sf_dir), "m"), "batches")
    hits, misses = batching.cache_lookup(b, b.where("batch_index % 2 = 0").select("cache_key", F.lit("[]").alias("response")))
    return hits.select("run_id", "batch_index", "cache_hit").unionByName(misses.select("run_id", "batch_index", F.lit(False).alias("cache_hit")))


def echo(system: str, user: str) -> str:
    """A stand-in for a model: one action whose object is the number of characters it was shown."""
    return f'[{{"verb": "read", "primary_object": "{len(user)}"}}]'


@query(f"{_R}{_PACKED} SELECT run_id, batch_index, CAST(length(text) + length(batch_id) + length(path) + length(CAST(estimated_tokens AS VARCHAR)) + length('Chunk ID: Section path: Estimated tokens: Prompt version: v1Schema version: v1Extract actions from the chunk below.Return JSON only.---') + 11 AS VARCHAR) AS primary_object FROM glued")
def extract_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = materialize(batching.extraction_cache_key(batching.build_prompts(glued(spark, sf_dir), "Extract."), "m"), "prompts")
    answers = materialize(batching.extract_batches(b, echo), "answers")
    drafts = responses.explode_drafts(responses.parse_responses(answers, "response"))
    return b.join(drafts, "cache_key").select("run_id", "batch_index", "primary_object")


@query(DRAFTS_JSON[1])
def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = responses.parse_responses(a.select(spark, sf_dir, DRAFTS_JSON[0]))
    return p.select("event_id", "valid", "error_kind", F.size(F.coalesce("drafts", F.array())).cast("long").alias("n_drafts"))


@query(f"SELECT event_id, CASE WHEN error_kind IS NULL THEN 'valid' WHEN event_id % 2 = 0 THEN 'repaired' ELSE 'rejected' END AS status FROM ({DRAFTS_JSON[1]})")
def quarantine_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.select(spark, sf_dir, DRAFTS_JSON[0]).withColumn("repaired_response", F.when(F.col("event_id") % 2 == 0, F.lit("[]")))
    return responses.quarantine_invalid(rows).select("event_id", "status")


# --- parsing -------------------------------------------------------------------------------------------------------


@query()
def parse_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = parsing.parse_html_blocks(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return b.select("doc_id", "unit_index", "block_type", joined(F.col("section_path"), "/").alias("path"), "text")


#: Texts as Markdown: lines get marks by their length.
_MARKED = "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE length(x) % 5 WHEN 0 THEN '## ' || x WHEN 1 THEN '- ' || x WHEN 2 THEN '| ' || x ELSE x END), chr(10)) AS text FROM documents"


@query(f"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit_index FROM ({_MARKED})), b AS (SELECT doc_id, unit_index, CASE WHEN starts_with(line, '## ') THEN 'heading' WHEN starts_with(line, '- ') THEN 'list' WHEN starts_with(line, '|') THEN 'table' ELSE 'paragraph' END AS block_type, CASE WHEN starts_with(line, '## ') THEN trim(line[4:]) ELSE line END AS text FROM l WHERE line <> '')
 SELECT doc_id, unit_index, block_type, coalesce(last_value(CASE WHEN block_type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY unit_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS path, text FROM b""")
def parse_markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_blocks(spark, sf_dir).select("doc_id", F.col("unit_index").cast("long").alias("unit_index"), "block_type", joined(F.col("section_path"), "/").alias("path"), "text")


def marked_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) % 5 == 0, F.concat(F.lit("## "), x)).when(F.length(x) % 5 == 1, F.concat(F.lit("- "), x)).when(F.length(x) % 5 == 2, F.concat(F.lit("| "), x)).otherwise(x)), "\n")
    return parsing.parse_markdown_blocks(d.select("doc_id", marked.alias("text")))


@query(f"SELECT doc_id, coalesce(CASE WHEN starts_with(line, '## ') THEN trim(line[4:]) END, '') AS title FROM (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS line FROM ({_MARKED}))")
def document_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.document_title(marked_blocks(spark, sf_dir))


_BLOCKS = f"""l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM ({_MARKED})),
 b AS (SELECT doc_id, CASE WHEN starts_with(line, '## ') THEN 'heading' WHEN starts_with(line, '- ') THEN 'list' WHEN starts_with(line, '|') THEN 'table' ELSE 'paragraph' END AS block_type, CASE WHEN starts_with(line, '## ') THEN trim(line[4:]) ELSE line END AS text FROM l WHERE line <> '')"""


@query(f"""WITH {_BLOCKS} SELECT b.doc_id, b.text, block_type FROM b JOIN documents d ON d.doc_id = b.doc_id WHERE d.lang = 'en'
 UNION ALL SELECT doc_id, trim(text, ' ' || chr(10)), 'paragraph' FROM documents WHERE lang IS DISTINCT FROM 'en' AND trim(text, ' ' || chr(10)) <> ''""")
def parse_fallback_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all documents, as if the parser knew one language alone: the others become a paragraph each."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parsed = marked_blocks(spark, sf_dir).join(d.where("lang = 'en'").select("doc_id"), "doc_id", "left_semi")
    return parsing.with_fallback(parsed, d).select("doc_id", "text", "block_type")


@query("SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 2, turn) - 1 AS unit_index, 'part/' || (dense_rank() OVER (PARTITION BY conv_id ORDER BY turn % 2) - 1) || '/' || role AS path, turn FROM conversations")
def merge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), (F.col("turn") % 2).alias("part"), F.col("turn").alias("unit_index"), "turn", F.array("role").alias("section_path"))
    return parsing.merge_parts(c).select("doc_id", F.col("unit_index").cast("long").alias("unit_index"), joined(F.col("section_path"), "/").alias("path"), "turn")


@query("SELECT doc_id - doc_id % 4 AS doc_id, count(*) AS n_parts, arg_min(lang || ' ' || source, doc_id) AS title, CASE WHEN count(*) > 1 THEN 'multi' ELSE min(lang) END AS source_format FROM documents GROUP BY 1")
def merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four neighbouring documents are the parts of one."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return parsing.merged_documents(d.select((F.col("doc_id") - F.col("doc_id") % 4).alias("doc_id"), F.col("doc_id").alias("part"), F.concat_ws(" ", "lang", "source").alias("title"), F.col("lang").alias("source_format")))


@query(f"{_R}{a.UNITS_SQL} SELECT doc_id, sha256('{{\"title\":\"doc\",\"source_format\":\"text\",\"blocks\":[' || string_agg('{{\"type\":\"' || block_type || '\",\"n\":' || CASE WHEN length(text) > 500 THEN 503 ELSE length(text) END || '}}', ',' ORDER BY unit_index) || '],\"n_tables\":' || count(*) FILTER (block_type = 'table') || ',\"n_lists\":' || count(*) FILTER (block_type = 'list') || '}}') AS json_sha FROM units GROUP BY 1")
def write_parse_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    d = u.select("doc_id").distinct().select("doc_id", F.lit("doc").alias("title"), F.lit("text").alias("source_format"))
    out = ingest.parse_export(u, d)
    shape = F.from_json("json", "title string, source_format string, blocks array<struct<type:string,preview:string>>, n_tables long, n_lists long")
    small = F.to_json(F.struct(shape["title"].alias("title"), shape["source_format"].alias("source_format"), F.transform(shape["blocks"], lambda b: F.struct(b["type"].alias("type"), F.length(b["preview"]).alias("n"))).alias("blocks"), shape["n_tables"].alias("n_tables"), shape["n_lists"].alias("n_lists")))
    return out.select("doc_id", F.sha2(small, 256).alias("json_sha"))


@query(f"{_R}{SPLIT} SELECT doc_id, CAST(to_json(list({{chunk_id: chunk_id, section_path: section_path, estimated_tokens: estimated_tokens}} ORDER BY chunk_index)) AS VARCHAR) AS json FROM chunks GROUP BY 1")
def write_chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunk_manifest(chunks.assemble_chunks(units(spark, sf_dir), MAX_TOKENS))


@query("SELECT doc_id, strlen(text) AS size FROM documents")
def table_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "table")
    ingest.save_table(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length("text").cast("long").alias("size"), "lang"), path, ["lang"])
    return ingest.load_table(spark, path).select("doc_id", "size")


# --- vectors and streams -------------------------------------------------------------------------------------------

_COS = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"


#: Vectors that can be compared: finite and not zero.
_FINE = "SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


@query(f"SELECT q.vec_id AS query_id, v.vec_id, round({_COS}, 6) AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS rank FROM ({_FINE}) q JOIN ({_FINE}) v ON v.label = q.label AND v.vec_id <> q.vec_id AND len(v.embedding) = len(q.embedding) WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")  # the query set of the operator
    return vectors.vector_top_k(e, queries, 5, "label").select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), "rank")


def _streamed(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives until its input is used up, from the files it wrote."""
    spark, path = stream.sparkSession, folder(stream.sparkSession, "stream")
    streams.write_batches(stream, path, mode, f"{path}-checkpoint").awaitTermination()
    return streams.latest_snapshot(spark, path) if mode == "complete" else spark.read.parquet(path).drop("v")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = streams.read_stream(spark, f"{sf_dir}/events.parquet*", schema)
    return spark.sql(a.EVENTS, events=raw)


@query(f"SELECT run_id, arg_max(step, (created_at, event_id)) AS step, arg_max(event_type, (created_at, event_id)) AS event_type, count(*) AS n_events FROM ({a.EVENTS}) GROUP BY 1")
def stream_run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(streams.stream_run_state(event_stream(spark, sf_dir)), "complete")


@query(f"SELECT run_id, arg_max(step, (created_at, event_id)) AS step, arg_max(event_type, (created_at, event_id)) AS event_type, count(*) AS n_events FROM ({a.EVENTS}) GROUP BY 1")
def stream_run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of every run, from the changes that the stateful stream gives."""
    return streams.latest_changes(_streamed(streams.stream_run_changes(event_stream(spark, sf_dir)), "update"))


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS window_start, step, count(*) AS n_events, round(sum(value), 2) AS total_value FROM ({a.EVENTS}) GROUP BY 1, 2")
def stream_step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "stream")
    streams.write_batches(streams.stream_step_metrics(event_stream(spark, sf_dir)), path, "update", f"{path}-checkpoint").awaitTermination()
    return streams.last_updates(spark, path, ["window_start", "step"]).withColumn("total_value", F.round("total_value", 2))


@query(f"SELECT run_id, step, event_type FROM ({a.EVENTS}) GROUP BY 1, 2, 3")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(streams.stream_dedupe(event_stream(spark, sf_dir), ["run_id", "step", "event_type"], "created_at", "400 days").select("run_id", "step", "event_type"), "append")


_OPEN = ", ".join(f"last_value(CASE WHEN level = {k} THEN unit_index END IGNORE NULLS) OVER w AS i{k}, last_value(CASE WHEN level = {k} THEN text END IGNORE NULLS) OVER w AS h{k}" for k in range(1, 7))
_OPEN_PATH = ", ".join("CASE WHEN i{0} > greatest(-1, {1}) THEN h{0} END".format(k, ", ".join(f"coalesce(i{j}, -1)" for j in range(1, k)) or "-1") for k in range(1, 7))
#: Blocks of documents read as Markdown.
_DOC_UNITS = rf"""lines AS (SELECT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10))), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS unit_index FROM documents),
levels AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\s') THEN length(regexp_extract(line, '^(#+)', 1)) END AS level FROM lines WHERE line <> ''),
typed AS (SELECT doc_id, unit_index, level, CASE WHEN level IS NOT NULL THEN 'heading' WHEN regexp_matches(line, '^[-*]\s') THEN 'list' WHEN starts_with(line, '|') THEN 'table' ELSE 'paragraph' END AS block_type, CASE WHEN level IS NOT NULL THEN trim(regexp_replace(line, '^#+\s', '')) ELSE line END AS text FROM levels),
opened AS (SELECT *, {_OPEN} FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY unit_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
units AS (SELECT doc_id, unit_index, block_type, text, list_filter([{_OPEN_PATH}], lambda x: x IS NOT NULL) AS section_path FROM opened)"""


@query(f"{_R}{_DOC_UNITS}, {_GROUP}, {_split(chunks.MAX_TOKENS)} SELECT CAST(doc_id AS VARCHAR) AS run_id, chunk_id AS chunk_hash, chunk_index AS seq, estimated_tokens FROM chunks")
def stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = streams.read_stream(spark, f"{sf_dir}/documents.parquet*", schema)
    path = folder(spark, "stream")

    def process(batch: DataFrame) -> DataFrame:
        blocks = parsing.parse_markdown_blocks(batch)
        c = chunks.assemble_chunks(blocks)
        return c.select(F.col("doc_id").cast("string").alias("run_id"), F.col("chunk_id").alias("chunk_hash"), F.col("chunk_index").alias("seq"), F.col("chunk_index").alias("id"), "estimated_tokens")

    table = streams.BucketedTable(spark, path, ["run_id", "chunk_hash"], 16)
    streams.stream_documents(docs, process, streams.upsert_buckets(table, records.upsert_chunks), f"{path}-checkpoint").awaitTermination()
    return table.read().select("run_id", "chunk_hash", "seq", "estimated_tokens")


