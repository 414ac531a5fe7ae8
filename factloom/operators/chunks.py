"""Section-aware chunks of ordered blocks.

Blocks are rows (doc_id, unit_index, section_path, block_type, text). Everything is keyed by document and ordered by
unit_index; one shuffle by document serves the fold, and the group and chunk tables that follow are smaller."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as t

MAX_TOKENS = 4000
OVERLAP_CHARS = 80


def with_column(rows: pa.RecordBatch, name: str, values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(values, pa.int32())], names=[*rows.schema.names, name])


def joins_group(previous: str, previous_path: list, kind: str, path: list) -> bool:
    """Whether a block may follow another one in a group, by their types."""
    if kind == "heading":
        return False
    if (previous, kind) in (("heading", "paragraph"), ("heading", "list"), ("heading", "table"), ("table", "paragraph"), ("list", "list")):
        return True
    return previous_path == path and previous == kind


def group_units(units: DataFrame) -> DataFrame:
    """Blocks with group_id: consecutive blocks whose paths lie under the first one's and whose types go together.

    A fold over each document's blocks in order; its state is the open group, so partitions stream through it. Rows pass
    as Arrow batches with their columns as they are."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, head, prior, prior_path, group = object(), [], "", [], -1
        for rows in batches:
            ids = []
            for d, path, kind in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "section_path", "block_type")), strict=True):
                path = path or []
                if d != doc:
                    doc, head, group = d, path, 0
                elif not (path[: len(head)] == head and joins_group(prior, prior_path, kind, path)):
                    head, group = path, group + 1
                prior, prior_path = kind, path
                ids.append(group)
            yield with_column(rows, "group_id", ids)

    order = units.repartition("doc_id").sortWithinPartitions("doc_id", "unit_index")
    return order.mapInArrow(fold, StructType([*units.schema.fields, StructField("group_id", IntegerType())]))


def assemble_groups(grouped: DataFrame) -> DataFrame:
    """One row a group: first path, text joined by blank lines, features, and its last heading."""
    first = lambda c: F.min_by(c, "unit_index")
    g = grouped.groupBy("doc_id", "group_id").agg(
        first("section_path").alias("section_path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_index", "text"))), lambda x: x["text"]), "\n\n").alias("text"),
        F.count("*").alias("n_units"), F.bool_or(F.col("block_type") == "table").alias("has_table"), F.bool_or(F.col("block_type") == "list").alias("has_list"),
        F.max_by("text", F.when(F.col("block_type") == "heading", F.col("unit_index"))).alias("heading"),
    )
    return g.withColumn("section_depth", F.size("section_path"))


def split_text(text: str, width: int) -> list[str]:
    """Greedy parts of ``width`` characters, cut back to the last blank line within; stripped, empty ones left out."""
    parts, start = [], 0
    while start < len(text):
        end = min(start + width, len(text))
        if end < len(text) and (at := text.rfind("\n\n", start, end + 1)) > start:
            end = at + 2
        parts.append(text[start:end].strip())
        start = end
    return [p for p in parts if p]


def split_oversize(groups: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Groups as rows of parts (part from 0); only those above the limit pass through Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = pdf.text.map(lambda s: list(enumerate(split_text(s, 4 * max_tokens))))
            rows = pdf.assign(part=parts).explode("part").dropna(subset=["part"])
            yield pd.DataFrame({"doc_id": rows.doc_id, "group_id": rows.group_id, "part": [p[0] for p in rows.part], "text": [p[1] for p in rows.part]})

    large = t.estimate_tokens(F.col("text")) > max_tokens
    rest = [c for c in groups.columns if c != "text"]
    kind = groups.schema["doc_id"].dataType.simpleString()
    parts = groups.where(large).select("doc_id", "group_id", "text").mapInPandas(run, f"doc_id {kind}, group_id int, part int, text string")
    cut = groups.where(large).select(*rest).join(parts, ["doc_id", "group_id"])
    return groups.where(~large).withColumn("part", F.lit(0)).unionByName(cut)


def context_prefix(parts: DataFrame, chars: int = OVERLAP_CHARS) -> DataFrame:
    """Text after a note of the last heading in earlier groups of the document."""
    earlier = Window.partitionBy("doc_id").orderBy("group_id").rangeBetween(Window.unboundedPreceding, -1)
    note = F.last(F.nullif("heading", F.lit("")), ignorenulls=True).over(earlier)
    prefixed = F.concat(F.lit("[Context: "), F.substring("_note", 1, chars), F.lit("]\n\n"), F.col("text"))
    return parts.withColumn("_note", note).withColumn("text", F.when(F.col("_note").isNotNull(), prefixed).otherwise(F.col("text"))).drop("_note")


def chunk_ids(parts: DataFrame) -> DataFrame:
    """chunk_index within the document, chunk_id over path, text and index, and the token estimate."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("group_id", "part")) - 1
    p = parts.withColumn("chunk_index", nth).withColumn("estimated_tokens", t.estimate_tokens(F.col("text")))
    return p.withColumn("chunk_id", F.sha2(F.concat(t.list_repr(F.col("section_path")), F.lit(":"), F.col("text"), F.lit(":"), F.col("chunk_index").cast("string")), 256))


def assemble_chunks(units: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Chunks of blocks: group, join, split, prefix, number."""
    return chunk_ids(context_prefix(split_oversize(assemble_groups(group_units(units)), max_tokens), overlap))


def chunk_llm_text(title: str, path: str, text: str):
    """Title, section and text for a model; parts that are empty are left out."""
    named = F.when(F.coalesce(F.col(title), F.lit("")) != "", F.concat(F.lit("Document: "), F.col(title)))
    section = F.when(F.size(path) > 0, F.concat(F.lit("Section: "), F.array_join(path, " / ")))
    return F.concat_ws("\n\n", named, section, F.nullif(text, F.lit("")))
