"""JSON answers as drafts, or the first thing that is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

#: The keys of an answer's objects.
KEYS = ("verb", "primary_object", "primary_actor", "input_state", "output_state", "action_label", "suggested_actor_canonical", "suggested_object_canonical", "suggested_verb_canonical", "suggested_state_canonical")
DRAFT = "array<struct<" + ",".join(f"{k}:string" for k in KEYS) + ">>"


def parse_responses(answers: DataFrame, column: str = "raw_response") -> DataFrame:
    """drafts (null if invalid), valid and error_kind. Values are read as VARIANT, so that a number is not a string."""
    v = F.try_parse_json(F.col(column))
    a = answers.withColumn("_v", v).withColumn("_kind", F.schema_of_variant("_v"))
    items = F.when(F.startswith("_kind", F.lit("ARRAY")), F.expr("try_variant_get(_v, '$', 'array<variant>')"))
    a = a.withColumn("_items", F.coalesce(items, F.expr("cast(array() as array<variant>)")))

    def wrong(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        fields = F.try_variant_get(x, "$", "map<string,variant>")
        odd_key = F.exists(F.map_keys(fields), lambda k: ~k.isin(*KEYS))
        odd_value = F.exists(F.map_values(fields), lambda y: ~F.coalesce(F.schema_of_variant(y), F.lit("VOID")).isin("STRING", "VOID"))
        return F.when(~F.startswith(F.coalesce(kind, F.lit("VOID")), F.lit("OBJECT")), "item_not_object").when(odd_key, "unknown_key").when(odd_value, "not_string")

    first = F.get(F.filter(F.transform("_items", wrong), lambda e: e.isNotNull()), F.lit(0))
    error = (
        F.when(t.is_blank(F.col(column)), "empty")
        .when(F.col("_v").isNull(), "not_json")
        .when(~F.startswith("_kind", F.lit("ARRAY")), "not_array")
        .otherwise(first)
    )
    a = a.withColumn("error_kind", error)
    drafts = F.when(F.col("error_kind").isNull(), F.from_json(F.col(column), DRAFT))
    return a.withColumns({"valid": F.col("error_kind").isNull(), "drafts": drafts}).drop("_v", "_kind", "_items")


def quarantine_invalid(answers: DataFrame, column: str = "raw_response", repaired: str = "repaired_response") -> DataFrame:
    """Drafts of the answer, else of its repaired form; ``status`` is valid, repaired or rejected."""
    a = parse_responses(answers, column).withColumnsRenamed({"valid": "_ok", "drafts": "_drafts", "error_kind": "_error"})
    b = parse_responses(a, repaired)
    status = F.when(F.col("_ok"), "valid").when(F.col("valid"), "repaired").otherwise("rejected")
    drafts = F.when(F.col("_ok"), F.col("_drafts")).when(F.col("valid"), F.col("drafts"))
    return b.withColumn("status", status).withColumn("drafts", drafts).withColumn("error_kind", F.col("_error")).drop("_ok", "_drafts", "_error", "valid")


def explode_drafts(parsed: DataFrame) -> DataFrame:
    return parsed.where("drafts is not null").select(*(c for c in parsed.columns if c != "drafts"), F.posexplode("drafts").alias("draft_index", "d")).select("*", "d.*").drop("d")
