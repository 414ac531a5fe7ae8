"""Uploads: content types, checks, and the document and version rows they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

#: Media type by extension, and extension by media type.
TYPE_OF = {"md": "text/markdown", "txt": "text/plain", "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
EXTENSION_OF = {"application/pdf": "pdf", "application/json": "json", "text/plain": "txt", "text/markdown": "md", "text/html": "html", "application/xml": "xml", "text/csv": "csv", "image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "application/msword": "doc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx"}
MAX_BYTES = 50 * 1024 * 1024
MAX_PARTS = 10


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def media_type(content_type: Column) -> Column:
    """The type without parameters, in lower case."""
    return F.lower(t.strip(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def infer_content_type(name: Column, content_type: Column) -> Column:
    """The given type; for a generic one, what the extension says."""
    generic = F.lit("application/octet-stream")
    given = F.when(F.coalesce(content_type, F.lit("")) == "", generic).otherwise(content_type)
    return F.when(media_type(content_type) == generic, F.coalesce(_lookup(TYPE_OF, t.extension(name)), content_type)).otherwise(given)


def read_raw_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modified, size and content of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def validate_uploads(uploads: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of (filename, content_type, size_bytes) with reject_reason, null where accepted."""
    ext, kind = t.extension(F.col("filename")), media_type(F.col("content_type"))
    reason = (
        F.when(t.is_blank(F.col("filename")), "filename is required")
        .when(F.col("size_bytes") > max_bytes, "file too large")
        .when(~ext.isin(*TYPE_OF), F.concat(F.lit("extension not allowed: "), F.when(ext == "", "(none)").otherwise(ext)))
        .when((kind != "") & ~kind.isin(*TYPE_OF.values()), F.concat(F.lit("content type not allowed: "), F.coalesce("content_type", F.lit("(none)"))))
    )
    return uploads.withColumn("reject_reason", reason)


def sanitize_filename(name: Column, longest: int = 512) -> Column:
    """The last part of a path without control characters."""
    base = t.strip(F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1))
    clean = F.substring(F.regexp_replace(base, r"[\x00-\x1f\x7f]", ""), 1, longest)
    return F.when(t.is_blank(name) | (clean == ""), F.lit("unnamed")).otherwise(clean)


def storage_key(document: Column, version: Column, content_type: Column, part: Column | None = None) -> Column:
    ext = F.coalesce(_lookup(EXTENSION_OF, media_type(content_type)), F.lit("bin"))
    name = F.lit("source") if part is None else F.concat(F.lit("part_"), part.cast("string"))
    return F.concat(F.lit("raw/"), document, F.lit("/"), version, F.lit("/"), name, F.lit("."), ext)


def ingest_documents(uploads: DataFrame) -> DataFrame:
    """Document rows of single files (document_id, version_id, filename, content_type, body)."""
    return uploads.select(
        F.col("document_id").alias("id"), sanitize_filename(F.col("filename")).alias("original_filename"), "content_type", F.octet_length("body").cast("long").alias("size_bytes"),
        F.sha2(F.col("body").cast("binary"), 256).alias("checksum_sha256"), storage_key(F.col("document_id"), F.col("version_id"), F.col("content_type")).alias("storage_key"), "version_id", F.lit(1).alias("version_number"),
    )


def ingest_multipart(parts: DataFrame, most: int = MAX_PARTS) -> DataFrame:
    """One document row of ordered files (document_id, version_id, part_index, filename, content_type, body).

    Bodies are reduced to their size and digest before the shuffle. More than ``most`` parts are refused by reject_reason."""
    p = parts.select("document_id", "version_id", "part_index", sanitize_filename(F.col("filename")).alias("filename"), "content_type", F.octet_length("body").cast("long").alias("size"), F.sha2(F.col("body").cast("binary"), 256).alias("sum"), storage_key(F.col("document_id"), F.col("version_id"), F.col("content_type"), F.col("part_index")).alias("key"))
    g = p.groupBy("document_id", "version_id").agg(F.count("*").alias("n_parts"), F.sum("size").alias("size_bytes"), F.array_sort(F.collect_list(F.struct("part_index", "filename", "content_type", "sum", "key"))).alias("p"))
    first = F.element_at("p", 1)
    name = F.when(F.col("n_parts") == 1, first["filename"]).otherwise(F.lit("Multi-file document"))
    return g.select(F.col("document_id").alias("id"), "version_id", "n_parts", name.alias("original_filename"), first["content_type"].alias("content_type"), "size_bytes", first["sum"].alias("checksum_sha256"), first["key"].alias("storage_key"), F.transform("p", lambda x: F.struct(x["key"].alias("storage_key"), x["content_type"].alias("content_type"))).alias("source_parts"), F.when(F.col("n_parts") > most, "too many parts").alias("reject_reason"))


def save_table(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Stores a record table as Parquet, partitioned by ``keys``; one writer at a time."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def load_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def jdbc_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A record table of a database, split among tasks by the options of Spark's JDBC source."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def parse_export(units: DataFrame, documents: DataFrame) -> DataFrame:
    """One JSON a document: title, format, previews of its blocks, numbers of tables and lists."""
    preview = F.when(F.length("text") > 500, F.concat(F.substring("text", 1, 500), F.lit("..."))).otherwise(F.col("text"))
    g = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit_index", F.col("block_type").alias("type"), preview.alias("preview")))).alias("b"), F.count_if(F.col("block_type") == "table").alias("n_tables"), F.count_if(F.col("block_type") == "list").alias("n_lists"))
    j = documents.join(g, "doc_id")
    return j.select("doc_id", F.to_json(F.struct("title", "source_format", F.transform("b", lambda x: F.struct(x["type"].alias("type"), x["preview"].alias("preview"))).alias("blocks"), "n_tables", "n_lists")).alias("json"))


def chunk_manifest(chunks: DataFrame) -> DataFrame:
    """One JSON array a document: id, path and tokens of its chunks."""
    g = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "section_path", "estimated_tokens"))).alias("c"))
    return g.select("doc_id", F.to_json(F.transform("c", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["section_path"].alias("section_path"), x["estimated_tokens"].alias("estimated_tokens")))).alias("json"))


def write_json(rows: DataFrame, path: str, buckets: int = 256) -> None:
    """Writes (doc_id, json) rows as JSON lines in a bounded number of folders, dealt by doc_id."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
    rows.select("doc_id", "json", bucket.alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def read_action_model_v2(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Actions, object states and connections of nested model files, as ``model_v2_to_v1`` takes them.

    ``model`` tells files apart; connections keep their place in their file."""
    schema = (
        "model_actions array<struct<action_id:string,action_actor:string,action_action:string,action_place:string>>,"
        "model_objects array<struct<object_id:string,object_name:string,resource_state:array<struct<state_id:string,state_name:string>>>>,"
        "model_connections array<struct<connection_out:string,connection_in:string>>"
    )
    raw = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.input_file_name().alias("model"), "*")
    actions = raw.select("model", F.explode("model_actions").alias("a")).select("model", "a.action_id", F.col("a.action_actor").alias("actor"), F.col("a.action_action").alias("action"), F.col("a.action_place").alias("place"))
    objects = raw.select("model", F.explode("model_objects").alias("o")).select("model", "o.object_id", "o.object_name", F.explode("o.resource_state").alias("s"))
    states = objects.select("model", "object_id", "object_name", "s.state_id", "s.state_name")
    links = raw.select("model", F.posexplode("model_connections").alias("pos", "c")).select("model", "pos", F.col("c.connection_out").alias("out_id"), F.col("c.connection_in").alias("in_id"))
    return actions, states, links
