"""Selected chunks with their parents, packed into batches of bounded tokens, and the calls made for them."""

from __future__ import annotations

import time
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..sources import staging

#: What stands between the texts of a batch, and the prompt's lines (``build_prompts``).
SEPARATOR = "\n\n---\n\n"
OVERHEAD = 100

#: Rows of a block are 2 to this power; up to 33, the bits that number the rows of a partition.
BLOCK_BITS = 14


def select_for_extraction(chunks: DataFrame) -> DataFrame:
    return chunks.where((F.col("decision") == "keep") | ((F.col("decision") == "gray") & F.col("selected_for_llm")))


def expand_parent_context(chunks: DataFrame, levels_up: int = 1) -> DataFrame:
    """The selected chunks and, for each level up, the nearest earlier chunk with the parent path.

    An as-of join without inequality: wanted parents and chunks share one window by run and path, in which each wanted
    row takes the last chunk before it."""
    rows = chunks.select("run_id", "chunk_index", "section_path", "selected")
    here = rows.select("run_id", F.col("section_path").alias("path"), "chunk_index", F.col("chunk_index").alias("candidate"))
    depth = F.least(F.lit(levels_up), F.size("section_path"))
    want = rows.where("selected").where(depth > 0).select("run_id", "chunk_index", "section_path", F.explode(F.sequence(F.lit(1), depth)).alias("k"))
    want = want.select("run_id", F.slice("section_path", 1, F.size("section_path") - F.col("k")).alias("path"), "chunk_index", F.lit(None).cast("int").alias("candidate"))
    before = Window.partitionBy("run_id", "path").orderBy("chunk_index").rangeBetween(Window.unboundedPreceding, -1)
    found = here.unionByName(want.withColumn("candidate", F.lit(None).cast(here.schema["candidate"].dataType))).withColumn("parent", F.last("candidate", ignorenulls=True).over(before)).where("candidate is null and parent is not null")
    keep = found.select("run_id", F.col("parent").alias("chunk_index")).unionByName(rows.where("selected").select("run_id", "chunk_index")).distinct()
    return chunks.join(keep, ["run_id", "chunk_index"], "left_semi")


def pack_token_batches(chunks: DataFrame, max_input_tokens: int, system_tokens: int = 0, overhead: int = OVERHEAD) -> DataFrame:
    """batch_index of every chunk: a batch closes when the next chunk would pass what is available.

    The fold over a run's chunks is cut into blocks, so that a run of any size is spread over tasks, and only sizes take part;
    a chunk's own columns are shuffled once, for the join with its batch:

    1. Sizes are sorted by run and chunk_index over all partitions and cut into blocks of 2 ** ``BLOCK_BITS`` rows.
    2. A block says of its first and last run what comes out for every amount that may be in use when it begins: the closed batches
       and what the open one holds. Chains of batches soon meet, so few cases differ; there are at most as many as tokens available.
    3. A run's blocks are chained by these cases, a row a block, and each block numbers its batches from what it is given.

    A chunk above what is available is a batch alone; with nothing available every chunk is. Tokens that are null or negative
    count as none. Rows that repeat a run and chunk_index are one chunk of their total tokens and share its batch; null runs and
    indices are values like others, and come first. A batch_index that is there already is replaced."""
    available = max_input_tokens - system_tokens - overhead
    available = available if available > 0 else -1  # less than any batch holds
    if "batch_index" in chunks.columns:
        chunks = chunks.drop("batch_index")
    tokens = F.greatest(F.coalesce(F.col("estimated_tokens").cast("long"), F.lit(0)), F.lit(0))
    sizes = staging.materialize(chunks.groupBy("run_id", "chunk_index").agg(F.sum(tokens).alias("tokens")), "chunk-sizes")
    placed = sizes.repartitionByRange("run_id", "chunk_index").sortWithinPartitions("run_id", "chunk_index").withColumn("at", F.monotonically_increasing_id())
    placed = staging.materialize(placed.withColumn("block", F.shiftright("at", BLOCK_BITS)), "chunk-blocks")
    begun = _chain(_block_cases(placed.drop("chunk_index"), available), available)

    def number(rows: pa.Table, given: pa.Table) -> pa.Table:
        rows, given = rows.sort_by("at"), given.sort_by("block_at")
        heads = np.zeros(rows.num_rows, bool)
        heads[_heads(rows.column("run_id"))] = True
        batch, used = given.column("batch")[0].as_py(), given.column("used")[0].as_py()
        heads[0], out = used is None, []
        for head, tokens in zip(heads.tolist(), rows.column("tokens").to_pylist(), strict=True):
            if head:
                batch, used = 0, tokens
            elif used + tokens > available:
                batch, used = batch + 1, tokens
            else:
                used += tokens
            out.append(batch)
        return pa.table({"run_id": rows.column("run_id"), "chunk_index": rows.column("chunk_index"), "batch_index": pa.array(out, pa.int32())})

    schema = StructType([placed.schema["run_id"], placed.schema["chunk_index"], StructField("batch_index", IntegerType())])
    numbered = placed.groupBy("block").cogroup(begun.groupBy("block")).applyInArrow(number, schema)
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("run_id", "chunk_index")]
    return chunks.alias("c").join(numbered.alias("b"), same[0] & same[1]).select("c.*", "b.batch_index")


def _heads(runs: pa.ChunkedArray) -> np.ndarray:
    """Where a run begins in sorted rows."""
    code = runs.combine_chunks().dictionary_encode(null_encoding="encode")
    code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))


def _block_cases(placed: DataFrame, available: int) -> DataFrame:
    """(run_id, block, block_at, total, fresh_closed, fresh_used, cases) of a block's first and last run, which other blocks may hold too.

    A case (room, closed, used): with less room than ``room`` in the open batch, and not less than the case before, ``closed``
    batches follow it in the block and the last holds ``used``. With more room than any case has, all chunks fit.
    ``fresh_closed`` and ``fresh_used`` are those of a batch that begins with the block: at the begin of a run, or after a batch
    that holds more than is available."""

    def cases(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        at, size, runs = rows.column("at").to_numpy(), rows.column("tokens").to_numpy(), rows.column("run_id")
        heads, out = np.append(_heads(runs), rows.num_rows), []
        ends = sorted({0, len(heads) - 2})
        for i, j in zip(heads[ends], heads[np.array(ends) + 1], strict=True):
            n, total = j - i, np.concatenate([[0], np.cumsum(size[i:j])])
            # step: the chunk that begins the next batch after one begun at a chunk; n: none
            step = np.append(np.maximum(np.searchsorted(total, total[:-1] + available, "right") - 1, np.arange(1, n + 1)), n)
            closed, final, reach = (step < n).astype(np.int64), np.arange(n + 1), 1
            final = np.where(step < n, step, final)
            while reach < n:  # doubled steps: batches begun after a chunk, and where the last of them begins
                closed, final, reach = closed + closed[final], final[final], 2 * reach
            used = total[n] - total[final]
            last = min(max(int(np.searchsorted(total, available, "right")) - 1, 0), n - 1)
            room = total[1 : last + 2]
            open_ = np.flatnonzero(size[i : i + last + 1] > 0)  # chunks that can be the first not to fit
            a, b, c = room[open_], 1 + closed[open_], used[open_]
            keep = np.append((b[1:] != b[:-1]) | (c[1:] != c[:-1]), True) if len(a) else np.zeros(0, bool)
            out.append((int(at[i]), int(total[n]), (int(closed[0]), int(used[0])), a[keep], b[keep], c[keep]))
        first = pa.array([x[2][0] for x in out]), pa.array([x[2][1] for x in out])
        lists = [pa.array([x[k] for x in out], pa.list_(pa.int64())) for k in (3, 4, 5)]
        block = rows.column("block").take(pa.array(heads[ends]))
        return pa.table([runs.take(pa.array(heads[ends])), block, pa.array([x[0] for x in out]), pa.array([x[1] for x in out]), *first, *lists], names=_CASES)

    types = [placed.schema["run_id"].dataType, *[LongType()] * 5, *[ArrayType(LongType())] * 3]
    return placed.groupBy("block").applyInArrow(cases, StructType([StructField(n, t) for n, t in zip(_CASES, types, strict=True)]))


_CASES = ["run_id", "block", "block_at", "total", "fresh_closed", "fresh_used", "room", "closed", "used"]


def _chain(cases: DataFrame, available: int) -> DataFrame:
    """(block, block_at, batch, used) of the runs of ``cases``: the number of the batch open before and its tokens; null tokens where the run begins."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, batch, used = object(), 0, 0
        for rows in batches:
            out = []
            for r, _, _, total, fresh_closed, fresh_used, room, closed, left in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if r != run:
                    out.append((0, None))
                    run, batch, used = r, fresh_closed, fresh_used
                    continue
                out.append((batch, used))
                k = bisect_right(room, available - used)
                if used > available:
                    batch, used = batch + 1 + fresh_closed, fresh_used
                elif k < len(room):
                    batch, used = batch + closed[k], left[k]
                else:
                    used += total
            yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["block", "block_at", "batch", "used"])

    order = cases.repartition("run_id").sortWithinPartitions("run_id", "block_at")
    return order.mapInArrow(chain, "block long, block_at long, batch long, used long")


def batch_hash(hashes):
    return F.concat(F.lit("glued_"), F.substring(F.sha2(F.array_join(F.array_sort(hashes), ","), 256), 1, 58))


def glue_batches(batched: DataFrame) -> DataFrame:
    """One row a batch: texts joined in order, path of the first chunk, tokens, constituents and the batch's hash."""
    g = batched.groupBy("run_id", "batch_index").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "chunk_text", "section_path"))).alias("c"), F.sum("estimated_tokens").alias("estimated_tokens"))
    ids = F.transform("c", lambda x: x["chunk_id"])
    return g.select("run_id", "batch_index", batch_hash(ids).alias("batch_id"), F.array_join(F.transform("c", lambda x: x["chunk_text"]), SEPARATOR).alias("text"), F.element_at("c", 1)["section_path"].alias("section_path"), "estimated_tokens", ids.alias("constituents"))


def build_prompts(batches: DataFrame, system: str, hint: str | None = None, prompt_version: str = "v1", schema_version: str = "v1") -> DataFrame:
    """system and user text of every batch. ``system`` is the caller's instruction, ``hint`` an addition to it."""
    where = F.when(F.size("section_path") > 0, F.array_join("section_path", " > ")).otherwise(F.lit("(root)"))
    head = F.format_string(f"Chunk ID: %s\nSection path: %s\nEstimated tokens: %s\nPrompt version: {prompt_version}\nSchema version: {schema_version}\n\n", F.col("batch_id"), where, F.col("estimated_tokens").cast("string"))
    user = F.concat(head, F.lit("Extract actions from the chunk below.\nReturn JSON only.\n\n---\n\n"), F.col("text"))
    return batches.withColumns({"system_text": F.lit(system if not hint else f"{system}\n\n{hint.strip()}"), "user_text": user})


def extraction_cache_key(batches: DataFrame, model: str, prompt_version: str = "v1", schema_version: str = "v1", normalization_version: str = "v1") -> DataFrame:
    key = F.concat_ws("|", F.lit(model), F.lit(prompt_version), F.lit(schema_version), F.array_join(F.array_sort("constituents"), ","), F.lit(normalization_version))
    return batches.withColumn("cache_key", key)


def cache_lookup(batches: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their stored response, one batch of each missing key)."""
    hits = batches.join(cache.select("cache_key", "response"), "cache_key").withColumn("cache_hit", F.lit(True))
    misses = batches.join(cache, "cache_key", "left_anti").dropDuplicates(["cache_key"])
    return hits, misses


@dataclass(frozen=True)
class Answer:
    """What a call returns besides plain text: the tokens it took, as its provider counts them."""

    text: str | None
    input_tokens: int | None = None
    output_tokens: int | None = None
    status_code: int | None = None


#: Columns of a call beside its key and response.
CALL = "error_kind string, retry_count int, latency_ms long, input_tokens long, output_tokens long, status_code int, estimated_cost_usd double, model string, cache_hit boolean"


def extract_batches(prompts: DataFrame, call: Callable[[str, str], str | Answer | None], concurrency: int = 8, retries: int = 2, delay: float = 15.0, transient: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), key: str = "cache_key", model: str | None = None, prices: tuple[float, float] | None = None) -> DataFrame:
    """Answers of ``call(system, user)`` with what each call took: key, response and the columns of ``CALL``.

    Transient errors are tried again after ``delay`` seconds, a batch that still fails has error_kind. Latency is that of the
    last try. Tokens are what an ``Answer`` says, else a quarter of the characters; ``prices`` are dollars for a million of
    input and of output tokens. As many tasks run as calls are allowed at once. Write the result before using it: a task that
    runs again calls again."""
    kind = prompts.schema[key].dataType.simpleString()
    rough = lambda *texts: max(1, sum(len(x or "") for x in texts) // 4)

    def one(system: str, user: str) -> tuple:
        answer, error, used, took = None, None, 0, 0
        for used in range(retries + 1):
            began = time.monotonic()
            try:
                answer, error = call(system, user), None
                took = time.monotonic() - began
                break
            except transient as e:
                error, took = type(e).__name__, time.monotonic() - began
                if used < retries:
                    time.sleep(delay)
        if answer is not None and not isinstance(answer, Answer):
            answer = Answer(answer)
        tokens = (None, None)
        if answer is not None:
            tokens = (rough(system, user) if answer.input_tokens is None else answer.input_tokens, rough(answer.text) if answer.output_tokens is None else answer.output_tokens)
        cost = None if prices is None or answer is None else (tokens[0] * prices[0] + tokens[1] * prices[1]) / 1e6
        return (answer and answer.text, error, used, int(took * 1000), *tokens, answer and answer.status_code, cost, model, False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "response", *(x.split()[0] for x in CALL.split(", "))]
        for pdf in batches:
            rows = [(k, *one(system, user)) for k, system, user in zip(pdf[key], pdf.system_text, pdf.user_text, strict=True)]
            yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("input_tokens", "output_tokens", "status_code")})

    return prompts.select(key, "system_text", "user_text").repartition(concurrency).mapInPandas(run, f"{key} {kind}, response string, {CALL}")
