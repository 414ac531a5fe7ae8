"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Each turn becomes ``<|role|>text</s>``; the characters that make up these controls are escaped in roles and texts, so
the output parses back to the turns. Every assistant turn becomes an example of its own: the text runs from the start of
the conversation to the end of that reply, and the loss mask covers the reply's text alone. Turns after the last reply
form one example without loss, so that the output holds every turn.

A conversation is gathered in two steps, blocks of turns first, so that one conversation's rows meet in one task only
as a few blocks. Examples carry the conversation's formatted text once through the explode and cut their own prefix from
it; no shuffle moves prefixes. Null texts and roles are empty; a null turn comes first, equal turns are ordered by role
and text, repeated rows are turns of their own, a null conv_id is a conversation of its own; an empty table gives no
examples. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TURNS = 256
#: Escape letters of the characters used in controls; the backslash itself is undone last.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("|", "\\p"), ("[", "\\b"))
OPEN, CLOSE, END = "<|", "|>", "</s>"


def escape(text: Column) -> Column:
    for char, code in ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for char, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and blocks: for each turn in order, its escaped role and text, in arrays of ``BLOCK_TURNS`` turns at most.

    Turns are gathered by blocks of turn numbers, which spreads a conversation over tasks; a block in which numbers repeat is cut again."""
    t = turns.select(turns[conv_id].alias("conv_id"), turns[turn].cast("long").alias("turn"), F.coalesce(turns[role], F.lit("")).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text"))
    blocks = t.groupBy("conv_id", F.floor(F.col("turn") / BLOCK_TURNS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("block", F.lit(-(1 << 62))).alias("block"), "turns"))).alias("blocks"))
    cut = lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.size(b["turns"]) - 1) / BLOCK_TURNS).cast("int")), lambda i: F.slice(b["turns"], i * BLOCK_TURNS + 1, F.lit(BLOCK_TURNS)))
    whole = whole.select("conv_id", F.flatten(F.transform("blocks", cut)).alias("blocks"))
    escaped = F.transform("blocks", lambda b: F.transform(b, lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text"))))
    return whole.select("conv_id", escaped.alias("blocks"))


def block_spans(parts: Column, reply_role: str) -> Column:
    """end, n, reply and spans of one block: its characters, its replies, whether a reply is last, and where replies stand."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"), F.lit(False).alias("reply"), F.expr("cast(array() as array<struct<example:int,loss_start:int,loss_end:int>>)").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["end"] + F.length(x["part"])
        reply = x["role"] == escape(F.lit(reply_role))
        stop = end - F.lit(len(END))
        span = F.struct(acc["n"].alias("example"), (stop - x["body"]).alias("loss_start"), stop.alias("loss_end"))
        return F.struct(end.alias("end"), F.when(reply, acc["n"] + 1).otherwise(acc["n"]).alias("n"), reply.alias("reply"), F.when(reply, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, start, step)


def prefix_targets(turns: DataFrame, reply_role: str = "assistant", **columns) -> DataFrame:
    """conv_id, example, is_last, text, loss_start and loss_end (0-based characters of text) of every example.

    Spans are found block by block and moved by what the blocks before hold, so that no array grows turn by turn."""
    c = conversations(turns, **columns)
    formatted = lambda x: F.struct(x["role"].alias("role"), F.length(x["text"]).alias("body"), F.concat(F.lit(OPEN), x["role"], F.lit(CLOSE), x["text"], F.lit(END)).alias("part"))
    c = c.select("conv_id", F.transform("blocks", lambda b: F.transform(b, formatted)).alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: F.array_join(F.transform(b, lambda x: x["part"]), "")), "")
    c = c.select("conv_id", text.alias("whole"), F.transform("blocks", lambda b: block_spans(b, reply_role)).alias("found"))

    place = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"), F.expr("cast(array() as array<struct<end:int,n:int>>)").alias("before"))
    add = lambda acc, b: F.struct((acc["end"] + b["end"]).alias("end"), (acc["n"] + b["n"]).alias("n"), F.concat(acc["before"], F.array(F.struct(acc["end"].alias("end"), acc["n"].alias("n")))).alias("before"))
    c = c.select("conv_id", "whole", "found", F.aggregate("found", place, add).alias("total"))
    moved = F.zip_with("found", "total.before", lambda b, at: F.transform(b["spans"], lambda s: F.struct((s["example"] + at["n"]).alias("example"), (s["loss_start"] + at["end"]).alias("loss_start"), (s["loss_end"] + at["end"]).alias("loss_end"))))
    rest = F.struct(F.col("total.n").alias("example"), F.col("total.end").alias("loss_start"), F.col("total.end").alias("loss_end"))
    spans = F.when(F.element_at("found", -1)["reply"], F.flatten(moved)).otherwise(F.concat(F.flatten(moved), F.array(rest)))
    c = c.select("conv_id", "whole", spans.alias("spans"))
    e = c.select("conv_id", "whole", F.size("spans").alias("n"), F.explode("spans").alias("s"))
    last = F.col("s.example") == F.col("n") - 1
    upto = F.when(last, F.length("whole")).otherwise(F.col("s.loss_end") + len(END))
    return e.select("conv_id", F.col("s.example").alias("example"), last.alias("is_last"), F.when(last, F.col("whole")).otherwise(F.substring(F.col("whole"), F.lit(1), upto)).alias("text"), F.col("s.loss_start").alias("loss_start"), F.col("s.loss_end").alias("loss_end"))


def parse_turns(text: Column) -> Column:
    """The roles and texts of a formatted text."""
    parts = F.filter(F.split(text, END), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(unescape(F.substring(F.substring_index(p, CLOSE, 1), len(OPEN) + 1, 1 << 30)).alias("role"), unescape(F.substring(p, F.locate(CLOSE, p) + len(CLOSE), F.length(p))).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """For each conversation, from the examples alone: turns, digests of all turns and of all text under the mask, size."""
    e = examples.select("conv_id", "example", F.when(F.col("is_last"), F.col("text")).alias("whole"), F.length("text").cast("long").alias("chars"), unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("loss"))
    g = e.groupBy("conv_id").agg(F.max("whole").alias("whole"), F.sum("chars").alias("formatted_chars"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"))
    g = g.withColumn("turns", parse_turns(F.col("whole")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return g.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
