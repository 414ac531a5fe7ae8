"""Ordered blocks of Markdown and HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

LEVELS = 6


def _paths(blocks: DataFrame) -> DataFrame:
    """section_path from level (null unless heading): the open headings above, then the block's own."""
    upto = Window.partitionBy("doc_id").orderBy("unit_index").rowsBetween(Window.unboundedPreceding, 0)
    b = blocks
    for k in range(1, LEVELS + 1):
        b = b.withColumn(f"_h{k}", F.last(F.when(F.col("level") == k, F.struct("unit_index", "text")), ignorenulls=True).over(upto))
    open_ = [F.when(F.coalesce(F.greatest(F.lit(-1), F.lit(-1), *(F.col(f"_h{j}.unit_index") for j in range(1, k))) < F.col(f"_h{k}.unit_index"), F.lit(False)), F.col(f"_h{k}.text")) for k in range(1, LEVELS + 1)]
    return b.withColumn("section_path", F.array_compact(F.array(*open_))).drop(*(f"_h{k}" for k in range(1, LEVELS + 1)))


def parse_markdown_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of Markdown or plain text: ``#`` headings, ``-`` and ``*`` lists, ``|`` tables, else paragraphs."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("unit_index", "line"))
    lines = lines.withColumn("line", t.strip(F.col("line"))).where("line <> ''")
    level = F.when(F.col("line").rlike(r"^#{1,6}\s"), F.length(F.regexp_extract("line", "^(#+)", 1)))
    kind = F.when(level.isNotNull(), "heading").when(F.col("line").rlike(r"^[-*]\s"), "list").when(F.startswith("line", F.lit("|")), "table").otherwise("paragraph")
    body = F.when(level.isNotNull(), t.strip(F.regexp_replace("line", r"^#+\s", ""))).otherwise(F.col("line"))
    blocks = lines.select("doc_id", "unit_index", level.alias("level"), kind.alias("block_type"), body.alias("text"))
    return _paths(blocks).drop("level")


#: Elements that stand within a line; all others stand apart, their text is never joined to a neighbour's.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is not shown; elements without content.
SILENT, EMPTY = frozenset("script style template title".split()), frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {f"h{k}": k for k in range(1, LEVELS + 1)}
#: What a start tag ends: open elements of these names, down to the nearest of those.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",))),
}
#: Elements that headings cannot hold and so end one that was left open.
NOT_IN_HEADINGS = frozenset(("p", "ul", "ol", "dl", "table", "pre", "blockquote", "section", "article", *HEADINGS))


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[str]] = []

    def markdown(self) -> str:
        width = max(map(len, self.rows), default=0)
        rows = ["| " + " | ".join([*row, *[""] * (width - len(row))]) + " |" for row in self.rows]
        return "\n".join([*rows[:1], "|" + " --- |" * width, *rows[1:]]) if any(map(any, self.rows)) else ""


class _Blocks(HTMLParser):
    """Blocks (kind, level, text) of a page: headings, list items, tables as Markdown, and paragraphs, which are all the rest.

    Open block elements are a stack. Start tags end what they cannot stand in, end tags end what was opened since; those of
    nothing open only part the text. A block's text is the text between two borders of blocks, white space collapsed (kept
    by lines in ``pre``); its kind is that of the nearest heading, list item or cell around it. A table within a cell is
    text of the cell. A title ends at the next element that stands apart, at the latest, so one left open hides nothing else."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int, str]] = []
        self.open: list[str] = []
        self.tables: list[_Table] = []
        self.text: list[str] = []
        self.hidden: list[str] = []

    def set_cdata_mode(self, elem: str, **options) -> None:
        if elem in ("script", "style"):  # a title left open is no text to the end
            super().set_cdata_mode(elem, **options)

    def flush(self) -> None:
        """The text so far becomes a block, or goes on in its cell."""
        raw, self.text = "".join(self.text), []
        text = "\n".join(x.rstrip() for x in raw.strip("\n").split("\n")).rstrip() if "pre" in self.open and not self.tables else " ".join(raw.split())
        if not text.strip():
            return
        if self.tables:
            rows = self.tables[0].rows
            if not rows:
                rows.append([])
            if not rows[-1]:
                rows[-1].append("")
            rows[-1][-1] = f"{rows[-1][-1]} {text.replace('|', chr(92) + '|')}".strip()
            return
        around = next((x for x in reversed(self.open) if x in HEADINGS or x == "li"), "")
        self.out.append(("heading", HEADINGS[around], text) if around in HEADINGS else ("list" if around else "paragraph", 0, text))

    def close_upto(self, names, borders=()) -> None:
        """Ends the outermost open element of these names above the nearest border, with all that was opened in it."""
        at = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] in borders:
                break
            if self.open[k] in names:
                at = k
        while at is not None and len(self.open) > at:
            self.pop()

    def pop(self) -> None:
        if self.open.pop() == "table":
            table = self.tables.pop()
            if not self.tables and (text := table.markdown()):
                self.out.append(("table", 0, text))

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in SILENT:
            self.flush()
            self.hidden.append(tag)
            return
        if tag in INLINE:
            return
        self.hidden = [x for x in self.hidden if x != "title"]
        if tag == "br":
            self.text.append("\n")
            return
        self.flush()
        names, borders = ENDS.get(tag, ((), ()))
        self.close_upto(names, borders)
        self.close_upto(("p",), ("li", "td", "th", "dd", "blockquote", "div", "section", "article", "table", "body"))
        if tag in NOT_IN_HEADINGS:
            self.close_upto(HEADINGS, ("table", "section", "article", "li"))
        if tag in EMPTY:
            return
        self.open.append(tag)
        if tag == "table":
            self.tables.append(_Table())
        elif len(self.tables) == 1 and tag == "tr":
            self.tables[0].rows.append([])
        elif len(self.tables) == 1 and tag in ("td", "th"):
            if not self.tables[0].rows:
                self.tables[0].rows.append([])
            self.tables[0].rows[-1].append("")

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            if tag in self.hidden:
                self.hidden.remove(tag)
        elif tag not in INLINE:
            if tag == "head":
                self.hidden = [x for x in self.hidden if x != "title"]
            self.flush()
            if tag in self.open:
                last = len(self.open) - 1 - self.open[::-1].index(tag)
                if tag in ("body", "html") or "table" not in self.open[last + 1 :]:  # an end tag in a table does not end what holds the table
                    while len(self.open) > last:
                        self.pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)

    def finish(self) -> list[tuple[str, int, str]]:
        self.close()
        self.flush()
        while self.open:
            self.pop()
        return self.out


def html_blocks(html: str | None) -> list[tuple[str, int, str]]:
    parser = _Blocks()
    parser.feed(html or "")
    return parser.finish()


def parse_html_blocks(pages: DataFrame, doc_id: str = "page_id", html: str = "html") -> DataFrame:
    """Blocks of HTML pages: doc_id, unit_index, block_type, text and section_path; a null or empty page has none."""
    kind = pages.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, k, *b) for d, h in zip(pdf.doc_id, pdf.html, strict=True) for k, b in enumerate(html_blocks(h))]
            yield pd.DataFrame(rows, columns=["doc_id", "unit_index", "block_type", "level", "text"])

    blocks = pages.select(F.col(doc_id).alias("doc_id"), F.col(html).alias("html")).mapInPandas(run, f"doc_id {kind}, unit_index int, block_type string, level int, text string")
    return _paths(blocks).drop("level")


def with_fallback(blocks: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without blocks but with text become one paragraph without path."""
    rest = docs.select(F.col(doc_id).alias("doc_id"), t.strip(F.col(text)).alias("text")).where("text <> ''").join(blocks.select("doc_id").distinct(), "doc_id", "left_anti")
    extra = rest.select("doc_id", F.lit(0).alias("unit_index"), F.lit("paragraph").alias("block_type"), "text", F.expr("cast(array() as array<string>)").alias("section_path"))
    return blocks.unionByName(extra)


def document_title(blocks: DataFrame, fallback: Column | None = None) -> DataFrame:
    """The first block's text where it is a heading."""
    first = blocks.groupBy("doc_id").agg(F.min_by(F.struct("block_type", "text"), "unit_index").alias("b"))
    return first.select("doc_id", F.when(F.col("b.block_type") == "heading", F.col("b.text")).otherwise(fallback if fallback is not None else F.lit("")).alias("title"))


def merge_parts(blocks: DataFrame) -> DataFrame:
    """Blocks of (doc_id, part, unit_index, ...) as one document each: numbered through, paths under ("part", place among the parts)."""
    order = Window.partitionBy("doc_id").orderBy("part", "unit_index")
    place = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("part")) - 1
    path = F.concat(F.array(F.lit("part"), place.cast("string")), F.col("section_path"))
    return blocks.withColumns({"section_path": path, "unit_index": F.row_number().over(order) - 1})


def merged_documents(parts: DataFrame) -> DataFrame:
    """doc_id, n_parts, title and source_format of documents from rows (doc_id, part, title, source_format): the first part's, and ``multi`` for several."""
    first = F.min_by(F.struct("title", "source_format"), F.struct("part", "title", "source_format"))
    g = parts.groupBy("doc_id").agg(F.count_distinct("part").alias("n_parts"), first.alias("f"))
    return g.select("doc_id", "n_parts", F.coalesce("f.title", F.lit("")).alias("title"), F.when(F.col("n_parts") > 1, F.lit("multi")).otherwise(F.col("f.source_format")).alias("source_format"))
