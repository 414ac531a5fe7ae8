"""Blocks of HTML: no word lost, none glued, whatever the tags; tables whole."""

import re
from html import unescape

import pyarrow.parquet as pq
import pytest
from factloom.operators import batching, parsing
from hypothesis import given, settings
from hypothesis import strategies as st

TAGS = "p div b i span h1 h2 ul ol li table tr td th dl dt dd blockquote pre section a br hr".split()


def shown(html):
    """The words of a page: inline tags vanish, all others part words."""
    html = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<title>[^<]*(</title>)?|<!doctype[^>]*>", " ", html)
    return unescape(re.sub(r"<(/?)([a-zA-Z0-9]+)[^>]*>", lambda m: "" if m[2].lower() in parsing.INLINE else " ", html)).split()


def words(blocks):
    out = []
    for kind, _, text in blocks:
        if kind == "table":
            lines = [x for k, x in enumerate(text.split("\n")) if k != 1]
            cells = [c for line in lines for c in re.split(r"(?<!\\)\|", line)]
            out += " ".join(cells).replace("\\|", "|").split()
        else:
            out += text.split()
    return out


@given(st.lists(st.one_of(st.tuples(st.sampled_from(["<", "</"]), st.sampled_from(TAGS)).map(lambda x: f"{x[0]}{x[1]}>"), st.sampled_from(["one", "two ", " three", "a|b", "&amp;", " "])), max_size=40))
@settings(max_examples=400, deadline=None)
def test_no_word_is_lost_or_glued(parts):
    html = "".join(parts)
    assert sorted(words(parsing.html_blocks(html))) == sorted(shown(html))


def test_pages_keep_their_words(sf):
    for html in pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist():
        for page in (html, html[: len(html) // 2], html.replace("</title>", ""), html.replace("</p>", "").replace("</li>", "")):
            cut = page if page.rfind("<") <= page.rfind(">") else page[: page.rfind("<")]
            assert words(parsing.html_blocks(cut)) == shown(cut)


@pytest.mark.parametrize(("html", "blocks"), [
    ("<title>open<h1>Head</h1><p>text", [("heading", 1, "Head"), ("paragraph", 0, "text")]),
    ("<blockquote>q</blockquote><pre>a\n  b </pre><dl><dt>k<dd>v</dl><section>s", [("paragraph", 0, "q"), ("paragraph", 0, "a\n  b"), ("paragraph", 0, "k"), ("paragraph", 0, "v"), ("paragraph", 0, "s")]),
    ("<ul><li>one<li>two<ul><li>in</ul>after</ul>end", [("list", 0, "one"), ("list", 0, "two"), ("list", 0, "in"), ("list", 0, "after"), ("paragraph", 0, "end")]),
    ("<table><tr><th>a<th>b<tr><td>1<td>x|y<tr><td>only</table>", [("table", 0, "| a | b |\n| --- | --- |\n| 1 | x\\|y |\n| only |  |")]),
    ("<table><tr><td>out<table><tr><td>in<td>ner</table>side</table>", [("table", 0, "| out in ner side |\n| --- |")]),
    ("<h2>open <p>para<b>bold</b></p>", [("heading", 2, "open"), ("paragraph", 0, "parabold")]),
    ("<li><div>a</div><p>b</p></li><h3><div>c</div></h3>", [("list", 0, "a"), ("list", 0, "b"), ("heading", 3, "c")]),
    ("<script>x<p></script><style>y</style>z<!-- c --><template>t</template>", [("paragraph", 0, "z")]),
    (None, []), ("", []), ("<table></table><p> </p>", []),
])
def test_trees(html, blocks):
    assert parsing.html_blocks(html) == blocks


def test_documents_of_parts(spark):
    parts = spark.createDataFrame([("d", 3, "Third", "md"), ("d", 7, "Seventh", "txt"), ("e", 1, None, "md")], "doc_id string, part int, title string, source_format string")
    assert sorted(map(tuple, parsing.merged_documents(parts).collect())) == [("d", 2, "Third", "multi"), ("e", 1, "", "md")]
    blocks = spark.createDataFrame([("d", 3, 0, ["x"]), ("d", 7, 0, [])], "doc_id string, part int, unit_index int, section_path array<string>")
    assert sorted((r.unit_index, r.section_path) for r in parsing.merge_parts(blocks).collect()) == [(0, ["part", "0", "x"]), (1, ["part", "1"])]


def test_calls_tell_what_they_took(spark):
    def call(system, user):
        if user == "down":
            raise TimeoutError
        return batching.Answer("[]", 100, 7, 200) if user == "counted" else None if user == "none" else "x" * 40

    rows = spark.createDataFrame([(k, "s" * 8, k) for k in ("counted", "plain", "down", "none")], "cache_key string, system_text string, user_text string")
    got = {r.cache_key: r for r in batching.extract_batches(rows, call, 2, 1, delay=0, model="m", prices=(1.0, 2.0)).collect()}
    assert (got["counted"].input_tokens, got["counted"].output_tokens, got["counted"].status_code, got["counted"].estimated_cost_usd) == (100, 7, 200, 114 / 1e6)
    assert (got["plain"].response, got["plain"].input_tokens, got["plain"].output_tokens, got["plain"].model) == ("x" * 40, 3, 10, "m")
    assert (got["down"].error_kind, got["down"].retry_count, got["down"].input_tokens) == ("TimeoutError", 1, None)
    assert got["none"].response is None and got["none"].error_kind is None and all(r.latency_ms >= 0 and not r.cache_hit for r in got.values())
