"""Scores next to a half of the sixth digit are rounded as their SQL rounds them."""

import duckdb
import pytest
from factloom.plans import document_queries, queries


def text(tokens: int, hits: int) -> str:
    """A text of so many tokens with so many windows in which an action and an object stand."""
    at = {hits % 10, *range(20, 20 + 20 * (hits // 10), 20)} - {0}
    return " ".join("thetion" if k + 1 in at else "x" for k in range(tokens))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    sf = tmp_path_factory.mktemp("halves")
    cases = [(161, 47), (641, 111), (97, 1), (97, 31)]
    rows = [(c, turn, ("user", "assistant")[turn % 2], text(n, h)) for c, (n, h) in enumerate(cases) for turn in range(12)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    con.execute(f"COPY conversations TO '{sf}/conversations.parquet' (FORMAT parquet)")
    return str(sf), con


@pytest.mark.parametrize("name", ["context_cooccurrence", "score_chunks", "weighted_score"])
def test_halves(spark, folder, name):
    sf, con = folder
    df = document_queries.QUERIES[name](spark, sf)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
