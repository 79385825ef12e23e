"""The driver's contract, and the queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__

#: Their SQL takes long, or they are checked with hand-made data elsewhere.
SLOW = {"title_links"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(d: pd.DataFrame) -> list:
    def show(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return str([show(x) for x in v])
        if v is None or pd.isna(v):
            return "-"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return f"{float(v):.5f}" if isinstance(v, (int, float, np.number)) else str(v)

    return sorted(tuple(show(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))


def own(found: dict) -> dict:
    """Without the training-data operators, which have tests of their own."""
    return {n: q for n, q in found.items() if q.__module__.startswith(("proofsearch.queries", "proofsearch.more_queries"))}


QUERIES, SQL = own(__spark_entry__.queries()), __spark_entry__.oracle_sql()
#: Queries that only tests with hand-made data hold to a result; here, the columns that are never null.
UNCHECKED = {
    "passage_chunks": ["document_id", "passage_id", "text"], "link_hop": ["query_id", "document_id", "score"], "pii_full": ["doc_id", "counts"], "screening": ["query_id"],
    "complexity_tier": ["query_id"], "interpretations": ["query_id"], "constraints_extract": ["query_id"], "text_claims": [], "near_duplicate_sentences": [], "chain_support": [],
    "bootstrap_ci": [], "paired_diff_ci": [], "event_frames": [], "property_graph": [], "entity_resolution": [], "rag_top_sentence": ["query_id"], "second_hop": ["query_id", "document_id"],
    "evidence": ["query_id"], "statement_drafts": ["query_id"], "multi_query": ["query_id", "document_id", "score"],
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL) - SLOW))
def test_query_matches_its_sql(name, spark, sf, con):
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(UNCHECKED) - set(SQL)))
def test_query_gives_whole_rows(name, spark, sf):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) or name in ("text_claims", "constraints_extract")
    assert got[UNCHECKED[name]].notna().all().all()


def test_every_query_is_checked():
    assert set(QUERIES) - set(SQL) - set(UNCHECKED) <= {"search_answers"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
