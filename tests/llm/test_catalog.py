"""The problems' queries on the smallest tables."""

import glob
import os

import duckdb
import pytest

from bidweave.llm import catalog

COLUMNS = {
    "p1_found": ["seq_a", "seq_b"], "p2_found": ["seq", "field_name"], "p3_found": ["seq", "field_name", "pii_type"], "p4_found": ["record_kind", "record_id"],
    "p5_found": ["record_kind", "record_id"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_runs(spark, small, name):
    df = catalog.QUERIES[name](spark, small)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(map(tuple, rows))) == len(rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_twin(spark, small, name):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    theirs = sorted(map(tuple, con.execute(catalog.SQL[name]).df().to_numpy().tolist()))
    assert sorted(map(tuple, catalog.QUERIES[name](spark, small).collect())) == theirs


def test_shares_and_groups_agree_with_their_parts(spark, small):
    mixture = catalog.p7_mixture(spark, small).selectExpr("sum(tokens * uses) AS n").first()["n"]
    assert catalog.p7_shares(spark, small).selectExpr("sum(reached_tokens) AS n").first()["n"] == mixture
    groups = {r["seq"]: r["group_seq"] for r in catalog.p1_groups(spark, small).collect()}
    for r in catalog.p1_found(spark, small).collect():
        assert groups[r["seq_a"]] == groups[r["seq_b"]] <= r["seq_a"]
