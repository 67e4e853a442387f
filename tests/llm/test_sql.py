"""Queries of the corpus operators against their SQL."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from loomspan.llm import registry  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        db.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, expected = registry.queries()[name](spark, SF).toPandas(), db.sql(registry.oracle_sql()[name]).df()
    cols = sorted(expected.columns)
    assert cols == sorted(got.columns)
    tidy = lambda f: f[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert tidy(got).equals(tidy(expected))


def test_every_operator_has_a_query():
    assert sorted({int(n[2:].split("_")[0]) for n in registry.queries()}) == list(range(1, 14))
