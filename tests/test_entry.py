import os

import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.01"
FAST = ["degrees_ns0", "redirect_statistics", "top_pages", "domain_authority", "page_profile", "bm25_title_unicode", "search_interactive", "search_batch", "grid_search_means", "ns_title_split"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in os.listdir(SF):
        db.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    got = e.queries()[name](spark, SF).toPandas()
    want = db.execute(e.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = lambda t: sorted(map(str, t[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_every_sql_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())
