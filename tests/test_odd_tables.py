"""Queries against their SQL on small tables with odd rows."""

import duckdb
import pytest

from lodestrata.plans.registry import ORACLES, QUERIES


@pytest.fixture
def differing(spark, tmp_path):
    """Rows of a query and of its SQL that the other lacks, over tables given as SQL."""

    def run(name, **tables):
        c = duckdb.connect()
        for t, sql in tables.items():
            c.sql(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet'")
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
        c.sql(f"CREATE VIEW got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
        columns = ", ".join(f'"{x}"' for x in sorted(c.sql("FROM got").columns))
        got, want = f"SELECT {columns} FROM got", f"SELECT {columns} FROM ({ORACLES[name]})"
        return c.sql(f"({got}) EXCEPT ALL ({want})").fetchall(), c.sql(f"({want}) EXCEPT ALL ({got})").fetchall()

    return run


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_ordered_listings_with_nulls_and_equal_days(spark, differing, coalesced):
    """Also with each range a partition of its own."""
    sf = "/root/testdata/sf0.001"
    orders = f"SELECT * REPLACE (CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 3 <> 0 THEN date_trunc('year', o_orderdate)::DATE END AS o_orderdate) FROM '{sf}/orders.parquet'"
    customer = f"SELECT * REPLACE (CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS c_mktsegment) FROM '{sf}/customer.parquet'"
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, coalesced)
    try:
        assert differing("ordered_listings", orders=orders, customer=customer, nation=f"FROM '{sf}/nation.parquet'") == ([], [])
    finally:
        spark.conf.unset(key)


DOCUMENTS = """SELECT (100 - i)::BIGINT AS doc_id, lang, source, text FROM (VALUES
    (1, 'en', 'a', '!!!'), (2, 'en', 'b', '???'), (3, 'en', 'b', ''), (4, 'de', 'c', '...'), (5, 'de', 'a', '-'),
    (6, 'en', 'a', 'Write to ltd.64@mail6'), (7, 'en', 'b', 'write to LTD.64@mail6'), (8, 'en', 'c', 'Write to 64@mail6'), (9, 'en', 'd', 'Ltd.'), (10, 'en', 'e', 'inc'), (11, 'en', 'a', 'Inc.'),
    (12, 'en', 'a', NULL), (13, 'de', 'b', NULL), (14, NULL, 'b', 'words'), (15, NULL, 'c', NULL), (16, NULL, 'b', 'words'), (17, 'de', 'a', 'Straße 1'), (18, 'de', 'b', 'STRASSE 1')) t(i, lang, source, text)"""


@pytest.mark.parametrize("name", ["cross_source_resolve", "merge_counts", "count_by_source", "cross_source_clusters"])
def test_documents_with_empty_texts_company_forms_and_nulls(differing, name):
    sf = "/root/testdata/sf0.001"
    others = {t: f"FROM '{sf}/{t}.parquet'" for t in ("orders", "customer", "nation")}
    assert differing(name, documents=DOCUMENTS, **others) == ([], [])
