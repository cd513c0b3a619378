import pandas as pd
import pytest

import __spark_entry__ as entry
from arcspan.plans import registry


def test_contract(spark):
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 60
    df = entry.entry(spark)
    assert df.count() == 25 and df.columns == ["type", "km", "observed", "total", "expected", "z"]


@pytest.mark.parametrize("name, columns", [("p1_found", ["place_id", "match_kind", "match_key"]), ("p3_found", ["src_table", "rec_key", "std_value"]), ("p4_found", ["place_id", "pos", "item"])])
def test_found_columns(spark, small, name, columns):
    df = registry.queries()[name](spark, small)
    assert df.columns == columns and df.count() > 0


def same(name, spark, small):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    a, b = registry.queries()[name](spark, small).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)

    def plain(v):
        return None if pd.isna(v) else round(float(v), 4) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    rows = lambda df: sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=str)
    for x, y in zip(rows(a), rows(b)):
        for v, w in zip(x, y):
            assert v == w or isinstance(v, float) and isinstance(w, float) and abs(v - w) <= 2e-4 * max(1.0, abs(v)), (x, y)


@pytest.mark.parametrize("name", ["corridor_counts", "gap_islands", "distance_anti_join", "nearest_class", "interval_bins", "dedup_site", "pole_scan", "mann_whitney", "cai_unpivot", "ripley_k", "directional_k", "c14_breakpoints", "cluster_assign", "hollow_stages", "straight_deviation", "prominence", "latitude_matched_poles", "interpolated_bins", "publication_year", "bootstrap_ratio", "mc_divergence", "fisher_exact", "welch_t", "granger_both", "block_bootstrap", "wavefront", "distance_self_density", "global_moran", "shuffle_null"])
def test_sql_agrees(spark, small, name):
    same(name, spark, small)


@pytest.mark.parametrize("name", ["kde_null", "mc_joint", "mc_marginal"])
def test_sql_agrees_where_keys_have_gaps(spark, small, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    duckdb.sql(f"copy (select * replace (c_custkey * 3 + 5 as c_custkey) from '{small}/customer.parquet') to '{tmp_path}/customer.parquet'")
    same(name, spark, str(tmp_path))


def test_prominence_agrees_to_the_last_digit(spark, small):
    """Sums of tenths over 192 places often end at a half of the sixth digit, where their last bits, and so their order, decide."""
    duckdb = pytest.importorskip("duckdb")
    duckdb.sql(f"create or replace view customer as select * from '{small}/customer.parquet'")
    df = registry.queries()["prominence"](spark, small)
    assert "BuildLeft" not in df._jdf.queryExecution().executedPlan().toString()  # the places around all points would be broadcast
    assert {r["id"]: r["prominence"] for r in df.collect()} == dict(duckdb.sql(registry.oracle_sql()["prominence"]).fetchall())
