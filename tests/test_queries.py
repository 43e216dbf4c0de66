"""Registered queries: contract, and a cross-section of them against their SQL."""
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from alphaloom.catalog import REGISTRY
from tools.check_oracle import TABLES, canon

DATA = Path("/root/testdata/sf0.001")
ROWS_ONLY: set[str] = set()
CHECKED = (
    "ts_momentum", "ts_ewma", "ts_triple_barrier", "cs_rank", "bt_metrics", "bt_portfolio", "wf_evaluate",
    "dsr_deflated", "vr_permutation", "sig_consensus", "svr_date_matched_bootstrap", "ledger_record",
    "tca_report", "join_asof_latest", "cal_unified", "kill_switch_batch",
)


def test_every_query_has_sql_except_the_named_ones():
    assert set(REGISTRY) <= set(entry.queries())
    assert set(REGISTRY) - set(entry.oracle_sql()) == ROWS_ONLY
    assert len(REGISTRY) >= 146


@pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert "sharpe_ratio" in df.columns and df.count() > 0
