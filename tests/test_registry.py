"""The registered queries run on the smallest tables and agree with their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from conftest import SF

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SAMPLE = [
    "a09_discover_dedupe", "b05_constant_within_group", "c10_overlay", "d03_stratified_group_folds", "e08_log1p",
    "f08_nested_select", "g04_auprc", "h05_cindex_within_stratum", "i04_boot_fold_label", "j08_kruskal_wallis",
    "k04_decision_patterns", "l17_calibration_ecology", "m09_parse_response", "n04_label_audit",
]


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 200


def test_entry(spark):
    assert entry_module.entry(spark).columns


@pytest.mark.parametrize("name", SAMPLE)
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry_module.queries()[name](spark, SF).toPandas()
    want = con.execute(entry_module.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    columns = sorted(got.columns)
    text = lambda d: sorted(
        "|".join("NULL" if v != v or v is None else (f"{float(v):.8g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in row)
        for row in d[columns].astype(object).itertuples(index=False)
    )
    assert text(got) == text(want)
