"""Registered queries against their SQL twins; TRACEWELL_ALL=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
import oracle

SF = os.environ.get("TRACEWELL_SF_DIR", "/root/testdata/sf0.001")
SOME = [
    "agg_13_quantiles", "aud_16_input_gate_end", "evt_06_report_table", "jn_02_interpolated_reference", "met_07_risk_coverage",
    "aud_02_file_errors", "aud_16_input_gate_file_order", "dec_03_gated_estimate", "exp_03_distance_explanation", "met_08_fitted_combination", "str_02_online_windowed_score",
    "prj_17_array_ops", "spl_05_severity_blocked", "str_01_online_alarm", "win_02_multi_window_dataset", "win_10_persistent_alarm_legacy",
]
NAMES = sorted(entry.queries()) if os.environ.get("TRACEWELL_ALL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    ok, message = oracle.compare(df, con, sql)
    assert ok, message


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
