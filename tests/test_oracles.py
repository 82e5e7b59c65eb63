"""Every query that has an oracle gives the oracle's rows on the smallest tables."""
import pytest

import __spark_entry__ as E
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
# Dozens of trainings each; tests/test_learn.py and tests/test_pipeline.py cover them on smaller frames,
# tests/run_oracles.py runs them against their oracles.
MANY_FITS = {"cv_fold_f1", "tune", "pipeline_report"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - MANY_FITS))
def test_query_matches_oracle(spark, con, name):
    r = compare(E.queries()[name](spark, SF), con, E.oracle_sql()[name])
    assert r["cols"], (r["spark_cols"], r["duck_cols"])
    assert r["rows"][0] == r["rows"][1]
    assert r["hash"]


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["split", "label", "n", "sources", "n_locations"]
    assert df.count() > 0
