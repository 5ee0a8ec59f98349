"""Every registered query against its DuckDB oracle on the smallest tables
(the round driver repeats this at sf0.01)."""

import pytest

import __spark_entry__ as E
from corpusprep.plans import registry
from tests.oracle_check import duck, frame_digest

registry.load_all()
KEYS = sorted(registry.QUERIES)
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con(smoke_dir):
    return duck(smoke_dir)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, smoke_dir, key):
    got = E.queries()[key](spark, smoke_dir).toPandas()
    if key not in ORACLES:
        assert len(got.columns) > 0
        return
    want = con.execute(ORACLES[key]).df()
    c1, n1, h1, r1 = frame_digest(got)
    c2, n2, h2, r2 = frame_digest(want)
    assert c1 == c2
    assert n1 == n2
    assert h1 == h2, (sorted(set(r1) - set(r2))[:3], sorted(set(r2) - set(r1))[:3])


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["conv_id", "pos", "token_id", "noisy_id", "label", "prompt_mask", "p_mask", "answer_len"]
