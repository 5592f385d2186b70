"""Oracle parity on a representative subset: the Spark query and its DuckDB SQL give the same rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
NAMES = ["ex8_oob_score_background", "sa1_sample_n", "sa2_sample_matched", "wi2_auc", "jo1_anti_by_key",
         "bl2_decision_tree", "fc1_contributions", "ag5_draw_counts"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels", "lineitem", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    srows = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in df.collect())
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    drows = sorted(repr(tuple(_norm(r[i]) for i in idx)) for r in cur.fetchall())
    assert srows == drows
