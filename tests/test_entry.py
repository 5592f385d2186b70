"""Driver contract smoke test: entry() on sf0.001 and the registry's shape."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "y", "oob_score", "n_votes"]
    assert df.count() > 0


def test_registry_names_and_sql_subset():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    names = set(q) - {"pipeline"}
    assert all(name.split("_")[0][:2].isalpha() and any(ch.isdigit() for ch in name.split("_")[0]) for name in names)
