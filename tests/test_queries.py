"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import pandas as pd
import pytest

from chronoweave.plans import registry


def _same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)

    def plain(df):
        df = df[cols].copy()
        for c in cols:
            if df[c].dtype.kind == "f":
                df[c] = df[c].round(5) + 0.0
        return df.astype(str).sort_values(cols).reset_index(drop=True)

    pd.testing.assert_frame_equal(plain(a), plain(b), check_dtype=False)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, sf, name):
    _same(registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
