"""Every registered query against its SQL."""

import __spark_entry__
import numpy as np
import pytest

from millrace import catalog


def comparable(df):
    df = df[sorted(df.columns)]

    def text(x):
        if isinstance(x, (list, np.ndarray)):
            return str([int(v) for v in x])
        if x is None or x != x:
            return ""
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(text(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)


def test_entry_and_contract(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
