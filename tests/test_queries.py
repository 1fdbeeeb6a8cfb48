import pytest

import __spark_entry__
from gridtide.plans import registry
from tests.conftest import DATA
from tests.oracle import same

FREE = sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_oracle(spark, name):
    assert same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], f"{DATA}/sf0.001") > 0


@pytest.mark.parametrize("name", FREE)
def test_query_without_oracle_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["series", "utc_start", "load_mw", "lag48h", "lag168h", "std4"]
    assert frame.count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
