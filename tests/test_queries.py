"""Every registered query of the reference's operators beside its SQL, on the smallest tables."""

import pytest
from compare import difference, duck_rows

from cuelake.plans import ORACLES, QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Rules that so few rows as the smallest tables' don't break.
RARE = ("ck01_unique_model_config_ids", "ck10_snapshot_unique_ids")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), ORACLES[name], SF) is None
    assert duck_rows(ORACLES[name], LARGER if name in RARE else SF)[1], "no rows to compare"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_point():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
