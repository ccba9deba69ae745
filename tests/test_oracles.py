"""Every query that SQL can express gives the rows that DuckDB gives."""

import pytest

from sparklode import plans
from tests.conftest import SMALL
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_oracle(spark, name):
    same(spark, plans.queries()[name], plans.oracle_sql()[name], SMALL)
