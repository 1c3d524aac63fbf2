"""Every query of the posting engine against its SQL, on the smallest tables."""

import pytest

from rolecall.plans import catalog
from tests.conftest import SMALL, rows


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SMALL)) == rows(duck.sql(catalog.oracle_sql()[name]))
