"""Every registered query of the subpackage against its SQL, on the smallest tables."""

import pytest

from corpusloom.llm.queries import QUERIES
from tests.test_queries import DATA, compare, db  # noqa: F401


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):  # noqa: F811
    compare(spark, db, name)
