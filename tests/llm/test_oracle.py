"""Queries of the subpackage against their SQL."""

import pytest

from grainguard.llm.queries import ORACLE, QUERIES
from tests.oracle import DATA, compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_as_the_oracle(spark, name):
    folder = f"{DATA}/sf0.01"
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) is None
