from __future__ import annotations

import pytest
from compare import assert_same

from sievelight.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(name, spark, sf_dir, duck):
    assert_same(registry.queries()[name](spark, sf_dir), duck, registry.oracle_sql()[name])
