"""Every query of the core that has SQL gives what the SQL gives; the others run."""

import pytest

from cairn.compare import differences, duck
from cairn.plans import registry

Q, O = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(O))
def test_same_as_sql(spark, sf, con, name):
    assert differences(spark, sf, Q[name], O[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_runs(spark, sf, name):
    assert Q[name](spark, sf).count() >= 0
    assert set(O) <= set(Q)
