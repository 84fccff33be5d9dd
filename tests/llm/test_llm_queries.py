import pytest
from conftest import SMALL, duck, normal
from verbena.llm import queries

QUERIES = {k: f for m in queries.MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in queries.MODULES for k, s in m.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert len(got.columns)
    if name.endswith("_found"):
        assert not got.duplicated().any() and len(got)
    if name in ORACLE:
        assert normal(got) == normal(duck(SMALL).execute(ORACLE[name]).df())
