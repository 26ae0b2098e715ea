import pytest
from oracle import FOLDER, compare

import __spark_entry__ as entry

MODULES = [m for m in entry.MODULES if ".llm" not in m.__name__]
SQL = {k: (m.QUERIES[k], q) for m in MODULES for k, q in m.ORACLE.items()}
ROWS = {k: f for m in MODULES for k, f in m.QUERIES.items() if k not in m.ORACLE}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    compare(spark, *SQL[name])


@pytest.mark.parametrize("name", sorted(ROWS))
def test_runs_with_a_stable_schema(spark, name):
    df = ROWS[name](spark, FOLDER)
    assert df.count() >= 0 and df.schema == ROWS[name](spark, FOLDER).schema
