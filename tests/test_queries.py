"""Every query of the core with SQL gives the rows of its SQL; those without run."""

import os

import pytest

from postlane import oracle, queries_core, queries_mail, queries_more

FOLDER = "/root/testdata/sf0.001"
MODULES = (queries_core, queries_mail, queries_more)
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(FOLDER)


@pytest.mark.parametrize("name", [n for m in MODULES for n in sorted(m.SQL)])
def test_rows_of_the_sql(spark, con, name):
    m = next(m for m in MODULES if name in m.SQL)
    assert oracle.compare(spark, con, FOLDER, m.QUERIES[name], m.SQL[name]) == ""


def test_entry_leaves_out_an_absent_subpackage():
    import __spark_entry__ as e

    assert set(queries_core.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
