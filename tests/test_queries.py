"""Every registered query of the core against its SQL, at the smallest scale; those without SQL must run."""

import pytest

from compare import DATA, compare, connect
from lodestone.plans import catalog

FOLDER = f"{DATA}/sf0.001"
#: may be empty at this scale
MAY_BE_EMPTY = {"w16_pending", "t10_math", "r1_postfilter", "r1_prefilter", "r2_bm25_filtered", "f1_source_like"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    n = compare(spark, con, name, catalog.queries()[name], catalog.oracle_sql()[name], FOLDER)
    assert n > 0 or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0 or name in MAY_BE_EMPTY


def test_flagship(spark):
    rows = catalog.flagship(spark, FOLDER).orderBy("rank").collect()
    assert rows and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_entry_without_the_optional_subpackage():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
