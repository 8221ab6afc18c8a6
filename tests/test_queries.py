import assaylake.plans.experiment
import assaylake.plans.marts
import assaylake.plans.reports
import assaylake.plans.topology  # noqa: F401  they register their queries
import pytest
from assaylake.plans.queries import QUERIES, SQL

from comparing import canonical


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in SQL:
        assert canonical(got) == canonical(duck(SQL[name]))
    else:
        assert len(got) > 0


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_skeleton_counts_has_every_segment(spark):
    from assaylake.plans import queries

    customers = spark.createDataFrame([(i % 5, f"s{i}", -1.0) for i in range(150)] + [(0, None, -1.0)], "c_nationkey int, c_mktsegment string, c_acctbal double")
    tables = {"customer": customers, "nation": spark.range(5).selectExpr("cast(id as int) n_nationkey")}
    got = {(r.n_nationkey, r.seg): r.n for r in queries.skeleton_counts(tables.__getitem__).collect()}
    assert got == {(n, s): int(s == f"s{i}" and i % 5 == n) for n in range(5) for i in range(150) for s in [f"s{i}"]} | {(n, None): 0 for n in range(5)}
