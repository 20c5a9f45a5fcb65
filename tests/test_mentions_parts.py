from tests.oracle import SMALL
from tidewire.operators import graph
from tidewire.plans.catalog import Catalog


def test_mentions_are_dealt_before_they_are_made_distinct(spark):
    cat = Catalog(spark, SMALL)
    plan = graph.place_counts(cat, "2001-08-02", 365)._jdf.queryExecution()
    assert "REPARTITION_BY_NUM" in plan.executedPlan().toString()  # Spark doesn't join such parts
    # other kinds of mentions are dropped below the distinct
    above = plan.optimizedPlan().toString().split("Union")[0]
    assert "LeftSemi" not in above and "LeftSemi" in plan.optimizedPlan().toString()


def test_routes_make_the_mentions_once(spark):
    plan = graph.routes(Catalog(spark, SMALL), "2001-08-02", 365)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "mentioned-places" in plan
