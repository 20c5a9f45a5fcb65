import pytest

from tests.oracle import SMALL, assert_same
from tidewire.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name])


def test_held_out_accuracy(spark):
    found = queries.op10_quality_classifier(spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality is not null")
    rows = found.join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert len(rows) > 5 and sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.8
