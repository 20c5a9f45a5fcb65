from pyspark.sql import functions as F

from tidewire.functions import titles


def test_a_title_is_worked_out_once(spark):
    rows = spark.createDataFrame([("Airbus 787 KLM", "Boeing 737 SAS"), ("Airbus 787", "Airbus 787 wins"), (None, "Boeing")], "a string, b string")
    found = rows.select(titles.conflict(F.col("a"), F.col("b")).alias("c"))
    assert [r.c for r in found.collect()] == [True, False, False]
    # the normal form for the makers and for the models, of two titles
    assert found._jdf.queryExecution().analyzed().toString().count("lower(coalesce(") == 4
