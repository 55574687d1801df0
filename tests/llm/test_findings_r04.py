"""What the findings of round 4 named, in small."""

from pyspark.sql import functions as F

from daygrid.llm import simhash


def test_exploded_cells_are_never_broadcast(spark):
    """Spark takes the cells to be as small as the fingerprints they come from, after the aggregate ran too."""
    fps = spark.range(2000).select(F.xxhash64("id").alias("fp")).repartition(3).groupBy("fp").agg(F.count("*").alias("n")).select("fp")
    out = simhash.links(fps)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
