"""Small tables are dealt over all cores without running anything."""

from pyspark.sql import functions as F

from sievemill.sources.tables import read_table, spread


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_nothing_runs(spark, sf_dir):
    one = read_table(spark, sf_dir, "documents")
    grouped = one.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    before = jobs(spark)
    for rows in (one, grouped, one.join(grouped, "source"), spark.range(5).toDF("id")):
        spread(rows)
    assert jobs(spark) == before
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_many_files_stay(spark, tmp_path):
    spark.range(2_000).repartition(12).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    assert "Exchange" not in spread(rows)._jdf.queryExecution().executedPlan().toString()
