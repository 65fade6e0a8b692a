"""Tables in one file are worked on by all cores, with the row ids that they have."""

from lodestar.functions.table import ROW_ID, canonical, spread


def test_one_file_is_dealt_to_all_cores(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).withColumnRenamed("id", "v").coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.rdd.getNumPartitions() == 1
    whole = canonical(table)
    assert whole.rdd.getNumPartitions() == cores
    assert sorted((r["v"], int(r[ROW_ID])) for r in whole.collect()) == [(k, k) for k in range(1000)]
    assert {r[ROW_ID] for r in canonical(table, "v").collect()} == {str(k) for k in range(1000)}


def test_many_partitions_stay(spark):
    table = spark.range(100).repartition(spark.sparkContext.defaultParallelism + 3)
    assert spread(table) is table
