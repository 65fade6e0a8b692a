"""Scans and statistics of databases, on the database that comes with Spark; the cache and its budget."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from lodestar.sources import catalog
from lodestar.sources.cache import FrameCache
from lodestar.sources.database import STATISTICS, Database, cuts, predicates, split_scan, table_infos
from lodestar.sources.spec import PORTS, SourceSpec

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def derby(spark):
    """A database with a table of crowded keys, some of them null, and an empty one."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    r = random.Random(3)
    keys = [None] * 7 + [r.randrange(50) for _ in range(900)] + [10**6 + r.randrange(10**6) for _ in range(300)] + [-(10**5)]
    rows = spark.createDataFrame([(k, f"row {i}") for i, k in enumerate(keys)], "K long, NAME string")
    write = lambda df, name: df.write.format("jdbc").option("url", url).option("driver", DRIVER).option("dbtable", name).save()
    write(rows, "crowded")
    write(rows.limit(0), "bare")
    write(spark.range(5).select(F.col("id").alias("cliente_id"), F.lit("a@b.c").alias("email")), "clientes")
    return Database("jdbc", {"url": url, "driver": DRIVER}, dialect="derby"), rows


def sizes(df):
    return [n for n in df.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()]


def test_scan_is_cut_along_the_data(spark, derby):
    database, rows = derby
    df = split_scan(spark, database, "crowded", "k", parts=6)
    got = sizes(df)
    assert len(got) == 6 and sum(got) == rows.count()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    evenly = split_scan(spark, database, "SELECT k, name FROM crowded WHERE k >= 1000000", "k", parts=4)
    assert max(sizes(evenly)) < 2 * 300 / 4 and sum(sizes(evenly)) == 300


def test_small_and_empty_tables_take_one_task(spark, derby):
    database, rows = derby
    assert split_scan(spark, database, "crowded", "k").rdd.getNumPartitions() == 1
    assert split_scan(spark, database, "bare", "k", parts=4).collect() == []
    assert split_scan(spark, database, "SELECT k FROM crowded WHERE k = -100000", "k", parts=4).count() == 1
    spec = SourceSpec("jdbc", query="crowded", connection=database.connection, options={"splitBy": "k", "parts": "3"})
    assert spec.to_df(spark).rdd.getNumPartitions() == 3 and spec.to_df(spark).count() == rows.count()


@pytest.mark.parametrize("seed", range(30))
def test_cuts(seed):
    r = random.Random(seed)
    cells = sorted(r.sample(range(400), r.randrange(1, 60)))
    histogram = [(c, r.choice([1, 5, 400])) for c in cells]
    parts = r.randrange(1, 12)
    starts = cuts(histogram, parts)
    assert starts == sorted(set(starts)) and len(starts) < parts and set(starts) <= set(cells[1:])
    total = [sum(n for c, n in histogram if a <= c < b) for a, b in zip([-1, *starts], [*starts, 10**9], strict=True)]
    assert all(total) and sum(total) == sum(n for _, n in histogram)
    assert max(total) <= 2 * max(sum(total) / parts, max(n for _, n in histogram)) + 1


def test_predicates_are_a_partition():
    where = predicates("k", [(None, 5), (5, 9), (9, None)])
    assert where == ["(k < 5 OR k IS NULL)", "(k >= 5 AND k < 9)", "k >= 9"] and predicates("k", [(None, None)]) == ["1 = 1"]


def test_tables_of_a_database_feed_suggestions(spark, derby):
    database, rows = derby
    infos = table_infos(spark, database)
    got = {r["table"].lower(): r for r in infos.collect()}
    assert {n: r["row_count"] for n, r in got.items()} == {"crowded": rows.count(), "bare": 0, "clientes": 5}
    assert all(r["exact"] for r in got.values()) and [c.lower() for c in got["clientes"]["col_names"]] == ["cliente_id", "email"]
    best = catalog.suggest(infos).first()
    assert best["table"].lower() == "clientes" and "personas" in best["tags"] and "email" in best["tags"]
    assert set(PORTS) <= set(STATISTICS)


def test_catalog_estimates(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("a_view_of_the_session")
    spark.sql("CREATE DATABASE IF NOT EXISTS sized")
    spark.range(3000).select("id", F.lit("x").alias("name")).write.mode("overwrite").saveAsTable("sized.big")
    spark.range(10).write.mode("overwrite").saveAsTable("sized.small")
    guess = {r["table"]: r for r in catalog.table_infos(spark, "sized").collect()}
    assert guess["big"]["row_count"] > guess["small"]["row_count"] and not guess["big"]["exact"] and guess["big"]["bytes"] > 0
    spark.sql("ANALYZE TABLE sized.big COMPUTE STATISTICS")
    spark.conf.set("spark.sql.cbo.enabled", "true")
    try:
        assert {r["table"]: r["row_count"] for r in catalog.table_infos(spark, "sized").collect()}["big"] == 3000
    finally:
        spark.conf.unset("spark.sql.cbo.enabled")
    assert {r["table"]: r["row_count"] for r in catalog.table_infos(spark, "sized", exact=True).collect()} == {"big": 3000, "small": 10}
    spark.sql("DROP DATABASE sized CASCADE")


@pytest.fixture
def files(spark, tmp_path):
    out = []
    for k in range(4):
        spark.range(20_000).select("id", F.hash("id", F.lit(k)).alias("x")).write.parquet(str(tmp_path / f"{k}"))
        out.append(SourceSpec("parquet", str(tmp_path / f"{k}")))
    return out


def test_cache_keeps_to_its_bytes(spark, files):
    cache = FrameCache()
    cache.get(spark, files[0])
    one = cache.stats()
    assert one["entries"] == 1 and one["memory_bytes"] > 50_000 and one["disk_bytes"] == 0
    cache.max_bytes = int(2.5 * one["memory_bytes"])
    cache.get(spark, files[1])
    cache.get(spark, files[0])  # used last
    cache.get(spark, files[2])
    assert set(cache.entries) == {files[0].key(), files[2].key()} and cache.stats()["evictions"] == 1
    assert cache.stats()["memory_bytes"] <= cache.max_bytes
    rows = cache.listing(spark).collect()
    assert [r["key"] for r in rows] == [files[2].key(), files[0].key()] and rows[1]["hits"] == 1 and rows[0]["columns"] == 2
    assert cache.query(spark, files[3], "SELECT count(*) AS n FROM data").first()["n"] == 20_000
    for k in list(cache.entries):
        cache.drop(k)
    assert cache.stats()["memory_bytes"] == 0


def test_cache_hands_out_what_is_too_large(spark, files):
    cache = FrameCache(max_bytes=1000)
    df = cache.get(spark, files[0])
    assert df.count() == 20_000 and cache.stats()["entries"] == 0 and cache.stats()["evictions"] == 1
    assert not df.is_cached
    cache = FrameCache(ttl=-1.0)
    cache.get(spark, files[0])
    cache.get(spark, files[0])
    assert (cache.hits, cache.misses) == (0, 2)
    cache.drop(files[0].key())
