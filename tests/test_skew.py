import pytest
from pyspark.sql import functions as F

from gridledger.functions.skew import hot_keys, lookup_join, split_join


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 != 1, (F.col("id") % 500).cast("string")).alias("key"),
        F.col("id").alias("n"),
    )
    right = spark.range(0, 400).select(F.col("id").cast("string").alias("key"), F.col("id").alias("v")).union(
        spark.createDataFrame([("hot", -1), ("hot", -2)], "key string, v long")
    )
    return left, right


def test_null_keys_are_spread_and_kept(spark):
    left = spark.range(5000).select(F.lit(None).cast("string").alias("key"), F.col("id").alias("n"))
    right = spark.createDataFrame([("a", 1)], "key string, v int")
    assert split_join(left, right, ["key"], ["n"], "left").count() == 5000
    assert split_join(left, right, ["key"], ["n"], "left_anti").count() == 5000
    assert split_join(left, right, ["key"], ["n"]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_the_plain_join(sides, how):
    left, right = sides
    plain = left.join(right, "key", how)
    split = split_join(left, right, ["key"], ["n"], how, rows_per_split=100).select(plain.columns)
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0


def test_full_joins_are_refused(sides):
    with pytest.raises(ValueError):
        split_join(*sides, ["key"], ["n"], "full_outer")


def test_hot_keys_are_few_and_splits_bounded(sides):
    left, _ = sides
    rows = hot_keys(left, ["key"], "splits", 100).collect()
    assert [(r.key, r.splits) for r in rows] == [("hot", 30)]
    spread = left.filter("key = 'hot'").groupBy(F.pmod(F.xxhash64("n"), F.lit(30))).count().agg(F.max("count")).first()[0]
    assert spread < 200


@pytest.mark.parametrize("max_rows", [10, 100000])
def test_lookup_join_is_the_same_on_both_ways(sides, max_rows):
    left, right = sides
    table = right.filter("v <> -2")
    got = lookup_join(left, table, ["key"], ["n"], max_rows=max_rows)
    plain = left.join(table, "key", "left").select(got.columns)
    assert got.exceptAll(plain).count() == 0 and got.count() == left.count()


def test_only_a_small_lookup_table_is_broadcast(spark, sides):
    left, right = sides
    table = right.filter("v <> -2")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def plan(max_rows):
            return lookup_join(left, table, ["key"], ["n"], max_rows=max_rows)._jdf.queryExecution().optimizedPlan().toString()

        assert "strategy=broadcast" in plan(1000)
        assert plan(1000).count("Join") == 1 and plan(10).count("Join") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_large_table_beside_a_stream_is_shuffled(spark, sides, tmp_path, capsys):
    """The table is small by Spark's estimate, but it was counted as too large and repeated per split."""
    left, right = sides
    left.write.parquet(str(tmp_path / "in"))
    right.filter("v <> -2").write.parquet(str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    stream = lookup_join(spark.readStream.schema(left.schema).parquet(str(tmp_path / "in")), table, ["key"], ["n"], max_rows=10)
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out")))
    query.awaitTermination()
    query.explain()
    assert "SortMergeJoin" in (plan := capsys.readouterr().out) and "BroadcastHashJoin" not in plan
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    plain = left.join(table, "key", "left").select(got.columns)
    assert got.count() == 9000 and got.exceptAll(plain).count() == 0
