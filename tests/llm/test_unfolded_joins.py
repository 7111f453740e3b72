"""Joins of unfolded rows, whose number a plan does not see, are never broadcasts; the sample stays the one of smallest hashes."""

from pyspark.sql import functions as F

from ledgerloom.llm import embedding_dedup, pairing


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unfolded_rows_are_not_broadcast(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("node"), F.encode(F.col("id").cast("string"), "UTF-8").alias("payload"), F.array(F.col("id") % 300, F.col("id") % 700 + 1000).alias("keys")).write.parquet(str(tmp_path / "coded"))
    coded = spark.read.parquet(str(tmp_path / "coded"))
    met = pairing.met_members(coded.select("node", F.explode("keys").alias("bucket")), coded.select("node", "payload"))
    spread = pairing.spread_join(coded.select("node", "payload"), coded.select("node", F.lit(1).alias("one")), "node", F.col("payload"))
    assert "Broadcast" not in plan(met) and "Broadcast" not in plan(spread)
    assert met.count() == 1000 + 600 and spread.where("one = 1").count() == 1000  # the first 300 of 700 values come twice


def test_the_sample_is_that_of_the_smallest_nodes(spark):
    classes = spark.range(20_000).select(F.xxhash64("id").alias("node")).cache()
    least = classes.orderBy("node").limit(500).collect()
    assert embedding_dedup._least(classes, 20_000, 500).collect() == least
    assert embedding_dedup._least(classes, 10**9, 500).collect() == least  # fewer than told: no range holds enough
    assert embedding_dedup._least(classes, 20_000, 30_000).count() == 20_000
