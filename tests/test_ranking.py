"""Ranges over hot groups give the same ranks as a plain window."""
from pyspark.sql import Window, functions as F

from sitelode.operators import ranking as R
from sitelode.session import WRITTEN


def rows(spark):
    return spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("site_id"),
        (F.col("id") * 7919 % 3001).alias("crawl_seq"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))


def test_rank_rows_equals_window(spark):
    df = rows(spark)
    got = R.rank_rows(df, ["site_id"], ["crawl_seq", "url"], range_rows=200)
    want = df.withColumn("idx", F.row_number().over(Window.partitionBy("site_id").orderBy("crawl_seq", "url")))
    assert got.count() == 3000
    assert got.exceptAll(want).isEmpty()


def test_ranges_grow_with_the_input(spark):
    """A group of twice the rows is ranked by twice the ranges, none of them much larger."""
    df = spark.range(20_000).select(F.lit("hot").alias("site_id"), F.col("id").alias("crawl_seq"))
    got = R.rank_rows(df, ["site_id"], ["crawl_seq"], range_rows=500)
    assert got.agg(F.max("idx"), F.sum(F.when(F.col("idx") == F.col("crawl_seq") + 1, 1))).first()[:] == (20_000, 20_000)
    ranged = [f for f in got.inputFiles()]
    assert len({f.rsplit("/", 1)[0] for f in ranged}) == 1 and len(set(ranged)) >= 40


def test_tiles_equal_ntile(spark):
    df = rows(spark)
    got = R.tiles(df, ["site_id"], ["crawl_seq", "url"], 3, "t", range_rows=200)
    want = df.withColumn("t", F.ntile(3).over(Window.partitionBy("site_id").orderBy("crawl_seq", "url")))
    assert got.exceptAll(want).isEmpty()


def test_top_n_is_cut_before_the_shuffle(spark):
    df = R.first_pages(rows(spark), 10)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert df.groupBy("site_id").count().agg(F.max("count")).first()[0] == 10


def test_top_n_beyond_group_limit(spark):
    df = rows(spark)
    got = R.top_n(df, ["site_id"], ["crawl_seq", "url"], 1500)
    assert got.filter("site_id = 'hot'").count() == 1500


def test_long_rows_are_ranked_in_small_ranges_and_written_once(spark, monkeypatch):
    """Texts count for the number of ranges; one table is written, in which groups lie together. Null groups and equal keys have positions too."""
    monkeypatch.setattr(R, "RANGE_CHARS", 20_000, raising=False)
    df = spark.range(2000).select(
        F.when(F.col("id") % 5 < 4, (F.col("id") % 5 % 2).cast("string")).alias("site_id"), F.expr("nullif(id % 300, 0)").alias("k"),
        F.when(F.col("id") % 9 > 0, F.repeat(F.lit("x"), F.lit(100))).alias("text"))
    before = len(WRITTEN)
    got = R.rank_rows(df, ["site_id"], ["k"])
    assert len(WRITTEN) == before + 1 and len(set(got.inputFiles())) >= 8
    by_group = Window.partitionBy("site_id")
    wrong = got.withColumn("n", F.count(F.lit(1)).over(by_group)).withColumn("r", F.rank().over(by_group.orderBy("k"))).withColumn(
        "after", F.lead("idx").over(by_group.orderBy("idx"))).withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy("site_id", "k")))
    assert wrong.filter("idx < r or idx >= r + ties or idx > n or after <> idx + 1").isEmpty()
    assert got.drop("idx").exceptAll(df).isEmpty() and got.count() == 2000 == got.select("site_id", "idx").distinct().count()
