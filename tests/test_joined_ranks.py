"""Forecasts and actuals joined as streams; ranks within groups of any size."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF0001
from shelfspark import fixtures as fx
from shelfspark.operators import panel, ranks
from shelfspark.streaming import feed, joined

COLS = [f.name for f in feed.ACTUALS_STREAM_SCHEMA.fields]


def test_stream_join_equals_the_batch_join_and_its_state_stays_flat(spark, tmpdir_path):
    a = fx.actuals(spark, SF0001).cache()
    joined.write_ordered_feed(a, f"{tmpdir_path}/feed", COLS, days_at_once=6, files=1, close_after=5)
    sides = [feed.daily_feed(spark, f"{tmpdir_path}/feed") for _ in range(2)]
    out = joined.join_forecasts(sides[0], joined.forecast_stream(sides[1]), "3 days")
    q = (out.writeStream.format("parquet").option("path", f"{tmpdir_path}/out").option("checkpointLocation", f"{tmpdir_path}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{tmpdir_path}/out")
    want = panel.forecast_vs_actual(a, panel.next_day_forecast(a)).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.filter(F.col("pred_demand").isNull()).count() > 0                  # actuals without a forecast come too
    kept = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    busiest = max(r.n for r in a.groupBy("date").agg(F.count(F.lit(1)).alias("n")).collect())
    assert len(kept) > 6 and max(kept) <= 2 * busiest * 10 and kept[-1] <= 4, kept   # two sides, some 10 days; at the end the closing rows


def test_dense_rank_equals_the_window(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 8 + ["a", None]), rnd.choice([1, 2, None]), rnd.choice([None, 0.0, -0.0, float("nan"), *[rnd.randrange(400) / 4 for _ in range(9)]]), i)
            for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, d int, v double, id int").repartition(5)
    got = ranks.dense_rank_desc(df, ["g", "d"], "v", "r")
    want = df.withColumn("r", F.dense_rank().over(Window.partitionBy("g", "d").orderBy(F.col("v").desc())).cast("bigint"))
    assert sorted((x.id, x.r) for x in got.collect()) == sorted((x.id, x.r) for x in want.collect())
    assert ranks.dense_rank_desc(df.limit(0), ["g", "d"], "v", "r").count() == 0


def test_no_window_holds_a_whole_group(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id").cast("double").alias("v"))
    got = ranks.dense_rank_desc(df, ["g"], "v", "r")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank" not in plan and "row_number() windowspecdefinition(_rank_range" in plan
    assert got.filter(F.col("r") != 20_000 - F.col("v")).count() == 0
    assert panel.panel_features(panel.to_master(fx.actuals(spark, SF0001))).filter("rank_in_category < 1").count() == 0
