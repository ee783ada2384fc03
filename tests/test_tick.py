"""The tick's commits: one moment over all tables, carried state, and models fitted by retrain decisions."""

import os

import duckdb
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from conftest import SF0001
from shelfspark import fixtures as fx
from shelfspark.operators import models, views
from shelfspark.plans import backtest as bt
from shelfspark.sources import readers
from shelfspark.sources.snapshots import Snapshots
from shelfspark.streaming import feed
from shelfspark.streaming.seen import SeenUrls, run_seen_urls

COLS = [f.name for f in feed.ACTUALS_STREAM_SCHEMA.fields]


@pytest.fixture(scope="module")
def panel_rows(spark):
    a = fx.actuals(spark, SF0001)
    dates = sorted(r.date for r in a.select("date").distinct().collect())[:5]
    return a.filter(F.col("date").isin(dates)).select(*COLS).coalesce(1).cache(), dates


def small_fit(train):
    """Three trees instead of a hundred."""
    return Pipeline(stages=[VectorAssembler(inputCols=models.FEATURES, outputCol="features", handleInvalid="skip"),
                            GBTRegressor(featuresCol="features", labelCol=models.TARGET, predictionCol="prediction", maxIter=3, maxDepth=3, seed=42)]).fit(train)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_event_types_outside_any_list(spark, tmpdir_path):
    """An unlisted event type stays in the panel; equal to SQL."""
    ev = fx.table(spark, SF0001, "events").withColumn("event_type", F.when(F.col("event_type") == "view", "refund").otherwise(F.col("event_type")))
    ev.coalesce(1).write.parquet(f"{tmpdir_path}/events.parquet")
    got = rows(fx.actuals(spark, tmpdir_path), "entity_id", "date", "event_type", "event_title", "event_description", "demand_index")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmpdir_path}/events.parquet/*.parquet')")
    want = con.execute(f"WITH {fx.ACTUALS_CTE} SELECT entity_id, date, event_type, event_title, event_description, demand_index FROM actuals").fetchall()
    assert got == sorted(want, key=repr) and any(r[2] == "refund" for r in got)


def test_a_writer_that_fails_leaves_the_former_day(spark, tmpdir_path, panel_rows, monkeypatch):
    a, dates = panel_rows
    tick, store = feed.Tick(tmpdir_path), Snapshots(spark, tmpdir_path)
    for i, d in enumerate(dates[:2]):
        tick(a.filter(F.col("date") == d), i)
    assert store.entry().last_date == dates[0]
    before = {n: rows(t, *t.columns) for n, t in readers.load_serving(spark, tmpdir_path).items()}
    real = Snapshots.write

    def failing(self, name, df, run, seq):
        if name == "alerts":
            raise OSError("lost")
        return real(self, name, df, run, seq)

    monkeypatch.setattr(Snapshots, "write", failing)
    with pytest.raises(OSError):
        tick(a.filter(F.col("date") == dates[2]), 2)
    after = readers.load_serving(spark, tmpdir_path)                 # master and daily of the new day lie there already
    assert {n: rows(t, *t.columns) for n, t in after.items()} == before
    assert {r.date for r in after["master"].select("date").distinct().collect()} == {dates[0]}
    monkeypatch.setattr(Snapshots, "write", real)
    tick(a.filter(F.col("date") == dates[2]), 2)                     # the batch runs again
    now = readers.load_serving(spark, tmpdir_path)
    for name, date in (("master", "date"), ("daily", "date"), ("alerts", "date"), ("forecast", "target_date")):
        assert {r[0] for r in now[name].select(date).distinct().collect()} <= set(dates[:3]), name
    assert {r.date for r in now["master"].select("date").distinct().collect()} == set(dates[:2])
    # a reader that has resolved the moment before still sees it
    assert {r.date for r in store.table("master", store.entry(2)).select("date").distinct().collect()} == {dates[0]}


def test_a_batch_reads_what_waits_not_the_feed(spark, tmpdir_path, panel_rows):
    a, dates = panel_rows
    tick, store = feed.Tick(tmpdir_path), Snapshots(spark, tmpdir_path)
    waiting = []
    for i, d in enumerate(dates):
        tick(a.filter(F.col("date") == d), i)
        at = store.entry()
        waiting.append({r.date for r in store.written_by("inbox", at).select("date").distinct().collect()})
        open_ = store.written_by("predictions_open", at)
        assert open_ is None or {r.target_date for r in open_.select("target_date").distinct().collect()} <= {d}
        tail = store.written_by("tail", at)
        assert tail is None or tail.count() <= 7
    assert waiting == [{d} for d in dates]                           # of a long feed, too, one date waits
    tick.flush(spark)
    assert store.written_by("inbox", store.entry()).count() == 0
    assert rows(store.table("fva"), *bt.panel.FVA_COLS) == rows(bt.backtest(a)["fva"], *bt.panel.FVA_COLS)


def test_old_moments_expire(spark, tmpdir_path, panel_rows):
    a, dates = panel_rows
    tick, store = feed.Tick(tmpdir_path, keep=2), Snapshots(spark, tmpdir_path)
    for i, d in enumerate(dates[:4]):
        tick(a.filter(F.col("date") == d), i)
    assert [os.path.isdir(f"{tmpdir_path}/_commits/{n:012d}") for n in (1, 2, 3, 4)] == [False, False, True, True]
    assert len([x for x in os.listdir(f"{tmpdir_path}/inbox/run=direct") if x.startswith("seq=")]) == 2
    assert store.entry(1) is None and {r.date for r in store.table("master").select("date").distinct().collect()} == set(dates[:3])


def test_retrain_fits_registers_and_scores(spark, tmpdir_path, panel_rows):
    """Models every two days: one date a batch and all dates in one batch agree; a replay does not fit twice."""
    a, dates = panel_rows
    fits = []

    def fit(train):
        fits.append(train.count())
        return small_fit(train)

    args = {"fit": fit, "every": 2, "retrain_threshold": 1e9}
    one, all_ = f"{tmpdir_path}/one", f"{tmpdir_path}/all"
    tick = feed.Tick(one, **args)
    for i, d in enumerate(dates):
        tick(a.filter(F.col("date") == d), i)
    tick.flush(spark)
    assert len(fits) == 2
    tick(a.filter(F.col("date") == dates[-1]), len(dates) - 1)      # replayed
    tick.flush(spark)
    assert len(fits) == 2
    whole = feed.Tick(all_, **args)
    whole(a, 0)
    whole.flush(spark)
    assert len(fits) == 4
    s, b = Snapshots(spark, one), Snapshots(spark, all_)
    for name, cols in (("fva", bt.panel.FVA_COLS), ("days", ["sim_day", "date", "retrained", "model_version"]),
                       ("predictions", ["target_date", "entity_id", "pred_demand", "pred_price", "model_version"]),
                       ("registry", ["model_version", "created_seq", "rows_seen", "training_mae", "retrain_reason", "date"])):
        assert rows(s.table(name), *cols) == rows(b.table(name), *cols), name
    # the registry has the error of a model fitted by hand on the same rows
    reg = s.table("registry").orderBy("created_seq").collect()
    assert [(r.model_version, r.date, r.retrain_reason) for r in reg] == [("v1.1", dates[1], "periodic"), ("v1.2", dates[3], "periodic")]
    train = models.training_set(bt.panel.to_master(a.filter(F.col("date") <= dates[1])))
    by_hand = small_fit(train)
    mae = models.training_mae(by_hand.transform(train)).first()
    assert (reg[0].rows_seen, reg[0].training_mae) == (mae.rows_seen, mae.training_mae) and mae.training_mae > 0
    # the day after the retrain is forecast by the model in force, the day before by momentum
    scored = models.score(a.filter(F.col("date") == dates[2]), by_hand).select("entity_id", "pred_demand")
    made = s.table("predictions").filter(F.date_sub("target_date", 1) == dates[2])
    assert rows(made, "entity_id", "pred_demand") == rows(scored, "entity_id", "pred_demand")
    first = s.table("predictions").filter(F.date_sub("target_date", 1) == dates[0])
    assert rows(first, "entity_id", "pred_demand") == rows(bt.panel.next_day_forecast(a.filter(F.col("date") == dates[0])), "entity_id", "pred_demand")
    # B15 shows the error
    status = views.model_status(s.table("registry")).first()
    assert (status.current_version, status.rolling_mae, status.all_versions) == ("v1.2", reg[1].training_mae, ["v1.1", "v1.2"])


def test_a_url_that_returns_is_never_new(spark, tmpdir_path):
    """A URL that comes back after ten days, in a later batch or a later session's stream, is not emitted."""
    inbox, ck = f"{tmpdir_path}/in", f"{tmpdir_path}/ck"
    put = lambda *urls: spark.createDataFrame(urls, "url string, ts string").selectExpr("url", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(inbox)
    stream = lambda: spark.readStream.schema("url string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(inbox)      # noqa: E731
    seen = SeenUrls(spark, f"{tmpdir_path}/seen", 4)
    put(("a", "2024-01-02"), ("a", "2024-01-01"), ("b", "2024-01-01"), (None, "2024-01-01"))
    put(("c", "2024-01-03"), ("b", "2024-01-03"))
    assert {(r.url, r.ts.day) for r in run_seen_urls(stream(), seen, ck).collect()} == {("a", 1), ("b", 1), ("c", 3)}
    seen.close()
    again = SeenUrls(spark, f"{tmpdir_path}/seen")
    assert again.buckets == 4
    put(("a", "2024-01-15"), ("d", "2024-01-15"))
    assert [r.url for r in run_seen_urls(stream(), again, ck).collect()] == ["d"]
    again.add(spark.createDataFrame([("e", None), ("a", None)], "url string, ts timestamp"), "x")
    again.add(spark.createDataFrame([("e", None), ("f", None)], "url string, ts timestamp"), "x")       # the same batch, run again
    assert sorted(r.url for r in again.read().collect()) == ["a", "b", "c", "d", "e"]
    plan = again.unseen(spark.createDataFrame([("z",)], "url string"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    with pytest.raises(ValueError, match="4 buckets"):
        SeenUrls(spark, f"{tmpdir_path}/seen", 8)
