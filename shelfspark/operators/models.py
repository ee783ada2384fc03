"""Model operators on Spark ML (J1-J6, D12): training set, boosted-tree fit, in-sample error,
registry rows, scoring with bias correction and a model-less fallback, save / load by version."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import RETRAIN_EVERY_N_DAYS, c_naive_demand, round_half_up
from .keys import keep_first
from .panel import forecast_columns

# The model's inputs, target and hyper-parameters.
FEATURES = ["price_index", "sentiment_index", "search_index", "ad_index"]
TARGET = "demand_index"
GBT_PARAMS = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "seed": 42}
MIN_TRAIN_ROWS = 5
FIT_ROWS = 50_000                  # training rows of a task: a fit is some 300 jobs, each a task per partition


def training_set(history: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """History union new rows, first row per (date, entity_id) kept, rows with a missing
    feature or target dropped."""
    cols = ["date", "entity_id", TARGET, *FEATURES]
    h = history.select(*cols).withColumn("_src", F.lit(0))
    if new is not None:
        h = h.unionByName(new.select(*cols).withColumn("_src", F.lit(1)))
    first = keep_first(h, ["date", "entity_id"], ["_src"]).drop("_src")
    return first.na.drop(subset=[TARGET, *FEATURES])


def fit_demand_model(train: DataFrame) -> PipelineModel | None:
    """Gradient-boosted trees (100 trees, depth 3, rate 0.1, seed 42) on the four features.
    Returns None when there are fewer than ``MIN_TRAIN_ROWS`` rows (the reference skips).

    The rows are made once and their partitions drawn together by their number, so that the fit's many jobs have as
    many tasks as there are rows for, whatever number of shuffle partitions the rows came in."""
    rows = train.select(TARGET, *FEATURES).persist()
    try:
        n = rows.count()
        if n < MIN_TRAIN_ROWS:
            return None
        pipe = Pipeline(stages=[
            VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="skip"),
            GBTRegressor(featuresCol="features", labelCol=TARGET, predictionCol="prediction", **GBT_PARAMS)])
        return pipe.fit(rows.coalesce(-(-n // FIT_ROWS)))
    finally:
        rows.unpersist()


def training_mae(scored: DataFrame, label: str = TARGET, pred: str = "prediction") -> DataFrame:
    """Mean absolute error of fitted values and rows seen."""
    return scored.agg(round_half_up(F.avg(F.abs(F.col(label) - F.col(pred))), 4).alias("training_mae"),
                      F.count(F.lit(1)).alias("rows_seen"))


def registry_row(spark, version: str, created_seq: int, rows_seen: int, mae: float, reason: str) -> DataFrame:
    """One registry row (a tiny append table; never grows with the data)."""
    return spark.createDataFrame(
        [(version, created_seq, rows_seen, float(mae), reason)],
        "model_version string, created_seq bigint, rows_seen bigint, training_mae double, retrain_reason string")


def residual_bias(fva: DataFrame, days: int = 7) -> DataFrame:
    """Per entity, mean demand error over the last ``days`` days of comparisons
    (the documented "level 1" bias correction). Partial aggregate, no window."""
    maxd = fva.agg(F.max("date")).scalar()
    # errors are cut to 6 decimals and summed as exact integers, so every engine and partitioning
    # gets the same mean (a plain double average can land on either side of a rounding tie)
    e6 = F.round(round_half_up("demand_error", 6) * 1e6).cast("bigint")
    mean = F.sum(e6) / (F.count(e6) * 1e6)
    return (fva.filter(F.col("date") > F.date_sub(maxd, days))
            .groupBy("entity_id").agg(round_half_up(mean, 4).alias("bias")))


def score(df: DataFrame, model: PipelineModel | None, bias: DataFrame | None = None) -> DataFrame:
    """Demand prediction per row plus the entity's bias; without a model the naive formula
    (G27) is used. ``bias`` is a per-entity table joined on entity_id (missing = 0)."""
    src = df
    if bias is not None:
        src = src.join(bias, "entity_id", "left")
    b = F.coalesce(F.col("bias"), F.lit(0.0)) if bias is not None else F.lit(0.0)
    naive = src.withColumn("pred_demand", c_naive_demand(bias=b))
    if model is None:
        return naive
    # a row that lacks a feature cannot be scored by the model: it takes the naive formula
    whole = F.lit(True)
    for f in FEATURES:
        whole = whole & F.col(f).isNotNull()
    out = (model.transform(src.filter(whole).withColumn("_b", b))
           .withColumn("pred_demand", round_half_up(F.col("prediction") + F.col("_b"), 4)))
    return out.drop("features", "prediction", "_b").unionByName(naive.filter(~whole))


def model_forecast(actuals: DataFrame, model: PipelineModel | None, version: str, bias: DataFrame | None = None,
                   noise: float = 0.0) -> DataFrame:
    """G18 with ``source="model"``: the next day's demand by the fitted model (naive without one) plus the entity's bias;
    date and price as in the momentum forecast."""
    target, _, price = forecast_columns(noise)
    return score(actuals, model, bias).select(target.alias("target_date"), "entity_id", "pred_demand", price.alias("pred_price"),
                                              F.lit(version).alias("model_version"))


def save_model(model: PipelineModel, base_dir: str, version: str) -> str:
    """Spark ML writer (not pickle), one folder per version."""
    path = f"{base_dir.rstrip('/')}/demand_model_{version}"
    model.write().overwrite().save(path)
    return path


def load_model(base_dir: str, version: str) -> PipelineModel:
    return PipelineModel.load(f"{base_dir.rstrip('/')}/demand_model_{version}")


def retrain_history(days: DataFrame, every: int = RETRAIN_EVERY_N_DAYS) -> DataFrame:
    """Retrain job rows (one per retrain day) from the backtest day table; ``every``: the interval of its decisions."""
    w = Window.orderBy("date")
    return days.filter("retrained").select(
        "sim_day", "date", "model_version", "drift_score",
        F.when((F.col("sim_day") > 0) & ((F.col("sim_day") % every) == 0), "periodic").otherwise("drift").alias("retrain_reason"),
        F.row_number().over(w).cast("bigint").alias("created_seq"))
