"""Feature preparation, splits, MLlib fits, evaluation and forecasts.

Fits run in MLlib over distributed rows. The only driver loop is over the fixed handful of boroughs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import safe_ratio

# Model settings and thresholds of the trip forecast.
BOOSTING = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.05, "seed": 42}
MIN_GROUP_ROWS = 100
FIT_ROWS = 5000
JOB_MAPE_LIMIT = 0.15
FORECAST_MAPE_LIMIT = 0.20


# ---- features ---------------------------------------------------------------------------------

def churn_features(accounts: DataFrame, as_of: str) -> DataFrame:
    """Per-day rates and ratios of an account table with its totals already joined."""
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("created_date"))
    with_age = accounts.withColumn("account_age_days", age)
    days = F.col("account_age_days")
    return with_age.withColumns(
        {
            "avg_daily_sessions": safe_ratio(F.col("total_sessions"), days),
            "avg_daily_duration": safe_ratio(F.col("total_duration"), days),
            "support_tickets_per_day": safe_ratio(F.col("support_ticket_count"), days),
            "failed_payment_rate": safe_ratio(F.col("failed_payments"), F.col("total_payments")),
        }
    )


def indexed_and_assembled(categories: Sequence[str], numbers: Sequence[str]) -> Pipeline:
    """Category indexes by falling frequency, then one feature vector; unseen values are kept."""
    index = StringIndexer(inputCols=list(categories), outputCols=[f"{c}_idx" for c in categories], handleInvalid="keep")
    assemble = VectorAssembler(inputCols=[*numbers, *[f"{c}_idx" for c in categories]], outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[index, assemble])


def correlation_ranking(df: DataFrame, features: Sequence[str], target: str, k: int = 10) -> DataFrame:
    """The k features with the highest absolute Pearson correlation, all computed in one pass."""
    wide = df.agg(*[F.corr(c, target).alias(c) for c in features])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in features])).alias("e"))
    return long.select("e.feature", F.abs("e.corr").alias("abs_corr")).orderBy(F.desc_nulls_last("abs_corr"), "feature").limit(k)


def standard_scaled(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """(x - mean) / population deviation, both from the training rows; a constant column becomes 0."""
    stats = df.filter(train).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    scaled = {
        c: safe_ratio(F.col(c) - stats.select(f"_m_{c}").scalar(), stats.select(f"_s_{c}").scalar()) for c in columns
    }
    return df.withColumns(scaled)


# ---- splits -----------------------------------------------------------------------------------

def time_split(df: DataFrame, group: str, order: str, share: float = 0.8) -> DataFrame:
    """Adds ``is_train``: the first int(n * share) rows of a group along ``order``."""
    along, whole = Window.partitionBy(group).orderBy(order), Window.partitionBy(group)
    cut = F.floor(F.count(F.lit(1)).over(whole) * F.lit(share))
    return df.withColumn("is_train", F.row_number().over(along) <= cut)


def expanding_folds(df: DataFrame, group: str, order: str, folds: int = 5) -> DataFrame:
    """One row per (row, fold, part): fold i trains on everything before its test block.

    Blocks hold n // (folds + 1) rows and end at the last row, so the first block only trains.
    """
    along, whole = Window.partitionBy(group).orderBy(order), Window.partitionBy(group)
    placed = df.withColumn("_at", F.row_number().over(along) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
    placed = placed.withColumn("_block", F.floor(F.col("_n") / (folds + 1)))
    start = F.col("_n") - (folds + 1 - F.col("fold")) * F.col("_block")
    part = F.when(F.col("_at") < start, "train").when(F.col("_at") < start + F.col("_block"), "test")
    return (
        placed.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
        .withColumn("part", part)
        .filter(F.col("part").isNotNull())
        .drop("_at", "_n", "_block")
    )


# ---- fits -------------------------------------------------------------------------------------

def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def regressors(n_train: int, trees: int = 100, depth: int = 5, seed: int = 42) -> dict[str, object]:
    """The compared models. Ridge with penalty 1 on the sum of squares is regParam = 1/n on the mean."""
    return {
        "GradientBoosting": GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed),
        "RandomForest": RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed),
        "Ridge": LinearRegression(regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False),
    }


def fit_and_predict(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, model) -> tuple[object, DataFrame]:
    model = model.copy({model.labelCol: target, model.featuresCol: "features"})
    ready = _assembled(train, features).persist()
    try:
        fitted = model.fit(ready)
    finally:
        ready.unpersist()
    return fitted, fitted.transform(_assembled(test, features))


def boosted_per_group(
    df: DataFrame, group: str, groups: Sequence[str], features: Sequence[str], targets: Mapping[str, str],
    settings: Mapping[str, object] | None = None, min_rows: int = MIN_GROUP_ROWS,
) -> tuple[dict[tuple[str, str], object], DataFrame]:
    """Boosted trees per (group, target); returns the models and the test predictions.

    ``groups`` is a fixed short list. Groups below ``min_rows`` and the group 'Unknown' are skipped.
    ``df`` carries ``is_train``.
    """
    settings = dict(settings or BOOSTING)
    sizes = {r[group]: r["n"] for r in df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col(group).isin(list(groups))).collect()}
    models, predicted = {}, []
    for name in groups:
        if name == "Unknown" or sizes.get(name, 0) < min_rows:
            continue
        rows = df.filter(F.col(group) == name).na.drop(subset=list(targets.values())).na.fill(0, list(features))
        for label, target in targets.items():
            model, test = fit_and_predict(
                rows.filter("is_train"), rows.filter("NOT is_train"), features, target, GBTRegressor(**settings)
            )
            models[(name, label)] = model
            predicted.append(test.select(F.col(group), F.lit(label).alias("target"), F.col(target).cast("double").alias("actual"), "prediction"))
    if not predicted:
        raise ValueError("no group has enough rows")
    out = predicted[0]
    for frame in predicted[1:]:
        out = out.unionAll(frame)
    return models, out


def compare_models(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, models: Mapping[str, object]) -> DataFrame:
    """Test metrics per model, best RMSE first (one fit per model)."""
    parts = None
    for name, model in models.items():
        _, predicted = fit_and_predict(train, test, features, target, model)
        part = predicted.select(F.lit(name).alias("model"), F.col(target).cast("double").alias("actual"), "prediction")
        parts = part if parts is None else parts.unionAll(part)
    return regression_metrics(parts, ["model"]).orderBy("rmse")


def cross_validated_rmse(folded: DataFrame, features: Sequence[str], target: str, model, folds: int = 5) -> DataFrame:
    """RMSE per expanding fold."""
    parts = None
    for fold in range(1, folds + 1):
        rows = folded.filter(F.col("fold") == fold)
        _, predicted = fit_and_predict(rows.filter("part = 'train'"), rows.filter("part = 'test'"), features, target, model)
        part = predicted.select(F.lit(fold).alias("fold"), F.col(target).cast("double").alias("actual"), "prediction")
        parts = part if parts is None else parts.unionAll(part)
    return regression_metrics(parts, ["fold"])


def spread_rows(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in as many partitions as there are cores, ``FIT_ROWS`` rows or more in each; fewer rows stay as they are.

    Tree models read their rows once per level, so rows that came from one file or one row group would be read by one core. Not more than
    cores: every partition sends statistics of all nodes of a level.
    """
    parts = min(-(-rows.count() // FIT_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(parts, key) if parts > 1 else rows


def tuned(estimator, grid: Sequence, evaluator, folds: int, parallelism: int = 4) -> CrossValidator:
    return CrossValidator(estimator=estimator, estimatorParamMaps=list(grid), evaluator=evaluator, numFolds=folds, parallelism=parallelism, seed=42)


def tuned_classifier(
    kind: str = "rf", label: str = "label", sizes=(20, 50, 100), depths=(5, 10, 15), leaves=(1, 5, 10), trees: int = 100, folds: int = 5
) -> CrossValidator:
    """Random forest over depth x least rows of a leaf, or boosted trees over rounds x depth, chosen by the area under the PR curve.

    The forest keeps the node that each row has reached in each tree; else a level of a fit walks every row down every tree from the root. The trees are the same.
    """
    if kind == "rf":
        model = RandomForestClassifier(labelCol=label, numTrees=trees, seed=42, cacheNodeIds=True)
        grid = ParamGridBuilder().addGrid(model.maxDepth, list(depths)).addGrid(model.minInstancesPerNode, list(leaves)).build()
    else:
        model = GBTClassifier(labelCol=label, seed=42)
        grid = ParamGridBuilder().addGrid(model.maxIter, list(sizes)).addGrid(model.maxDepth, list(depths)).build()
    return tuned(model, grid, BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderPR"), folds)


def tuned_forest_regressor(label: str, sizes=(50, 100, 200), depths=(5, 10, 15), folds: int = 3) -> CrossValidator:
    model = RandomForestRegressor(labelCol=label, seed=42)
    grid = ParamGridBuilder().addGrid(model.numTrees, list(sizes)).addGrid(model.maxDepth, list(depths)).build()
    return tuned(model, grid, RegressionEvaluator(labelCol=label, metricName="rmse"), folds)


def tuning_table(spark: SparkSession, fitted) -> DataFrame:
    """The grid with its average metric; as many rows as grid points."""
    rows = [
        ({p.name: str(v) for p, v in point.items()}, float(metric))
        for point, metric in zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics)
    ]
    return spark.createDataFrame(rows, "params map<string,string>, metric double")


def per_group_line(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Least-squares line per group as plain aggregates: any group size, no group in one task."""
    return df.groupBy(group).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


# ---- evaluation -------------------------------------------------------------------------------

def regression_metrics(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MAPE, RMSE and R2 = 1 - SSE/SST per group over ``actual`` and ``prediction``."""
    error = F.col("actual") - F.col("prediction")
    sst = F.var_pop("actual") * F.count("actual")
    return predictions.groupBy(*keys).agg(
        F.avg(F.abs(error) / F.greatest(F.abs(F.col("actual")), F.lit(2.220446049250313e-16))).alias("mape"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.lit(1.0) - safe_ratio(F.sum(error * error), sst, None)).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def pass_gate(metrics: DataFrame, group: str, limit: float) -> DataFrame:
    """``metrics`` has one row per (group, target) with ``mape``; a group passes when all stay below the limit."""
    return metrics.groupBy(group).agg((F.max("mape") < limit).alias("passed"), F.max("mape").alias("worst_mape"))


def gate_verdict(gate: DataFrame) -> DataFrame:
    """One row: fail when fewer than half (rounded down) of the models pass."""
    return gate.agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("models")).withColumn(
        "verdict", F.when(F.col("passed") < F.floor(F.col("models") / 2), "fail").otherwise("pass")
    )


def classifier_report(spark: SparkSession, scored: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """ROC and PR areas, accuracy at the threshold and base rate in one row (runs jobs)."""
    def area(metric: str) -> float:
        return BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label, metricName=metric, numBins=0).evaluate(scored)

    hit = (F.col(score) >= threshold).cast("int") == F.col(label).cast("int")
    return scored.agg(
        F.lit(area("areaUnderROC")).alias("roc_auc"), F.lit(area("areaUnderPR")).alias("pr_auc"),
        F.avg(hit.cast("int")).alias("accuracy"), F.avg(F.col(label).cast("double")).alias("base_rate"),
        F.count(F.lit(1)).alias("n"),
    )


def scored(model_path: str, rows: DataFrame) -> DataFrame:
    """Load a saved pipeline and add the probability of class 1; static and streaming frames alike."""
    out = PipelineModel.load(model_path).transform(rows)
    return out.withColumn("probability_1", vector_to_array("probability")[1])


# ---- forecast ---------------------------------------------------------------------------------

def forecast_inputs(history: DataFrame, group: str, day: str, features: Sequence[str], as_of: str, days: int = 7) -> DataFrame:
    """``days`` rows per group after the as-of day: calendar columns of the day, group means elsewhere."""
    calendar = {
        "day_of_week": F.dayofweek(day), "day_of_month": F.dayofmonth(day), "month": F.month(day),
        "quarter": F.quarter(day), "is_weekend": F.dayofweek(day).isin(1, 7).cast("int"),
    }
    start = F.lit(as_of).cast("date")
    means = history.groupBy(group).agg(*[F.avg(c).alias(c) for c in features if c not in calendar])
    future = means.withColumn(day, F.explode(F.sequence(F.date_add(start, 1), F.date_add(start, days))))
    return future.withColumns({c: e for c, e in calendar.items() if c in features})


def clamp_forecast(predicted: DataFrame, revenue: str, trips: str) -> DataFrame:
    """Never negative; revenue to cents, trips cut to whole numbers."""
    return predicted.withColumns(
        {
            "predicted_revenue": F.round(F.greatest(F.col(revenue), F.lit(0.0)), 2),
            "predicted_trips": F.greatest(F.col(trips), F.lit(0.0)).cast("int"),
        }
    )


def forecast_summary(forecast: DataFrame, group: str) -> DataFrame:
    """Totals per group plus a row 'TOTAL'."""
    sums = [F.round(F.sum("predicted_revenue"), 2).alias("revenue"), F.sum("predicted_trips").alias("trips")]
    per_group = forecast.groupBy(group).agg(*sums)
    return per_group.unionByName(forecast.agg(*sums).withColumn(group, F.lit("TOTAL")))


# ---- run tracking -----------------------------------------------------------------------------

def log_run(spark: SparkSession, path: str, run: str, params: Mapping[str, object], metrics: Mapping[str, float], model_path: str = "") -> None:
    """Append one run to a Parquet table."""
    row = [(run, {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()}, model_path)]
    schema = "run string, params map<string,string>, metrics map<string,double>, model_path string"
    spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(path)


def best_run(runs: DataFrame, metric: str) -> DataFrame:
    return runs.orderBy(F.element_at("metrics", metric), "run").limit(1)
