"""Boosted regression trees for many small groups, all fitted at the same time.

The groups are daily tables: one row per (group, day), so the calendar bounds what a group holds, however large the detail
below it. Spark shuffles each (group, target) to a task of its own and every model is fitted there, in one job; MLlib would
run one job per tree level and model. Groups that the calendar does not bound belong to ``learning.boosted_per_group``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.learning import BOOSTING, MIN_GROUP_ROWS

BINS = 256


class Trees:
    """Squared-error boosting: level by level, every leaf takes the split with the largest gain over binned features."""

    def __init__(self, rounds: int, depth: int, step: float, bins: int = BINS):
        self.rounds, self.depth, self.step, self.bins = rounds, depth, step, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.borders = [self._borders(column) for column in x.T]
        codes, self.base, self.trees = self._codes(x), y.mean(), []
        rest = y - self.base
        for _ in range(self.rounds):
            leaf, splits = np.zeros(len(y), dtype=np.int64), []
            for level in range(self.depth):
                splits.append(self._best(codes, leaf, rest, 2**level))
                leaf = self._down(codes, leaf, splits[-1])
            size = np.bincount(leaf, minlength=2**self.depth)
            gain = self.step * np.bincount(leaf, rest, 2**self.depth) / np.maximum(size, 1)
            self.trees.append((splits, gain))
            rest = rest - gain[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes, out = self._codes(x), np.full(len(x), self.base)
        for splits, gain in self.trees:
            leaf = np.zeros(len(x), dtype=np.int64)
            for split in splits:
                leaf = self._down(codes, leaf, split)
            out += gain[leaf]
        return out

    def _borders(self, column: np.ndarray) -> np.ndarray:
        """Middles between neighbouring values, or between quantiles where there are more values than bins."""
        values = np.unique(column)
        if len(values) > self.bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, self.bins), method="lower"))
        return (values[1:] + values[:-1]) / 2

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, column) for b, column in zip(self.borders, x.T)], axis=1)

    def _best(self, codes: np.ndarray, leaf: np.ndarray, rest: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """(feature, last code that goes left) per leaf; a leaf without a useful split sends all rows left."""
        n_features = codes.shape[1]
        cell = ((leaf[:, None] * n_features + np.arange(n_features)) * self.bins + codes).ravel()
        shape = (leaves, n_features, self.bins)
        sums = np.bincount(cell, np.repeat(rest, n_features), np.prod(shape)).reshape(shape).cumsum(axis=2)
        counts = np.bincount(cell, minlength=np.prod(shape)).reshape(shape).cumsum(axis=2)
        total, size = sums[:, :, -1:], counts[:, :, -1:]
        valid = (counts > 0) & (counts < size)
        left, right = np.maximum(counts, 1), np.maximum(size - counts, 1)
        gain = np.where(valid, sums**2 / left + (total - sums) ** 2 / right - total**2 / np.maximum(size, 1), 0.0).reshape(leaves, -1)
        best = gain.argmax(axis=1)
        useful = gain[np.arange(leaves), best] > 1e-12
        return best // self.bins, np.where(useful, best % self.bins, self.bins)

    @staticmethod
    def _down(codes: np.ndarray, leaf: np.ndarray, split: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        feature, last = split
        return 2 * leaf + (codes[np.arange(len(leaf)), feature[leaf]] > last[leaf])


def boosted_daily(
    rows: DataFrame, group: str, day: str, part: str, features: Sequence[str], targets: Mapping[str, str],
    settings: Mapping[str, object] | None = None, min_rows: int = MIN_GROUP_ROWS,
) -> DataFrame:
    """Fits one model per (group, target) on the rows whose ``part`` is 'train' and predicts every row.

    ``rows`` has one row per (group, day); ``targets`` maps a label to its column. Missing features count as 0, known rows without
    a target are left out, rows to forecast ('future') need none. Groups with fewer than ``min_rows`` known rows, without training rows, and the
    group 'Unknown' are skipped. Returns (group, day, part, target, actual, prediction).
    """
    chosen = dict(settings or BOOSTING)
    names, kinds = list(features), {f.name: f.dataType.simpleString() for f in rows.schema}
    pairs = F.explode(F.array(*[F.struct(F.lit(label).alias("target"), F.col(c).cast("double").alias("actual")) for label, c in targets.items()]))
    long = rows.filter(F.col(group) != "Unknown").select(group, day, part, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names], pairs.alias("_t"))
    long = long.select("*", "_t.*").drop("_t").filter((F.col(part) == "future") | F.col("actual").isNotNull())
    columns = [group, day, part, "target", "actual", "prediction"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([day, *names], kind="stable")  # sums in one order: reruns agree
        train = pdf[pdf[part] == "train"]
        if (pdf[part] != "future").sum() < min_rows or train.empty:
            return pdf.assign(prediction=0.0)[columns].head(0)
        model = Trees(chosen["maxIter"], chosen["maxDepth"], chosen["stepSize"])
        model.fit(train[names].to_numpy(float), train["actual"].to_numpy(float))
        return pdf.assign(prediction=model.predict(pdf[names].to_numpy(float)))[columns]

    schema = f"`{group}` {kinds[group]}, `{day}` {kinds[day]}, `{part}` string, target string, actual double, prediction double"
    return long.groupBy(group, "target").applyInPandas(fit, schema)


def forecast_report(predicted: DataFrame, metrics: DataFrame, group: str, day: str, version: str, generated_at: str) -> DataFrame:
    """The forecast table: predictions of both targets side by side with the error of the models that made them."""
    def both(df: DataFrame, value: str, names: Mapping[str, str], *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.max(F.when(F.col("target") == label, F.col(value))).alias(name) for label, name in names.items()])

    future = both(predicted.filter("part = 'future'"), "prediction", {"revenue": "_revenue", "trips": "_trips"}, group, day)
    errors = both(metrics, "mape", {"revenue": "mape_revenue", "trips": "mape_trips"}, group)
    return future.join(errors, group, "left").select(
        F.col(day).alias("forecast_date"), group, F.round(F.greatest(F.col("_revenue"), F.lit(0.0)), 2).alias("predicted_revenue"),
        F.greatest(F.col("_trips"), F.lit(0.0)).cast("int").alias("predicted_trips"), F.lit(f"v{version}").alias("model_version"),
        F.lit("GradientBoostedTrees").alias("model_type"), "mape_revenue", "mape_trips", F.lit(generated_at).cast("timestamp").alias("generated_at"),
    )
