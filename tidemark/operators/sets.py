"""Unions, pivots and hierarchies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import Steps


def union_evolving(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing from a frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def pivot_sum(df: DataFrame, keys: Sequence[str], category: str, values: Sequence[str], value: str) -> DataFrame:
    """Listed categories to columns; naming them spares the extra pass that finds them."""
    return df.groupBy(*keys).pivot(category, list(values)).sum(value)


def levels(nodes: DataFrame, id: str, parent: str) -> DataFrame:
    """All nodes reachable from the roots (NULL parent) with their level (runs two actions per level).

    Each level is one join with the level above and is written to the shared folder; it ends when a level is empty,
    however deep the hierarchy. A node has one parent, so nodes on a cycle are never reached.
    """
    steps = Steps(nodes.sparkSession, "levels")
    frontier = steps.add(nodes.filter(F.col(parent).isNull()))
    while not frontier.isEmpty():
        parents = frontier.select(F.col(id).alias("_parent"))
        frontier = steps.add(nodes.join(parents, F.col(parent) == F.col("_parent"), "left_semi"))
    return steps.all().withColumn("level", F.col("_step") + 1).drop("_step")


def descendants(nodes: DataFrame, id: str, parent: str, root: str) -> DataFrame:
    """The root and everything below it, one join per level (runs two actions per level).

    Each level is written to the shared folder, so a lost executor costs one level, and all levels are read
    as one table, so the plan does not grow. It ends when a level is empty. A node is visited once, so cycles end.
    """
    steps = Steps(nodes.sparkSession, "descendants")
    frontier = steps.add(nodes.filter(F.col(id) == root))
    while not frontier.isEmpty():
        parents = frontier.select(F.col(id).alias("_parent"))
        below = nodes.join(parents, F.col(parent) == F.col("_parent"), "left_semi")
        frontier = steps.add(below.join(steps.all().select(id), id, "left_anti").select(*nodes.columns))
    return steps.all().drop("_step")
