"""Caching and plan inspection."""

from __future__ import annotations

import weakref
from collections.abc import Callable
from contextlib import contextmanager, redirect_stdout
from functools import partial
from io import StringIO

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


@contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """Keep ``df`` while the block runs; blocks that do not fit in memory go to disk."""
    kept = df.persist(level)
    try:
        yield kept
    finally:
        kept.unpersist()


class Kept:
    """A cached frame that its owner closes: by ``close``, as a context, or, once attached to a result, when that result goes."""

    def __init__(self, df: DataFrame, drop: Callable[[], object]):
        self.df, self._drop = df, weakref.finalize(self, drop)

    def close(self) -> None:
        self._drop()

    def attach(self, result: DataFrame) -> DataFrame:
        """Keeps the cache for as long as ``result`` is held."""
        result._kept = self
        return result

    def __enter__(self) -> DataFrame:
        return self.df

    def __exit__(self, *error: object) -> None:
        self.close()


def keep(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Kept:
    """Caches ``df`` until the handle is closed; it is filled when it is first read."""
    df.persist(level)
    return Kept(df, df.unpersist)


def keep_table(spark: SparkSession, name: str, select: str, lazy: bool = False) -> Kept:
    """CACHE [LAZY] TABLE name AS select until the handle is closed."""
    spark.sql(f"CACHE {'LAZY ' if lazy else ''}TABLE {name} AS {select}")
    return Kept(spark.table(name), partial(spark.sql, f"UNCACHE TABLE IF EXISTS {name}"))


@contextmanager
def cached_table(spark: SparkSession, name: str, select: str, lazy: bool = False):
    """CACHE [LAZY] TABLE name AS select while the block runs."""
    spark.sql(f"CACHE {'LAZY ' if lazy else ''}TABLE {name} AS {select}")
    try:
        yield name
    finally:
        spark.sql(f"UNCACHE TABLE IF EXISTS {name}")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    out = StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()
