"""Window reports. Detail-level windows go through ``piecewise``; the rest run on aggregated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.piecewise import PIECE_ROWS, pieces_of, piecewise_frame, piecewise_windows, spread
from tidemark.session import materialize


def _by_zone(trips: DataFrame, row_order: Sequence[str], rows_per_piece: int, **windows) -> DataFrame:
    """Windows along the pickup time of a zone, cut by day, and days above ``rows_per_piece`` rows again (runs a job)."""
    cut = ["pu_zone"], F.to_date("pickup_ts"), ["pickup_ts", *row_order]
    return piecewise_windows(spread(trips, *cut, rows_per_piece), *cut, **windows)


def zone_ranks(trips: DataFrame, row_order: Sequence[str], rows_per_piece: int = PIECE_ROWS) -> DataFrame:
    return _by_zone(
        trips, row_order, rows_per_piece,
        row_number="row_num", rank="rank", dense_rank="dense_rank", rank_by=["pickup_ts"],
    )


def zone_neighbours(trips: DataFrame, row_order: Sequence[str], value: str, rows_per_piece: int = PIECE_ROWS) -> DataFrame:
    return _by_zone(
        trips, row_order, rows_per_piece,
        prev={f"prev_{value}": value}, next={f"next_{value}": value},
    )


def zone_running(trips: DataFrame, row_order: Sequence[str], value: str, rows_per_piece: int = PIECE_ROWS) -> DataFrame:
    out = _by_zone(
        trips, row_order, rows_per_piece,
        row_number="_n", running_sum={"_sum": value},
    )
    total = F.round("_sum", 4)
    return out.withColumns({f"running_sum_{value}": total, f"running_avg_{value}": total / F.col("_n")}).drop("_n", "_sum")


def top_fares_with_running(trips: DataFrame, row_order: Sequence[str], k: int = 100, rows_back: int = 10, rows_per_piece: int = PIECE_ROWS) -> DataFrame:
    """The k highest fares per passenger count with, at each of them, the running fare total and the
    mean of the last ``rows_back + 1`` fares in pickup order.

    The trips are written narrow first, as several passes read them (runs one job). The k rows are found
    next; only the days they fall on are then sorted, while the running total takes all other days
    from their totals.
    """
    keys, day, order = ["passengers"], F.to_date("pickup_ts"), ["pickup_ts", *row_order]
    base = materialize(trips.select("passengers", *order).withColumn("_row", F.monotonically_increasing_id()), "top-fares")
    best = Window.partitionBy("passengers").orderBy(F.desc("fare"), *order)
    top = base.withColumn("fare_rank", F.row_number().over(best)).filter(F.col("fare_rank") <= k)
    days = pieces_of(top, keys, day)
    base = spread(base, keys, day, order, rows_per_piece)
    running = piecewise_windows(base, keys, day, order, running_sum={"running_fare_total": "fare"}, only=days)
    rolling = piecewise_frame(
        base, keys, day, order, rows_back, 0, {"_sum": F.sum("fare"), "_n": F.count("fare")}, only=days
    )
    return (
        top.join(running.select("_row", "running_fare_total"), "_row")
        .join(rolling.select("_row", "_sum", "_n"), "_row")
        .withColumns(
            {"running_fare_total": F.round("running_fare_total", 2), "rolling_avg_fare": F.round("_sum", 2) / F.col("_n")}
        )
        .drop("_row", "_sum", "_n")
    )


def centered_mean(df: DataFrame, key: str, value: str, band: float, row_order: Sequence[str], reach: int = 2, rows_per_piece: int = PIECE_ROWS) -> DataFrame:
    """Mean over ``reach`` rows on either side in value order; ``band`` is the width of a value piece, larger ones are cut again.

    The rows are written narrow first, as both borders and the frame read them (runs one job).
    """
    order = [value, *[c for c in row_order if c != value]]
    cut = [key], F.floor(F.col(value) / band), order
    out = piecewise_frame(
        spread(materialize(df.select(key, *order), "centered"), *cut, rows_per_piece), *cut, reach, reach,
        {"_sum": F.sum(value), "_n": F.count(value)},
    )
    return out.withColumn(f"rolling_avg_{value}", F.round("_sum", 2) / F.col("_n")).drop("_sum", "_n")


def cumulative(df: DataFrame, order: str, value: str, keys: Sequence[str] = ()) -> Column:
    """Running sum over already aggregated rows."""
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(order))


def growth_pct(value: str, order: str, back: int = 1, keys: Sequence[str] = ()) -> Column:
    earlier = F.lag(value, back).over(Window.partitionBy(*keys).orderBy(order))
    return (F.col(value) - earlier) / earlier * 100


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, ranking: str = "row_number") -> DataFrame:
    """The best k rows per group; Spark prunes to k per group in every map task before the shuffle."""
    rank = getattr(F, ranking)().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def borough_lags(daily: DataFrame, value: str) -> DataFrame:
    """Lag 1 and 7, 7-row rolling mean and sample deviation per borough; rows with a gap are dropped."""
    along = Window.partitionBy("borough").orderBy("pickup_date")
    week = along.rowsBetween(-6, 0)
    return daily.withColumns(
        {
            f"{value}_lag_1": F.lag(value, 1).over(along), f"{value}_lag_7": F.lag(value, 7).over(along),
            f"{value}_rolling_mean_7": F.avg(value).over(week), f"{value}_rolling_std_7": F.stddev_samp(value).over(week),
        }
    ).na.drop()


def shuffled_cap(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows in a repeatable random order: sorted by a key hash, without a one-task window."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)
