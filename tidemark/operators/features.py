"""The trip feature table: calendar, place, history and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as fx

# The columns of the feature table.
FEATURE_COLUMNS = [
    "pickup_date", "pu_zone", "do_zone", "borough", "hour_of_day", "day_of_week", "day_of_month", "month",
    "quarter", "year", "is_weekend", "is_rush_hour", "is_holiday", "time_of_day", "distance", "trip_duration",
    "avg_speed", "is_airport", "daily_revenue", "daily_trips", "revenue_ma_7d", "trips_ma_7d",
    "revenue_same_day_lw", "trips_same_day_lw", "total_amount_7d", "trip_count_7d",
]


def temporal(trips: DataFrame) -> DataFrame:
    ts = F.col("pickup_ts")
    hour, weekday = F.hour(ts), F.dayofweek(ts)
    return trips.withColumns(
        {
            "pickup_date": F.to_date(ts), "hour_of_day": hour, "day_of_week": weekday,
            "day_of_month": F.dayofmonth(ts), "month": F.month(ts), "quarter": F.quarter(ts), "year": F.year(ts),
            "week_of_year": F.weekofyear(ts), "is_weekend": fx.is_weekend(weekday),
            "is_rush_hour": fx.is_rush_hour(hour), "is_holiday": fx.is_holiday(F.to_date(ts)),
            "time_of_day": fx.time_of_day(hour),
        }
    )


def geospatial(trips: DataFrame) -> DataFrame:
    minutes = fx.minutes_between(F.col("pickup_ts"), F.col("dropoff_ts"))
    return trips.withColumns(
        {
            "borough": fx.borough(F.col("pu_zone")), "trip_duration": minutes,
            "avg_speed": fx.safe_ratio(F.col("distance"), minutes / 60), "is_airport": fx.is_airport(F.col("pu_zone")),
        }
    )


def daily_zone(trips: DataFrame) -> DataFrame:
    """Revenue, trips, mean distance and mean minutes per day, zone and borough."""
    return trips.groupBy(
        F.to_date("pickup_ts").alias("pickup_date"), "pu_zone", fx.borough(F.col("pu_zone")).alias("borough")
    ).agg(
        F.sum("total").alias("daily_revenue"), F.count(F.lit(1)).alias("daily_trips"),
        F.avg("distance").alias("avg_distance"),
        F.avg(fx.minutes_between(F.col("pickup_ts"), F.col("dropoff_ts"))).alias("avg_duration"),
    )


def daily_borough(trips: DataFrame) -> DataFrame:
    """The modelling table: one row per day and borough."""
    ts = F.col("pickup_ts")
    return trips.groupBy(F.to_date(ts).alias("pickup_date"), fx.borough(F.col("pu_zone")).alias("borough")).agg(
        F.count(F.lit(1)).alias("trip_count"), F.sum("total").alias("revenue"), F.avg("distance").alias("avg_distance"),
        F.sum(fx.is_rush_hour(F.hour(ts))).alias("rush_trips"), F.sum(fx.is_airport(F.col("pu_zone"))).alias("airport_trips"),
        F.max(fx.is_weekend(F.dayofweek(ts))).alias("is_weekend"),
    )


def with_history(daily: DataFrame) -> DataFrame:
    """Mean of the 7 earlier rows and the value 7 rows back, per zone. Frames count rows, not days.

    ``daily`` has one row per zone and day, so the calendar bounds the rows of a zone.
    """
    along = Window.partitionBy("pu_zone").orderBy("pickup_date")
    week = along.rowsBetween(-7, -1)
    return daily.withColumns(
        {
            "revenue_ma_7d": F.avg("daily_revenue").over(week), "trips_ma_7d": F.avg("daily_trips").over(week),
            "revenue_same_day_lw": F.lag("daily_revenue", 7).over(along),
            "trips_same_day_lw": F.lag("daily_trips", 7).over(along),
        }
    )


def with_history_by_date(daily: DataFrame) -> DataFrame:
    """The calendar form: the mean over the 7 previous days, whether or not every day has a row."""
    day = daily.withColumn("_day", F.unix_date("pickup_date"))
    week = Window.partitionBy("pu_zone").orderBy("_day").rangeBetween(-7, -1)
    return day.withColumns(
        {"revenue_ma_7d": F.avg("daily_revenue").over(week), "trips_ma_7d": F.avg("daily_trips").over(week)}
    ).drop("_day")


def with_targets(daily: DataFrame) -> DataFrame:
    """Sums of the 7 following rows per zone; fewer at the end, NULL on the last row."""
    week = Window.partitionBy("pu_zone").orderBy("pickup_date").rowsBetween(1, 7)
    return daily.withColumns(
        {"total_amount_7d": F.sum("daily_revenue").over(week), "trip_count_7d": F.sum("daily_trips").over(week)}
    )


def feature_table(trips: DataFrame, row_order: list[str]) -> DataFrame:
    """One row per (day, zone, hour) with its calendar, place, history and target columns.

    The kept row of a key is the first by pickup time and ``row_order``. Trips are read and shuffled
    once: they shrink map-side to one row per (day, zone, hour) carrying its sums and its kept row,
    those gather into one row per (day, zone) with at most 24 hours inside, and the history windows
    run on these day rows, whose number per zone the calendar bounds. No join back is needed.
    """
    carried = ["pickup_ts", *row_order, *[c for c in ("dropoff_ts", "do_zone", "distance") if c not in row_order]]
    hourly = trips.groupBy(
        F.to_date("pickup_ts").alias("pickup_date"), "pu_zone", F.hour("pickup_ts").alias("_hour")
    ).agg(F.sum("total").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.min(F.struct(*carried)).alias("_kept"))
    daily = hourly.groupBy("pickup_date", "pu_zone").agg(
        F.sum("_sum").alias("daily_revenue"), F.sum("_n").alias("daily_trips"), F.collect_list("_kept").alias("_hours")
    )
    rows = (
        with_targets(with_history(daily))
        .withColumn("_row", F.explode("_hours"))
        .select("*", *[F.col(f"_row.{c}").alias(c) for c in carried])
    )
    return geospatial(temporal(rows)).select(*FEATURE_COLUMNS)
