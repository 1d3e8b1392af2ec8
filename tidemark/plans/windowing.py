"""Window functions, sorting, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.operators import features, sets
from tidemark.operators import windows as ops
from tidemark.operators.piecewise import stitched_sessions
from tidemark.plans.inputs import TRIP_ORDER, WITH_TRIPS, table, trips
from tidemark.plans.registry import query
from tidemark.plans.rows import BOROUGH_SQL, KEYS

IN_ORDER = "PARTITION BY pu_zone ORDER BY pickup_ts, order_id, line_no, part_id, supp_id, fare"


@query(
    "win_01_ranks",
    f"""{WITH_TRIPS} SELECT {KEYS}, row_number() OVER ({IN_ORDER}) AS row_num,
        rank() OVER (PARTITION BY pu_zone ORDER BY pickup_ts) AS rank,
        dense_rank() OVER (PARTITION BY pu_zone ORDER BY pickup_ts) AS dense_rank FROM trips""",
)
def ranks(spark: SparkSession, d: str) -> DataFrame:
    rides = trips(spark, d).select("pu_zone", "pickup_ts", *TRIP_ORDER)
    return ops.zone_ranks(rides, TRIP_ORDER).drop("pu_zone", "pickup_ts")


@query(
    "win_02_neighbours",
    f"""{WITH_TRIPS} SELECT {KEYS}, lead(fare) OVER ({IN_ORDER}) AS next_fare, lag(fare) OVER ({IN_ORDER}) AS prev_fare
        FROM trips""",
)
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    rides = trips(spark, d).select("pu_zone", "pickup_ts", *TRIP_ORDER)
    return ops.zone_neighbours(rides, TRIP_ORDER, "fare").drop("pu_zone", "pickup_ts")


@query(
    "win_03_running",
    f"""{WITH_TRIPS}, w AS (SELECT {KEYS},
        round(sum(fare) OVER ({IN_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running_sum_fare,
        row_number() OVER ({IN_ORDER}) AS n FROM trips)
    SELECT {KEYS}, running_sum_fare, running_sum_fare / n AS running_avg_fare FROM w""",
)
def running(spark: SparkSession, d: str) -> DataFrame:
    rides = trips(spark, d).select("pu_zone", "pickup_ts", *TRIP_ORDER)
    return ops.zone_running(rides, TRIP_ORDER, "fare").drop("pu_zone", "pickup_ts")


@query(
    "win_04_top_fares_running",
    f"""{WITH_TRIPS}, v AS (SELECT * FROM trips WHERE passengers BETWEEN 1 AND 4 AND total > 0 AND fare > 0),
    w AS (SELECT passengers, pickup_ts, order_id, line_no, part_id, supp_id, fare,
        round(sum(fare) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_fare_total,
        round(sum(fare) OVER (o ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), 2)
          / count(fare) OVER (o ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS rolling_avg_fare,
        row_number() OVER (PARTITION BY passengers ORDER BY fare DESC, pickup_ts, order_id, line_no, part_id, supp_id)
          AS fare_rank FROM v
        WINDOW o AS (PARTITION BY passengers ORDER BY pickup_ts, order_id, line_no, part_id, supp_id, fare))
    SELECT * FROM w WHERE fare_rank <= 100""",
)
def top_fares_running(spark: SparkSession, d: str) -> DataFrame:
    rides = trips(spark, d).filter(F.col("passengers").between(1, 4) & (F.col("total") > 0) & (F.col("fare") > 0))
    return ops.top_fares_with_running(rides, TRIP_ORDER)


@query(
    "win_05_centered_mean",
    f"""{WITH_TRIPS} SELECT passengers, {KEYS}, round(sum(fare) OVER w, 2) / count(fare) OVER w AS rolling_avg_fare
    FROM trips WINDOW w AS (PARTITION BY passengers ORDER BY fare, order_id, line_no, part_id, supp_id
                            ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
)
def centered_mean(spark: SparkSession, d: str) -> DataFrame:
    return ops.centered_mean(trips(spark, d), "passengers", "fare", 1000.0, TRIP_ORDER)


DAILY_SQL = f"""SELECT pickup_ts::DATE AS pickup_date, pu_zone, {BOROUGH_SQL} AS borough,
    round(sum(total), 4) AS daily_revenue, count(*) AS daily_trips FROM trips GROUP BY 1, 2, 3"""


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return features.daily_zone(trips(spark, d)).withColumn("daily_revenue", F.round("daily_revenue", 4))


@query(
    "win_06_trailing_mean",
    f"""{WITH_TRIPS}, daily AS ({DAILY_SQL}) SELECT pickup_date, pu_zone, round(avg(daily_revenue) OVER w, 6) AS revenue_ma_7d,
        round(avg(daily_trips) OVER w, 6) AS trips_ma_7d FROM daily
    WINDOW w AS (PARTITION BY pu_zone ORDER BY pickup_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
)
def trailing_mean(spark: SparkSession, d: str) -> DataFrame:
    out = features.with_history(_daily(spark, d))
    return out.select("pickup_date", "pu_zone", F.round("revenue_ma_7d", 6).alias("revenue_ma_7d"), F.round("trips_ma_7d", 6).alias("trips_ma_7d"))


@query(
    "win_06_trailing_mean_by_date",
    f"""{WITH_TRIPS}, daily AS ({DAILY_SQL}) SELECT pickup_date, pu_zone, round(avg(daily_revenue) OVER w, 6) AS revenue_ma_7d,
        round(avg(daily_trips) OVER w, 6) AS trips_ma_7d FROM daily
    WINDOW w AS (PARTITION BY pu_zone ORDER BY pickup_date
                 RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""",
)
def trailing_mean_by_date(spark: SparkSession, d: str) -> DataFrame:
    out = features.with_history_by_date(_daily(spark, d))
    return out.select("pickup_date", "pu_zone", F.round("revenue_ma_7d", 6).alias("revenue_ma_7d"), F.round("trips_ma_7d", 6).alias("trips_ma_7d"))


@query(
    "win_07_seven_rows_back",
    f"""{WITH_TRIPS}, daily AS ({DAILY_SQL}) SELECT pickup_date, pu_zone, lag(daily_revenue, 7) OVER w AS revenue_same_day_lw,
        lag(daily_trips, 7) OVER w AS trips_same_day_lw FROM daily
    WINDOW w AS (PARTITION BY pu_zone ORDER BY pickup_date)""",
)
def seven_rows_back(spark: SparkSession, d: str) -> DataFrame:
    out = features.with_history(_daily(spark, d))
    return out.select("pickup_date", "pu_zone", "revenue_same_day_lw", "trips_same_day_lw")


@query(
    "win_08_forward_sum",
    f"""{WITH_TRIPS}, daily AS ({DAILY_SQL}) SELECT pickup_date, pu_zone, round(sum(daily_revenue) OVER w, 4) AS total_amount_7d,
        (sum(daily_trips) OVER w)::BIGINT AS trip_count_7d FROM daily
    WINDOW w AS (PARTITION BY pu_zone ORDER BY pickup_date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)""",
)
def forward_sum(spark: SparkSession, d: str) -> DataFrame:
    out = features.with_targets(_daily(spark, d))
    return out.select("pickup_date", "pu_zone", F.round("total_amount_7d", 4).alias("total_amount_7d"), "trip_count_7d")


MONTHLY_SQL = "SELECT month(pickup_ts) AS month, round(sum(total) / 1000000, 6) AS revenue_m FROM trips GROUP BY 1"


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    return trips(spark, d).groupBy(F.month("pickup_ts").alias("month")).agg(F.round(F.sum("total") / 1_000_000, 6).alias("revenue_m"))


@query(
    "win_09_cumulative_month",
    f"""{WITH_TRIPS}, m AS ({MONTHLY_SQL})
    SELECT month, revenue_m, round(sum(revenue_m) OVER (ORDER BY month), 6) AS cumulative_revenue_m FROM m""",
)
def cumulative_month(spark: SparkSession, d: str) -> DataFrame:
    monthly = _monthly(spark, d)
    return monthly.withColumn("cumulative_revenue_m", F.round(ops.cumulative(monthly, "month", "revenue_m"), 6))


@query(
    "win_10_month_over_month",
    f"""{WITH_TRIPS}, m AS ({MONTHLY_SQL}) SELECT month, revenue_m,
        round((revenue_m - lag(revenue_m) OVER (ORDER BY month)) / lag(revenue_m) OVER (ORDER BY month) * 100, 4)
          AS month_over_month_pct FROM m""",
)
def month_over_month(spark: SparkSession, d: str) -> DataFrame:
    return _monthly(spark, d).withColumn("month_over_month_pct", F.round(ops.growth_pct("revenue_m", "month"), 4))


REVENUE_BY_DAY_SQL = """SELECT o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1"""


def _revenue_by_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query(
    "win_11_year_over_year",
    f"""SELECT day, revenue, lag(revenue, 365) OVER (ORDER BY day) AS revenue_last_year,
        round(revenue - lag(revenue, 365) OVER (ORDER BY day), 2) AS yoy_growth FROM ({REVENUE_BY_DAY_SQL})""",
)
def year_over_year(spark: SparkSession, d: str) -> DataFrame:
    last_year = F.lag("revenue", 365).over(Window.partitionBy().orderBy("day"))
    return _revenue_by_day(spark, d).withColumns(
        {"revenue_last_year": last_year, "yoy_growth": F.round(F.col("revenue") - last_year, 2)}
    )


@query(
    "win_12_moving_mean",
    """WITH s AS (SELECT o_orderpriority, o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS sales
                  FROM orders GROUP BY 1, 2)
    SELECT o_orderpriority, day, sales, round(sum(sales) OVER w, 2) / count(sales) OVER w AS moving_avg_7day FROM s
    WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def moving_mean(spark: SparkSession, d: str) -> DataFrame:
    sales = table(spark, d, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("sales")
    )
    week = Window.partitionBy("o_orderpriority").orderBy("day").rowsBetween(-6, 0)
    return sales.withColumn("moving_avg_7day", F.round(F.sum("sales").over(week), 2) / F.count("sales").over(week))


@query(
    "win_13_top_per_customer",
    """SELECT o_custkey, o_orderkey, o_totalprice,
              row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders
       QUALIFY rank <= 10""",
)
def top_per_customer(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ops.top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


@query(
    "win_13_top_zones_by_month",
    f"""{WITH_TRIPS}, z AS (SELECT month(pickup_ts) AS month, pu_zone, count(*) AS trip_count FROM trips GROUP BY 1, 2)
    SELECT *, rank() OVER (PARTITION BY month ORDER BY trip_count DESC) AS rank FROM z QUALIFY rank <= 3""",
)
def top_zones_by_month(spark: SparkSession, d: str) -> DataFrame:
    zones = trips(spark, d).groupBy(F.month("pickup_ts").alias("month"), "pu_zone").agg(agg.n_rows())
    return ops.top_per_group(zones, ["month"], [F.desc("trip_count")], 3, "rank")


@query(
    "win_14_sessions",
    """WITH f AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE
                                           THEN 1 ELSE 0 END AS is_new FROM events),
    s AS (SELECT user_id, ts, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS session_id FROM f)
    SELECT user_id, session_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS event_count
    FROM s GROUP BY 1, 2""",
)
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return stitched_sessions(table(spark, d, "events"), "user_id", "ts", "30 MINUTES")


@query(
    "win_15_borough_lags",
    f"""{WITH_TRIPS}, b AS (SELECT pickup_ts::DATE AS pickup_date, {BOROUGH_SQL} AS borough, count(*) AS trip_count
                            FROM trips GROUP BY 1, 2),
    w AS (SELECT *, lag(trip_count, 1) OVER o AS trip_count_lag_1, lag(trip_count, 7) OVER o AS trip_count_lag_7,
        round(avg(trip_count) OVER (o ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS trip_count_rolling_mean_7,
        round(stddev_samp(trip_count) OVER (o ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS trip_count_rolling_std_7
        FROM b WINDOW o AS (PARTITION BY borough ORDER BY pickup_date))
    SELECT * FROM w WHERE trip_count_lag_7 IS NOT NULL AND trip_count_rolling_std_7 IS NOT NULL""",
)
def borough_lags(spark: SparkSession, d: str) -> DataFrame:
    daily = features.daily_borough(trips(spark, d)).select("pickup_date", "borough", "trip_count")
    out = ops.borough_lags(daily, "trip_count")
    names = ["trip_count_rolling_mean_7", "trip_count_rolling_std_7"]
    return out.withColumns({n: F.round(n, 6) for n in names})


@query(
    "win_16_share_of_total",
    """SELECT l_returnflag, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS pct
       FROM lineitem GROUP BY 1""",
)
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").groupBy("l_returnflag").agg(agg.n_rows("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


@query(
    "win_17_shuffled_cap",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 1000",
)
def shuffled_cap(spark: SparkSession, d: str) -> DataFrame:
    return ops.shuffled_cap(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000)


@query(
    "win_18_cumulative_per_year",
    f"""{WITH_TRIPS}, m AS (SELECT year(pickup_ts) AS year, month(pickup_ts) AS month, round(sum(fare), 2) AS fare
                            FROM trips GROUP BY 1, 2)
    SELECT *, round(sum(fare) OVER (PARTITION BY year ORDER BY month), 2) AS cumulative_fare FROM m""",
)
def cumulative_per_year(spark: SparkSession, d: str) -> DataFrame:
    monthly = trips(spark, d).groupBy(F.year("pickup_ts").alias("year"), F.month("pickup_ts").alias("month")).agg(
        F.round(F.sum("fare"), 2).alias("fare")
    )
    return monthly.withColumn("cumulative_fare", F.round(ops.cumulative(monthly, "month", "fare", ["year"]), 2))


@query(
    "srt_01_global_sort",
    """SELECT l_returnflag, l_extendedprice, l_orderkey, l_linenumber, l_partkey FROM lineitem
       ORDER BY l_extendedprice DESC, l_returnflag, l_orderkey, l_linenumber, l_partkey""",
)
def global_sort(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")
    return lines.orderBy(F.desc("l_extendedprice"), "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey")


@query(
    "srt_02_top_1000",
    """SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderdate, o_orderkey
       LIMIT 1000""",
)
def top_1000(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(1000)


@query(
    "srt_03_top_zones",
    f"""{WITH_TRIPS} SELECT pu_zone, count(*) AS trip_count, round(sum(total), 4) AS revenue FROM trips GROUP BY 1
        ORDER BY trip_count DESC, pu_zone LIMIT 10""",
)
def top_zones(spark: SparkSession, d: str) -> DataFrame:
    zones = trips(spark, d).groupBy("pu_zone").agg(agg.n_rows(), F.round(F.sum("total"), 4).alias("revenue"))
    return zones.orderBy(F.desc("trip_count"), "pu_zone").limit(10)


@query(
    "srt_03_top_routes",
    f"""{WITH_TRIPS} SELECT pu_zone, do_zone, count(*) AS trip_count, round(sum(fare), 4) / count(fare) AS avg_fare
        FROM trips GROUP BY 1, 2 ORDER BY trip_count DESC, pu_zone, do_zone LIMIT 15""",
)
def top_routes(spark: SparkSession, d: str) -> DataFrame:
    routes = trips(spark, d).groupBy("pu_zone", "do_zone").agg(agg.n_rows(), agg.steady_mean("fare"))
    return routes.orderBy(F.desc("trip_count"), "pu_zone", "do_zone").limit(15)


@query("srt_04_range_repartition", "SELECT o_orderkey, o_totalprice FROM orders")
def range_repartition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").hint("repartition_by_range", 16, F.col("o_totalprice"))


@query(
    "set_01_union_all",
    """SELECT 'by_flag' AS kind, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 2
       UNION ALL SELECT 'by_status', l_linestatus, count(*) FROM lineitem GROUP BY 2""",
)
def union_all(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    flags = lines.groupBy(F.lit("by_flag").alias("kind"), F.col("l_returnflag").alias("label")).agg(agg.n_rows("n"))
    states = lines.groupBy(F.lit("by_status").alias("kind"), F.col("l_linestatus").alias("label")).agg(agg.n_rows("n"))
    return flags.unionAll(states)


@query(
    "set_02_union_by_name",
    """SELECT o_orderkey AS id, o_totalprice AS amount, NULL::VARCHAR AS event_type FROM orders
       UNION ALL BY NAME SELECT event_id AS id, event_type, value AS amount FROM events""",
)
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    events = table(spark, d, "events").select("event_type", F.col("event_id").alias("id"), F.col("value").alias("amount"))
    return sets.union_evolving([orders, events])


@query("set_03_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query(
    "set_04_cte",
    """WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000)
       SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM big GROUP BY 1""",
)
def cte(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(
        """WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 200000)
           SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM big GROUP BY 1""",
        orders=table(spark, d, "orders"),
    )


@query(
    "set_05_scalar_subquery",
    """SELECT o_orderpriority, count(*) AS n, (SELECT max(o_totalprice) FROM orders) AS max_price,
              count(*) / (SELECT count(*) FROM orders)::DOUBLE AS share FROM orders GROUP BY 1""",
)
def scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    whole = orders.agg(F.max("o_totalprice").alias("top"), F.count(F.lit(1)).alias("n"))
    return orders.groupBy("o_orderpriority").agg(agg.n_rows("n")).select(
        "o_orderpriority", "n", whole.select("top").scalar().alias("max_price"),
        (F.col("n") / whole.select("n").scalar()).alias("share"),
    )


@query(
    "set_06_temp_view",
    """SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 20 GROUP BY 1""",
)
def temp_view(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "events").createOrReplaceTempView("tidemark_events")
    return spark.sql(
        "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM tidemark_events WHERE value > 20 GROUP BY 1"
    )


NODES_SQL = """SELECT 'R' || r_regionkey AS id, r_name AS name, NULL AS parent FROM region
    UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation
    UNION ALL SELECT 'C' || c_custkey, c_name, 'N' || c_nationkey FROM customer
    UNION ALL SELECT 'O' || o_orderkey, o_orderpriority, 'C' || o_custkey FROM orders"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """region > nation > customer > order as (id, name, parent)."""
    def part(name: str, letter: str, key: str, label: str, parent: str | None) -> DataFrame:
        return table(spark, d, name).select(
            F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.col(label).alias("name"),
            (F.concat(F.lit({"N": "R", "C": "N", "O": "C"}[letter]), F.col(parent).cast("string")) if parent else F.lit(None).cast("string")).alias("parent"),
        )

    return (
        part("region", "R", "r_regionkey", "r_name", None)
        .unionAll(part("nation", "N", "n_nationkey", "n_name", "n_regionkey"))
        .unionAll(part("customer", "C", "c_custkey", "c_name", "c_nationkey"))
        .unionAll(part("orders", "O", "o_orderkey", "o_orderpriority", "o_custkey"))
    )


@query(
    "set_07_recursive_levels",
    f"""WITH RECURSIVE n AS ({NODES_SQL}), h AS (SELECT id, name, parent, 1 AS level FROM n WHERE parent IS NULL
        UNION ALL SELECT n.id, n.name, n.parent, h.level + 1 FROM n JOIN h ON n.parent = h.id) SELECT * FROM h""",
)
def recursive_levels(spark: SparkSession, d: str) -> DataFrame:
    return sets.levels(nodes(spark, d), "id", "parent")


@query(
    "set_07_recursive_descendants",
    f"""WITH RECURSIVE n AS ({NODES_SQL}), h AS (SELECT id, parent FROM n WHERE id = 'R2'
        UNION ALL SELECT n.id, n.parent FROM n JOIN h ON n.parent = h.id) SELECT * FROM h""",
)
def recursive_descendants(spark: SparkSession, d: str) -> DataFrame:
    return sets.descendants(nodes(spark, d), "id", "parent", "R2").select("id", "parent")


@query(
    "res_01_pivot",
    """SELECT o_orderstatus, round(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 2) AS urgent,
              round(sum(o_totalprice) FILTER (o_orderpriority = '2-HIGH'), 2) AS high,
              round(sum(o_totalprice) FILTER (o_orderpriority = '5-LOW'), 2) AS low FROM orders GROUP BY 1""",
)
def pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = sets.pivot_sum(table(spark, d, "orders"), ["o_orderstatus"], "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"], "o_totalprice")
    return wide.select("o_orderstatus", *[F.round(F.col(f"`{a}`"), 2).alias(b) for a, b in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("5-LOW", "low"))])


@query("res_02_explode_literals", "SELECT s_suppkey, unnest([0, 1, 2, 3]) AS salt FROM supplier")
def explode_literals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("salt"))
