"""Window functions over keys that may hold a large share of all rows.

A plain ``Window.partitionBy(key)`` sorts all rows of one key in one task. Here each key is cut into
*pieces* by an expression that never decreases along the ordering (a day of the time column, a band
of the sort value). The detail rows are windowed per (key, piece); what a piece needs to know about
earlier pieces is a handful of totals per piece, windowed per key on that small table and joined back.

Key and piece travel as columns that are never NULL (a filler value plus one column of NULL flags), so
rows with NULL keys keep their group, and the join back needs no NULL filter that would keep Spark from
using one shuffle for both branches. ``order`` lists ascending columns that together order rows totally.

One piece may still hold far too many rows (all trips of a zone on one day, all rows of one value).
``spread`` counts the rows per piece and cuts those above a row target again, along the full ordering;
the windows then also stitch ranks whose ties cross such a cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from tidemark.session import materialize

PIECE = ["_no_piece", "_piece"]
PART = "_part"  # where in a piece that was cut again a row lies
PIECE_ROWS = 1_000_000


def _filled(column: Column, kind: DataType) -> Column:
    if isinstance(kind, NumericType):
        filler = F.lit(0)
    elif isinstance(kind, BooleanType):
        filler = F.lit(False)
    elif isinstance(kind, StringType):
        filler = F.lit("")
    elif isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        filler = F.lit("1970-01-01")
    else:
        raise TypeError(f"cannot cut keys of type {kind.simpleString()}")
    return F.coalesce(column, filler.cast(kind))


def _placed(df: DataFrame, keys: Sequence[str], piece: Column) -> tuple[DataFrame, list[str]]:
    """Adds the group columns and the piece columns; returns the frame and the group column names."""
    kinds = [df.schema[k].dataType for k in keys]
    flags = sum((F.col(k).isNull().cast("int") * 2**i for i, k in enumerate(keys)), F.lit(0))
    group = {"_nulls": flags, **{f"_k{i}": _filled(F.col(k), kind) for i, (k, kind) in enumerate(zip(keys, kinds))}}
    kind = df.select(piece.alias("p")).schema["p"].dataType
    at = {PIECE[0]: piece.isNotNull().cast("int"), PIECE[1]: _filled(piece, kind)}
    return df.withColumns({**group, **at}), list(group)


def spread(df: DataFrame, keys: Sequence[str], piece: Column, order: Sequence[str], rows_per_piece: int = PIECE_ROWS) -> DataFrame:
    """Cuts pieces of more than ``rows_per_piece`` rows again: adds the column ``_part`` if there are any.

    Rows are counted per piece (a job, combined before its shuffle). Only rows of large pieces are written, and
    dealt in ranges of the full ordering; rows that are equal in it are told apart by where they were
    written, so that even one repeated row spreads. All other rows keep part 0. The list of large pieces has
    at most one row per ``rows_per_piece`` rows; Spark's size check decides whether it is broadcast.
    """
    rows, group = _placed(df, keys, piece)
    at = [*group, *PIECE]
    sizes = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_piece)
    large = materialize(sizes, "large-pieces")
    total = large.agg(F.sum("_n")).first()[0]
    if total is None:
        return df
    large = large.drop("_n")
    kept = materialize(rows.join(large, at, "left_semi"), "large-rows").withColumn("_at", F.monotonically_increasing_id())
    dealt = kept.repartitionByRange(-(-total // rows_per_piece) + 1, *at, *order, "_at").withColumn(PART, F.spark_partition_id())
    cut = materialize(dealt.select(*df.columns, PART), "cut-pieces")
    return rows.join(large, at, "left_anti").select(*df.columns, F.lit(0).alias(PART)).unionByName(cut)


def _part_of(df: DataFrame) -> list[str]:
    return [PART] if PART in df.columns else []


def pieces_of(df: DataFrame, keys: Sequence[str], piece: Column) -> DataFrame:
    """The distinct (group, piece) pairs of ``df``."""
    rows, group = _placed(df, keys, piece)
    return rows.select(*group, *PIECE).distinct()


def piecewise_windows(
    df: DataFrame,
    keys: Sequence[str],
    piece: Column,
    order: Sequence[str],
    *,
    row_number: str | None = None,
    rank_by: Sequence[str] = (),
    rank: str | None = None,
    dense_rank: str | None = None,
    running_sum: Mapping[str, str] | None = None,
    running_avg: Mapping[str, str] | None = None,
    prev: Mapping[str, str] | None = None,
    next: Mapping[str, str] | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """Add row numbers, ranks, running sums/averages and neighbour values. Mappings are name -> column.

    ``rank_by`` must be a prefix of ``order`` whose ties never cross a piece (those of ``spread`` may). ``only`` (from
    ``pieces_of``) limits the output to those pieces; the totals still cover all rows, but then
    only rows of the wanted pieces are shuffled and sorted (not if ranks of spread pieces are asked for).
    """
    running_sum, running_avg = dict(running_sum or {}), dict(running_avg or {})
    prev, next = dict(prev or {}), dict(next or {})
    summed = sorted(set(running_sum.values()) | set(running_avg.values()))
    counted = sorted(set(running_avg.values()))

    rows, group = _placed(df, keys, piece)
    at = [*group, *PIECE, *_part_of(df)]
    stitched = (rank_by or order) if _part_of(df) and (rank or dense_rank) else ()
    in_piece = Window.partitionBy(*at).orderBy(*order)
    so_far = in_piece.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tied = Window.partitionBy(*at).orderBy(*(rank_by or order))

    local = {"_rn": F.row_number().over(in_piece)}
    if rank or stitched:
        local["_rank"] = F.rank().over(tied)
    if dense_rank:
        local["_dense"] = F.dense_rank().over(tied)
    local |= {f"_sum_{c}": F.sum(c).over(so_far) for c in summed}
    local |= {f"_cnt_{c}": F.count(c).over(so_far) for c in counted}
    local |= {f"_prev_{n}": F.lag(c).over(in_piece) for n, c in prev.items()}
    local |= {f"_next_{n}": F.lead(c).over(in_piece) for n, c in next.items()}

    along = Window.partitionBy(*group).orderBy(*PIECE, *_part_of(df))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    offsets = [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.col("_n")]
    if dense_rank:
        new = F.col("_d") - F.col("_continues").cast("int") if stitched else F.col("_d")
        offsets.append(F.coalesce(F.sum(new).over(earlier), F.lit(0)).alias("_d0"))
    if stitched:
        offsets += ["_continues", F.lag("_run").over(along).alias("_run0")]
    offsets += [F.sum(f"_t_{c}").over(earlier).alias(f"_t0_{c}") for c in summed]
    offsets += [F.coalesce(F.sum(f"_c_{c}").over(earlier), F.lit(0)).alias(f"_c0_{c}") for c in counted]
    offsets += [F.lag(f"_last_{n}").over(along)["v"].alias(f"_edge_{n}") for n in prev]
    offsets += [F.lead(f"_first_{n}").over(along)["v"].alias(f"_edge_{n}") for n in next]

    if only is None or stitched:
        detail = rows.withColumns({**local, "_is_last": F.lead(F.lit(1)).over(in_piece).isNull()})
        totals = _totals_from_edges(detail, at, summed, counted, prev, next, bool(dense_rank), stitched)
        if stitched:
            totals = _runs_of_ties(totals, along)
        if only is not None:
            detail = detail.join(only, [*group, *PIECE], "left_semi")
    else:
        detail = rows.join(only, [*group, *PIECE], "left_semi").withColumns(local)
        totals = _totals_from_rows(rows, at, order, summed, counted, prev, next, rank_by if dense_rank else ())
    joined = detail.join(totals.select(*at, *offsets), at, "left")

    def total(column: str) -> Column:
        here, before = F.col(f"_sum_{column}"), F.col(f"_t0_{column}")
        return F.coalesce(here + before, here, before)

    def original(column: str) -> Column:
        """A key from its filled form, so that the shuffle carries it once."""
        if column not in keys:
            return F.col(column)
        i = list(keys).index(column)
        return F.when(F.col("_nulls").bitwiseAND(F.lit(2**i)) == 0, F.col(f"_k{i}")).alias(column)

    out: list[Column] = [original(c) for c in df.columns if c != PART]
    goes_on = F.col("_continues") if stitched else F.lit(False)
    if row_number:
        out.append((F.col("_rn") + F.col("_n0")).alias(row_number))
    if rank:
        here = F.col("_rank") + F.col("_n0")
        out.append((F.when(goes_on & (F.col("_rank") == 1), F.col("_run0")).otherwise(here) if stitched else here).alias(rank))
    if dense_rank:
        out.append((F.col("_dense") + F.col("_d0") - (goes_on.cast("int") if stitched else F.lit(0))).alias(dense_rank))
    out += [total(c).alias(n) for n, c in running_sum.items()]
    out += [(total(c) / (F.col(f"_cnt_{c}") + F.col(f"_c0_{c}"))).alias(n) for n, c in running_avg.items()]
    out += [F.when(F.col("_rn") == 1, F.col(f"_edge_{n}")).otherwise(F.col(f"_prev_{n}")).alias(n) for n in prev]
    out += [F.when(F.col("_rn") == F.col("_n"), F.col(f"_edge_{n}")).otherwise(F.col(f"_next_{n}")).alias(n) for n in next]
    return joined.select(*out)


def _totals_from_edges(
    detail: DataFrame, at: list[str], summed: list[str], counted: list[str], prev: Mapping, next: Mapping, dense: bool,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Totals of a piece from its first and last windowed row. The shuffle of the detail serves both
    branches when the frame holds no columns beyond those used here."""
    last, first = F.col("_is_last"), F.col("_rn") == 1
    aggs = [F.max(F.when(last, F.col("_rn"))).alias("_n")]
    if dense:
        aggs.append(F.max(F.when(last, F.col("_dense"))).alias("_d"))
    aggs += [F.max(F.when(last, F.col(f"_sum_{c}"))).alias(f"_t_{c}") for c in summed]
    aggs += [F.max(F.when(last, F.col(f"_cnt_{c}"))).alias(f"_c_{c}") for c in counted]
    aggs += [F.max(F.when(last, F.struct(F.col(c).alias("v")))).alias(f"_last_{n}") for n, c in prev.items()]
    aggs += [F.max(F.when(first, F.struct(F.col(c).alias("v")))).alias(f"_first_{n}") for n, c in next.items()]
    if ties:
        tie = F.struct(*ties)
        aggs += [F.max(F.when(first, tie)).alias("_first_tie"), F.max(F.when(last, tie)).alias("_last_tie")]
        aggs.append(F.max(F.when(last, F.col("_rank"))).alias("_last_rank"))
    return detail.filter(first | last).groupBy(*at).agg(*aggs)


def _runs_of_ties(totals: DataFrame, along: WindowSpec) -> DataFrame:
    """Adds whether a piece begins inside a run of ties (``_continues``) and the rank of the run it ends in (``_run``)."""
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    begun = totals.withColumns(
        {
            "_continues": F.col("_first_tie").eqNullSafe(F.lag("_last_tie").over(along)),
            "_starts": F.col("_last_rank") + F.coalesce(F.sum("_n").over(before), F.lit(0)),
        }
    )
    opens = F.when(~(F.col("_continues") & (F.col("_last_rank") == 1)), F.col("_starts"))
    return begun.withColumn("_run", F.last(opens, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))


def _totals_from_rows(
    rows: DataFrame, at: list[str], order: Sequence[str], summed: list[str], counted: list[str], prev: Mapping, next: Mapping,
    rank_by: Sequence[str],
) -> DataFrame:
    """Totals of a piece by map-side combined aggregation, without windowing its rows."""
    position = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("_n")]
    if rank_by:
        aggs.append(F.countDistinct(*rank_by).alias("_d"))
    aggs += [F.sum(c).alias(f"_t_{c}") for c in summed]
    aggs += [F.count(c).alias(f"_c_{c}") for c in counted]
    # the wrapping struct keeps a NULL value at the edge of a piece
    aggs += [F.max_by(F.struct(F.col(c).alias("v")), position).alias(f"_last_{n}") for n, c in prev.items()]
    aggs += [F.min_by(F.struct(F.col(c).alias("v")), position).alias(f"_first_{n}") for n, c in next.items()]
    return rows.groupBy(*at).agg(*aggs)


def piecewise_frame(
    df: DataFrame,
    keys: Sequence[str],
    piece: Column,
    order: Sequence[str],
    before: int,
    after: int,
    aggregates: Mapping[str, Column],
    only: DataFrame | None = None,
) -> DataFrame:
    """Aggregates over ``ROWS BETWEEN before PRECEDING AND after FOLLOWING``.

    Each piece is windowed together with a border: the last ``before`` rows ahead of it and the first
    ``after`` rows behind it. Border rows come from the edges of pieces only, so the per-key window
    that places them sees at most ``before + after`` rows per piece. ``only`` (from ``pieces_of``)
    limits the output, and the windows, to those pieces.
    """
    rows, group = _placed(df, keys, piece)
    place = [*PIECE, *_part_of(df)]
    at = [*group, *place]
    parts = [rows.withColumn("_border", F.lit(False))]
    for size, ascending in ((before, False), (after, True)):
        if size:
            parts.append(_border(rows, group, place, order, size, ascending))
    bordered = parts[0]
    for part in parts[1:]:
        bordered = bordered.unionByName(part)
    if only is not None:
        bordered = bordered.join(only, [*group, *PIECE], "left_semi")
    frame = Window.partitionBy(*at).orderBy(*order).rowsBetween(-before, after)
    computed = bordered.withColumns({name: agg.over(frame) for name, agg in aggregates.items()})
    return computed.filter(~F.col("_border")).select(*[c for c in df.columns if c != PART], *aggregates)


def _border(rows: DataFrame, group: list[str], place: list[str], order: Sequence[str], size: int, ascending: bool) -> DataFrame:
    """Rows that neighbouring pieces need: the first (ascending) or last ``size`` rows of every piece,
    re-labelled with each other piece that lies within ``size`` edge rows of them."""
    turn = F.asc if ascending else F.desc
    nearest = Window.partitionBy(*group, *place).orderBy(*[turn(c) for c in order])
    edge = rows.withColumn("_nth", F.row_number().over(nearest)).filter(F.col("_nth") <= size).drop("_nth")
    walk = Window.partitionBy(*group).orderBy(*place, *order)
    reach = walk.rowsBetween(-size, -1) if ascending else walk.rowsBetween(1, size)
    here = F.struct(*place)
    return (
        edge.withColumn("_near", F.collect_set(here).over(reach))
        .withColumn("_to", F.explode(F.array_except("_near", F.array(here))))
        .withColumns({c: F.col(f"_to.{c}") for c in place})
        .drop("_near", "_to")
        .withColumn("_border", F.lit(True))
    )


def stitched_sessions(
    df: DataFrame, user: str, ts: str, gap: str, measures: Mapping[str, tuple[str, Column]] | None = None, piece: Column | None = None,
    rows_per_piece: int = PIECE_ROWS,
) -> DataFrame:
    """Sessions split where a user is silent for longer than ``gap`` (strictly); ids start at 0.

    Sessions are first found per (user, piece), by default a day, large ones cut again (``spread``, which runs
    a job), reduced to one row each, and then stitched across pieces on those rows. ``measures`` maps
    an output name to ("sum" | "min" | "max", column).
    """
    measures = dict(measures or {})
    day = F.to_date(ts) if piece is None else piece
    day_rows = spread(df, [user], day, [ts], rows_per_piece).withColumn("_day", day)
    at = [user, "_day", *_part_of(day_rows)]
    in_day = Window.partitionBy(*at).orderBy(ts)
    starts = F.when(F.col(ts) > F.lag(ts).over(in_day) + F.expr(f"INTERVAL {gap}"), 1).otherwise(0)
    first = [F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.count(F.lit(1)).alias("_n")]
    first += [getattr(F, how)(col).alias(f"_m_{name}") for name, (how, col) in measures.items()]
    pieces = (
        day_rows.withColumn("_new", starts)
        .withColumn("_local", F.sum("_new").over(in_day))
        .groupBy(*at, "_local")
        .agg(*first)
    )
    along = Window.partitionBy(user).orderBy("_from", "_to")  # pieces that begin at one time: the longest comes last
    opens = F.when(F.col("_from") > F.lag("_to").over(along) + F.expr(f"INTERVAL {gap}"), 1).otherwise(0)
    second = [F.min("_from").alias("session_start"), F.max("_to").alias("session_end"), F.sum("_n").alias("event_count")]
    second += [getattr(F, how)(f"_m_{name}").alias(name) for name, (how, _) in measures.items()]
    return (
        pieces.withColumn("_open", opens)
        .withColumn("session_id", F.sum("_open").over(along))
        .groupBy(user, "session_id")
        .agg(*second)
    )
