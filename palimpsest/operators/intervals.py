"""Merged validity periods and the gaps between them.

Native session windows with a row-specific duration merge overlapping intervals; touching periods are joined
afterwards and the gaps come from ``lead``. All of it works on (key, time slice) groups that are stitched through one
small summary row each, so that a key holding a third of all rows is spread over its slices.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import materialize

#: Stands for an open end while intervals are merged.
OPEN_END = "9999-12-31 00:00:00"


def _merge(df: DataFrame, keys: list[str]) -> DataFrame:
    gap = F.concat((F.unix_micros("_to") - F.unix_micros("_from")).cast("string"), F.lit(" microseconds"))
    merged = df.groupBy(*keys, F.session_window("_from", gap).alias("_w")).agg(F.count(F.lit(1)).alias("_n"))
    return merged.select(*keys, F.col("_w.start").alias("_from"), F.col("_w.end").alias("_to"))


def _stitched(df: DataFrame, keys: list[str], start: str, end: str, slice_days: int) -> DataFrame:
    """(_k0.., _from, _to, _next): merged periods and the start of the next one, with OPEN_END for open ends.

    Intervals are merged inside (key, slice of their start). One summary row per key and slice then tells how far the
    slices before reach, which periods of a slice are fresh (start after that) and how far the last fresh one is carried
    on by later slices. So no task ever holds more than one slice of a key, or the summary rows of one.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    far = F.lit(OPEN_END).cast("timestamp")
    rows = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)],
        F.col(start).cast("timestamp").alias("_from"),
        F.coalesce(F.col(end).cast("timestamp"), far).alias("_to"),
    ).where(F.col("_from").isNotNull() & (F.col("_to") > F.col("_from")))
    part = [*names, "_slice"]
    sliced = rows.withColumn("_slice", F.floor(F.unix_seconds("_from") / F.lit(86400 * slice_days)))
    in_slice = Window.partitionBy(*part).orderBy("_from", "_to")
    new = F.when(F.lag("_to").over(in_slice) >= F.col("_from"), F.lit(0)).otherwise(F.lit(1))
    islands = _merge(sliced, part).withColumn("_new", new).withColumn("_island", F.sum("_new").over(in_slice.rowsBetween(Window.unboundedPreceding, 0)))
    periods = materialize(islands.groupBy(*part, "_island").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to")).drop("_island"), "periods")
    by_key = Window.partitionBy(*names).orderBy("_slice")

    def joined(summary: DataFrame, *columns: str) -> Callable[[DataFrame], DataFrame]:
        other = summary.select(*[F.col(c).alias(f"s{c}") for c in part], *columns)
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"s{c}")) for c in part])
        return lambda left: left.join(other, same).drop(*[f"s{c}" for c in part])

    reach = periods.groupBy(*part).agg(F.max("_to").alias("_reach"))
    reach = reach.withColumn("_carry", F.max("_reach").over(by_key.rowsBetween(Window.unboundedPreceding, -1)))
    marked = periods.transform(joined(reach, "_carry")).withColumn("_fresh", F.coalesce(F.col("_from") > F.col("_carry"), F.lit(True)))
    tail = marked.groupBy(*part).agg(
        F.max(F.when(~F.col("_fresh"), F.col("_to"))).alias("_absorbed"), F.min(F.when(F.col("_fresh"), F.col("_from"))).alias("_first"), F.max(F.when(F.col("_fresh"), F.col("_from"))).alias("_last")
    )
    # slices after a fresh one, up to the next fresh one, carry on its last period
    tail = tail.withColumn("_run", F.count("_first").over(by_key.rowsBetween(Window.unboundedPreceding, -1)))
    tail = tail.withColumn("_carried", F.max("_absorbed").over(Window.partitionBy(*names, "_run")))
    tail = tail.withColumn("_carried", F.lead("_carried").over(by_key)).withColumn("_after", F.first("_first", ignorenulls=True).over(by_key.rowsBetween(1, Window.unboundedFollowing)))
    fresh = marked.where("_fresh").select(*part, "_from", "_to").transform(joined(tail.where(F.col("_first").isNotNull()), "_last", "_carried", "_after"))
    last = F.col("_from") == F.col("_last")
    to = F.when(last, F.greatest("_to", "_carried")).otherwise(F.col("_to"))
    return fresh.withColumn("_next", F.when(last, F.col("_after")).otherwise(F.lead("_from").over(Window.partitionBy(*part).orderBy("_from")))).select(*names, "_from", to.alias("_to"), "_next")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, slice_days: int = 90) -> DataFrame:
    """Longest periods [period_from, period_to) that the intervals [start, end) of each key cover without a break.

    Rows whose start is null, or whose end is not null and not later than the start, do not count. A null end is an
    open end; the result has null there too. Null key values form a key of their own. Repeated rows change nothing.
    Columns of the input other than keys, start and end are ignored, whatever their names. An empty input gives an
    empty result.
    """
    far = F.lit(OPEN_END).cast("timestamp")
    return _stitched(df, keys, start, end, slice_days).select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)],
        F.col("_from").alias("period_from"),
        F.when(F.col("_to") < far, F.col("_to")).alias("period_to"),
    )


def period_gaps(periods: DataFrame, keys: list[str]) -> DataFrame:
    """Holes [gap_from, gap_to) between successive periods of a key, from the result of merge_intervals.

    A key with one period, or whose last period is open, has no gap after it.
    """
    w = Window.partitionBy(*keys).orderBy("period_from")
    return periods.select(
        *keys, F.col("period_to").alias("gap_from"), F.lead("period_from").over(w).alias("gap_to")
    ).where(F.col("gap_to").isNotNull())


def _secs(c: str) -> Column:
    return F.coalesce(F.unix_seconds(c), F.lit(-1))


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, slice_days: int = 90) -> DataFrame:
    """Rows (keys, piece, from_s, to_s): every period and gap, in seconds since 1970 (-1: open end)."""
    names = [f"_k{i}" for i in range(len(keys))]
    far = F.lit(OPEN_END).cast("timestamp")
    periods = _stitched(df, keys, start, end, slice_days).withColumn("_to", F.when(F.col("_to") < far, F.col("_to")))
    both = periods.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)],
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("period").alias("piece"), _secs("_from").alias("from_s"), _secs("_to").alias("to_s")),
                    F.struct(F.lit("gap").alias("piece"), _secs("_to").alias("from_s"), _secs("_next").alias("to_s")),
                ),
                lambda x: (x["piece"] == "period") | (x["to_s"] != -1),
            )
        ).alias("_x"),
    )
    return both.select(*keys, "_x.piece", "_x.from_s", "_x.to_s")
