"""Point-in-time features: trailing frames over events, range and as-of joins, availability, splits.

Frames are those of `frames`: running sums and maxima of marks, so that time grows with the rows and not with the frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import DAY, MICROS
from tidemark.functions.ranges import with_range
from tidemark.operators.frames import Frame, frames
from tidemark.operators.running import running


def over_frames(rows: DataFrame, by: Sequence[str], features: dict[str, Frame], *, id_: str = "event_id", t: str = "t") -> DataFrame:
    """(id_, features...) over the earlier rows of the key, [t - width, t), at each row's own time. Ids are unique."""
    known = rows.withColumns({"t": F.col(t), "available": F.col(t), "now": F.col(t)})
    return frames(known, known, by, features, id_=id_)


def available_counts(rows: DataFrame, widths: dict[str, int], *, key: str = "customer", id_: str = "event_id") -> DataFrame:
    """For each row, at T = its own availability: how many other rows of the key lie in [T - w, T) and were available by T."""
    known = rows.withColumn("now", F.col("available"))
    return frames(known, known, [key], {n: Frame("count", w) for n, w in widths.items()}, id_=id_)


def days_since(order: str, previous: Column) -> Column:
    """Fractional days since a time, -1 where there is none."""
    return F.coalesce((F.col(order) - previous) / float(DAY), F.lit(-1.0))


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, time: str, width: int, null_safe: bool = False) -> DataFrame:
    """left rows with the right rows of the same keys and 0 < left.at - right.time <= width.

    Both sides are dealt into time buckets of the width, the left one into two, so the join has an equality on key and
    bucket and never compares all rows of a key. Right columns must not clash with left ones.
    """
    bucket = F.floor(F.col(time) / width)
    r = right.withColumn("_bucket", bucket).select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_bucket", *[c for c in right.columns if c not in keys])
    here = F.floor(F.col(at) / width)
    l = left.withColumn("_own", F.explode(F.array(here - 1, here)))
    on = F.col("_own") == F.col("_bucket")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_r_{k}")) if null_safe else F.col(k) == F.col(f"_r_{k}")
    on &= (F.col(time) < F.col(at)) & (F.col(time) >= F.col(at) - width)
    return l.join(r, on).drop("_own", "_bucket", *[f"_r_{k}" for k in keys])


def latest_as_of(left: DataFrame, versions: DataFrame, key: str, at: str, available: str, version: str, values: Sequence[str]) -> DataFrame:
    """left with the values of the latest version available at or before `at`: the largest (available, version).

    Both sides are merged in the order of time by key, and the largest version so far is carried to the rows of left; repeated rows
    of left stay, and rows without a version get nulls.
    """
    best = F.struct(*dict.fromkeys([available, version, *values]))
    known = versions.select(F.col(key).alias("_key"), F.col(available).alias("_at"), F.lit(0).alias("_q"), best.alias("_best"))
    asked = left.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_q"), F.struct(*left.columns).alias("_row"))
    run = running(known.unionByName(asked, allowMissingColumns=True), ["_key"], ["_at", "_q"], {"_found": ("max", "_best")})
    return run.where("_q = 1").select("_row.*", *[F.col("_found")[v].alias(v) for v in values if v not in left.columns])


def running_max(rows: DataFrame, order: str, value: str, out: str, *, id_: str) -> DataFrame:
    """(id_, out): the largest value over all rows at or before each row's time, the row and equal times included; in ranges of time."""
    ranged = with_range(rows.select(F.col(id_), F.col(order).alias("_at"), F.col(value).alias("_x")), ["_at"])  # equal times share a range
    most = ranged.groupBy(F.col("_range").alias("_r")).agg(F.max("_x").alias("_m"))
    before = most.select("_r", F.max("_m").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row for each range
    inside = F.max("_x").over(Window.partitionBy("_range").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    both = ranged.withColumn("_in", inside).join(F.broadcast(before), F.col("_range") == F.col("_r"), "left")  # as in global_rank
    return both.select(id_, F.greatest("_in", "_before").alias(out))


def assign_interval(at: Column, intervals: Sequence[tuple[str, int, int]], otherwise: str | None = None) -> Column:
    """The name of the first [start, end) that holds the time."""
    out = None
    for name, start, end in intervals:
        inside = (at >= start) & (at < end)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return (out if out is not None else F.lit(None)).otherwise(otherwise) if intervals else F.lit(otherwise)


def temporal_split(at: Column, train_end: int, validation_end: int, gap: int) -> Column:
    """train, validation or test; null in the gaps before the later parts, where labels are not mature."""
    return F.when(at < train_end - gap, "train").when((at >= train_end) & (at < validation_end - gap), "validation").when(at >= validation_end, "test")


__all__ = ["DAY", "MICROS", "assign_interval", "available_counts", "days_since", "latest_as_of", "over_frames", "range_join", "running_max", "temporal_split"]
