"""Running sums, maxima and previous values by key, in time proportional to the rows, with hot keys cut into ranges.

A window over a key runs in one task. A key with more than PART_ROWS rows, and more than a HOT_SHARE of all, is cut by
quantiles of its first order column into parts of about that size; each part is a window of its own, to which the total of the
parts before it is carried. Equal values of the first order column stay in one part.

Null keys are a key of their own. Nulls in summed or compared columns are passed over. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import let

#: Rows of a part, the share of all rows that a key must have to be cut, and the most parts of a key.
PART_ROWS, HOT_SHARE, PARTS = 1_000_000, 1e-4, 1024


def find_cuts(rows: DataFrame, by: Sequence[str], order: str, at_most: int | None = None) -> DataFrame | None:
    """(_hot0.., _bounds): the keys to be cut and where; None if there are none, which is found out now, by counts of the keys.

    At most 1 / HOT_SHARE keys are hot, and their parts number at most twice that together, which bounds what comes to the driver.
    at_most: a bound of the number of rows, where one is known; rows are counted otherwise.
    """
    if at_most is not None and at_most <= PART_ROWS:
        return None
    keys = [F.col(c).alias(f"_hot{k}") for k, c in enumerate(by)]
    per = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > PART_ROWS)
    found = per.collect()  # the one pass over the rows, where no key is large
    if not found:
        return None
    most = max(PART_ROWS, int((rows.count() if at_most is None else at_most) * HOT_SHARE))
    if not (found := [r for r in found if r["_n"] > most]):
        return None
    hot = rows.sparkSession.createDataFrame(found, per.schema)
    at = F.percentile_approx(order, F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)]), F.lit(10 * PARTS))
    placed = rows.select(*by, order).join(F.broadcast(hot), _same(by, "_hot")).groupBy(*hot.columns[:-1]).agg(at.alias("_q"), F.first("_n").alias("_n"))
    parts = F.least(F.lit(PARTS), F.ceil(F.col("_n") / F.lit(most))).cast("int")
    bounds = F.array_distinct(F.transform(F.sequence(F.lit(1), parts - 1), lambda k: F.get("_q", F.floor(k * PARTS / parts).cast("int") - 1)))
    cut = placed.where(parts > 1).select(*hot.columns[:-1], bounds.alias("_bounds"))
    return rows.sparkSession.createDataFrame(cut.collect(), cut.schema)


def _same(by: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{prefix}{k}")) for k, c in enumerate(by)])


def cut_keys(rows: DataFrame, by: Sequence[str], order: str, at_most: int | None = None, cuts: DataFrame | str | None = "find") -> tuple[DataFrame, bool]:
    """rows with _part, which grows with `order` within a key that is cut and is null for others, and whether any key is cut."""
    found = find_cuts(rows, by, order, at_most) if isinstance(cuts, str) else cuts
    if found is None:
        return rows.withColumn("_part", F.lit(None).cast("int")), False
    part = let(F.col(order), lambda at: F.size(F.filter("_bounds", lambda b: b < at)))
    return rows.join(F.broadcast(found), _same(by, "_hot"), "left").withColumn("_part", F.when(F.col("_bounds").isNotNull(), part)).select(*rows.columns, "_part"), True


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], columns: dict[str, tuple[str, str]], at_most: int | None = None, cuts: DataFrame | str | None = "find") -> DataFrame:
    """rows with columns: name -> (kind, column), over the rows of the key up to and with the row itself, in the given order.

    Kinds: sum, max (of anything that has an order), max_before (without the row itself) and previous (the value of the row
    before). sum and max of rows that are equal in the order are only determined after the last of them.
    cuts: what find_cuts found for rows with the same keys and order; None if no key is to be cut.
    """
    cut, parted = cut_keys(rows, by, order[0], at_most, cuts)
    ordered = (Window.partitionBy(*by, "_part") if parted else Window.partitionBy(*by)).orderBy(*order)
    here, before = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(Window.unboundedPreceding, -1)

    def own(kind: str, column: str) -> Column:
        if kind == "sum":
            return F.sum(column).over(here)
        if kind == "previous":
            return F.lag(F.struct(column)).over(ordered)
        return F.max(column).over(here if kind == "max" else before)

    out = cut.withColumns({n: own(*c) for n, c in columns.items()})
    if parted:
        whole = {"sum": F.sum, "max": F.max, "max_before": F.max, "previous": lambda c: F.max_by(F.struct(c), F.struct(*order))}
        totals = cut.where("_part is not null").groupBy(*by, "_part").agg(*[whole[k](c).alias(f"_t_{n}") for n, (k, c) in columns.items()])
        earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carry = {"sum": F.sum, "max": F.max, "max_before": F.max, "previous": lambda c: F.last(c, ignorenulls=True)}
        carried = totals.withColumns({f"_c_{n}": carry[k](f"_t_{n}").over(earlier) for n, (k, _) in columns.items()}).where("_part > 0")
        carried = carried.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_part").alias("_p"), *[f"_c_{n}" for n in columns])
        same = _same(by, "_by") & (F.col("_part") == F.col("_p"))
        out = out.join(F.broadcast(carried), same, "left")

        def joined(name: str, kind: str) -> Column:
            mine, theirs = F.col(name), F.col(f"_c_{name}")
            if kind == "sum":
                return F.when(theirs.isNull(), mine).when(mine.isNull(), theirs).otherwise(mine + theirs)
            return F.coalesce(mine, theirs) if kind == "previous" else F.greatest(mine, theirs)

        out = out.withColumns({n: joined(n, k) for n, (k, _) in columns.items()})
    out = out.withColumns({n: F.col(n)[c] for n, (k, c) in columns.items() if k == "previous"})
    return out.select(*rows.columns, *columns)
