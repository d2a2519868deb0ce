"""Trailing frames over rows that become known later than they happen, in time proportional to the rows.

A row that happens at t and is available at a is visible to a frame of width w at the time T where t < T <= t + w and a <= T:
from max(a, t + 1) to t + w. So a count or sum over a frame is a running sum of marks, plus where a row becomes visible and
minus where it stops. Distinct values are counted by their first row that becomes visible and their last that stops. A maximum is
taken in cells of the frame's width: a row is visible to the end of one cell and from the start of the next, so two running
maxima find it; rows that are visible within one cell only are dealt on a second grid, and the few that are late by more than
half a frame are joined by time bucket. Nothing is read again for each row, and hot keys are cut as in `running`.

A row is never in its own frame: what has the same id is left out. Null keys equal null keys. Null values are no values.
Repeated ids are not allowed. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shipping import stored
from tidemark.operators import running

MONEY = "decimal(20,6)"


@dataclass(frozen=True)
class Frame:
    """kind: count, sum, distinct, seen (the row's own value is in the frame) or max; width None: all history."""

    kind: str
    width: int | None = None
    value: str | None = None


def _start(t: str = "t", available: str = "available") -> Column:
    return F.greatest(F.col(available), F.col(t) + 1)


def _visible(width: int | None) -> Column:
    """Whether a row becomes visible at all."""
    return F.lit(True) if width is None else _start() <= F.col("t") + width


def _own_visible(width: int | None) -> Column:
    """Whether a query's own row is in its frame; false where the query is no row itself."""
    inside = (F.col("own_start") <= F.col("at")) & (F.lit(True) if width is None else F.col("at") <= F.col("own_t") + width)
    return F.coalesce(inside, F.lit(False))


def frames(values: DataFrame, queries: DataFrame, by: Sequence[str], features: dict[str, Frame], *, id_: str) -> DataFrame:
    """(id_, features...) for each query.

    values: by..., id_, t, available (both in microseconds) and value columns. queries: by..., id_, now, the columns of `seen`
    features, and where a query is a row of values too, its t, available and value columns. Sums are decimals, 0 when empty;
    maxima are null when empty.
    """
    out, weight = None, 2 + len({f.width for f in features.values()})
    many = 4 * queries.count() + weight * values.count()  # no fewer than any table of marks has
    # A key's marks are no more than this either, so one look at the keys may spare a look at each table of marks.
    cuts = "find" if many > running.PART_ROWS and _any_hot(values, queries, by, weight, many) else None
    additive = {n: f for n, f in features.items() if f.kind in ("count", "sum")}
    parts = [_additive(values, queries, by, additive, id_, many, cuts)] if additive else []
    for value in dict.fromkeys(f.value for f in features.values() if f.kind in ("distinct", "seen")):
        parts.append(_distinct(values, queries, by, value, {n: f for n, f in features.items() if f.value == value and f.kind in ("distinct", "seen")}, id_, many, cuts))
    parts += [_max(values, queries, by, n, f, id_, many, cuts) for n, f in features.items() if f.kind == "max"]
    if many > running.PART_ROWS and len(parts) > 1:
        parts = [stored(part, "frames") for part in parts]  # one plan of them all takes the driver longer than the rows take
    for part in parts:
        out = part if out is None else out.join(part, id_)
    return out.select(id_, *features)


def _any_hot(values: DataFrame, queries: DataFrame, by: Sequence[str], weight: int, many: int) -> bool:
    """Whether a key may have enough marks to be cut."""
    sizes = values.select(*by, F.lit(weight).alias("_w")).unionByName(queries.select(*by, F.lit(4).alias("_w"))).groupBy(*by).agg(F.sum("_w").alias("_n"))
    return bool(sizes.where(F.col("_n") > running.PART_ROWS).limit(1).count())


def _queries(queries: DataFrame, by: Sequence[str], keep: Sequence[str], id_: str) -> DataFrame:
    own = "t" in queries.columns
    t, start = (F.col("t"), _start()) if own else (F.lit(None).cast("long"), F.lit(None).cast("long"))
    return queries.select(*by, F.col(id_).alias("id"), F.col("now").alias("at"), F.lit(1).alias("q"), t.alias("own_t"), start.alias("own_start"), *[(F.col(c) if c in queries.columns else F.lit(None)).alias(f"own_{c}") for c in keep])


def _additive(values: DataFrame, queries: DataFrame, by: Sequence[str], features: dict[str, Frame], id_: str, many: int, cuts: str | None) -> DataFrame:
    amounts = {n: F.lit(1).cast("long") if f.kind == "count" else F.coalesce(F.col(f.value).cast(MONEY), F.lit(0).cast(MONEY)) for n, f in features.items()}
    zero = {n: F.lit(0).cast("long") if f.kind == "count" else F.lit(0).cast(MONEY) for n, f in features.items()}
    mark = lambda at, chosen: F.struct(at.alias("at"), *[chosen(n, f).alias(n) for n, f in features.items()])
    marks = [mark(_start(), lambda n, f: F.when(_visible(f.width), amounts[n]).otherwise(zero[n]))]
    for w in sorted({f.width for f in features.values() if f.width is not None}):
        marks.append(F.when(_visible(w), mark(F.col("t") + w + 1, lambda n, f, w=w: -amounts[n] if f.width == w else zero[n])))
    given = values.select(*by, F.explode(F.array_compact(F.array(*marks))).alias("m")).select(*by, F.lit(0).alias("q"), "m.*")
    asked = _queries(queries, by, list(dict.fromkeys(f.value for f in features.values() if f.value)), id_).withColumns(zero)
    run = running.running(given.unionByName(asked, allowMissingColumns=True), by, ["at", "q"], {f"_{n}": ("sum", n) for n in features}, many, cuts)
    own = {n: F.lit(1).cast("long") if f.kind == "count" else F.coalesce(F.col(f"own_{f.value}").cast(MONEY), zero[n]) for n, f in features.items()}
    return run.where("q = 1").select(F.col("id").alias(id_), *[(F.col(f"_{n}") - F.when(_own_visible(f.width), own[n]).otherwise(zero[n])).alias(n) for n, f in features.items()])


def _distinct(values: DataFrame, queries: DataFrame, by: Sequence[str], value: str, features: dict[str, Frame], id_: str, many: int, cuts: str | None) -> DataFrame:
    widths = list(dict.fromkeys(f.width for f in features.values()))
    mark = lambda at, chosen: F.struct(at.alias("at"), *[chosen(w).cast("long").alias(f"d{k}") for k, w in enumerate(widths)])
    marks = [mark(_start(), lambda w: F.when(_visible(w), 1).otherwise(0))]
    marks += [F.when(_visible(w), mark(F.col("t") + w + 1, lambda x, w=w: F.lit(-1 if x == w else 0))) for w in widths if w is not None]
    given = values.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"), F.explode(F.array_compact(F.array(*marks))).alias("m")).select(*by, "v", F.lit(0).alias("q"), "m.*")
    asked = _queries(queries, by, [value], id_).withColumnRenamed(f"own_{value}", "v").withColumns({f"d{k}": F.lit(0).cast("long") for k in range(len(widths))})
    # How many visible rows have the value; a value comes into the frame where this leaves 0, and goes where it comes back to 0.
    marked = given.unionByName(asked, allowMissingColumns=True)
    of_value = running.running(marked, [*by, "v"], ["at", "q"], {f"c{k}": ("sum", f"d{k}") for k in range(len(widths))}, many, cuts)
    turns = {f"e{k}": (F.col(f"c{k}") > 0).cast("long") - (F.col(f"c{k}") - F.col(f"d{k}") > 0).cast("long") for k in range(len(widths))}
    run = of_value.withColumns(turns)
    if any(f.kind == "distinct" for f in features.values()):
        found = cuts and running.find_cuts(marked, by, "at", many)  # of the same rows before their columns
        run = running.running(run, by, ["at", "q"], {f"n{k}": ("sum", f"e{k}") for k in range(len(widths))}, many, found)

    def result(f: Frame) -> Column:
        k = widths.index(f.width)
        own = _own_visible(f.width) & F.col("v").isNotNull()
        if f.kind == "seen":
            return F.col("v").isNotNull() & (F.col(f"c{k}") - own.cast("long") > 0)
        return F.col(f"n{k}") - (own & (F.col(f"c{k}") == 1)).cast("long")

    return run.where("q = 1").select(F.col("id").alias(id_), *[result(f).alias(n) for n, f in features.items()])


def _max(values: DataFrame, queries: DataFrame, by: Sequence[str], name: str, f: Frame, id_: str, many: int, cuts: str | None) -> DataFrame:
    w, start, end = f.width, _start(), F.col("t") + (f.width or 0)
    place = lambda grid, cell, falling, o: F.struct(F.lit(grid).alias("grid"), cell.cast("long").alias("cell"), F.lit(falling).alias("falling"), o.alias("o"))
    cell = lambda at, grid: F.floor((at + (w // 2) * grid) / F.lit(w)) if w else F.lit(0)
    top = F.struct(F.col(f.value).alias("x"), F.col(id_).alias("i"))
    known = values.where(F.col(f.value).isNotNull())
    if w is None:
        places, spots = F.array(place(0, F.lit(0), False, start)), lambda at: F.array(place(0, F.lit(0), False, at))
    else:
        known = known.where(_visible(w))
        crossing = lambda grid: F.array(place(grid, cell(start, grid), False, start), place(grid, cell(end, grid), True, -end))
        places = F.when(cell(start, 0) != cell(end, 0), crossing(0)).when(cell(start, 1) != cell(end, 1), crossing(1))
        spots = lambda at: F.array(*[place(g, cell(at, g), falling, -at if falling else at) for g in (0, 1) for falling in (False, True)])
    given = known.select(*by, top.alias("top"), F.explode(places).alias("p")).select(*by, "p.*", F.lit(0).alias("q"), "top")
    asked = queries.select(*by, F.col(id_).alias("id"), F.explode(spots(F.col("now"))).alias("p")).select(*by, "id", "p.*", F.lit(1).alias("q"))
    keys, order = [*by, "grid", "cell", "falling"], ["o", "q"]
    marked = given.unionByName(asked, allowMissingColumns=True)
    found = cuts and running.find_cuts(marked, keys, "o", many)
    run = running.running(marked, keys, order, {"m1": ("max", "top"), "b1": ("max_before", "top")}, many, found)
    # The second largest so far: what was largest before a larger one came, or came after a larger one.
    run = run.withColumn("second", F.when((F.col("q") == 0) & F.col("b1").isNotNull(), F.least("top", "b1")))
    run = running.running(run, keys, order, {"m2": ("max", "second")}, many, found)
    best = F.when(F.col("m1")["i"] == F.col("id"), F.col("m2")["x"]).otherwise(F.col("m1")["x"])
    out = run.where("q = 1").groupBy("id").agg(F.max(best).alias(name))
    if w is not None and (values.agg(F.max(F.col("available") - F.col("t"))).first()[0] or 0) > w // 2:
        late = known.where(places.isNull()).select(*[F.col(c).alias(f"late_{k}") for k, c in enumerate(by)], start.alias("s"), end.alias("e"), top.alias("late"))
        bucket = late.withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / w), F.floor(F.col("e") / w))))
        on = F.floor(F.col("now") / w) == F.col("b")
        for k, c in enumerate(by):
            on &= F.col(c).eqNullSafe(F.col(f"late_{k}"))
        hit = queries.join(bucket, on & F.col("now").between(F.col("s"), F.col("e")) & (F.col("late")["i"] != F.col(id_)))
        more = hit.groupBy(F.col(id_).alias("id")).agg(F.max(F.col("late")["x"]).alias("_late"))
        out = out.join(more, "id", "left").select("id", F.greatest(name, "_late").alias(name))
    return out.withColumnRenamed("id", id_)
