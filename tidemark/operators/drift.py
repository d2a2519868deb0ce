"""Drift between two windows of a table: PSI, Wasserstein, Jensen-Shannon, rates and the report of alerts.

Numeric columns are binned by exact quantiles of the reference; only bin edges and distinct categories stay after the
first aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evaluation import running_totals

BINS, SMOOTHING, ALIGN = 10, 1e-6, 101
#: From which value on a metric raises an alert.
THRESHOLDS = {"psi": 0.20, "wasserstein": 0.10, "js": 0.10, "missing_rate": 0.05, "duplicate_rate": 0.05, "prevalence": 0.05}
MIN_ROWS = 30


def quantiles(rows: DataFrame, value: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles, linear between neighbouring values; [] if there is no value.

    Values are counted first and their running number is found by ranges, so no task holds all of them.
    """
    per = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    run = running_totals(per, "_v", {"_upto": "_n"})
    total = per.agg(F.sum("_n")).first()[0]
    if not total:
        return []
    places = sorted({p for q in shares for p in (math.floor((total - 1) * q), math.ceil((total - 1) * q))})
    wanted = F.explode(F.array(*[F.lit(p).cast("long") for p in places]))
    hit = run.select("_v", "_n", "_upto", wanted.alias("_p")).where((F.col("_upto") > F.col("_p")) & (F.col("_upto") - F.col("_n") <= F.col("_p")))
    at = {r["_p"]: float(r["_v"]) for r in hit.select("_p", "_v").collect()}  # a row for each place
    spot = [(total - 1) * q for q in shares]
    return [at[math.floor(s)] + (s - math.floor(s)) * (at[math.ceil(s)] - at[math.floor(s)]) for s in spot]


def bin_edges(reference: DataFrame, value: str, bins: int = BINS) -> list[float]:
    """Inner edges: the distinct interpolated quantiles of the reference."""
    return sorted(set(quantiles(reference, value, [k / bins for k in range(1, bins)])))


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """The number of edges at or below the value; values outside go to the first and last bin."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value)) if edges else F.lit(0)


def _shares(rows: DataFrame, side: str, key: Column) -> DataFrame:
    """(key, r, c): smoothed shares of each key in the reference (side 0) and in the current rows (side 1)."""
    counts = rows.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.sum((F.col(side) == 0).cast("long")).alias("_r"), F.sum((F.col(side) == 1).cast("long")).alias("_c"))
    return counts.select("key", (F.col("_r") / counts.agg(F.sum("_r")).scalar()).alias("r"), (F.col("_c") / counts.agg(F.sum("_c")).scalar()).alias("c"))


def psi(rows: DataFrame, value: str, side: str, bins: int = BINS) -> DataFrame:
    """One row, psi: the sum over bins of (c - r) ln(c / r), each share smoothed by SMOOTHING; empty bins count."""
    edges = bin_edges(rows.where(F.col(side) == 0), value, bins)
    spark = rows.sparkSession
    every = spark.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    shares = every.join(F.broadcast(_shares(rows, side, F.when(F.col(value).isNotNull(), bin_of(F.col(value), edges)))), F.col("bin") == F.col("key"), "left")
    r, c = F.coalesce("r", F.lit(0.0)) + SMOOTHING, F.coalesce("c", F.lit(0.0)) + SMOOTHING
    return shares.agg(F.sum((c - r) * F.log(c / r)).alias("psi"))


def jensen_shannon(rows: DataFrame, category: str, side: str) -> DataFrame:
    """One row, js: half the divergences from the mean law, natural logarithm."""
    shares = _shares(rows, side, F.col(category))
    m = (F.col("r") + F.col("c")) / 2
    part = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    return shares.agg((F.sum(part(F.col("r"))) / 2 + F.sum(part(F.col("c"))) / 2).alias("js"))


def wasserstein(rows: DataFrame, value: str, side: str, points: int = ALIGN) -> DataFrame:
    """One row, wasserstein: the mean distance of `points` interpolated quantiles of both sides."""
    shares = [k / (points - 1) for k in range(points)]
    a, b = (quantiles(rows.where(F.col(side) == s), value, shares) for s in (0, 1))
    distance = sum(abs(x - y) for x, y in zip(a, b, strict=True)) / points if a and b else None
    return rows.sparkSession.createDataFrame([(distance,)], "wasserstein double")


def rates(rows: DataFrame, side: str, value: str, id_: str) -> DataFrame:
    """Per side: rows, missing rate of a column and duplicate rate of the id."""
    return rows.groupBy(side).agg(F.count("*").alias("n"), F.avg(F.col(value).isNull().cast("double")).alias("missing_rate"), (1 - F.count_distinct(id_) / F.count("*")).alias("duplicate_rate"))


def report(rows: DataFrame, side: str, numeric: Sequence[str], categorical: Sequence[str], id_: str | None = None, label: Column | None = None) -> DataFrame:
    """(field, metric, value, alert): alert where the value reaches the metric's threshold and both sides have MIN_ROWS rows.

    Besides the distances: how far the missing rate of each field moved, and with id_ and label the duplicate rate and prevalence.
    """
    parts = [psi(rows, f, side).select(F.lit(f).alias("field"), F.lit("psi").alias("metric"), F.col("psi").alias("value")) for f in numeric]
    parts += [wasserstein(rows, f, side).select(F.lit(f).alias("field"), F.lit("wasserstein").alias("metric"), F.col("wasserstein").alias("value")) for f in numeric]
    parts += [jensen_shannon(rows, f, side).select(F.lit(f).alias("field"), F.lit("js").alias("metric"), F.col("js").alias("value")) for f in categorical]
    shares = {(f, "missing_rate"): F.avg(F.col(f).isNull().cast("double")) for f in (*numeric, *categorical)}
    shares |= {(id_, "duplicate_rate"): 1 - F.count_distinct(id_) / F.count("*")} if id_ else {}
    shares |= {("label", "prevalence"): F.avg(label.cast("double"))} if label is not None else {}
    moved = rows.groupBy(F.col(side).alias("_s")).agg(*[c.alias(f"_{k}") for k, c in enumerate(shares.values())])
    delta = lambda k: F.abs(F.max(F.when(F.col("_s") == 1, F.col(f"_{k}"))) - F.max(F.when(F.col("_s") == 0, F.col(f"_{k}"))))
    wide = moved.agg(*[delta(k).alias(f"_{k}") for k in range(len(shares))])
    parts.append(wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(m).alias("metric"), F.col(f"_{k}").alias("value")) for k, (f, m) in enumerate(shares)])).alias("x")).select("x.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    least = rows.agg(F.least(F.sum((F.col(side) == 0).cast("long")), F.sum((F.col(side) == 1).cast("long")))).scalar()
    limit = F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv])[F.col("metric")]
    return out.select("field", "metric", "value", ((least >= MIN_ROWS) & (F.col("value") >= limit)).alias("alert"))


def nearest_rank(rows: DataFrame, value: str, quantiles: Sequence[float]) -> DataFrame:
    """(q, value): the value at position round((n - 1) q), halves to even, of the sorted values.

    Values are counted first; the running sum is over distinct values, by ranges.
    """
    per = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    run = running_totals(per, value, {"_upto": "_n"})
    wanted = rows.sparkSession.createDataFrame([(float(q),) for q in quantiles], "q double")
    wanted = wanted.select("q", F.bround((per.agg(F.sum("_n")).scalar() - 1) * F.col("q")).cast("long").alias("_at"))
    hit = run.join(F.broadcast(wanted), (F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at")))
    return hit.groupBy("q").agg(F.min(value).alias("value"))
