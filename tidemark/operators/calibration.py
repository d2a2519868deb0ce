"""Calibration: summaries of a reference table, sampling from them, and how close a simulated table comes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import hash_uniform
from tidemark.operators.drift import nearest_rank
from tidemark.operators.evaluation import running_totals


def bad_values(df: DataFrame, numeric: Sequence[str] = (), positive: Sequence[str] = (), text: Sequence[str] = ()) -> DataFrame:
    """(column, bad): nulls, values that are not finite, not above 0 or empty, by column, in one pass."""
    finite = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    rules = {c: finite(c) for c in numeric} | {c: finite(c) | (F.col(c) <= 0) for c in positive} | {c: F.col(c).isNull() | (F.length(c) == 0) for c in text}
    sums = df.agg(*[F.coalesce(F.sum(r.cast("long")), F.lit(0)).alias(c) for c, r in rules.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bad")) for c in rules])).alias("x")).select("x.*")


def load_reference(df: DataFrame, required: dict[str, T.DataType], optional: Sequence[str] = ()) -> DataFrame:
    """The reference with exactly the known columns; ValueError for a missing, unknown or wrongly typed one."""
    have = {f.name: f.dataType for f in df.schema}
    missing, unknown = set(required) - set(have), set(have) - set(required) - set(optional)
    if missing or unknown:
        raise ValueError(f"missing columns {sorted(missing)}, unknown columns {sorted(unknown)}")
    wrong = [c for c, t in required.items() if have[c] != t]
    if wrong:
        raise ValueError(f"columns of another type: {wrong}")
    return df


def category_weights(df: DataFrame, category: str, given: Sequence[str] = ()) -> DataFrame:
    """(given..., value, weight): shares of the categories, within each combination of the given columns."""
    per = df.where(F.col(category).isNotNull()).groupBy(*given, F.col(category).alias("value")).agg(F.count("*").alias("_n"))
    total = per.groupBy(*given).agg(F.sum("_n").alias("_t"))
    both = per.join(total, list(given)) if given else per.withColumn("_t", total.scalar())
    return both.select(*given, "value", (F.col("_n") / F.col("_t")).alias("weight"))


def zero_filled(df: DataFrame, column: str, vocabulary: Sequence[str]) -> DataFrame:
    """(value, n) for each word of the vocabulary, 0 where there is none."""
    words = df.sparkSession.createDataFrame([(w,) for w in vocabulary], "value string")
    return words.join(df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def sample_quantiles(stream: str, key: Column, quantiles: Sequence[float]) -> Column:
    """A value for each key with the law of the quantile vector, linear between its points."""
    at = hash_uniform(stream, key) * (len(quantiles) - 1)
    points = F.array(*[F.lit(float(q)) for q in quantiles])
    low = F.floor(at).cast("int")
    return F.get(points, low) + (at - low) * (F.get(points, F.least(low + 1, F.lit(len(quantiles) - 1))) - F.get(points, low))


def fidelity(reference: DataFrame, simulated: DataFrame, numeric: Sequence[str], categorical: Sequence[str], weights: dict[str, float] | None = None, points: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(field, score): 1 less the mean relative distance of quantiles, or less half the distance of shares; and a row `total`."""
    parts = []
    for f in numeric:
        both = nearest_rank(reference, f, points).withColumnRenamed("value", "a").join(nearest_rank(simulated, f, points).withColumnRenamed("value", "b"), "q")
        distance = F.avg(F.when(F.greatest(F.abs("a"), F.abs("b")) == 0, 0.0).otherwise(F.abs(F.col("a") - F.col("b")) / F.greatest(F.abs("a"), F.abs("b"))))
        parts.append(both.agg(F.greatest(F.lit(0.0), 1 - distance).alias("score")).select(F.lit(f).alias("field"), "score"))
    for f in categorical:
        both = category_weights(reference, f).withColumnRenamed("weight", "a").join(category_weights(simulated, f).withColumnRenamed("weight", "b"), "value", "full")
        distance = F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))) / 2
        parts.append(both.agg((1 - distance).alias("score")).select(F.lit(f).alias("field"), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in (weights or {"": 1.0}).items() for x in kv])[F.col("field")], F.lit(1.0))
    return out.unionByName(out.agg((F.sum(F.col("score") * w) / F.sum(w)).alias("score")).select(F.lit("total").alias("field"), "score"))


def descriptors(labels: DataFrame, label: str, at: str, available: str) -> DataFrame:
    """One row: rows, prevalence, and least, middle (element n // 2) and largest delay of the labels that came."""
    delay = labels.where(F.col(available).isNotNull()).select((F.col(available) - F.col(at)).alias("d"))
    n = delay.count()
    middle = nearest_upper(delay, "d", n // 2)
    counts = labels.agg(F.count("*").alias("rows"), F.avg(F.col(label).cast("double")).alias("prevalence"))
    return counts.select("rows", "prevalence", delay.agg(F.min("d")).scalar().alias("delay_min"), delay.agg(F.max("d")).scalar().alias("delay_max"), middle.scalar().alias("delay_median"))


def nearest_upper(df: DataFrame, value: str, at: int) -> DataFrame:
    """One row, delay_median: the value at position `at` (from 0) of the sorted values."""
    run = running_totals(df.groupBy(value).agg(F.count("*").alias("_n")), value, {"_upto": "_n"})
    return run.where(F.col("_upto") > at).agg(F.min(value).alias("delay_median"))
