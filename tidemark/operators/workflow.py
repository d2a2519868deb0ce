"""The fraud workflow: alerts, cases, confirmations and labels against the records they come from; and its history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dangling(rows: DataFrame, key: str, parents: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """violations(rule, key, detail): references, not null, that no parent has."""
    known = parents.select(F.col(parent_key).alias("_p")).distinct()
    lost = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).join(known, F.col(key) == F.col("_p"), "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.col("_n").cast("string").alias("detail"))


def mismatched(rows: DataFrame, parents: DataFrame, key: str, fields: Sequence[str], rule: str) -> DataFrame:
    """violations for rows whose copied fields are not their parent's; null equals null."""
    p = parents.select(F.col(key).alias("_p"), *[F.col(f).alias(f"_p_{f}") for f in fields])
    both = rows.join(p, F.col(key) == F.col("_p"))
    wrong = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_p_{f}")), f) for f in fields]))
    return both.withColumn("_w", wrong).where(F.size("_w") > 0).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.concat_ws(",", "_w").alias("detail"))


def out_of_order(rows: DataFrame, key: str, times: Sequence[str], rule: str) -> DataFrame:
    """violations for rows whose times, where present, do not follow one another."""
    bad = F.lit(False)
    for k, later in enumerate(times[1:], 1):
        before = F.greatest(F.lit(None).cast("long"), *[F.col(t).cast("long") for t in times[:k]])
        bad = bad | F.coalesce(F.col(later).cast("long") < before, F.lit(False))
    return rows.where(bad).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.concat_ws(",", *[F.col(t).cast("string") for t in times]).alias("detail"))


def prefix(facts: DataFrame, available: Column, until: Column | int, references: Sequence[tuple[str, DataFrame, str, str]]) -> dict[str, DataFrame]:
    """What was known by a time: the facts available by then, and of each other table the rows that belong to them."""
    kept = facts.where(available <= until)
    out = {"facts": kept}
    for name, table, mine, theirs in references:
        out[name] = table.join(kept.select(F.col(mine).alias("_k")).distinct(), F.col(theirs) == F.col("_k"), "left_semi")
    return out


def requested_and_realised(rows: DataFrame, hits: dict[str, Column], requested: dict[str, float]) -> DataFrame:
    """(fault, requested, realised, rows) of each injected fault."""
    sums = rows.agg(F.count("*").alias("_n"), *[F.coalesce(F.sum(h.cast("long")), F.lit(0)).alias(f) for f, h in hits.items()])
    parts = F.array(*[F.struct(F.lit(f).alias("fault"), F.lit(float(requested[f])).alias("requested"), (F.col(f) / F.col("_n")).alias("realised"), F.col(f).alias("rows")) for f in hits])
    return sums.select(F.explode(parts).alias("x")).select("x.*")


def compare(reference: DataFrame, current: DataFrame, name: str, value: str, threshold: float) -> DataFrame:
    """(name, reference, current, delta, alert) of the metrics of two windows."""
    both = reference.select(name, F.col(value).alias("reference")).join(current.select(name, F.col(value).alias("current")), name, "full")
    delta = F.col("current") - F.col("reference")
    return both.select(name, "reference", "current", delta.alias("delta"), F.coalesce(F.abs(delta) >= threshold, F.lit(False)).alias("alert"))


def members(rows: DataFrame, campaign: str, ends: Sequence[str], at: str) -> DataFrame:
    """(campaign, members, n_rows, first_at, last_at): who took part in each campaign, sorted and distinct."""
    each = rows.select(campaign, at, F.explode(F.array(*[F.col(e).cast("string") for e in ends])).alias("_m")).where("_m is not null")
    per = each.groupBy(campaign).agg(F.sort_array(F.collect_set("_m")).alias("members"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return per.join(rows.groupBy(campaign).agg(F.count("*").alias("n_rows")), campaign)
