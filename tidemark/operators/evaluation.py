"""Scores against labels: rank metrics with total orders, threshold sweeps, folds and segments.

A global rank never needs one task: rows are ranked inside ranges of the whole order, as many as the rows need, whose offsets are
prefix sums (`global_rank`); running sums likewise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranges import with_range


def global_rank(rows: DataFrame, order: Sequence[Column], out: str, hits: dict[str, Column] | None = None) -> DataFrame:
    """rows with `out`, the rank from 1 in the given total order, all ascending; rows equal in all of it are interchangeable.

    hits: name -> condition; how many rows up to and with the row itself meet it.
    """
    keys, marks = [f"_o{k}" for k in range(len(order))], {f"_m_{n}": F.coalesce(c, F.lit(False)).cast("long") for n, c in (hits or {}).items()}
    ranged = with_range(rows.withColumns(dict(zip(keys, order, strict=True)) | marks), keys)
    sizes = ranged.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n"), *[F.sum(m).alias(f"_s{m}") for m in marks])
    earlier, within = Window.orderBy("_r"), Window.partitionBy("_range").orderBy(*keys)
    before = sizes.select("_r", (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"), *[(F.sum(f"_s{m}").over(earlier) - F.col(f"_s{m}")).alias(f"_b{m}") for m in marks])  # a row for each range
    here = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranged.withColumns({"_in": F.row_number().over(within)} | {f"_i{m}": F.sum(m).over(here) for m in marks})
    both = ranked.join(F.broadcast(before), F.col("_range") == F.col("_r"), "left")  # all have one; an inner join would look for null ranges first, and work each out twice
    return both.select(*rows.columns, (F.col("_in") + F.col("_before")).cast("long").alias(out), *[(F.col(f"_i_m_{n}") + F.col(f"_b_m_{n}")).alias(n) for n in hits or {}])


def running_totals(groups: DataFrame, key: str, sums: dict[str, str], *, descending: bool = False) -> DataFrame:
    """groups (one row for each key) with running sums in the order of the key: out name -> summed column."""
    ranged = with_range(groups.withColumn("_key", -F.col(key).cast("double") if descending else F.col(key).cast("double")), ["_key"])
    totals = ranged.groupBy(F.col("_range").alias("_r")).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    carried = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = totals.select("_r", *[F.sum(f"_t_{n}").over(carried).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(before), F.col("_range") == F.col("_r"), "left")  # as in global_rank
    return out.select(*groups.columns, *[(F.col(n) + F.coalesce(F.col(f"_b_{n}"), F.lit(0))).alias(n) for n in sums])


def auc(rows: DataFrame, score: str, label: str, id_: str) -> DataFrame:
    """One row: the rank-sum AUC by (score, id), without tie averaging; null with one class only.

    A range's ranks are summed from 1 in the pass that orders it; the ranges before it are added once for each of its positives.
    """
    mark = F.col(label).cast("long")
    cut = with_range(rows.select(F.col(score).alias("_o0"), F.col(id_).alias("_o1"), mark.alias("_p")), ["_o0", "_o1"])
    placed = cut.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy("_o0", "_o1")))
    hit = F.col("_p") == 1
    per = placed.groupBy("_range").agg(F.count("*").alias("_n"), F.sum("_p").alias("_p"), F.sum(1 - F.col("_p")).alias("_q"), F.count_if(hit).alias("_h"), F.sum(F.when(hit, F.col("_in")).otherwise(0)).alias("_s"))
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")  # a row for each range
    ranks = F.sum(F.col("_s") + F.col("_h") * F.col("_before"))
    both = per.withColumn("_before", before).agg(F.sum("_p").alias("positives"), F.sum("_q").alias("negatives"), ranks.alias("_s"))
    value = (F.col("_s") - F.col("positives") * (F.col("positives") + 1) / 2) / (F.col("positives") * F.col("negatives"))
    return both.select("positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), value).alias("auc"))


def pr_auc(rows: DataFrame, score: str, label: str, id_: str) -> DataFrame:
    """One row: stepwise average precision in the order (score descending, id)."""
    positive = F.col(label).cast("int") == 1
    ranked = global_rank(rows.withColumn("_neg", -F.col(score)), [F.col("_neg"), F.col(id_)], "_rank", {"_hit": positive})
    return ranked.where(positive).agg(F.count("*").alias("positives"), F.avg(F.col("_hit") / F.col("_rank")).alias("pr_auc"))


def threshold_sweep(rows: DataFrame, score: str, label: str, fpr: float, recall: float) -> DataFrame:
    """One row: the threshold of the best F1, of the best recall at a false-positive rate, and of the best precision at a recall.

    Scores are grouped before the running sums, so the sums are over distinct scores.
    """
    per = rows.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.count("*").alias("_n"))
    per = per.withColumn("_f", F.col("_n") - F.col("_p"))
    run = running_totals(per, score, {"tp": "_p", "fp": "_f"}, descending=True).withColumnRenamed(score, "threshold")
    run = run.withColumns({"P": per.agg(F.sum("_p")).scalar(), "T": per.agg(F.sum("_n")).scalar()})
    precision, rec = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("P")
    f1 = F.when(F.col("tp") > 0, 2 * precision * rec / (precision + rec)).otherwise(0.0)
    run = run.select("threshold", precision.alias("precision"), rec.alias("recall"), f1.alias("f1"), (F.col("fp") / (F.col("T") - F.col("P"))).alias("fpr"))
    best = lambda ok, *by: F.max(F.when(ok, F.struct(*by, "threshold")))
    out = run.agg(best(F.lit(True), "f1").alias("a"), best(F.col("fpr") <= fpr, "recall").alias("b"), best(F.col("recall") >= recall, "precision").alias("c"))
    return out.select(F.col("a.threshold").alias("best_f1_threshold"), F.col("a.f1").alias("best_f1"), F.col("b.threshold").alias("fpr_threshold"), F.col("b.recall").alias("recall_at_fpr"), F.col("c.threshold").alias("recall_threshold"), F.col("c.precision").alias("precision_at_recall"))


def top_fraction(rows: DataFrame, score: str, label: str, id_: str, fraction: float) -> DataFrame:
    """One row: precision and recall among the max(1, ceil(n * fraction)) best rows by (score descending, id).

    Ranges before the last of these rows count as a whole; only the range where it lies is put in order.
    """
    rows = rows.select((-F.col(score)).alias("_o0"), F.col(id_).alias("_o1"), F.col(label).cast("long").alias("_p"))
    cut = with_range(rows, ["_o0", "_o1"])
    per = sorted(cut.groupBy("_range").agg(F.count("*"), F.sum("_p")).collect())  # a row for each range
    k, positives = max(1, math.ceil(sum(n for _, n, _ in per) * fraction)), sum(p or 0 for *_, p in per)
    last, whole, found = 0, 0, None
    for last, n, p in per:
        if whole + n >= k:
            break
        whole, found = whole + n, found if p is None else (found or 0) + p
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_o0", "_o1"))
    rest = cut.where(F.col("_range") == last).withColumn("_in", place).where(F.col("_in") <= k - whole)
    both = rest.agg((F.count("*") + whole).alias("k"), F.sum("_p").alias("_r")).withColumn("_f", F.lit(found).cast("long"))
    hits = F.coalesce(F.col("_r") + F.col("_f"), "_r", "_f")
    return both.select("k", (hits / F.col("k")).alias("precision_at_k"), (hits / F.lit(positives or None)).alias("recall_at_k"))


def confusion(score: Column, label: Column, threshold: float) -> list[Column]:
    """Aggregates: the four counts and the Brier score of the sigmoid."""
    yes, pos = score >= threshold, label.cast("int") == 1
    p = 1 / (1 + F.exp(-score))
    count = lambda c: F.sum(c.cast("long"))
    return [count(yes & pos).alias("tp"), count(yes & ~pos).alias("fp"), count(~yes & pos).alias("fn"), count(~yes & ~pos).alias("tn"), F.avg((p - label.cast("double")) ** 2).alias("brier")]


def fold_aggregate(folds: DataFrame, fold: str, metric: str) -> DataFrame:
    """One row: folds, mean, population standard deviation, and the drop from the first fold to the last."""
    first, last = F.min(F.struct(fold, metric))[metric], F.max(F.struct(fold, metric))[metric]
    return folds.agg(F.count("*").alias("folds"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("stddev"), (first - last).alias("degradation"))


def segment_metrics(rows: DataFrame, dimensions: Sequence[str], measures: Sequence[Column]) -> DataFrame:
    """(dimension, value, measures): one aggregate over the grouping sets of single dimensions."""
    sets = rows.groupingSets([[F.col(d)] for d in dimensions], *dimensions).agg(*measures, F.grouping_id().alias("_g"))
    bits = {2 ** len(dimensions) - 1 - 2 ** (len(dimensions) - 1 - k): d for k, d in enumerate(dimensions)}
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for g, d in bits.items():
        name, value = F.when(F.col("_g") == g, d).otherwise(name), F.when(F.col("_g") == g, F.col(d).cast("string")).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), *[c for c in sets.columns if c not in (*dimensions, "_g")])
