"""Predictions against a labelled dataset: resolving them to rows, metrics for each model, and baseline models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(predictions: DataFrame, dataset: DataFrame, row_id: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(predictions with their row id, violations): each prediction names its row by any one of several keys.

    Keys are unpivoted on both sides, so the join is one equality on (key name, value). No row, several rows, or several
    predictions of one model for a row are violations.
    """
    p = predictions.withColumn("_p", F.xxhash64(*predictions.columns))
    pairs = lambda: F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in keys]))
    asked = p.select("_p", pairs().alias("x")).select("_p", "x.*").where("v is not null")
    known = dataset.select(F.col(row_id).alias("_row"), pairs().alias("x")).select("_row", "x.*").where("v is not null")
    rows = asked.join(known, ["k", "v"]).groupBy("_p").agg(F.collect_set("_row").alias("_rows"))
    found = p.join(rows, "_p", "left").withColumn("_n", F.coalesce(F.size("_rows"), F.lit(0)))
    one = found.where("_n = 1").withColumn(row_id, F.col("_rows")[0]).drop("_p", "_rows", "_n")
    rule = F.when(F.col("_n") == 0, "no_row").when(F.col("_n") > 1, "ambiguous")
    bad = found.where("_n <> 1").select(rule.alias("rule"), F.col("_p").cast("string").alias("key"), F.col("_n").cast("string").alias("detail"))
    twice = one.groupBy("model", row_id).agg(F.count("*").alias("n")).where("n > 1")
    return one, bad.unionByName(twice.select(F.lit("duplicate").alias("rule"), F.concat_ws("/", "model", F.col(row_id).cast("string")).alias("key"), F.col("n").cast("string").alias("detail")))


def model_metrics(rows: DataFrame, by: Sequence[str], score: str, label: Column, threshold: float) -> DataFrame:
    """Per group: rows, positives, precision, recall, F1 at the threshold, and the Brier score of the scores."""
    yes, pos = F.col(score) >= threshold, label.cast("int") == 1
    n = lambda c: F.sum(c.cast("long"))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), n(pos).alias("positives"), n(yes & pos).alias("tp"), n(yes).alias("flagged"), F.avg((F.col(score) - label.cast("double")) ** 2).alias("brier"))
    precision, recall = F.coalesce(F.try_divide("tp", "flagged"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "positives"), F.lit(0.0))
    out = out.withColumns({"precision": precision, "recall": recall})
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def calibration_error(rows: DataFrame, score: str, label: Column, bins: int = 10) -> DataFrame:
    """One row: the mean gap between score and rate over equal-width bins, weighted by rows."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    per = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("s"), F.avg(label.cast("double")).alias("r"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("r"))) / F.sum("n")).alias("calibration_error"))


def drops(metrics: DataFrame, model: str, metric: str, baseline: str) -> DataFrame:
    """Per model: the metric, and its relative drop against the baseline model's."""
    base = metrics.where(F.col(model) == baseline).agg(F.max(metric)).scalar()
    return metrics.select(model, metric, F.try_divide(base - F.col(metric), base).alias("drop"))


def train_baseline(rows: DataFrame, features: Sequence[str], label: str, kind: str = "logistic"):
    """A fitted pipeline: nulls and NaN to 0, scaling, and a logistic regression or boosted trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    if kind not in ("logistic", "trees"):
        raise ValueError(f"unknown model {kind!r}")
    model = LogisticRegression(featuresCol="scaled", labelCol=label, regParam=0.01) if kind == "logistic" else GBTClassifier(featuresCol="scaled", labelCol=label, maxIter=20, seed=42)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), model]).fit(clean(rows, features))


def clean(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return rows.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features})


def predict(model, rows: DataFrame, features: Sequence[str], out: str = "score") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(clean(rows, features))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("raw", "scaled", "rawPrediction", "probability", "prediction")


def one_hot(rows: DataFrame, numeric: Sequence[str], categorical: dict[str, Sequence[str]], flags: Sequence[str] = ()) -> DataFrame:
    """rows with a column for each feature: numbers and flags as doubles with 0 for null and NaN, and 1 or 0 for each known category."""
    plain = {f"x_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in (*numeric, *flags)}
    hot = {f"x_{c}={v}": F.coalesce(F.col(c) == v, F.lit(False)).cast("double") for c, known in categorical.items() for v in known}
    return rows.withColumns(plain | hot)


def value_at_risk(rows: DataFrame, by: Sequence[str], score: str, label: Column, amount: str, threshold: float) -> DataFrame:
    """Per group: the fraud amount there is, what is flagged of it, and what legitimate amount is flagged."""
    yes, pos, x = F.col(score) >= threshold, label.cast("int") == 1, F.col(amount).cast("decimal(38,6)")
    total = lambda c: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("double")
    return rows.groupBy(*by).agg(total(pos).alias("fraud_amount"), total(pos & yes).alias("caught_amount"), total(~pos & yes).alias("blocked_amount"))


def detection_delay(rows: DataFrame, by: Sequence[str], score: str, label: Column, at: str, threshold: float, group: str) -> DataFrame:
    """Per group: frauds, those detected, and the mean time from a fraud's first row to its first flagged one."""
    each = rows.where(label.cast("int") == 1).groupBy(*by, group).agg(F.min(at).alias("_first"), F.min(F.when(F.col(score) >= threshold, F.col(at))).alias("_found"))
    return each.groupBy(*by).agg(F.count("*").alias("frauds"), F.count("_found").alias("detected"), F.avg(F.col("_found") - F.col("_first")).alias("mean_delay"))
