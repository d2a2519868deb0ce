"""Rolling backtests: folds with maturity gaps, which rows belong to which part of them, and scores fitted on mature training rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import clamp


@dataclass(frozen=True)
class Fold:
    """Half-open times; validation and stress may be missing."""

    name: str
    train: tuple[int, int]
    test: tuple[int, int]
    validation: tuple[int, int] | None = None
    stress: tuple[int, int] | None = None


def folds(start: int, end: int, *, test: int, step: int, gap: int, train: int | None = None, validation: int = 0) -> list[Fold]:
    """Folds whose tests fit before the end, a step apart. Labels mature in the gap that lies before validation and before the test.

    train: the width of the training window; without it the window begins at the start and grows.
    """
    at = start + (train if train is not None else step) + gap * (2 if validation else 1) + validation
    out: list[Fold] = []
    while at + test <= end:
        check_end = at - gap
        check_start = check_end - validation
        train_end = check_start - (gap if validation else 0)
        train_start = start if train is None else train_end - train
        if train_start >= train_end:
            raise ValueError("the training window is empty")
        out.append(Fold(f"FOLD-{len(out) + 1:04d}", (train_start, train_end), (at, at + test), (check_start, check_end) if validation else None))
        at += step
    if not out:
        raise ValueError("no fold fits the history")
    return out


def assign(rows: DataFrame, at: str, plan: Sequence[Fold]) -> DataFrame:
    """rows with fold and part, once for each fold they belong to: train, validation, test or stress, the first that holds."""
    def part(fold: Fold) -> Column:
        out = None
        for name, span in (("train", fold.train), ("validation", fold.validation), ("test", fold.test), ("stress", fold.stress)):
            if span is not None:
                inside = (F.col(at) >= span[0]) & (F.col(at) < span[1])
                out = F.when(inside, name) if out is None else out.when(inside, name)
        return out

    each = F.explode(F.array(*[F.struct(F.lit(f.name).alias("fold"), part(f).alias("part")) for f in plan]))
    return rows.withColumn("_fold", each).where("_fold.part is not null").select(*rows.columns, "_fold.*")


def raw_score(new_device: Column, new_country: Column, count_1h: Column, ratio: Column) -> Column:
    """The score of a row before it is centred; a missing ratio counts as 1."""
    used = clamp(F.coalesce(ratio, F.lit(1.0)), 0.0, 10.0)
    parts = 4 * new_device.cast("double") + 2 * new_country.cast("double") + F.least(count_1h, F.lit(10)) / 10 + F.greatest(F.lit(0.0), used - 1) / 10
    return F.round(parts, 12)


def fit(rows: DataFrame, by: Sequence[str], score: str, positive: Column) -> DataFrame:
    """(by..., centre, scale): the middle between the class means, and their distance, but at least 1; a class without rows has mean 0."""
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col(score))), F.lit(0.0))
    out = rows.groupBy(*by).agg(mean(positive).alias("_p"), mean(~positive).alias("_n"))
    return out.select(*by, ((F.col("_p") + F.col("_n")) / 2).alias("centre"), F.greatest(F.abs(F.col("_p") - F.col("_n")), F.lit(1.0)).alias("scale"))
