"""Ranges of a total order: rows are cut at places from a sample, as many as the rows need.

The cuts decide how much a task has, never a result. The sample is bounded: about SAMPLED rows for each of at most RANGES ranges.
Rows that are equal in all order columns share a range. Nulls come first. Columns are numbers, texts, booleans, dates or times.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import let

#: Rows in a range, the most ranges, and the sampled rows for each.
RANGE_ROWS, RANGES, SAMPLED = 200_000, 4096, 10
#: Fixed value: the seed of the sample.
SEED = 7


def comparable(rows: DataFrame, name: str) -> Column:
    """The column as a number or text with the same order, which JSON holds exactly."""
    kind = rows.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(name)
    if isinstance(kind, (T.DecimalType, T.FloatType)):
        return F.col(name).cast("double")
    return F.col(name).cast("int") if isinstance(kind, T.BooleanType) else F.col(name)


def with_range(rows: DataFrame, order: Sequence[str], out: str = "_range") -> DataFrame:
    """rows with the number of their range, which grows with the order of the columns."""
    total = rows.count()
    count = max(1, min(RANGES, -(-total // RANGE_ROWS)))
    if count == 1:
        return rows.withColumn(out, F.lit(0))
    key = F.struct(*[comparable(rows, c).alias(f"k{k}") for k, c in enumerate(order)])
    some = rows.sample(min(1.0, count * SAMPLED / total), seed=SEED).select(key.alias("k")).select("k.*")  # before the keys are worked out, so only the sampled rows' are
    kind = some.schema.simpleString()
    found = [r.asDict() for r in some.orderBy(*some.columns).collect()]
    bounds = [b for k, b in enumerate(found[SAMPLED - 1 :: SAMPLED]) if b != (found[k * SAMPLED - 1] if k else None)]
    bounds = [b for b in bounds if not any(isinstance(v, float) and not math.isfinite(v) for v in b.values())]
    return rows.withColumn(out, _number_of(key, bounds, kind))


def _number_of(key: Column, bounds: list[dict], kind: str) -> Column:
    """How many bounds lie below the key, by bisection: as many comparisons as their number has binary digits."""
    if not bounds:
        return F.lit(0)
    places = F.from_json(F.lit(json.dumps(bounds, ensure_ascii=False)), f"array<{kind}>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return let(key, lambda k: F.aggregate(steps, F.lit(0), lambda below, step: below + F.when(F.get(places, below + step - 1) < k, step).otherwise(0)))
