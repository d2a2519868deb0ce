"""Campaigns: phases that change by chance, actions by an intensity, motifs, camouflage and counterfactuals."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import hash_uniform
from tidemark.functions.registry import REGISTRY
from tidemark.functions.shipping import ship_package
from tidemark.operators.running import running

#: Phases in order, the chance to move on after each action, and the mark of each phase.
PHASES = ("PROBE", "RAMP", "EXPLOIT", "COOL")
MOVE_ON, MARKS = 0.3, {"PROBE": 0.5, "RAMP": 1.0, "EXPLOIT": 2.0, "COOL": 0.25}
HAWKES = (0.25, 0.35, 0.5)


def _u(*parts: object) -> float:
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / (1 << 52)


def evolve(campaigns: DataFrame, most_actions: int, seed: int = 42) -> DataFrame:
    """(campaign_id, step, phase, at, intensity): the actions of each campaign (campaign_id, started, ends).

    Each action depends on the one before, so a campaign is a loop; campaigns are independent, and every draw is a hash
    of (seed, campaign, step), so neither batches nor partitions matter. One campaign's rows are bounded by most_actions.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, excite, decay = HAWKES
        for batch in batches:
            out = []
            for c in batch.itertuples(index=False):
                at, phase = int(c.started), 0
                for step in range(most_actions):
                    rate = max(0.0, (base + excite * (1 - math.exp(-decay * step))) * MARKS[PHASES[phase]])
                    at += int(-math.log(1 - _u(seed, c.campaign_id, step, "gap")) / max(rate, 1e-9) * 3_600_000_000)
                    if at >= c.ends:
                        break
                    out.append((c.campaign_id, step, PHASES[phase], at, rate))
                    if _u(seed, c.campaign_id, step, "move") < MOVE_ON and phase < len(PHASES) - 1:
                        phase += 1
            yield pd.DataFrame(out, columns=["campaign_id", "step", "phase", "at", "intensity"])

    ship_package(campaigns.sparkSession)
    return campaigns.select("campaign_id", "started", "ends").mapInPandas(run, "campaign_id string, step int, phase string, at long, intensity double")


def phase_violations(actions: DataFrame) -> DataFrame:
    """violations(rule, key, detail): steps without gaps, times in order, and phases that never go back."""
    from pyspark.sql import Window

    order = Window.partitionBy("campaign_id").orderBy("step")
    index = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase"))
    seen = actions.withColumns({"_p": F.lag(index).over(order), "_t": F.lag("at").over(order), "_n": F.row_number().over(order)})
    rules = {"gap": F.col("step") != F.col("_n") - 1, "time": F.col("at") < F.col("_t"), "phase": (index < F.col("_p")) | (index > F.col("_p") + 1) | (index == 0)}
    found = F.array_compact(F.array(*[F.when(bad, rule) for rule, bad in rules.items()]))
    return seen.select(F.explode(found).alias("rule"), F.col("campaign_id").alias("key"), F.col("step").cast("string").alias("detail"))


def campaign_summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("campaign_id").agg(F.count("*").alias("n"), (F.max("at") - F.min("at")).alias("duration"), F.avg("intensity").alias("intensity"))


#: The kinds of motif, and which sizes each takes.
MOTIFS = {
    "CYCLIC_RING": ("member_count",),
    "MULE_NETWORK": ("source_count",),
    "BENEFICIARY_NETWORK": ("source_count",),
    "FAN_OUT": ("destination_count",),
    "BIPARTITE_NETWORK": ("originator_count", "beneficiary_count"),
    "STACKED_NETWORK": ("originator_count", "intermediary_count", "beneficiary_count"),
    "SCATTER_GATHER": ("intermediary_count",),
    "GATHER_SCATTER": ("source_count", "destination_count"),
    "DENSE_CAMPAIGN": ("member_count", "edge_count"),
    "RANDOM_ALERT_CONTROL": ("member_count", "edge_count"),
    "MERCHANT_CUSTOMER_COMMUNITY": ("customer_count", "merchant_count", "repeat_count"),
    "SHARED_DEVICE_INFRASTRUCTURE": ("member_count",),
    "SHARED_IP_INFRASTRUCTURE": ("member_count",),
}


def motif(spark: SparkSession, kind: str, **sizes: int) -> DataFrame:
    """(src, dst) over members numbered from 0: the edges of one planted pattern, each as often as it is planted.

    Ends of an edge are worked out from its number, so a pattern of any size is one distributed range.
    """
    if kind not in MOTIFS or set(sizes) != set(MOTIFS[kind]) or min(sizes.values()) < 1:
        raise ValueError(f"a motif is one of {MOTIFS}, with its sizes")
    a, b, c = (*[sizes[n] for n in MOTIFS[kind]], 1, 1)[:3]
    e, zero = F.col("id"), F.lit(0).cast("long")
    at = lambda x: F.lit(x).cast("long")
    grid = lambda first, width, second: (first + F.floor(e / width), second + e % width)
    number, src, dst = {
        "CYCLIC_RING": lambda: (a, e, (e + 1) % a),
        "MULE_NETWORK": lambda: (a + 1, e, F.when(e < a, at(a)).otherwise(at(a + 1))),
        "BENEFICIARY_NETWORK": lambda: (a, e, at(a)),
        "FAN_OUT": lambda: (a, zero, e + 1),
        "BIPARTITE_NETWORK": lambda: (a * b, *grid(0, b, a)),
        "STACKED_NETWORK": lambda: (a * b + b * c, F.when(e < a * b, F.floor(e / b)).otherwise(a + F.floor((e - a * b) / c)), F.when(e < a * b, a + e % b).otherwise(a + b + (e - a * b) % c)),
        "SCATTER_GATHER": lambda: (2 * a, F.when(e < a, zero).otherwise(e - a + 1), F.when(e < a, e + 1).otherwise(at(a + 1))),
        "GATHER_SCATTER": lambda: (a + b, F.when(e < a, e).otherwise(at(a)), F.when(e < a, at(a)).otherwise(e + 1)),
        "DENSE_CAMPAIGN": lambda: (min(a * (a - 1), b), F.floor(e / max(1, a - 1)), e % max(1, a - 1) + (e % max(1, a - 1) >= F.floor(e / max(1, a - 1))).cast("long")),
        "RANDOM_ALERT_CONTROL": lambda: (b, e % a, (e + 1) % a),
        "MERCHANT_CUSTOMER_COMMUNITY": lambda: (a * b * c, e % a, (e + 1) % a),
        "SHARED_DEVICE_INFRASTRUCTURE": lambda: (a, e, (e + 1) % a),
        "SHARED_IP_INFRASTRUCTURE": lambda: (a, e, (e + 1) % a),
    }[kind]()
    return spark.range(number).select(src.cast("long").alias("src"), dst.cast("long").alias("dst"))


def camouflage(fraud: DataFrame, legitimate: DataFrame, cohort: Sequence[str], value: str, strength: float, digits: int = 2) -> DataFrame:
    """Fraud rows with the value moved towards the median of the legitimate rows of their cohort.

    Medians are exact: values are counted, and the middle ones found by their running number, in ranges for large cohorts.
    """
    per = legitimate.where(F.col(value).isNotNull()).groupBy(*cohort, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    total = per.groupBy(*cohort).agg(F.sum("_n").alias("_all"))
    run = running(per, cohort, ["_v"], {"_upto": ("sum", "_n")}).join(total, list(cohort))
    holds = lambda place: F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place), F.col("_v")))
    middle = run.groupBy(*cohort).agg(((holds(F.floor((F.col("_all") - 1) / 2)) + holds(F.ceil((F.col("_all") - 1) / 2))) / 2).alias("_m"))
    blended = F.round((1 - strength) * F.col(value) + strength * F.coalesce("_m", F.col(value)), digits)
    return fraud.join(middle, list(cohort), "left").withColumn(value, blended).drop("_m")


def counterfactuals(rows: DataFrame, id_: str, score: Column, threshold: float, candidates: dict[str, tuple[Sequence[float], float]]) -> DataFrame:
    """For each row at or above the threshold, the cheapest change of one column that brings its score below.

    candidates: for a column, factors to try and the cost of a change by the whole value. Ties go to the column's name.
    The score is evaluated on the changed rows, so it may be any column expression.
    """
    hit = rows.where(score >= threshold)
    tries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(f)).alias("factor"), F.lit(abs(1 - f) * cost).alias("cost")) for c, (factors, cost) in sorted(candidates.items()) for f in factors])
    tried = hit.withColumn("_try", F.explode(tries))
    changed = tried.withColumns({c: F.when(F.col("_try.column") == c, F.col(c) * F.col("_try.factor")).otherwise(F.col(c)) for c in candidates})
    feasible = changed.where(score < threshold)
    best = feasible.groupBy(id_).agg(F.min(F.struct(F.col("_try.cost").alias("cost"), F.col("_try.column").alias("column"), F.col("_try.factor").alias("factor"))).alias("b"))
    return hit.select(id_).join(best, id_, "left").select(id_, "b.cost", "b.column", "b.factor")


def trajectories(ids: DataFrame, id_: str, count: int, seed: int = 42) -> DataFrame:
    """`count` ids in the order of a hash of (seed, id): a sample that does not depend on the partitions."""
    return ids.select(id_).distinct().orderBy(hash_uniform(f"{seed}/pick", F.col(id_)), id_).limit(count)


def intensity(name: str, events_before: Column, mark: Column) -> Column:
    return REGISTRY.get("intensity", name)(events_before, mark)
