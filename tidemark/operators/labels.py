"""Label histories: versions of observed labels, nested and flat, and what was visible at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import DAY, bounded_lognormal, hash_uniform

#: Shares of investigated, missing, wrong and corrected observations; delay in days: median, sigma, least and most.
POLICY = {"investigate": 0.70, "missing": 0.05, "error": 0.02, "correct": 0.01}
DELAY = (1.0, 0.5, 0.05, 30.0)


def observe(records: DataFrame, id_: str, truth: Column, at: Column, policy: dict[str, float] | None = None) -> DataFrame:
    """(id, versions): each record's array of (version, status, label, available), by hashes of its id.

    Version 0 is unobserved. An investigated record that is not missing gets version 1, confirmed, or preliminary with
    the wrong label; a preliminary one, and a few confirmed ones, get a corrected version with the truth.
    """
    p = POLICY | (policy or {})
    i = F.col(id_)
    seen = (hash_uniform("investigate", i) < p["investigate"]) & (hash_uniform("missing", i) >= p["missing"])
    wrong, fixed = hash_uniform("error", i) < p["error"], hash_uniform("correct", i) < p["correct"]
    wait = lambda s: (bounded_lognormal(s, i, *DELAY) * DAY).cast("long")
    first, second = at + wait("delay"), at + wait("delay") + wait("correction")
    version = lambda n, status, label, when: F.struct(F.lit(n).alias("version"), F.lit(status).alias("status"), label.alias("label"), when.alias("available"))
    none = F.lit(None)
    versions = F.array(
        version(0, "UNOBSERVED", none.cast("boolean"), none.cast("long")),
        F.when(seen & ~wrong, version(1, "CONFIRMED", truth, first)).when(seen, version(1, "PRELIMINARY", ~truth, first)),
        F.when(seen & (wrong | fixed), version(2, "CORRECTED", truth, second)),
    )
    return records.select(id_, F.array_compact(versions).alias("versions"))


def flatten(observed: DataFrame, id_: str) -> DataFrame:
    return observed.select(id_, F.explode("versions").alias("v")).select(id_, "v.*")


def nest(versions: DataFrame, id_: str) -> DataFrame:
    """The inverse of flatten, versions in order."""
    rest = [c for c in versions.columns if c != id_]
    return versions.groupBy(id_).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("versions"))


def visible_at(versions: Column, at: Column) -> Column:
    """The latest version available at the time, by (available, version); else version 0."""
    ok = F.filter(versions, lambda v: v["available"] <= at)
    best = F.array_max(F.transform(ok, lambda v: F.struct(v["available"].alias("a"), v["version"].alias("n"), v.alias("v"))))
    return F.coalesce(best["v"], F.get(F.filter(versions, lambda v: v["version"] == 0), F.lit(0)))


def violations(versions: DataFrame, id_: str) -> DataFrame:
    """violations(rule, key, detail): versions without gaps from 0, version 0 unobserved, later ones available in order."""
    per = nest(versions, id_).withColumn("n", F.size("versions"))
    steps = F.transform("versions", lambda v: v["version"])
    times = F.transform(F.filter("versions", lambda v: v["version"] > 0), lambda v: v["available"])
    rules = {
        "gap": steps != F.sequence(F.lit(0), F.col("n") - 1),
        "version_0": F.col("versions")[0]["status"] != "UNOBSERVED",
        "not_available": F.exists(times, lambda t: t.isNull()),
        "order": times != F.sort_array(times),
    }
    found = F.array_compact(F.array(*[F.when(bad, rule) for rule, bad in rules.items()]))
    return per.select(F.explode(found).alias("rule"), F.col(id_).cast("string").alias("key"), F.col("n").cast("string").alias("detail"))
