"""What the second round found to grow too fast."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.operators import graph, running
from tidemark.plans import catalogue, catalogue_generated, catalogue_more  # noqa: F401
from tidemark.streaming import velocity as stream


SF = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_state_of_a_stream_is_on_disk_and_has_no_sketches(spark, tmp_path):
    start = 960_000_000
    rows = [(k, k % 7, start + 60 * k, 1) for k in range(200)]
    made = spark.createDataFrame(rows, "event_id long, customer long, s long, amount long").withColumn("event_time", F.timestamp_seconds("s")).drop("s")
    made.coalesce(1).write.parquet(f"{tmp_path}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    windows = stream.velocity(stream.source(spark, f"{tmp_path}/in", made.schema), device=None)
    assert "devices" not in windows.columns
    query = stream.write(windows, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    assert spark.conf.get(name) == before
    kept = query.recentProgress[0]["stateOperators"]
    assert len(kept) == 2 and all(any("rocksdb" in m for m in k["customMetrics"]) for k in kept)
    got = {(r.window_start, r.customer, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = stream.velocity(made, device=None).where(f"window_end <= timestamp_seconds({start + 199 * 60 - 600})")
    assert got == {(r.window_start, r.customer, r.n) for r in want.collect()} != set()


def test_pairs_of_members_are_not_shuffled(spark, monkeypatch):
    """One shuffle, of uses; the pairs of each cell are found and counted where they are."""
    monkeypatch.setattr(graph, "CELL_PAIRS", 500, raising=False)
    rng = random.Random(3)
    uses = [(rng.randrange(40), f"r{rng.randrange(4)}", rng.randrange(300)) for _ in range(400)]
    out = graph.shared_pairs(spark.createDataFrame(uses, "m long, r string, t long"), "m", "r", "t", 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    want = {}
    for m, r, t in uses:
        for n, s, v in uses:
            if r == s and m < n and abs(t - v) <= 10:
                want.setdefault((m, n), {}).setdefault(r, []).append(max(t, v))
    assert {(x.a, x.b): (x.resource, x.shared, x.since) for x in out.collect()} == {k: (min(v), len(v), min(map(min, v.values()))) for k, v in want.items()}
    assert out.count() == len(want)


def asked(monkeypatch) -> list:
    """The plans of the rows in which hot keys are looked for from now on; each is a pass of its own."""
    found, find = [], running.find_cuts
    monkeypatch.setattr(running, "find_cuts", lambda rows, *a, **b: found.append(optimized(rows)) or find(rows, *a, **b))
    return found


def test_generated_lifecycles_are_worked_out_once(spark, monkeypatch):
    seen = asked(monkeypatch)
    assert catalogue.QUERIES["j15_lifecycle_violations"](spark, SF).count() > 0
    assert seen == []


def test_faults_are_counted_without_an_order_and_drawn_once(spark, monkeypatch):
    seen = asked(monkeypatch)
    assert optimized(catalogue.QUERIES["n09_faults"](spark, SF)).count("sha2(") <= 25
    assert seen == []


def test_edge_ids_are_worked_out_before_they_are_looked_through(spark, monkeypatch):
    seen = asked(monkeypatch)
    catalogue.QUERIES["w07_edge_ids"](spark, SF)
    assert len(seen) == 1 and "sha2(" not in seen[0]


def test_where_no_key_is_large_the_rows_are_counted_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(running, "PART_ROWS", 50)
    passes = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    assert running.find_cuts(spark.range(1000).select((F.col("id") % 100).alias("k"), "id"), ["k"], "id") is None
    one = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - passes
    passes += one
    spark.range(1000).groupBy(F.col("id") % 100).count().where("count > 50").collect()
    assert one <= spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - passes


def test_a_join_by_key_has_as_many_tasks_as_its_rows_need(spark, monkeypatch):
    monkeypatch.setattr(catalogue_more, "KEYED_ROWS", 300, raising=False)
    plan = catalogue.QUERIES["j17_workflow_checks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert plan.count(f", {-(-rows // 300)}), REPARTITION_BY_NUM") >= 2
