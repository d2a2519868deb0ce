"""Hand-computed cases of what is easy to get wrong."""

from __future__ import annotations

import hashlib
import json
import random
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import exprs, ranges, registry
from tidemark.operators import backtest, campaigns, contracts, dataset, drift, evaluation, faults, generate, graph, labels, ledger, quality, records, replay, running, workflow
from tidemark.operators import point_in_time as pit
from tidemark.operators.frames import Frame, frames
from tidemark.plans import catalogue_dataset
from tidemark.sources import config, runs, sinks, tables


def one(df):
    return df.first().asDict()


def test_trailing_frame_is_half_open(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 5), (3, "a", 10), (4, "a", 10), (5, "b", 10)], "event_id long, k string, t long")
    got = {r.event_id: r.n for r in pit.over_frames(rows, ["k"], {"n": Frame("count", 10)}).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 2, 5: 0}


FEATURES = {"n1": Frame("count", 100), "n2": Frame("count", 700), "na": Frame("count"), "s1": Frame("sum", 100, "x"), "d1": Frame("distinct", 100, "v"), "d2": Frame("distinct", 700, "v"), "da": Frame("distinct", None, "v"), "seen": Frame("seen", 300, "v"), "m1": Frame("max", 100, "x"), "m2": Frame("max", 700, "x"), "ma": Frame("max", None, "t")}


@pytest.mark.parametrize("part_rows", [10**9, 20])
def test_frames_equal_brute_force(spark, monkeypatch, part_rows):
    """Late rows, equal times, null keys and values, with keys whole and cut into ranges."""
    monkeypatch.setattr(running, "PART_ROWS", part_rows)
    rng = random.Random(1)
    rows = []
    for i in range(300):
        t = rng.randrange(3000)
        available = t + rng.choice([0, 1, 5, 30, 200, 400])
        rows.append((i, rng.choice([None, 1, 2]), t, available, available + rng.choice([0, 0, 3, 50]), rng.choice([None, "a", "b", "c"]), rng.choice([None, 1.0, 2.0, 3.0, 5.0, 8.0])))
    df = spark.createDataFrame(rows, "i long, k long, t long, available long, now long, v string, x double")
    got = {r.i: r.asDict() for r in frames(df, df, ["k"], FEATURES, id_="i").collect()}
    for i, k, _, _, now, v, _ in rows:
        for name, f in FEATURES.items():
            own = [r for r in rows if r[0] != i and r[1] == k and r[2] < now and r[3] <= now and (f.width is None or now - r[2] <= f.width)]
            values = [r[2] if f.value == "t" else r[6] for r in own]
            want = {"count": lambda: len(own), "sum": lambda: sum(x or 0 for x in values), "distinct": lambda: len({r[5] for r in own} - {None}), "seen": lambda: v is not None and any(r[5] == v for r in own), "max": lambda: max((x for x in values if x is not None), default=None)}[f.kind]()  # noqa: B023
            assert got[i][name] == want, (i, name)


def test_running_columns_over_cut_keys(spark, monkeypatch):
    rows = [("hot" if k % 4 else f"k{k % 12}", (k * 7919) % 1009, k) for k in range(600)] + [(None, k, -k) for k in range(50)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    run = lambda: sorted(map(str, running.running(df, ["k"], ["t", "v"], {"s": ("sum", "v"), "m": ("max", "v"), "b": ("max_before", "v"), "p": ("previous", "v")}).collect()))
    whole = run()
    monkeypatch.setattr(running, "PART_ROWS", 40)
    assert running.cut_keys(df, ["k"], "t")[0].where("k = 'hot'").select("_part").distinct().count() > 5
    assert run() == whole and len(whole) == 650


def test_as_of_keeps_repeated_rows(spark):
    left = spark.createDataFrame([("a", 5), ("a", 5), ("a", 0), ("b", 9), (None, 3)], "k string, at long")
    versions = spark.createDataFrame([("a", 1, 1, "x"), ("a", 5, 2, "y"), ("a", 5, 1, "w"), ("a", 6, 3, "z"), ("c", 0, 1, "q")], "k string, since long, version int, label string")
    got = sorted(map(tuple, pit.latest_as_of(left, versions, "k", "at", "since", "version", ["version", "label"]).collect()), key=str)
    assert got == sorted([("a", 5, 2, "y"), ("a", 5, 2, "y"), ("a", 0, None, None), ("b", 9, None, None), (None, 3, None, None)], key=str)


def test_exact_quantiles_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 20)
    values = [float((k * 31) % 257) / 3 for k in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    assert drift.quantiles(df, "v", shares) == pytest.approx(list(np.quantile(values, shares)))
    same = spark.createDataFrame([(1.0, k) for k in range(500)], "s double, i long")  # equal first keys are cut by the second
    assert ranges.with_range(same, ["s", "i"]).select("_range").distinct().count() > 10
    assert {r.i: r.rank for r in evaluation.global_rank(same, [F.col("s"), F.col("i")], "rank").collect()} == {k: k + 1 for k in range(500)}


def test_running_totals_in_both_orders(spark):
    groups = spark.createDataFrame([(float((k * 31) % 997), k % 7) for k in range(900)], "s double, n int").dropDuplicates(["s"])
    rows = [(r.s, r.n) for r in groups.collect()]
    up = {r.s: r.x for r in evaluation.running_totals(groups, "s", {"x": "n"}).collect()}
    down = {r.s: r.x for r in evaluation.running_totals(groups, "s", {"x": "n"}, descending=True).collect()}
    assert up == {s: sum(n for t, n in rows if t <= s) for s, _ in rows} and down == {s: sum(n for t, n in rows if t >= s) for s, _ in rows}


def test_available_counts_against_brute_force(spark):
    events = [(k, "a" if k % 3 else "b", k * 7 % 50, k * 7 % 50 + (k % 5) * 9) for k in range(60)]
    df = spark.createDataFrame(events, "event_id long, customer string, t long, available long")
    got = {r.event_id: r.n for r in pit.available_counts(df, {"n": 20}).collect()}
    want = {i: sum(c2 == c and i2 != i and a - 20 <= t2 < a and a2 <= a for i2, c2, t2, a2 in events) for i, c, _, a in events}
    assert got == want


def test_unavailable_event_changes_nothing(spark):
    base = [(1, "a", 0, 5), (2, "a", 10, 15)]
    late = [*base, (3, "a", 9, 1000)]
    count = lambda rows: {r.event_id: r.n for r in pit.available_counts(spark.createDataFrame(rows, "event_id long, customer string, t long, available long"), {"n": 100}).collect()}
    assert {k: v for k, v in count(late).items() if k != 3} == count(base)


def test_range_join_null_safe(spark):
    left = spark.createDataFrame([(None, 10), ("x", 10)], "k string, at long")
    right = spark.createDataFrame([(None, 5, 1), ("x", 9, 2), ("x", 10, 3), ("x", 0, 4)], "k string, t long, v int")
    got = sorted((r.k or "", r.v) for r in pit.range_join(left, right, ["k"], "at", "t", 10, null_safe=True).collect())
    assert got == [("", 1), ("x", 2), ("x", 4)]


def test_running_max_of_all_rows(spark):
    rows = [(k, (k * 37) % 101) for k in range(200)]
    got = {r.t: r.m for r in pit.running_max(spark.createDataFrame(rows, "t long, v long"), "t", "v", "m", id_="t").collect()}
    assert got == {t: max(v for s, v in rows if s <= t) for t, _ in rows}


def test_global_rank_is_total(spark):
    rows = [(k, float((k * 7919) % 53)) for k in range(500)]
    got = {r.i: r.rank for r in evaluation.global_rank(spark.createDataFrame(rows, "i long, s double").repartition(5), [F.col("s"), F.col("i")], "rank").collect()}
    assert got == {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}


def test_auc_without_ties_averaged_and_one_class(spark):
    rows = [(1, 0.5, 1), (2, 0.5, 0), (3, 0.9, 1), (4, 0.1, 0)]
    df = spark.createDataFrame(rows, "i long, s double, y int")
    ranks = {i: k + 1 for k, (i, *_) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    want = (sum(ranks[i] for i, _, y in rows if y) - 3) / 4
    assert one(evaluation.auc(df, "s", "y", "i"))["auc"] == want
    assert one(evaluation.auc(df.where("y = 1"), "s", "y", "i"))["auc"] is None


def test_nearest_rank_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(float(k),) for k in range(4)], "v double")  # (n - 1) / 2 = 1.5 -> 2
    assert one(drift.nearest_rank(df, "v", [0.5]))["value"] == 2.0


def test_drift_of_a_table_with_itself(spark):
    rows = spark.createDataFrame([(float(k), str(k % 3), s) for k in range(100) for s in (0, 1)], "v double, c string, side int")
    assert one(drift.psi(rows, "v", "side"))["psi"] == pytest.approx(0)
    assert one(drift.jensen_shannon(rows, "c", "side"))["js"] == pytest.approx(0)
    assert one(drift.wasserstein(rows, "v", "side"))["wasserstein"] == 0
    assert [r.alert for r in drift.report(rows, "side", ["v"], ["c"]).collect()] == [False] * 5


def test_shard_index_equals_hashlib(spark):
    got = spark.createDataFrame([("PAY-1",), ("x",)], "k string").select("k", exprs.shard_index(F.col("k"), 7).alias("s")).collect()
    assert all(r.s == int.from_bytes(hashlib.sha256(r.k.encode()).digest()[:8], "big") % 7 for r in got)


def test_canonical_json(spark):
    got = one(spark.range(1).select(exprs.canonical_json({"b": F.lit(None).cast("string"), "a": F.lit('x"y'), "c": F.lit(1.5)}).alias("j")))["j"]
    assert got == json.dumps({"a": 'x"y', "b": None, "c": 1.5}, separators=(",", ":"))


def test_score_treats_missing_ratio_as_one(spark):
    got = [r.s for r in spark.createDataFrame([(None,), (0.0,), (1.0,), (11.0,)], "r double").select(exprs.heuristic_score(F.lit(True), F.lit(False), F.lit(20), F.col("r")).alias("s")).collect()]
    assert got == pytest.approx([5 / 7, 5 / 7, 5 / 7, 6 / 7])


def test_durations():
    assert [exprs.parse_duration(x) for x in ("90s", "5m", "2h", "3d", "1w", "7")] == [90, 300, 7200, 259200, 604800, 7]
    with pytest.raises(ValueError):
        exprs.parse_duration("soon")


def test_ledger_checks(spark):
    rows = spark.createDataFrame([("p1", "DEBIT", 1.0), ("p1", "CREDIT", 1.0), ("p2", "DEBIT", 1.0), ("p3", "DEBIT", 2.0), ("p3", "CREDIT", 3.0)], "payment_id string, entry_type string, amount double")
    assert sorted((r.rule, r.key) for r in ledger.validate_entries(rows).collect()) == [("equal_amounts", "p3"), ("two_sides", "p2")]
    with pytest.raises(ValueError, match="two_sides"):
        quality.assert_none(ledger.validate_entries(rows).where("key = 'p2'"))


def test_lifecycle_rules(spark):
    good = [("p", "CARD_PAYMENT_INITIATED", 1, "a", None), ("p", "CARD_AUTHORIZATION_REQUESTED", 2, "b", "a"), ("p", "CARD_DECLINED", 3, "c", "b")]
    bad = [("q", "CARD_AUTHORIZED", 1, "d", None), ("q", "CARD_SETTLED", 1, "e", "x")]
    df = spark.createDataFrame([*good, *bad], "payment_id string, event_type string, event_time long, event_id string, causation_id string")
    assert sorted((r.key, r.rule) for r in quality.lifecycle_violations(df, quality.CARD, quality.FIRST["CARD"]).collect()) == [("q", "cause"), ("q", "first_state"), ("q", "move"), ("q", "time")]


def test_references_with_nulls_and_empty(spark):
    rows, parents = spark.createDataFrame([(1,), (None,), (9,)], "k long"), spark.createDataFrame([(1,), (1,)], "p long")
    assert one(quality.reference_rate(rows, "k", parents, "p")) == {"checked": 2, "nulls": 1, "valid": 1, "rate": 0.5}
    assert one(quality.reference_rate(rows.limit(0), "k", parents, "p"))["rate"] == 1.0


def test_winner_and_conflicts(spark):
    rows = spark.createDataFrame([(1, "b", "x"), (1, "a", "x"), (2, "a", "y"), (2, "a", "z")], "k long, src string, v string")
    got = {r.k: (r.src, r.v, r.contributors, r.copies) for r in records.winner_dedup(rows, ["k"], [F.col("src"), F.col("v")], "src").collect()}
    assert got == {1: ("a", "x", ["a", "b"], 2), 2: ("a", "y", ["a"], 2)}
    _, conflicts = records.exact_dedup(rows.drop("src"), "k")
    assert [r.k for r in conflicts.collect()] == [2]


def test_fingerprint_ignores_order_and_partitions(spark):
    df = spark.range(1000).select("id", (F.col("id") * 2).cast("string").alias("s"))
    assert one(records.fingerprint(df)) == one(records.fingerprint(df.orderBy(F.desc("id")).repartition(7)))
    assert one(records.fingerprint(df)) != one(records.fingerprint(df.where("id < 999")))


def test_rings_need_increasing_times(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("b", "x", 2), ("x", "a", 1)], "src string, dst string, at long")
    assert [(r.path, r.started, r.ended) for r in graph.rings(e, 10).collect()] == [(["a", "b", "c"], 1, 3)]
    assert graph.rings(e, 1).count() == 0


def test_triangles_and_shared_pairs(spark):
    e = spark.createDataFrame([(a, b, 0) for a in "abcd" for b in "abcd" if a < b] + [("b", "a", 0)], "src string, dst string, at long")
    assert one(graph.triangles(e))["triangles"] == 4
    uses = spark.createDataFrame([("m", "r1", 0), ("n", "r1", 5), ("m", "r2", 9), ("n", "r2", 9), ("o", None, 9), ("p", "r1", 60), ("n", "r1", 7)], "m string, r string, t long")
    assert [tuple(r) for r in graph.shared_pairs(uses, "m", "r", "t", 10).collect()] == [("m", "n", "r1", 2, 5)]


def test_fan_is_all_or_nothing(spark):
    e = spark.createDataFrame([("a", "h", 0), ("b", "h", 1), ("c", "h", 2), ("d", "h", 100)], "src string, dst string, at long")
    assert graph.fans(e, "dst", "src", "at", 50).count() == 0
    assert graph.fans(e, "dst", "src", "at", 100).count() == 1


def test_labels_round_trip_and_visibility(spark):
    rows = spark.range(300).select("id", (F.col("id") % 2 == 0).alias("truth"), F.lit(0).cast("long").alias("t"))
    seen = labels.observe(rows, "id", F.col("truth"), F.col("t"), {"error": 0.3, "correct": 0.2})
    flat = labels.flatten(seen, "id")
    assert labels.violations(flat, "id").count() == 0
    assert {r.id: [tuple(v) for v in r.versions] for r in labels.nest(flat, "id").collect()} == {r.id: [tuple(v) for v in r.versions] for r in seen.collect()}
    assert {r.s for r in seen.select(labels.visible_at(F.col("versions"), F.lit(0).cast("long"))["status"].alias("s")).collect()} == {"UNOBSERVED"}


def test_generated_ranges_join_up(spark):
    whole = generate.payments(spark, 0, 100, 10).collect()
    parts = generate.payments(spark, 0, 60, 10).collect() + generate.payments(spark, 60, 100, 10).collect()
    assert sorted(whole) == sorted(parts)
    assert all(r.payer_account_id != r.payee_account_id for r in whole)


def test_chaos_is_reproducible(spark):
    df = spark.range(500).select("id", (F.col("id") * 10).alias("t"))
    run = lambda n: sorted(replay.chaos(df.repartition(n), "id", "t", drop=0.1, duplicate=0.1, delay=0.1, delay_by=1000, window=50).collect())
    assert run(1) == run(6)


def test_typed_scan_masks_and_partitions(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("truth", T.BooleanType())])
    df = spark.range(20).select("id", F.lit(True).alias("truth"), (F.col("id") % 2).cast("string").alias("kind"))
    sinks.write_typed(df, schema, f"{tmp_path}/t", hide=["truth"])
    assert {r.truth for r in tables.read_typed(spark, f"{tmp_path}/t", schema).collect()} == {None}
    with pytest.raises(ValueError, match="missing"):
        tables.read_typed(spark, f"{tmp_path}/t", T.StructType([T.StructField("no", T.LongType())]))
    manifest = sinks.write_partitions(df, "id", "kind", f"{tmp_path}/p", 3)
    assert sum(manifest["rows"].values()) == 20
    assert sinks.read_partitions(spark, f"{tmp_path}/p", kind="1", columns=["id"]).count() == 10
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_typed(df, schema, f"{tmp_path}/t")


def test_resume_writes_only_what_is_missing(spark, tmp_path):
    df = spark.range(60).select("id")
    assert sinks.resume_partitions(df, "id", f"file://{tmp_path}/r", 3) == [0, 1, 2]
    assert sinks.resume_partitions(df, "id", f"file://{tmp_path}/r", 3) == []
    assert spark.read.parquet(f"file://{tmp_path}/r").count() == 60


@dataclass(frozen=True)
class Inner:
    rate: float = 0.5


@dataclass(frozen=True)
class Settings:
    seed: int
    inner: Inner = Inner()


def test_settings_are_strict():
    assert config.parse(Settings, {"seed": 1, "inner": {"rate": 1}}) == Settings(1, Inner(1.0))
    for bad in ({}, {"seed": "x"}, {"seed": 1, "more": 2}, {"seed": 1, "inner": {"no": 1}}, {"seed": True}):
        with pytest.raises(ValueError):
            config.parse(Settings, bad)


def test_workflow_fields_must_match(spark):
    parents = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, v int, w string")
    rows = spark.createDataFrame([("a", 1, None), ("b", 3, None)], "k string, v int, w string")
    assert [(r.key, r.detail) for r in workflow.mismatched(rows, parents, "k", ["v", "w"], "copy").collect()] == [("b", "v,w")]


def test_extensions_by_name():
    own = registry.Registry()
    own.add("metric", "m", 1)
    assert own.get("metric", "m") == 1
    for bad in (("metric", "m"), ("metric", " "), ("nothing", "m")):
        with pytest.raises(ValueError):
            own.add(*bad, 2)
    with pytest.raises(ValueError):
        own.get("metric", "x")


def test_command_line_lists_queries(capsys):
    from tidemark.__main__ import main

    assert main(["list"]) == 0 and "w01_txn_counts" in capsys.readouterr().out


def test_sql_needs_its_source(spark):
    assert tables.sql_over(spark.range(3), "SELECT count(*) AS n FROM {source}").first().n == 3
    with pytest.raises(ValueError):
        tables.sql_over(spark.range(3), "SELECT 1")


def test_segments_are_single_dimensions(spark):
    df = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1")], "a string, b string")
    got = sorted(tuple(r) for r in evaluation.segment_metrics(df, ["a", "b"], [F.count("*").alias("n")]).collect())
    assert got == [("a", "x", 2), ("a", "y", 1), ("b", "1", 2), ("b", "2", 1)]


def test_an_event_that_is_not_available_changes_no_row(spark):
    """Of the dataset: a payment, its label and an entry that come after every prediction time."""
    t = catalogue_dataset.tables(spark, "/root/testdata/sf0.001")
    t["payments"] = t["payments"].where("customer_id < 4")
    t["labels"] = t["labels"].join(t["payments"], "payment_id", "left_semi")
    t["entries"] = t["entries"].where("account_id < 4")
    late = 4_000_000_000_000_000
    more = dict(t)
    first = t["payments"].orderBy("payment_id").limit(1)
    more["payments"] = t["payments"].unionByName(first.withColumns({"payment_id": F.lit("LATE"), "event_id": F.lit("LATE"), "source_available_at": F.lit(late)}))
    more["labels"] = t["labels"].unionByName(t["labels"].limit(1).withColumns({"payment_id": F.lit("LATE"), "label": F.lit("FRAUD"), "label_available_at": F.lit(late), "fraud_confirmed_at": F.lit(1)}))
    more["entries"] = t["entries"].unionByName(t["entries"].limit(1).withColumn("posted_at", F.lit(late)))
    rows = lambda x: sorted(map(str, dataset.build(x, run_id="R", end=late // 2).collect()))
    assert rows(more) == rows(t)


def test_sources_that_contradict_themselves_are_refused(spark):
    t = catalogue_dataset.tables(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError, match="unknown_account"):
        dataset.build(t | {"accounts": t["accounts"].where("account_id <> 3")}, run_id="R")
    with pytest.raises(ValueError, match="no_valid_account"):
        dataset.build(t | {"accounts": t["accounts"].withColumn("valid_to", F.lit(1_704_500_000_000_000))}, run_id="R")
    with pytest.raises(ValueError, match="include or exclude"):
        dataset.build(t, run_id="R", unresolved="maybe")


def test_folds_with_gaps(spark):
    plan = backtest.folds(0, 100, test=20, step=10, gap=5, validation=10)
    assert [(f.train, f.validation, f.test) for f in plan[:2]] == [((0, 10), (15, 25), (30, 50)), ((0, 20), (25, 35), (40, 60))] and plan[-1].test[1] <= 100
    fixed = backtest.folds(0, 100, test=20, step=10, gap=5, train=30)
    assert fixed[0].train == (0, 30) and fixed[1].train == (10, 40) and fixed[0].validation is None
    with pytest.raises(ValueError):
        backtest.folds(0, 10, test=20, step=10, gap=5)
    rows = spark.createDataFrame([(k,) for k in range(0, 60, 5)], "t long")
    got = {(r.t, r.fold, r.part) for r in backtest.assign(rows, "t", plan[:2]).collect()}
    assert (0, "FOLD-0001", "train") in got and (15, "FOLD-0001", "validation") in got and (45, "FOLD-0001", "test") in got and (45, "FOLD-0002", "test") in got and not any(t in (10, 25) and f == "FOLD-0001" for t, f, _ in got)


def test_motifs_have_their_shapes(spark):
    pairs = lambda kind, **sizes: sorted((r.src, r.dst) for r in campaigns.motif(spark, kind, **sizes).collect())
    assert pairs("STACKED_NETWORK", originator_count=2, intermediary_count=1, beneficiary_count=2) == [(0, 2), (1, 2), (2, 3), (2, 4)]
    assert pairs("MULE_NETWORK", source_count=3) == [(0, 3), (1, 3), (2, 3), (3, 4)]
    assert pairs("DENSE_CAMPAIGN", member_count=3, edge_count=4) == [(0, 1), (0, 2), (1, 0), (1, 2)]
    assert pairs("GATHER_SCATTER", source_count=2, destination_count=1) == [(0, 2), (1, 2), (2, 3)]
    with pytest.raises(ValueError):
        campaigns.motif(spark, "CYCLIC_RING", wrong=3)


def test_faults_and_outages_are_checked(spark):
    with pytest.raises(ValueError):
        faults.inject(spark.range(1), faults.Settings({"nothing": 0.1}))
    for bad in ((5, 5, "DROP"), (0, 5, "NO"), (0, 5, "DELAY")):
        with pytest.raises(ValueError):
            faults.Outage(*bad)


def test_schema_changes_and_versions(spark):
    df = spark.createDataFrame([(1, "2")], "a long, b string")
    assert contracts.apply_change(df, "rename", {"a": "c", "z": "y"}).columns == ["c", "b"]
    assert contracts.apply_change(df, "nullability", {"n": True, "m": False}).columns == ["a", "b", "n"]
    assert contracts.apply_change(df, "type", {"b": "integer", "z": "int"}).schema["b"].dataType == T.LongType()
    assert contracts.infer_compatibility("nullability", {"a": False}) == "BREAKING" and contracts.infer_compatibility("type", {}, "BREAKING") == "BREAKING"
    book = contracts.SchemaRegistry()
    book.register("1", {"a": "long"})
    with pytest.raises(ValueError):
        book.register("1", {"a": "string"})
    assert contracts.structure_score(df, {"a": "bigint", "c": "string"}) == {"order": 0.5, "types": 0.5}
    assert one(df.select(contracts.decode(F.lit("/w==")).alias("x"), contracts.decode(F.lit("eA==")).alias("y"))) == {"x": None, "y": "x"}


def test_observable_view_hides_truth(spark):
    nodes = spark.createDataFrame([("a", "X", 0, None, 0), ("b", "X", 0, None, 50)], "node_id string, node_type string, valid_from long, valid_to long, available_at long")
    edge = spark.createDataFrame([("e", "a", "b", "K", None, 5, None, None, None, "S", "C", "D", None, 5)], "edge_id string, src_id string, dst_id string, edge_type string, event_time long, valid_from long, valid_to long, source_event_id string, payment_id string, scenario_id string, campaign_id string, edge_origin string, support_count int, available_at long")
    assert graph.view(nodes, edge, 10, "observable")[1].count() == 0
    seen = graph.view(nodes, edge, 60, "observable")[1].first()
    assert (seen.scenario_id, seen.campaign_id) == (None, None) and graph.view(nodes, edge, 10, "oracle")[1].first().scenario_id == "S"
    assert {r.rule for r in graph.graph_violations(nodes, edge.withColumns({"dst_id": F.lit("a"), "valid_to": F.lit(5).cast("long"), "edge_type": F.lit("SHARES_IP")}), 0, 9).collect()} == {"self_loop", "interval", "support"}


def test_a_run_goes_to_disk_and_becomes_a_dataset(spark, tmp_path, capsys):
    """Generated tables written as a run, read back with their types, and built into a dataset from the command line."""
    from tidemark.__main__ import main

    payments = generate.payments(spark, 0, 200, 20)
    events = generate.lifecycle(payments)
    at = lambda c: F.timestamp_micros(c)
    start = F.timestamp_micros(F.lit(generate.START - 10**12))
    none = lambda kind: F.lit(None).cast(kind)
    accounts = generate.accounts(spark, 20)
    customer = F.concat(F.lit("CUS-"), F.substring("payer_account_id", 5, 20))
    tables_ = {
        "accounts": accounts.select("account_id", "customer_id", none("string").alias("institution_id"), F.col("opening_balance").alias("ledger_balance"), F.lit(100.0).alias("credit_limit"), start.alias("opening_date"), start.alias("valid_from"), none("timestamp").alias("valid_to"), start.alias("system_from")),
        "payments": payments.select("payment_id", customer.alias("customer_id"), "payer_account_id", "payee_account_id", none("string").alias("merchant_id"), none("string").alias("card_id"), "payment_rail", F.lit("TRANSFER").alias("payment_type"), "amount", at("initiated").alias("initiated_at")),
        "payment_events": events.select("event_id", "payment_id", customer.alias("customer_id"), none("string").alias("device_id"), "event_type", "amount", F.lit(True).alias("online"), *[at(c).alias(c) for c in ("event_time",)], at("event_time").alias("source_created_at"), *[at(c).alias(c) for c in ("source_available_at", "ingested_at", "processed_at")], "correlation_id", "causation_id", none("string").alias("scenario_id"), F.lit(True).alias("fraud_truth")),
        "ledger_entries": generate.ledger_entries(events).select(F.concat_ws("-", "event_id", "entry_type").alias("ledger_entry_id"), "event_id", "payment_id", "account_id", "entry_type", "amount", at("effective_at").alias("effective_at"), at("posted_at").alias("posted_at")),
    }
    empty = {"merchants": runs.TABLES["entities"]["merchants"], "devices": runs.TABLES["entities"]["devices"], "cards": runs.TABLES["entities"]["cards"], "fraud_labels": runs.TABLES["behavior"]["fraud_labels"]}
    tables_ |= {n: spark.createDataFrame([], schema) for n, schema in empty.items()}
    path = f"{tmp_path}/run"
    with pytest.raises(ValueError, match="not whole"):
        runs.load_run(spark, path)
    runs.write_run(tables_, path, run_id="R")
    back = runs.load_run(spark, path)
    assert back["payments"].count() == 200 and {r.fraud_truth for r in back["payment_events"].collect()} == {None}
    with pytest.raises(Exception, match="(?i)exists"):
        runs.write_run(tables_, path, run_id="R")
    with pytest.raises(ValueError, match="is missing"):
        runs.load_run(spark, path, ["customers"])
    assert runs.load_run(spark, path, ["customers"], optional=["customers"])["customers"].count() == 0
    assert main(["build-dataset", path, f"{tmp_path}/out"]) == 0
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 200 and out.columns == list(dataset.COLUMNS) and out.where("feature_available_at > prediction_time").count() == 0
    assert main(["validate-lifecycles", path]) == 0 and main(["replay", path, "2024-01-01", "2024-01-02", f"{tmp_path}/replay"]) == 0
    assert spark.read.parquet(f"{tmp_path}/replay").agg(F.max("replay_sequence"), F.count("*")).first()[0] == spark.read.parquet(f"{tmp_path}/replay").count()
    assert main(["ddl"]) == 0 and "CREATE TABLE IF NOT EXISTS payments" in capsys.readouterr().out
    # Older files lack the times of ingestion.
    old = back["payment_events"].drop("ingested_at", "processed_at")
    old.write.parquet(f"{tmp_path}/old/behavior/payment_events")
    (tmp_path / "old" / "manifest.json").write_text("{}")
    filled = runs.load_run(spark, f"{tmp_path}/old", ["payment_events"])["payment_events"]
    assert filled.where("not (ingested_at <=> source_available_at)").count() == 0


def test_predictions_are_checked(spark, tmp_path):
    row = {"model": "m", "payment_id": "p", "event_id": None, "customer_id": None, "dataset_row_id": None, "prediction_time": None, "score": 0.5}
    (tmp_path / "good.jsonl").write_text(json.dumps(row) + "\n")
    (tmp_path / "bad.jsonl").write_text(json.dumps(row | {"score": 2.0}) + "\n")
    (tmp_path / "none.jsonl").write_text("")
    assert runs.load_predictions(spark, f"{tmp_path}/good.jsonl").count() == 1
    for name in ("bad", "none"):
        with pytest.raises(ValueError):
            runs.load_predictions(spark, f"{tmp_path}/{name}.jsonl")
    assert runs.metrics_text(spark.createDataFrame([("b", 0.5), ("a", 1.0)], "metric string, value double")) == "tidemark_a 1\ntidemark_b 0.5\n"


def test_counts_against_what_was_written(spark):
    a, b = spark.range(3), spark.range(2)
    written = a.select(F.lit("a").alias("subject")).unionByName(b.limit(1).select(F.lit("b").alias("subject")))
    assert [tuple(r) for r in records.verify_counts({"a": a, "b": b}, written).collect()] == [("rows", "b", "1/2")]


def test_realigned_times_and_clean_delivery(spark):
    entries = spark.createDataFrame([("e", 5, None), ("x", 7, 7)], "event_id string, posted_at long, other long")
    events = spark.createDataFrame([("e", 9), ("e", 11)], "event_id string, source_available_at long")
    assert sorted(map(tuple, faults.realign(entries, events, "event_id", ["posted_at", "other"]).collect())) == [("e", 11, None), ("x", 7, 7)]
    sent = faults.deliver(spark.createDataFrame([(k, "key", k * 10) for k in range(20)], "record_id long, key string, scheduled long"), faults.Chaos())
    assert one(faults.delivery_counts(sent)) == {"emitted": 20, "dropped": 0, "retried": 0, "duplicated": 0, "late": 0, "deduplicated": 0}
    assert one(faults.out_of_order(faults.reordered(sent, 0)))["out_of_order"] == 0
