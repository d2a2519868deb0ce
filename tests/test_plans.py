"""What the plans must show: pruned columns, pushed filters, no cross join, no Python on the way."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import point_in_time, running
from tidemark.operators.frames import Frame
from tidemark.plans import catalogue, catalogue_dataset, catalogue_generated, catalogue_more, catalogue_population  # noqa: F401

SF = "/root/testdata/sf0.001"
PYTHON = {"n15_campaigns"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - {"t01_stream_velocity", "u05_baseline_model", "v10_schema_compatibility"}))
def test_plans_stay_native_and_without_cartesian_products(spark, name):
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert bool(re.search("Python|Pandas|Arrow", text)) == (name in PYTHON)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalogue.QUERIES["j08_closure"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", text)
    text = plan(catalogue.QUERIES["s08_sql_over_partitions"](spark, SF))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_linestatus:string>" in text


def test_trailing_frames_of_one_key_share_one_exchange(spark):
    assert plan(catalogue.QUERIES["w01_txn_counts"](spark, SF)).count("Exchange hashpartitioning") == 1


def test_no_part_of_a_hot_key_is_larger_than_it_should_be(spark, monkeypatch):
    """A key with most of the rows is cut into ranges, and no range has more than twice its share."""
    monkeypatch.setattr(running, "PART_ROWS", 1000)
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 300).alias("k"), (F.col("id") * 7919 % 40_009).alias("t"))
    cut, parted = running.cut_keys(rows, ["k"], "t")
    sizes = cut.groupBy("k", "_part").count()
    assert parted and sizes.agg(F.max("count")).first()[0] <= 2000 and sizes.where("k = 0").count() >= 20


def test_frames_take_time_in_proportion_to_the_rows(spark, monkeypatch):
    """One key in one window, frames over half its rows: twice the rows take at most 2.3 times as long."""
    monkeypatch.setattr(running, "PART_ROWS", 10**9)
    def took(n: int) -> float:
        rows = spark.range(0, n, 1, 1).select(F.col("id").alias("event_id"), F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") % 97).cast("double").alias("x")).cache()
        rows.count()
        best = 1e9
        for _ in range(2):
            start = time.perf_counter()
            point_in_time.over_frames(rows, ["k"], {"n": Frame("count", n // 2), "s": Frame("sum", n // 2, "x")}).agg(F.sum("n")).collect()
            best = min(best, time.perf_counter() - start)
        rows.unpersist()
        return best

    took(1000)
    small, large = took(300_000), took(600_000)
    assert large <= 2.3 * small + 1  # a frame that is read again for each row would take hours
