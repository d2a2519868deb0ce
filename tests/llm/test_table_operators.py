"""Mixing, sharding, WARC, I-Match, components and the pipeline."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import components, imatch, mixing_cube, registry, sharding, warc

SF = "/root/testdata/sf0.001"


# mixing


def targets_by_hand(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), set()
    while True:
        left, w = total - sum(2 * sizes[s] for s in fixed), sum(weight[s] for s in order if s not in fixed)
        out = {s: 2.0 * sizes[s] if s in fixed else left * weight[s] / w for s in order}
        more = {s for s in order if s not in fixed and out[s] > 2 * sizes[s]}
        if not more:
            return out
        fixed |= more


def test_mix_meets_its_targets(spark):
    d = "/root/testdata/sf0.01"
    rows = mixing_cube.op6_mixing(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    size, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    want = targets_by_hand(size)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source]
    for s in size:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 50)


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(1, 200))
        pi, size = rng.uniform(0, 1, n), rng.integers(0, 500, n)
        out = mixing_cube.flight(pi, size, rng.uniform(0, 1, n))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out.sum() == pytest.approx(pi.sum(), abs=1e-6) and out @ size == pytest.approx(pi @ size, abs=1e-3)


def test_flight_keeps_probabilities():
    size, hits = np.array([5, 9, 2, 7, 7, 1, 30, 4]), np.zeros(8)
    rng = np.random.default_rng(2)
    for _ in range(4000):
        out = mixing_cube.flight(np.full(8, 0.3), size, rng.uniform(0, 1, 8))
        hits += out
    assert np.allclose(hits / 4000, 0.3, atol=0.03)


def test_levels_of_blocks_agree_with_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing_cube, "BLOCK", 16)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 40 as int))").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"))
    plan = mixing_cube.allocate(docs).collect()
    assert len(plan) == 600
    for source in ("a", "b", None):
        mine = [r for r in plan if r.source == source]
        assert abs(sum(r.copies * r["size"] for r in mine) - mine[0].target) <= 60
    again = mixing_cube.allocate(docs.repartition(7)).collect()
    assert Counter((r.i, r.copies) for r in plan) == Counter((r.i, r.copies) for r in again)


def test_mix_edges(spark, ugly, empty):
    plan = mixing_cube.allocate(ugly).collect()
    assert len(plan) == ugly.count()
    mixed = mixing_cube.mix(ugly)
    assert mixed.columns == ugly.columns
    taken = Counter((r.doc_id, r.text) for r in mixed.collect())
    want = Counter()
    texts = {(r.doc_id, r.text or ""): r.text for r in ugly.collect()}
    assert set(taken) <= {(r.doc_id, r.text) for r in ugly.collect()} and texts
    for r in plan:
        want[r.i] += r.copies
    assert Counter({k: sum(v for (i, _), v in taken.items() if i == k) for k in want if want[k]}) == Counter({k: v for k, v in want.items() if v})
    assert mixing_cube.mix(empty).count() == 0


# sharding


def test_matrix_has_exact_margins():
    counts = np.array([0, 5, 17, 100, 3, 41])
    m = sharding.communication_matrix(counts, 7)
    assert (m.sum(1) == counts).all() and m.sum(0).max() - m.sum(0).min() <= 1 and (m >= 0).all()


def test_shards_are_exact_gapless_and_uniform(spark):
    d = "/root/testdata/sf0.01"
    rows = sharding.op7_sharding(spark, d).collect()
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None
    assert len(rows) == len(text) and set(by) == set(range(40))
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    quarter = Counter((r.doc_id * 4 // 1000, r.shard * 4 // 40) for r in rows)
    assert all(35 < n < 95 for n in quarter.values())  # 62.5 expected, deviation under 8
    again = sharding.op7_sharding(spark, d).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_sharding_edges(spark, ugly, empty):
    out = sharding.shuffle_into_shards(ugly, ["doc_id", "text"], 4)
    assert set(ugly.columns) < set(out.columns) and out.count() == ugly.count()
    assert sharding.shuffle_into_shards(empty, ["doc_id"], 4).count() == 0


def test_written_shards(spark, tmp_path):
    rows = spark.range(100).select("id")
    sharding.write_shards(rows, ["id"], f"{tmp_path}/s", 5)
    assert {r["count"] for r in spark.read.parquet(f"{tmp_path}/s").groupBy("shard").count().collect()} == {20}


# WARC


@pytest.fixture(scope="session")
def pages(spark):
    big = "<p>" + "ü" * 600 + "</p>"
    rows = [(1, "http://B.example.com:8080/x?q=1", big), (2, "https://a.example.com/", big), (3, None, big), (4, "not a url", None), (5, "http://a.example.com/", "<p>small</p>"), (6, "http://[bad", "<p>small</p>"), (None, "http://z.org/ü v\n", "x" * 2000), (7, "http://z.org/", "x" * 2000), (7, "http://z.org/", "x" * 2000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"i": F.lit(1), "d": F.lit("x"), "m": F.lit(0)})


@pytest.mark.parametrize("kind", ["long", "string"])
def test_archive_round_trip(spark, pages, kind):
    archive = warc.write_archive(pages.withColumn("page_id", F.col("page_id").cast(kind)))
    back = warc.read_archive(archive)
    assert back.schema["page_id"].dataType.simpleString() in (kind, "big" + "int")
    number = lambda i: None if i is None else int(i)
    got = sorted(((number(r.page_id) or 0, r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in back.collect()), key=repr)
    want = []
    for r in pages.collect():
        body = (r.html or "").encode()
        last = max((x.page_id or 0) for x in pages.collect() if (x.html or "") == (r.html or ""))
        again = len(body) >= 1000 and (r.page_id or 0) != last
        want.append((r.page_id or 0, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last if again else None))
    assert got == sorted(want, key=repr)


def test_index_lookups(spark):
    docs = spark.read.parquet(f"{SF}/pages.parquet")
    archive = warc.write_archive(docs)
    index = warc.CaptureIndex(archive)
    for r in docs.limit(20).collect():
        found = index.lookup(r.url)
        assert str(r.page_id) in {c.page_id for c in found}
        assert all(c.payload is None or hashlib.sha1(c.payload).hexdigest() == c.payload_digest for c in found)
    assert index.lookup("http://nowhere.invalid/") == []


def test_blocks_of_few_lines(spark, monkeypatch):
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 50).cast("string"), F.lit(".org/")).alias("url"), F.col("id").cast("string").alias("html"))
    archive = warc.write_archive(pages)
    index = warc.CaptureIndex(archive)
    for k in range(0, 50, 7):
        assert sorted(int(c.page_id) for c in index.lookup(f"http://h{k}.org/")) == list(range(k, 500, 50))


def test_ids_of_any_text(spark):
    rows = [(i, "http://a.org/", "x" * 1500) for i in ("a b", "ü/%41", "", "null", None, "no-page")]
    got = {r.page_id: r.refers_to for r in warc.read_archive(warc.write_archive(spark.createDataFrame(rows, "page_id string, url string, html string"))).collect()}
    assert got == {i: None if i == "ü/%41" else "ü/%41" for i, _, _ in rows}


def test_reading_back_needs_each_directory(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "fresh_path", lambda spark, name: f"file://{tmp_path}/{name}")
    archive = warc.write_archive(spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 7).cast("string"), F.lit(".org/")).alias("url"), F.lit("x").alias("html")))
    assert warc.read_archive(archive).count() == 300
    found = list(tmp_path.glob("warc/index/*.directory"))
    assert len(found) > 1
    found[0].unlink()
    with pytest.raises(Exception, match="FileNotFound|No such file|does not exist"):
        warc.read_archive(archive).collect()


def test_lookups_of_given_keys(spark):
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 20).cast("string"), F.lit(".org/")).alias("url"), F.col("id").cast("string").alias("html"))
    keys = spark.createDataFrame([(warc.url_key("http://h3.org/"),), (warc.url_key("http://h3.org/"),), (warc.url_key("http://none.org/"),)], "key string")
    assert sorted(r.page_id for r in warc.read_archive(warc.write_archive(pages), keys).collect()) == list(range(3, 200, 20))


def test_empty_archive(spark, pages):
    assert warc.read_archive(warc.write_archive(pages.limit(0))).count() == 0


def test_keys():
    assert warc.url_key("https://www.Example.com/a b?c") == "com,example,www)/a%20b?c"
    assert warc.url_key("http://example.com:8080") == "com,example:8080)/"
    assert warc.url_key(None) == ""


# I-Match


@pytest.mark.parametrize("kind", ["long", "string"])
def test_next_document_over_ranges(spark, monkeypatch, kind):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 10)
    ids = random.Random(4).sample(range(10_000, 90_000), 333)
    df = spark.createDataFrame([(i, f"t{i}", i) for i in ids], "i long, t string, th long").withColumn("i", F.col("i").cast(kind))
    got = {r.t: r.next_t for r in imatch.with_next(df, ["t"], {}).collect()}
    ids.sort()
    assert got == {f"t{a}": f"t{b}" for a, b in zip(ids, [*ids[1:], ids[0]], strict=True)}


def test_imatch_edges(spark, ugly, empty):
    rows = imatch.compare_with_edits(ugly).collect()
    assert len(rows) == ugly.count()
    text = defaultdict(set)
    for r in rows:
        text[r.doc_id].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert text[5] == text[6] and len(text[9]) == 1
    assert imatch.compare_with_edits(empty).count() == 0
    alone = imatch.compare_with_edits(spark.createDataFrame([(1, "abcde")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcab").hexdigest()


def test_equal_ids_are_cut_into_ranges_too(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 10)
    df = spark.createDataFrame([(None if k % 3 == 0 else "same", f"t{k}", 8 * k % 301) for k in range(301)], "i string, t string, th long")
    got = {r.t: r.next_t for r in imatch.with_next(df, ["t"], {}).collect()}
    order = [r.t for r in sorted(df.collect(), key=lambda r: (r.i is not None, r.i or "", r.th))]
    assert got == {a: b for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    assert len(imatch._bounds(df.select("i", "th"), "i", "th", 301)) > 20


def test_texts_without_band_terms_are_alike_only_if_equal(spark):
    texts = ["common words everywhere here now"] * 30 + ["zyx", "zyx", "wvu", "", None, "!!", "zyx WVU", "wvu zyx"]
    rows = imatch.compare_with_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    by = {r.doc_id: r.fingerprint for r in rows}
    assert by[30] == by[31] != by[32] and by[33] == by[34] != by[35] and by[36] == by[37] and len({by[k] for k in (0, 30, 32, 33, 35, 36)}) == 6
    near = {r.doc_id: r.near_next for r in rows}
    assert near[30] == 1.0 == near[33] and near[31] == near[32] == near[34] == 0.0


def test_imatch_plan_is_native(spark):
    plan = imatch.op10_imatch(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "BatchEval"))


# components


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(300, 300), (200, 201), (201, 200)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), **dict.fromkeys(range(101, 160), 100), 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# registry and pipeline


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    want, got = con.sql(registry.ORACLES[name]), registry.QUERIES[name](spark, SF)
    order = sorted(got.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    mine = Counter(tuple(plain(r[c]) for c in order) for r in got.collect())
    theirs = Counter(tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
    assert mine == theirs


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    docs, was = spark.read.parquet(f"{SF}/documents.parquet"), None
    names = docs.columns
    labelled = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        was = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == names
        if k == 0:
            kept = {r.doc_id for r in docs.collect()}
            long = {r.doc_id for r in was.where("size(split(text, ' ')) >= 12").collect()}
            assert len((labelled & long) - kept) <= 0.05 * len(labelled & long)
        if k in (1, 2):
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in was.collect()}
    assert docs.where("not lossless").count() == 0 and docs.count() > 0


def test_attach_joins_hot_and_cold_keys(spark, monkeypatch):
    from tidemark.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    monkeypatch.setattr(shared, "HOT_KEYS", 4)
    rows = [(k, 1 if k % 3 else k) for k in range(300)] + [(k, 2) for k in range(300, 330)]
    df = spark.createDataFrame(rows, "i long, key long").withColumn("s", F.xxhash64("i"))
    summary = df.groupBy("key").agg(F.min("i").alias("least"), F.count("*").alias("n")).where("key <> 6")
    want = Counter((i, k, min(a for a, b in rows if b == k)) for i, k in rows if k != 6)
    assert Counter((r.i, r.key, r.least) for r in shared.attach(df, summary, "key", "n", "s").collect()) == want
