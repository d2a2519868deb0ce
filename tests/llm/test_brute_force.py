"""Operators without SQL against plain recomputation, and the cases their earlier limits left out."""

from __future__ import annotations

import itertools
import math
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import LONG
from tidemark.llm import langid, license_scan, mixing_cube, piece_sampling, quality_crf, sharding, shared, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# language ID


def test_sizes_by_plain_compression(spark, documents):
    model = langid.train(documents)
    got = {r.doc_id: r for r in langid.identify(documents, model).collect()}
    for r in documents.limit(60).collect():
        text = " ".join(re.sub(r"[^a-zA-Z\x80-\U0010ffff]", " ", r.text or "").split())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode()
        if not text:
            assert got[r.doc_id].lang_pred == "und"
            continue
        sizes = {}
        for code, dictionary, _ in model.languages:
            raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[code] = len(zstandard.ZstdCompressor(dict_data=raw, level=langid.LEVEL, write_content_size=False).compress(text))
        order = sorted(sizes.values())
        assert got[r.doc_id].margin_bytes == order[1] - order[0]
        if order[1] - order[0] > langid.MARGIN:
            best = min(sizes, key=sizes.get)
            assert got[r.doc_id].lang_pred == best and not got[r.doc_id].rejected
            assert got[r.doc_id].score == pytest.approx(1 / sum(2.0 ** max(-60, order[0] - s) for s in order))


def test_ties_go_to_the_language_with_more_rows():
    same = b"the same words in both of the dictionaries " * 20
    classify = langid.Classifier(langid.Model((("zz", same, (same,)), ("aa", same, (same,)))))
    assert classify(b"some of the same words") == ("zz", 0.5, True, 0)


def test_many_languages_share_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_BYTES", 200_000)
    rng = random.Random(1)
    rows = [(f"l{k}", " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(9000))) for k in range(80)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model.languages) == 80 and sum(len(d) + sum(map(len, small)) for _, d, small in model.languages) <= 200_000


# quality rules


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    scores, moves, document = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    one, pair = quality_crf.marginals(scores, moves, document)
    for d in range(3):
        own = np.flatnonzero(document == d)
        total, first, both = 0.0, np.zeros(len(own)), np.zeros((len(own), 2, 2))
        for y in itertools.product((0, 1), repeat=len(own)):
            w = math.exp(sum(scores[k] for k, label in zip(own, y, strict=True) if label) + sum(moves[a][b] for a, b in zip(y, y[1:], strict=False)))
            total, first = total + w, first + w * np.array(y)
            for k in range(1, len(own)):
                both[k, y[k - 1], y[k]] += w
        assert np.allclose(one[own], first / total) and np.allclose(pair[own], both / total)


def test_quality_on_documents_that_were_not_fitted(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality_crf.train(docs, labels.where("doc_id % 2 = 0"))
    got = quality_crf.score_documents(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    by = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert by.get((1, False), 0) <= 0.02 * by[(1, True)] and by.get((0, True), 0) <= 0.1 * by[(0, False)]


def test_lines_far_down_are_fitted_and_ids_may_be_text(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    head = [" ".join(word() for _ in range(8)) for _ in range(60)]
    body = lambda bad: "\n".join([*head, *[" ".join(word() + ("$#<>" if bad else "") for _ in range(8)) for _ in range(200)]])
    rows = [(f"d{k}", body(k % 2 == 1)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{k}", 1 - k % 2) for k in range(40)], "doc_id string, quality int")
    model = quality_crf.train(docs, labels)
    assert model is not quality_crf.START
    assert {r.doc_id: r.kept for r in quality_crf.score_documents(docs, model).collect()} == {f"d{k}": k % 2 == 0 for k in range(40)}


def test_quality_and_simhash_of_an_empty_table(spark, empty):
    assert quality_crf.score_documents(empty, quality_crf.START).count() == 0
    assert quality_crf.train(empty, spark.createDataFrame([], "doc_id long, quality int")) is quality_crf.START
    assert simhash.near_duplicates(empty).count() == 0
    assert license_scan.scan_documents(empty).count() == 0


# near-duplicates


def test_scattered_edits_are_found_in_every_band_of_similarity(spark):
    """Recall by bands of exact similarity, of words replaced anywhere; and nothing below the threshold is grouped."""
    rng = random.Random(11)
    sets = lambda words: {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    rows, bands, below = [], defaultdict(list), []
    for k in range(900):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((80, 300)))]
        edited = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 30))):
            edited[rng.randrange(len(edited))] = f"x{rng.randrange(5000)}"
        a, b = sets(words), sets(edited)
        s = len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
        (bands[int(s * 20)] if s >= 0.8 else below).append(2 * k + 1)
    first = {r.i: r.first_i for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(bands) >= {16, 17, 18, 19} and min(map(len, bands.values())) >= 20 and len(below) > 50
    for own in bands.values():
        assert sum(first[i] == i - 1 for i in own) >= 0.99 * len(own)
    assert all(first[i] == i for i in below)


def test_a_group_around_the_threshold_equals_brute_force(spark, monkeypatch):
    """Many edits of one text, whose similarities to each other lie on both sides of the threshold, in small tiles."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(12)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(90):
        words = list(base)
        for _ in range(rng.randint(1, 9)):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(words)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    root = list(range(90))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(range(90), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    want = {k: find(k) for k in range(90)}
    assert 1 < len(set(want.values())) < 90
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    assert {r.i: r.first_i for r in simhash.similar_groups(df).collect()} == want


# segmentation


@pytest.fixture(scope="session")
def vocabulary():
    return piece_sampling.load()


def weights_of(vocabulary):
    """Of each piece that is not a byte, by its text: a whole segment's first space stands for the space mark."""
    return {vocabulary.texts[i].decode(): float(w) for i, w in zip(vocabulary.ids, vocabulary.weights, strict=True)}


@pytest.mark.parametrize("text", [" " + "abracadabrasimsalabim" * 24, "語" * 40 + "internationalization" * 8, "a😀b😀"])
def test_chances_of_cuts_in_long_and_spelled_words(vocabulary, text):
    """How often a piece ends at each place against forward and backward sums over the whole word, in logarithms."""
    weight, n = weights_of(vocabulary), len(text)
    forward, backward = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    forward[0] = backward[n] = 0.0
    arcs = [(a, b, math.log(weight[text[a:b]])) for a in range(n) for b in range(a + 1, min(n, a + vocabulary.longest) + 1) if text[a:b] in weight]
    arcs += [(a, a + 1, 0.0) for a in range(n) if text[a] not in weight]
    for a, b, w in sorted(arcs, key=lambda x: x[1]):
        forward[b] = np.logaddexp(forward[b], forward[a] + w)
    for a, b, w in sorted(arcs, key=lambda x: -x[0]):
        backward[a] = np.logaddexp(backward[a], backward[b] + w)
    exact = np.array([math.exp(forward[k] + backward[k] - forward[n]) for k in range(n + 1)])
    draws = 3000
    ids, at = piece_sampling.sample([text] * draws, np.arange(draws, dtype=np.uint64) * np.uint64(7919), piece_sampling.Lattices(vocabulary))
    ends, seen = {len(text[:k].encode()): k for k in range(n + 1)}, np.zeros(n + 1)
    for a, b in zip(at, at[1:], strict=False):
        sizes = np.cumsum([0, *[len(vocabulary.texts[i]) for i in ids[a:b]]])
        for e in sizes:
            if int(e) in ends:
                seen[ends[int(e)]] += 1
    assert sizes[-1] == len(text.encode())
    assert np.abs(seen / draws - exact).max() < 5 * 0.5 / draws**0.5
    if n > 300:
        assert exact[64] < 0.9 and exact[128] < 0.9  # no cut is forced


def test_draws_are_those_of_the_row_keys(spark, documents, vocabulary):
    coded = {r.doc_id: list(r.pieces) for r in piece_sampling.encode(documents, vocabulary).collect()}
    rows = documents.select("doc_id", "text", F.xxhash64(F.lit(piece_sampling.SEED), "doc_id").alias("k")).collect()
    for r in rows[:50]:
        ids, _ = piece_sampling.sample([r.text or ""], np.array([r.k]).astype(np.int64).view(np.uint64), piece_sampling.Lattices(vocabulary))
        assert coded[r.doc_id] == ids.tolist()


# mixing


def flight_by_hand(pi, size, coin):
    """Three open ones at a time along the vector that keeps both sums, in plain numbers."""
    pi, held, eps = list(map(float, pi)), [], 1e-9
    for k in range(len(pi)):
        if not eps < pi[k] < 1 - eps:
            pi[k] = float(round(pi[k]))
            continue
        held.append(k)
        if len(held) == 3:
            x, y, z = (int(size[j]) for j in held)
            v = (y - z, z - x, x - y) if (x, y, z) != (x, x, x) else (1, -1, 0)
            up = min((1 - pi[j]) / m if m > 0 else pi[j] / -m for j, m in zip(held, v, strict=True) if m)
            down = min(pi[j] / m if m > 0 else (1 - pi[j]) / -m for j, m in zip(held, v, strict=True) if m)
            step = up if coin[k] * (up + down) < down else -down
            for j, m in zip(held, v, strict=True):
                pi[j] += step * m
                if not eps < pi[j] < 1 - eps:
                    pi[j] = float(round(pi[j]))
            held = [j for j in held if 0 < pi[j] < 1]
            if len(held) == 3:
                j = min(held, key=lambda j: min(pi[j], 1 - pi[j]))
                pi[j] = float(round(pi[j]))
                held.remove(j)
    return pi


def test_taken_words_by_hand(spark, documents):
    """All of one source fit in a block here: one flight, with the largest open ones waiting, and the landing."""
    plan = mixing_cube.allocate(documents).collect()
    keys = {(r.doc_id, r.th): r.r for r in documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).withColumn("r", F.xxhash64(F.lit(mixing_cube.SEED), "doc_id", "th", F.lit(0).cast("long"))).collect()}
    by = defaultdict(list)
    for r in plan:
        by[r.source].append(r)
    for own in by.values():
        rate = min(own[0].target / own[0].source_size, 2.0) if own[0].source_size else 0.0
        sure = math.floor(rate + 1e-12)
        own.sort(key=lambda r: (keys[r.i, r.th], r["size"]))
        pi, size = [max(0.0, rate - sure)] * len(own), [r["size"] for r in own]
        coin = mixing_cube._uniforms(np.array([keys[r.i, r.th] for r in own]), 0)
        open_ = [k for k in range(len(own)) if 0 < pi[k] < 1]
        wait = sorted(open_, key=lambda k: -size[k])[: mixing_cube.LAND]
        fly = [k for k in range(len(own)) if k not in set(wait)]
        for k, p in zip(fly, flight_by_hand([pi[k] for k in fly], [size[k] for k in fly], [coin[k] for k in fly]), strict=True):
            pi[k] = p
        rest = [k for k in range(len(own)) if 0 < pi[k] < 1]
        want = sum(pi[k] * size[k] for k in rest)
        choices = [(y, abs(sum(size[k] for k, b in zip(rest, y, strict=True) if b) - want), abs(sum(y) - sum(pi[k] for k in rest))) for y in itertools.product((0, 1), repeat=len(rest))]
        slack = max(mixing_cube.SLACK * own[0].target, min(c[1] for c in choices)) + 1e-9
        near = [c for c in choices if c[1] <= slack]
        near = {c[0] for c in near if c[2] <= min(c[2] for c in near) + 1e-9}
        assert tuple(r.copies - sure for r in (own[k] for k in rest)) in near
        for k in set(range(len(own))) - set(rest):
            assert own[k].copies == sure + int(pi[k])


def test_equal_rows_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(shared, "FOLD", 7)
    df = spark.createDataFrame([(1, "a")] * 50 + [(2, None)] * 3 + [(None, None)], "i long, t string")
    got = Counter(map(tuple, shared.numbered(df, "number").collect()))
    assert got == Counter([(1, "a", k) for k in range(50)] + [(2, None, k) for k in range(3)] + [(None, None, 0)])


# sharding


@pytest.mark.parametrize(("good", "bad", "sample"), [(50, 70, 30), (5, 3, 7), (1, 9, 4), (50_000_000, 1_950_000_000, 500_000), (10**10, 4 * 10**11, 10**8)])
def test_draws_follow_the_hypergeometric_law(good, bad, sample):
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    low, chances = sharding.hypergeometric_law(good, bad, sample)
    if good + bad < 1000:
        total = math.comb(good + bad, sample)
        exact = [Fraction(math.comb(good, k) * math.comb(bad, sample - k), total) for k in range(max(0, sample - bad), min(good, sample) + 1)]
        assert low == max(0, sample - bad) and np.allclose(chances, [float(x) for x in exact], rtol=1e-12)
    else:
        for k in (len(chances) // 3, len(chances) // 2):
            want = choose(good, low + k) + choose(bad, sample - low - k) - choose(good + bad, sample)
            assert math.log(chances[k]) == pytest.approx(want, abs=0.02)  # the logarithms of factorials are no better here
        mean = (chances * (low + np.arange(len(chances)))).sum()
        assert mean == pytest.approx(sample * good / (good + bad), rel=1e-9)


def test_matrix_of_more_than_1e9_rows():
    counts = np.full(8, 400_000_000)
    m = sharding.communication_matrix(counts, 5)
    assert (m.sum(1) == counts).all() and m.sum(0).max() - m.sum(0).min() <= 1


def test_shards_and_slots_by_hand(spark, documents):
    text = F.coalesce("text", F.lit(""))
    thin = documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit(0).cast("long").alias("copy"))
    keys, seed, shards = ["doc_id", "size", "text_crc32", "copy"], sharding.SEED, sharding.SHARDS
    rows = [r.asDict() for r in thin.withColumn("h", F.xxhash64(F.lit(seed), *keys)).withColumn("local", F.xxhash64(F.lit("local"), F.lit(seed), "h")).collect()]
    buckets, total = 64, len(rows)
    counts = [0] * buckets
    for r in rows:
        r["b"] = r["h"] % buckets
        counts[r["b"]] += 1
    # The matrix, with exact probabilities.
    rng, left = np.random.Generator(np.random.PCG64(seed)), [total // shards + (k < total % shards) for k in range(shards)]
    ends = []
    for want in counts:
        line, rest = [0] * shards, sum(left)
        for s in range(shards):
            if want == 0:
                break
            rest -= left[s]
            good, bad = left[s], rest
            if good and bad and want < good + bad:
                u, so_far, k = rng.random(), Fraction(0), max(0, want - bad)
                while k < min(good, want):
                    so_far += Fraction(math.comb(good, k) * math.comb(bad, want - k), math.comb(good + bad, want))
                    if u < so_far:
                        break
                    k += 1
                line[s] = k
            else:
                line[s] = min(good, want) if good else 0
            want -= line[s]
        left = [a - b for a, b in zip(left, line, strict=True)]
        ends.append(np.cumsum(line))
    by = defaultdict(list)
    for r in rows:
        by[r["b"]].append(r)
    for b, own in by.items():
        for rank, r in enumerate(sorted(own, key=lambda r: (r["local"], *(r[k] for k in keys)))):
            r["r"], r["shard"] = rank, int((ends[b] <= rank).sum())
    # The second permutation: slices by one hash, ranks in a slice by another.
    slices = max(4, -(-total // (shards * sharding.SLICE_ROWS)))
    placed = spark.createDataFrame([(r["doc_id"], r["h"], r["r"], r["b"], r["shard"]) for r in rows], "doc_id long, h long, r int, b int, shard int")
    placed = placed.withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), F.lit(seed), "h", "r", "b"), F.lit(slices))).withColumn("again", F.xxhash64(F.lit("again"), F.lit(seed), "h", "r", "b")).collect()
    want = {}
    for s in range(shards):
        for slot, r in enumerate(sorted((r for r in placed if r.shard == s), key=lambda r: (r.slice, r.again, r.b, r.r))):
            want[r.doc_id] = (s, slot)
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.op7_sharding(spark, SF).collect()} == want


# license scans


def test_labels_and_scores_by_hand(spark, documents, ugly):
    phrases = {**license_scan.BASE, **license_scan.NOTICES}

    def by_hand(text):
        text = text or ""
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        found = Counter(p for p in phrases for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        base, labels = {phrases[p] for p in found if p in license_scan.BASE}, {phrases[p] for p in found}
        places, families = sum(n for p, n in found.items() if p in license_scan.BASE), []
        for expression in re.findall(r"(?i:(?:SPDX-)?License-Identifier:)[ \t]*([^\r\n]*)", text):
            names, family = license_scan.evaluate(expression)
            labels |= {f"id:{n}" for n in names}
            families += [family] if family else []
        worst = max(families, key=license_scan.FAMILIES.index, default=None)
        labels |= {f"family:{worst}"} if worst else set()
        return ",".join(sorted(labels)), 1 - 0.5 ** (places + len(labels - base) + 2 * (worst is not None))

    tagged = spark.createDataFrame([(1, "// SPDX-License-Identifier: MIT OR GPL-2.0\nbsd license"), (2, "License-Identifier: (MIT"), (3, "SPDX-License-Identifier: MPL-2.0 AND Foo\nLicense-Identifier: CC0-1.0")], "doc_id long, text string")
    for df in (documents, ugly, tagged):
        got = Counter((r.doc_id, r.labels, r.score) for r in license_scan.scan_documents(df).collect())
        assert got == Counter((r.doc_id, *by_hand(r.text)) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize(
    ("expression", "family"),
    [
        ("LicenseRef-Proprietary WITH Foo-exception", "unknown"),
        ("MIT WITH Foo-exception", "permissive"),
        ("MITRE-closed", "unknown"),
        ("GPLish", "unknown"),
        ("CC-BY-SA-4.0", "strong-copyleft"),
        ("GPL-2.0+", "strong-copyleft"),
        ("(MIT OR BSD-3-Clause) AND (ISC OR Zlib) AND Apache-2.0 AND LGPL-3.0-only", "weak-copyleft"),
    ],
)
def test_families(expression, family):
    assert license_scan.evaluate(expression)[1] == family


# pipeline


def written(spark, tmp_path, docs):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (10, 1, 0), (11, 1, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_run_takes_ugly_rows(spark, tmp_path, ugly):
    d = written(spark, tmp_path, ugly)
    out = corpus_pipeline.run(spark, d)
    assert out.columns == [*[c for c in ugly.columns if c != "text"], "n_pieces", "pieces", "lossless"]
    rows = out.collect()
    assert all(r.lossless for r in rows) and {r.doc_id for r in rows} <= {1, 5, 6, 7, 8, 10, 11, 12, None}
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in corpus_pipeline.run(spark, d).collect())


def test_every_stage_takes_an_empty_table(spark, tmp_path, empty):
    d = written(spark, tmp_path, empty)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0
    assert corpus_pipeline.run(spark, d).count() == 0


def test_stages_on_null_empty_and_repeated_rows(spark, tmp_path, ugly):
    d = written(spark, tmp_path, ugly)
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    kept = ids(stages["quality rules"](spark, ugly, d))
    assert not {2, 3, 4, 9} & set(kept) and kept[1] == kept[10] == 1
    near = ids(stages["near duplicates"](spark, ugly, d))
    assert near[5] == 1 and near[6] == 0 and near[9] == 1 and near[2] + near[3] + near[4] + near[None] <= 2
    passages = ids(stages["repeated passages"](spark, ugly, d))
    assert passages[2] == passages[3] == passages[4] == 1 and passages[9] == 2 and passages[6] == 0
    mixed = ids(stages["source mix"](spark, ugly, d))
    assert all(n <= 2 * ids(ugly)[i] for i, n in mixed.items())
    pieces = stages["segmentation"](spark, ugly, d).collect()
    assert len(pieces) == ugly.count() and all(r.lossless and r.n_pieces == len(r.pieces) for r in pieces)
    assert max(r.n_pieces for r in pieces) > len(LONG) // 20


def test_the_shared_folder_is_empty_when_the_driver_has_ended(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
import corpus_pipeline
from tidemark.llm import registry
print("rows", corpus_pipeline.run(spark, "{SF}").count(), registry.QUERIES["op9_warc"](spark, "{SF}").count())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=False)
    assert "rows" in done.stdout, done.stderr[-2000:]
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []  # Spark leaves an empty folder of its own
