"""Language ID, chunk dedup, quality rules, SimHash, segmentation and license scans against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import LONG, PASSAGE
from tidemark.llm import arrow_text as tx
from tidemark.llm import cdc_dedup, langid, license_scan, piece_sampling, quality_crf, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# language ID


def test_held_out_accuracy(spark):
    rows = langid.op1_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = rows.where("held_out").join(docs, "doc_id")
    right, n = held.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.97
    for r in rows.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1


def test_language_edges(spark, ugly, empty, documents):
    model = langid.train(documents)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(ugly, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (None, "und")} <= got and (7, "und") not in got
    assert langid.identify(ugly, model).count() == ugly.count()
    assert langid.identify(empty, model).count() == 0
    assert langid.train(empty).languages == ()
    assert {r.lang_pred for r in langid.identify(ugly, langid.Model(())).collect()} == {"und"}


def test_rare_languages_and_those_of_long_texts_are_learned(spark):
    rng = random.Random(9)
    rows = []
    for k in range(70):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(60)]
        rows += [(f"l{k:02}", " ".join(rng.choices(words, k=4000 if k == 69 else 80))) for _ in range(2)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    assert [code for code, _, _ in model.languages] == [f"l{k:02}" for k in range(70)]
    classify = langid.Classifier(model)
    assert all(classify(t.encode()[:500])[0] == code for code, t in rows[-20:])


# chunk dedup


def chunks_by_hand(text: bytes) -> list[tuple[int, int]]:
    """Cuts by a plain loop over the bytes."""
    cuts, last = [0], -10**9
    for p in range(1, len(text)):
        if text[p - 1] in b" \t\n\v\f\r" and text[p] not in b" \t\n\v\f\r" and p >= cdc_dedup.MIN_CHUNK:
            h = sum(int(cdc_dedup.GEAR[text[p - 1 - k]]) << k for k in range(cdc_dedup.WINDOW)) % (1 << 16)
            if h >> (16 - cdc_dedup.CUT_BITS) == 0:
                if p - last >= cdc_dedup.MIN_CHUNK:
                    cuts.append(p)
                last = p
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
        while a < b:
            e = min(b, a + cdc_dedup.MAX_CHUNK)
            while e < b and text[e] & 0xC0 == 0x80:
                e -= 1
            out.append((a, e))
            a = e
    return out


def test_chunks_equal_a_plain_loop():
    rng = random.Random(1)
    texts = [" ".join("abcdefgh"[: rng.randint(1, 8)] for _ in range(rng.randint(0, 300))) for _ in range(40)]
    data, at = tx.buffer_of(pa.array(texts))
    begin, end = cdc_dedup.cut_points(data, at)
    for k, t in enumerate(texts):
        mine = [(int(a - at[k]), int(b - at[k])) for a, b in zip(begin, end, strict=True) if at[k] <= a < at[k + 1]]
        assert mine == (chunks_by_hand(t.encode()) if t else [])


def test_insertions_shift_no_later_cut():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(2000)]
    chunk = lambda t: {t[a:b] for a, b in chunks_by_hand(t)}
    a, b = " ".join(words).encode(), " ".join([*words[:50], "inserted", *words[50:]]).encode()
    assert len(chunk(a) - chunk(b)) <= 3


@pytest.mark.parametrize("alphabet", ["".join(map(chr, range(0x4E00, 0x5600))), "".join(map(chr, range(0x0E01, 0x0E2F))), "abcdefghijklmnopqrstuvwxyz0123456789"])
def test_shifted_passages_without_spaces_are_found(spark, alphabet):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices(alphabet, k=n))
    rows, size = [], 600
    for k in range(30):
        passage = text(size)
        rows += [(2 * k, text(rng.randint(40, 400)) + passage + text(90)), (2 * k + 1, text(rng.randint(40, 400)) + passage + text(90))]
    got = {r.doc_id: r for r in cdc_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = len(text(size).encode())
    assert all(not got[2 * k].repeats and 0.4 * whole < got[2 * k + 1].repeated_bytes <= whole for k in range(30))


def test_unspaced_cuts_depend_on_their_own_row_alone():
    rng = random.Random(4)
    texts = ["".join(rng.choices("語日本のはをが漢字 ", (9, 9, 9, 9, 9, 9, 9, 9, 9, 1), k=rng.randint(0, 300))) for _ in range(60)]
    data, at = tx.buffer_of(pa.array(texts))
    begin, end = cdc_dedup.cut_points(data, at)
    for k, t in enumerate(texts):
        alone = cdc_dedup.cut_points(*tx.buffer_of(pa.array([t])))
        mine = (begin >= at[k]) & (begin < at[k + 1])
        assert (begin[mine] - at[k]).tolist() == alone[0].tolist() and (end[mine] - at[k]).tolist() == alone[1].tolist()
        for a in alone[0]:
            t.encode()[a:].decode()


def test_repeated_passages_are_found_and_clean_texts_left(spark, ugly, empty):
    got = {r.doc_id: r for r in cdc_dedup.report(ugly).collect()}
    assert got[11].repeated_bytes > 0.6 * len(PASSAGE) and "quite another beginning" in got[11].kept_text and "finish" in got[11].kept_text
    assert got[6].kept_text == "" and not got[10].repeats and not got[1].repeats and not got[12].repeats and not got[9].repeats
    assert all(len(r.kept_text.encode()) == r.n_bytes - r.repeated_bytes for r in got.values())
    kept = cdc_dedup.remove_repeats(ugly)
    assert kept.columns == ugly.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert ids[6] == 0 and ids[9] == 2 and ids[3] == ids[2] == 1 and ids[None] == 2
    assert cdc_dedup.remove_repeats(empty).count() == 0 == cdc_dedup.report(empty).count()


def test_repeats_equal_brute_force(spark, documents):
    first, want = {}, {}
    rows = sorted(((r.doc_id, r.text) for r in documents.collect()), key=lambda r: r[0])
    th = {i: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64) for i, t in rows}
    for i, t in rows:
        b = t.encode()
        for s, e in chunks_by_hand(b):
            first.setdefault(b[s:e], []).append((i, th[i], s))
    for i, t in rows:
        b, spans = t.encode(), []
        for s, e in chunks_by_hand(b):
            if min(first[b[s:e]]) != (i, th[i], s):
                spans.append((s, e - s))
        want[i] = cdc_dedup.passages(spans)
    got = {r.doc_id: [(x.start, x.end) for x in r.repeats] for r in cdc_dedup.report(documents).collect()}
    assert got == want


# quality rules


def base_by_hand(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(spark, documents, ugly):
    for df in (documents, ugly):
        model = quality_crf.START
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_crf.score_documents(df, model).collect())
        want = Counter((r.doc_id, *(b := base_by_hand(r.text)), b[0] < 10 or 100 * b[4] > 20 * b[0]) for r in df.select("doc_id", "text").collect())
        assert got == want


def test_viterbi_equals_enumeration():
    rng = random.Random(3)
    for _ in range(50):
        n, moves = rng.randint(1, 8), [[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)]
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        value = lambda y: sum(s for s, b in zip(scores, y, strict=True) if b) + sum(moves[a][b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        best = max(value([k >> j & 1 for j in range(n)]) for k in range(1 << n))
        assert value(quality_crf.viterbi(scores, moves)) == pytest.approx(best)


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality_crf.op3_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    by = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert by.get((1, False), 0) == 0 and by.get((0, True), 0) <= 0.15 * by[(0, False)]


def test_quality_filter_keeps_columns(spark, ugly, empty):
    kept = quality_crf.filter_documents(ugly, quality_crf.START)
    assert kept.columns == ugly.columns and {1, 10, 11} <= {r.doc_id for r in kept.collect()}
    assert quality_crf.filter_documents(empty, quality_crf.START).count() == 0


# SimHash


def print_by_hand(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(ids, prints, radius):
    root = list(range(len(ids)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(ids)):
        groups.setdefault(find(k), []).append(ids[k])
    return {k: min((i for i in groups[find(k)] if i is not None), default=None) for k in range(len(ids))}


def test_simhash_equals_brute_force(spark, documents, ugly):
    for df in (documents, ugly):
        rows = df.select("doc_id", "text").collect()
        prints = [print_by_hand(r.text) for r in rows]
        roots = components_by_hand([r.doc_id for r in rows], prints, 2)
        want = Counter((r.doc_id, f"{p:016x}", roots[k]) for k, (r, p) in enumerate(zip(rows, prints, strict=True)))
        assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == want


def test_links_survive_tiles_of_any_size(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = list({centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (2**64 - 1) for _ in range(300)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(k, p) for k, p in enumerate(signed)], "node long, fp long")
    want = components_by_hand(list(range(len(prints))), prints, 2)
    for tile in (8, 64, 4096):
        root = list(range(len(prints)))
        find = lambda x: x if root[x] == x else find(root[x])  # noqa: B023, E731
        for r in simhash.links(nodes, simhash.block_keys(2), ["fp"], 2, tile).collect():
            assert (prints[r.u] ^ prints[r.v]).bit_count() <= 64
            a, b = find(r.u), find(r.v)
            root[max(a, b)] = min(a, b)
        assert {k: find(k) for k in range(len(prints))} == want


def test_similar_documents_are_grouped(spark, empty, ugly):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=rng.randint(2, 9)))
    base = [[word() for _ in range(400)] for _ in range(12)]
    rows = []
    for k, words in enumerate(base):
        rows.append((10 * k, " ".join(words)))
        for c in range(1, 4):
            near = list(words)
            for _ in range(c):
                near[rng.randrange(len(near))] = word()
            rows.append((10 * k + c, " ".join(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit("x"))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [10 * k for k in range(12)]
    assert simhash.keep_one(empty).count() == 0
    ids = Counter(r.doc_id for r in simhash.keep_one(ugly).collect())
    assert ids[5] == 1 and ids[6] == 0 and ids[9] == 1 and ids[1] == 1 and sum(ids[k] for k in (2, 3, 4)) + ids[None] <= 2


def test_appended_and_truncated_copies_are_grouped_and_no_others(spark):
    """Pairs whose shingle sets have a similarity of exactly 0.8, 0.85, 0.9 by a contiguous edit, and just under 0.8."""
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, want = [], set()
    for size, edits in ((104, (25, 17, 11, 26)), (404, (100, 70, 44, 101))):
        for extra in edits:
            for shape in range(60):
                base, more, k = text(size), text(extra), 2 * len(rows)
                edited = [[*base, *more], [*more, *base]][shape % 2]  # appended or put before; the shorter one is the truncated copy
                pair = [" ".join(base), " ".join(edited)]
                rows.append(((k, pair[shape % 3 > 0]), (k + 1, pair[shape % 3 == 0])))
                want |= {k} if extra not in (26, 101) else {k, k + 1}
    df = spark.createDataFrame([r for pair in rows for r in pair], "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(df).select("doc_id").collect()} == want


def test_groups_equal_brute_force_over_shingle_sets(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    words = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in words]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(least.get(find(k), r.doc_id), r.doc_id)
    assert {r.i: r.first_i for r in simhash.similar_groups(documents).collect()} == {r.doc_id: least[find(k)] for k, r in enumerate(rows)}


# segmentation


@pytest.fixture(scope="session")
def vocabulary():
    return piece_sampling.load()


def test_round_trip_and_reproducible(spark, documents, ugly, empty, vocabulary):
    for df in (documents, ugly, empty):
        coded = piece_sampling.encode(df, vocabulary)
        back = piece_sampling.decode(coded.select("doc_id", "n_pieces", "pieces", "lossless"), vocabulary)
        assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in df.collect())
        assert coded.where("not lossless or n_pieces <> size(pieces)").count() == 0
        again = piece_sampling.encode(df.repartition(3), vocabulary)
        key = lambda x: Counter((r.doc_id, tuple(r.pieces)) for r in x.collect())
        assert key(coded) == key(again)


def test_samples_follow_the_lattice_law(vocabulary):
    """Frequencies of whole segmentations of a word against their exact probabilities."""
    text, n = " the", 20_000
    weight = {t.decode(): (int(i), float(w)) for t, i, w in ((vocabulary.texts[i], i, w) for i, w in zip(vocabulary.ids, vocabulary.weights, strict=True))}
    paths = {}

    def walk(at, ids, p):
        if at == len(text):
            paths[tuple(ids)] = p
        for e in range(at + 1, len(text) + 1):
            if text[at:e] in weight:
                i, w = weight[text[at:e]]
                walk(e, [*ids, i], p * w)

    walk(0, [], 1.0)
    total = sum(paths.values())
    ids, at = piece_sampling.sample([text] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919), piece_sampling.Lattices(vocabulary))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(at, at[1:], strict=False))
    assert set(seen) <= set(paths)
    for path, p in paths.items():
        assert abs(seen[path] / n - p / total) < 5 * (p / total / n) ** 0.5 + 1e-3


# license scans


def test_license_places_equal_brute_force(spark, documents, ugly):
    def by_hand(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        return len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))

    for df in (documents, ugly):
        got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan_documents(df).collect())
        assert got == Counter((r.doc_id, *by_hand(r.text)) for r in df.collect())


@pytest.mark.parametrize(
    ("expression", "names", "family"),
    [
        ("MIT", {"mit"}, "permissive"),
        ("(MIT OR GPL-2.0-only) AND Apache-2.0", {"mit", "gpl-2.0-only", "apache-2.0"}, "permissive"),
        ("MIT AND GPL-3.0-or-later", {"mit", "gpl-3.0-or-later"}, "strong-copyleft"),
        ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2.0-only"}, "weak-copyleft"),
        ("MIT OR LGPL-2.1 AND GPL-2.0", {"mit", "lgpl-2.1", "gpl-2.0"}, "permissive"),
        ("AND MIT", {"mit"}, None),
        ("(MIT", {"mit"}, None),
    ],
)
def test_expressions(expression, names, family):
    assert license_scan.evaluate(expression) == (names, family)


def test_tags_add_labels_and_base_stays():
    got = license_scan.scan("SPDX-License-Identifier: MIT OR Apache-2.0\nMIT license text", license_scan.automaton())
    assert got[1] == 1 and got[4] == "mit" and set(got[5].split(",")) == {"mit", "id:mit", "id:apache-2.0", "family:permissive"} and 0 < got[6] <= 1


def test_long_text_is_read_whole():
    assert license_scan.scan(LONG + "MIT license", license_scan.automaton())[1] == 1


def test_malformed_expressions_keep_all_their_identifiers():
    names, family = license_scan.evaluate("(MIT OR Apache-2.0 OR BSD-3-Clause OR ISC OR Zlib")
    assert names == {"mit", "apache-2.0", "bsd-3-clause", "isc", "zlib"} and family is None
