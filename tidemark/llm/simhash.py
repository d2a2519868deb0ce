"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius.

Fingerprints are made distinct before anything is compared. Distinct fingerprints are dealt by every choice of
BLOCKS - radius blocks of their bits: two fingerprints within the radius agree on at least one choice, so no link can be
missed. The fingerprints that share a choice are compared exactly in tiles with numpy exclusive-or and bit counts, and
tile pairs whose population counts differ by more than the radius are skipped. A choice shared by more than TILE
fingerprints is split by population count and hash into tiles, each pair of tiles being its own unit of work, so a hot
group spreads over many tasks. A unit emits links that connect its members (a spanning set), not all pairs.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any other. Repeated
rows have equal fingerprints and one component. A null id never becomes a component id unless the whole component has
null ids. An empty table gives an empty table. Other columns are ignored, or carried through by `keep_one`.

`similar_groups` serves similarities of shingle sets, at which 64 bits cannot tell documents apart cheaply: minima of
hashes of the shingles deal the documents, the same tiles compare wider prints, and the sets decide what prints leave open,
the nearest pairs first and then, inside the tiles' tasks, all that these leave apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import arrow_text as tx
from tidemark.llm.components import components
from tidemark.llm.shared import Stored, attach, configure, free_names, materialize

RADIUS, SHINGLE, SEED = 2, 3, 42
#: For similarities: bits of the prints over shingles, the minima in a band, and the share of pairs at the similarity that
#: may share no band.
SHINGLE_BITS, BAND_MINIMA, MISSED = 1024, 4, 1e-4
#: Standard deviations of a print's distance below which a pair is linked unseen, and above which it is not looked at.
SURE, DOUBT = 6, 8
BLOCKS = 5
TILE = 4096
#: Masks of the 5 blocks of 13, 13, 13, 13 and 12 bits.
_BLOCK_MASKS = [((1 << (13 if k < 4 else 12)) - 1) << (13 * k) for k in range(BLOCKS)]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half the shingles' XXH64 (repeats included); no word: 0."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=at[1:])
    hashing = xxhash.xxh64_intdigest
    hashes = np.fromiter([hashing(line[a:b], SEED) for a, b in zip(at[:-shingle].tolist(), (at[shingle:] - 1).tolist(), strict=True)], np.uint64, len(words) - shingle + 1)
    return int(_majority(hashes[:, None])[0])


def _majority(hashes: np.ndarray) -> np.ndarray:
    """hashes: a row of 64-bit words for each feature -> the words whose bits are set in over half the rows."""
    n, width = hashes.shape
    set_bits = np.zeros(64 * width, np.int64)
    for start in range(0, n, 255):  # sums of up to 255 bits fit in a byte
        rows = np.ascontiguousarray(hashes[start : start + 255]).astype("<u8").view(np.uint8)
        set_bits += np.add.reduce(np.unpackbits(rows, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * set_bits > n, bitorder="little").view("<u8")


def fingerprints(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, fp): the id and the fingerprint as a signed long, one row for each document."""
    configure(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))

    def run(batches):
        for batch in batches:
            for part, data, at in tx.chunks(batch, "t"):
                fps = np.array([fingerprint(t) for t in tx.text_list(data, at)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([tx.column(part, "i"), pa.array(fps)], ["i", "fp"])

    return docs.mapInArrow(run, f"i {docs.schema['i'].dataType.simpleString()}, fp long")


def near(left: np.ndarray, right: np.ndarray, radius: int, roots: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and distances of the pairs of fingerprints (rows of 64-bit words) within the radius; both sides in order of population count.

    roots: what each side's fingerprints are known to belong to; pairs within one root are left out.
    """
    a, b, d = [], [], []
    pl, pr = np.bitwise_count(left).sum(1, dtype=np.int32), np.bitwise_count(right).sum(1, dtype=np.int32)
    step = 512
    for i in range(0, len(left), step):
        for j in range(0, len(right), step):
            x, y = pl[i : i + step], pr[j : j + step]
            if int(x[0]) > int(y[-1]) + radius or int(y[0]) > int(x[-1]) + radius:
                continue
            differ = np.zeros((len(x), len(y)), np.uint16)
            for k in range(left.shape[1]):
                differ += np.bitwise_count(left[i : i + step, k, None] ^ right[None, j : j + step, k])
            found = differ <= radius
            if roots is not None:
                found &= roots[0][i : i + step, None] != roots[1][None, j : j + step]
            p, q = np.nonzero(found)
            a.append(p + i)
            b.append(q + j)
            d.append(differ[p, q])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b), np.concatenate(d)) if a else (none, none, none)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n members the least member that the links (a, b) reach."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, root[a], root[b])
        np.minimum.at(new, root[b], root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b) at distance d the nearest ones that connect all that the pairs connect, beyond what root does.

    In each turn every part takes its nearest pair to another part, and parts that a pair joins become one.
    """
    order = np.argsort(d, kind="stable")
    a, b, left, right = a[order], b[order], [], []
    while True:
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
        if not len(a):
            return (np.concatenate(left), np.concatenate(right)) if left else (a, b)
        best = np.full(len(root), len(a))
        np.minimum.at(best, root[a], np.arange(len(a)))
        np.minimum.at(best, root[b], np.arange(len(a)))
        pick = np.unique(best[best < len(a)])
        left.append(a[pick])
        right.append(b[pick])
        root = spanning(root[a[pick]], root[b[pick]], len(root))[root]


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of what is compared: a tile with itself (side 0), or rows of side 1 with those of side 2."""
    return (np.arange(len(side)),) * 2 if side[0] == 0 else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))


def _links_of_unit(node: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int, sure: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links that connect what lies within `sure`, and the nearest pairs within the radius that connect what these leave apart.

    Ends, whether a link is sure, and the places of what has pairs that were left out.
    """
    one, two = _sides(side)
    if not len(one) or not len(two):
        return node[:0], node[:0], np.zeros(0, bool), np.zeros(0, np.int64)
    a, b, _ = near(fp[one], fp[two], sure)
    root = spanning(one[a], two[b], len(node))
    own = np.flatnonzero(root != np.arange(len(node)))
    u, v = node[own], node[root[own]]
    if sure == radius:
        return u, v, np.ones(len(u), bool), own[:0]
    a, b, d = near(fp[one], fp[two], radius, (root[one], root[two]))
    a, b = one[a], two[b]
    i, j = forest(a, b, d, root)
    times = 2 if side[0] == 0 else 1  # a tile against itself finds each pair both ways
    open_ = np.unique(np.append(a, b)) if len(a) > times * len(i) else own[:0]
    return np.append(u, node[i]), np.append(v, node[j]), np.arange(len(u) + len(i)) < len(u), open_


def _by_population(fp: np.ndarray) -> np.ndarray:
    return np.argsort(np.bitwise_count(fp).sum(1, dtype=np.int32), kind="stable")


def block_keys(radius: int) -> Column:
    """For a 64-bit fingerprint fp: every choice of BLOCKS - radius blocks; fingerprints within the radius share one at least."""
    masks = [sum(_BLOCK_MASKS[k] for k in chosen) for chosen in combinations(range(BLOCKS), BLOCKS - radius)]
    return F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def units(nodes: DataFrame, keys: Column, words: list[str], radius: int, tile: int = TILE, more: tuple[str, ...] = ()) -> DataFrame:
    """nodes(node long, words... long, more...), distinct -> (key, side, node, words..., more...): what is compared, unit by unit.

    The nodes of a key are one unit; a key with more than `tile` is cut by population count and hash into tiles, and each
    pair of tiles that can hold a link is a unit of its own. No key gathers in one task.
    """
    rest = [*words, *more]
    dealt = nodes.select("node", *rest, F.explode(keys).alias("key"))
    many = dealt.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").withColumn("n", F.col("rows"))
    sized = attach(dealt, many, "key", "rows", "node", total=dealt.count())
    small = sized.where(F.col("n") <= tile).select("key", F.lit(0).alias("side"), "node", *rest)
    cut = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    step = radius + 1
    pop = F.floor(sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0])) / step).cast("int")
    large = sized.where(F.col("n") > tile).select("key", "node", *rest, pop.alias("pop"), (F.pmod(F.xxhash64(F.lit("tile"), "node"), cut)).cast("int").alias("part"), cut.alias("cut"))
    large = large.select("*", F.explode(F.array(*[F.lit(g) for g in (-1, 0, 1)])).alias("gap")).select("*", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("other"))
    here, there = F.struct("pop", "part"), F.struct((F.col("pop") + F.col("gap")).alias("pop"), F.col("other").alias("part"))
    side = F.when(here == there, 0).when(here < there, 1).otherwise(2).cast("int")
    large = large.select(F.xxhash64("key", F.least(here, there), F.greatest(here, there)).alias("key"), side.alias("side"), "node", *rest)
    return small.unionByName(large)


Arrays = dict[str, np.ndarray]


def _per_unit(rows: DataFrame, words: list[str], work: Callable[[Arrays, np.ndarray], list[np.ndarray]], schema: str) -> DataFrame:
    """`work` on many whole units at a time: their columns (words in one array, fp), sorted by key, and where the units start.

    A column of lists becomes an array of arrays. A task holds a little more than one Arrow batch, or its largest unit.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    plain = [c for c in rows.columns if c not in words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Arrays] = []
        count, last = 0, None

        def flush() -> pa.RecordBatch:
            all_ = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            cuts = np.flatnonzero(np.append(True, all_["key"][1:] != all_["key"][:-1]))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in work(all_, np.append(cuts, len(all_["key"])))], names)

        for batch in batches:
            new = {c: _objects(tx.column(batch, c)) if pa.types.is_list(tx.column(batch, c).type) else tx.column(batch, c).to_numpy(zero_copy_only=False) for c in plain}
            if not len(new["key"]):
                continue
            new["fp"] = np.column_stack([tx.column(batch, w).to_numpy() for w in words]).view(np.uint64)
            if held and count > 1 << 15 and new["key"][-1] != last:  # whole units only; the open one stays
                stop = int(np.searchsorted(new["key"], new["key"][-1]))
                held.append({c: x[:stop] for c, x in new.items()})
                yield flush()
                held, count, new = [], 0, {c: x[stop:] for c, x in new.items()}
            held.append(new)
            count, last = count + len(new["key"]), new["key"][-1]
        if held:
            yield flush()

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _objects(lists: pa.ListArray) -> np.ndarray:
    values, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    out = np.empty(len(lists), object)
    for k in range(len(lists)):
        out[k] = values[at[k] : at[k + 1]]
    return out


def links(nodes: DataFrame, keys: Column, words: list[str], radius: int, tile: int = TILE, sure: int | None = None) -> DataFrame:
    """nodes(node long, words... long), distinct -> (kind, key, side, u, v): links that connect all fingerprints within the radius that share a key.

    kind 0 is a link, with key 0. With `sure`, links connect all within that lesser radius; kind 1 are, in each unit, the nearest
    pairs within the radius that connect what those leave apart, and kind 2 (u = v) the unit's members with more such pairs. So a
    unit's rows are bounded by its members, and never all its pairs.
    """
    sure = radius if sure is None else sure

    def work(rows: Arrays, cuts: np.ndarray) -> list[np.ndarray]:
        key, node, fp, side, size = rows["key"], rows["node"], rows["fp"], rows["side"], np.diff(cuts)
        one = cuts[:-1][size == 2]
        two = one + 1
        distance = np.bitwise_count(fp[one] ^ fp[two]).sum(1, dtype=np.int32)
        ok = (distance <= radius) & ((side[one] == 0) | (side[one] != side[two]))
        zero = np.zeros(int(ok.sum()), np.int64)
        found = [((distance[ok] > sure).astype(np.int64), zero, zero, np.minimum(node[one], node[two])[ok], np.maximum(node[one], node[two])[ok])]
        for a, b in zip(cuts[:-1][size > 2].tolist(), cuts[1:][size > 2].tolist(), strict=True):
            order = a + _by_population(fp[a:b])
            u, v, certain, open_ = _links_of_unit(node[order], fp[order], side[order], radius, sure)
            zero, more = np.zeros(len(u), np.int64), order[open_]
            found.append(((~certain).astype(np.int64), zero, zero, np.minimum(u, v), np.maximum(u, v)))
            found.append((np.full(len(more), 2), key[more], side[more].astype(np.int64), node[more], node[more]))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    return _per_unit(units(nodes, keys, words, radius, tile), words, work, "kind long, key long, side long, u long, v long").distinct()


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) for each document; component_id is the least id reachable over links."""
    prints = materialize(fingerprints(documents, id_col=id_col, text_col=text_col), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("i").alias("node"), F.count("*").alias("n")), "simhash")
    # One id may carry several fingerprints (repeated ids) or be null: nodes are numbered by a hash where the id is not unique.
    nodes = distinct.select("fp", F.col("fp").alias("node"))
    found = components(links(nodes, block_keys(radius), ["fp"], radius).select("u", "v"), "simhash")
    rooted = materialize(distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "node", "n", F.coalesce("root", "fp").alias("root")), "simhash")
    least = rooted.groupBy("root").agg(F.min("node").alias("component_id"), F.count("*").alias("prints"))
    by_print = attach(rooted, least, "root", "prints", "fp").select("fp", "component_id", "n")
    out = attach(prints.withColumn("spread", F.xxhash64("i")), by_print, "fp", "n", "spread")
    return out.select(F.col("i").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _features(data: np.ndarray, at: np.ndarray, shingle: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles; of fewer words than a shingle the whole sequence; no word: none."""
    low = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    starts, ends = tx.spans(tx.WORD_BYTES[low], at)
    rows, hashes = tx.rows_of(starts, at), tx.SpanHashes(low)(starts, ends)
    first, windows = tx.window_hashes(hashes, rows, shingle)
    n = len(at) - 1
    word_at, window_at = np.searchsorted(rows, np.arange(n + 1)), np.searchsorted(rows[first], np.arange(n + 1))
    out = []
    for k in range(n):
        own, part = hashes[word_at[k] : word_at[k + 1]], windows[window_at[k] : window_at[k + 1]]
        if len(own) and not len(part):
            part = tx.mix(np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED)], np.uint64))
        out.append(np.unique(part))
    return out


def _wide(features: list[np.ndarray], bands: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set of features the hashes of `bands` bands of BAND_MINIMA minima each, and a print of SHINGLE_BITS bits.

    Two sets of similarity s have equal minima with probability s, and so a band in common with that of s ** BAND_MINIMA.
    """
    turns, odd = np.random.Generator(np.random.PCG64(31)).integers(0, 1 << 63, (2, bands * BAND_MINIMA), dtype=np.uint64)
    odd = odd << np.uint64(1) | np.uint64(1)
    least, prints = np.zeros((len(features), len(odd)), np.uint64), np.zeros((len(features), SHINGLE_BITS // 64), np.uint64)
    for k, own in enumerate(features):
        if len(own):
            least[k] = np.minimum.reduce([((own[j : j + 4096, None] ^ turns) * odd).min(0) for j in range(0, len(own), 4096)])
            prints[k] = _spread(own, SHINGLE_BITS // 64)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(features), bands))
    for j in range(BAND_MINIMA):
        keys = tx.mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, j::BAND_MINIMA])
    return keys, prints


def _spread(hashes: np.ndarray, count: int) -> np.ndarray:
    """A fingerprint of count 64-bit words, each word from hashes of its own."""
    offsets = np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _majority(tx.mix(hashes[:, None] + offsets[None, :]))


def similar_groups(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(i, th, first_i, first_th): for each document (id and XXH64 of its text) the least one of its group of near-duplicates.

    Documents are linked if their sets of shingles have at least the given Jaccard similarity. Which are compared is dealt by
    bands of minima of the sets, as many as miss a pair at that similarity in MISSED of cases, whatever the edit's shape, and
    pairs more alike in fewer. The distance of SHINGLE_BITS-bit prints tells pairs that are SURE standard deviations within
    what is expected at the similarity (its angle has the cosine 2s / (1 + s)), which are linked, and those DOUBT beyond,
    which are not; the sets themselves decide all pairs between that known links do not connect.
    """
    configure(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    deep = [f"s{k}" for k in range(SHINGLE_BITS // 64)]
    bands = math.ceil(math.log(MISSED) / math.log1p(-(min(similarity, 0.99) ** BAND_MINIMA)))

    def run(batches):
        for batch in batches:
            for part, data, at in tx.chunks(batch, "t"):
                keys, prints = (x.view(np.int64) for x in _wide(_features(data, at, shingle), bands))
                th = np.array([xxhash.xxh64_intdigest(t, SEED) for t in tx.text_list(data, at)], np.uint64).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(len(th) + 1, dtype=np.int32) * bands, pa.array(np.ascontiguousarray(keys).ravel()))
                yield pa.RecordBatch.from_arrays([tx.column(part, "i"), pa.array(th), lists, *(pa.array(np.ascontiguousarray(c)) for c in prints.T)], ["i", "th", "bands", *deep])

    kind = docs.schema["i"].dataType.simpleString()
    prints = materialize(docs.mapInArrow(run, f"i {kind}, th long, bands array<long>, " + ", ".join(f"{c} long" for c in deep)).withColumn("node", F.xxhash64("bands", *deep)), "simhash")
    nodes = materialize(prints.groupBy("node").agg(*[F.first(c).alias(c) for c in ("bands", *deep)], F.min(F.struct("i", "th")).alias("least"), F.count("*").alias("n")), "simhash")
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    mean, deviation = SHINGLE_BITS * share, math.sqrt(SHINGLE_BITS * share * (1 - share))
    sure, radius = round(mean - SURE * deviation), round(mean + DOUBT * deviation)
    pairs = Stored(links(nodes, F.col("bands"), deep, radius, sure=sure), "simhash")
    doubtful = pairs.rows.where("kind = 1").select("u", "v")
    some = Stored(_sets(docs, nodes, doubtful.select(F.explode(F.array("u", "v")).alias("node")), shingle), "simhash")
    known = Stored(pairs.rows.where("kind = 0").select("u", "v").unionByName(_verified(doubtful, some.rows, similarity)), "simhash")
    some.discard()
    listed = pairs.rows.where("kind = 2").select("key", "side", F.col("u").alias("node"))
    rest = _open_links(docs, nodes, listed, components(known.rows, "simhash"), deep, radius, shingle, similarity)
    found = components(known.rows.unionByName(rest.rows), "simhash")
    for done in (pairs, known, rest):
        done.discard()
    rooted = materialize(nodes.select("node", "least", "n").join(found, "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("root")), "simhash")
    first = attach(rooted, rooted.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("members")), "root", "members", "node").select("node", "first", "n")
    out = attach(prints.select("i", "th", "node", F.xxhash64("i").alias("spread")), first, "node", "n", "spread")
    return out.select("i", "th", F.col("first.i").alias("first_i"), F.col("first.th").alias("first_th"))


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, own): the sets of shingles of the wanted nodes, worked out from the texts of their least documents."""
    own = nodes.select("node", F.col("least.i").alias("wi"), F.col("least.th").alias("wth")).join(wanted.select("node").distinct(), "node", "left_semi")
    hashed = docs.withColumn("th", F.xxhash64(F.coalesce("t", F.lit(""))))
    texts = hashed.join(own, F.col("i").eqNullSafe(F.col("wi")) & (F.col("th") == F.col("wth"))).select("node", "t").dropDuplicates(["node"])

    def run(batches):
        for batch in batches:
            for part, data, at in tx.chunks(batch, "t"):
                own = _features(data, at, shingle)
                ends_at = np.cumsum([0, *map(len, own)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([tx.column(part, "node"), pa.ListArray.from_arrays(ends_at, pa.array(np.concatenate(own).view(np.int64)))], ["node", "own"])

    return texts.mapInArrow(run, "node long, own array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the pairs of nodes whose sets of shingles have the similarity."""
    a, b = sets.select(F.col("node").alias("u"), F.col("own").alias("a")), sets.select(F.col("node").alias("v"), F.col("own").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").where(common / (F.size("a") + F.size("b") - common) >= similarity).select("u", "v")


def _open_links(docs: DataFrame, nodes: DataFrame, listed: DataFrame, roots: DataFrame, words: list[str], radius: int, shingle: int, similarity: float) -> Stored:
    """(u, v): links between nodes of different roots whose sets have the similarity; listed(key, side, node): members of units.

    Each unit with several roots gets its members' sets and compares, nearest first, the pairs within the radius that what is linked
    by then does not connect. The pairs stay inside the task, and a unit has fewer links than members.
    """
    rooted = Stored(listed.join(roots, "node", "left").select("key", "side", "node", F.coalesce("root", "node").alias("root")), "simhash")
    several = rooted.rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    open_ = Stored(rooted.rows.join(several, "key", "left_semi"), "simhash")
    sets = Stored(_sets(docs, nodes, open_.rows, shingle).join(nodes.select("node", *words), "node"), "simhash")

    def compare(rows: Arrays, cuts: np.ndarray) -> list[np.ndarray]:
        us, vs = [], []
        for a, b, d in _apart(rows, cuts, radius):
            joined: dict[int, int] = {}

            def find(x: int, joined: dict[int, int] = joined) -> int:
                while x in joined:
                    x = joined[x]
                return x

            for k in np.argsort(d, kind="stable").tolist():
                i, j = int(a[k]), int(b[k])
                p, q = find(int(rows["root"][i])), find(int(rows["root"][j]))
                if p != q and _jaccard(rows["own"][i], rows["own"][j], similarity) >= similarity:
                    joined[max(p, q)] = min(p, q)
                    us.append(rows["node"][i])
                    vs.append(rows["node"][j])
        return [np.array(us, np.int64), np.array(vs, np.int64)]

    out = Stored(_per_unit(open_.rows.join(sets.rows, "node"), words, compare, "u long, v long"), "simhash")
    for done in (rooted, open_, sets):
        done.discard()
    return out


def _apart(rows: Arrays, cuts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each unit the places and distances of its pairs within the radius and of different roots, each pair once."""
    node, fp, side, root, size = rows["node"], rows["fp"], rows["side"], rows["root"], np.diff(cuts)
    one = cuts[:-1][size == 2]
    one = one[(root[one] != root[one + 1]) & ((side[one] == 0) | (side[one] != side[one + 1]))]
    distance = np.bitwise_count(fp[one] ^ fp[one + 1]).sum(1, dtype=np.int32)
    for k in np.flatnonzero(distance <= radius).tolist():
        yield one[k : k + 1], one[k : k + 1] + 1, distance[k : k + 1]
    for start, stop in zip(cuts[:-1][size > 2].tolist(), cuts[1:][size > 2].tolist(), strict=True):
        if (root[start:stop] == root[start]).all():
            continue
        order = start + _by_population(fp[start:stop])
        left, right = _sides(side[order])
        if not len(left) or not len(right):
            continue
        a, b, d = near(fp[order[left]], fp[order[right]], radius, (root[order[left]], root[order[right]]))
        a, b = order[left[a]], order[right[b]]
        once = (node[a] < node[b]) | (side[start] != 0)
        if once.any():
            yield a[once], b[once], d[once]


def _jaccard(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Of two sorted sets; 0 where their sizes alone keep it below `least`."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def keep_one(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id, with all its columns.

    Texts without a word are near-duplicates of each other. Rows with the same id and text are one document.
    """
    groups = similar_groups(documents, id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity)
    name, i, th = free_names(documents, "own", "i", "th")
    firsts = groups.select(F.col("first_i").alias(i), F.col("first_th").alias(th)).distinct()
    hashed = documents.withColumn(name, F.xxhash64(F.coalesce(text_col, F.lit(""))))
    kept = hashed.join(firsts, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(name) == F.col(th)), "left_semi")
    return kept.dropDuplicates([id_col, name]).drop(name)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
