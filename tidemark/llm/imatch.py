"""I-Match fingerprints: sorted distinct mid-frequency terms, hashed over several randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency ln(N / df) lies from ln(MOST_COMMON) to ln(RAREST). A term
of the lexicon stands in at least 1 of RAREST documents, so the lexicon has at most RAREST times the mean number of
distinct terms of a document, however large the corpus: that is the bound of the only data that is gathered (one array).
Each term belongs to a random choice of SUBSETS subsets: subsets of group g keep 1 of 2 * 4 ** (g + 1) terms, so that
short and long texts both have subsets with a few of their terms. A subset's hash is the MD5 of the text's distinct terms in
it, sorted; "" if there are none. A text with fewer than LEAST terms in the subsets has, in place of all hashes, that of all
its distinct terms, or without any of its own text: it is like equal ones alone. The fingerprint joins the hashes. Likeness is
1 for equal fingerprints, else the share of subsets that agree among those that are not empty on both sides.

Everything is DataFrame functions. Document frequencies are pre-aggregated on the map side. The next document is found
by ranges of (id, hash of the text), cut at places from a sample of bounded size: within a range by a window, and across its
end by a copy of the next range's first row. The sample decides the cuts, and not the result.

Defined results: a null text is empty: n_chars 0. Ids are numbers, texts or dates. Null ids come first, equal ids are ordered
by a hash of the text; rows equal in both are interchangeable. One row alone is its own next document. An empty table
gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_COMMON, RAREST, LEAST = 3, 1000, 4
GROUPS, EACH = 3, 4
SUBSETS = GROUPS * EACH
#: Slots of the array in which a term is looked up by its hash.
SLOTS = 1 << 17
#: Rows in a range of ids, the most ranges, and the sampled rows for each.
RANGE_ROWS, RANGES, SAMPLED = 2_000, 20_000, 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), SEPARATORS))


def subset_mask(term: Column) -> Column:
    """Bits of the subsets a term belongs to: group g, member e if three hex digits of the MD5 allow it."""
    digest = F.md5(term.cast("binary"))
    mask = F.lit(0)
    for k in range(SUBSETS):
        value = F.conv(F.substring(digest, k + 1, 3), 16, 10).cast("int")
        mask = mask + F.when(value < 4096 // (2 * 4 ** (k // EACH + 1)), 1 << k).otherwise(0)
    return mask


def lexicon(documents: DataFrame, text: Column) -> DataFrame:
    """(term, mask) for the terms in the band."""
    total = documents.agg(F.count("*").alias("n"))
    counted = documents.select(F.explode(terms(text)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = total.scalar()
    band = counted.where((F.col("df") * RAREST >= n) & (F.col("df") * MOST_COMMON <= n) & (F.col("term") != ""))
    return band.select("term", subset_mask(F.col("term")).alias("mask"))


def lookup_arrays(lex: DataFrame) -> tuple[Column, Column]:
    """Two constant arrays over the hash slots: whether a slot is used, and the (term, mask) in it.

    The lexicon's size has a fixed bound. Terms that belong to no subset have no use here.
    """
    slot = F.pmod(F.xxhash64("term"), F.lit(SLOTS))
    entries: list[list] = [[] for _ in range(SLOTS)]
    for r in lex.select(slot.cast("int").alias("slot"), "term", "mask").collect():  # a filter on mask would run before the counting
        if r.mask:
            entries[r.slot].append({"term": r.term, "mask": r.mask})
    used = F.from_json(F.lit(json.dumps([bool(e) for e in entries])), "array<boolean>")
    return used, F.from_json(F.lit(json.dumps(entries, ensure_ascii=False)), "array<array<struct<term:string,mask:int>>>")


def subset_hashes(text: Column, lookup: tuple[Column, Column]) -> Column:
    """Array of SUBSETS hashes of the text."""
    used, entries = lookup

    def slot(word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")

    candidates = F.filter(terms(text), lambda word: F.get(used, slot(word)))
    found = F.transform(candidates, lambda word: F.get(F.filter(F.get(entries, slot(word)), lambda x: x["term"] == word), F.lit(0)))
    found = F.sort_array(F.filter(found, lambda x: x.isNotNull()))

    def hashed(mine: Column, bit: Column) -> Column:
        own = F.transform(F.filter(mine, lambda x: x["mask"].bitwiseAND(bit) != 0), lambda x: x["term"])
        return F.when(F.size(own) == 0, "").otherwise(F.substring(F.md5(F.concat_ws(" ", own).cast("binary")), 1, 16))

    every = F.array(*[F.lit(1 << k) for k in range(SUBSETS)])
    words = F.filter(terms(text), lambda word: word != "")
    plain = F.md5(F.when(F.size(words) == 0, text).otherwise(F.concat_ws(" ", F.sort_array(words))).cast("binary"))
    few = F.array_repeat(F.substring(plain, 1, 16), SUBSETS)
    # An array of one holds the terms found, so that they are found once and not again for each subset.
    return F.get(F.transform(F.array(found), lambda mine: F.when(F.size(mine) < LEAST, few).otherwise(F.transform(every, lambda bit: hashed(mine, bit)))), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    told = F.size(F.filter(pairs, lambda x: (x["a"] != "") | (x["b"] != "")))
    agree = F.size(F.filter(pairs, lambda x: (x["a"] != "") & (x["a"] == x["b"])))
    return F.when(a == b, 1.0).otherwise(agree / told)


def _bounds(rows: DataFrame, key: str, tie: str, total: int) -> list:
    """Places to cut the order of (key, tie) at: every SAMPLED-th row of a sample by hash, RANGES at most."""
    count = max(1, min(RANGES, -(-total // RANGE_ROWS)))
    step = max(1, total // (count * SAMPLED))
    some = rows.where(F.pmod(F.xxhash64(F.lit("bounds"), key, tie), F.lit(step)) == 0).select(key, tie).distinct() if count > 1 else None
    return [] if some is None else some.orderBy(F.col(key).asc_nulls_first(), tie).collect()[SAMPLED - 1 :: SAMPLED]


def _range_of(rows: DataFrame, key: str, tie: str, bounds: list) -> Column:
    """The number of bounds at or before (key, tie), by two levels of bounds, each of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    kind = f"struct<k:{rows.schema[key].dataType.simpleString()},t:{rows.schema[tie].dataType.simpleString()}>"
    plain = [{"k": b[0], "t": b[1]} for b in bounds]
    step = max(1, int(len(plain) ** 0.5))
    groups = [plain[k : k + step] for k in range(0, len(plain), step)]
    text = lambda x: F.lit(json.dumps(x, default=str, ensure_ascii=False))
    coarse, fine = F.from_json(text([g[0] for g in groups]), f"array<{kind}>"), F.from_json(text([[], *groups]), f"array<array<{kind}>>")
    own = F.struct(F.col(key).alias("k"), F.col(tie).alias("t"))
    first = F.size(F.filter(coarse, lambda x: x <= own))
    inner = F.size(F.filter(F.get(fine, first), lambda x: x <= own))
    return F.when(first > 0, (first - 1) * step + inner).otherwise(0)


def with_next(rows: DataFrame, carry: list[str], derive: dict[str, Column], *, key: str = "i", tie: str = "th") -> DataFrame:
    """rows with the columns of derive, and next_<c> for each c of carry and derive: that of the next row by (key, tie).

    After the last row comes the first. What derive has is worked out once for each row, before the exchange.
    """
    ranged = rows.withColumn("range", _range_of(rows, key, tie, _bounds(rows, key, tie, rows.count())))
    # The first row of each range is also put, as a ghost, at the end of the range before; that of the first range at the end of the last.
    firsts = ranged.groupBy("range").agg(F.min(F.struct(key, tie)).alias("first"))
    order = Window.orderBy("range")  # one row for each range, RANGES at most
    to = firsts.select(F.col("range").alias("_own"), "first", F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())).alias("_to"))
    same = (F.col("range") == F.col("_own")) & F.col(key).eqNullSafe(F.col("first")[key]) & F.col(tie).eqNullSafe(F.col("first")[tie])
    ghosts = ranged.join(F.broadcast(to), same).groupBy(F.col("_to").alias("range")).agg(*[F.first(c).alias(c) for c in [key, tie, *carry]])
    both = ranged.withColumn("ghost", F.lit(0)).unionByName(ghosts.withColumn("ghost", F.lit(1)), allowMissingColumns=True)
    span = Window.partitionBy("range").orderBy("ghost", F.col(key).asc_nulls_first(), tie)
    return both.withColumns(derive).select("*", *[F.lead(c).over(span).alias(f"next_{c}") for c in [*carry, *derive]]).where("ghost = 0").drop("ghost", "range")


def fingerprints(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, t, th, hashes): id, text (null: empty), hash of the text, subset hashes."""
    text = F.coalesce(text_col, F.lit(""))
    return documents.select(F.col(id_col).alias("i"), text.alias("t"), F.xxhash64(text).alias("th")).withColumn("hashes", subset_hashes(F.col("t"), _lookup(documents, text)))


def _lookup(documents: DataFrame, text: Column) -> tuple[Column, Column]:
    return lookup_arrays(lexicon(documents, text))


def compare_with_edits(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are to each other and to the next document's.

    The edited text has the last half of the code points replaced by the first as many (or all) of the next document.
    """
    text = F.coalesce(text_col, F.lit(""))
    lookup = _lookup(documents, text)
    plain = documents.select(F.col(id_col).alias("i"), text.alias("t"), F.xxhash64(text).alias("th"))
    near = with_next(plain, ["t"], {"own": subset_hashes(F.col("t"), lookup)})
    half = F.floor(F.length("t") / 2).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), F.length("t") - half), F.substring(F.col("next_t"), F.lit(1), half))
    rows = near.select("i", F.length("t").cast("long").alias("n_chars"), "own", F.col("next_own").alias("next"), edited.alias("e"))
    rows = rows.select("i", "n_chars", "own", "next", F.sha2("e", 256).alias("edited_sha256"), subset_hashes(F.col("e"), lookup).alias("edit"))
    return rows.select(
        F.col("i").alias(id_col), "n_chars", "edited_sha256", F.concat_ws("-", "own").alias("fingerprint"), F.concat_ws("-", "edit").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_FINGERPRINT = "list_transform(range({n}), lambda k: coalesce(list_filter(hs, lambda x: x.k = k)[1].h, ''))"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT unnest(list_distinct(string_split_regex(lower(t), '{SEPARATORS}'))) AS term FROM d),
df AS (SELECT term, count(*) AS df FROM w GROUP BY term),
lex AS (SELECT term, md5(term) AS m FROM df WHERE term <> '' AND df * {RAREST} >= (SELECT count(*) FROM documents) AND df * {MOST_COMMON} <= (SELECT count(*) FROM documents)),
bits AS (SELECT term, k FROM lex, range({SUBSETS}) r(k) WHERE CAST('0x' || substr(m, CAST(k AS INT) + 1, 3) AS INT) < 4096 // CAST(2 * 4 ** (k // {EACH} + 1) AS INT)),
e AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM d),
x AS (SELECT doc_id, t, n, substr(t, 1, n - n // 2) || substr(nt, 1, n // 2) AS et FROM e),
both_texts AS (SELECT doc_id, 'own' AS kind, t FROM x UNION ALL SELECT doc_id, 'edit', et FROM x),
words AS (SELECT doc_id, kind, unnest(list_distinct(string_split_regex(lower(t), '{SEPARATORS}'))) AS term FROM both_texts),
plain AS (SELECT doc_id, kind, string_agg(term, ' ' ORDER BY term) AS terms, count(*) FILTER (term IN (SELECT term FROM bits)) AS found FROM words WHERE term <> '' GROUP BY ALL),
h AS (SELECT doc_id, kind, k, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 16) AS h FROM words JOIN bits USING (term) GROUP BY ALL),
l AS (SELECT doc_id, kind, list({{'k': k, 'h': h}}) AS hs FROM h GROUP BY ALL),
f AS (SELECT b.doc_id, b.kind, CASE WHEN coalesce(p.found, 0) < {LEAST} THEN list_transform(range({SUBSETS}), lambda k: substr(md5(coalesce(p.terms, b.t)), 1, 16)) ELSE {_FINGERPRINT.format(n=SUBSETS)} END AS f
  FROM both_texts b LEFT JOIN plain p ON b.doc_id = p.doc_id AND b.kind = p.kind LEFT JOIN l ON b.doc_id = l.doc_id AND b.kind = l.kind),
o AS (SELECT doc_id, f, coalesce(lead(f) OVER (ORDER BY doc_id), first_value(f) OVER (ORDER BY doc_id)) AS nf FROM f WHERE kind = 'own'),
p AS (SELECT o.doc_id, o.f, o.nf, g.f AS ef FROM o JOIN f g ON g.doc_id = o.doc_id AND g.kind = 'edit'),
s AS (SELECT *, list_zip(f, ef) AS ze, list_zip(f, nf) AS zn FROM p)
SELECT s.doc_id, x.n AS n_chars, sha256(x.et) AS edited_sha256, array_to_string(s.f, '-') AS fingerprint, array_to_string(s.ef, '-') AS edited_fingerprint,
       CASE WHEN f = ef THEN 1.0::DOUBLE ELSE len(list_filter(ze, lambda z: z[1] <> '' AND z[1] = z[2]))::DOUBLE / len(list_filter(ze, lambda z: z[1] <> '' OR z[2] <> '')) END AS near_edited,
       CASE WHEN f = nf THEN 1.0::DOUBLE ELSE len(list_filter(zn, lambda z: z[1] <> '' AND z[1] = z[2]))::DOUBLE / len(list_filter(zn, lambda z: z[1] <> '' OR z[2] <> '')) END AS near_next
FROM s JOIN x USING (doc_id)
"""
