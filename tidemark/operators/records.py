"""Record handling: deduplication, union and merge, fingerprints, schema changes, bronze, silver and gold tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import canonical_json, shard_index


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return F.sha2(canonical_json({c: F.col(c) for c in (columns or df.columns)}), 256)


def exact_dedup(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows without full copies, conflicts): conflicts are keys with several different contents."""
    unique = rows.dropDuplicates()
    conflicts = unique.groupBy(key).agg(F.count("*").alias("contents")).where("contents > 1")
    return unique, conflicts


def winner_dedup(rows: DataFrame, key: Sequence[str], order: Sequence[Column], source: str) -> DataFrame:
    """One row for each key: the least by the given total order, with contributors (sorted sources) and a reason.

    The least row and the set of sources are aggregates, so copies fold on the map side; no window holds a hot key.
    """
    rest = [c for c in rows.columns if c not in key]
    keyed = F.struct(*[c.alias(f"_o{k}") for k, c in enumerate(order)], *[F.col(c) for c in rest])
    out = rows.groupBy(*key).agg(F.min(keyed).alias("_w"), F.sort_array(F.collect_set(F.col(source).cast("string"))).alias("contributors"), F.count("*").alias("copies"))
    reason = F.when(F.col("copies") == 1, "unique").otherwise("least_source_order")
    return out.select(*key, *[F.col("_w")[c].alias(c) for c in rest], "contributors", "copies", reason.alias("reason"))


def merge_records(base: DataFrame, added: DataFrame, key: Sequence[str], prefer_added: bool = True) -> DataFrame:
    """All keys of both; where both have a key, the preferred side's row."""
    first, second = (added, base) if prefer_added else (base, added)
    return first.unionByName(second.join(first, list(key), "left_anti"), allowMissingColumns=True)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: an order-insensitive digest of the table's rows, with their number.

    Equal rows are counted first, so copies fold on the map side. Buckets by the digests' first two bytes hash their sorted
    digests with counts, and the result hashes the 65,536 buckets' hashes; no task holds the whole table.
    """
    digests = df.groupBy(row_digest(df, columns).alias("_d")).agg(F.count("*").alias("_n"))
    entry = F.concat_ws(":", "_d", F.col("_n").cast("string"))
    per = digests.groupBy(F.substring("_d", 1, 4).alias("_b")).agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(entry))), 256).alias("_h"), F.sum("_n").alias("_n"))
    return per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("_b", "_h"))), lambda x: x["_h"])), 256).alias("fingerprint"))


def fingerprints(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(by, rows, fingerprint): `fingerprint` of each group, in one pass."""
    digests = df.groupBy(by, row_digest(df, columns).alias("_d")).agg(F.count("*").alias("_n"))
    entry = F.concat_ws(":", "_d", F.col("_n").cast("string"))
    per = digests.groupBy(by, F.substring("_d", 1, 4).alias("_b")).agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(entry))), 256).alias("_h"), F.sum("_n").alias("_n"))
    return per.groupBy(by).agg(F.sum("_n").alias("rows"), F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("_b", "_h"))), lambda x: x["_h"])), 256).alias("fingerprint"))


def schema_change(df: DataFrame, *, add: dict[str, str] | None = None, rename: dict[str, str] | None = None, cast: dict[str, str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Optional columns added as nulls, columns renamed, cast and dropped."""
    out = df.drop(*drop)
    out = out.withColumns({c: F.col(c).cast(t) for c, t in (cast or {}).items()}).withColumnsRenamed(rename or {})
    return out.withColumns({c: F.lit(None).cast(t) for c, t in (add or {}).items()})


def bronze(df: DataFrame, subject: str, id_: Column, event_time: Column, source: str) -> DataFrame:
    """The raw envelope: subject, record id, event time, source and the payload as canonical JSON."""
    return df.select(F.lit(subject).alias("subject"), id_.cast("string").alias("record_id"), event_time.alias("event_time"), F.lit(source).alias("source"), canonical_json({c: F.col(c) for c in df.columns}).alias("payload"))


def silver(raw: DataFrame) -> DataFrame:
    return winner_dedup(raw, ["subject", "record_id"], [F.col("source"), F.col("payload")], "source")


def id_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, left_rows, right_rows) where the counts differ."""
    l, r = left.groupBy(key).agg(F.count("*").alias("left_rows")), right.groupBy(key).agg(F.count("*").alias("right_rows"))
    zero = F.lit(0).cast("long")
    both = l.join(r, key, "full").select(key, F.coalesce("left_rows", zero).alias("left_rows"), F.coalesce("right_rows", zero).alias("right_rows"))
    return both.where("left_rows <> right_rows")


def routed(rows: DataFrame, kind: str, shards: int, owners: Sequence[str] = ("customer_id", "account_id", "payer_account_id", "merchant_id", "payment_id")) -> DataFrame:
    """rows with logical_id (the first column named *_id), logical_type, source_id, partition_key (the first owner that is not null, else the id) and partition_id."""
    ids = [c for c in rows.columns if c.endswith("_id")]
    if not ids:
        raise ValueError(f"{kind}: no column names an id")
    logical = F.col(ids[0]).cast("string")
    key = F.coalesce(*[F.col(c).cast("string") for c in owners if c in rows.columns], logical)
    out = rows.withColumns({"logical_id": logical, "logical_type": F.lit(kind), "source_id": logical, "partition_key": key})
    return out.withColumn("partition_id", shard_index(F.col("partition_key"), shards))


def tagged_union(tables: dict[str, DataFrame], shards: int) -> DataFrame:
    """All tables as one, each row tagged with its table and shard; columns that a table lacks are null."""
    parts = [routed(t, kind, shards) for kind, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def verify_counts(sources: dict[str, DataFrame], written: DataFrame, kind: str = "subject") -> DataFrame:
    """violations(rule, key, detail): tables whose rows are not all in what was written, or of which there are more."""
    have = written.groupBy(F.col(kind).alias("key")).agg(F.count("*").alias("have"))
    want = None
    for name, t in sources.items():
        one = t.agg(F.count("*").alias("want")).select(F.lit(name).alias("key"), "want")
        want = one if want is None else want.unionByName(one)
    both = want.join(have, "key", "full").where(~F.col("want").eqNullSafe(F.coalesce("have", F.lit(0))))
    return both.select(F.lit("rows").alias("rule"), "key", F.concat_ws("/", F.col("have").cast("string"), F.col("want").cast("string")).alias("detail"))
