"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows fall into buckets by a hash (the partitions of the algorithm, independent of files and tasks). How many rows each
bucket sends to each shard is drawn at once, exactly, from the multivariate hypergeometric law, so shard sizes differ
by one row at most. A draw inverts the law itself, at every size alike: probabilities as ratios to that of the mode, summed
outwards until what is left cannot change a double. Each bucket is permuted locally and dealt out by its row of the matrix; after the exchange each
shard is permuted again, in slices whose offsets are prefix sums of their counts, so no shard needs one task.

Only bucket counts (BUCKETS at most) and the matrix (BUCKETS x shards) are on the driver and broadcast; both bounds are
fixed. Row order comes from seeded hashes of the row: reruns agree, whatever the partitioning.

Defined results: null texts have size OVERHEAD and the CRC of no bytes. Repeated rows are dealt out as rows of their
own; rows equal in every key column are interchangeable, and share a bucket unless `numbered` has told them apart. An empty table gives an empty table. All columns are kept;
columns named shard and slot are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import Stored, free_names, materialize, numbered

SHARDS, OVERHEAD, SEED = 40, 16, 23
BUCKETS, BUCKET_ROWS, SLICE_ROWS, SLICES = 4096, 2_000, 2_000, 4096


def communication_matrix(counts: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """counts of rows by bucket -> rows each bucket sends to each shard; columns sum to shard sizes at most one apart."""
    total = int(counts.sum())
    left = np.full(shards, total // shards, np.int64)
    left[: total % shards] += 1
    rng = np.random.Generator(np.random.PCG64(seed))
    matrix = np.zeros((len(counts), shards), np.int64)
    for k, n in enumerate(counts):
        row, rest, want = matrix[k], int(left.sum()), int(n)
        for s in range(shards):
            if want == 0:
                break
            rest -= int(left[s])
            row[s] = _hypergeometric(rng, int(left[s]), rest, want)
            want -= int(row[s])
        left -= row
    return matrix


def hypergeometric_law(good: int, bad: int, sample: int) -> tuple[int, np.ndarray]:
    """The least number of good ones with a probability that counts, and the probabilities from there on.

    By the ratios of neighbouring probabilities, from the mode outwards: no factorial, so any size is exact to rounding.
    """
    least, most = max(0, sample - bad), min(good, sample)
    mode = min(max((good + 1) * (sample + 1) // (good + bad + 2), least), most)
    spread = (sample * (good / (good + bad)) * (bad / (good + bad)) * ((good + bad - sample) / max(1, good + bad - 1))) ** 0.5
    reach = int(12 * spread) + 40
    while True:
        low, high = max(least, mode - reach), min(most, mode + reach)
        k = np.arange(low, high, dtype=np.float64)  # the ratio of the probabilities of k + 1 and k
        steps = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
        logs = np.concatenate([[0.0], np.cumsum(steps)])
        weight = np.exp(logs - logs[mode - low])
        if (low == least or weight[0] < 1e-20) and (high == most or weight[-1] < 1e-20):
            return low, weight / weight.sum()
        reach *= 2


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    if good == 0 or sample == 0:
        return 0
    if bad == 0 or sample == good + bad:
        return min(good, sample)
    low, chances = hypergeometric_law(good, bad, sample)
    return low + min(int(np.searchsorted(np.cumsum(chances), rng.random(), "right")), len(chances) - 1)


def shuffle_into_shards(rows: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (gapless from 0 in each shard); keys: columns that tell rows apart."""
    spark = rows.sparkSession
    h, b, r, g, b2, ends, shard2, g2, before_ = free_names(rows, "h", "bucket", "rank", "slice", "bucket2", "ends", "shard2", "slice2", "before")
    stored = Stored(rows.withColumn(h, F.xxhash64(F.lit(seed), *keys)), "shards")  # what rows are made from is read once
    rows = stored.rows
    total = rows.count()
    if not total:
        return rows.drop(h).withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    buckets = int(min(BUCKETS, max(64, -(-total // BUCKET_ROWS))))
    rows = rows.withColumn(b, F.pmod(F.col(h), F.lit(buckets)).cast("int"))
    counts = np.zeros(buckets, np.int64)
    for x in rows.groupBy(b).count().collect():  # at most BUCKETS rows
        counts[x[0]] = x[1]
    cumulative = np.cumsum(communication_matrix(counts, shards, seed), axis=1)
    matrix = spark.createDataFrame([(k, [int(c) for c in line]) for k, line in enumerate(cumulative)], f"{b2} int, {ends} array<long>")
    # Permute locally: rank in the bucket by a second hash of the row.
    rows = rows.withColumn(r, F.row_number().over(Window.partitionBy(b).orderBy(F.xxhash64(F.lit("local"), F.lit(seed), h), *keys)) - 1)
    rows = rows.join(F.broadcast(matrix), F.col(b) == F.col(b2))
    rows = rows.withColumn("shard", F.size(F.filter(ends, lambda end: end <= F.col(r))).cast("int")).drop(b2, ends)
    slices = int(min(SLICES, max(4, -(-total // (shards * SLICE_ROWS)))))
    rows = rows.withColumn(g, F.pmod(F.xxhash64(F.lit("slice"), F.lit(seed), h, r, b), F.lit(slices)).cast("int"))
    rows = materialize(rows, "shards")
    stored.discard()
    # Permute again: slices of a shard come in order, and within a slice the rank by a third hash.
    sizes = rows.groupBy("shard", g).count()
    before = sizes.select(F.col("shard").alias(shard2), F.col(g).alias(g2), (F.sum("count").over(Window.partitionBy("shard").orderBy(g)) - F.col("count")).alias(before_))
    rank = F.row_number().over(Window.partitionBy("shard", g).orderBy(F.xxhash64(F.lit("again"), F.lit(seed), h, r, b), b, r)) - 1
    rows = rows.withColumn("slot", rank)
    rows = rows.join(before, (F.col("shard") == F.col(shard2)) & (F.col(g) == F.col(g2)))
    return rows.withColumn("slot", (F.col("slot") + F.col(before_)).cast("long")).drop(h, b, r, g, shard2, g2, before_)


def write_shards(rows: DataFrame, keys: list[str], path: str, shards: int = SHARDS) -> None:
    """The shuffled rows as Parquet, a folder for each shard, in slot order within each file."""
    out = shuffle_into_shards(rows, keys, shards)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffle_into_shards(numbered(docs, "copy"), ["doc_id", "size", "text_crc32", "copy"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
