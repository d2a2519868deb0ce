"""Mixing sources to target weights by the cube method (balanced sampling).

Each source's words are taken at a rate of target / size (0 to 2): a document is taken floor(rate) times for certain and
once more with probability pi, the rate's fraction. Which documents get the extra copy is decided by the cube method's
flight phase: three open documents at a time, their probabilities move along the null-space vector of the constraints
(document count, word count) until one becomes 0 or 1, so both totals stay exactly as expected. Flights run in blocks of
about BLOCK documents of one source; the at most two documents each leaves open fly again among themselves, until a
source fits in one block. There its LAND largest open documents wait while the others fly, and the small problem that
remains lands at once: a seeded draw among the choices whose words are within SLACK of the target.

Everything depends on the rows alone (hashes of ids and sizes, never the partitioning): reruns agree.

Targets: sources in code-point order, null last, weigh 3, 1, 2 in turn and share SHARE of all words; a target stops at
2 times its source's words and the excess is reshared by weight.

Defined results: null text has size 0, and a document of size 0 is taken 0 words. A source without words has target 0.
Repeated rows are documents of their own: equal ones are numbered, so that they fall into different blocks. An empty table
gives an empty table. `mix` keeps all columns and repeats rows;
rows equal in id and text are there one document taken as often as all of them together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import arrow_text as tx
from tidemark.llm.shared import Stored, attach, configure, free_name, free_names, materialize, numbered

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
BLOCK, LAND, SLACK, SEED, TEXT_SEED = 2_000, 10, 0.001, 17, 42


def sized(documents: DataFrame, *, text_col: str = "text", out: str = "size") -> DataFrame:
    """The documents without their text, with the number of its words; th is a hash of the text."""
    configure(documents.sparkSession)
    rest = [c for c in documents.columns if c != text_col]
    docs = documents.select(*rest, F.col(text_col).alias(text_col))
    schema = documents.select(*rest).schema.add(out, "long").add(free_name(documents, "th"), "long")

    def run(batches):
        for batch in batches:
            for part, data, at in tx.chunks(batch, text_col):
                starts, _ = tx.spans(tx.WORD_BYTES[data], at)
                th = np.array([xxhash.xxh64_intdigest(t, TEXT_SEED) for t in tx.text_list(data, at)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(tx.column(part, c) for c in rest), pa.array(np.bincount(tx.rows_of(starts, at), minlength=len(part)).astype(np.int64)), pa.array(th)], schema.names)

    return docs.mapInArrow(run, schema)


def targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, size) -> (source, source_size, n_docs, target), one row for each source.

    Only sums reach the driver: in each round the sources above their cap are fixed there, and the rest is reshared.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # Sources are numbered in ranges, since there may be as many as documents; the ranges' sizes are few.
    order = F.col("source").asc_nulls_last()
    ranged = Stored(totals.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "mix")
    before = ranged.rows.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_r")) - F.col("_n"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1 + F.col("_before")
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (number % len(WEIGHTS)).cast("int"))
    placed = ranged.rows.join(F.broadcast(before), F.col("_range") == F.col("_r"))
    table = materialize(placed.select("source", "source_size", "n_docs", weight.alias("weight")), "mix")
    ranged.discard()
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, cap = 0.0, F.col("source_size") * CAP
    while True:
        capped = cap <= F.lit(level) * F.col("weight")
        fixed, open_weight = table.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        if not open_weight:
            break
        new = (SHARE * total - (fixed or 0.0)) / open_weight
        if new <= level:
            break
        level = new
    return table.select("source", "source_size", "n_docs", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def _uniforms(key: np.ndarray, salt: int) -> np.ndarray:
    return (tx.mix(key.astype(np.int64).view(np.uint64) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def flight(pi: np.ndarray, size: np.ndarray, coin: np.ndarray) -> np.ndarray:
    """Probabilities after the flight: all but at most two are 0 or 1; the sums of pi and of pi * size do not change."""
    out = pi.astype(float).copy()
    sizes, coins = size.tolist(), coin.tolist()
    held: list[int] = []
    eps = 1e-9
    for k in range(len(out)):
        if out[k] <= eps or out[k] >= 1 - eps:
            out[k] = round(out[k])
            continue
        held.append(k)
        if len(held) < 3:
            continue
        a, b, c = held
        s, t, u = sizes[a], sizes[b], sizes[c]
        move = (t - u, u - s, s - t)  # orthogonal to (1, 1, 1) and to the three sizes
        if move == (0, 0, 0):
            move = (1.0, -1.0, 0.0)
        up = min((1 - p) / m if m > 0 else p / -m for p, m in zip((out[a], out[b], out[c]), move, strict=True) if m)
        down = min(p / m if m > 0 else (1 - p) / -m for p, m in zip((out[a], out[b], out[c]), move, strict=True) if m)
        by = up if coins[k] * (up + down) < down else -down
        held = []
        for j, m in zip((a, b, c), move, strict=True):
            p = out[j] + by * m
            if p <= eps or p >= 1 - eps:
                out[j] = round(p)
            else:
                out[j] = p
                held.append(j)
        while len(held) > 2:  # rounding kept all three open
            j = min(held, key=lambda j: min(out[j], 1 - out[j]))
            out[j] = round(out[j])
            held.remove(j)
    return out


def land(pi: np.ndarray, size: np.ndarray, coin: float, slack: float) -> np.ndarray:
    """0 or 1 for each of at most LAND + 2 documents: drawn by probability among the choices whose words are off by at
    most `slack`, or by the least possible; among these the counts off by the least."""
    n = len(pi)
    choice = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    off = np.abs(choice @ size.astype(float) - pi @ size)
    near = np.flatnonzero(off <= max(slack, off.min()) + 1e-9)
    count = np.abs(choice[near].sum(1) - pi.sum())
    near = near[count <= count.min() + 1e-9]
    weight = np.exp((np.log(np.where(choice[near] == 1, pi, 1 - pi))).sum(1))
    at = np.searchsorted(np.cumsum(weight), coin * weight.sum(), "right")
    return choice[near[min(int(at), len(near) - 1)]].astype(float)


def _fly(level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "size", "pi"], kind="stable").reset_index(drop=True)
        pi, size, coin = pdf["pi"].to_numpy().copy(), pdf["size"].to_numpy(), _uniforms(pdf["r"].to_numpy(), level)
        if not pdf["last"].iloc[0]:
            pdf["pi"] = flight(pi, size, coin)
            return pdf
        # The source's last flight: its largest open documents wait for the landing, where they can offset each other.
        open_ = np.flatnonzero((pi > 0) & (pi < 1))
        wait = open_[np.argsort(-size[open_], kind="stable")[:LAND]]
        fly = np.setdiff1d(np.arange(len(pi)), wait)
        pi[fly] = flight(pi[fly], size[fly], coin[fly])
        rest = np.flatnonzero((pi > 0) & (pi < 1))
        if len(rest):
            pi[rest] = land(pi[rest], size[rest], float(coin[rest[0]]), SLACK * float(pdf["target"].iloc[0]))
        pdf["pi"] = pi
        return pdf

    return run


def copies(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """rows(source, size, r, ...) with r a hash of the row -> with source_size, target and copies (0, 1 or 2)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.coalesce(F.concat(F.lit("."), F.col("source").cast("string")), F.lit(""))
    small = tables.select(key.alias("_source"), "source_size", "n_docs", "target", F.col("n_docs").alias("_rows"))
    known = attach(rows.withColumn("_source", key), small, "_source", "_rows", "r").drop("_source")
    known = known.withColumn("sure", F.floor(F.least(rate, F.lit(CAP)) + 1e-12).cast("int")).withColumn("pi", F.greatest(F.lit(0.0), F.least(rate, F.lit(CAP)) - F.col("sure")))
    most = tables.agg(F.max("n_docs")).first()[0] or 0
    blocks, level, done, now = F.ceil(F.col("n_docs") / BLOCK).cast("long"), 0, [], known
    while True:
        own = F.greatest(F.lit(1), blocks)
        dealt = now.withColumn("last", own == 1).withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), "r"), own))
        flown = materialize(dealt.groupBy("source", "block").applyInPandas(_fly(level), dealt.schema).drop("block", "last"), "mix")
        most = -(-most // BLOCK)
        closed = F.col("pi").isin(0.0, 1.0)
        done.append(flown.where(closed))
        if most <= 1:
            break
        # At most two of each block stay open; they fly again in blocks of what is left.
        now, level, most, blocks = flown.where(~closed), level + 1, 2 * most, F.ceil(2 * blocks / BLOCK).cast("long")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("copies", F.col("sure") + F.col("pi").cast("int")).drop("sure", "pi", "n_docs")


def allocate(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(i, th, size, source_size, target, copies) for each document; th is a hash of the text."""
    plain = documents.select(F.col(id_col).alias("i"), F.col(source_col).alias("source"), F.col(text_col).alias("t"))
    rows = materialize(numbered(sized(plain, text_col="t"), "copy"), "mix")
    keyed = rows.withColumn("r", F.xxhash64(F.lit(SEED), "i", "th", "copy")).drop("copy")
    return copies(keyed, targets(rows))


def mix(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents: each row as often as it is taken."""
    plan = allocate(documents, id_col=id_col, text_col=text_col, source_col=source_col)
    i, th, own, times, rows = free_names(documents, "i", "th", "own", "copies", "rows")
    # Rows with the same id and text are one key: their copies add up, and one of them is repeated that often.
    mine = plan.groupBy(F.col("i").alias(i), F.col("th").alias(th)).agg(F.sum("copies").alias(times), F.count("*").alias(rows)).where(F.col(times) > 0)
    hashed = documents.withColumn(own, F.xxhash64(F.coalesce(text_col, F.lit(""))))
    both = hashed.join(mine, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(own) == F.col(th)))
    each = both.where(F.col(rows) == 1).unionByName(both.where(F.col(rows) > 1).dropDuplicates([i, th]))
    return each.select(*documents.columns, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int"))).alias(own)).select(*documents.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = allocate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select(F.col("i").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")
