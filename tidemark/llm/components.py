"""Connected components of an edge table by alternating large-star and small-star steps.

Edges and labels stay distributed; each round is written to the shared folder, so lineage stays short and a lost
executor costs a task, not the run. A node's least neighbour is aggregated before any row is joined back, and rows of a
hub get it from a bounded broadcast list, so that a hub's links are not in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Stored, attach


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return attach(both, least, "u", "n", "v", total=2 * rows).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = attach(down, least, "u", "n", "v", total=rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(u long, v long), undirected -> (node, root): every node that is not the least of its component, with that least.

    Self-links and repeated links change nothing; an empty edge table gives an empty result; nulls are dropped.
    """
    now = Stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    state = None
    while True:
        rows = now.rows.count()  # from the files' footers
        # A large star has no more links than it is given, so its number bounds what the small star is given.
        new = Stored(_small_star(_large_star(now.rows, rows), rows), name)
        found = new.rows.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        now.discard()
        now = new
        if found == state or found[0] == 0:
            return now.rows.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = found
