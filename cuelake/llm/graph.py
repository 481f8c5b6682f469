"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import remove, write_table

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the least node around each node: the larger ones of them, or the smaller and the node itself."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    around = both.select(F.col("src").alias("node"), F.col("dst").alias("other"))
    if not large:
        around = around.where("other < node")
    least = around.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
    joined = around.join(least, "node")
    out = joined.where("other > node" if large else "other != least").select(F.col("least").alias("src"), F.col("other").alias("dst"))
    if not large:
        out = out.union(least.select(F.col("least").alias("src"), F.col("node").alias("dst")))
    return out.where("src != dst").distinct()


def connected_components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, component): the least node of each node's component, for every node that an edge names.

    Large-star and small-star alternate, which takes about log2 of the longest path's length. Each round
    is written to the shared folder, and the round before it is deleted. No task gathers a component: the
    joins are by node, and only sums and minima are grouped. Self-links, repeated edges and edges with a
    null are ignored.
    """
    spark = edges.sparkSession
    clean = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where(
        "src is not null and dst is not null and src < dst"
    )
    path = write_table(clean, "components")
    state, seen = spark.read.schema(clean.schema).parquet(path), None
    for _ in range(rounds):
        after = _star(_star(state, large=True), large=False)
        new_path = write_table(after, "components")
        state = spark.read.schema(clean.schema).parquet(new_path)
        remove(spark, path)
        path = new_path
        # a star forest repeats: as many edges, and the same sum over them
        now = state.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return state.select(F.col("dst").alias("node"), F.col("src").alias("component")).union(state.select("src", "src").distinct())
