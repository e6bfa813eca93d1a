"""Connected components of an undirected edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.plans.shared import materialise, skew_lookup

#: Edge tables up to this length are joined plainly: no node can have more rows in a task than that (64 MB).
PLAIN_EDGES = 4_000_000


def _to_least(edges: DataFrame, least: DataFrame, rows: int, plain: int) -> DataFrame:
    """(u, v, m) of every edge: m is what `least` (u, m, degree) has for u; a node of very many edges is dealt over salts."""
    if rows <= plain:
        return edges.join(least, "u")
    return skew_lookup(edges, materialise(least, "least"), "u", "degree", "v")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, plain: int = PLAIN_EDGES) -> DataFrame:
    """(node, root) for every node of a real edge; root is the smallest node id of its component.

    Self loops and null ends make no edge; nodes without an edge are absent. Every step only groups
    and joins on node ids, so no component is ever gathered in one task; the edges of a hub beyond
    `plain` are spread. Each round is written to the shared folder, so a lost executor never replays earlier rounds.
    """
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    now = materialise(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    rows, seen = now.count(), None
    pair = [F.col("v").alias("u"), F.col("m").alias("v")]
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = _to_least(both.filter("v > u"), least, rows, plain).select(*pair).filter("u <> v").distinct()
        if rows > plain:
            large = materialise(large, "edges")  # read twice below, and once more by the spread join
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        small = _to_least(large, least, rows, plain).select(*pair).filter("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(small, "edges")
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        rows = state[0]
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
