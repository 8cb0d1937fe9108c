"""Connected components of an edge table, by repeated contraction; nothing is collected.

Each round every node points at its smallest neighbour (or itself), pointers are jumped to roots,
and edges are rewritten between roots.  At least half of the non-isolated roots vanish in a round,
so the number of rounds is logarithmic.  State is cut to the checkpoint folder each round, by as
many tasks as the edges need: each task's file there costs its executor two forks (chmod).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


#: Rows of a task's file.
ROWS_A_TASK = 1 << 16


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, root): root is the smallest node of node's component.  Nodes without an edge are absent."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a") != F.col("b"))
    e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # No later table has more rows than the edges have ends.
    tasks = 2 * e.count() // ROWS_A_TASK + 1
    e = e.coalesce(tasks)
    maps = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")).coalesce(tasks))
        # Pointers only lead to smaller nodes; jumping doubles the distance each time.
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = cut(parent.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")).coalesce(tasks))
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        maps.append(parent)
        pa, pb = parent.select(F.col("node").alias("a"), F.col("root").alias("ra")), parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = e.join(pa, "a").join(pb, "b").where(F.col("ra") != F.col("rb"))
        e = cut(e.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct().coalesce(tasks))
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))  # empty
    out = maps[0]
    for m in maps[1:]:
        out = out.join(m.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return cut(out.coalesce(tasks)) if len(maps) > 1 else out
