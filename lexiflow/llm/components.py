"""Connected components of an edge table by contraction.

In each round every node points to the smallest of itself and its neighbours, edges are
renamed to where their ends point, and edges within one name vanish. A star ends after two
rounds at most, and long chains shrink by a factor each round. All state is in checkpointed
tables; the driver sees only counts.

An edge with a null end is none. Repeated edges and loops change nothing; an empty table has no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root) for every node of an edge; root is the component's smallest node."""
    left = cut(edges.select("a", "b").where("a <> b").distinct())
    steps = []
    while not left.isEmpty():
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the checkpoint also drops the partitioning, so the joins below bring exchanges
        # of their own, and Spark can split the partition of a hub
        step = cut(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
        steps.append(step)
        to_a, to_b = step.select(F.col("node").alias("a"), F.col("root").alias("ra")), step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = left.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        left = cut(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0]
    for step in steps[1:]:
        further = step.select(F.col("node").alias("root"), F.col("root").alias("_to"))
        found = found.join(further, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return cut(found)
