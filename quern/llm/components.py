"""Connected components of a distributed edge list: hook to the smallest neighbour, contract, repeat until no edge is left.

Every join reads two written tables, so a hub with very many edges is one hot key of a join that adaptive execution
splits; minima are pre-aggregated before their shuffle. Each round at least halves the vertices that are no local
minimum, and the loop ends only when no edge joins two different representatives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for every vertex of an edge; component is the smallest vertex reachable.

    Edges with a null end, loops and repeated edges add nothing; vertices without an edge to another are left out.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    e = saved(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    now = None
    while not e.isEmpty():
        ends = e.select(F.col("b").alias("v"), F.col("a").alias("n")).unionByName(e.select(F.col("a").alias("v"), F.col("a").alias("n")))
        up = saved(ends.groupBy("v").agg(F.min("n").alias("p")), "parents")
        # one jump: a vertex takes its parent's parent
        top = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
        up = saved(up.join(top, "p").select("v", F.col("q").alias("p")), "parents")
        old = now
        if old is None:
            now = up.select(F.col("v").alias("vertex"), F.col("p").alias("component"))
        else:
            step = up.select(F.col("v").alias("component"), F.col("p").alias("next"))
            now = saved(old.join(step, "component", "left").select("vertex", F.coalesce("next", "component").alias("component")), "labels")
        pa = up.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        pb = up.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        e = e.join(pa, "a").select("b", "pa").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        e = saved(e, "edges")
    if now is None:
        return edges.sparkSession.createDataFrame([], "vertex long, component long")
    return now
