"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is one shuffle by node with map-side minima and a table in the
shared folder; nothing but a row count reaches the driver.  Hot nodes do not
gather their neighbours: minima are aggregated map-side, and the minima of the
nodes that hold more than a partition's share of all edges, of which there are
at most as many as partitions, go out to the edges instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenspark.llm.shared import cut, forget, parts


def _hung(edges: DataFrame, least: DataFrame, hot: float) -> DataFrame:
    """edges (u, v) with the minimum m of their node u; least: (u, m, d) with the node's number of edges d.

    Nodes of `hot` edges and more, no more than there are partitions, are named
    first; their minima go out to the edges, which are not shuffled for them.
    """
    hubs = least.where(F.col("d") >= hot).select("u", "m").collect()  # at most as many rows as partitions
    if not hubs:
        return edges.join(least.select("u", "m"), "u")
    few = F.broadcast(edges.sparkSession.createDataFrame(hubs, least.select("u", "m").schema))
    others = edges.join(few.select("u"), "u", "left_anti").join(least.select("u", "m"), "u")
    return edges.join(few, "u").unionByName(others)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest reachable node.

    Null ends and self-edges are ignored; an empty edge table gives an empty result.
    """
    now = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "edges",
    )
    before, total = None, now.count()
    while total:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a node that holds so many of the 2 * total ends is a hub: there are no more of them than partitions
        hot = 2 * total / parts(now.sparkSession)
        # large star: every larger neighbour is hung on the least of the node and its neighbours
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("d"))
        large = _hung(both.where("v > u"), least, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its smaller neighbours are hung on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        small = _hung(large, least, hot).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        # a fingerprint of the edge set tells when a round changes nothing
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(now)
        now, total = after, mark[0]
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
