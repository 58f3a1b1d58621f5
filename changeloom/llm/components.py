"""Connected components by alternating large and small stars, a few shuffles of the links a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rounds grow with the logarithm of the longest path; far more than any graph needs.
MAX_ROUNDS = 60
#: Links that one file of a round holds, so that a few links are not many small files.
FILE_LINKS = 500_000


def _neighbours_to_least(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or its not larger) neighbours to the least of its neighbours and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges  # (a, b) with a < b; here b looks at its smaller neighbours
        both = both.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("least").alias("a"), F.col("b"))
    else:
        out = joined.select(F.col("least").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return out.filter("a < b").distinct()


def connected_components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``id, component`` (the smallest id reachable) for every node of ``links`` (a, b).

    Repeated links, loops and either order are fine; null ends are dropped. ``start`` (id, component), an earlier
    result, is taken in as links. An empty table gives no row. Each round is written to the shared folder, and the one before it deleted.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if start is not None:
        edges = edges.unionByName(start.select(F.col("component").alias("a"), F.col("id").alias("b")))
    scratch = Scratch(links.sparkSession)
    edges = scratch.write(edges.filter("a < b").distinct(), "edges")
    before, files = None, -(-edges.count() // FILE_LINKS) or 1  # links never grow in number
    for _ in range(MAX_ROUNDS):
        edges = scratch.write(_neighbours_to_least(_neighbours_to_least(edges, True), False).coalesce(files), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    ids = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    out = scratch.write(ids.unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()).coalesce(2 * files), "components")
    scratch.drop("edges")
    return out
