"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014).

Every round is two DataFrame aggregations and joins over the edge table, so a
hub's neighbours are spread by Spark (partial minima before the shuffle, skewed
join partitions split at run time).  Each round's edges are written to the
shared folder; the loop ends when a round leaves the edge set unchanged, which
takes about log n rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versekit.llm.store import discard, keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (u > v)."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    j = both.join(low, "u")
    if large:
        out = j.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (j.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v"))))
    return out.filter(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, root): ``root`` is the smallest node reachable, for every node of an edge.

    Self-loops give a node of its own; edges with a null end are ignored.
    Nodes may be any orderable type.  No edge gives an empty table.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter(
        F.col("u").isNotNull() & F.col("v").isNotNull())
    start, start_path = keep(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    cur, path = start.filter(F.col("u") != F.col("v")), None
    state = _state(cur)
    while state[0]:
        nxt, nxt_path = keep(_star(_star(cur, True), False), "cc")
        new = _state(nxt)
        if path:
            discard(spark, path)
        cur, path = nxt, nxt_path
        if new == state:
            break
        state = new
    loops = start.filter(F.col("u") == F.col("v")).select(F.col("u").alias("node"), F.col("u").alias("root"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    members = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("root").alias("root"))
