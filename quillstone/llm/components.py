"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import discard, materialize


def _stars(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the least of u and its neighbours as m.

    The minima are a table of their own, so that the join may split a node that very many share.
    """
    least = materialize(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "stars").withColumnRenamed("u", "w")
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    s = _stars(down)
    linked = s.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(s.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) to (id, component): the least node that each node of an edge reaches.

    Each round is written to the shared folder; rounds grow with the logarithm of the nodes. Edges
    may repeat, point either way, or join a node to itself. Nulls join nothing.
    """
    nodes = edges.where("u is not null and v is not null")
    now = materialize(nodes.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        new = materialize(_small(_large(now)), "edges")
        discard(now)
        old, state, now = state, _state(new), new
        if state == old:
            break
    # now holds a star for each component
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
