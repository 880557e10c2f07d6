"""Sharding by rendezvous hashing over weighted shards.

Every shard draws a number from the record's key; the shard with the smallest draw, divided by its
weight, holds the record. A further shard only takes the records for which its own draw is smallest.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import running, without


def rendezvous(key: Column, shards: Mapping[int, float]) -> Column:
    """The shard of a key. shards: weight above 0 by shard number. Null keys share one shard."""
    known = F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.lit(int(s)).alias("shard")) for s, w in sorted(shards.items())])
    # 53 of the hash's bits as a number strictly between 0 and 1
    draw = lambda s: (F.shiftrightunsigned(F.xxhash64(key, s.shard, F.lit("shard")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.array_min(F.transform(known, lambda s: F.struct((-F.log(draw(s)) / s.weight).alias("score"), s.shard.alias("shard")))).shard


def assign(df: DataFrame, shards: Mapping[int, float], key_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """df with each row's shard; rows don't move.

    The key alone decides: rows that repeat a key share a shard, null keys among them. Of equal draws the
    smallest shard wins. An empty table gives an empty table. A column of this name is replaced.
    """
    return without(df, name).withColumn(name, rendezvous(F.col(key_col), shards))


def slots(df: DataFrame, order: list[str], shard_col: str = "shard", name: str = "slot") -> DataFrame:
    """df with each row's number within its shard, from 0 without gaps, in this order.

    Numbers are counted over range partitions, so a shard needn't fit a task. Rows that agree in all
    of order share out their numbers. Null shards are a shard, nulls in order come first. An empty table
    gives an empty table, a column of this name is replaced. Pass narrow rows: df is shuffled and written once.
    """
    return running(without(df, name), [shard_col], [F.col(c) for c in order], F.lit(1), name)
