"""Randomness that depends on seeds alone: a counter-based 32-bit generator, shuffles, hash orders."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.operators.tables import discard, materialize, running

#: Fixed values of the mulberry32 generator (public domain): its step and multiplier masks.
STEP, M32 = 0x6D2B79F5, 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """Product modulo 2^32 of numbers below 2^32, by halves: a whole product would overflow a bigint."""
    return ((((F.shiftrightunsigned(a, 16) * b).bitwiseAND(0xFFFF)) * 65536) + a.bitwiseAND(0xFFFF) * b).bitwiseAND(M32)


def mulberry32(seed: Column, k: Column) -> Column:
    """Draw k (from 1) of the generator with this seed, between 0 and 1. The state before draw k is
    seed + k * STEP, so draws don't depend on one another."""
    a = (seed.cast("bigint") + _times(k.cast("bigint").bitwiseAND(M32), F.lit(STEP).cast("bigint"))).bitwiseAND(M32)
    t = _times(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + _times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(M32))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)


def draws(seed: int) -> Iterator[float]:
    """The same generator in plain Python."""
    a = seed & M32
    while True:
        a = (a + STEP) & M32
        t = ((a ^ a >> 15) * (a | 1)) & M32
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & M32)) & M32
        yield ((t ^ t >> 14) & M32) / 4294967296


def shuffled(items: Sequence, seed: int) -> list:
    """Fisher-Yates from the end."""
    out, r = list(items), draws(seed)
    for i in range(len(out) - 1, 0, -1):
        j = int(next(r) * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def hash_order(seed: int, row_id: Column) -> list[Column]:
    """A uniform order that any engine with MD5 can repeat."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string"))), row_id]


def replay_order(cells: DataFrame, seed_of: Callable[[str], int], stratum: str = "stratum", row_id: str = "row_id", content: str | None = None, first: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(stratum, row_id, place, *keep) of cells: place (from 1) in each stratum's shuffle, as shuffled() goes.

    Cells start in the order of their content hash, then of the id as text, nulls last; rows that repeat an id
    take a place each. first: only so many places of each stratum. keep: further columns of cells.

    No stratum meets in one task. Step i of the shuffle, from the last cell to the first, swaps places i and
    j <= i, and draw j depends on i alone, so steps are rows. Step p fixes place p: it takes what lies at j,
    which the last step before it that drew j has brought there from its own place, where in turn a step
    may have brought it from further up. These links are disjoint chains, about as long as the
    logarithm of the stratum at most, and are followed by pointer jumping: a few rounds of joins.
    """
    narrow = cells.select(F.col(stratum).cast("string").alias("stratum"), F.col(row_id).alias("row_id"), *keep, *[F.col(c).alias("__content") for c in [content] if c], F.col(row_id).cast("string").alias("__text"))
    order = [F.col(c).asc_nulls_last() for c in narrow.columns if c in ("__content", "__text")]
    sizes = narrow.groupBy(F.col("stratum").alias("__name")).agg(F.count("*").alias("__n"))
    seed = F.udf(lambda s: seed_of(s) & M32, "long")(F.col("__name"))
    sizes = materialize(sizes.select("__name", "__n", seed.alias("__seed"), F.monotonically_increasing_id().alias("__s")), "strata")
    start = running(narrow, ["stratum"], order, F.lit(1), "__i").join(sizes, F.col("stratum").eqNullSafe(F.col("__name")))
    draw = F.floor(mulberry32(F.col("__seed"), F.col("__n") - F.col("__i")) * (F.col("__i") + 1))
    steps = materialize(start.select("__s", "__i", draw.alias("__j"), "stratum", "row_id", *keep), "steps")

    same = Window.partitionBy("__s", "__j").orderBy("__i")
    links = materialize(steps.select("__s", "__i", "__j", F.lead("__i").over(same).alias("__next"), F.lag("__i").over(same).alias("__last")), "links")
    # what was at a place before its own step came from the first later step that drew the place
    came = [links.where((F.col("__i") > F.col("__j")) & (F.col("__last").isNull() | (F.col("__last") == F.col("__j")))).select("__s", F.col("__j").alias("__at"), F.col("__i").alias("__from"))]

    def further(rows: DataFrame, key: str, at: str) -> DataFrame:
        """rows' key and the farthest place known so far that what lies at their column `at` came from."""
        known = reduce(DataFrame.union, came).select(F.col("__s").alias("__s2"), F.col("__at").alias("__at2"), F.col("__from").alias("__from2"))
        return rows.join(known, (F.col("__s") == F.col("__s2")) & (F.col(at) == F.col("__at2"))).groupBy("__s", key).agg(F.max("__from2").alias("__from"))

    while True:
        jump = materialize(further(came[-1], "__at", "__from"), "jump")
        if jump.isEmpty():
            break
        came.append(jump)
    wanted = links if first is None else materialize(links.where(F.col("__i") < first), "wanted")
    own = wanted.select("__s", "__i", F.coalesce("__next", "__j").alias("__from"))
    found = own.union(further(wanted.where(F.col("__next").isNotNull()), "__i", "__next"))
    # places only rise along a chain
    found = materialize(found.groupBy(F.col("__s").alias("__s2"), F.col("__i").alias("__place")).agg(F.max("__from").alias("__from")), "found")
    discard(sizes, links, wanted, jump, *came[1:])
    out = steps.join(found, (F.col("__s") == F.col("__s2")) & (F.col("__i") == F.col("__from")))
    return out.select("stratum", "row_id", (F.col("__place") + 1).alias("place"), *keep)


def experiment_seed(base: int) -> Callable[[str], int]:
    """Another seed for each stratum, by the length of its name."""
    return lambda stratum: base + len(stratum) * 7919
