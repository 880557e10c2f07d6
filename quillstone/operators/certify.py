"""Certified reuse of cached cells after an edit: sample strata along looks, bound their flip rates.

With probability 1 - delta no certified stratum has flips in more than alpha of its cells. A look is
decided by its count of flips alone, so each stratum's looks become a small table (look, n, k_max), and a
replay over known labels is one query: rank, running sum of flips, an equi-join at the looks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import bounds
from quillstone.functions.rng import hash_order, replay_order
from quillstone.operators.strata import Stratifier, value_only
from quillstone.operators.tables import materialize

LOOKS = "stratum string, size long, look int, n long, k_max long"


@dataclass
class Procedure:
    alpha: float = 0.1
    delta: float = 0.1
    first: int = 45
    most: int = 6
    bound: str = "exact"
    reuse_set: bool = False
    seed: int = 42
    adaptive: bool = True

    def __post_init__(self):
        if self.bound not in bounds.BOUNDS:
            raise ValueError(f"no bound {self.bound}; a betting bound needs the flips' order, see evaluate.betting_replay")


#: Cells of a stratum that one task ranks.
SPREAD = 500_000


def ranked(cells: DataFrame, order: list[Column], most: int, size: int = 0) -> DataFrame:
    """The first cells (stratum, row_id, flip) of each stratum's order, most at most, with place (from 1) and
    the flips up to there. size: cells of the largest stratum; a large one is first dealt to several
    tasks, of which each passes on the first of its own."""
    if size > SPREAD:
        deal = F.pmod(F.xxhash64("row_id"), F.lit(1 + size // SPREAD))
        first = F.row_number().over(Window.partitionBy("stratum", "__deal").orderBy(*order))
        cells = cells.withColumn("__deal", deal).withColumn("__first", first).where(F.col("__first") <= most).drop("__deal", "__first")
    places = cells.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy(*order))).where(F.col("place") <= most)
    upto = Window.partitionBy("stratum").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return places.withColumn("flips", F.sum(F.coalesce("flip", F.lit(1))).over(upto))


def plan_looks(sizes: dict[str, int], p: Procedure) -> list[tuple]:
    """(stratum, size, look, n, k_max) of each look of each stratum."""
    if p.adaptive:
        return [(s, sizes[s], i, n, k) for s, i, n, k in bounds.looks_table(sizes, p.alpha, p.delta, p.first, p.most, p.bound, p.reuse_set)]
    rows = []
    for s, size in sizes.items():
        n = bounds.plan_fixed(size, p.alpha, p.delta, len(sizes))
        limit = p.alpha * (size - n) / size if p.reuse_set else p.alpha
        f, d = bounds.BOUNDS[p.bound], p.delta / len(sizes)
        rows.append((s, size, 1, n, max((k for k in range(n + 1) if f(k, n, size, d) <= limit), default=-1)))
    return rows


def looks_of(spark: SparkSession, plan: list[tuple]) -> DataFrame:
    """A row for each look of each stratum; as many as strata times looks."""
    return spark.createDataFrame(plan, LOOKS)


def decide(ranks: DataFrame, looks: DataFrame, alpha: float | Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """(stratum, size, look, n, flips, certified, futile) of the look at which each stratum stops.

    A stratum stops at the first look that certifies it or that shows more flips than alpha allows,
    else at the last. looks has few rows; ranks is as large as the cells. extra: columns of either that
    tell several runs apart.
    """
    at = looks.select(F.col("stratum").alias("s"), "size", "look", "n", "k_max", *[c for c in extra if c in looks.columns])
    seen = ranks.join(at, (F.col("stratum") == F.col("s")) & (F.col("place") == F.col("n")))
    seen = seen.withColumn("certified", F.col("flips") <= F.col("k_max")).withColumn("futile", ~F.col("certified") & (F.col("flips") > F.lit(alpha) * F.col("n")))
    stop = F.min_by(F.struct("size", "look", "n", "flips", "certified", "futile"), F.struct(F.when(F.col("certified") | F.col("futile"), 0).otherwise(1), F.when(F.col("certified") | F.col("futile"), F.col("look")).otherwise(-F.col("look"))))
    return seen.groupBy(*extra, "stratum").agg(stop.alias("x")).select(*extra, "stratum", "x.*")


def strata_sizes(cells: DataFrame) -> dict[str, int]:
    """Strata are few: cached values by buckets."""
    return {r[0]: r[1] for r in cells.groupBy("stratum").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "stratum").collect()}


def replay(cells: DataFrame, p: Procedure, order: str = "hash") -> DataFrame:
    """Certify on known labels. cells: stratum, row_id, flip (null: no fresh value, which counts as a flip).

    order: "hash" (a hash of seed and id) or "replay" (a shuffle of each stratum).
    """
    sizes = strata_sizes(cells)
    plan, size = plan_looks(sizes, p), max(sizes.values(), default=0)
    most = max((r[3] for r in plan), default=0)
    if order == "replay":
        seed = p.seed
        ranks = ranked(replay_order(cells, lambda s: seed, first=most, keep=["flip"]).withColumnRenamed("place", "at"), [F.col("at")], most)
    else:
        ranks = ranked(cells, hash_order(p.seed, F.col("row_id")), most, size)
    return decide(ranks, looks_of(cells.sparkSession, plan), p.alpha)


def _fates(cells: DataFrame, drawn: DataFrame, decisions: DataFrame) -> DataFrame:
    """cells with fate. drawn: row_id and fresh of the rows that were sampled, fresh null where the oracle
    failed."""
    d = decisions.select(F.col("stratum").alias("s"), "certified")
    seen = drawn.select(F.col("row_id").alias("__r"), F.col("fresh").alias("__fresh"), F.lit(True).alias("__drawn"))
    out = cells.join(seen, F.col("row_id") == F.col("__r"), "left").join(d, F.col("stratum") == F.col("s"))
    fate = F.when(F.col("__drawn") & F.col("__fresh").isNotNull(), "sampled").when(F.col("__drawn").isNull() & F.col("certified"), "reuse").otherwise("recompute")
    return out.withColumn("fate", fate)


def partition_cells(cells: DataFrame, decisions: DataFrame, p: Procedure) -> DataFrame:
    """cells with fate: sampled, reuse or recompute. Sampled rows without a fresh value are recomputed."""
    known = decisions.agg(F.max("n"), F.max("size")).first()
    ranks = ranked(cells, hash_order(p.seed, F.col("row_id")), known[0] or 0, known[1] or 0)
    d = decisions.select(F.col("stratum").alias("s"), F.col("n").alias("last"))
    drawn = ranks.join(d, F.col("stratum") == F.col("s")).where("place <= last").select("row_id", F.col("flip").alias("fresh"))
    return _fates(cells, drawn, decisions).select(*cells.columns, "fate")


@dataclass
class Outcome:
    decisions: DataFrame
    cells: DataFrame
    oracle_calls: int
    looks: list[dict] = field(default_factory=list)


def certify_live(cached: DataFrame, oracle: Callable[[DataFrame], DataFrame], p: Procedure, stratify: Stratifier = value_only, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> Outcome:
    """Certify with an oracle. cached: row_id, value and what stratify needs. oracle: (row_id) to
    (row_id, value); a row that it leaves out, or answers with null, counts as a flip and is recomputed.

    All strata take a look together, so the driver loops over looks alone; each look's answers are
    written before they are used, and each row is asked for once. keep(df, name) writes and rereads a
    table, by default in the shared folder.
    """
    keep = keep or materialize
    cells = keep(stratify(cached).select("row_id", "value", "stratum"), "cells")
    sizes = strata_sizes(cells)
    looks = plan_looks(sizes, p)
    ranks = ranked(cells.withColumn("flip", F.lit(None).cast("int")), hash_order(p.seed, F.col("row_id")), max((r[3] for r in looks), default=0), max(sizes.values(), default=0))
    ranks = keep(ranks.select("row_id", "value", "stratum", "place"), "ranks")
    plan: dict[str, list] = {}
    for s, _, _, n, k in looks:
        plan.setdefault(s, []).append({"n": n, "k_max": k})
    open_, answers, calls, decided, log = dict.fromkeys(plan, 0), None, 0, {}, []
    for i in range(max(map(len, plan.values()), default=0)):
        step = [(s, int(plan[s][i - 1]["n"] if i else 0), int(plan[s][i]["n"])) for s in open_ if s not in decided and i < len(plan[s])]
        if not step:
            break
        want = F.broadcast(cells.sparkSession.createDataFrame(step, "s string, a long, b long"))
        ask = ranks.join(want, (F.col("stratum") == F.col("s")) & (F.col("place") > F.col("a")) & (F.col("place") <= F.col("b"))).select("row_id", "stratum", F.col("value").alias("old"), "place")
        new = keep(ask.join(oracle(ask.select("row_id")).withColumnRenamed("value", "fresh"), "row_id", "left"), f"look-{i}")
        calls += new.count()
        answers = new if answers is None else answers.unionByName(new)
        flip = (F.col("fresh").isNull() | (F.col("fresh") != F.col("old"))).cast("long")
        got = {r[0]: r[1] for r in answers.groupBy("stratum").agg(F.sum(flip)).collect()}
        for s, _, n in step:
            k, r = got.get(s, 0), plan[s][i]
            sure, futile = k <= r["k_max"], k > r["k_max"] and k > p.alpha * n
            log.append({"stratum": s, "look": i + 1, "n": n, "flips": k, "certified": sure})
            if sure or futile or i + 1 == len(plan[s]):
                decided[s] = (s, sizes[s], i + 1, n, k, sure, futile)
    decisions = cells.sparkSession.createDataFrame(list(decided.values()), "stratum string, size long, look int, n long, flips long, certified boolean, futile boolean")
    drawn = answers.select("row_id", "fresh") if answers is not None else cells.select("row_id", F.lit(None).cast("string").alias("fresh")).limit(0)
    return Outcome(decisions, _fates(cells, drawn, decisions).select("row_id", "stratum", "value", F.col("__fresh").alias("fresh"), "fate"), calls, log)


def default_seed(column_id: str, old: int, new: int) -> int:
    from quillstone.functions.text import fnv1a32

    return fnv1a32(f"{column_id}:{old}:{new}")


def certificate(outcome: Outcome, p: Procedure, certificate_id: str, column_id: str, old: int, new: int, delta_json: str) -> DataFrame:
    """The certificate as one row, as in cells.CERTIFICATES but for its time."""
    counts = outcome.cells.agg(*[F.count_if(F.col("fate") == f).alias(c) for f, c in (("reuse", "reused_count"), ("recompute", "recompute_count"), ("sampled", "sampled_count"))])
    strata = outcome.decisions.agg(F.to_json(F.sort_array(F.collect_list(F.struct("stratum", "size", "look", "n", "flips", "certified")))).alias("strata"))
    return counts.crossJoin(strata).select(F.lit(certificate_id).alias("id"), F.lit(column_id).alias("column_id"), F.lit(old).cast("int").alias("from_version"), F.lit(new).cast("int").alias("to_version"), F.lit(p.alpha).alias("alpha"), F.lit(delta_json).alias("delta"), "strata", "reused_count", "recompute_count", "sampled_count", F.lit(0.0).alias("verification_cost_usd"), F.current_timestamp().alias("created_at"))
