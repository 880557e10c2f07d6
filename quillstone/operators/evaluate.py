"""Evaluation of certificates over stored labels: replications, audits, drift, agreement, dispersion."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import replace
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from quillstone.functions import bounds, md5
from quillstone.functions.rng import hash_order
from quillstone.operators.certify import LOOKS, Procedure, decide, plan_looks, ranked, strata_sizes
from quillstone.operators.ranks import nearest_ranks
from quillstone.operators.tables import before, materialize, running


# labels


def flip_label(old: Column, new: Column) -> Column:
    """1 where cached and fresh value differ; null equals null."""
    return (~old.eqNullSafe(new)).cast("int")


def graded_flip(old: Column, new: Column, tiers: Sequence[str]) -> Column:
    """1 where two ordinal values are more than one tier apart; an unknown value raises."""
    known = F.array(*map(F.lit, tiers))

    def tier(c: Column) -> Column:
        at = F.array_position(known, c)
        return F.when(at > 0, at).otherwise(F.raise_error(F.concat(F.lit("unknown option "), F.coalesce(c, F.lit("null")))))

    return (F.abs(tier(old) - tier(new)) > 1).cast("int")


def vote(values: Column) -> Column:
    """Majority of a group's non-null booleans: more than half; null without any. An aggregate."""
    n = F.count(values)
    return F.when(n > 0, F.sum(values.cast("int")) * 2 > n)


# replays


def savings(sampled: Column, recomputed: Column, n: Column) -> Column:
    return 1 - (sampled + recomputed) / n


#: Standard deviations beyond a stratum's longest look up to which its hashes are ranked at first.
MARGIN = 6.0

#: Hashes that are computed together: as many as stay in a core's cache.
TOGETHER = 1 << 15


def _below(cells: DataFrame, seeds: range) -> DataFrame:
    """(seed, stratum, row_id, flip) of each seed's cells of which the first 32 bits of the hash are below cut.

    cells: stratum, row_id, flip, cut (from 1), text (what is hashed behind the seed). Each cell is hashed
    once a seed, many cells or seeds in one step; a task holds a batch of cells and of results.
    """
    kept = ["stratum", "row_id", "flip"]
    kinds = {f.name: f for f in cells.schema.fields}
    schema = StructType([StructField("seed", LongType()), *[kinds[c] for c in kept]])

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for f in frames:
            held.append(f)
            if sum(map(len, held)) >= TOGETHER:
                yield pa.Table.from_batches(held)
                held = []
        if sum(map(len, held)):
            yield pa.Table.from_batches(held)

    def found(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Seeds and places in rows."""
        texts, cut = rows.column("text").cast(pa.binary()).to_pylist(), rows.column("cut").to_numpy()
        for size, some in groupby(seeds, lambda seed: len(str(seed))):
            alike = np.array(list(some))
            for at, words in md5.padded(texts, size + 1):
                most, step = (cut[at] - 1).astype(np.uint32), max(1, TOGETHER // len(at))
                for k in range(0, len(alike), step):
                    part = alike[k : k + step]
                    lead, place = np.nonzero(md5.heads(words, md5.leads([b"%d:" % seed for seed in part])) <= most)
                    yield part[lead], at[place]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches(frames):
            rows, held, n = rows.combine_chunks(), [], 0
            for end, some in chain(((False, x) for x in found(rows)), [(True, None)]):
                if some:
                    held.append(some)
                    n += len(some[0])
                if n >= TOGETHER or n and end:
                    seed, place = (np.concatenate(x) for x in zip(*held, strict=True))
                    got = rows.select(kept).take(pa.array(place)).add_column(0, "seed", pa.array(seed, pa.int64()))
                    yield from got.combine_chunks().to_batches()
                    held, n = [], 0

    return cells.select(*kept, "cut", "text").mapInArrow(run, schema)


def _first_places(cells: DataFrame, sizes: dict[str, int], most: dict[str, int], seeds: tuple[int, int]) -> DataFrame:
    """(seed, stratum, place, flips up to there) of at least the first `most` places of the orders of all
    seeds from the first to the last.

    Hashes are even, so those below a cut hold the first places with near certainty, and nothing else leaves
    the step that hashes. Orders in which too few fall below the cut are ranked again without one: the result
    is exact.
    """
    spark, rows, whole = cells.sparkSession, [], 2**32
    for s, size in sizes.items():
        share = (most[s] + MARGIN * math.sqrt(most[s]) + MARGIN) / size
        rows.append((s, most[s], min(whole, max(0, math.ceil(share * whole)))))
    cuts = spark.createDataFrame(rows, "s string, most long, cut long")
    text = F.coalesce(F.col("row_id").cast("string"), F.lit(""))
    # each row is hashed for all seeds, so even a small table is dealt to all tasks; a given number of partitions stays
    dealt = cells.select("stratum", "row_id", "flip").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row_id")
    each = dealt.join(F.broadcast(cuts.where("cut > 0")), F.col("stratum") == F.col("s")).withColumn("text", text)
    by = Window.partitionBy("seed", "stratum").orderBy("__order", "row_id")

    def rank(df: DataFrame) -> DataFrame:
        df = df.withColumn("__order", F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), text)))
        flips = F.sum(F.coalesce("flip", F.lit(1))).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.select("seed", "stratum", F.row_number().over(by).alias("place"), flips.alias("flips"))

    ranks = materialize(rank(_below(each, range(seeds[0], seeds[1] + 1))), "places")
    held = ranks.groupBy("seed", "stratum").agg(F.max("place").alias("held")).withColumnRenamed("stratum", "s")
    seed = F.explode(F.sequence(*(F.lit(x).cast("long") for x in seeds))).alias("seed")
    short = cuts.where(F.col("cut") < whole).select("s", "most", seed).join(held, ["seed", "s"], "left").where("coalesce(held, 0) < most").select("seed", F.col("s").alias("stratum"))
    if short.isEmpty():
        return ranks
    return ranks.join(short, ["seed", "stratum"], "left_anti").unionByName(rank(dealt.join(short, "stratum")))


def replications(cells: DataFrame, procedures: list[Procedure], trials: int, first_seed: int = 1000) -> DataFrame:
    """One replay for each seed and procedure: seed, alpha, reuse_set, cells, sampled, recompute, reused,
    reused_flips, unsafe, savings.

    cells: stratum, row_id, flip (null counts as a flip). Orders are hashes of seed and id, so any engine can
    check them; each cell is hashed once a seed, whatever the number of procedures, and about as many rows
    as looks need are ranked. A procedure's own seed isn't used. For many seeds on large strata, see
    monte_carlo. No trials, procedures or cells give no rows.
    """
    sizes, spark = strata_sizes(cells), cells.sparkSession
    plan = [(p.alpha, p.reuse_set, *look) for p in procedures for look in plan_looks(sizes, p)]
    looks = spark.createDataFrame(plan, f"alpha double, reuse_set boolean, {LOOKS}")
    if not plan or trials < 1:
        ranks = spark.createDataFrame([], "seed long, stratum string, place int, flips long")
    else:
        most = {s: max(r[5] for r in plan if r[2] == s) for s in sizes}
        ranks = _first_places(cells, sizes, most, (first_seed, first_seed + trials - 1))
    stops = decide(ranks, looks, F.col("alpha"), ("seed", "alpha", "reuse_set"))
    whole = cells.groupBy(F.col("stratum").alias("s")).agg(F.sum(F.coalesce("flip", F.lit(1))).alias("all_flips"))
    rows = stops.join(whole, F.col("stratum") == F.col("s"))
    sure, left = F.col("certified"), F.col("size") - F.col("n")
    bad = sure & (F.col("all_flips") > F.col("alpha") * F.col("size") + 1e-9)
    out = rows.groupBy("seed", "alpha", "reuse_set").agg(
        F.sum("size").alias("cells"),
        F.sum("n").alias("sampled"),
        F.sum(F.when(sure, 0).otherwise(left)).alias("recompute"),
        F.sum(F.when(sure, left).otherwise(0)).alias("reused"),
        F.sum(F.when(sure, F.col("all_flips") - F.col("flips")).otherwise(0)).alias("reused_flips"),
        F.max(bad.cast("int")).alias("unsafe"),
    )
    return out.withColumn("savings", savings(F.col("sampled"), F.col("recompute"), F.col("cells")))


def monte_carlo(cells: DataFrame, p: Procedure, trials: int, first_seed: int = 1000) -> DataFrame:
    """Replays with random orders: seed, sampled, recompute, reused, savings, unsafe. Only the counts of
    flips at the looks matter, and those are hypergeometric draws: no cell is shuffled, however many
    there are."""
    spark = cells.sparkSession
    strata = [(r[0], int(r[1]), int(r[2])) for r in cells.groupBy("stratum").agg(F.count("*"), F.sum("flip")).orderBy("stratum").collect()]
    total = sum(n for _, n, _ in strata)
    looks: dict[str, list] = {}
    for s, _, n, k in bounds.looks_table({s: n for s, n, _ in strata}, p.alpha, p.delta, p.first, p.most, p.bound, p.reuse_set):
        looks.setdefault(s, []).append((n, k))
    alpha = p.alpha

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            seeds = pdf.id.to_numpy()
            sampled, redo, unsafe = np.zeros(len(seeds), int), np.zeros(len(seeds), int), np.zeros(len(seeds), bool)
            rng = np.random.default_rng([int(seeds[0]), len(seeds)])
            for s, size, bad in strata:
                open_, k, drawn = np.ones(len(seeds), bool), np.zeros(len(seeds), int), 0
                for i, (n, top) in enumerate(looks[s]):
                    k = k + rng.hypergeometric(bad - k, size - drawn - (bad - k), n - drawn)
                    drawn = n
                    sure = open_ & (k <= top)
                    stop = open_ & (sure | (k > alpha * n) | (i + 1 == len(looks[s])))
                    sampled[stop] += n
                    redo[stop & ~sure] += size - n
                    unsafe |= sure & (bad > alpha * size + 1e-9)
                    open_ &= ~stop
            yield pd.DataFrame({"seed": seeds, "sampled": sampled, "recompute": redo, "reused": total - sampled - redo, "savings": 1 - (sampled + redo) / total, "unsafe": unsafe.astype(int)})

    return spark.range(first_seed, first_seed + trials).mapInPandas(run, "seed long, sampled long, recompute long, reused long, savings double, unsafe int")


def summary(runs: DataFrame, value: str = "savings") -> DataFrame:
    """Rate of runs that reuse anything, mean, population deviation, least, median and most of a value,
    with nearest-rank percentiles of the middle 95 %."""
    at = lambda f: F.get(F.sort_array(F.collect_list(value)), F.floor(F.lit(f) * F.count("*")).cast("int"))
    return runs.agg(F.count("*").alias("runs"), F.avg((F.col("reused") > 0).cast("int")).alias("rate"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"), at(0.5).alias("p50"), at(0.025).alias("low"), at(0.975).alias("high"))


def betting_replay(cells: DataFrame, p: Procedure) -> DataFrame:
    """As certify.replay with the betting bound, which needs the flips of the looks in their order: a
    stratum's last look, not the stratum, is one task's work."""
    sizes = strata_sizes(cells)
    plan = {s: bounds.look_schedule(n, p.alpha, p.delta / len(sizes), p.first, p.most) for s, n in sizes.items()}
    spark = cells.sparkSession
    last = F.broadcast(spark.createDataFrame([(s, ns[-1]) for s, ns in plan.items()], "s string, last long"))
    most = max((ns[-1] for ns in plan.values()), default=0)
    drawn = ranked(cells.select("stratum", "row_id", "flip"), hash_order(p.seed, F.col("row_id")), most, max(sizes.values(), default=0))
    drawn = drawn.join(last, F.col("stratum") == F.col("s")).where("place <= last")
    alpha, level, reuse_set = p.alpha, p.delta / max(1, len(sizes)), p.reuse_set

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, flips = pdf.stratum.iloc[0], pdf.sort_values("place").flip.fillna(1).to_numpy()
        for i, n in enumerate(plan[s], 1):
            limit, k = alpha * (sizes[s] - n) / sizes[s] if reuse_set else alpha, int(flips[:n].sum())
            sure = n < sizes[s] and bounds.betting(flips[:n], level) <= limit
            if sure or k > alpha * n:
                break
        return pd.DataFrame([(s, sizes[s], i, n, k, sure)], columns=["stratum", "size", "look", "n", "flips", "certified"])

    return drawn.select("stratum", "place", "flip").groupBy("stratum").applyInPandas(run, "stratum string, size long, look int, n long, flips long, certified boolean")


def calibration(spark, size: int, rate: float, alpha: float, delta: float, trials: int = 2000, reuse_set: bool = False) -> DataFrame:
    """Trials with flips planted at a rate: how often a stratum is certified, and how often wrongly."""
    plan = [(n, bounds.k_max(n, size, alpha, delta / len(ns), "exact", reuse_set)) for ns in [bounds.look_schedule(size, alpha, delta)] for n in ns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rng = np.random.default_rng([int(pdf.id.iloc[0]), size])
            bad = rng.binomial(size, rate, len(pdf))
            k, drawn, open_, sure_at = np.zeros(len(pdf), int), 0, np.ones(len(pdf), bool), np.zeros(len(pdf), bool)
            rest = np.zeros(len(pdf))
            for n, top in plan:
                k = k + rng.hypergeometric(bad - k, size - drawn - (bad - k), n - drawn)
                drawn = n
                sure = open_ & (k <= top)
                sure_at |= sure
                rest[sure] = (bad - k)[sure] / max(1, size - n)
                open_ &= ~sure & (k <= alpha * n)
            wrong = sure_at & ((rest > alpha + 1e-9) if reuse_set else (bad > alpha * size + 1e-9))
            yield pd.DataFrame({"trial": pdf.id, "certified": sure_at.astype(int), "wrong": wrong.astype(int)})

    return spark.range(trials).mapInPandas(run, "trial long, certified int, wrong int").agg(F.count("*").alias("trials"), F.sum("certified").alias("certified"), F.sum("wrong").alias("wrong"))


def overdispersion(spark, size: int, alpha: float, delta: float, phi: float, trials: int = 100_000, block: int = 32) -> DataFrame:
    """As calibration at rate alpha, with flips that come in blocks of correlated ones (beta-binomial)."""
    ns = bounds.look_schedule(size, alpha, delta)
    plan = [(n, bounds.k_max(n, size, alpha, delta / len(ns))) for n in ns]
    rho = (phi - 1) / (block - 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rng, m = np.random.default_rng([int(pdf.id.iloc[0]), size]), len(pdf)
            k, drawn, open_, sure_at = np.zeros(m, int), 0, np.ones(m, bool), np.zeros(m, bool)
            for n, top in plan:
                while drawn < n:
                    b = min(block, n - drawn)
                    r = rng.beta(alpha * (1 / rho - 1), (1 - alpha) * (1 / rho - 1), m) if rho > 0 else alpha
                    k, drawn = k + rng.binomial(b, r, m), drawn + b
                sure = open_ & (k <= top)
                sure_at |= sure
                open_ &= ~sure & (k <= alpha * n)
            yield pd.DataFrame({"trial": pdf.id, "certified": sure_at.astype(int)})

    return spark.range(trials).mapInPandas(run, "trial long, certified int").agg(F.count("*").alias("trials"), F.sum("certified").alias("certified"))


def audit(reused: DataFrame, oracle: DataFrame, alpha: float) -> DataFrame:
    """Realised error of a reuse set on rows that an oracle has answered: reused (row_id, value), oracle
    (row_id, value)."""
    o = oracle.select("row_id", F.col("value").alias("fresh"))
    rows = reused.join(o, "row_id")
    flips = F.sum(flip_label(F.col("value"), F.col("fresh")))
    return rows.agg(F.count("*").alias("audited"), F.coalesce(flips, F.lit(0)).alias("flips"), F.coalesce(flips / F.count("*"), F.lit(0.0)).alias("error"), F.coalesce(flips <= F.lit(alpha) * F.count("*"), F.lit(True)).alias("within"))


def baselines(cells: DataFrame) -> DataFrame:
    """What recomputing everything and reusing everything would cost and get wrong."""
    return cells.agg(F.count("*").alias("full_cost"), F.lit(0.0).alias("full_error"), F.lit(0).alias("blind_cost"), F.avg("flip").alias("blind_error"))


# scores as proxies


def auc(rows: DataFrame, score: str, label: str, tie: str, midranks: bool = False) -> DataFrame:
    """Rank AUC of a score for a 0/1 label; ties by another column, or by mid-ranks. 0.5 if one class is
    absent. Ranks are counted over range partitions."""
    keys = [score] if midranks else [score, tie]
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    ranks = running(n, [], [F.col(k).asc() for k in keys], F.col("n"), "before").withColumn("rank_sum", F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2))
    s = ranks.agg(F.sum("pos").alias("p"), F.sum("n").alias("n"), F.sum("rank_sum").alias("r"))
    return s.select(F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).otherwise(0.5).alias("auc"))


def tau_sweep(cells: DataFrame, score: str, taus: Sequence[float]) -> DataFrame:
    """Reuse where the score reaches a threshold: what is reused, what of it is wrong."""
    t = cells.sparkSession.createDataFrame([(float(x),) for x in taus], "tau double")
    hit = F.col(score) >= F.col("tau")
    return cells.crossJoin(F.broadcast(t)).groupBy("tau").agg(F.count("*").alias("cells"), F.count_if(hit).alias("reused"), F.coalesce(F.sum(F.when(hit, F.col("flip"))), F.lit(0)).alias("reused_flips"))


def supg(cells: DataFrame, score: str, alpha: float, delta: float, budget: int, thresholds: Sequence[float], seed: int = 42, least: int = 10) -> DataFrame:
    """The lowest threshold of a proxy score whose selected cells, on a sample of the budget's size, have
    a bound on their flips within alpha; delta is shared among thresholds."""
    sample = cells.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string"))), "row_id").limit(budget)
    t = cells.sparkSession.createDataFrame([(float(x),) for x in thresholds], "tau double")
    hit = F.col(score) >= F.col("tau")
    seen = sample.crossJoin(F.broadcast(t)).groupBy("tau").agg(F.count_if(hit).alias("n"), F.coalesce(F.sum(F.when(hit, F.col("flip"))), F.lit(0)).alias("k")).collect()
    level = delta / len(thresholds)
    good = sorted(r["tau"] for r in seen if r["n"] >= least and bounds.clopper_pearson(r["k"], r["n"], 0, level) <= alpha)
    tau = good[0] if good else float("inf")
    keep = F.col(score) >= F.lit(tau)
    return cells.agg(F.lit(tau).alias("tau"), F.count_if(keep).alias("selected"), F.coalesce(F.sum(F.when(keep, F.col("flip"))), F.lit(0)).alias("selected_flips"))


# drift and agreement


def drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """How two label sets (row_id, value) differ, by direction `old->new`."""
    rows = a.select("row_id", F.col("value").alias("va")).join(b.select("row_id", F.col("value").alias("vb")), "row_id")
    return rows.where(flip_label(F.col("va"), F.col("vb")) == 1).groupBy(F.concat_ws("->", F.coalesce("va", F.lit("null")), F.coalesce("vb", F.lit("null"))).alias("direction")).agg(F.count("*").alias("n"))


def paired_flips(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Rows that flip in one of two arms alone; their counts feed an exact McNemar test."""
    return rows.agg(F.count("*").alias("n"), F.count_if((F.col(first) == 1) & (F.col(second) == 0)).alias("only_first"), F.count_if((F.col(first) == 0) & (F.col(second) == 1)).alias("only_second"), F.count_if((F.col(first) == 1) & (F.col(second) == 1)).alias("in_both"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two 0/1 raters."""
    s = rows.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("agree"), F.avg(a).alias("pa"), F.avg(b).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select("n", "agree", F.when(chance < 1, (F.col("agree") - chance) / (1 - chance)).otherwise(1.0).alias("kappa"))


def failure_as_flip(cells: DataFrame, part: str) -> DataFrame:
    """By part: cells, those without a fresh value (flip is null), and the flip rate if they are left out
    and if each counts as a flip."""
    n, failed = F.count("*"), F.count_if(F.col("flip").isNull())
    return cells.groupBy(part).agg(n.alias("n"), failed.alias("failed"), F.avg("flip").alias("rate_without"), F.avg(F.coalesce("flip", F.lit(1))).alias("rate_as_flips"))


def subgroup_error(cells: DataFrame, decisions: DataFrame, drawn: DataFrame, part: str) -> DataFrame:
    """What a certificate over all cells leaves in each subgroup: cells that are reused, and how many of
    them flip. cells: row_id, flip and part, of one stratum; drawn: row_id of those that were sampled."""
    kept = cells.join(decisions.where("certified").limit(1).select(F.lit(True).alias("c")), F.lit(True), "left_semi").join(drawn.select("row_id"), "row_id", "left_anti")
    reused = kept.groupBy(F.col(part).alias("__part")).agg(F.count("*").alias("reused"), F.sum(F.coalesce("flip", F.lit(1))).alias("flips"))
    return cells.select(part).distinct().join(reused, F.col(part).eqNullSafe(F.col("__part")), "left").select(part, F.coalesce("reused", F.lit(0)).alias("reused"), F.coalesce("flips", F.lit(0)).alias("flips"))


def bound_ablation(cells: DataFrame, p: Procedure, names: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """For each bound and alpha: strata that are certified, cells that are sampled, recomputed and reused, and
    savings. One order of the cells serves all."""
    sizes = strata_sizes(cells)
    rows = [(b, a, *look) for b in names for a in alphas for look in plan_looks(sizes, replace(p, bound=b, alpha=a))]
    at = cells.sparkSession.createDataFrame(rows, "bound string, alpha double, s string, size long, look int, n long, k_max long")
    ranks = ranked(cells, hash_order(p.seed, F.col("row_id")), max((r[5] for r in rows), default=0), max(sizes.values(), default=0))
    seen = ranks.join(at, (F.col("stratum") == F.col("s")) & (F.col("place") == F.col("n")))
    seen = seen.withColumn("certified", F.col("flips") <= F.col("k_max")).withColumn("stops", F.col("certified") | (F.col("flips") > F.col("alpha") * F.col("n")))
    first = F.min_by(F.struct("size", "n", "certified"), F.struct(F.when(F.col("stops"), 0).otherwise(1), F.when(F.col("stops"), F.col("look")).otherwise(-F.col("look"))))
    each = seen.groupBy("bound", "alpha", "stratum").agg(first.alias("x")).select("bound", "alpha", "x.*")
    rest = F.col("size") - F.col("n")
    out = each.groupBy("bound", "alpha").agg(F.count_if("certified").alias("certified"), F.sum("size").alias("cells"), F.sum("n").alias("sampled"), F.sum(F.when(F.col("certified"), 0).otherwise(rest)).alias("recompute"), F.sum(F.when(F.col("certified"), rest).otherwise(0)).alias("reused"))
    return out.withColumn("savings", savings(F.col("sampled"), F.col("recompute"), F.col("cells")))


def family(cells: DataFrame) -> DataFrame:
    """By model: flips between two draws of the same prompt, flips after the edit, and whether the edit's
    are less than twice the draws'. cells: model, self_flip, edit_flip."""
    out = cells.groupBy("model").agg(F.avg("self_flip").alias("floor"), F.avg("edit_flip").alias("edit"))
    return out.withColumn("floor_dominated", F.col("edit") < 2 * F.col("floor"))


# independence of draws in time order


def lag1(rows: DataFrame, order: Sequence[str], value: str, part: Sequence[str] = ()) -> DataFrame:
    """Lag-1 autocorrelation of a series, by part. A part of any size: its order goes over range partitions."""
    means = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in part]).agg(F.avg(value).alias("__mean"))
    same = F.lit(True)
    for c in part:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    d = rows.join(means, same).withColumn("d", F.col(value) - F.col("__mean")).select(*part, *order, "d")
    x = before(d, list(part), list(order), F.col("d"), "prev")
    return x.groupBy(*part).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("d") * F.col("prev")) / F.nullif(F.sum(F.col("d") * F.col("d")), F.lit(0.0)), F.lit(0.0)).alias("lag1"))


def block_dispersion(rows: DataFrame, order: Sequence[str], flip: str, part: Sequence[str] = (), block: int = 32) -> DataFrame:
    """Variance of flips in blocks of consecutive rows against the binomial; an incomplete last block is
    left out. Rows are counted over range partitions, so a part may be of any size."""
    placed = running(rows.select(*part, *order, flip), list(part), [F.col(c) for c in order], F.lit(1), "place")
    b = placed.withColumn("b", F.floor(F.col("place") / block)).groupBy(*part, "b").agg(F.count("*").alias("m"), F.sum(flip).alias("k")).where(F.col("m") == block)
    s = b.groupBy(*part).agg(F.count("*").alias("blocks"), (F.sum("k") / F.sum("m")).alias("p"), F.coalesce(F.var_samp("k"), F.lit(0.0)).alias("variance"))
    expected = block * F.col("p") * (1 - F.col("p"))
    ratio = F.when(expected > 0, F.col("variance") / expected).otherwise(1.0)
    return s.withColumn("ratio", ratio).withColumn("df", F.greatest(F.lit(1), F.col("blocks") - 1)).withColumn("chi2", F.col("ratio") * F.col("df")).drop("variance")


def latency_split(rows: DataFrame, latency: str, flip: str, tie: str) -> DataFrame:
    """Flips in the faster and in the slower half; the middle one of an odd number is among the faster."""
    places = running(rows.select(latency, tie, flip), [], [F.col(latency).asc(), F.col(tie).asc()], F.lit(1), "place")
    n = F.broadcast(rows.agg(F.count("*").alias("all")))
    return places.crossJoin(n).groupBy((F.col("place") >= F.ceil(F.col("all") / 2)).alias("slower")).agg(F.count("*").alias("n"), F.sum(flip).alias("flips"))


def permutation_p(values: np.ndarray, observed: float, statistic, permutations: int = 2000, seed: int = 1) -> float:
    """(at least as large + 1) / (permutations + 1) for a short series."""
    rng = np.random.default_rng(seed)
    hits = sum(statistic(rng.permutation(values)) >= observed for _ in range(permutations))
    return (hits + 1) / (permutations + 1)


def calibration_sample(rows: DataFrame, part: Sequence[str], n: Column, seed: int, id_col: str, most: int = 1000) -> DataFrame:
    """A seeded sample of n rows (a Column, most at most) from each part. A task keeps most rows of a part."""
    w = Window.partitionBy(*part).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).where(F.col("place") <= n)


def deflated_alpha(alpha: float, missed: int, judged: int, level: float = 0.05) -> float:
    """alpha less what a judge may miss; at or below zero nothing can be certified."""
    return alpha - bounds.clopper_pearson(missed, judged, 0, level)


def equivalent(a: Column, b: Column, ab: Column, ba: Column) -> Column:
    """A judge's verdict on two texts, asked in both orders: the same if both say so; null if either failed."""
    return F.when(a == b, True).when(ab.isNull() | ba.isNull(), None).otherwise((ab == "SAME") & (ba == "SAME"))


def path_replay(looks: DataFrame) -> DataFrame:
    """(stratum, n, flips) of recorded looks; looks of equal depth that disagree raise."""
    g = looks.groupBy("stratum", "n").agg(F.min("flips").alias("flips"), F.max("flips").alias("most"))
    return g.withColumn("flips", F.when(F.col("flips") == F.col("most"), F.col("flips")).otherwise(F.raise_error(F.lit("looks of one stratum and depth disagree")).cast("long"))).drop("most")


def label_export(old: DataFrame, new: DataFrame, piece: int = 1000) -> DataFrame:
    """Aligned arrays of row ids, cached and fresh values by pair; null where there is no fresh value. The
    arrays hold piece rows at most, in the order of row ids: piece 0 the first of a pair, and so on."""
    rows = old.join(new.select("pair", "row_id", F.col("value").alias("fresh")), ["pair", "row_id"], "left").select("pair", "row_id", "value", "fresh")
    rows = running(rows, ["pair"], [F.col(c) for c in ("row_id", "value", "fresh")], F.lit(1), "place")
    s = F.sort_array(F.collect_list(F.struct("row_id", "value", "fresh")))
    return rows.groupBy("pair", F.floor(F.col("place") / piece).alias("piece")).agg(s.alias("s")).select("pair", "piece", F.transform("s", lambda x: x.row_id).alias("row_ids"), F.transform("s", lambda x: x.value).alias("cached"), F.transform("s", lambda x: x.fresh).alias("fresh"))


def noise_floor(draws: DataFrame) -> DataFrame:
    """How often two draws of one prompt differ: draws (regime, a, b)."""
    return draws.groupBy("regime").agg(F.count("*").alias("n"), F.avg(flip_label(F.col("a"), F.col("b"))).alias("self_flip"))


def label_noise(runs: DataFrame) -> DataFrame:
    """Range of savings and of certification over labelings: runs (labeling, savings, reused)."""
    each = runs.groupBy("labeling").agg(F.avg("savings").alias("savings"), F.avg((F.col("reused") > 0).cast("int")).alias("certified"))
    return each.agg(*[f(c).alias(f"{n}_{c}") for c in ("savings", "certified") for n, f in (("least", F.min), ("most", F.max))])


def exclusion_check(rows: DataFrame, dropped: str, flip: str) -> DataFrame:
    """Whether rows that one arm leaves out flip more in the other: n, flips and rate by dropped or not."""
    return rows.groupBy(dropped).agg(F.count("*").alias("n"), F.sum(flip).alias("flips"), F.avg(flip).alias("rate"))


def median_nearest(rows: DataFrame, value: str) -> DataFrame:
    """The value at place n/2 of the order, not an average of two."""
    return nearest_ranks(rows, value, [("median", 0.5)])


def drift_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """n, disagreements, rate and its score interval of two label sets (row_id, value)."""
    from quillstone.functions.stats import wilson

    rows = a.select("row_id", F.col("value").alias("va")).join(b.select("row_id", F.col("value").alias("vb")), "row_id")
    s = rows.agg(F.count("*").alias("n"), F.sum(flip_label(F.col("va"), F.col("vb"))).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return s.select("n", "k", (F.col("k") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def supg_by_value(cells: DataFrame, score: str, alpha: float, delta: float, budget: int, thresholds: Sequence[float], values: Sequence[str]) -> DataFrame:
    """supg within the cells of each cached value, each with its share of delta and of the budget."""
    out = None
    for v in values:
        one = supg(cells.where(F.col("value") == v), score, alpha, delta / len(values), budget // len(values), thresholds).withColumn("value", F.lit(v))
        out = one if out is None else out.unionByName(one)
    return out


def lag1_counts(rows: DataFrame, order: Sequence[str], flip: str, part: Sequence[str] = ()) -> DataFrame:
    """The same autocorrelation of 0/1 series as whole numbers, so ties of permutations are exact: n times
    the pairs that both flip, n, and the flips."""
    x = before(rows.select(*part, *order, flip), list(part), list(order), F.col(flip), "__prev")
    return x.groupBy(*part).agg(F.count("*").alias("n"), F.sum(flip).alias("flips"), F.coalesce(F.sum(F.col(flip) * F.col("__prev")), F.lit(0)).alias("pairs"))
