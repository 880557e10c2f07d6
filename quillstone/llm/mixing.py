"""Mixing sources to target weights along a time-varying curriculum. DataFrame operations only.

Each source gets a target of words by its weight. Its weight over training time is a piecewise linear
schedule; the integral of the schedule, scaled to the target, is the demand for the source's words up
to a time. Documents stand in a fixed pseudo-random order within their source, again for each pass;
a document's place in that order, as a share of demand, is turned into a training position between 0
and 1 by inverting the integral. Rows are then range-sorted by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import materialize, running, without, word_count

#: (time, weight) breakpoints, one schedule after another for sources in order: rising, level, falling.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)))
WEIGHTS = (3.0, 1.0, 2.0)
RESULTS = ("size", "source_size", "target", "taken", "positions")


def _cycle(values: list[Column], k: Column) -> Column:
    return F.element_at(F.array(*values), (k % len(values) + 1).cast("int"))


def source_table(units: DataFrame, weights=WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """One row per source with its words, and weight and schedule by its rank in code-point order, null last."""
    sums = materialize(units.groupBy("source").agg(F.sum("mass").alias("source_size")), "sources")
    ranked = running(sums, [], [F.col("source").asc_nulls_last()], F.lit(1), "rank")
    plans = [F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in s]) for s in schedules]
    return ranked.select("source", "source_size", _cycle([F.lit(float(w)) for w in weights], F.col("rank")).alias("weight"), _cycle(plans, F.col("rank")).alias("schedule"))


def allocate(sources: DataFrame, factor: float, cap: float) -> DataFrame:
    """sources with target: factor times all words, shared by weight, none above cap times its words.

    A source at its cap leaves the rest to the others, until none is above. Only two sums come to
    the driver in each of the rounds, of which there are no more than sources reach their cap.
    """
    sources = materialize(sources, "weights")
    words, most = F.col("source_size").cast("double"), F.col("source_size") * F.lit(float(cap))
    total = sources.agg(F.coalesce(F.sum(words), F.lit(0.0))).first()[0]
    level, capped = 0.0, -1
    while True:
        at_cap = F.col("weight") * F.lit(level) >= most
        held, w, n = sources.agg(F.coalesce(F.sum(F.when(at_cap, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0.0)), F.count_if(at_cap)).first()
        if n == capped or not w:
            return sources.withColumn("target", F.when(at_cap, most).otherwise(F.col("weight") * F.lit(level)))
        level, capped = (factor * total - held) / w, n


def _segments(schedule: Column) -> Column:
    """Breakpoints as segments with the integral at both ends."""
    pieces = F.zip_with(F.slice(schedule, 1, F.size(schedule) - 1), F.slice(schedule, 2, F.size(schedule) - 1), lambda a, b: F.struct(a.t.alias("t0"), a.w.alias("w0"), b.t.alias("t1"), b.w.alias("w1"), ((b.t - a.t) * (a.w + b.w) / 2).alias("area")))
    return F.transform(pieces, lambda p, i: F.struct(p.t0.alias("t0"), p.w0.alias("w0"), p.t1.alias("t1"), p.w1.alias("w1"), F.aggregate(F.slice(pieces, 1, i), F.lit(0.0), lambda s, x: s + x.area).alias("d0"), F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0.0), lambda s, x: s + x.area).alias("d1")))


def _time_of(share: Column, segs: Column) -> Column:
    """The time by which this share of all demand has come."""
    y = share * F.element_at(segs, -1).d1
    s = F.coalesce(F.get(F.filter(segs, lambda x: y <= x.d1), F.lit(0)), F.element_at(segs, -1))
    rest, slope = F.greatest(y - s.d0, F.lit(0.0)), (s.w1 - s.w0) / (s.t1 - s.t0)
    root = s.w0 + F.sqrt(F.greatest(s.w0 * s.w0 + 2 * slope * rest, F.lit(0.0)))
    return s.t0 + F.when(root > 0, 2 * rest / root).otherwise(0.0)


def mix_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", factor: float = 1.5, cap: float = 2.0, weights=WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """df with size, source_size, target, taken and positions.

    size: words of the text (null: 0). taken: words that the mix takes of the row; the document at
    which a source's target is reached gives a part. positions: training times from 0 to 1, one for
    each pass that takes words of it; empty texts have none. Rows that repeat id, source and text are
    taken alike, and rows that differ in one of them are units of their own. Null sources are one source,
    and rows with a null id are ordered like those of empty id. A source without words has target 0. Ties
    in the order are broken by id and text. An empty table gives an empty table. Columns named like a
    result are replaced.
    """
    df = without(df, *RESULTS)
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    light = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), mark.alias("mark"))
    units = materialize(light.groupBy("id", "source", "size", "mark").agg(F.count("*").alias("n")).withColumn("mass", F.col("size") * F.col("n")), "units")
    sources = materialize(allocate(source_table(units, weights, schedules), factor, cap).withColumn("segs", _segments(F.col("schedule"))), "targets").select(F.col("source").alias("__source"), "source_size", "target", "segs")
    order = [F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.col("id"), F.col("mark"), F.col("size")]
    placed = running(units, ["source"], order, F.col("mass"), "before").join(sources, F.col("source").eqNullSafe(F.col("__source")))
    whole = F.floor("target")

    def one_pass(k: Column) -> Column:
        start = F.col("before") + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("mass"), whole - start))
        return F.struct(words.alias("words"), F.when(words > 0, _time_of((start + words / 2) / F.col("target"), F.col("segs"))).alias("at"))

    passes = F.transform(F.sequence(F.lit(0), F.lit(max(0, math.ceil(cap) - 1))), one_pass)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda s, p: s + F.floor(p.words / F.col("n")))
    plan = placed.withColumn("passes", passes).select(
        F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("mark").alias("__mark"), "size", "source_size", "target", taken.alias("taken"),
        F.filter(F.transform("passes", lambda p: p["at"]), lambda t: t.isNotNull()).alias("positions"),
    )
    rows = df.withColumn("__m", mark)
    on = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__m") == F.col("__mark"))
    return rows.join(plan, on).select(*df.columns, *RESULTS)


def mix(df: DataFrame, **options) -> DataFrame:
    """The training sequence: a row for each pass over each taken document, range-sorted by position.

    The document at which a source's target is reached comes whole, as a text isn't cut: a source has at
    most the rest of that one document above its target. Rows that the mix takes nothing of are left out.
    """
    plan = mix_plan(df, **options)
    return plan.withColumn("position", F.explode("positions")).drop("positions").orderBy("position", F.xxhash64(options.get("id_col", "doc_id")))
