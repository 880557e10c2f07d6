"""Queries of certification and evaluation, over cells made from events and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import bounds, rng, stats
from quillstone.operators import certify, evaluate, strata
from quillstone.operators.certify import Procedure
from quillstone.plans.columns import TERMS
from quillstone.plans.registry import query, table

#: Edits of "is the value 100 or more": what the new prompt answers, in SQL that both engines read.
EDITS = {"small": "value >= 102", "large": "value >= 150", "other": "value >= 100 OR (event_type = 'error' AND user_id % 7 = 0)"}


def event_cells(spark: SparkSession, sf_dir: str, edit: str) -> DataFrame:
    """row_id, value, fresh and flip of each event; stratum by value."""
    e = table(spark, sf_dir, "events")
    old, new = F.col("value") >= 100, F.expr(EDITS[edit])
    rows = e.select("event_id", "user_id", "event_type", F.when(old, "true").otherwise("false").alias("cached"), F.when(new, "true").otherwise("false").alias("fresh"))
    rows = rows.select(F.col("event_id").alias("row_id"), "user_id", "event_type", F.col("cached").alias("value"), "fresh", evaluate.flip_label(F.col("cached"), F.col("fresh")).alias("flip"))
    return strata.value_only(rows)


def _cells_sql(edit: str) -> str:
    return f"cells AS (SELECT event_id AS row_id, 'v=' || (value >= 100)::VARCHAR || '|all' AS stratum, ((value >= 100) <> ({EDITS[edit]}))::INT AS flip FROM events)"


def _exact_sql(p: Procedure) -> str:
    """Look schedule and largest certifying counts in SQL, for the exact bound: one statement for all sizes."""
    return f"""
    sizes AS (SELECT stratum, count(*) AS size, count(*) OVER () AS strata FROM cells GROUP BY stratum),
    need AS (SELECT stratum, size, {p.delta} / strata AS d, ceil(7 * ln(2 / ({p.delta} / strata / {p.most})) / (3 * {p.alpha}))::BIGINT + 1 AS need FROM sizes),
    raw_looks AS (SELECT stratum, size, d, need, j, ({p.first} * pow(2, j))::BIGINT AS raw FROM need CROSS JOIN range({p.most}) t(j) WHERE j = 0 OR {p.first} * pow(2, j - 1) < greatest(need, size)),
    capped AS (SELECT stratum, size, d, CASE WHEN j = max(j) OVER (PARTITION BY stratum) THEN greatest(least(raw, size), least(need, size)) ELSE least(raw, size) END AS n FROM raw_looks),
    looks AS (SELECT stratum, size, n, d / count(*) OVER (PARTITION BY stratum) AS level, row_number() OVER (PARTITION BY stratum ORDER BY n) AS look FROM (SELECT DISTINCT stratum, size, d, n FROM capped)),
    {_counts_sql(p)}"""


def _counts_sql(p: Procedure) -> str:
    """A look certifies k flips if the smallest number of bad cells above the limit would show so few with
    probability at most its level."""
    limit = f"{p.alpha} * (size - n) / size" if p.reuse_set else f"{p.alpha}"
    lf = lambda x: f"lgamma(({x})::DOUBLE + 1)"
    term = f"exp({lf('bad')} - {lf('i')} - {lf('bad - i')} + {lf('size - bad')} - {lf('n - i')} - {lf('size - bad - n + i')} - {lf('size')} + {lf('n')} + {lf('size - n')})"
    return f"""worst AS (SELECT *, floor({limit} * size + 1e-9)::BIGINT + 1 AS bad FROM looks),
    tail AS (SELECT stratum, size, look, n, level, i, sum(p) OVER (PARTITION BY stratum, look ORDER BY i) AS cdf
      FROM (SELECT stratum, size, look, n, level, i, {term} AS p FROM worst CROSS JOIN range(2000) t(i) WHERE i <= least(n, bad) AND n - i <= size - bad)),
    kmax AS (SELECT w.stratum, w.size, w.look, w.n, CASE WHEN w.n >= w.size THEN -1 ELSE coalesce(max(i) FILTER (cdf <= t.level), -1) END AS k_max
      FROM worst w LEFT JOIN tail t ON t.stratum = w.stratum AND t.look = w.look GROUP BY w.stratum, w.size, w.look, w.n)"""


def _decide_sql(p: Procedure) -> str:
    return f"""
    ranked AS (SELECT stratum, flip, row_number() OVER w AS place, sum(flip) OVER (w ROWS UNBOUNDED PRECEDING) AS flips
      FROM cells WINDOW w AS (PARTITION BY stratum ORDER BY md5('{p.seed}:' || row_id::VARCHAR), row_id)),
    seen AS (SELECT k.stratum, size, look, n, flips::BIGINT AS flips, flips <= k_max AS certified, flips > k_max AND flips > {p.alpha} * n AS futile
      FROM kmax k JOIN ranked r ON r.stratum = k.stratum AND r.place = k.n),
    decided AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY CASE WHEN certified OR futile THEN look ELSE 1000 - look END) = 1)"""


def certify_sql(edit: str, p: Procedure, tail: str) -> str:
    return f"WITH {_cells_sql(edit)}, {_exact_sql(p)}, {_decide_sql(p)} {tail}"


DECIDED = "SELECT stratum, size, look::INT AS look, n, flips, certified, futile FROM decided"


def _certify(name: str, edit: str, p: Procedure) -> None:
    @query(name, certify_sql(edit, p, DECIDED))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return certify.replay(event_cells(spark, sf_dir, edit), p)


for _edit in EDITS:
    for _alpha in (0.05, 0.1, 0.2):
        _certify(f"certify_{_edit}_{int(_alpha * 100)}", _edit, Procedure(alpha=_alpha))
_certify("certify_presented", "other", Procedure())
_certify("certify_reuse_set", "small", Procedure(reuse_set=True))
_certify("certify_four_looks", "other", Procedure(alpha=0.05, most=4))

_FIXED = Procedure(adaptive=False)


@query("certify_fixed", f"""WITH {_cells_sql('small')},
    sizes AS (SELECT stratum, count(*) AS size, count(*) OVER () AS strata FROM cells GROUP BY stratum),
    looks AS (SELECT stratum, size, least(size, greatest(30, ceil(7 * ln(2 / (0.1 / strata)) / 0.3)::BIGINT + 1)) AS n, 0.1 / strata AS level, 1 AS look FROM sizes),
    {_counts_sql(_FIXED)}, {_decide_sql(_FIXED)} {DECIDED}""")
def certify_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certify.replay(event_cells(spark, sf_dir, "small"), _FIXED)


@query("certify_fates", certify_sql("other", Procedure(), """, fates AS (SELECT r.stratum, CASE WHEN place <= n THEN 'sampled' WHEN certified THEN 'reuse' ELSE 'recompute' END AS fate FROM ranked r JOIN decided d USING (stratum))
SELECT stratum, fate, count(*) AS n FROM fates GROUP BY ALL"""))
def certify_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = event_cells(spark, sf_dir, "other")
    d = certify.replay(cells, Procedure())
    return certify.partition_cells(cells, d, Procedure()).groupBy("stratum", "fate").agg(F.count("*").alias("n"))


@query("certify_live", certify_sql("other", Procedure(), """, fates AS (SELECT r.stratum, CASE WHEN place <= n THEN 'sampled' WHEN certified THEN 'reuse' ELSE 'recompute' END AS fate FROM ranked r JOIN decided d USING (stratum))
SELECT stratum, fate, count(*) AS n FROM fates GROUP BY ALL"""))
def certify_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an oracle that is asked look by look; it decides as the replay does."""
    cells = event_cells(spark, sf_dir, "other")
    fresh = cells.select("row_id", F.col("fresh").alias("value"))
    out = certify.certify_live(cells.select("row_id", "value"), lambda ask: ask.join(fresh, "row_id"), Procedure())
    return out.cells.groupBy("stratum", "fate").agg(F.count("*").alias("n"))


@query("certify_shuffled")
def certify_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certify.replay(event_cells(spark, sf_dir, "other"), Procedure(), order="replay")


@query("certify_betting")
def certify_betting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.betting_replay(event_cells(spark, sf_dir, "other"), Procedure())


# strata


@query("strata_value_only", f"WITH {_cells_sql('small')} SELECT stratum, count(*) AS size FROM cells GROUP BY stratum")
def strata_value_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata.sizes(event_cells(spark, sf_dir, "small"))


_LEXICAL_SQL = r"""WITH t AS (SELECT quality, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '\{\{[^}]*\}\}', ' ', 'g'), '[^a-z0-9+#.]+'), lambda w: length(w) > 2)) AS words FROM documents JOIN labels USING (doc_id)),
s AS (SELECT quality, len(list_intersect(words, [""" + ", ".join(repr(t) for t in TERMS) + """])) AS s FROM t)
SELECT 'v=' || quality::VARCHAR || '|o=' || CASE WHEN s = 0 THEN '0' WHEN s <= 2 THEN '1-2' ELSE '3+' END AS stratum, count(*) AS size FROM s GROUP BY ALL"""


@query("strata_lexical", _LEXICAL_SQL)
def strata_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("value", F.col("quality").cast("string"))
    return strata.sizes(strata.lexical(TERMS)(d))


@query("strata_embed", """WITH o AS (SELECT embedding::DOUBLE[] AS o FROM embeddings WHERE vec_id = 0),
e AS (SELECT label % 2 = 0 AS value, round(list_dot_product(embedding::DOUBLE[], o) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(o, o))), 6) AS s FROM embeddings CROSS JOIN o),
r AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM e),
cut AS (SELECT max(s) FILTER (i = n // 3) AS a, max(s) FILTER (i = 2 * n // 3) AS b FROM r)
SELECT 'v=' || value::VARCHAR || '|' || CASE WHEN s <= a THEN 'low' WHEN s <= b THEN 'mid' ELSE 'high' END AS stratum, count(*) AS size FROM e CROSS JOIN cut GROUP BY ALL""")
def strata_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.functions.text import cosine

    e = table(spark, sf_dir, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("o"))
    s = e.crossJoin(F.broadcast(one)).select((F.col("label") % 2 == 0).cast("string").alias("value"), F.round(cosine(F.col("embedding"), F.col("o")), 6).alias("similarity"))
    return strata.sizes(strata.tertiles("similarity")(s))


@query("strata_category", "SELECT 'v=' || event_type || '|all' AS stratum, count(*) AS size FROM events GROUP BY event_type")
def strata_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata.sizes(strata.category("event_type")(event_cells(spark, sf_dir, "small")))


# replications and bounds

TRIALS = 1000
GRID = [Procedure(alpha=a, reuse_set=r) for a in (0.02, 0.05, 0.1, 0.2) for r in (False, True)]


@query("replications", f"""WITH {_cells_sql('other')},
kmax AS ({" UNION ALL ".join(f"SELECT {p.alpha}::DOUBLE AS alpha, {p.reuse_set} AS reuse_set, * FROM (WITH {_exact_sql(p)} SELECT * FROM kmax)" for p in GRID)}),
each AS (SELECT seed, stratum, row_id, flip FROM cells CROSS JOIN range(1000, {1000 + TRIALS}) t(seed)),
ranked AS (SELECT seed, stratum, row_number() OVER w AS place, sum(flip) OVER (w ROWS UNBOUNDED PRECEDING) AS flips
  FROM each WINDOW w AS (PARTITION BY seed, stratum ORDER BY md5(seed::VARCHAR || ':' || row_id::VARCHAR), row_id)),
seen AS (SELECT seed, alpha, reuse_set, k.stratum, size, look, n, flips, flips <= k_max AS certified, flips > k_max AND flips > alpha * n AS futile FROM kmax k JOIN ranked r ON r.stratum = k.stratum AND r.place = k.n),
decided AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY seed, alpha, reuse_set, stratum ORDER BY CASE WHEN certified OR futile THEN look ELSE 1000 - look END) = 1),
whole AS (SELECT stratum, sum(flip) AS f FROM cells GROUP BY stratum)
SELECT seed, alpha, reuse_set, sum(size)::BIGINT AS cells, sum(n)::BIGINT AS sampled, sum(CASE WHEN certified THEN 0 ELSE size - n END)::BIGINT AS recompute, sum(CASE WHEN certified THEN size - n ELSE 0 END)::BIGINT AS reused,
       sum(CASE WHEN certified THEN f - flips ELSE 0 END)::BIGINT AS reused_flips, max((certified AND f > alpha * size + 1e-9)::INT) AS unsafe,
       round(1 - (sum(n) + sum(CASE WHEN certified THEN 0 ELSE size - n END)) / sum(size), 9) AS savings
FROM decided JOIN whole USING (stratum) GROUP BY seed, alpha, reuse_set""")
def replications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,000 orders, four budgets, both estimands."""
    out = evaluate.replications(event_cells(spark, sf_dir, "other"), GRID, TRIALS)
    return out.withColumn("savings", F.round("savings", 9))


@query("monte_carlo")
def monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand replays at each of four budgets, and how their savings spread."""
    cells = event_cells(spark, sf_dir, "other").select("stratum", "row_id", "flip")
    runs = [evaluate.summary(evaluate.monte_carlo(cells, Procedure(alpha=a), 1000)).withColumn("alpha", F.lit(a)) for a in (0.05, 0.1, 0.15, 0.2)]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


@query("percentile_pi", """WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT max(value) FILTER (i = floor(0.025 * n)) AS low, max(value) FILTER (i = floor(0.5 * n)) AS p50, max(value) FILTER (i = floor(0.975 * n)) AS high FROM r""")
def percentile_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of all values, without sorting them in one task."""
    return evaluate.nearest_ranks(table(spark, sf_dir, "events"), "value", [("low", 0.025), ("p50", 0.5), ("high", 0.975)])


@query("bounds_table", f"""WITH g AS (SELECT n, size, k, 0.1 / 12 AS delta FROM (SELECT unnest([45, 90, 180]) AS n) CROSS JOIN (SELECT unnest([600, 1800]) AS size) CROSS JOIN (SELECT unnest([0, 1, 5]) AS k)),
m AS (SELECT n, size, k, delta, bad FROM g CROSS JOIN range(0, 1801) t(bad) WHERE bad >= k AND bad <= size - (n - k)),
c AS (SELECT n, size, k, delta, bad, sum({"exp(lgamma(bad + 1.0) - lgamma(i + 1.0) - lgamma(bad - i + 1.0) + lgamma(size - bad + 1.0) - lgamma(n - i + 1.0) - lgamma(size - bad - n + i + 1.0) - lgamma(size + 1.0) + lgamma(n + 1.0) + lgamma(size - n + 1.0))"}) AS cdf
  FROM m CROSS JOIN range(0, 6) t(i) WHERE i <= k AND n - i <= size - bad GROUP BY ALL)
SELECT n, size, k, round(max(bad) / size, 9) AS exact,
       round(least(1, k / n + sqrt(2 * (k * (n - k) / (n * (n - 1))) * ln(2 / delta) / n) + 7 * ln(2 / delta) / (3 * (n - 1))), 9) AS empirical_bernstein
FROM c WHERE cdf > delta GROUP BY n, size, k, delta""")
def bounds_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, size, k, round(bounds.exact(k, n, size, 0.1 / 12), 9), round(bounds.empirical_bernstein(k, n, size, 0.1 / 12), 9)) for n in (45, 90, 180) for size in (600, 1800) for k in (0, 1, 5)]
    return spark.createDataFrame(rows, "n int, size int, k int, exact double, empirical_bernstein double")


@query("calibration")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = [evaluate.calibration(spark, 1800, rate, 0.1, 0.1).withColumn("rate", F.lit(rate)) for rate in (0.0, 0.05, 0.1, 0.12)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("overdispersion")
def overdispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = [evaluate.overdispersion(spark, 1800, 0.1, 0.05, phi).withColumn("phi", F.lit(phi)) for phi in (1.0, 2.0, 4.0)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("boundary_exact")
def boundary_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact probabilities of certifying a stratum just above the budget, one task for each case."""
    grid = [(size, alpha, mode) for size in (600, 1800) for alpha in (0.05, 0.1, 0.2) for mode in (False, True)]

    def run(frames):
        for pdf in frames:
            yield pdf.assign(probability=[bounds.unsafe_probability(int(r.size_), int(r.alpha * r.size_ + 1e-9) + 1, r.alpha, 0.05, reuse_set=bool(r.reuse_set)) for r in pdf.itertuples()])

    return spark.createDataFrame(grid, "size_ int, alpha double, reuse_set boolean").repartition(12, "size_", "alpha", "reuse_set").mapInPandas(run, "size_ int, alpha double, reuse_set boolean, probability double")


# labels, drift, agreement


@query("flip_label", f"WITH {_cells_sql('other')} SELECT row_id, flip FROM cells")
def flip_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_cells(spark, sf_dir, "other").select("row_id", "flip")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("graded_flip", "SELECT o_orderkey, (abs(substr(o_orderpriority, 1, 1)::INT - (1 + o_orderkey % 5)) > 1)::INT AS flip FROM orders")
def graded_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.get(F.array(*map(F.lit, PRIORITIES)), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", evaluate.graded_flip(F.col("o_orderpriority"), other, PRIORITIES).alias("flip"))


@query("vote_k", "SELECT user_id, CASE WHEN count(b) = 0 THEN NULL ELSE sum(b::INT) * 2 > count(b) END AS answer, count(b) AS votes FROM (SELECT user_id, CASE WHEN event_id % 7 <> 0 THEN value >= 20 END AS b FROM events) GROUP BY user_id")
def vote_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "events").withColumn("b", F.when(F.col("event_id") % 7 != 0, F.col("value") >= 20))
    return b.groupBy("user_id").agg(evaluate.vote(F.col("b")).alias("answer"), F.count("b").alias("votes"))


@query("drift_compare", """WITH d AS (SELECT (value >= 100)::VARCHAR AS a, (value >= 102)::VARCHAR AS b FROM events) SELECT a || '->' || b AS direction, count(*) AS n FROM d WHERE a <> b GROUP BY direction""")
def drift_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_cells(spark, sf_dir, "small")
    return evaluate.drift(c.select("row_id", "value"), c.select("row_id", F.col("fresh").alias("value")))


@query("paired_flips", "WITH f AS (SELECT ((value >= 100) <> (value >= 102))::INT AS a, ((value >= 100) <> (value >= 100 OR (event_type = 'error' AND user_id % 7 = 0)))::INT AS b FROM events) SELECT count(*) AS n, count(*) FILTER (a = 1 AND b = 0) AS only_first, count(*) FILTER (a = 0 AND b = 1) AS only_second, count(*) FILTER (a = 1 AND b = 1) AS in_both FROM f")
def paired_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = event_cells(spark, sf_dir, "small").select("row_id", F.col("flip").alias("a"))
    b = event_cells(spark, sf_dir, "other").select("row_id", F.col("flip").alias("b"))
    return evaluate.paired_flips(a.join(b, "row_id"), "a", "b")


@query("kappa", "WITH s AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS agree, avg(quality) AS pa, avg(toxic) AS pb FROM labels) SELECT n, round(agree, 9) AS agree, round((agree - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 9) AS kappa FROM s")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = evaluate.kappa(table(spark, sf_dir, "labels"), "quality", "toxic")
    return k.select("n", F.round("agree", 9).alias("agree"), F.round("kappa", 9).alias("kappa"))


@query("auc", "WITH r AS (SELECT (event_type = 'error')::INT AS y, row_number() OVER (ORDER BY value, event_id) AS r FROM events) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 9) AS auc FROM r")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_type") == "error").cast("int").alias("y"))
    return evaluate.auc(e, "value", "y", "event_id").select(F.round("auc", 9).alias("auc"))


@query("tau_sweep", f"WITH {_cells_sql('small')}, s AS (SELECT row_id, flip, (row_id % 101) / 100 AS score FROM cells) SELECT tau, count(*) AS cells, count(*) FILTER (score >= tau) AS reused, coalesce(sum(flip) FILTER (score >= tau), 0)::BIGINT AS reused_flips FROM s CROSS JOIN (SELECT unnest([0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0])::DOUBLE AS tau) GROUP BY tau")
def tau_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_cells(spark, sf_dir, "small").withColumn("score", F.col("row_id") % 101 / 100)
    return evaluate.tau_sweep(c, "score", (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0))


@query("supg")
def supg(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_cells(spark, sf_dir, "small").withColumn("score", F.col("row_id") % 101 / 100)
    return evaluate.supg(c, "score", 0.1, 0.1, 500, (0.0, 0.25, 0.5, 0.75, 0.9))


@query("audit", certify_sql("other", Procedure(), """, reuse AS (SELECT flip, row_number() OVER (PARTITION BY r.stratum ORDER BY place) AS k FROM ranked r JOIN decided d USING (stratum) WHERE certified AND place > n)
SELECT count(*) AS audited, sum(flip)::BIGINT AS flips, round(avg(flip), 9) AS error, sum(flip) <= 0.1 * count(*) AS within FROM reuse"""))
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = event_cells(spark, sf_dir, "other")
    fates = certify.partition_cells(cells, certify.replay(cells, Procedure()), Procedure())
    out = evaluate.audit(fates.where("fate = 'reuse'").select("row_id", "value"), cells.select("row_id", F.col("fresh").alias("value")), 0.1)
    return out.withColumn("error", F.round("error", 9))


@query("baselines", f"WITH {_cells_sql('other')} SELECT count(*) AS full_cost, 0.0::DOUBLE AS full_error, 0 AS blind_cost, round(avg(flip), 9) AS blind_error FROM cells")
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.baselines(event_cells(spark, sf_dir, "other")).withColumn("blind_error", F.round("blind_error", 9))


@query("family_cert", "SELECT event_type AS model, round(avg((event_id % 13 = 0)::INT), 9) AS floor, round(avg(((value >= 100) <> (value >= 102))::INT), 9) AS edit, avg(((value >= 100) <> (value >= 102))::INT) < 2 * avg((event_id % 13 = 0)::INT) AS floor_dominated FROM events GROUP BY event_type")
def family_cert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_cells(spark, sf_dir, "small").select(F.col("event_type").alias("model"), (F.col("row_id") % 13 == 0).cast("int").alias("self_flip"), F.col("flip").alias("edit_flip"))
    return evaluate.family(c).withColumns({"floor": F.round("floor", 9), "edit": F.round("edit", 9)})


# draws in the order of time, by type of event


@query("lag1", "WITH x AS (SELECT event_type, ts, event_id, value - avg(value) OVER (PARTITION BY event_type) AS d FROM events), y AS (SELECT event_type, d, lag(d) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM x) SELECT event_type, count(*) AS n, round(coalesce(sum(d * p) / sum(d * d), 0), 8) AS lag1 FROM y GROUP BY event_type")
def lag1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.lag1(table(spark, sf_dir, "events"), ["ts", "event_id"], "value", ["event_type"]).withColumn("lag1", F.round("lag1", 8))


@query("block_dispersion", """WITH f AS (SELECT event_type, (value >= 20)::INT AS k, floor((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) / 32) AS b FROM events),
b AS (SELECT event_type, b, sum(k) AS k FROM f GROUP BY event_type, b HAVING count(*) = 32),
s AS (SELECT event_type, count(*) AS blocks, sum(k) / (32 * count(*)) AS p, var_samp(k) AS v FROM b GROUP BY event_type)
SELECT event_type, blocks, round(p, 9) AS p, round(v / (32 * p * (1 - p)), 8) AS ratio, greatest(1, blocks - 1) AS df, round(v / (32 * p * (1 - p)) * greatest(1, blocks - 1), 6) AS chi2 FROM s""")
def block_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", (F.col("value") >= 20).cast("int"))
    out = evaluate.block_dispersion(e, ["ts", "event_id"], "k", ["event_type"])
    return out.withColumns({"p": F.round("p", 9), "ratio": F.round("ratio", 8), "chi2": F.round("chi2", 6)})


@query("latency_split", "SELECT slower, count(*) AS n, sum(k)::BIGINT AS flips FROM (SELECT (value >= 20)::INT AS k, ntile(2) OVER (ORDER BY event_id % 700, event_id) = 2 AS slower FROM events) GROUP BY slower")
def latency_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") >= 20).cast("int").alias("k"), (F.col("event_id") % 700).alias("latency"))
    return evaluate.latency_split(e, "latency", "k", "event_id")


@query("wilson", "WITH s AS (SELECT event_type, sum((value >= 20)::INT) AS k, count(*) AS n FROM events GROUP BY event_type), p AS (SELECT event_type, k / n AS p, n, 1.96 * 1.96 AS z FROM s) SELECT event_type, round((p + z / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n), 9) AS low, round((p + z / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n), 9) AS high FROM p")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") >= 20).alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return s.select("event_type", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("two_prop_z", "WITH s AS (SELECT sum((value >= 20)::INT) FILTER (user_id % 2 = 0) AS k1, count(*) FILTER (user_id % 2 = 0) AS n1, sum((value >= 20)::INT) FILTER (user_id % 2 = 1) AS k2, count(*) FILTER (user_id % 2 = 1) AS n2 FROM events), p AS (SELECT *, (k1 + k2) / (n1 + n2) AS p FROM s) SELECT round((k1 / n1 - k2 / n2) / sqrt(p * (1 - p) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)), 8) AS z FROM p")
def two_prop_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit, even = F.col("value") >= 20, F.col("user_id") % 2 == 0
    s = table(spark, sf_dir, "events").agg(F.count_if(hit & even).alias("k1"), F.count_if(even).alias("n1"), F.count_if(hit & ~even).alias("k2"), F.count_if(~even).alias("n2"))
    return s.select(F.round(stats.two_proportions_z(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2")), 8).alias("z"))


@query("cal_sample", "SELECT event_type, event_id, place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || event_id::VARCHAR), event_id) AS place FROM events) WHERE place <= CASE WHEN event_type = 'error' THEN 50 ELSE 17 END")
def cal_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.calibration_sample(table(spark, sf_dir, "events"), ["event_type"], F.when(F.col("event_type") == "error", 50).otherwise(17), 7, "event_id")
    return out.select("event_type", "event_id", F.col("place").cast("long").alias("place"))


@query("label_export", "WITH d AS (SELECT doc_id % 8 AS pair, doc_id, source, quality, (row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id, source, quality) - 1) // 1000 AS piece FROM documents LEFT JOIN labels USING (doc_id)) SELECT pair, piece, string_agg(doc_id::VARCHAR || '=' || source || '/' || coalesce(quality::VARCHAR, '-'), ' ' ORDER BY doc_id) AS labels FROM d GROUP BY pair, piece")
def label_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = (F.col("doc_id") % 8).alias("pair")
    old = table(spark, sf_dir, "documents").select(pair, F.col("doc_id").alias("row_id"), F.col("source").alias("value"))
    new = table(spark, sf_dir, "labels").select(pair, F.col("doc_id").alias("row_id"), F.col("quality").cast("string").alias("value"))
    both = F.zip_with(F.zip_with("row_ids", "cached", lambda i, v: F.concat(i.cast("string"), F.lit("="), v)), "fresh", lambda a, q: F.concat(a, F.lit("/"), F.coalesce(q, F.lit("-"))))
    return evaluate.label_export(old, new).select("pair", "piece", F.array_join(both, " ").alias("labels"))


_FAILED = "CASE WHEN event_id % 13 <> 0 THEN ((value >= 100) <> (value >= 102))::INT END"


@query("failure_as_flip", f"SELECT event_type, count(*) AS n, count(*) FILTER (f IS NULL) AS failed, round(avg(f), 9) AS rate_without, round(avg(coalesce(f, 1)), 9) AS rate_as_flips FROM (SELECT event_type, {_FAILED} AS f FROM events) GROUP BY event_type")
def failure_as_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thirteenth call failed."""
    c = event_cells(spark, sf_dir, "small").withColumn("flip", F.when(F.col("row_id") % 13 != 0, F.col("flip")))
    return evaluate.failure_as_flip(c, "event_type").withColumns({x: F.round(x, 9) for x in ("rate_without", "rate_as_flips")})


@query("bound_ablation")
def bound_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five bounds at four budgets over the same order of cells."""
    out = evaluate.bound_ablation(event_cells(spark, sf_dir, "other"), Procedure(), list(bounds.BOUNDS), (0.05, 0.1, 0.15, 0.2))
    return out.withColumn("savings", F.round("savings", 9))


@query("aggregate_cert", f"""WITH cells AS (SELECT event_id AS row_id, event_type, 'all' AS stratum, ((value >= 100) <> ({EDITS['small']}))::INT AS flip FROM events), {_exact_sql(Procedure())},
ranked AS (SELECT stratum, row_id, row_number() OVER w AS place, sum(flip) OVER (w ROWS UNBOUNDED PRECEDING) AS flips FROM cells WINDOW w AS (PARTITION BY stratum ORDER BY md5('42:' || row_id::VARCHAR), row_id)),
seen AS (SELECT k.stratum, size, look, n, flips, flips <= k_max AS certified, flips > k_max AND flips > 0.1 * n AS futile FROM kmax k JOIN ranked r ON r.stratum = k.stratum AND r.place = k.n),
decided AS (SELECT * FROM seen QUALIFY row_number() OVER (ORDER BY CASE WHEN certified OR futile THEN look ELSE 1000 - look END) = 1)
SELECT event_type, count(*) FILTER (certified AND place > n) AS reused, coalesce(sum(flip) FILTER (certified AND place > n), 0)::BIGINT AS flips FROM cells JOIN ranked USING (row_id) CROSS JOIN decided GROUP BY event_type""")
def aggregate_cert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One certificate over all cells, and what it leaves in each event type."""
    c = event_cells(spark, sf_dir, "small").withColumn("stratum", F.lit("all"))
    p = Procedure()
    decisions = certify.replay(c, p)
    fates = certify.partition_cells(c, decisions, p)
    return evaluate.subgroup_error(c, decisions, fates.where("fate = 'sampled'"), "event_type")


@query("path_replay", f"WITH {_cells_sql('other')} SELECT stratum, n, sum(flip)::BIGINT AS flips FROM (SELECT stratum, flip, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || row_id::VARCHAR), row_id) AS place FROM cells) JOIN (SELECT unnest([45, 90, 180]) AS n) ON place <= n GROUP BY stratum, n HAVING max(place) = n")
def path_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looks recorded twice come to one path."""
    r = certify.ranked(event_cells(spark, sf_dir, "other"), rng.hash_order(42, F.col("row_id")), 180).where(F.col("place").isin(45, 90, 180)).select("stratum", F.col("place").cast("int").alias("n"), F.col("flips").cast("long").alias("flips"))
    return evaluate.path_replay(r.unionByName(r))


@query("noise_floor", "SELECT event_type AS regime, count(*) AS n, round(avg(((value >= 100) <> (value >= 102))::INT), 9) AS self_flip FROM events GROUP BY event_type")
def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_cells(spark, sf_dir, "small").select(F.col("event_type").alias("regime"), F.col("value").alias("a"), F.col("fresh").alias("b"))
    return evaluate.noise_floor(c).withColumn("self_flip", F.round("self_flip", 9))


@query("label_noise", """WITH r AS (SELECT event_type AS labeling, user_id, avg((value >= 20)::INT) AS savings, sum((value >= 100)::INT) AS reused FROM events GROUP BY ALL),
e AS (SELECT labeling, avg(savings) AS savings, avg((reused > 0)::INT) AS certified FROM r GROUP BY labeling)
SELECT round(min(savings), 9) AS least_savings, round(max(savings), 9) AS most_savings, round(min(certified), 9) AS least_certified, round(max(certified), 9) AS most_certified FROM e""")
def label_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("labeling"), "user_id").agg(F.avg((F.col("value") >= 20).cast("int")).alias("savings"), F.count_if(F.col("value") >= 100).alias("reused"))
    out = evaluate.label_noise(r)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("exclusion_check", "SELECT event_id % 11 = 0 AS dropped, count(*) AS n, sum((value >= 20)::INT)::BIGINT AS flips, round(avg((value >= 20)::INT), 9) AS rate FROM events GROUP BY dropped")
def exclusion_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 11 == 0).alias("dropped"), (F.col("value") >= 20).cast("int").alias("k"))
    return evaluate.exclusion_check(e, "dropped", "k").withColumn("rate", F.round("rate", 9))


@query("median_latency", "SELECT value AS median FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i = n // 2")
def median_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.median_nearest(table(spark, sf_dir, "events"), "value")


@query("drift_summary", "WITH s AS (SELECT count(*) AS n, sum(((value >= 100) <> (value >= 102))::INT)::BIGINT AS k FROM events), p AS (SELECT n, k, k / n AS p, 1.96 * 1.96 AS z FROM s) SELECT n, k, round(p, 9) AS rate, round((p + z / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n), 9) AS low, round((p + z / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n), 9) AS high FROM p")
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_cells(spark, sf_dir, "small")
    out = evaluate.drift_summary(c.select("row_id", "value"), c.select("row_id", F.col("fresh").alias("value")))
    return out.withColumns({x: F.round(x, 9) for x in ("rate", "low", "high")})


@query("supg_value")
def supg_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_cells(spark, sf_dir, "small").withColumn("score", F.col("row_id") % 101 / 100)
    return evaluate.supg_by_value(c, "score", 0.1, 0.1, 600, (0.0, 0.25, 0.5, 0.75, 0.9), ("true", "false"))


@query("lag1_int", "SELECT event_type, count(*) AS n, sum(k)::BIGINT AS flips, coalesce(sum(k * p), 0)::BIGINT AS pairs FROM (SELECT event_type, k, lag(k) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM (SELECT *, (value >= 20)::INT AS k FROM events)) GROUP BY event_type")
def lag1_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", (F.col("value") >= 20).cast("int"))
    return evaluate.lag1_counts(e, ["ts", "event_id"], "k", ["event_type"])
