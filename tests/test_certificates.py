import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import bounds, rng
from quillstone.operators import certify, evaluate, strata
from quillstone.operators.certify import Procedure


def cells(spark, *spec):
    """spec: (value, size, flips)."""
    rows = []
    for value, size, flips in spec:
        r = random.Random(size)
        bad = set(r.sample(range(size), flips))
        rows += [(f"{value}-{i}", value, "other" if i in bad else value) for i in range(size)]
    df = spark.createDataFrame(rows, "row_id string, value string, fresh string")
    return strata.value_only(df.withColumn("flip", evaluate.flip_label(F.col("value"), F.col("fresh")))).cache()


def plain(rows, p, order):
    """Sequential certification of {stratum: {row: flip}}."""
    out = {}
    for s, flips in rows.items():
        ns = bounds.look_schedule(len(flips), p.alpha, p.delta / len(rows), p.first, p.most)
        seq = [flips[i] for i in order(s, list(flips))]
        for look, n in enumerate(ns, 1):
            k = sum(seq[:n])
            limit = p.alpha * (len(seq) - n) / len(seq) if p.reuse_set else p.alpha
            sure = n < len(seq) and bounds.BOUNDS[p.bound](k, n, len(seq), p.delta / len(rows) / len(ns)) <= limit
            if sure or k / n > p.alpha or look == len(ns):
                out[s] = (look, n, k, sure)
                break
    return out


@pytest.mark.parametrize("p", [Procedure(), Procedure(alpha=0.05), Procedure(alpha=0.2, reuse_set=True), Procedure(bound="clopper_pearson"), Procedure(bound="empirical_bernstein", alpha=0.3), Procedure(bound="without_replacement", alpha=0.5), Procedure(alpha=0.1, most=3, first=60)])
def test_replay_as_sequential(spark, p):
    df = cells(spark, ("a", 3000, 20), ("b", 900, 200), ("c", 300, 25), ("d", 40, 0), ("e", 700, 0))
    rows = {}
    for r in df.collect():
        rows.setdefault(r.stratum, {})[r.row_id] = r.flip
    import hashlib

    by_hash = lambda s, ids: sorted(ids, key=lambda i: (hashlib.md5(f"{p.seed}:{i}".encode()).hexdigest(), i))
    got = {r.stratum: (r.look, r["n"], r.flips, r.certified) for r in certify.replay(df.repartition(7), p).collect()}
    assert got == plain(rows, p, by_hash)
    shuffled = {r.stratum: (r.look, r["n"], r.flips, r.certified) for r in certify.replay(df.repartition(3), p, order="replay").collect()}
    assert shuffled == plain(rows, p, lambda s, ids: rng.shuffled(sorted(ids), p.seed))
    assert not got["v=d|all"][3]


def test_live_asks_once_and_recomputes_failures(spark):
    df = cells(spark, ("a", 2000, 10), ("b", 500, 300))
    asked = []

    def oracle(ids):
        asked.extend(r[0] for r in ids.collect())
        return ids.join(df.select("row_id", F.col("fresh").alias("value")), "row_id").where(~F.col("row_id").endswith("77"))

    p = Procedure()
    out = certify.certify_live(df.select("row_id", "value"), oracle, p, keep=lambda d, n: d.cache())
    assert len(asked) == len(set(asked)) == out.oracle_calls
    fates = {r.fate: r["n"] for r in out.cells.groupBy("fate").agg(F.count("*").alias("n")).collect()}
    assert sum(fates.values()) == 2500 and fates["sampled"] + sum(i.endswith("77") for i in asked) == len(asked)
    assert out.cells.where("fate = 'sampled' and fresh is null").count() == 0 and out.cells.where("fate = 'reuse' and fresh is not null").count() == 0
    failing = df.withColumn("flip", F.when(~F.col("row_id").endswith("77"), F.col("flip")))
    same = lambda rows: sorted((r.stratum, r.look, r["n"], r.flips, r.certified) for r in rows.collect())
    assert same(out.decisions) == same(certify.replay(failing, p))
    row = certify.certificate(out, p, "id", "c", 1, 2, "{}").first()
    assert row.reused_count == fates.get("reuse", 0) and row.alpha == 0.1 and '"stratum":"v=a|all"' in row.strata


def test_strata(spark):
    df = spark.createDataFrame([(str(i), "t", float(v)) for i, v in enumerate([5, 1, 1, 1, 2, 3, 9])], "row_id string, value string, s double")
    got = {r.s: r.stratum for r in strata.tertiles("s")(df).collect()}
    order = sorted([5, 1, 1, 1, 2, 3, 9])
    a, b = order[7 // 3], order[14 // 3]
    assert got == {float(v): "v=t|" + ("low" if v <= a else "mid" if v <= b else "high") for v in order}
    assert strata.tertiles("s")(df.limit(0)).count() == 0 and strata.sizes(strata.single(df)).first()["size"] == 7
    with pytest.raises(ValueError):
        Procedure(bound="betting")


def test_large_strata_are_dealt_out(spark, monkeypatch):
    df = cells(spark, ("a", 3000, 100), ("b", 900, 200))
    want = sorted(map(tuple, certify.replay(df, Procedure()).collect()))
    monkeypatch.setattr(certify, "SPREAD", 200)
    assert sorted(map(tuple, certify.replay(df, Procedure()).collect())) == want


def test_fixed_plan(spark):
    df = cells(spark, ("a", 3000, 20), ("b", 900, 300))
    got = {r.stratum: (r["n"], r.certified) for r in certify.replay(df, Procedure(adaptive=False)).collect()}
    n = bounds.plan_fixed(3000, 0.1, 0.1, 2)
    assert got["v=a|all"] == (n, True) and got["v=b|all"] == (n, False)


def test_monte_carlo_agrees_with_replications(spark):
    df = cells(spark, ("a", 2000, 120), ("b", 400, 8)).select("stratum", "row_id", "flip")
    p = Procedure()
    exact = evaluate.replications(df, [p], 150).cache()
    fast = evaluate.summary(evaluate.monte_carlo(df, p, 4000)).first()
    assert exact.count() == 150 and abs(exact.agg(F.avg("savings")).first()[0] - fast["mean"]) < 0.05 and fast["runs"] == 4000
    assert exact.where("sampled + recompute + reused <> cells").count() == 0


def test_replications_by_cut_are_exact(spark, monkeypatch):
    """Orders that the cut leaves too short are ranked whole; every cut gives the replay of its seed."""
    df = cells(spark, ("a", 2000, 120), ("b", 400, 8), ("c", 3, 0)).select("stratum", "row_id", "flip")
    grid = [Procedure(alpha=a, reuse_set=r) for a in (0.05, 0.1) for r in (False, True)]
    want = {}
    for p in grid:
        for seed in (1000, 1001, 1002):
            rows = certify.replay(df, Procedure(alpha=p.alpha, reuse_set=p.reuse_set, seed=seed)).collect()
            want[seed, p.alpha, p.reuse_set] = (sum(r["n"] for r in rows), sum(r["size"] - r["n"] for r in rows if not r.certified))
    for margin in (6.0, 0.0, -1000.0):
        monkeypatch.setattr(evaluate, "MARGIN", margin)
        got = {(r.seed, r.alpha, r.reuse_set): (r.sampled, r.recompute) for r in evaluate.replications(df, grid, 3).collect()}
        assert got == want, margin
    assert evaluate.replications(df.limit(0), grid, 3).count() == 0 and evaluate.replications(df, grid, 0).count() == 0


def test_replications_hash_without_a_row_for_each_cell_and_seed(spark, monkeypatch):
    """Only what falls below the cuts becomes rows; ids that are null, long or repeated and seeds of several
    lengths hash as Spark's md5 does, whatever number is hashed together."""
    plans, keep = [], evaluate.materialize
    monkeypatch.setattr(evaluate, "materialize", lambda df, name: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), keep(df, name))[1])
    df = cells(spark, ("a", 900, 20)).select("stratum", "row_id", "flip")
    assert evaluate.replications(df, [Procedure()], 3).count() == 3
    assert [(n, "Generate" in p, "MapInArrow" in p) for n, p in plans] == [("places", False, True)]

    ids = [None, "", "é\U0001f600", "x" * 50, "y" * 51, "z" * 200, "twice", "twice", *map(str, range(700))]
    rows = spark.createDataFrame([("ab"[i % 2], x, i % 3 if i % 5 else None, (2**31, 2**32)[i % 2], x or "") for i, x in enumerate(ids)], "stratum string, row_id string, flip int, cut long, text string")
    head = F.conv(F.substring(F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), "text")), 1, 8), 16, 10).cast("long")
    for seeds in (range(-2, 12), range(998, 1002)):
        want = rows.crossJoin(spark.range(seeds[0], seeds[-1] + 1).withColumnRenamed("id", "seed")).where(head < F.col("cut"))
        want = sorted(map(tuple, want.select("seed", "stratum", "row_id", "flip").collect()), key=str)
        for together in (1 << 15, 100, 1):
            monkeypatch.setattr(evaluate, "TOGETHER", together)
            got = evaluate._below(rows, seeds).collect()
            assert sorted(map(tuple, got), key=str) == want and 0 < len(want) < len(ids) * len(seeds)


def test_certification_is_valid(spark):
    """Strata at, above and far above the budget are hardly ever, or never, certified."""
    rate = lambda **k: (lambda r: (r.certified / r.trials, r.wrong / r.trials))(evaluate.calibration(spark, k.pop("size", 1800), **k).first())
    assert rate(rate=0.0, alpha=0.1, delta=0.1)[0] > 0.95 and rate(rate=0.35, alpha=0.1, delta=0.1)[0] == 0
    for mode in (False, True):
        assert rate(rate=0.105, alpha=0.1, delta=0.1, reuse_set=mode)[1] <= 0.1
    plain_, wide = (evaluate.overdispersion(spark, 1800, 0.1, 0.05, phi, 20_000).first().certified for phi in (1.0, 4.0))
    assert plain_ < wide


def test_betting_replay(spark):
    df = cells(spark, ("a", 2000, 10), ("b", 500, 300))
    got = {r.stratum: r for r in evaluate.betting_replay(df, Procedure()).collect()}
    assert got["v=a|all"].certified and not got["v=b|all"].certified


def test_betting_replay_deals_large_strata_to_tasks(spark, monkeypatch):
    df = cells(spark, ("a", 2000, 10), ("b", 500, 300), ("c", 90, 4)).repartition(5)
    whole = sorted(evaluate.betting_replay(df, Procedure()).collect())
    monkeypatch.setattr(certify, "SPREAD", 100)
    dealt = evaluate.betting_replay(df, Procedure())
    assert "__deal" in dealt._jdf.queryExecution().toString()
    assert len(whole) == 3 and sorted(dealt.collect()) == whole
    want = hashlib_order([r.row_id for r in df.where("stratum = 'v=a|all'").collect()], 42)
    flips = {r.row_id: r.flip for r in df.collect()}
    a = next(r for r in whole if r.stratum == "v=a|all")
    assert a.flips == sum(flips[i] for i in want[: a["n"]])


def hashlib_order(ids, seed):
    import hashlib

    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def test_evaluations(spark):
    df = spark.createDataFrame([(1, 0.1, 0), (2, 0.4, 0), (3, 0.35, 1), (4, 0.8, 1), (5, 0.4, 1)], "i int, s double, y int")
    assert evaluate.auc(df, "s", "y", "i").first()[0] == pytest.approx(5 / 6) and evaluate.auc(df, "s", "y", "i", midranks=True).first()[0] == pytest.approx(4.5 / 6)
    assert evaluate.auc(df.where("y = 1"), "s", "y", "i").first()[0] == 0.5
    v = spark.createDataFrame([("a", True), ("a", True), ("a", False), ("b", None), ("c", True), ("c", False)], "g string, b boolean")
    assert {r.g: r.x for r in v.groupBy("g").agg(evaluate.vote(F.col("b")).alias("x")).collect()} == {"a": True, "b": None, "c": False}
    t = spark.createDataFrame([("lo", "hi"), ("lo", "mid")], "a string, b string")
    assert [r[0] for r in t.select(evaluate.graded_flip(F.col("a"), F.col("b"), ("lo", "mid", "hi"))).collect()] == [1, 0]
    with pytest.raises(Exception, match="unknown option"):
        t.select(evaluate.graded_flip(F.col("a"), F.lit("zz"), ("lo", "mid", "hi"))).collect()
    looks = spark.createDataFrame([("s", 45, 1), ("s", 45, 1), ("s", 90, 2)], "stratum string, n int, flips long")
    assert evaluate.path_replay(looks).count() == 2
    with pytest.raises(Exception, match="disagree"):
        evaluate.path_replay(looks.unionByName(spark.createDataFrame([("s", 45, 7)], looks.schema))).collect()
    assert evaluate.deflated_alpha(0.1, 0, 200) < 0.1 and evaluate.permutation_p(__import__("numpy").arange(5.0), 99.0, lambda x: x[0]) == 1 / 2001
    p = evaluate.supg(df.selectExpr("cast(i as string) row_id", "s", "0 flip"), "s", 0.5, 0.1, 5, (0.0,), least=1).first()
    assert p.selected == 5
    j = spark.createDataFrame([("x", "x", None, None), ("x", "y", "SAME", "SAME"), ("x", "y", "SAME", "NO"), ("x", "y", None, "SAME")], "a string, b string, ab string, ba string")
    assert [r[0] for r in j.select(evaluate.equivalent(*map(F.col, ("a", "b", "ab", "ba")))).collect()] == [True, True, False, None]


def test_the_row_before_over_partitions(spark):
    from quillstone.operators.tables import before

    rows = [("a" if i % 3 else None, i * 7 % 1000, i) for i in range(1000)] + [("b", 1, 5)]
    df = spark.createDataFrame(rows, "k string, t int, v long").repartition(5)
    got = {(r.k, r.t): r.prev for r in before(df, ["k"], ["t"], F.col("v"), "prev").collect()}
    want = {}
    for k in ("a", None, "b"):
        own = sorted((t, v) for x, t, v in rows if x == k)
        want |= {(k, t): own[i - 1][1] if i else None for i, (t, _) in enumerate(own)}
    assert got == want


def test_failures_subgroups_and_pieces(spark):
    df = spark.createDataFrame([("x", 1), ("x", 0), ("x", None), ("y", None)], "part string, flip int")
    got = {r.part: (r.n, r.failed, r.rate_without, r.rate_as_flips) for r in evaluate.failure_as_flip(df, "part").collect()}
    assert got == {"x": (3, 1, 0.5, 2 / 3), "y": (1, 1, None, 1.0)}
    c = spark.createDataFrame([(i, i % 2, "s" if i < 6 else "t") for i in range(9)], "row_id long, flip int, part string")
    drawn, yes = spark.createDataFrame([(0,), (1,)], "row_id long"), spark.createDataFrame([(True,)], "certified boolean")
    assert {tuple(r) for r in evaluate.subgroup_error(c, yes, drawn, "part").collect()} == {("s", 4, 2), ("t", 3, 1)}
    assert {tuple(r) for r in evaluate.subgroup_error(c, yes.where("not certified"), drawn, "part").collect()} == {("s", 0, 0), ("t", 0, 0)}
    old = spark.createDataFrame([(1, i, f"v{i}") for i in range(7)], "pair int, row_id int, value string")
    out = sorted(evaluate.label_export(old, old.where("row_id <> 3"), piece=3).collect(), key=lambda r: r.piece)
    assert [r.row_ids for r in out] == [[0, 1, 2], [3, 4, 5], [6]] and out[1].fresh == [None, "v4", "v5"]


def test_ablation_is_certification_by_each_bound(spark):
    c = cells(spark, ("a", 900, 20), ("b", 400, 90))
    for r in evaluate.bound_ablation(c, Procedure(), list(bounds.BOUNDS), (0.05, 0.1)).collect():
        one = certify.replay(c, Procedure(bound=r.bound, alpha=r.alpha)).collect()
        assert (r.certified, r.sampled, r.cells) == (sum(x.certified for x in one), sum(x.n for x in one), 1300)
