import math
import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import bounds as b
from quillstone.functions import rng, stats, text

D = 0.1 / 12


@pytest.mark.parametrize(("got", "want"), [
    (lambda: b.exact(1, 45, 81469, D), 0.14261866476819404), (lambda: b.exact(80, 1440, 81469, D), 0.07153641262320637), (lambda: b.exact(0, 90, 1800, D), 0.05), (lambda: b.empirical_bernstein(5, 174, 0, 0.05), 0.11298924056128),
    (lambda: b.empirical_bernstein(14, 594, 0, 0.0125), 0.06338623963163), (lambda: b.empirical_bernstein(6, 360, 0, 0.0125), 0.07117917094981), (lambda: b.betting([0] * 90, 0.05), 0.065),
    (lambda: b.unsafe_probability(600, 31, 0.05, 0.05), 0.013391505038395066), (lambda: b.unsafe_probability(600, 22, 0.05, 0.05, reuse_set=True), 0.003607173489645812), (lambda: b.unsafe_probability(1800, 91, 0.05, 0.05), 0.02267650998851728),
])
def test_golden_bounds(got, want):
    assert got() == pytest.approx(want, abs=1e-11)


def test_golden_tables():
    assert [round(f(0, 90, 1800, D), 4) for f in (b.exact, b.clopper_pearson, b.empirical_bernstein, b.without_replacement)] == [0.05, 0.0518, 0.1437, 0.3166]
    assert [round(f(5, 180, 81469, D), 3) for f in (b.exact, b.clopper_pearson, b.empirical_bernstein, b.without_replacement)] == [0.073, 0.073, 0.14, 0.23]
    assert b.min_zero(0.05, 0.05) == 174
    assert b.look_schedule(600, 0.05, 0.05) == [45, 90, 180, 360, 600] and b.look_schedule(1800, 0.05, 0.05) == [45, 90, 180, 360, 720, 1440]
    assert b.look_schedule(1814, 0.02, 0.05, most=4) == [45, 90, 180, 594] and b.look_schedule(186, 0.1, 0.05) == [45, 90, 180, 186] and b.look_schedule(20, 0.1, 0.05) == [20]
    ns = (45, 90, 180, 360, 720, 1440)
    assert [b.k_max(n, 81469, 0.2, 0.05 / 6) for n in ns] == [2, 8, 23, 53, 118, 251] and [b.k_max(n, 81469, 0.1, 0.05 / 6) for n in ns] == [-1, 2, 8, 22, 52, 117]


def test_bounds_at_the_edges():
    for f in b.BOUNDS.values():
        assert f(0, 0, 100, 0.1) == 1.0
    assert b.exact(3, 50, 50, 0.1) == 3 / 50 and b.exact(5, 5, 50, 0.1) == 1.0 and b.clopper_pearson(5, 5, 50, 0.1) == 1.0 and b.betting([], 0.1) == 1.0
    assert b.dispersed(5, 180, 0, D, 1.0) == pytest.approx(b.clopper_pearson(5, 180, 0, D), abs=1e-9) and b.dispersed(5, 180, 0, D, 2.0) > b.dispersed(5, 180, 0, D, 1.0)
    with pytest.raises(ValueError):
        b.dispersed(1, 10, 0, 0.1, 0.5)


def test_exact_bound_holds():
    """The bound is below the truth with probability delta at most."""
    for total, bad in ((200, 20), (200, 3), (60, 30)):
        miss = sum(math.comb(bad, k) * math.comb(total - bad, 40 - k) / math.comb(total, 40) for k in range(min(40, bad) + 1) if b.exact(k, 40, total, 0.1) < bad / total)
        assert miss <= 0.1


def test_draws(spark):
    r = rng.draws(42)
    assert [next(r) for _ in range(3)] == [0.6011037519201636, 0.44829055899754167, 0.8524657934904099] and rng.shuffled(range(10), 42) == [0, 7, 3, 5, 2, 1, 8, 9, 4, 6]
    seeds = [0, 1, 42, 2**31, 2**32 - 1, 123456789]
    df = spark.createDataFrame([(s, k) for s in seeds for k in range(1, 30)], "s long, k int")
    got = {(r.s, r.k): r.d for r in df.withColumn("d", rng.mulberry32(F.col("s"), F.col("k"))).collect()}
    for s in seeds:
        it = rng.draws(s)
        assert [got[s, k] for k in range(1, 30)] == [next(it) for _ in range(29)]


def test_replay_order(spark):
    cells = spark.createDataFrame([("s1", str(i), f"h{i % 3}") for i in range(50)] + [("s2", "x", "h")], "stratum string, row_id string, content string")
    got = {(r.stratum, r.place): r.row_id for r in rng.replay_order(cells.repartition(5), rng.experiment_seed(7), content="content").collect()}
    start = [i for _, i in sorted((f"h{i % 3}", str(i)) for i in range(50))]
    assert [got["s1", p] for p in range(1, 51)] == rng.shuffled(start, 7 + 2 * 7919)


def test_replay_order_takes_no_stratum_in_one_task(spark):
    sizes = {"a": 1, "b": 2, "c": 3, "dd": 700, "eee": 2500}
    cells = spark.createDataFrame([(s, i, f"{s}{i}") for s, n in sizes.items() for i in range(n)] + [("twice", 7, "x"), ("twice", 7, "x"), ("twice", 1, "y")], "g string, id long, more string").repartition(5)
    whole = rng.replay_order(cells, rng.experiment_seed(7), "g", "id")
    assert "InPandas" not in whole._jdf.queryExecution().toString()
    got = {(r.stratum, r.place): r.row_id for r in whole.collect()}
    want = {s: rng.shuffled(sorted(range(n), key=str), 7 + len(s) * 7919) for s, n in sizes.items()} | {"twice": rng.shuffled([1, 7, 7], 7 + 5 * 7919)}
    assert got == {(s, p): i for s, ids in want.items() for p, i in enumerate(ids, 1)}
    some = rng.replay_order(cells, rng.experiment_seed(7), "g", "id", first=40, keep=["more"]).collect()
    assert sorted((r.stratum, r.place, r.row_id) for r in some) == sorted((s, p, i) for (s, p), i in got.items() if p <= 40)
    assert all(r.more == f"{r.stratum}{r.row_id}" for r in some if r.stratum != "twice")
    assert rng.replay_order(cells.limit(0), rng.experiment_seed(7), "g", "id").count() == 0


def test_normalisation(spark):
    df = spark.createDataFrame([(v,) for v in (None, "", "NA", " a ; b;;", "3.5", "less THAN 1 year", "More than 50 years", "NaN", "1e999", "x")], "v string")
    v = F.col("v")
    rows = df.select(text.norm_na(v), text.norm_multi(v), text.norm_num(v), text.norm_years(v), text.norm_text(v)).collect()
    assert [r[0] for r in rows][:4] == [None, None, None, " a ; b;;"] and [r[1] for r in rows][:4] == [[], [], [], ["a", "b"]]
    assert [r[2] for r in rows][4:] == [3.5, None, None, None, None, None] and [r[3] for r in rows][4:8] == [3.5, 0.5, 51.0, None] and rows[1][4] is None and rows[3][4] == "a ; b;;"


def test_templates(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"], 5.0, None), (2, None, [], 0.5, "t"), (3, "q", None, 1e8, "$1 {{a}}")], "n int, a string, l array<string>, d double, t string")
    types = dict(df.dtypes)
    bound = [r[0] for r in df.orderBy("n").select(text.bind_text("{{ a }}|{{l}}|{{d}}|{{t}}|{{n}}.", types)).collect()]
    assert bound == ["a|x, y|5|(unknown)|1.", "(unknown)||0.5|t|2.", "q|(unknown)|100000000|$1 {{a}}|3."]
    assert text.template_fields("{{a}} {{ b }} {{a}} {{no-t}}") == ["a", "b", "a"]
    h = [r[0] for r in df.select(text.content_hash("{{a}} {{l}} {{a}}", types)).collect()]
    same = [r[0] for r in df.withColumn("d", F.lit(9.0)).select(text.content_hash("other {{a}} text {{l}}", types)).collect()]
    assert h == same and len(set(h)) == 3
    with pytest.raises(ValueError):
        text.bind_text("{{nope}}", types)
    assert df.select(text.content_hash("constant", types)).distinct().count() == 1


def test_tokens_and_diff(spark):
    t = "The C++ and {{field_name}} node.js, c# THE 12 go go experience experience"
    assert text.tokens_of(t) == ["c++", "node.js", "experience"]
    assert spark.createDataFrame([(t,)], "t string").select(text.tokens(F.col("t"))).first()[0] == text.tokens_of(t)
    d = text.prompt_diff("Is this person senior or not", "Is this developer very senior")
    assert d == {"added": ["developer", "very"], "removed": ["person", "or", "not"], "terms": ["developer", "very", "person"]}
    assert text.prompt_diff("same", "same") == {"added": [], "removed": [], "terms": []}
    assert text.fnv1a32("col:1:2") == 2835551380
    s = spark.createDataFrame([("a developer very",), ("nothing",), (None,)], "t string").select(text.overlap_bucket(text.overlap_score(F.col("t"), ["developer", "very", "x y"])))
    assert [r[0] for r in s.collect()][:2] == ["1-2", "0"]


def test_titles(spark):
    long = "word " * 30
    got = [r[0] for r in spark.createDataFrame([("# *Hi*\n there",), (long,)], "t string").select(text.fallback_title(F.col("t"))).collect()]
    assert got[0] == "Hi there" and got[1].endswith("...") and len(got[1]) <= 72


def test_statistics():
    assert stats.mcnemar(0, 0) == 1.0 and stats.mcnemar(10, 2) == pytest.approx(0.03857421875) and stats.normal_tail(1.96) == pytest.approx(0.0499958, abs=1e-6)
    assert stats.chi2_quantile(0.025, 10) == pytest.approx(3.24697, abs=1e-4) and stats.chi2_quantile(0.975, 1) == pytest.approx(5.02389, abs=1e-4)
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.22814, abs=1e-4) and stats.df_factor(10, 1e6) == pytest.approx((2.22814 / 1.95997) ** 2, abs=1e-3)
    assert b.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248) and b.incomplete_beta(0.5, 0.5, 0.5) == pytest.approx(0.5)
    assert random.Random(1).random() < 1


def test_md5_heads_are_those_of_the_library():
    """Leads and texts of all lengths around the ends of blocks, and texts of other lengths beside them."""
    import hashlib

    from quillstone.functions import md5

    texts = [b"", "é\U0001f600".encode(), b"z" * 1000, *[b"x" * k for k in range(40, 140)], *[str(i * 37).encode() for i in range(300)]]
    for some in ([b"1000:", b"1999:"], [b"7:"], [b"-12345678:", b"-12345679:"], [b""], [b"abcdefgh" * 9]):
        got = {}
        for at, words in md5.padded(texts, len(some[0])):
            head = md5.heads(words, md5.leads(some))
            got |= {(lead, int(k)): int(head[i, j]) for i, lead in enumerate(some) for j, k in enumerate(at)}
        assert got == {(lead, k): int(hashlib.md5(lead + t).hexdigest()[:8], 16) for lead in some for k, t in enumerate(texts)}
