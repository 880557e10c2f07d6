import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm import minhash
from quillstone.llm.components import connected_components
from quillstone.llm.minhash import near_dedup, near_duplicates, shingle_sets
from tests.llm import helpers as h


def vary(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def near_rows(seed, groups=6, size=12, n=100):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(50)}g{g}" for _ in range(n)]
        for _ in range(size):
            rows.append(" ".join(vary(rng, base, rng.randint(0, 4))))
    rows += [" ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randint(1, 80))) for _ in range(40)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def result(df):
    return {r[0]: (r[1], r[2], r[3]) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()}


@pytest.mark.parametrize(("seed", "k", "block"), [(1, 4, 1000), (2, 5, 1000), (3, 4, 3)])
def test_as_all_pairs(spark, seed, k, block):
    rows = near_rows(seed)
    want = h.components(rows, k)
    got = result(near_duplicates(h.docs(spark, rows).repartition(5), shingle=k, block=block))
    assert {i: v[1] for i, v in got.items()} == want
    assert all(got[i] == (len(h.shingles(t, k)), want[i], want[i] == i) for i, t in rows)


def templates(n, own, base=140, seed=5):
    """Documents that share base words and own others: similar, but to less than 0.8 if own is large."""
    rng = random.Random(seed)
    shared = [f"shared{i}" for i in range(base)]
    return [(i, " ".join(shared + [f"d{i}w{rng.randrange(10**6)}" for _ in range(own)])) for i in range(n)]


@pytest.mark.parametrize(("block", "own"), [(10, 35), (10, 20), (5, 12)])
def test_crowded_buckets_as_all_pairs(spark, block, own):
    rng = random.Random(7)
    rows = templates(120, own)
    # some are near copies of others, some of a part of the template and of each other
    rows += [(200 + i, " ".join(vary(rng, rows[i][1].split(), 2 + i % 5))) for i in range(30)] + [(300 + i, " ".join(rows[i][1].split()[i % 40 :])) for i in range(60)]
    rows += [(400 + i, rows[i][1] + " " + " ".join(f"tail{j}" for j in range(i % 30))) for i in range(30)]
    rng.shuffle(rows)
    got = result(near_duplicates(h.docs(spark, rows), shingle=4, block=block))
    assert {i: v[1] for i, v in got.items()} == h.components(rows, 4)


def test_work_on_templates_grows_with_their_number(spark, monkeypatch):
    """What is compared, in a bucket and across blocks, for documents of one template that link with none."""
    old, counts = minhash._to_search, []

    def counted(*args):
        found = old(*args)
        counts.append(found.count())
        return found

    monkeypatch.setattr(minhash, "_to_search", counted)
    for n in (250, 500, 1000):
        rows = [*templates(n, 35), (n, "some other text of its own")]
        assert all(v[2] for v in result(near_duplicates(h.docs(spark, rows), shingle=4, block=50)).values())
    assert counts[1] <= 2.5 * counts[0] + 200 and counts[2] <= 2.5 * counts[1] + 200


def test_one_large_group_in_small_blocks(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(vary(rng, base, rng.randint(1, 5)))) for i in range(250)]
    got = result(near_duplicates(h.docs(spark, rows), shingle=4, block=20))
    assert {i: v[1] for i, v in got.items()} == h.components(rows, 4)


def test_awkward_documents(spark):
    rows = [(5, "a b c d e f g h"), (2, " A b\tC d e\nf g H "), (3, None), (4, ""), (6, " \n "), (7, "one two"), (8, "ONE two"), (9, "one"), (10, "two one"), (11, "É x"), (12, "é x"), (1, "a b c d e f g z"), (None, "one two"), (None, "nothing like it"), (13, "a b c d a b c d a b c d")]
    got = near_duplicates(h.docs(spark, rows), shingle=4).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert by[5] == (5, 2, False) and by[2] == (5, 2, True) and by[3] == (0, 3, True) and by[4] == (0, 4, True) and by[6] == (0, 6, True)
    assert by[7] == (1, 7, True) and by[8] == (1, 7, False) and by[9] == (1, 9, True) and by[10] == (1, 10, True) and by[11][1] == 11 and by[12][1] == 12 and by[1] == (5, 1, True) and by[13] == (4, 13, True)
    assert sorted((r.component_id, r.kept) for r in got if r.doc_id is None and r.component_id) == [(7, False)] and [r.kept for r in got if r.doc_id is None and r.component_id is None] == [True]


def test_threshold_is_inclusive(spark):
    # 9 shingles each, 8 shared: 8 of 10; one further word changed: 7 of 11
    a = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join(a)), (2, " ".join([*a[:11], "z"])), (3, " ".join([*a[:10], "y", "z"]))]
    assert {i: v[1] for i, v in result(near_duplicates(h.docs(spark, rows), shingle=4)).items()} == {1: 1, 2: 1, 3: 3}


def test_repeated_ids_empty_and_clash(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, "v w x y z"), (3, "a b c d e")]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(h.docs(spark, rows), shingle=4).collect()}
    assert (1, 1) in got and (2, 1) in got
    assert {c for i, c in got if i == 3} == {1}
    assert near_duplicates(h.docs(spark, []), shingle=4).count() == 0 and near_dedup(h.docs(spark, [])).count() == 0
    clash = h.docs(spark, rows).withColumn("id", F.lit(0)).withColumn("Kept", F.lit("old")).withColumn("component_id", F.lit(-1))
    out = near_dedup(clash)
    assert out.columns == clash.columns and {r.doc_id for r in out.collect()} <= {1, 3}


def test_an_id_has_the_links_of_each_of_its_texts(spark):
    rng = random.Random(3)
    bases = [[f"t{g}w{i}" for i in range(100)] for g in range(4)]
    # ids 0 and 1 hold texts of two groups each, which joins groups 0, 1 and 2; group 3 stays apart
    rows = [(i, " ".join(bases[g])) for i, g in ((0, 0), (0, 1), (1, 1), (1, 2))]
    rows += [(10 * g + 10 + i, " ".join(vary(rng, bases[g], 1))) for g in range(4) for i in range(3)]
    got = {r.doc_id: r.component_id for r in near_duplicates(h.docs(spark, rows).repartition(3), shingle=4).collect()}
    assert got == {i: 0 if i < 40 else 40 for i, _ in rows}


def test_near_dedup_keeps_one_of_each(spark):
    rows = near_rows(4)
    want = {i for i, c in h.components(rows, 5).items() if i == c}
    assert {r.doc_id for r in near_dedup(h.docs(spark, rows)).collect()} == want


def test_shingle_sets_of_long_words():
    a, b, c = shingle_sets(["x" * 5000 + " b c d", "x" * 4999 + "y b c d", "X" * 5000 + " b c d"], 4)
    assert len(a) == 1 and a[0] != b[0] and a[0] == c[0]
    moved = shingle_sets(["p" * 256 + "q" * 256, "q" * 256 + "p" * 256], 1)
    assert moved[0][0] != moved[1][0]


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2300)] + [(7, 7)]
    rng.shuffle(edges)
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges + [(None, 3)], "u long, v long")).collect()}
    want = h.union_find(edges, {x for e in edges for x in e})
    assert got == {n: c for n, c in want.items() if sum(v == c for v in want.values()) > 1}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
