import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import bloom
from quillstone.llm.exact_dedup import Table, _fold, exact_dedup, grace
from quillstone.llm.line_dedup import line_dedup
from tests.llm import helpers as h

LONG = "long line of text number "
ROWS = [
    (3, f"{LONG}1\nshort\n  {LONG}1 \nown line of three"), (1, f"{LONG}1\nshort\n{LONG.upper()}2"), (2, "short\n\t" + LONG + "2\r"), (4, None), (5, ""), (6, "\n\n"), (7, "é" * 9 + "\nÉ" + "x" * 9), (8, "é" * 9 + "\né" + "x" * 9),
    (9, "ü" * 10), (10, "ü" * 10), (11, f"{LONG}9\n{LONG}9"), (12, "z\n" * 3000 + LONG + "1"),
]


def test_lines_as_plain(spark):
    for bits in (bloom.MAX_BITS, 40):  # 40: the filter in several slices
        got = line_dedup(h.docs(spark, ROWS).repartition(4), max_bits=bits).select("doc_id", "kept_text", "n_lines", "n_dropped").collect()
        assert sorted(map(tuple, got)) == sorted(h.line_dedup(ROWS))


def test_lines_random(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice([f"{LONG}{rng.randint(0, 60)}", "tiny", "", f" {LONG}{rng.randint(0, 9)} "]) for _ in range(rng.randint(0, 12)))) for i in range(200)]
    got = line_dedup(h.docs(spark, rows).repartition(7)).select("doc_id", "kept_text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got)) == sorted(h.line_dedup(rows))


def test_lines_null_and_repeated_ids(spark):
    rows = [(None, LONG + "1\nrest of null"), (None, LONG + "1"), (7, LONG + "1"), (8, LONG + "8\n" + LONG + "8"), (8, LONG + "8"), (None, LONG + "only null")]
    got = {tuple(r) for r in line_dedup(h.docs(spark, rows)).select("doc_id", "kept_text", "n_dropped").collect()}
    assert got == {(None, "rest of null", 1), (None, "", 1), (7, LONG + "1", 0), (8, LONG + "8\n" + LONG + "8", 0), (8, LONG + "8", 0), (None, LONG + "only null", 0)}


def test_lines_empty_and_clash(spark):
    none = h.docs(spark, [])
    assert line_dedup(none).count() == 0
    clash = h.docs(spark, ROWS).withColumn("N_Lines", F.lit("old")).withColumn("key", F.lit(1)).withColumn("id", F.lit(2))
    out = line_dedup(clash)
    assert out.columns[-3:] == ["kept_text", "n_lines", "n_dropped"] and {"key", "id"} <= set(out.columns) and out.where("n_lines >= 1").count() == len(ROWS)


def test_once_and_twice_filters(spark):
    rng = np.random.default_rng(1)
    once = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    twice = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    values = np.concatenate([once, twice, twice]).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in values], "h long").repartition(6)
    found = bloom.repeated(df, lambda b: b.column(0).to_numpy().view(np.uint64))
    got = {r.h for r in found.collect()}
    assert set(twice.view(np.int64).tolist()) <= got and len(got) < 500 + 0.02 * 40_000
    f = bloom.build(found, bloom.bits_for(len(got)))
    assert f.test(twice).all() and f.test(once).mean() < 0.04 and not f.test(np.zeros(0, np.uint64)).any()
    assert df.where(f.column(F.col("h"))).count() >= 1000


def test_seen_grows():
    rng, seen = np.random.default_rng(2), bloom.Seen(1 << 16)
    a, b = (np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)) for _ in range(2))
    assert seen.add(a[:100]).sum() == 0 and seen.add(a[100:]).mean() < 0.02 and seen.add(a).all() and seen.add(b).mean() < 0.05 and seen.add(b).all() and len(seen.layers) > 3


def exact_plain(rows):
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        least = min((x for x in g if x is not None), default=None)
        out.append((i, least, len(g), i == least))
    return out


EXACT = [(5, "a b"), (2, "a  b"), (9, "a\t\nb"), (1, "a b "), (3, None), (4, ""), (6, " "), (7, "  \n"), (8, "A b"), (10, "x" * 300_000), (11, "x" * 300_000), (None, "a b"), (None, "null only"), (12, "a b")]


def plain(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)


def test_exact_as_plain(spark):
    df = h.docs(spark, EXACT).repartition(5)
    assert plain(exact_dedup(df)) == sorted(exact_plain(EXACT), key=str)
    # buckets that spill change nothing
    assert plain(exact_dedup(df, budget=100)) == sorted(exact_plain(EXACT), key=str)


def test_exact_colliding_key(spark):
    rows = [(i, f"text {i % 7}") for i in range(50)]
    assert plain(exact_dedup(h.docs(spark, rows).repartition(4), key=F.lit("00"))) == sorted(exact_plain(rows), key=str)


def test_exact_empty_repeated_and_clash(spark):
    assert exact_dedup(h.docs(spark, [])).count() == 0
    twice = h.docs(spark, [(1, "a"), (1, "a"), (2, "a")])
    assert plain(exact_dedup(twice)) == [(1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False)]
    out = exact_dedup(twice.withColumn("Keep_ID", F.lit("old")).withColumn("k", F.lit("x")).withColumn("t", F.lit("y")))
    assert out.columns.count("keep_id") == 1 and {r["k"] for r in out.collect()} == {"x"}


@pytest.mark.parametrize("budget", [50, 2000, 10**9])
def test_grace_buckets(budget, tmp_path):
    import hashlib

    rng = random.Random(2)
    texts = [f"text {rng.randint(0, 300)}" for _ in range(3000)]
    records = [(hashlib.sha256(t.encode()).hexdigest(), t, n, 1) for n, t in enumerate(texts)]
    got = {e[1]: (e[2], e[3]) for b in grace(iter(records), budget, folder=str(tmp_path)) for e in b}
    want = {t: (texts.index(t), texts.count(t)) for t in set(texts)}
    assert got == want and not list(tmp_path.iterdir())


def test_many_short_texts_stay_within_the_budget():
    """Memory of folding and of the table, for texts of a few characters, as Python counts it."""
    n, budget = 150_000, 4 << 20
    batches = (pa.RecordBatch.from_arrays([pa.array([f"{i:064x}" for i in range(a, a + 10_000)]), pa.array([f"{i:05d}" for i in range(a, a + 10_000)]), pa.array(range(a, a + 10_000), pa.int64())], ["k", "t", "least"]) for a in range(0, n, 10_000))
    tracemalloc.start()
    rows = sum(b.num_rows for b in _fold(budget)(batches))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and most < 4 * budget


def test_table_grows():
    t = Table()
    for i in range(5000):
        t.add(f"{i % 2500:064x}", f"t{i % 2500}", i, 1)
    assert len(t.entries) == 2500 and all(e[3] == 2 for e in t.entries)
