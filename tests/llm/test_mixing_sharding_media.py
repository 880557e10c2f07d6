import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import media, mixing, sharding
from tests.llm import helpers as h


def mix_rows(seed=1):
    rng = random.Random(seed)
    sizes = {"a": 60, "B": 5, "c": 20, None: 30, "Z": 1, "é": 10}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 40))), "en", s))
            i += 1
    return rows + [(None, "one two three", "en", "a"), (i, None, "en", "a"), (i + 1, " \t", "en", None)]


def targets(rows, factor=1.5, cap=2.0):
    words = Counter()
    for _, t, _, s in rows:
        words[s] += len(h.WORD.findall(t or ""))
    names = sorted((s for s in words if s is not None), key=lambda s: s.encode()) + ([None] if None in words else [])
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    full, total = set(), factor * sum(words.values())
    while True:
        level = (total - sum(cap * words[s] for s in full)) / (sum(weight[s] for s in names if s not in full) or 1)
        more = {s for s in names if s not in full and weight[s] * level >= cap * words[s]}
        if not more:
            return words, {s: cap * words[s] if s in full else weight[s] * level for s in names}
        full |= more


def test_targets_and_taken(spark):
    rows = mix_rows()
    out = mixing.mix_plan(h.docs(spark, rows).repartition(6)).collect()
    words, want = targets(rows)
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        assert r.size == len(h.WORD.findall(r.text or "")) and r.source_size == words[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and len(r.positions) == -(-r.taken // r.size if r.size else 0) and all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_reruns_agree_and_rows_share(spark):
    rows = mix_rows()
    key = lambda rs: sorted(((r.doc_id, r.taken, tuple(r.positions)) for r in rs), key=str)
    a = key(mixing.mix_plan(h.docs(spark, rows).repartition(3)).collect())
    assert a == key(mixing.mix_plan(h.docs(spark, rows[::-1]).repartition(7)).collect())
    twice = mixing.mix_plan(h.docs(spark, [(1, "a b c d", "en", "s")] * 3 + [(2, "e f", "en", "s")])).collect()
    assert len(twice) == 4 and len({r.taken for r in twice if r.doc_id == 1}) == 1 and abs(sum(r.taken for r in twice) - 21) <= 3


def test_positions_follow_schedules(spark):
    rows = [(i, "w w w w", "en", s) for i, s in enumerate("abc" * 400)]
    seq = mixing.mix(h.docs(spark, rows), weights=(1.0, 1.0, 1.0), factor=1.0, cap=1.0).select("source", "position").collect()
    at = [r.position for r in seq]
    assert at == sorted(at) and len(seq) == 1200
    early = Counter(r.source for r in seq if r.position < 0.5)
    # a rises from 0.5 to 1.5: 3/8 of it comes in the first half; c falls: 5/8
    assert abs(early["a"] / 400 - 0.375) < 0.01 and abs(early["b"] / 400 - 0.5) < 0.01 and abs(early["c"] / 400 - 0.625) < 0.01


def test_mix_of_nothing_and_clash(spark):
    assert mixing.mix_plan(h.docs(spark, [])).count() == 0
    assert mixing.mix(h.docs(spark, [(1, "", "en", "s"), (2, None, "en", None)])).count() == 0
    out = mixing.mix_plan(h.docs(spark, mix_rows()).withColumn("Target", F.lit("old")).withColumn("id", F.lit(1)).withColumn("mark", F.lit(2)).withColumn("n", F.lit(3)))
    assert out.columns.count("target") == 1 and {r.n for r in out.collect()} == {3}


def test_few_records_move(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    even = {i: 1.0 for i in range(40)}
    both = sharding.assign(sharding.assign(df, even), even | {40: 1.0}, name="grown").collect()
    moved = [r for r in both if r.shard != r.grown]
    assert {r.grown for r in moved} == {40} and 0.6 < len(moved) / (20_000 / 41) < 1.4
    assert max(Counter(r.shard for r in both).values()) < 1.35 * 500


def test_weights_and_removal(spark):
    df = spark.range(9000).withColumnRenamed("id", "doc_id")
    w = {0: 1.0, 1: 2.0, 7: 3.0}
    got = {r.doc_id: r.shard for r in sharding.assign(df, w).collect()}
    n = Counter(got.values())
    assert all(abs(n[s] - 1500 * x) < 220 for s, x in w.items())
    less = {r.doc_id: r.shard for r in sharding.assign(df, {0: 1.0, 7: 3.0}).collect()}
    assert all(less[i] == s for i, s in got.items() if s != 1)


def test_slots(spark):
    rows = [(i, "t" * (i % 9)) for i in range(500)] + [(None, "x"), (None, "x"), (3, "ttt")]
    df = sharding.assign(h.docs(spark, rows).withColumn("Shard", F.lit("old")), {i: 1.0 for i in range(5)})
    out = sharding.slots(df.select("doc_id", "text", "shard").repartition(6), ["doc_id", "text"]).collect()
    for s in range(5):
        own = sorted(r.slot for r in out if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.slots(sharding.assign(h.docs(spark, []), {0: 1.0}), ["doc_id"]).count() == 0


def song(seed, n=60):
    return np.concatenate([np.sin(2 * np.pi * hz / media.RATE * np.arange(1100)) for hz in 220 * 2 ** (np.random.default_rng(seed).integers(0, 24, n) / 12)]).astype(np.float32) * 0.5


def pcm(x):
    return (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()


def test_recordings_align(spark):
    rng = np.random.default_rng(0)
    a, b = song(1), song(2)
    late = np.concatenate([rng.normal(0, 0.01, 20 * media.HOP).astype(np.float32), a[: 80 * media.HOP]])
    rows = [(1, pcm(a)), (2, pcm(b)), (3, pcm(a + rng.normal(0, 0.02, len(a)).astype(np.float32))), (4, pcm(late)), (5, pcm(a)), (6, b""), (7, None), (8, pcm(np.zeros(60_000, np.float32))), (9, pcm(np.zeros(60_000, np.float32))), (10, b"\1" * 5), (11, pcm(a[30 * media.HOP :])), (12, pcm(np.zeros(70_000, np.float32)))]
    df = spark.createDataFrame(rows, "id long, audio binary").withColumn("Bits", F.lit("old"))
    prints = media.fingerprints(df, F.col("audio"))
    digests = {r.id: r.digest for r in prints.collect()}
    assert digests[1] == digests[5] and digests[6] is digests[7] is digests[10] is None and digests[8] == digests[9] != digests[12]
    got = {(r.query_class, r.class_id): r for r in media.align(prints.drop("audio"), F.col("id") == 1).collect()}
    assert set(got) == {(1, 3), (1, 4), (1, 11)}
    assert got[1, 3].offset == 0 and got[1, 4].offset == 20 and got[1, 11].offset == -30 and got[1, 11].bit_errors == 0


def test_no_recordings(spark):
    none = media.fingerprints(spark.createDataFrame([], "id long, audio binary"), F.col("audio"))
    assert media.align(none, F.lit(True)).count() == 0


@pytest.mark.parametrize("values", [None, [], [None, 0.1], [float("nan")] * 5])
def test_melody(values):
    assert len(media.melody(values)) == len(values or ()) * int(media.RATE * 0.1)


def test_filters_see_the_integral_image():
    c = np.random.default_rng(1).random((40, 12)).astype(np.float32)
    kind, p, n, w = media._filters()[1]
    x, y = c[3 : 3 + w // 2, p : p + n].sum(), c[3 + w // 2 : 3 + w, p : p + n].sum()
    level = int(np.searchsorted([-0.15, 0.0, 0.15], np.log1p(x) - np.log1p(y)))
    assert kind == 1 and media.packed(c)[3] >> 28 & 3 == level ^ level >> 1 and len(media.packed(c[:15])) == 0


def test_disturbed_recordings_align_as_by_brute_force(spark):
    rng = np.random.default_rng(5)
    prints = [media.fingerprint(song(i, 30))[0] for i in range(6)]
    for b in prints[:3]:
        prints.append(b ^ (np.int64(1) << rng.integers(0, 32, len(b))))  # a bit of each integer
        prints.append((b ^ ((rng.random((len(b), 32)) < 0.1) << np.arange(32)).sum(axis=1))[7:])
    rows = [(i, b.tolist(), [True] * len(b), str(i)) for i, b in enumerate(prints)]
    want = set()
    for i, q in enumerate(prints):
        for j, r in enumerate(prints):
            for o in range(16 - len(q), len(r) - 15):
                a, b = max(0, o), min(len(r), len(q) + o)
                if i % 2 == 0 and i != j and np.bitwise_count(r[a:b] ^ q[a - o : b - o]).sum() <= 8 * (b - a):
                    want.add((i, j))
    got = media.align(spark.createDataFrame(rows, "id long, bits array<long>, sound array<boolean>, digest string"), F.col("id") % 2 == 0).collect()
    assert {(r.query_class, r.class_id) for r in got} == want and len(got) == len(want) and {(0, 6), (2, 10), (2, 11)} <= want


def test_blocks_of_recordings_that_share_nothing():
    rng = np.random.default_rng(3)
    a, b = ([(i, rng.integers(0, 1 << 32, n), np.ones(n, bool)) for i, n in enumerate((16, 40, 300), k)] for k in (0, 10))
    assert list(media._aligned(a, b)) == []


def test_alignments_of_mixed_lengths_as_by_brute_force():
    rng, rows = np.random.default_rng(5), []
    song_ = rng.integers(0, 1 << 32, 400)
    for i in range(24):
        part = song_[(at := rng.integers(0, 200)) : at + rng.integers(10, 190)]
        bits = np.concatenate([rng.integers(0, 1 << 32, rng.integers(0, 60)), part ^ np.where(rng.random(len(part)) < 0.3, rng.integers(0, 1 << 32, len(part)), 0)])
        rows.append((i, bits, rng.random(len(bits)) < 0.9))
    want = set()
    for i, q, qs in rows[:8]:
        for j, r, rs in rows:
            found = []
            for o in range(media.LEAST_OVERLAP - len(q), len(r) - media.LEAST_OVERLAP + 1):
                lo, hi = max(0, -o), min(len(q), len(r) - o)
                if hi - lo < media.LEAST_OVERLAP:
                    continue
                differ, sound = r[lo + o : hi + o] ^ q[lo:hi], rs[lo + o : hi + o] & qs[lo:hi]
                errors, votes = float(np.bitwise_count(differ).sum()) / (32.0 * (hi - lo)), int(((differ == 0) & sound).sum())
                if errors <= media.MOST_ERRORS and (votes >= media.LEAST_VOTES or sound.sum() >= media.LEAST_OVERLAP):
                    found.append((-votes, errors, o, hi - lo))
            if i != j and found:
                v, e, o, n = min(found)
                want.add((i, j, o, -v, n, e))
    assert want and set(media._aligned(rows[:8], rows)) == want
