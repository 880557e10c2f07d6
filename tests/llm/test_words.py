import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import language_id as li
from quillstone.llm import toxicity as tx
from quillstone.llm.words import Chains, Words, chunks
from tests.llm import helpers as h

EN = ["the cat and the dog walked home", "this is what they wanted to see there", "with other things that were not theirs", "whether it rains or shines we go out"]
DE = ["der hund und die katze gingen heim", "das ist was sie dort sehen wollten", "mit anderen dingen die nicht ihre waren", "ob es regnet oder scheint wir gehen hinaus"]
RU = ["собака и кошка пошли домой", "это то что они хотели там увидеть"]


def labelled(n=40):
    rows = []
    for i in range(n):
        for j, (lang, pool) in enumerate((("en", EN), ("de", DE), ("ru", RU))):
            rng = random.Random(1000 * j + i)
            rows.append((3 * i + j, " ".join(" ".join(rng.sample(rng.choice(pool).split(), 4)) for _ in range(5)), lang, "s"))
    return rows


def test_words_of_texts():
    texts = ["Ab c1d", "", "ÉÉ x\n y", "...", "last"]
    w = Words(texts)
    got = ["".join(map(chr, w.chars[s : s + n])) for s, n in zip(w.start, w.length, strict=True)]
    assert got == ["ab", "c", "d", "éé", "x", "y", "last"] and w.doc.tolist() == [0, 0, 0, 2, 2, 2, 4] and w.offset.tolist() == [0, 3, 3, 6, 6, 7]
    assert len(set(Words(["abc", "acb", "ab", "abcd", "ABC"]).hashes().tolist())) == 4
    assert [(a, len(p)) for a, p in chunks(["a" * 5, None, "b" * 50, "c"], 10)] == [(0, 2), (2, 1), (3, 1)]


def test_chains_cover_each_word_once():
    offset = np.array([0, 3, 3, 10, 11])
    f = [x for _, at in Chains(offset).forward() for x in at.tolist()]
    b = [x for _, at in Chains(offset).backward() for x in at.tolist()]
    assert sorted(f) == sorted(b) == list(range(11))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    m = li.Model(["a", "b", "c"], rng.normal(size=(li.BUCKETS, 3)).astype(np.float32), np.ones((len(li.SCRIPTS) + 1, 3), bool))
    texts = ["xq zz top", "one two three four five six", "", "w"]
    w, label = m.label(texts, 1.5)
    score = w.of
    value = lambda path, at: sum(score[at + i, x] for i, x in enumerate(path)) - 1.5 * sum(a != b for a, b in itertools.pairwise(path))
    for d in range(len(texts)):
        a, b = w.offset[d], w.offset[d + 1]
        if b > a:
            best = max(value(p, a) for p in itertools.product(range(3), repeat=b - a))
            assert abs(value(label[a:b].tolist(), a) - best) < 1e-3


def test_three_hundred_languages():
    rng = np.random.default_rng(6)
    m = li.Model([f"l{i:03d}" for i in range(300)], rng.normal(size=(li.BUCKETS, 300)).astype(np.float32), np.ones((len(li.SCRIPTS) + 1, 300), bool))
    texts = ["".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(60)]
    w = Words(texts)
    best = m.scores(w).argmax(axis=1)
    assert best.max() > 255 and [p[0] for p in m.predict(texts)] == [m.langs[b] for b in best]


def test_language_ties_repeats_and_long_texts(spark):
    m = li.Model(["aa", "bb"], np.zeros((li.BUCKETS, 2), np.float32), np.ones((len(li.SCRIPTS) + 1, 2), bool))
    rows = [(1, "some words"), (1, "some words"), (2, "w " * 100_000), (3, "x" * 100_000)]
    got = [(r.doc_id, r.lang_pred, r.score, len(r.spans)) for r in li.identify(h.docs(spark, rows), m).collect()]
    assert sorted(got) == [(1, "aa", 1.0, 1), (1, "aa", 1.0, 1), (2, "aa", 1.0, 1), (3, "aa", 1.0, 1)]


def test_language_held_out_and_spans(spark):
    df = h.docs(spark, labelled())
    model = li.train(df.where(li.remainder(F.col("doc_id"), 3) != 1))
    assert model.langs == ["de", "en", "ru"]
    out = li.identify(df.where(li.remainder(F.col("doc_id"), 3) == 1), model)
    assert out.where("lang <> lang_pred").count() == 0 and out.where("score < 0.9").count() == 0
    mixed = EN[0] + " " + EN[1] + ". " + DE[0] + " " + DE[3] + " собака и кошка"
    rows = h.docs(spark, [(1, mixed), (2, None), (3, ""), (4, "12 ... 34"), (5, "собака"), (None, EN[2])]).withColumn("Score", F.lit("old"))
    got = {r.doc_id: r for r in li.identify(rows, model).collect()}
    spans = [(mixed[s.start : s.end].split()[0], s.lang) for s in got[1].spans]
    assert spans == [("the", "en"), ("der", "de"), ("собака", "ru")]
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and [got[i].score for i in (2, 3, 4)] == [0.0] * 3
    assert got[5].lang_pred == "ru" and got[None].lang_pred == "en"


def test_language_without_training(spark):
    model = li.train(h.docs(spark, []))
    assert li.identify(h.docs(spark, [(1, "words")]), model).first().lang_pred == "und"
    assert li.identify(h.docs(spark, []), model).count() == 0
    assert li.train(h.docs(spark, [(1, "text", None, "s")])).langs == []


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(4)
    f = tx.Field(np.array([1, 5, 9], np.uint64), np.array([30, 9, 4]), np.array([0, 1, 4]), 0.3, 1)
    f.weights = rng.normal(size=len(f.weights))
    bins, doc = rng.integers(0, 5, 9), np.array([0] * 5 + [1] * 1 + [2] * 3)
    p, left, right, pairs = f.marginals(bins, doc, Chains(np.array([0, 5, 6, 9])), True)
    e = f._emit(bins, doc)[0]
    t = [[0.0, f.weights[-3]], [f.weights[-2], f.weights[-1]]]
    want, edge = np.zeros(9), np.zeros((2, 2))
    for a, b in ((0, 5), (5, 6), (6, 9)):
        paths = list(itertools.product((0, 1), repeat=b - a))
        weight = [math.exp(sum(math.log(e[a + i]) * s for i, s in enumerate(q)) + sum(t[x][y] for x, y in itertools.pairwise(q))) for q in paths]
        z = sum(weight)
        for q, w in zip(paths, weight, strict=True):
            for i, s in enumerate(q):
                want[a + i] += s * w / z
            for x, y in itertools.pairwise(q):
                edge[x, y] += w / z
    assert np.allclose(p, want) and np.allclose(pairs, [edge[0, 1], edge[1, 0], edge[1, 1]])


BAD = ("idiot", "moron", "trash", "loser")


def toxic_rows(n=400):
    rows, labels = [], []
    for i in range(n):
        rng = random.Random(i)
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(rng.randint(5, 60))]
        y = int(i % 4 == 0)
        for _ in range(y * rng.randint(1, 4)):
            words.insert(rng.randint(0, len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, y))
    return rows, labels


def test_toxicity_held_out_and_spans(spark):
    rows, labels = toxic_rows()
    df, y = h.docs(spark, rows).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    kept = li.remainder(F.col("doc_id"), 5) != 0
    model = tx.train(df.where(kept), y.where(kept))
    out = tx.score(df.where(~kept), model).join(y, "doc_id").collect()
    wrong = [r.doc_id for r in out if (r.score >= 0.5) != (r.toxic == 1)]
    assert len(out) > 60 and not wrong
    for r in out:
        assert {r.text[s.start : s.end] for s in r.spans} == {w for w in BAD if w in r.text.split()} or any(" " in r.text[s.start : s.end] for s in r.spans)
    odd = h.docs(spark, [(1, None), (2, ""), (3, "good " * 30_000 + "idiot"), (4, "IDIOT!")]).withColumn("spans", F.lit(0))
    got = {r.doc_id: r for r in tx.score(odd, model).collect()}
    assert got[1].score == got[2].score < 0.5 and got[3].score >= 0.5 and [(s.start, s.end) for s in got[3].spans] == [(150_000, 150_005)] and got[4].score >= 0.5


def test_toxicity_without_classes(spark):
    df, none = h.docs(spark, [(1, "some text"), (2, "idiot"), (None, "x")]), spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    for labels in (none, one):
        model = tx.train(df, labels)
        assert {r.score < 0.5 for r in tx.score(df, model).collect()} == {True}
    assert tx.score(h.docs(spark, []), tx.train(h.docs(spark, []), none)).count() == 0


def test_rare_words_of_large_tables_are_evidence(spark):
    n = 5000
    rows = [(i, f"ba be bi {'grobian' if i < 4 else 'moron'}" if i < n else "ba be bi bo") for i in range(2 * n)]
    labels = spark.createDataFrame([(i, int(i < n)) for i in range(2 * n)], "doc_id long, toxic int")
    model = tx.train(h.docs(spark, rows).repartition(4), labels, sample_rows=400)
    rare, common, clean = model.bin_of(tx.Words(["grobian moron bo"]).hashes())
    assert rare > 0 and common >= rare and clean == 0


def test_lexicon_in_slices(spark):
    rows, labels = toxic_rows()
    df, y = h.docs(spark, [*rows, (1000, None), (1001, "")]).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole, sliced = tx.train(df, y, sample_rows=200), tx.train(df, y, sample_rows=200, lexicon_words=60)
    assert whole.slices == 1 and whole.table is None and sliced.slices >= 2
    out = [sorted((r.doc_id, r.score, r.toxic_words, r.spans) for r in tx.score(df, m).collect()) for m in (whole, sliced)]
    assert out[0] == out[1] and tx.score(df, sliced).columns == tx.score(df, whole).columns


def test_rare_labels_are_learned(spark):
    rows = [(i, f"ba {'be' if i % 2 else 'bi'} bo {BAD[i // 500 % 4] + ' bu ' + BAD[i // 2000 % 4] if i % 500 == 0 else 'bu'}") for i in range(20_000)]
    labels = spark.createDataFrame([(i, int(i % 500 == 0)) for i in range(20_000)], "doc_id long, toxic int")
    model = tx.train(h.docs(spark, rows).repartition(4), labels, sample_rows=100)
    new = [(1, "bi bo idiot idiot"), (2, "ba moron loser"), (3, "ba be bi bo bu"), (4, "something else")]
    got = {r.doc_id: r for r in tx.score(h.docs(spark, new), model).collect()}
    assert got[1].score >= 0.5 and got[2].score >= 0.5 and got[3].score < 0.5 and got[4].score < 0.5 and got[1].spans and not got[3].spans
