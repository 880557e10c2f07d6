"""Contract queries over the smallest tables, against SQL or against plain versions."""

import hashlib
import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from quillstone.llm import language_id, media, toxicity
from quillstone.llm.bpe import vocabulary
from quillstone.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import helpers as h

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_sql(spark, name):
    got = QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert key(got.select(*cols).collect()) == key(want)


def test_shards(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op7_sharding"](spark, DATA).collect()}
    for i, t, *_ in documents:
        r = got[i]
        assert r.size == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    for s in range(40):
        own = sorted(r.slot for r in got.values() if r.shard == s)
        assert own == list(range(len(own)))
    for i, *_ in documents:
        assert (got[i].shard, got[i].grown_shard) == (winner(i, 40), winner(i, 41))


def winner(key, shards):
    """The shard with the smallest draw, each drawn from key, shard and a word by chained XXH64."""

    def draw(shard):
        seed = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        seed = xxhash.xxh64_intdigest(shard.to_bytes(4, "little", signed=True), seed)
        return ((xxhash.xxh64_intdigest(b"shard", seed) >> 11) + 0.5) / 2**53

    return min(range(shards), key=lambda s: -math.log(draw(s)))


def test_near_duplicates(spark, documents):
    want = h.components([(i, t) for i, t, *_ in documents], 4)
    assert {r.doc_id: r.component_id for r in QUERIES["op9_minhash"](spark, DATA).collect()} == want


def test_tokens(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op10_bpe"](spark, DATA).collect()}
    assert all(got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t, *_ in documents)
    ranks = vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t, *_ in documents:
        ids = np.array(enc.encode_ordinary(t), "<u4")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()


def test_languages(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, DATA).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in documents)
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in documents if got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def words_of(text):
    """(start, word in lower case) of the runs of letters."""
    out, at = [], None
    for i, c in enumerate(text + " "):
        if c.isalpha():
            at = i if at is None else at
        elif at is not None:
            out.append((at, "".join(x.lower() if len(x.lower()) == 1 else x for x in text[at:i])))
            at = None
    return out


def trigram(a, b, c):
    h = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) % 2**64
    h ^= h >> 31
    return (h * 0xBF58476D1CE4E5B9 % 2**64) >> 48


def test_languages_as_plain(spark, documents):
    """Counts, word scores and the best labelling of each whole text, one word after the other."""
    counts, totals, cache = {}, Counter(), {}

    def grams(word):
        if word not in cache:
            c = [0, *map(ord, word), 0]
            cache[word] = [trigram(*c[i : i + 3]) for i in range(len(word))]
        return cache[word]

    for i, t, lang, _ in documents:
        if lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            for _, w in words_of(t or ""):
                counts.setdefault(lang, Counter()).update(grams(w))
                totals[lang] += len(w)
    langs = sorted(counts)
    logp = lambda lang, g: math.log((counts[lang][g] + 0.05) / (totals[lang] + 0.05 * language_id.BUCKETS))
    got = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, DATA).collect()}
    for i, t, *_ in documents[:80]:
        found = words_of(t or "")
        best, came = None, []
        for _, w in found:
            own = [sum(logp(x, g) for g in grams(w)) for x in langs]
            if best is None:
                best = own
                continue
            top = max(range(len(langs)), key=lambda k: best[k])
            came.append([k if best[k] >= best[top] - language_id.SWITCH else top for k in range(len(langs))])
            best = [max(best[k], best[top] - language_id.SWITCH) + own[k] for k in range(len(langs))]
        if not found:
            assert got[i].lang_pred == "und"
            continue
        label = [max(range(len(langs)), key=lambda k: best[k])]
        for step in reversed(came):
            label.append(step[label[-1]])
        share = Counter()
        spans = []
        for (at, w), k in zip(found, reversed(label), strict=True):
            share[k] += len(w)
            if spans and spans[-1][2] == langs[k]:
                spans[-1][1] = at + len(w)
            else:
                spans.append([at, at + len(w), langs[k]])
        k = min(share, key=lambda x: (-share[x], x))
        assert got[i].lang_pred == langs[k] and abs(got[i].score - share[k] / sum(share.values())) < 1e-9 and [list(x) for x in got[i].spans] == spans


def test_toxicity_as_plain(spark, documents):
    """Row counts of words, bins, marginals by forward and backward sums, scores and spans; fitted weights are the query's."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    learn = language_id.remainder(docs.doc_id, 5) != 0
    f = toxicity.train(docs.where(learn), labels.where(language_id.remainder(labels.doc_id, 5) != 0))
    text = {i: t or "" for i, t, *_ in documents}
    y = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = {1: Counter(), 0: Counter()}
    for i, v in y.items():
        rows[v].update({w for _, w in words_of(text[i])})
    share = sum(y.values()) / len(y)
    lexicon = {w for w, n in rows[1].items() if n >= toxicity.LEAST_ROWS and n > share * (n + rows[0][w])}
    assert abs(f.share - share) < 1e-12 and len(f.words) == len(lexicon)
    k, a = len(toxicity.BINS) + 1, toxicity.PRIOR_ROWS

    def bin_of(w):
        if w not in lexicon:
            return 0
        odds = math.log((rows[1][w] + a * share) / (rows[0][w] + a * (1 - share))) - math.log(share / (1 - share))
        return sum(b <= odds for b in toxicity.BINS)

    got = {r.doc_id: r for r in QUERIES["op3_toxicity"](spark, DATA).collect()}
    step = [[0.0, f.weights[-3]], [f.weights[-2], f.weights[-1]]]
    both = lambda x, z: max(x, z) + math.log1p(math.exp(-abs(x - z)))
    for i, t in list(text.items())[:120]:
        found = words_of(t)
        b = [0, *[bin_of(w) for _, w in found], 0]
        e = [max(-30, min(30, f.weights[b[j]] + f.weights[k + b[j - 1]] + f.weights[2 * k + b[j + 1]])) for j in range(1, len(b) - 1)]
        n = len(e)
        fwd, back = [[0.0, 0.0] for _ in range(n)], [[0.0, 0.0] for _ in range(n)]
        for j in range(n):
            fwd[j] = [(0, e[j])[s] + (both(fwd[j - 1][0] + step[0][s], fwd[j - 1][1] + step[1][s]) if j else 0.0) for s in (0, 1)]
        for j in range(n - 2, -1, -1):
            back[j] = [both(step[s][0] + back[j + 1][0], step[s][1] + e[j + 1] + back[j + 1][1]) for s in (0, 1)]
        p = [1 / (1 + math.exp(min(700, fwd[j][0] + back[j][0] - fwd[j][1] - back[j][1]))) for j in range(n)]
        x = math.log1p(sum(-math.log1p(-min(q, 1 - 1e-12)) for q in p if q >= toxicity.FLOOR))
        want = 1 / (1 + math.exp(-max(-30, min(30, f.slope * x + f.shift))))
        spans = []
        for j, q in enumerate(p):
            if q >= toxicity.SPAN_LEVEL:
                start, end = found[j][0], found[j][0] + len(found[j][1])
                if spans and spans[-1][2] == j - 1:
                    spans[-1][1:] = [end, j]
                else:
                    spans.append([start, end, j])
        assert abs(got[i].score - want) < 1e-6 and [(s.start, s.end) for s in got[i].spans] == [(s[0], s[1]) for s in spans]


def test_toxicity(spark, documents):
    got = QUERIES["op3_toxicity"](spark, DATA).collect()
    assert len(got) == len(documents) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_recordings(spark):
    """All ids divisible by 100 against all others, at all offsets."""
    got = {r.vec_id: r for r in QUERIES["op8_audio"](spark, DATA).collect()}
    prints = {r.vec_id: media.fingerprint(media.melody(list(r.embedding))) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    assert set(got) == set(prints)
    classes = {}
    for i, (bits, _) in sorted(prints.items()):
        classes.setdefault(bits.tobytes(), []).append(i)
    links = Counter()
    for members in classes.values():
        assert {got[i].class_id for i in members} == {members[0]}
    for q in (m for m in classes.values() if any(i % 100 == 0 for i in m)):
        qb, qs = prints[q[0]]
        for r in classes.values():
            rb, rs = prints[r[0]]
            for o in range(16 - len(qb), len(rb) - 15) if r is not q else ():
                a, b = max(0, o), min(len(rb), len(qb) + o)
                differ, sound = rb[a:b] ^ qb[a - o : b - o], rs[a:b] & qs[a - o : b - o]
                if np.bitwise_count(differ).sum() <= 8 * (b - a) and (((differ == 0) & sound).sum() >= 4 or sound.sum() >= 16):
                    links[r[0]] += 1
                    break
    assert all(r.n_links == links[r.class_id] for r in got.values())
