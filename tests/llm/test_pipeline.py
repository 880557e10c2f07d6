import hashlib
import random
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from quillstone.llm.bpe import vocabulary
from tests.llm import helpers as h
from tests.llm.test_minhash import near_rows
from tests.llm.test_mixing_sharding_media import targets
from tests.llm.test_words import labelled


def corpus():
    rng = random.Random(8)
    shared = [f"a line that many documents share {i}" for i in range(5)]
    rows = [(i, t + ("\n" + rng.choice(shared) if rng.random() < 0.4 else ""), "en", rng.choice(["s1", "s2", None, "b"])) for i, t in near_rows(6)]
    rows += [(1000 + i, t, lang, "s1") for i, t, lang, _ in labelled(6)]
    return rows + [(2000, None, "en", "s1"), (2001, "", None, "s2"), (2002, "1234 ... 5678", "en", "s2"), (2003, "a line that many documents share 1", "en", "b"), (2004, "x" * 20_000 + " long", "en", None)]


def mixed(rows):
    """Rows once for each pass that takes words of them."""
    _, want = targets(rows)
    out = []
    for s in want:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
        size = [len(h.WORD.findall(r[1])) for r in own]
        for k in range(2):
            before = k * sum(size)
            for r, n in zip(own, size, strict=True):
                if min(n, int(want[s]) - before) > 0:
                    out.append(r)
                before += n
    return out


def test_as_plain(spark, tmp_path):
    rows = corpus()
    h.docs(spark, rows).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    kept = {i: t for i, t, _, _ in h.line_dedup([(i, t) for i, t, *_ in rows])}
    rows = [(i, kept[i], lang, s) for i, _, lang, s in rows]
    first = h.components([(i, t) for i, t, *_ in rows], 5)
    rows = mixed([r for r in rows if first[r[0]] == r[0]])
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary(path, public_tokenizers.PATTERN).ranks, special_tokens={})
    want = Counter((i, lang, s, tuple(t.encode_ordinary(text)), hashlib.sha256(text.encode()).hexdigest()) for i, text, lang, s in rows)
    assert Counter((r.doc_id, r.lang, r.source, tuple(r.ids), r.decoded_sha256) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = h.docs(spark, corpus())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_no_documents(spark, tmp_path):
    h.docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
