import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import bpe
from quillstone.llm.bpe import RankQueue, Vocabulary, bpe_round_trip, encode_array, vocabulary
from tests.llm import helpers as h

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def both():
    v = vocabulary(PATH, PATTERN)
    return v, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def same(both, text):
    v, t = both
    ids = v.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == t.encode_ordinary(text)
    assert v.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(both, text):
    same(both, text)


@settings(max_examples=100, deadline=None)
@given(text=st.text(alphabet="abn the", max_size=80))
def test_repeating_text(both, text):
    same(both, text)


@pytest.mark.parametrize("text", ["", " ", "a" * 30_000, "ab" * 5000, "aab" * 4000, "the" * 9000, "<|endoftext|>", "\n\n \t x", "é" * 3000, "漢字かな" * 500, "🙂" * 300, "=" * 777, "0123456789" * 300])
def test_long_and_odd(both, text):
    same(both, text)


def test_queue_is_empty_after_use(both):
    v, _ = both
    v.merge(b"unbelievablebelievable")
    list(v.merge_many([b"unbelievablebelievable", b"aaaaaaa"]))
    assert not any(v.queue.low) and not v.queue.top and all(b == -1 for b in v.queue.places if b.__class__ is int) and not any(isinstance(b, list) for b in v.queue.places)


def test_small_vocabulary_leftmost_first():
    v = Vocabulary({b"a": 0, b"b": 1, b"aa": 2, b"aaaa": 3, b"ab": 4}, r".+")
    want = {b"aaaaa": [3, 0], b"aaab": [2, 4], b"ba": [1, 0], b"aabaa": [2, 1, 2]}
    assert {p: v.merge(p) for p in want} == want
    assert [np.frombuffer(x, "<u4").tolist() for x in v.merge_many(list(want))] == list(want.values())
    q = RankQueue(1000)
    for r in (700, 3, 255, 256, 999):
        q.add(r)
    assert [q.take() for _ in range(5)] == [3, 255, 256, 700, 999] and not q.top


@settings(max_examples=60, deadline=None)
@given(pieces=st.lists(st.binary(min_size=1, max_size=20) | st.text(alphabet="abnthe ", min_size=1, max_size=30).map(str.encode), min_size=1, max_size=40))
def test_many_at_once_as_one_by_one(both, pieces):
    v, _ = both
    pieces = [p for p in pieces if p not in v.ranks] or [b"xqzj"]
    assert [np.frombuffer(x, "<u4").tolist() for x in v.merge_many(pieces)] == [v.merge(p) for p in pieces]


def test_many_texts_and_full_memory(both, monkeypatch):
    v, t = both
    rng = random.Random(3)
    texts = ["".join(rng.choice(["th", "er", "qu", "an", "é", " ", "xyz", "ing", "Z"]) for _ in range(rng.randint(0, 400))) for _ in range(300)] + ["", "x" * 5000, "words and " * 500]
    other = Vocabulary(v.ranks, PATTERN + "|$^")
    for name, value in (("MANY", 1), ("REMEMBERED", 40), ("RECALLED", 60), ("TOGETHER", 3000)):
        monkeypatch.setattr(bpe, name, value)
        v.memory, other.known = bpe.Memory(), bpe._Known(other)
        assert [np.frombuffer(x, "<u4").tolist() for x in other.encode_all(texts)] == [t.encode_ordinary(x) for x in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in v.encode_all(texts)] == [t.encode_ordinary(x) for x in texts]


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("ab'stremvdlLS 1²\n\t\u00a0\u2003\x1c\0é漢!.🙂-"), max_size=25), min_size=1, max_size=4) | st.lists(st.text(max_size=20), min_size=1, max_size=3))
def test_split_as_the_pattern(both, texts):
    s = bpe.Split(texts)
    got = [s.token(i) for i in range(len(s.start))]
    assert got == [t for x in texts for t in both[0].find(x)]
    assert s.last.tolist() == list(np.cumsum([len(both[0].find(x)) for x in texts])) and not s.long


def test_patterns_are_the_same():
    assert bpe.PATTERN == PATTERN


def test_long_tokens_among_others(both):
    v, t = both
    texts = ["short one", "x" * 65 + " tail", "y" * 64, "x" * 66, "", "z" * 5000 + " z", "again short one"]
    assert [np.frombuffer(x, "<u4").tolist() for x in v.encode_all(texts)] == [t.encode_ordinary(x) for x in texts]


def test_columns(spark):
    df = h.docs(spark, [(1, "Hello there"), (2, None), (3, ""), (None, "x" * 5000)])
    out = {r.doc_id: r for r in bpe_round_trip(df, PATH, PATTERN).collect()}
    t = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary(PATH, PATTERN).ranks, special_tokens={})
    assert out[1].n_tokens == len(t.encode_ordinary("Hello there")) and bytes(out[1].decoded) == b"Hello there"
    assert out[2].n_tokens == out[3].n_tokens == 0 and bytes(out[2].decoded) == b"" and bytes(out[None].decoded) == b"x" * 5000
    arrays = {r[0]: r[1] for r in df.select("doc_id", encode_array(df.text, PATH, PATTERN)).collect()}
    assert arrays[1] == t.encode_ordinary("Hello there") and arrays[2] == []
    assert bpe_round_trip(h.docs(spark, []), PATH, PATTERN).count() == 0
    clash = bpe_round_trip(df.withColumn("IDS", df.doc_id), PATH, PATTERN)
    assert clash.columns[-3:] == ["ids", "n_tokens", "decoded"] and "IDS" not in clash.columns


@pytest.mark.parametrize("few", [1, 97])
def test_clashing_hashes_are_told_apart_by_text(both, monkeypatch, few):
    number = bpe.Split._number

    def clash(self, c, start, length, at):
        number(self, c, start, length, at)
        self.hash[at : at + len(start)] %= np.uint64(few)

    monkeypatch.setattr(bpe.Split, "_number", clash)
    v, rng = Vocabulary(both[0].ranks, PATTERN), random.Random(3)
    for n in (1, 40, 40):
        texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 5))) for _ in range(n)] + ["", "x" * 200]
        assert [np.frombuffer(x, "<u4").tolist() for x in v.encode_all(texts)] == [both[1].encode_ordinary(t) for t in texts]
