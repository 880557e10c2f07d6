"""Language identification of mixed-language text.

Words are runs of letters. A word's script narrows its candidates to the languages whose training
text uses that script; each candidate's score for the word is the sum of the log-probabilities of
its letters in context (hashed trigrams within the word). A Viterbi pass over the words of a text,
with a penalty for each switch, labels spans; the text's language is the one with most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import without
from quillstone.llm.words import ALL, PIECE, TOGETHER, Chains, Scan, Words, chunks

UNKNOWN = "und"
#: Trigram hashes; a model has so many numbers for each language.
BUCKETS = 1 << 16
#: Natural-log units that a switch of language costs.
SWITCH = 14.0
#: A language uses a script that has at least this share of its letters.
SCRIPT_SHARE = 0.01
RESULTS = ("lang_pred", "score", "spans")

# Scripts by first and last code point of their main blocks (Unicode).
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF))),
)


def _script_table() -> np.ndarray:
    table = np.zeros(ALL, np.uint8)  # 0: any other
    for i, (_, ranges) in enumerate(SCRIPTS, 1):
        for a, b in ranges:
            table[a : b + 1] = i
    return table


_TABLE: list[np.ndarray] = []


def scripts_of(chars: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_script_table())
    return _TABLE[0][chars]


def trigrams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and script of every letter, and where each word begins among the letters."""
    at, begin = w.letters()
    c = w.chars.astype(np.uint64)
    padded = np.concatenate([[0], np.where(w.is_letter, c, 0), [0]]).astype(np.uint64)
    h = padded[at] * np.uint64(0x9E3779B97F4A7C15) + padded[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + padded[at + 2] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(48)).astype(np.int64), scripts_of(w.chars[at]), begin


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # BUCKETS x languages, float32
    allowed: np.ndarray  # scripts x languages, bool

    @classmethod
    def of_counts(cls, counts: dict[str, np.ndarray], scripts: dict[str, np.ndarray]) -> Model:
        langs = sorted(counts)
        n = np.stack([counts[x] for x in langs], axis=1).astype(float) if langs else np.zeros((BUCKETS, 0))
        logp = np.log((n + 0.05) / (n.sum(axis=0) + 0.05 * BUCKETS)) if langs else n
        s = np.stack([scripts[x] for x in langs], axis=1).astype(float) if langs else np.zeros((len(SCRIPTS) + 1, 0))
        allowed = s >= SCRIPT_SHARE * np.maximum(1, s.sum(axis=0))
        allowed[~allowed.any(axis=1)] = True  # a script of no language narrows nothing
        return cls(langs, logp.astype(np.float32), allowed)

    def scores(self, w: Words) -> np.ndarray:
        """Each word's score in each language."""
        if not len(w.start) or not self.langs:
            return np.zeros((len(w.start), len(self.langs)), np.float32)
        bucket, script, begin = trigrams(w)
        score = np.add.reduceat(self.logp[bucket], begin, axis=0)
        score[~self.allowed[script[begin]]] -= 1e6
        return score

    def label(self, texts: list, switch: float = SWITCH) -> tuple[Scan, np.ndarray]:
        """The words of texts and each one's language number."""
        w = Scan(texts, self.scores)
        score, n, k = w.of, len(w.doc), len(self.langs)
        kind = np.min_scalar_type(max(0, k - 1))  # a byte for up to 256 languages
        if not n or not k:
            return w, np.zeros(n, kind)
        chains, came = Chains(w.offset), np.zeros((n, k), kind)
        own = np.arange(k, dtype=kind)
        best = None
        for m, at in chains.forward():
            if best is None:
                best = score[at]
                continue
            old = best[:m]
            top = old.argmax(axis=1)
            jump = old[np.arange(m), top][:, None] - switch
            stay = old >= jump
            came[at] = np.where(stay, own, top[:, None])
            best[:m] = np.where(stay, old, jump) + score[at]
        # best keeps the last step of every chain, however long it is
        label, now = np.zeros(n, kind), best.argmax(axis=1).astype(kind)
        for m, at in chains.backward():
            label[at] = now[:m]
            now[:m] = came[at, now[:m]]
        return w, label

    def predict(self, texts: list, switch: float = SWITCH, spans: bool = True) -> Iterator[tuple[str, float, list]]:
        """Language, share of letters, and spans (start, end, language) in code points, for each text."""
        for _, part in chunks(texts, TOGETHER):
            w, label = self.label(part, switch)
            k = len(self.langs)
            share = np.zeros((len(part), max(1, k)))
            np.add.at(share, (w.doc, label), w.length)
            top, total = share.argmax(axis=1), share.sum(axis=1)
            new = np.flatnonzero((np.diff(w.doc, prepend=-1) != 0) | (np.diff(label.astype(int), prepend=-1) != 0)) if spans else np.zeros(0, int)
            where = np.searchsorted(w.doc[new], np.arange(len(part) + 1)) if spans else None
            last = np.append(new[1:], len(w.doc)) - 1 if len(new) else new
            for i in range(len(part)):
                if not k or not total[i]:
                    yield UNKNOWN, 0.0, []
                    continue
                found = []
                if spans:
                    for a, b in zip(new[where[i] : where[i + 1]].tolist(), last[where[i] : where[i + 1]].tolist(), strict=True):
                        found.append((int(w.begin[a]), int(w.begin[b] + w.length[b]), self.langs[label[a]]))
                yield self.langs[top[i]], float(share[i, top[i]] / total[i]), found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, place, n): letters of this task by trigram bucket, and by script from BUCKETS on."""
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        by: dict[str, list[str]] = {}
        for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if t:
                by.setdefault(x, []).append(t)
        for lang, texts in by.items():
            c = counts.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS) + 1, np.int64))
            for _, part in chunks(texts, PIECE):
                bucket, script, _ = trigrams(Words(part))
                c[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                c[BUCKETS:] += np.bincount(script, minlength=len(SCRIPTS) + 1)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], ["lang", "place", "n"])


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages of df, counted over all its rows; rows without language are left out.

    What comes to the driver is BUCKETS numbers for each language at most.
    """
    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col).cast("string"))
    sums = rows.mapInArrow(_count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, np.ndarray] = {}
    lang, place, n = sums.column(0).combine_chunks().dictionary_encode(), sums.column(1).to_numpy(), sums.column(2).to_numpy()
    codes = np.concatenate([c.indices.to_numpy() for c in lang.chunks]) if isinstance(lang, pa.ChunkedArray) else lang.indices.to_numpy()
    names = (lang.chunk(0) if isinstance(lang, pa.ChunkedArray) else lang).dictionary.to_pylist() if len(sums) else []
    for i, name in enumerate(names):
        c = counts[name] = np.zeros(BUCKETS + len(SCRIPTS) + 1)
        c[place[codes == i]] = n[codes == i]
    return Model.of_counts({k: c[:BUCKETS] for k, c in counts.items()}, {k: c[BUCKETS:] for k, c in counts.items()})


def identify(df: DataFrame, model: Model, text_col: str = "text", switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """df with lang_pred, score (share of the letters in that language) and spans.

    Texts without letters, null ones among them, are `und` with score 0 and no spans; so is every
    text if the model knows no language. Of languages with equally many letters the first by name
    is taken, and of equally good labellings that which switches least to later names. Rows may repeat; an
    empty table gives an empty table. Columns named like a result are replaced.
    """
    df = without(df, *RESULTS)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double, spans array<struct<start int, end int, lang string>>>")
    def run(texts: pa.Array) -> pa.Array:
        out = list(shared.value.predict(texts.to_pylist(), switch, spans))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        return pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in x[2]] for x in out], kind)], list(RESULTS))

    rows = df.withColumn("__r", run(F.col(text_col)))
    return rows.select(*df.columns, *[F.col(f"__r.{c}").alias(c) for c in RESULTS])


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % n
