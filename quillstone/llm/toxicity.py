"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Rows are labelled as a whole, so tokens are labelled first: over all labelled rows, each word's
document frequency in toxic and in other rows gives its log-odds, drawn towards the share of toxic rows.
Tokens of a toxic row whose word reaches TOKEN_LEVEL are toxic; all tokens of other rows are not. The
field sees each token's log-odds, in bins, and those of its neighbours; it is fitted on a bounded sample of whole rows,
for which a row's own part in the frequencies is taken out again.
Forward-backward marginals over a text's whole chain of words give spans and, through a logistic
function of how many toxic words are expected, the text's score.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import bloom
from quillstone.llm.common import discard, materialize, without
from quillstone.llm.words import PIECE as PIECE_CHARS
from quillstone.llm.words import TOGETHER, Chains, Scan, Words, chunks

RESULTS = ("score", "toxic_words", "spans")
#: Rows that the field is fitted on, at most.
SAMPLE_ROWS = 4000
#: One in so many of them, at least, is of the rarer class if there are such rows.
RARER = 10
#: Toxic rows that hold a word of the lexicon, at least, however many rows there are; log-odds decide further.
LEAST_ROWS = 3
#: Words of a lexicon that is held in memory at once. A larger one stays a table, which score() goes
#: through in slices of about so many words, writing each word's bin down between two slices.
LEXICON_WORDS = 4_000_000
#: Log-odds, above those of all rows, from which a word of a toxic row counts as toxic; and the rows of
#: average kind that every word is taken to have been seen in besides.
TOKEN_LEVEL, PRIOR_ROWS = 2.5, 4.0
#: Lower bounds of the bins of log-odds; words outside the lexicon are in bin 0.
BINS = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0)
#: Words less likely to be toxic than this say nothing about their text, however many there are.
FLOOR = 0.1
SPAN_LEVEL = 0.5
EPOCHS, RATE, DECAY = 80, 0.5, 1e-3
#: Words after which chains are cut for fitting, and only there.
PIECE = 200
WORKERS = 8


@dataclass
class Field:
    """Lexicon and weights. States: 0 clean, 1 toxic."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # rows that hold the word
    other: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    share: float = 0.5  # of toxic rows
    least: float = LEAST_ROWS
    #: by bin, of the token, the one before and the one after; then log transitions 01, 10, 11 relative to 00
    weights: np.ndarray = field(default_factory=lambda: np.concatenate([[-6.0], np.zeros(3 * (len(BINS) + 1) + 2)]))
    slope: float = 1.0
    shift: float = -2.0
    #: the lexicon as a table (word, toxic, other) if it is read in slices; words are then those of the sample only
    table: DataFrame | None = None
    slices: int = 1

    def bin_of(self, hashes: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Bin of each token. own: label of each token's row, if that row is among those counted."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = np.flatnonzero(self.words[at] == hashes)
        t, o = self.toxic[at[known]].astype(float), self.other[at[known]].astype(float)
        if own is not None:
            t, o = t - own[known], o - (1 - own[known])
        a = PRIOR_ROWS
        odds = np.log((np.maximum(t, 0) + a * self.share) / (np.maximum(o, 0) + a * (1 - self.share))) - np.log(self.share / (1 - self.share))
        out = np.zeros(len(hashes), np.int64)
        out[known] = np.where(t >= self.least, np.searchsorted(BINS, odds, "right"), 0)
        return out

    def _emit(self, bins: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Factor of the toxic state for each token, and its neighbours' bins (0 at the ends of a text)."""
        k = len(BINS) + 1
        same = doc[1:] == doc[:-1]
        left, right = np.zeros_like(bins), np.zeros_like(bins)
        left[1:] = np.where(same, bins[:-1], 0)
        right[:-1] = np.where(same, bins[1:], 0)
        w = self.weights
        return np.exp(np.clip(w[bins] + w[k + left] + w[2 * k + right], -30, 30)), left, right

    def marginals(self, bins: np.ndarray, doc: np.ndarray, chains: Chains, edges: bool = False):
        """Probability that each token is toxic; with edges, also sums over pairs of 01, 10 and 11."""
        e, left, right = self._emit(bins, doc)
        t01, t10, t11 = np.exp(np.clip(self.weights[-3:], -30, 30))
        # ratios of toxic to clean, forward and backward
        r, q = np.empty(len(e)), np.empty(len(e))
        before = None
        for m, at in chains.forward():
            if before is None:
                before = e[at]
            else:
                x = before[:m]
                before = np.clip(e[at] * (t01 + x * t11) / (1 + x * t10), 1e-30, 1e30)
            r[at] = before
        after = np.ones(len(chains.size))
        for m, at in chains.backward():
            q[at] = after[:m]
            y = e[at] * after[:m]
            after[:m] = np.clip((t10 + t11 * y) / (1 + t01 * y), 1e-30, 1e30)
        p = 1 - 1 / (1 + r * q)
        if not edges:
            return p, left, right, None
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        y, x = e[pair + 1] * q[pair + 1], r[pair]
        z = 1 + t01 * y + x * t10 + x * t11 * y
        return p, left, right, np.array([(t01 * y / z).sum(), (x * t10 / z).sum(), (x * t11 * y / z).sum()])

    def fit(self, texts: list[str], toxic: list[int]) -> None:
        """AdaGrad on the conditional likelihood of token labels."""
        k, w = len(BINS) + 1, Words(texts)
        if not len(w.start):
            return
        level, rows = int(np.searchsorted(BINS, TOKEN_LEVEL, "right")), np.array(toxic)[w.doc]
        b = self.bin_of(w.hashes(), rows)
        y = ((b >= level) & (rows == 1)).astype(float)
        within = np.arange(len(b)) - w.offset[w.doc]
        begin = np.flatnonzero(within % PIECE == 0)
        piece = np.cumsum(within % PIECE == 0)
        chains = Chains(np.append(begin, len(b)))
        same = piece[1:] == piece[:-1]
        y0, y1 = y[:-1][same], y[1:][same]
        got = np.array([((1 - y0) * y1).sum(), (y0 * (1 - y1)).sum(), (y0 * y1).sum()])
        seen = np.full(len(self.weights), 1e-6)
        for _ in range(EPOCHS):
            p, left, right, pairs = self.marginals(b, piece, chains, True)
            g = np.concatenate([np.bincount(x, y - p, k) for x in (b, left, right)] + [got - pairs]) / np.sqrt(len(b)) - DECAY * self.weights
            seen += g * g
            self.weights = self.weights + RATE * g / np.sqrt(seen)

    def scan(self, texts: list, own: list | None = None, marks: list | None = None) -> Iterator[tuple[Scan, np.ndarray, int]]:
        """Words, each one's probability to be toxic, and the number of texts. own: labels of the texts'
        rows, if they are among those counted. marks: bins of the texts' words, if they are known."""
        for at, part in chunks(texts, TOGETHER):
            w = Scan(part, Words.hashes)
            rows = None if own is None else np.array(own)[at + w.doc]
            bins = self.bin_of(w.of, rows) if marks is None else np.frombuffer(b"".join(marks[at : at + len(part)]), np.uint8).astype(np.int64)
            p = self.marginals(bins, w.doc, Chains(w.offset))[0] if len(w.doc) else np.zeros(0)
            yield w, p, len(part)

    @staticmethod
    def evidence(w: Scan, p: np.ndarray, n: int) -> np.ndarray:
        """log(1 + expected odds that a text has toxic words): grows with their number and certainty."""
        if not n:
            return np.zeros(0)
        return np.log1p(np.bincount(w.doc, np.where(p >= FLOOR, -np.log1p(-np.minimum(p, 1 - 1e-12)), 0.0), n))

    def mark(self, texts: list, marks: list) -> Iterator[bytes]:
        """Bins of each text's words, a byte each: those of the lexicon's words here, else those in marks."""
        for at, part in chunks(texts, TOGETHER):
            w = Scan(part, Words.hashes)
            bins = self.bin_of(w.of).astype(np.uint8)
            for i, (a, b) in enumerate(itertools.pairwise(w.offset.tolist())):
                old = marks[at + i]
                yield (bins[a:b] if old is None else np.maximum(bins[a:b], np.frombuffer(old, np.uint8))).tobytes()

    def predict(self, texts: list, spans: bool = True, marks: list | None = None) -> Iterator[tuple[float, float, list]]:
        """Score, expected toxic words, and spans (start, end, probability) in code points, of each text."""
        for w, p, n in self.scan(texts, None, marks):
            score = 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(w, p, n) + self.shift, -30, 30)))
            expected = np.bincount(w.doc, p, n)
            found: list[list] = [[] for _ in range(n)]
            if spans:
                for i in np.flatnonzero(p >= SPAN_LEVEL).tolist():
                    a = int(w.begin[i])
                    b, old = a + int(w.length[i]), found[int(w.doc[i])]
                    if old and old[-1][3] == i - 1:
                        old[-1] = (old[-1][0], b, max(old[-1][2], float(p[i])), i)
                    else:
                        old.append((a, b, float(p[i]), i))
            yield from zip(score.tolist(), expected.tolist(), ([s[:3] for s in f] for f in found), strict=True)


FREQUENCIES = "word long, toxic long, other long"


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word hash, toxic rows, other rows) of this task."""
    total = None
    for b in batches:
        toxic = np.array(b.column(1).to_pylist(), np.int64)
        for at, part in chunks(b.column(0).to_pylist(), PIECE_CHARS):
            w = Words(part)
            pair = np.unique(np.stack([w.hashes(), w.doc.astype(np.uint64)], axis=1), axis=0) if len(w.start) else np.zeros((0, 2), np.uint64)
            word, n = np.unique(pair[:, 0], return_inverse=True)
            y = toxic[at + pair[:, 1].astype(np.int64)]
            new = word, np.bincount(n, y, len(word)), np.bincount(n, 1 - y, len(word))
            if total is not None:
                word, n = np.unique(np.concatenate([total[0], new[0]]), return_inverse=True)
                new = word, np.bincount(n, np.concatenate([total[1], new[1]])), np.bincount(n, np.concatenate([total[2], new[2]]))
            total = new
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(total[0].view(np.int64)), pa.array(total[1].astype(np.int64)), pa.array(total[2].astype(np.int64))], ["word", "toxic", "other"])


def _sample(rows: DataFrame, n: int, most: int) -> DataFrame:
    """Of n rows the most with the smallest __h."""
    # somewhat more than the sample by a cut on the hash alone, so that no task sorts more than that
    cut = most + 6 * most**0.5 + 30
    if n > 1.2 * cut:
        rows = rows.where(F.shiftrightunsigned("__h", 1) < F.lit(int(cut / n * (1 << 63))))
    return rows.orderBy("__h", "__id").limit(most)


def _arrays(lexicon: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted words of a lexicon, and the toxic and other rows that hold each."""
    got = lexicon.toArrow()
    words, toxic, other = (got.column(i).to_numpy() for i in range(3))
    words = words.astype(np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], toxic[order], other[order]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, lexicon_words: int = LEXICON_WORDS) -> Field:
    """A field learned from the rows of docs that labels has a label (0 or 1) for.

    Word frequencies cover all those rows; the weights are fitted on sample_rows of them, chosen by a
    hash of the id, in WORKERS tasks whose weights are averaged. The rarer class makes up a tenth of them
    at least, or all its rows if they are fewer; scores are put back to the
    shares of all rows, while the probabilities of words stay those at the sample's shares. Without toxic rows, or without
    others, the field calls nothing toxic. A lexicon of more than lexicon_words is read in slices.
    Rows with a null id or without a label are left out; of several labels of an id the largest counts,
    and each row that repeats an id counts. Null texts are empty. Empty tables teach nothing.
    """
    labels = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("long").alias("__y"))
    labels = materialize(labels, "labels")
    # most rows have no label: a filter of the labelled ids keeps their texts out of the shuffle
    as_hash = F.xxhash64(F.col("__id"))
    known = bloom.build(labels.select(as_hash.alias("h")), bloom.bits_for(labels.count()))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__t"))
    rows = materialize(texts.where(known.column(as_hash)).join(labels, "__id"), "labelled")
    sizes = dict(rows.groupBy("__y").count().collect())
    nt, nc = sizes.get(1, 0), sizes.get(0, 0)
    f = Field()
    if not nt or not nc:
        f.slope, f.shift = 0.0, (-4.0 if nc or not nt else 0.0)
        return f
    f.share = nt / (nt + nc)
    sums = rows.select("__t", "__y").mapInArrow(_frequencies, FREQUENCIES).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    lexicon = materialize(sums.where((F.col("toxic") >= LEAST_ROWS) & (F.col("toxic") > f.share * (F.col("toxic") + F.col("other")))), "lexicon")
    # of each class its share of the sample, but of the rarer one a tenth of the sample at least
    rare = min(nt, nc, max(round(sample_rows * min(nt, nc) / (nt + nc)), sample_rows // RARER))
    take = [min(max(nt, nc), sample_rows - rare), rare][:: 1 if nt <= nc else -1]
    pick = rows.withColumn("__h", F.xxhash64("__id", F.lit("sample")))
    pick = _sample(pick.where("__y = 1"), nt, take[1]).unionAll(_sample(pick.where("__y = 0"), nc, take[0]))
    excess = (take[1] / take[0]) / (nt / nc)
    sample = pick.repartition(WORKERS, "__h")
    n, near = lexicon.count(), lexicon
    if n > lexicon_words:  # fitting needs the words of the sample only
        near = lexicon.join(sample.select("__t", "__y").mapInArrow(_frequencies, FREQUENCIES).select("word").distinct(), "word")
    f.words, f.toxic, f.other = _arrays(near)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((h, t, y) for b in batches for h, t, y in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        if got:
            own = Field(f.words, f.toxic, f.other, f.share)
            own.fit([t for _, t, _ in got], [y for _, _, y in got])
            yield pa.RecordBatch.from_arrays([pa.array([own.weights.tolist()], pa.list_(pa.float64())), pa.array([len(got)], pa.int64())], ["w", "n"])

    fitted = sample.select("__h", "__t", "__y").mapInArrow(fit, "w array<double>, n long").collect()
    total = sum(n for _, n in fitted)
    f.weights = np.sum([np.array(w) * n for w, n in sorted(fitted)], axis=0) / total

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.concatenate([Field.evidence(*s) for s in f.scan(b.column(0).to_pylist(), b.column(1).to_pylist())] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([pa.array(x), b.column(1)], ["x", "y"])

    seen = sample.select("__t", "__y").mapInArrow(measure, "x double, y long").toArrow()
    f.slope, f.shift = _logistic(seen.column(0).to_numpy(), seen.column(1).to_numpy())
    f.shift -= float(np.log(excess))
    if n > lexicon_words:
        f.table, f.slices = lexicon, -(-n // lexicon_words)
    return f


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, slightly regularised; the slope is never negative."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((y - p) * x).sum() - 0.01 * a, (y - p).sum() - 0.01 * b])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(a)), float(b)


def _marker(shared: Broadcast) -> Callable:
    @F.arrow_udf("binary")
    def mark(texts: pa.Array, marks: pa.Array) -> pa.Array:
        return pa.array(list(shared.value.mark(texts.to_pylist(), marks.to_pylist())), pa.binary())

    return mark


def _marked(df: DataFrame, model: Field, text_col: str) -> DataFrame:
    """df with __b, the bins of each text's words, from one slice of the lexicon after the other."""
    spark, before = df.sparkSession, None
    df = df.withColumn("__b", F.lit(None).cast("binary"))
    for k in range(model.slices):
        words, toxic, other = _arrays(model.table.where(F.pmod(F.xxhash64("word"), F.lit(model.slices)) == k))
        shared = spark.sparkContext.broadcast(Field(words, toxic, other, model.share))
        df = materialize(df.withColumn("__b", _marker(shared)(F.col(text_col), F.col("__b"))), "marks")
        if before is not None:
            discard(before)
        before = df
        shared.unpersist()
    return df


def score(df: DataFrame, model: Field, text_col: str = "text", spans: bool = True) -> DataFrame:
    """df with score (0 to 1), toxic_words (expected number) and spans (start, end, probability).

    Null and empty texts score as texts without words, whole texts of any length as one chain. Rows may
    repeat. An empty table gives an empty table. Columns named like a result are replaced.
    """
    df = without(df, *RESULTS)
    columns, marked = df.columns, model.table is not None
    if marked:
        df = _marked(df, model, text_col)
    shared = df.sparkSession.sparkContext.broadcast(replace(model, table=None))

    @F.arrow_udf("struct<score double, toxic_words double, spans array<struct<start int, end int, probability double>>>")
    def run(texts: pa.Array, *marks: pa.Array) -> pa.Array:
        out = list(shared.value.predict(texts.to_pylist(), spans, marks[0].to_pylist() if marks else None))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.float64()), pa.array([[dict(zip(("start", "end", "probability"), s, strict=True)) for s in x[2]] for x in out], kind)], list(RESULTS))

    rows = df.withColumn("__r", run(F.col(text_col), F.col("__b")) if marked else run(F.col(text_col)))
    return rows.select(*columns, *[F.col(f"__r.{c}").alias(c) for c in RESULTS])
