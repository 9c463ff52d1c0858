"""Toxicity: a linear-chain conditional random field tags toxic spans.

Documents carry the labels, tokens don't, so token labels are made first. On a bounded sample of labelled
rows, beginnings of words (STEM letters or more, the whole word included, so that inflected forms count
together) that stand in toxic documents mostly are candidates. The number of different contexts (the word's
neighbours) of each in toxic documents is tested against that in clean ones; a copied passage counts once,
however often it was copied. Of nested beginnings the one with the best test stays, the longest of equal
ones. A word with a beginning that passed is labelled toxic in a toxic document, and clean in a clean one.
The field (a weight for each beginning, one for all other words, transitions between the tags) is fitted to
windows around those words by gradient ascent on its log-likelihood.

Scoring reads whole texts. Tokens between two words of the vocabulary all have the same factor, so the
forward and backward passes cross them by a power of one matrix; the marginals are those of the whole
chain. A logistic function of the expected number of toxic tokens and of the largest marginal turns them
into the score; spans are runs of characters of tokens whose marginal is at least one half.

Tokens are runs of letters and digits, lower-cased, for learning and scoring alike.

Null and empty texts get the score of a text without a word of the vocabulary. Labels of null value or
without a document are ignored, repeated ones count once each; without labels of both kinds all scores are
0. Repeated rows are scored alike. Score inputs are the text alone. op3's held_out is null where doc_id is.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: The sample of labelled rows is bounded by these; all else follows from whole texts of the sample.
TOXIC_ROWS, CLEAN_ROWS = 3000, 6000
_WORD = re.compile(r"[^\W_]+")
_HALF = 5
#: The features of a word: its beginnings of so many letters, and the whole word.
STEM, STEM_MOST = 4, 12


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))  # the last is that of all other words
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    begin: np.ndarray = field(default_factory=lambda: np.zeros(2))
    score: np.ndarray = field(default_factory=lambda: np.array([-50.0, 0.0, 0.0]))


def _beginnings(word: str) -> list[str]:
    return [word[:n] for n in range(STEM, min(len(word), STEM_MOST + 1))] + [word]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, t, n) of each beginning: toxic documents and all documents with it."""
    for batch in batches:
        both: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = _WORD.findall((text or "").lower())
            both[toxic].update(set(chain.from_iterable(map(_beginnings, set(w)))))
        keys = list(both[0].keys() | both[1].keys())
        yield pa.record_batch([pa.array(keys, pa.string()), pa.array([both[1][k] for k in keys], pa.int64()), pa.array([both[0][k] + both[1][k] for k in keys], pa.int64())], names=["w", "t", "n"])


def _all_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, toxic): hashes of all words with their neighbours, each at least once."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        found: tuple[set, set] = (set(), set())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = _WORD.findall((text or "").lower())
            found[toxic].update(zip(["", *w[:-1]], w, [*w[1:], ""]))
        h = [digest(" ".join(c)) - (1 << 63) for x in found for c in x]
        yield pa.record_batch([pa.array(h, pa.int64()), pa.array([0] * len(found[0]) + [1] * len(found[1]), pa.int32())], names=["h", "toxic"])


def _contexts_of(candidates: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = _WORD.findall((text or "").lower())
                wanted = {x: own for x in set(w) if (own := candidates.intersection(_beginnings(x)))}
                rows.update((k, before, after, toxic) for x, before, after in zip(w, ["", *w[:-1]], [*w[1:], ""]) for k in wanted.get(x, ()))
            a, b, c, d = zip(*rows) if rows else ([], [], [], [])
            yield pa.record_batch([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.string()), pa.array(d, pa.int32())], names=["w", "before", "after", "toxic"])

    return run


def _tail(k: int, n: int, p: float) -> float:
    """A bound (Chernoff) of the logarithm of the chance of k or more out of n."""
    x = k / n
    if x <= p:
        return 0.0
    return -n * (x * math.log(x / p) + (0 if k == n else (1 - x) * math.log((1 - x) / (1 - p))))


def vocabulary(sample: DataFrame) -> list[str]:
    """The beginnings of words of sample (text, toxic) that mark toxic documents; none begins with another."""
    rows = sample.select("text", "toxic")
    counts = rows.mapInArrow(_document_counts, "w string, t long, n long").groupBy("w").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    share = rows.agg(F.avg("toxic")).first()[0]
    if not share or share == 1:
        return []
    found = counts.filter((F.col("t") >= 2) & (F.col("t") / F.col("n") > (1 + share) / 2)).select("w").collect()
    whole = {r.toxic: r["count"] for r in rows.mapInArrow(_all_contexts, "h long, toxic int").distinct().groupBy("toxic").count().collect()}
    if not found or not (whole.get(0) and whole.get(1)):
        return []
    p = whole[1] / (whole[0] + whole[1])
    contexts = rows.mapInArrow(_contexts_of(frozenset(r.w for r in found)), "w string, before string, after string, toxic int").distinct()
    toxic = F.col("toxic") == 1
    # An edit in one of many copies changes the neighbours on one side only, so both sides must differ.
    side = F.least(F.countDistinct(F.when(toxic, F.col("before"))), F.countDistinct(F.when(toxic, F.col("after"))))
    tested = contexts.groupBy("w").agg(F.sum("toxic").cast("long").alias("t"), F.count("*").alias("n"), side.alias("side"))
    passed = tested.filter((F.col("side") >= 6) & (F.col("t") / F.col("n") > (1 + p) / 2)).collect()
    best: list[str] = []
    begun: set[str] = set()  # all beginnings of what is in best
    for s, _, w in sorted((_tail(r.t, r.n, p), -len(r.w), r.w) for r in passed):
        if s < math.log(1e-6) and w not in begun and not any(w[:n] in best for n in range(1, len(w))):
            best.append(w)
            begun.update(w[:n] for n in range(1, len(w) + 1))
    return best


def _passes(emit: np.ndarray, moves: np.ndarray, begin: np.ndarray):
    """Of (n, length, 2) emissions: log-normaliser, tag marginals, sums of pair marginals by tags."""
    n, length, _ = emit.shape
    e, m = np.exp(emit), np.exp(moves)
    f, scale = np.empty_like(e), np.empty((n, length))
    at = e[:, 0] * np.exp(begin)
    for t in range(length):
        if t:
            at = (f[:, t - 1] @ m) * e[:, t]
        scale[:, t] = at.sum(1)
        f[:, t] = at / scale[:, t, None]
    b = np.ones((n, 2))
    marginal, pairs = np.empty_like(e), np.zeros((2, 2))
    for t in range(length - 1, -1, -1):
        marginal[:, t] = f[:, t] * b
        if t:
            x = e[:, t] * b / scale[:, t, None]
            pairs += np.einsum("na,nb->ab", f[:, t - 1], x) * m
            b = x @ m.T
    return np.log(scale).sum(1), marginal, pairs


def fit_field(windows: np.ndarray, tags: np.ndarray, n_words: int, rounds: int = 150) -> Model:
    """windows (n, length) of word numbers, n_words for others; tags alike. Adam on the mean log-likelihood."""
    model = Model(weights=np.zeros(n_words + 1), moves=np.zeros((2, 2)), begin=np.zeros(2))
    if not len(windows):
        return model
    own = np.zeros(n_words + 1)
    np.add.at(own, windows, tags)
    own_pairs = np.zeros((2, 2))
    np.add.at(own_pairs, (tags[:, :-1], tags[:, 1:]), 1)
    own_begin = np.bincount(tags[:, 0], minlength=2)
    theta = np.zeros(n_words + 1 + 4 + 2)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    n = len(windows)
    for step in range(1, rounds + 1):
        w, moves, begin = theta[: n_words + 1], theta[n_words + 1 : -2].reshape(2, 2), theta[-2:]
        emit = np.zeros((*windows.shape, 2))
        emit[..., 1] = w[windows]
        _, marginal, pairs = _passes(emit, moves, begin)
        expected = np.bincount(windows.ravel(), marginal[..., 1].ravel(), n_words + 1)
        grad = np.concatenate([own - expected, (own_pairs - pairs).ravel(), own_begin - marginal[:, 0].sum(0)]) / n - 1e-4 * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta = theta + 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    model.weights, model.moves, model.begin = theta[: n_words + 1], theta[n_words + 1 : -2].reshape(2, 2), theta[-2:]
    return model


class Tagger:
    """Finds words that begin as the vocabulary says in whole texts and computes their marginals."""

    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        for i, w in enumerate(model.words):
            self.automaton.add_word(w, i)
        if model.words:
            self.automaton.make_automaton()
        self.move = np.exp(model.moves)
        self.step = self.move * np.exp([0.0, model.weights[-1]])  # over a token of another word
        self.squares = [self.step / self.step.sum()]  # of the step, to its powers of two

    @functools.lru_cache(maxsize=4096)
    def power(self, n: int) -> np.ndarray:
        """The step to the power n, up to a factor, by squaring."""
        out, k = np.eye(2), 0
        while n:
            if k == len(self.squares):
                p = self.squares[-1] @ self.squares[-1]
                self.squares.append(p / p.sum())
            if n & 1:
                out = out @ self.squares[k]
            n >>= 1
            k += 1
        return out / out.sum()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(word, tokens since the hit before, first and last offset) of each hit."""
        if not self.model.words:
            return []
        low = text.lower()
        if len(low) != len(text):  # a letter with a longer lower case; offsets follow the text as given
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        out, last = [], 0
        for end, i in self.automaton.iter(low):
            start = end - len(self.model.words[i]) + 1
            if start and low[start - 1].isalnum():
                continue
            while end + 1 < len(low) and low[end + 1].isalnum():  # to the end of the word
                end += 1
            gap = len(_WORD.findall(low, last, start))
            out.append((i, gap, start, end + 1))
            last = start
        return out

    def marginals(self, hits: list[tuple[int, int, int, int]], text: str) -> list[float]:
        """The chance of the toxic tag at each hit, given the whole chain."""
        if not hits:
            return []
        power = self.power
        rest = len(_WORD.findall(text, hits[-1][3]))
        emit = [np.array([1.0, math.exp(self.model.weights[h[0]])]) for h in hits]
        f = np.exp(self.model.begin)
        if hits[0][1]:
            f = (f * [1.0, math.exp(self.model.weights[-1])]) @ power(hits[0][1] - 1) @ self.move
        forward = []
        for n, (h, e) in enumerate(zip(hits, emit)):
            if n:
                f = f @ power(h[1] - 1) @ self.move
            f = f * e
            f = f / f.sum()
            forward.append(f)
        b = power(rest) @ np.ones(2)
        out = []
        for n in range(len(hits) - 1, -1, -1):
            x = forward[n] * b
            out.append(float(x[1] / x.sum()))
            if n:
                b = power(hits[n][1] - 1) @ self.move @ (emit[n] * b)
                b = b / b.sum()
        return out[::-1]


_taggers: dict[int, tuple[Model, Tagger]] = {}


def _tagger(model: Model) -> Tagger:
    if id(model) not in _taggers:
        _taggers.clear()
        _taggers[id(model)] = (model, Tagger(model))
    return _taggers[id(model)][1]


def _inputs(marginals: list[float]) -> tuple[float, float]:
    return (math.log1p(sum(marginals)), max(marginals)) if marginals else (0.0, 0.0)


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit on labels (doc_id, toxic) of documents (doc_id, text), of which a bounded sample is used."""
    with shared.scope():
        return _fit(documents, labels)


def _fit(documents: DataFrame, labels: DataFrame) -> Model:
    spark = documents.sparkSession
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = own.filter("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).union(own.filter("toxic = 0").orderBy(*order).limit(CLEAN_ROWS))
    ids = spark.createDataFrame([tuple(r) for r in ids.distinct().collect()], "doc_id long, toxic int")
    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # repeated ids don't outgrow the bound
    sample = shared.written(sample.select("text", "toxic"), "sample")
    words = vocabulary(sample)
    if not words:
        return Model()
    number = {w: i for i, w in enumerate(words)}
    other = len(words)
    lengths = sorted({len(w) for w in words})
    number_of = lambda word: next((number[word[:n]] for n in lengths if word[:n] in number), other)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tags = set(), []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = [number_of(x) for x in _WORD.findall((text or "").lower())]
                w = [other] * _HALF + w + [other] * _HALF
                at = {i for i, x in enumerate(w) if x != other} | {_HALF + 7 * (len(w) // 9)}
                for i in at:
                    if _HALF <= i < len(w) - _HALF:
                        rows.add((tuple(w[i - _HALF : i + _HALF + 1]), toxic))
            rows = list(rows)
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.int32())], names=["w", "toxic"])

    rows = sample.mapInArrow(windows, "w array<int>, toxic int").distinct().orderBy("w", "toxic").collect()
    w = np.array([r.w for r in rows], dtype=np.int64).reshape(-1, 2 * _HALF + 1)
    tags = ((w != other) & (np.array([r.toxic for r in rows])[:, None] == 1)).astype(np.int64)
    model = fit_field(w, tags, other)
    model.words = words

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            x = [_inputs(tagger.marginals(tagger.hits(t), t)) for t in (t or "" for t in batch.column(0).to_pylist())]
            yield pa.record_batch([pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), batch.column(1)], names=["a", "b", "toxic"])

    rows = sample.mapInArrow(inputs, "a double, b double, toxic int").collect()
    x = np.array([(1.0, r.a, r.b) for r in rows])
    y = np.array([r.toxic for r in rows], dtype=float)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    theta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ theta))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(3)
        theta = theta + np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-4 * theta)
    model.score = theta
    return model


def tag(text: Column, model: Model) -> Column:
    """A struct for a text: score, and spans (first offset, end, chance) of toxic characters."""

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,p:double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        tagger = _tagger(model)
        scores, spans = [], []
        for t in texts:
            t = t or ""
            hits = tagger.hits(t)
            p = tagger.marginals(hits, t)
            a, b = _inputs(p)
            scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, model.score[0] + model.score[1] * a + model.score[2] * b)))))
            spans.append([{"start": h[2], "end": h[3], "p": x} for h, x in zip(hits, p) if x >= 0.5])
        return pd.DataFrame({"score": scores, "spans": spans})

    return run(text)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit(documents, labels.filter(~held_out))
    rows = documents.select("doc_id", held_out.alias("held_out"), tag(F.col("text"), model).alias("t"))
    return rows.select("doc_id", "held_out", "t.score", (F.col("t.score") >= 0.7).cast("int").alias("predicted"), F.size("t.spans").alias("n_spans"), "t.spans")
