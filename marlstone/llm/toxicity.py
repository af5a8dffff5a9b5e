"""Toxicity: subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of the word itself and of its
character n-grams, hashed into ``BUCKETS``; a text's vector is the mean of its
words'. Embeddings and softmax are trained together, with Adam over all
training rows, so a misspelling that was not seen shares most of its n-grams'
vectors with the word. The softmax being linear, a word's share in a text's
score is one number, which workers keep for the words that they have met.

Training takes at most ``SAMPLE_ROWS`` labelled rows, picked by a hash of their
id; their texts are read whole, of any length. Words are counted on the
executors; the driver gets the vocabulary, words of ``MIN_DOCS`` rows or more,
and for each row the weights of its words, but no texts. Null ids, null labels
and rows without text do not count, of repeated labels the mean is rounded, and
of rows that share an id the first text in order counts, once, so the same
tables give the same model. Without rows of both labels, as with empty tables,
every score is 0.

Null texts read as empty; texts without a word have the score of the bias alone.
Scoring reads whole texts, very long ones stretch by stretch. A score at the cut
counts as toxic. Repeated rows get the same score. Columns of other names are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import longtext
from marlstone.llm._common import bounded_batches, checkpointed, fold, map_texts, text_column, texts_of
from marlstone.llm.ranker import labelled, sampled

WORD = re.compile(r"[^\W_]+")
BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
DIM = 4
SAMPLE_ROWS = 10_000
#: Rarer words are left out of training: there they only tell single texts apart.
MIN_DOCS = 3
STEPS = 120
RATE = 0.1
L2 = 2e-6
#: A word that occurs n times weighs n to this power, so that one repeated word is not the whole text.
DAMP = 0.6
#: So many words of vector zero are added to every text, else the few words of a short one weigh too much.
PAD = 60
#: A text's mean is multiplied by this, else a few words among hundreds cannot move it.
GAIN = 50.0
CUT = 0.5
#: What an overlooked toxic text costs against a wrongly accused one.
POSITIVE = 2.0
SEED = 11
CACHE = 300_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def subwords(word: str) -> list[int]:
    """Buckets of the word and of its n-grams, its two ends marked. Of a very long word, all."""
    w = f"<{word}>".encode()
    return [zlib.crc32(w) % BUCKETS, *[zlib.crc32(w[i : i + k], k) % BUCKETS for k in GRAMS for i in range(len(w) - k + 1)]]


class _Rows:
    """Means of rows, and their transpose, for a ragged list of row numbers."""

    def __init__(self, owner: np.ndarray, item: np.ndarray, weight: np.ndarray, owners: int, items: int) -> None:
        self.there = self._sorted(owner, item, weight, owners)
        self.back = self._sorted(item, owner, weight, items)

    @staticmethod
    def _sorted(to: np.ndarray, of: np.ndarray, weight: np.ndarray, n: int) -> tuple:
        order = np.argsort(to, kind="stable")
        starts = np.searchsorted(to[order], np.arange(n))
        return of[order], weight[order, None].astype(np.float32), starts, np.bincount(to, minlength=n) > 0

    @staticmethod
    def _apply(side: tuple, x: np.ndarray) -> np.ndarray:
        of, weight, starts, has = side
        out = np.zeros((len(has), x.shape[1]), np.float32)
        out[has] = np.add.reduceat(x[of] * weight, starts[has], axis=0)
        return out

    def mean(self, x: np.ndarray) -> np.ndarray:
        return self._apply(self.there, x)

    def spread(self, g: np.ndarray) -> np.ndarray:
        return self._apply(self.back, g)


def weights(text: str) -> tuple[list[str], np.ndarray]:
    """The text's distinct words, and the share of each in its mean."""
    counts = longtext.counted(text, words_of)
    damped = np.fromiter(counts.values(), np.float64, len(counts)) ** DAMP
    return list(counts), damped / (damped.sum() + PAD)


class Model:
    """What scoring needs: each bucket's share in the logit, and the bias."""

    def __init__(self, vocabulary: list[str], rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        """rows: of each text, numbers of words and their weights."""
        self.known = len(set(y.tolist())) == 2
        if not self.known:
            return
        none = [np.zeros(0, np.int64)]
        sizes = [len(x) for x, _ in rows]
        item = np.concatenate([*none, *[x for x, _ in rows]])
        by_doc = _Rows(np.repeat(np.arange(len(rows)), sizes), item, np.concatenate([np.zeros(0), *[w for _, w in rows]]), len(rows), len(vocabulary))
        bags = [subwords(w) for w in vocabulary]
        size = np.array([len(b) for b in bags], np.int64)
        by_word = _Rows(np.repeat(np.arange(len(bags)), size), np.concatenate([*none, *[np.array(b, np.int64) for b in bags]]), np.repeat(1 / np.maximum(1, size), size), len(bags), BUCKETS)
        self._train(by_doc, by_word, y)

    def _train(self, by_doc: _Rows, by_word: _Rows, y: np.ndarray) -> None:
        draw = np.random.default_rng(SEED)
        params = [draw.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), draw.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)]
        first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
        target = np.eye(2, dtype=np.float32)[y]
        pull = np.where(y == 1, POSITIVE, 1.0).astype(np.float32)[:, None] / len(y)
        for step in range(1, STEPS + 1):
            e, w, b = params
            h = GAIN * by_doc.mean(by_word.mean(e))
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - target) * pull
            grads = [by_word.spread(by_doc.spread(GAIN * (g @ w.T))) + L2 * e, h.T @ g + L2 * w, g.sum(0)]
            for i, x in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * x
                second[i] = 0.99 * second[i] + 0.01 * x * x
                params[i] = params[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-7)
        e, w, b = params
        self.bucket = (GAIN * (e @ (w[:, 1] - w[:, 0]))).astype(np.float32)
        self.bias = float(b[1] - b[0])

    def word(self, word: str) -> float:
        ids = subwords(word)
        return float(self.bucket[ids].sum()) / len(ids)


def scorer(model: Model) -> Callable[[list[str]], list]:
    class Known(dict):
        def __missing__(self, word: str) -> float:
            self[word] = x = model.word(word)
            return x

    known = Known()

    def run(texts: list[str]) -> list:
        if not model.known:
            return [np.zeros(len(texts))]
        if len(known) > CACHE:
            known.clear()
        z = np.full(len(texts), model.bias)
        for i, text in enumerate(texts):
            words, share = weights(text)
            if words:
                z[i] += share @ np.fromiter(map(known.__getitem__, words), np.float64, len(words))
            if len(known) > 2 * CACHE:  # a text with very many words
                known.clear()
        return [1 / (1 + np.exp(-np.clip(z, -60, 60)))]

    return run


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Model:
    """Learn from the labels given; the caller leaves held-out ones out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = checkpointed(sampled(docs, labelled(labels, column, SAMPLE_ROWS)).select("text", "label", "doc_id"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in texts_of(batch, 0):
                seen.update(longtext.counted(text, words_of).keys())
            yield pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    common = rows.select("text").mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS)
    vocabulary = common.select("word").orderBy("word").toArrow().column(0).to_pylist()  # bounded: words of several of the rows
    shared = spark.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, shares = [], []
            for text in texts_of(batch, 0):
                found, share = weights(text)
                at = np.fromiter((index.get(w, -1) for w in found), np.int32, len(found))
                order = np.argsort(at, kind="stable")[int((at < 0).sum()) :]
                ids.append(at[order])
                shares.append(share[order].astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["doc_id", "label", "ids", "shares"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, ids array<int>, shares array<float>"
    got = rows.mapInArrow(bags, schema).orderBy("doc_id").select("label", "ids", "shares").toArrow().combine_chunks()
    lists = [(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(got.column("ids"), got.column("shares"), strict=True)]
    return Model(vocabulary, lists, np.array(got.column("label").to_pylist(), np.int64))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score and predicted of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats
    return map_texts(df, lambda: scorer(shared.value), "score double", id_col, text_col).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def score_column(model: Model):
    return text_column(lambda: scorer(model), "double")


def held_out():
    return fold("doc_id", 5) == 0
