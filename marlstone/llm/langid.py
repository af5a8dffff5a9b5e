"""Language identification, words first.

Known words score by their log frequency in each language. A word that was
not seen falls back to its character n-grams, the longest first: the mean log
frequency of those that are known, of the longest length that has any. Word
and n-gram frequencies are counted by Spark on a bounded sample of the
training fold, n-grams over all of its words. All languages are learnt. Each
has a quota of words and of n-grams of each length, and a key that is kept has
its counts in all languages, so no language loses its own to a larger one's;
the tables that are sent to every worker are bounded by language.

A null text, or one without a letter, is ``und`` with score 0, and so is every
text if there is nothing to learn from, as with an empty table. Ties go to the
first language in alphabetical order. Very long texts are read whole, stretch
by stretch. Repeated rows get the same result, and count as often as they occur
where they are learnt from. Columns of other names are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import longtext
from marlstone.llm._common import bounded_batches, checkpointed, fold, map_texts, texts_of

WORD = re.compile(r"[^\W\d_]+")
#: Bounds of what is learnt of each language: documents, words, n-grams of each length.
SAMPLE_DOCS = 4000
MAX_WORDS = 200_000
MAX_GRAMS = 40_000
ORDERS = (5, 4, 3, 2, 1)
CACHE = 200_000
#: Up to this many numbers a table's rows are worked out beforehand.
DENSE = 1 << 24
#: The score's temperature, in words: posteriors are those of so many average words.
WEIGHT = 6.0


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n) over all rows of ``df``, counted per batch first and then merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(texts_of(batch, 0), batch.column(1).to_pylist(), strict=True):
                counts[lang].update(longtext.counted(text, words_of))
            for lang, c in counts.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(c), pa.string()), "word": pa.array(c.keys(), pa.string()), "n": pa.array(c.values(), pa.int64())})

    bounded_batches(df.sparkSession)
    counted = df.select(F.col(text_col), F.col(lang_col).cast("string")).mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Table:
    """Counts by key and language; a key's row is its log frequency in each language, less the largest."""

    def __init__(self, rows: pa.Table, langs: list[str]) -> None:
        at = {lang: i for i, lang in enumerate(langs)}
        rows = rows.sort_by([("key", "ascending"), ("lang", "ascending")])
        keys = rows["key"].to_pylist()
        self.lang = np.array([at[x] for x in rows["lang"].to_pylist()], np.int64)
        self.n = rows["n"].to_numpy().astype(float)
        first = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
        self.at = {keys[i]: r for r, i in enumerate(first)}
        self.bounds = np.array([*first, len(keys)], np.int64)
        self.sums = np.bincount(self.lang, self.n, len(langs)) if langs else np.zeros(0)
        every = len(self.at) * len(langs) <= DENSE
        self.dense = self._rows(np.arange(len(self.at))) if every else None

    def _rows(self, which: np.ndarray) -> np.ndarray:
        m = np.zeros((len(which), len(self.sums)))
        for i, r in enumerate(which.tolist()):
            a, b = self.bounds[r], self.bounds[r + 1]
            m[i, self.lang[a:b]] = self.n[a:b]
        if not m.size:
            return m.astype(np.float32)
        m = np.log((m + 0.5) / (self.sums + 0.5 * len(self.at)))
        return (m - m.max(1, keepdims=True)).astype(np.float32)  # just differences between languages matter

    def rows(self, keys: list[str]) -> np.ndarray:
        """The rows of those ``keys`` that are known."""
        which = np.array([r for r in map(self.at.get, keys) if r is not None], np.int64)
        return self.dense[which] if self.dense is not None else self._rows(which)


class Model:
    """Log frequencies by language: of words, and of n-grams by length."""

    def __init__(self, words: pa.Table | None = None, grams: pa.Table | None = None) -> None:
        """``words``: (lang, key, n); ``grams``: the same with their length k."""
        self.langs = sorted(set(words["lang"].to_pylist())) if words is not None else []
        self.tables: list[Table] = []
        if words is not None:
            self.tables = [Table(words, self.langs), *[Table(grams.filter(pc.equal(grams["k"], k)), self.langs) for k in ORDERS]]

    def word(self, word: str) -> np.ndarray:
        known = self.tables[0].rows([word])
        if len(known):
            return known[0]
        for k, table in zip(ORDERS, self.tables[1:], strict=True):
            found = table.rows(ngrams(word, k))
            if len(found):
                return np.sum(found, axis=0) / len(found)
        return np.zeros(len(self.langs), np.float32)


def ngrams(word: str, k: int) -> list[str]:
    """The n-grams of ``word`` with its two ends marked; of a long word, all of them."""
    w = f"<{word}>"
    return [w[i : i + k] for i in range(len(w) - k + 1)]


def gram_counts(counts: DataFrame) -> DataFrame:
    """(lang, k, key, n) of all words of ``counts`` (lang, word, n); n: the sum of the roots of the words' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int, str], float] = defaultdict(float)
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                damped = math.sqrt(n)  # else a few frequent words are all that n-grams show
                for k in ORDERS:
                    for g in ngrams(word, k):
                        found[lang, k, g] += damped
            if found:
                langs, ks, keys = zip(*found, strict=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "k": pa.array(ks, pa.int32()), "key": pa.array(keys, pa.string()), "n": pa.array(found.values(), pa.float64())})

    counted = counts.select("lang", "word", "n").mapInArrow(run, "lang string, k int, key string, n double")
    return counted.groupBy("lang", "k", "key").agg(F.round(F.sum("n"), 6).alias("n"))


def most_frequent(counts: DataFrame, by: tuple[str, ...], most: int) -> DataFrame:
    """The rows of all keys that are among the ``most`` most frequent of any language (and length)."""
    place = F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("n"), "key"))
    kept = counts.withColumn("place", place).where(F.col("place") <= most).select(*by, "key").distinct()
    return counts.join(kept, [*by, "key"], "left_semi")


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learn from about ``SAMPLE_DOCS`` rows, or all there are, of each of ``df``'s languages."""
    langs = df.where(F.col(lang_col).isNotNull()).groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).collect()
    if not langs:
        return Model()
    # each language's share of rows is picked by a hash of the id, so one pass does for all
    share = F.create_map(*[F.lit(x) for r in langs for x in (r[0], min(1.0, SAMPLE_DOCS / r[1]))])
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    known = df.where(place < share[F.col(lang_col)])
    counts = checkpointed(word_counts(known, text_col, lang_col))
    words = most_frequent(counts.withColumnRenamed("word", "key"), (), MAX_WORDS)
    grams = most_frequent(checkpointed(gram_counts(counts)), ("k",), MAX_GRAMS)
    return Model(words.select("lang", "key", "n").toArrow(), grams.select("lang", "k", "key", "n").toArrow())


def predictor(model: Model) -> Callable[[list[str]], list]:
    rows: list[np.ndarray] = []
    index: dict[str, int] = {}

    class Ids(dict):
        def __missing__(self, word: str) -> int:
            rows.append(model.word(word))
            self[word] = k = len(rows) - 1
            return k

    index = Ids()

    def run(texts: list[str]) -> list:
        langs: list[str] = []
        scores: list[float] = []
        for text in texts:
            total, n, letters = np.zeros(len(model.langs)), 0, False
            for part in longtext.stretches(text):
                if len(index) > CACHE:
                    index.clear()
                    rows.clear()
                words = words_of(part)
                if not words or not model.langs:
                    continue
                letters = letters or any(map(str.isalpha, "".join(words)))
                ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                if len(ids) > 64:
                    uniq, times = np.unique(ids, return_counts=True)
                else:
                    uniq, times = ids, np.ones(len(ids))
                total += times @ np.array([rows[i] for i in uniq.tolist()])
                n += len(words)
            if not letters:
                langs.append("und")
                scores.append(0.0)
                continue
            mean = total / n
            p = np.exp(WEIGHT * (mean - mean.max()))
            best = int(mean.argmax())
            langs.append(model.langs[best])
            scores.append(float(p[best] / p.sum()))
        return [langs, scores]

    return run


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred and score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_WORDS and MAX_GRAMS for each language
    return map_texts(df, lambda: predictor(shared.value), "lang_pred string, score double", id_col, text_col)


def held_out():
    return fold("doc_id", 4) == 2
