"""Quality by Bradley-Terry: scores learnt from preference pairs, cut at a quantile.

A document's score is linear in features of its whole text. Each pair of a
document labelled 1 and one labelled 0 says that the first wins; the weights
minimise the logistic loss of the differences of features over pairs drawn at
random with a fixed seed. The cut is a quantile of the training scores: of
a grid of quantiles, the one whose cut errs least on the training rows. Scores
are mapped to (0, 1) so that the cut lies at ``CUT``, by a logistic function
with the spread of the training scores.

Training takes at most ``SAMPLE_ROWS`` labelled rows, picked by a hash of their
id; null ids, null labels and rows without text do not count, of a document's
repeated labels the mean is rounded, and of rows that share an id the first
text in order counts, once. So the same tables give the same weights, in
whatever order their rows come. Without rows of both labels, as with empty
tables, every score is ``CUT``.

Null texts read as empty; empty texts are scored like any other. Very long texts
are read whole, their words as 64-bit hashes. A score at the cut passes.
Repeated rows get the same score. Columns of other names are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import longtext
from marlstone.llm._common import bounded_sample, fold, map_texts, text_column

SAMPLE_ROWS = 12_000
PAIRS = 200_000
STEPS = 200
L2 = 1e-4
CUT = 0.7
SEED = 7
_SPACES = str.maketrans("", "", " \t\n\v\f\r")
FEATURES = ("words", "word_len", "symbols", "any_symbol", "upper", "marks", "digits", "dup_lines", "repeats", "same_next", "distinct", "commas", "stops", "other")


def features(text: str) -> list[float]:
    """``FEATURES`` of a text; shares are stretched near zero, where they matter."""
    if len(text) > longtext.LONG:
        hashes, lines = longtext.word_hashes(text), longtext.line_hashes(text)
        n, n_lines, kinds, n_kinds = len(hashes), len(lines), longtext.distinct(lines), longtext.distinct(hashes)
        chars = max(1, sum(len(x.translate(_SPACES)) for x in longtext.stretches(text)))
        windows = max(0, n - 2)
        repeats = windows - longtext.distinct(longtext.triples(hashes))
        same = int((hashes[1:] == hashes[:-1]).sum())
    else:
        words = text.encode("utf-8", "surrogatepass").split()
        lines = [x for x in text.split("\n") if x.translate(_SPACES)]
        n, n_lines, kinds, n_kinds = len(words), len(lines), len(set(lines)), len(set(words))
        chars = max(1, len(text.translate(_SPACES)))
        windows = max(0, n - 2)
        repeats = windows - len(set(zip(words, words[1:], words[2:]))) if windows else 0
        same = sum(a == b for a, b in zip(words, words[1:]))  # noqa: B905  pairs
    m = max(1, n)
    symbols = sum(map(text.count, "#*$%&|<>"))
    digits = sum(map(text.count, "0123456789"))
    upper = 0 if text.islower() else sum(map(str.isupper, text))
    marks = text.count("!") + text.count("?")
    stops, commas = text.count("."), text.count(",")
    other = sum(map(text.count, "@{}[]()=+~^_\\/\"'"))
    near_zero = lambda x: math.log1p(50 * x)
    return [
        math.log1p(n), chars / m, near_zero(symbols / m), float(symbols > 0), near_zero(upper / chars), near_zero(marks / m), near_zero(digits / chars),
        near_zero((n_lines - kinds) / max(1, n_lines)), near_zero(repeats / max(1, windows)), near_zero(same / m), n_kinds / m,
        near_zero(commas / m), near_zero(stops / m), near_zero(other / m),
    ]


class Ranker:
    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        """x: features, y: labels 0 or 1."""
        self.known = len(set(y.tolist())) == 2
        if not self.known:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        draw = np.random.default_rng(SEED)
        win, lose = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
        d = z[draw.choice(win, PAIRS)] - z[draw.choice(lose, PAIRS)]
        self.weights = self._fit(d)
        s = z @ self.weights
        grid = np.unique(np.quantile(s, np.linspace(0, 1, 1001)))
        ordered = np.sort(s[win]), np.sort(s[lose])
        errors = np.searchsorted(ordered[0], grid) / len(win) + 1 - np.searchsorted(ordered[1], grid) / len(lose)
        best = np.nonzero(errors <= errors.min() + 1e-12)[0]
        at = float(grid[best[len(best) // 2]])
        below = s[s < at]
        self.cut = (at + float(below.max())) / 2 if len(below) else at  # half-way to the next score below
        self.spread = float(np.std(s)) / 4 + 1e-9

    @staticmethod
    def _fit(d: np.ndarray) -> np.ndarray:
        """Newton's method for mean log(1 + exp(-d w)) + L2 |w|^2."""
        w = np.zeros(d.shape[1])
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
            g = -(d * p[:, None]).mean(0) + 2 * L2 * w
            if np.abs(g).max() < 1e-7:
                break
            h = (d * (p * (1 - p))[:, None]).T @ d / len(d) + 2 * L2 * np.eye(len(w))
            w -= np.linalg.solve(h, g)
        return w

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), CUT)
        s = ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip((s - self.cut) / self.spread, -60, 60) - math.log(CUT / (1 - CUT))))


def labelled(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """At most ``rows`` ids with a 0/1 label: (_id, label)."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.round(F.avg(column)).cast("int").alias("label"))
    return bounded_sample(one, rows, "_id")


def sampled(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the picked ids that have a text, one row for each."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))  # bounded: the rows picked
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Ranker:
    """Learn from the labels given; the caller leaves held-out ones out."""
    picked = labelled(labels, column, SAMPLE_ROWS)
    known = sampled(docs, picked)
    rows = map_texts(known, lambda: lambda texts: [[features(t) for t in texts]], "x array<double>", carry=("label",)).orderBy("doc_id").select("x", "label").collect()
    return Ranker(np.array([r[0] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r[1] for r in rows], np.int64))


def score(df: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score and predicted of every row."""
    return map_texts(df, _scorer(model), "score double", id_col, text_col).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def score_column(model: Ranker):
    return text_column(_scorer(model), "double")


def _scorer(model: Ranker) -> Callable[[], Callable[[list[str]], list]]:
    return lambda: lambda texts: [model.scores(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES)))]


def held_out():
    return fold("doc_id", 4) == 2
