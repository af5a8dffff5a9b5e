"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets counts over its whole text. Ratios of these counts are
sketched per (language, source): a sketch is the number of documents in each
logarithmic bucket of a ratio, so sketches merge by adding counts, any
quantile has a relative error of at most ``ACCURACY``, and the result does not
depend on the order of merging. The fence of a group is its median plus
``SPREADS`` times the distance between first decile and median; no ratio has a
cutoff of its own. Taken from the lower half, it holds up to half of a group
being junk. Groups with few documents take their language's fence, and that in
turn the one of all documents. Documents are then joined with their group's
fences.

A document fails a rule if its ratio is beyond the fence by more than chance
explains: its count is taken ``ERRORS`` standard errors towards the fence first,
counts being those of single events, so that one repeated line among three is
no evidence, and twenty among sixty are. A repeated run of three words marks
six words at least, which are one event.

Null and empty texts have no words and fail the base rule. Very long texts are
read whole, their words as 64-bit hashes. Null languages or sources form groups
of their own. A ratio that equals its fence passes. Repeated rows count as often
as they occur, and each gets a result. An empty table gives an empty one. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import longtext
from marlstone.llm._common import checkpointed, map_texts

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
ACCURACY = 0.01
MIN_GROUP = 200
SPREADS = 4.0
#: Up to this many groups the fences are broadcast; beyond, they are joined by salted shuffle.
BROADCAST_GROUPS = 20_000
SALTS = 32
#: Standard errors by which a document's count must be beyond its group's fence.
ERRORS = 4.0
#: Ratio: numerator, denominator, the numerator's units in one event, is there a lower fence too.
RATIOS = {
    "symbols": ("n_symbols", "n_words", 1, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1, False),
    "repeats": ("n_repeat_words", "n_words", 6, False),
    "upper": ("n_upper", "word_chars", 1, False),
    "marks": ("n_marks", "n_words", 1, False),
    "word_len": ("word_chars", "n_words", 1, True),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
_SPACES = str.maketrans("", "", " \t\n\v\f\r")


def text_counts(text: str) -> tuple[int, ...]:
    """The counts of ``COUNTS`` for one text."""
    if len(text) > longtext.LONG:
        return _long_counts(text)
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: at exactly the six ASCII white spaces
    n = len(words)
    lines = [x for x in text.split("\n") if x.translate(_SPACES)]
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < n - 2:
            seen = Counter(windows)
            repeated = _marked(np.fromiter((seen[w] > 1 for w in windows), bool, n - 2))
    return n, len(text.translate(_SPACES)), _symbols(text), len(lines) - len(set(lines)), repeated, len(lines), _uppers(text), text.count("!") + text.count("?")


def _long_counts(text: str) -> tuple[int, ...]:
    """The same, stretch by stretch."""
    words, lines = longtext.word_hashes(text), longtext.line_hashes(text)
    chars = sum(len(x.translate(_SPACES)) for x in longtext.stretches(text))
    upper = sum(map(_uppers, longtext.stretches(text)))
    repeated = _marked(longtext.several(longtext.triples(words)))
    return len(words), chars, _symbols(text), len(lines) - longtext.distinct(lines), repeated, len(lines), upper, text.count("!") + text.count("?")


def _symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def _uppers(text: str) -> int:
    return 0 if text.islower() else len(text) - len(text.translate(_UPPER)) if text.isascii() else sum(map(str.isupper, text))


def _marked(starts: np.ndarray) -> int:
    """Words in any of the windows of three words that start where ``starts`` is true."""
    marked = np.zeros(len(starts) + 2, bool)
    for k in range(3):
        marked[k : len(starts) + k] |= starts
    return int(marked.sum())


_UPPER = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _counter() -> Callable[[list[str]], list]:
    return lambda texts: list(map(list, zip(*map(text_counts, texts), strict=True)))


def count_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    return map_texts(df, _counter, ", ".join(f"{c} long" for c in COUNTS), id_col, text_col, carry)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _gamma() -> float:
    return (1 + ACCURACY) / (1 - ACCURACY)


def sketches(features: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """(groups, ratio, bucket, n): a quantile sketch of each ratio in each group."""
    value = lambda a, b: F.try_divide(F.col(a), F.col(b))
    bucket = lambda x: F.when(x > 1e-6, F.ceil(F.ln(x) / math.log(_gamma()))).otherwise(F.lit(-(10**6))).cast("int")
    each = F.array(*[F.struct(F.lit(k).alias("ratio"), bucket(value(a, b)).alias("bucket")) for k, (a, b, *_) in RATIOS.items()])
    return features.select(*groups, F.explode(each).alias("x")).groupBy(*groups, "x.ratio", "x.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Sketches of wider groups from those of narrower ones."""
    return sketch.groupBy(*groups, "ratio", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, groups: tuple[str, ...], at: tuple[float, ...]) -> DataFrame:
    """(groups, ratio, docs, q0, q1, ...) from sketches."""
    keys = [*groups, "ratio"]
    up_to = Window.partitionBy(*keys).orderBy("bucket")
    whole = Window.partitionBy(*keys)
    value = F.when(F.col("bucket") > -(10**6), 2 * F.pow(F.lit(_gamma()), F.col("bucket")) / (_gamma() + 1)).otherwise(0.0)
    steps = sketch.withColumns({"below": F.sum("n").over(up_to), "docs": F.sum("n").over(whole), "value": value})
    return steps.groupBy(*keys).agg(F.max("docs").alias("docs"), *[F.min(F.when(F.col("below") >= q * F.col("docs"), F.col("value"))).alias(f"q{i}") for i, q in enumerate(at)])


def fences(sketch: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """(groups, docs, {ratio}_hi, {ratio}_lo): one row per group."""
    q = quantiles(sketch, groups, (0.1, 0.5))
    spread = SPREADS * (F.col("q1") - F.col("q0"))
    of = lambda k, x: F.max(F.when(F.col("ratio") == k, x))
    out = [F.max("docs").alias("docs")]
    for k, (_, _, _, below) in RATIOS.items():
        out.append(of(k, F.col("q1") + spread).alias(f"{k}_hi"))
        if below:
            out.append(of(k, F.col("q1") - spread).alias(f"{k}_lo"))
    return q.groupBy(*groups).agg(*out)


def group_fences(groups: DataFrame, sketch: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """Fences of every (language, source) of ``groups``, small ones and those without a sketch backed off."""
    limits = [f"{k}_{side}" for k, r in RATIOS.items() for side in ("hi", "lo") if side == "hi" or r[3]]
    own = fences(sketch, (lang_col, source_col)).withColumnsRenamed({lang_col: "_own_lang", source_col: "_own_source"})
    same = F.col(lang_col).eqNullSafe(F.col("_own_lang")) & F.col(source_col).eqNullSafe(F.col("_own_source"))
    own = groups.select(lang_col, source_col).distinct().join(own, same, "left")
    of_lang = fences(merged(sketch, (lang_col,)), (lang_col,)).select(F.col(lang_col).alias("_lang"), F.col("docs").alias("_docs"), *[F.col(c).alias(f"l_{c}") for c in limits])
    of_all = fences(merged(sketch, ()).withColumn("_all", F.lit(0)), ("_all",)).select(*[F.col(c).alias(f"a_{c}") for c in limits])
    joined = own.join(of_lang, F.col(lang_col).eqNullSafe(F.col("_lang")), "left").join(F.broadcast(of_all), F.lit(True), "left")  # of_all: one row
    pick = lambda c: F.when(F.col("docs") >= MIN_GROUP, F.col(c)).when(F.col("_docs") >= MIN_GROUP, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    return joined.select(F.col(lang_col).alias("f_lang"), F.col(source_col).alias("f_source"), *[pick(c).alias(c) for c in limits])


def apply_fences(features: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``features`` with ``base_failed``, ``failed_rules`` and ``kept``."""
    same = F.col(lang_col).eqNullSafe(F.col("f_lang")) & F.col(source_col).eqNullSafe(F.col("f_source"))
    limits = checkpointed(limits)
    if limits.count() <= BROADCAST_GROUPS:
        joined = features.join(F.broadcast(limits), same, "left")
    else:
        spread = limits.withColumn("f_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = features.withColumn("_salt", F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, same & (F.col("_salt") == F.col("f_salt")), "left")
    failed = []
    for k, (a, b, unit, below) in RATIOS.items():
        error = ERRORS * F.sqrt(F.col(a) * unit)
        bad = F.try_divide(F.col(a) - error, F.col(b)) > F.col(f"{k}_hi")
        if below:
            bad = bad | (F.try_divide(F.col(a) + error, F.col(b)) < F.col(f"{k}_lo"))
        failed.append(F.when(bad, F.lit(k)))
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("failed_rules", F.concat_ws(",", *failed))
        .withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
    )


def quality_rules(df: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed, failed_rules and kept of every row of ``df``."""
    features = checkpointed(count_features(df, carry=(lang_col, source_col)))
    sketch = checkpointed(sketches(features.where(~base_failed()), (lang_col, source_col)))
    known = group_fences(features, sketch, lang_col, source_col)
    return apply_fences(features, known, lang_col, source_col).select("doc_id", *COUNTS, "base_failed", "failed_rules", "kept")
