"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND.

Items are cut into units of at most ``UNIT`` words and indexed. A posting's
impact is its BM25 weight over the unit's own score, so a score of one means
that all of a unit's words are there. Postings are in blocks that know their
largest impact, and units of similar length share a tier. Every text is cut into overlapping passages, long enough for
a unit to lie in one whole, and each passage is a query: WAND finds all units
whose score reaches ``THRESHOLD``, skipping to the first unit whose terms'
largest impacts, then whose blocks' largest impacts, could reach it. Where a
passage's terms' largest impacts together stay below it in a tier, the tier
ends there, and most do.

A hit is then verified against the words around the passage: of the item's
question and of its answer (the last sentence, or the last half of a single
one), ``OVERLAP`` of the five-word shingles must occur.

Items of two to four words are found where all of their words stand side by
side, with a score of one. In scripts without spaces each character is a word.
Items of one word have no answer; they, empty and null ones are not searched
for. Null and empty texts have no hits; very long ones are searched whole, some
``PASSAGES`` passages at a time. A score or share that equals its threshold counts.
Items with the same text are all reported; an item that occurs twice in a text,
or twice in the table, is reported once. Repeated rows give repeated hits;
without items nothing is found, and everything is kept. Columns of other names
are not read.

The index is sent to workers in shards of bounded rows and bytes, each for a pass
over the texts, so that a worker holds one of them. Frequencies and lengths are
those of the whole table of items, however many shards it takes, so scores do
not hang on their number.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import longtext
from marlstone.llm._common import bounded_batches, checkpointed, map_texts, text_column, texts_of

#: Scripts that are written without spaces between words: Thai to Tibetan, Burmese, Khmer, kana, Han.
UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
#: A run of letters, digits and underscores, but each character of an unspaced script is a word of its own.
WORD = re.compile(rf"[^\W{UNSPACED}]+|\w")
UNIT = 64
PASSAGE = 2 * UNIT
STRIDE = UNIT
THRESHOLD = 0.7
TIERS = 16
OVERLAP = 0.8
SHINGLE = 5
K1, B = 1.2, 0.75
BLOCK = 32
#: Passages of a text that are bounded at once.
PASSAGES = 4096
#: Bounds of one shard of the index.
SHARD_ITEMS = 50_000
SHARD_BYTES = 32 << 20


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def all_words(text: str) -> list[str]:
    """The words of a text; of a long one stretch by stretch, equal ones as one object."""
    if len(text) <= longtext.LONG:
        return words_of(text)
    seen: dict[str, str] = {}
    return [seen.setdefault(w, w) for part in longtext.stretches(text) for w in words_of(part)]


def units_of(words: list[str]) -> list[Counter]:
    """An item's words cut into units of like size; items of few words have none."""
    n = math.ceil(len(words) / UNIT) if len(words) >= SHINGLE else 0
    return [Counter(words[k * len(words) // n : (k + 1) * len(words) // n]) for k in range(n)]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence with a word is the answer; of a single sentence, the last half."""
    parts = [w for w in map(words_of, re.split(r"(?<=[.!?])\s+", text)) if w]
    if len(parts) < 2:
        words = parts[0] if parts else []
        return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(words: list[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    """All runs of ``k`` words; of fewer words, the one run."""
    if len(words) <= k:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(k)]))  # noqa: B905  cut to the shortest


@dataclass
class Item:
    item_id: object
    size: int
    question: list[str]
    answer: list[str]

    def overlap(self, words: list[str]) -> tuple[float, float]:
        """Shares of the question's and the answer's shingles among ``words``; an empty part counts as found."""
        shares = []
        for part in (self.question, self.answer):
            own = shingles(part)
            k = min(SHINGLE, len(part))
            shares.append(len(own & shingles(words, k)) / len(own) if own and len(words) >= k else float(not own))
        return shares[0], shares[1]


class Tier:
    """Postings of some units: by term, units in rising order, impacts, each block's last unit and largest impact."""

    def __init__(self, lists: dict[int, list[tuple[int, float]]], terms: int) -> None:
        self.units = {t: [u for u, _ in x] for t, x in lists.items()}
        self.impacts = {t: [w for _, w in x] for t, x in lists.items()}
        self.block_last = {t: [x[min(k + BLOCK, len(x)) - 1] for k in range(0, len(x), BLOCK)] for t, x in self.units.items()}
        self.block_max = {t: [max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for t, x in self.impacts.items()}
        self.most = np.zeros(terms + 1, np.float32)  # at the end, that of a word that no item has
        for t, x in self.impacts.items():
            self.most[t] = max(x)

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """(unit, score) of all units that reach the threshold, for a passage's distinct terms."""
        eps = threshold - 1e-6
        cursors = [[self.units[t][0], t, 0] for t in terms if t in self.units]  # unit that it stands at, term, place in the list
        found: list[tuple[int, float]] = []
        most = self.most
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, t, _) in enumerate(cursors):
                bound += most[t]
                if bound >= eps:
                    pivot = i
                    break
            if pivot < 0:
                break
            unit = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
                pivot += 1
            # the blocks that would hold the pivot's unit
            bound, skip_to = 1e-5, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
            for c in cursors[: pivot + 1]:
                lasts = self.block_last[c[1]]
                b = c[2] // BLOCK
                while b < len(lasts) and lasts[b] < unit:
                    b += 1
                if b < len(lasts):
                    bound += self.block_max[c[1]][b]
                    skip_to = min(skip_to, lasts[b] + 1)
            if bound < eps:
                self._advance(cursors, range(pivot + 1), max(skip_to, unit + 1))
            elif cursors[0][0] == unit:
                score = sum(self.impacts[c[1]][c[2]] for c in cursors[: pivot + 1])
                if score >= eps:
                    found.append((unit, score))
                self._advance(cursors, range(pivot + 1), unit + 1)
            else:
                self._advance(cursors, (i for i in range(pivot + 1) if cursors[i][0] < unit), unit)
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def _advance(self, cursors: list[list[int]], which, unit: int) -> None:
        """Move cursors to the first posting at or after ``unit``, whole blocks at a time; at its list's end one gets -1."""
        for i in which:
            c = cursors[i]
            units, lasts = self.units[c[1]], self.block_last[c[1]]
            b = c[2] // BLOCK
            while b < len(lasts) and lasts[b] < unit:
                b += 1
            at = max(c[2], b * BLOCK)
            while at < len(units) and units[at] < unit:
                at += 1
            c[0], c[2] = (units[at], at) if at < len(units) else (-1, at)


class Index:
    """Units in tiers of similar length, as a short unit's impacts are large and would loosen all bounds."""

    def __init__(self, items: list[tuple[object, str]], whole: tuple[dict[str, int], int, float] | None = None) -> None:
        """whole: of all items, in how many units each term is, the number of units and their mean length; else these items are all."""
        self.items: list[Item] = []
        self.unit_item: list[int] = []
        self.short: dict[tuple[str, ...], list[object]] = {}
        counts: list[Counter] = []
        for item_id, text in items:
            words = words_of(text or "")
            if len(words) < SHINGLE:
                if len(words) > 1:
                    self.short.setdefault(tuple(words), []).append(item_id)
                continue
            own = units_of(words)
            counts += own
            self.unit_item += [len(self.items)] * len(own)
            self.items.append(Item(item_id, len(words), *question_and_answer(text)))
        df = Counter(t for c in counts for t in c)
        total = len(counts)
        known, every, mean = whole or (df, total, sum(sum(c.values()) for c in counts) / max(1, total))
        idf = {t: math.log(1 + (every - known[t] + 0.5) / (known[t] + 0.5)) for t in df}
        self.term: dict[str, int] = {t: i for i, t in enumerate(df)}
        by_size = sorted(range(total), key=lambda u: (sum(counts[u].values()), u))
        self.tiers: list[Tier] = []
        for k in range(TIERS):
            lists: dict[int, list[tuple[int, float]]] = {}
            for u in sorted(by_size[k * total // TIERS : (k + 1) * total // TIERS]):
                c = counts[u]
                norm = K1 * (1 - B + B * sum(c.values()) / mean)
                weight = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in c.items()}
                own = sum(weight.values())
                for t, w in weight.items():
                    lists.setdefault(self.term[t], []).append((u, w / own))
            if lists:
                self.tiers.append(Tier(lists, len(df)))
        self.most = np.stack([t.most for t in self.tiers], 1) if self.tiers else np.zeros((1, 0), np.float32)


def find_short(index: Index, words: list[str]) -> list[tuple[object, float, float, float]]:
    """The items of fewer than ``SHINGLE`` words whose words, question and then answer, stand side by side."""
    found: set[tuple[str, ...]] = set()
    for k in sorted({len(x) for x in index.short}):
        found.update(x for x in zip(*[islice(words, i, None) for i in range(k)]) if x in index.short)  # noqa: B905  cut to the shortest
    return [(item_id, 1.0, 1.0, 1.0) for x in sorted(found) for item_id in index.short[x]]


def find(index: Index, text: str) -> list[tuple[object, float, float, float]]:
    """(item_id, score, question's overlap, answer's overlap) of every verified item, each once."""
    words = all_words(text)
    short = find_short(index, words) if index.short else []
    if not words or not index.items:
        return short
    bound = THRESHOLD - 1e-5  # the table is in single precision
    hits: dict[int, float] = {}
    where: dict[int, list[int]] = {}
    every = np.arange(0, max(1, len(words) - (PASSAGE - STRIDE)), STRIDE)
    for k in range(0, len(every), PASSAGES):  # a very long text a stretch of passages at a time
        starts = every[k : k + PASSAGES]
        base, stretch = int(starts[0]), words[int(starts[0]) : int(starts[-1]) + PASSAGE]
        ids = np.fromiter(map(index.term.get, stretch, [-1] * len(stretch)), np.int64, len(stretch))
        known = np.nonzero(ids >= 0)[0]
        sums = np.zeros((len(known) + 1, len(index.tiers)))
        np.cumsum(index.most[ids[known]], axis=0, out=sums[1:])
        first, last = np.searchsorted(known, starts - base), np.searchsorted(known, starts - base + PASSAGE)
        for n in np.nonzero((sums[last] - sums[first] >= bound).any(1))[0].tolist():
            terms = np.array(sorted(set(ids[known[first[n] : last[n]]].tolist())), np.int64)
            for tier in np.nonzero(index.most[terms].sum(0) >= bound)[0].tolist():
                for unit, score in index.tiers[tier].search(terms.tolist()):
                    i = index.unit_item[unit]
                    hits[i] = max(hits.get(i, 0.0), score)
                    where.setdefault(i, []).append(int(starts[n]))
    out = short
    for i, score in sorted(hits.items()):
        item = index.items[i]
        q, a = max((item.overlap(words[max(0, at - item.size) : at + PASSAGE + item.size]) for at in where[i]), key=min)
        if q >= OVERLAP and a >= OVERLAP:
            out.append((item.item_id, score, q, a))
    return out


def terms_of(items: DataFrame) -> DataFrame:
    """(shard, term, n, size) of ``items`` (t, shard): in how many units each term is; under the null term, the units and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            sizes: Counter = Counter()
            for text, shard in zip(texts_of(batch, 0), batch.column(1).to_pylist(), strict=True):
                for unit in units_of(all_words(text)):
                    found.update((shard, t) for t in unit)
                    found[shard, None] += 1
                    sizes[shard, None] += sum(unit.values())
            rows = [(*k, n, sizes[k]) for k, n in found.items()]
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ((),) * 4, kinds, strict=True)], names=["shard", "term", "n", "size"])

    bounded_batches(items.sparkSession)
    return items.select("t", "shard").mapInArrow(run, "shard int, term string, n long, size long").groupBy("shard", "term").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))


def shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The index of ``items``, in as many shards as their rows and bytes need, one after the other."""
    rows, size = items.agg(F.count("*"), F.sum(F.octet_length(text_col))).first()
    n = max(math.ceil(rows / SHARD_ITEMS), math.ceil((size or 0) / SHARD_BYTES), 1)
    of = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(n)).cast("int")
    keyed = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), of.alias("shard")).distinct()
    terms = whole = None
    if n > 1:
        terms = checkpointed(terms_of(keyed))
        whole = checkpointed(terms.groupBy("term").agg(F.sum("n").alias("n"), F.sum("size").alias("size")))
    for k in range(n):
        about = None
        if terms is not None:
            total, words = whole.where("term IS NULL").select("n", "size").first() or (0, 0)
            own = whole.join(terms.where(F.col("shard") == k).select("term"), "term").select("term", "n").toArrow()  # terms of one shard
            about = dict(zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True)), total, words / max(1, total)
        yield Index(sorted(((r.i, r.t) for r in keyed.where(F.col("shard") == k).collect()), key=lambda x: (str(x[0]), x[1] or "")), about)


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, item_id, score, question_overlap, answer_overlap: a row for each item found in each row of ``df``."""
    kind = items.schema["item_id"].dataType.simpleString()
    hit = f"hits array<struct<item_id:{kind},score:double,question_overlap:double,answer_overlap:double>>"
    names = ("item_id", "score", "question_overlap", "answer_overlap")
    out = None
    for index in shards(items):
        shared = df.sparkSession.sparkContext.broadcast(index)  # bounded by SHARD_ITEMS and SHARD_BYTES

        def make(shared=shared) -> Callable[[list[str]], list]:
            return lambda texts: [[[dict(zip(names, h, strict=True)) for h in find(shared.value, t)] for t in texts]]

        part = map_texts(df, make, hit, id_col, text_col).select(id_col, F.inline("hits"))
        out = part if out is None else out.unionByName(part)
    return out


def clean(df: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that hold no item; all columns as they are."""
    for index in shards(items):
        shared = df.sparkSession.sparkContext.broadcast(index)

        def make(shared=shared) -> Callable[[list[str]], list]:
            return lambda texts: [[bool(find(shared.value, t)) for t in texts]]

        df = df.where(~text_column(make, "boolean")(F.col(text_col)))
    return df
