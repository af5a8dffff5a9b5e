"""Which texts of a group stay, by the similarity of the texts themselves.

A text stays unless it is similar to one that stays already: the sets of their
runs of ``SHINGLE`` words have a Jaccard similarity of ``SIMILARITY`` or more. This is
worked out in rounds. Of each group some ``FIRST`` texts, all of a smaller one, are
decided against each other in one task, in the order of their ids; those that
stay are leaders, and all other texts of the group are held against them, in
parts of bounded bytes, each in a task of its own. Texts that are like none of
the leaders go on to the next round, where four times as many are decided, up to
``MOST``. Which texts of a large group are decided first is told by a hash, so no
group is sorted or gathered whole. Every round decides some texts of every group,
and none is cut off.

Words are lower-cased at A-Z and end at ASCII white space. A text of fewer words
is one run; two texts without a word are similar. Null texts read as empty, and
null ids come last.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import longtext
from marlstone.llm._common import bounded_batches, checkpointed

SHINGLE = 5
SIMILARITY = 0.8
#: Texts of a group that are decided in the first round, about, and the most in later ones.
FIRST, MOST = 32, 1024
#: Bytes of texts that one task holds against a group's leaders.
PART_BYTES = 16 << 20


def identity(text: Column) -> list[Column]:
    """(t1, t2): two independent 64-bit hashes of the text; null reads as empty."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit(7), whole).alias("t2")]


def runs(text: str) -> np.ndarray:
    """The sorted hashes of the text's distinct runs of words."""
    words = longtext.word_hashes(text, lower=True)
    return np.unique(longtext.tuples(words, min(SHINGLE, len(words))))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if not large:
        return True
    if small < SIMILARITY * large:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if small else 0
    return both >= SIMILARITY * (small + large - both)


def _first(table: pa.Table) -> pa.Table:
    """A group's first texts, in order: those that stay."""
    table = table.sort_by([("id_null", "ascending"), ("id", "ascending"), ("t1", "ascending"), ("t2", "ascending")])
    leaders: list[np.ndarray] = []
    stays = []
    for text in table.column("text").to_pylist():
        own = runs(text or "")
        stays.append(not any(similar(own, x) for x in leaders))
        if stays[-1]:
            leaders.append(own)
    return table.filter(pa.array(stays)).select(["t1", "t2", "component", "parts", "text"])


def _others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (component, part), leaders first: the texts that are like none of the leaders."""
    group, leaders = None, []
    for batch in batches:
        keep = []
        for i, (component, part, leads, text) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("component", "part", "leads", "text")], strict=True)):
            if (component, part) != group:
                group, leaders = (component, part), []
            own = runs(text or "")
            if leads:
                leaders.append(own)
            elif not any(similar(own, x) for x in leaders):
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int32())).select(["t1", "t2", "id", "component", "text"])


def staying(rivals: DataFrame, texts: DataFrame) -> DataFrame:
    """(t1, t2) of the texts that stay; rivals: (t1, t2, id, component), a row for each text; texts: (id, text, t1, t2)."""
    bounded_batches(rivals.sparkSession)
    # a text's rows are many where it has copies, so one row of each is picked before
    own = texts.join(rivals.hint("shuffle_hash").withColumnRenamed("id", "_id"), ["t1", "t2"]).where(F.col("id").eqNullSafe(F.col("_id")))
    left = checkpointed(own.groupBy("t1", "t2").agg(F.min("id").alias("id"), F.min("component").alias("component"), F.min("text").alias("text")))
    kind = left.schema["id"].dataType.simpleString()
    stays, most = [], FIRST
    for turn in count():
        bytes_ = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
        about = left.groupBy("component").agg((F.lit(float(most)) / F.count("*")).alias("share"), F.ceil((bytes_ + 1) / PART_BYTES).cast("int").alias("parts"))
        place = F.pmod(F.xxhash64("t1", F.lit(turn)), F.lit(1 << 40)) / float(1 << 40)
        dealt = checkpointed(left.join(about, "component").withColumn("first", place < F.col("share")))
        chosen = dealt.where("first").withColumn("id_null", F.col("id").isNull()).select("component", "parts", "t1", "t2", "id", "id_null", "text")
        decided = checkpointed(chosen.groupBy("component").applyInArrow(_first, "t1 long, t2 long, component long, parts int, text string"))
        stays.append(decided.select("t1", "t2"))
        others = dealt.where("not first")
        if not others.head(1):
            break
        columns = ["component", "part", "leads", "t1", "t2", "id", "text"]
        members = others.withColumns({"part": F.pmod(F.xxhash64("t1", "t2"), F.col("parts")).cast("int"), "leads": F.lit(False)})
        leaders = decided.withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "leads": F.lit(True), "id": F.lit(None).cast(kind)})
        met = members.select(columns).unionByName(leaders.select(columns)).repartition("component", "part").sortWithinPartitions("component", "part", F.desc("leads"))
        left = checkpointed(met.mapInArrow(_others, f"t1 long, t2 long, id {kind}, component long, text string"))
        most = min(4 * most, MOST)
    return reduce(DataFrame.unionByName, stays)
