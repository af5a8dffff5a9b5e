"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints within ``DISTANCE`` = 3 bits differ by at most one bit in one of
their two 32-bit halves. On each half, anchors are the words of a covering code:
the perfect Hamming code of length 31, times one free bit, whose covering radius
is one. A half's home anchor is the one within that radius; it is replicated to
all anchors within covering radius plus threshold, 1 + 1 = 2, which are at most
17. So two linked fingerprints meet at the home anchor of either, and nothing
is missed. At each anchor, the homes are compared with the members by XOR and
bit count.

Copies share a fingerprint and are one node. What leaves an anchor is a forest
of its links, not all of its pairs. An anchor that is home to many fingerprints,
or has many members, is dealt out as blocks of homes times blocks of members,
each compared by a task of its own, so none is gathered in one place and none is
cut off.

Null and empty texts have fingerprint zero, linked like any other; very long ones
are read whole, stretch by stretch. Rows with a null id get a fingerprint and
their fingerprint's component, but are never its representative; the component
is null if no row with an id can be reached. A bit that is set in just half of
the shingles is zero. Repeated rows give repeated results, an empty table an
empty one. Columns of other names are not read.

To keep one document of each group of near-copies, by the similarity of sets of
five-word runs, ``keep_one`` searches with wider fingerprints: ``WIDE`` of 64 bits,
of two-word runs, as an edited word changes fewer of those. Cut in blocks of 32
bits, two that differ by at most two bits in any block share an anchor within
distance two of both, as the word half-way between them has its home there. So
each is replicated to the anchors within two, and members of an anchor are
candidates if all of their bits differ in ``WIDE_DISTANCE`` at most. What is
dropped is decided by the texts themselves, in ``leaders``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import leaders, longtext
from marlstone.llm._common import bounded_batches, checkpointed, map_texts
from marlstone.llm.components import connected_components

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: The search for near-copies: seeds of its fingerprints, words in a run, and bits that may differ in all.
WIDE = (42, 43)
WIDE_SHINGLE = 2
WIDE_DISTANCE = 28
#: Homes of one anchor that one task compares, and pairs that are compared at once.
BLOCK = 2048
CELLS = 1 << 19
#: Members of one anchor that one task compares with its homes.
MEMBERS = 1 << 16
#: Members of a hot anchor's block in the search for near-copies, and the share of fingerprints that hot anchors are told by.
WIDE_BLOCK = 8192
SAMPLED = 16
#: Up to so many members of an anchor are compared step by step, for all anchors of a batch at once.
FEW = 32
#: Up to this many hot anchors their table is broadcast (16 bytes each).
BROADCAST_HOT = 50_000


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number; ``bytes`` split and lower-case at ASCII only, as wanted here."""
    set_bits, n, held = np.zeros(64, np.int64), 0, []
    for part in longtext.stretches(text):
        # the last words of what came before are the first of this part's shingles
        held = held[len(held) - shingle + 1 :] if len(held) >= shingle else held
        held = held + part.encode("utf-8", "surrogatepass").lower().split()
        if len(held) >= shingle:
            h = _shingle_hashes(held, shingle, seed)
            n += len(h)
            for k in range(0, len(h), 1 << 15):
                some = h[k : k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
                set_bits += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(held), seed) if held else 0
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def _shingle_hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.zeros(len(words), np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    stops = (starts + lengths)[shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist())], np.uint64)  # noqa: B905  the last starts have no shingle


def _fingerprinter() -> Callable[[list[str]], list]:
    return lambda texts: [np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and fp, the fingerprint's bits as a signed long."""
    return map_texts(df, _fingerprinter, "fp long", id_col, text_col)


def _syndrome(half: Column) -> Column:
    """Which of the low 31 bits to flip for a codeword, from 1; 0: none."""
    syndrome = F.lit(0).cast("int")
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        syndrome = syndrome + F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))).bitwiseAND(F.lit(1)) * (1 << k)
    return syndrome


def anchors(fps: DataFrame, words: tuple[str, ...] = ("fp",)) -> DataFrame:
    """(words, rep, half, home, more): for each half of each fingerprint, its home anchor, and the other anchors within distance two of it."""
    halves = F.array(
        *[
            F.struct(F.lit(2 * i + k).alias("half"), (F.shiftrightunsigned(w, 32) if k else F.col(w).bitwiseAND(F.lit(0xFFFFFFFF))).alias("x"))
            for i, w in enumerate(words)
            for k in (0, 1)
        ]
    )
    split = fps.select(*words, "rep", F.explode(halves).alias("h")).select(*words, "rep", F.col("h.half").alias("half"), F.col("h.x").alias("x"))
    syndrome = _syndrome(F.col("x"))
    step = split.withColumn("s", syndrome)
    step = step.withColumn("home", F.col("x").bitwiseXOR(F.expr("if(s > 0, shiftleft(1L, s - 1), 0L)")))
    # at distance two: two flips i < j with i xor j = s, or the one flip s and the free bit
    pairs = F.expr("transform(filter(sequence(1, 31), i -> s > 0 and i < (i ^ s) and (i ^ s) <= 31), i -> x ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))")
    free = F.expr("array(home ^ shiftleft(1L, 31))")
    return step.select(*words, "rep", "half", "home", F.concat(pairs, free).alias("more"))


def _flips() -> np.ndarray:
    """By syndrome, what to flip in a half for each of its anchors, the home first; a codeword has two, the rest of its row repeat the home."""
    out = np.zeros((32, 17), np.int64)
    for s in range(32):
        home = 1 << (s - 1) if s else 0
        pairs = [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i < i ^ s <= 31] if s else [home] * 15
        out[s] = [home, home | 1 << 31, *pairs]
    return out


FLIPS = _flips()
#: Syndromes of the four bytes of a half, each over all its values.
BYTE_SYNDROMES = np.array([[reduce(int.__xor__, (8 * k + b + 1 for b in range(8) if v >> b & 1 and 8 * k + b < 31), 0) for v in range(256)] for k in range(4)], np.int64)


def _met_before(key: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether both of each pair of fingerprints are members of an anchor before ``key`` too, in the order of keys."""
    half, anchor = key >> 32 & 0xFF, key & 0xFFFFFFFF
    out = np.zeros(len(key), bool)
    for h in range(2 * len(a)):
        x, y = ((w[h // 2] >> 32 * (h % 2)) & 0xFFFFFFFF for w in (a, b))
        syndrome = reduce(np.bitwise_xor, (BYTE_SYNDROMES[k][x >> 8 * k & 0xFF] for k in range(4)))
        own = x[:, None] ^ FLIPS[syndrome]
        # a codeword within distance two of the other is an anchor of it
        before = (h < half)[:, None] | ((h == half)[:, None] & (own < anchor[:, None]))
        out |= (before & (np.bitwise_count(own ^ y[:, None]) <= 2)).any(1)
    return out


def _apart(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Bits in which fingerprints differ, word by word summed; of a signed number, numpy counts the absolute value's bits."""
    return sum(np.bitwise_count((x ^ y).view(np.uint64)) for x, y in zip(a, b, strict=True))


def _forest(homes: list[np.ndarray], home_reps: np.ndarray, fps: list[np.ndarray], reps: np.ndarray, label: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A forest that joins what links between homes and members; label: the homes' running component, changed in place."""
    out = []
    step = max(1, CELLS // max(1, len(home_reps)))
    for k in range(0, len(reps), step):
        near = _apart([x[:, None] for x in homes], [x[None, k : k + step] for x in fps]) <= most
        rows, cols = np.nonzero(near)
        if not len(rows):
            continue
        keep = home_reps[rows] != reps[k + cols]
        rows, cols = rows[keep], cols[keep]
        if not len(rows):
            continue
        member = np.full(near.shape[1], len(home_reps), np.int64)
        while True:  # both sides take the least label that they reach
            np.minimum.at(member, cols, label[rows])
            least = label.copy()
            np.minimum.at(least, rows, member[cols])
            least = np.minimum(least, least[least])
            if (least == label).all():
                break
            # a home that moves to another label is linked to it through the member
            moved = np.nonzero(least != label)[0]
            out.append((home_reps[moved], home_reps[least[moved]]))
            label[:] = least
        hit = member < len(home_reps)
        out.append((reps[k : k + step][hit], home_reps[member[hit]]))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches are sorted by (key, salt, member): of each group the homes come first, and are held; members stream by."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    group: tuple[int, int] | None = None
    homes: list[tuple[np.ndarray, np.ndarray]] = []
    held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def made(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if found:
            u, v = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(u := u[apart := u != v]):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v[apart])], schema=schema)

    for batch in batches:
        key, salt, member, fp, rep = (batch.column(i).to_numpy() for i in range(5))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        starts = np.nonzero(new)[0]
        stops = np.append(starts[1:], len(key))
        # a group inside the batch with a single row, or without a home or a member, has no link
        sizes = stops - starts
        found: list[tuple[np.ndarray, np.ndarray]] = []
        first, last = 0, len(starts) - 1
        for g in range(len(starts)):
            if first < g < last and (sizes[g] < 2 or member[starts[g]]):
                continue
            a, b = starts[g], stops[g]
            now = (key[a], salt[a])
            if now != group:
                group, homes, held = now, [], None
            m = member[a:b]
            n_home = int((m == 0).sum())
            if n_home:
                homes.append((fp[a : a + n_home], rep[a : a + n_home]))
                held = None
            if n_home < b - a and homes:
                if held is None:
                    own = np.concatenate([x for x, _ in homes]), np.concatenate([x for _, x in homes])
                    held = (*own, np.arange(len(own[0])))
                found += _forest([held[0]], held[1], [fp[a + n_home : b]], rep[a + n_home : b], held[2], DISTANCE)
        yield from made(found)


def links(fps: DataFrame) -> DataFrame:
    """(u, v): links between representatives that join whatever is within ``DISTANCE``; ``fps`` has one row per fingerprint (fp, rep)."""
    spark = fps.sparkSession
    near = anchors(fps)
    key = lambda half, anchor: F.shiftleft(half.cast("long"), 32).bitwiseOR(anchor)
    met = lambda of: of.select("half", F.explode(F.concat(F.array("home"), F.col("more"))).alias("anchor"), "fp", "rep").select(key(F.col("half"), F.col("anchor")).alias("key"), "fp", "rep")
    homes, members = near.select(key(F.col("half"), F.col("home")).alias("key"), "fp", "rep"), met(near)
    # an anchor of many homes or members is dealt out as blocks of either; members are estimated, as that changes who compares what, but not what is found
    many_homes = homes.groupBy("key").count().where(F.col("count") > BLOCK).select(F.col("key").alias("hot"), F.ceil(F.col("count") / BLOCK).cast("int").alias("h"), F.lit(1).alias("m"))
    some = met(anchors(fps.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0))).groupBy("key").count().withColumn("count", F.col("count") * SAMPLED)
    many_members = some.where(F.col("count") > MEMBERS).select(F.col("key").alias("hot"), F.lit(1).alias("h"), F.ceil(F.col("count") / MEMBERS).cast("int").alias("m"))
    hot = checkpointed(many_homes.unionByName(many_members).groupBy("hot").agg(F.max("h").alias("h"), F.max("m").alias("m")))
    n_hot = hot.count()
    if n_hot:
        table = F.broadcast(hot) if n_hot <= BROADCAST_HOT else hot
        own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")

        def dealt(df: DataFrame, others: str, salt: Callable[[Column], Column]) -> DataFrame:
            joined = df.join(table, F.col("key") == F.col("hot"), "left")
            salts = F.transform(F.sequence(F.lit(0), F.col(others) - 1), salt)
            return joined.select("key", "fp", "rep", F.explode(F.when(F.col("h").isNull(), F.array(F.lit(0))).otherwise(salts)).alias("salt"))

        homes, members = dealt(homes, "m", lambda b: own("h") * F.col("m") + b), dealt(members, "h", lambda a: a * F.col("m") + own("m"))
    else:
        homes, members = homes.withColumn("salt", F.lit(0)), members.withColumn("salt", F.lit(0))
    cols = lambda df, member: df.select("key", "salt", F.lit(member).alias("member"), "fp", "rep")
    both = cols(homes, 0).unionByName(cols(members, 1))
    bounded_batches(spark)
    return both.repartition("key", "salt").sortWithinPartitions("key", "salt", "member").mapInArrow(_compare, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fingerprint (16 hex digits) and component_id of every row of ``df``."""
    rows = checkpointed(fingerprints(df, id_col, text_col))
    fps = checkpointed(rows.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("rep")))
    component = connected_components(links(fps))
    of_fp = fps.join(component, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(of_fp, "fp", "left").select(id_col, hexed.alias("fingerprint"), "component_id")


def _wide(text: str) -> list[int]:
    return [fingerprint(text, WIDE_SHINGLE, seed) for seed in WIDE]


def _wide_fingerprinter() -> Callable[[list[str]], list]:
    def run(texts: list[str]) -> list:
        made = np.array([_wide(t) for t in texts], np.uint64).reshape(len(texts), len(WIDE)).view(np.int64)
        return [np.ascontiguousarray(made[:, i]) for i in range(len(WIDE))]

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches are sorted by (key, words): links that join what is near in each group.

    A link of i and j is left out where one before both is near both: it joins
    them then, by links of its own or of ones before it. It is left out, too,
    where both are members of an anchor before this one, which joins them. So a
    pair is told by one anchor, and not by each of the many that copies share.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def made(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, *fps = columns
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.nonzero(new)[0]
        sizes = np.diff(np.append(starts, len(key)))
        size, nth = np.repeat(sizes, sizes), np.arange(len(key)) - np.repeat(starts, sizes)
        found, pairs = [], []
        lower = np.zeros(len(key), np.uint64)  # which of the group's earlier ones are near, by their places
        for step in range(1, min(FEW, int(sizes.max(initial=0)))):
            i = np.nonzero((size <= FEW) & (nth + step < size))[0]
            i = i[_apart([x[i] for x in fps], [x[i + step] for x in fps]) <= WIDE_DISTANCE]
            lower[i + step] |= np.uint64(1) << nth[i].astype(np.uint64)
            pairs.append((i, i + step))
        for i, j in pairs:
            new_ = (lower[i] & lower[j]) == 0
            found.append((i[new_], j[new_]))
        for a, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            own, at = [x[a : a + n] for x in fps], np.arange(a, a + n)
            found += _forest(own, at, own, at, np.arange(n), WIDE_DISTANCE)
        if found:
            i, j = np.sort([np.concatenate(x) for x in zip(*found, strict=True)], axis=0)
            i, j = np.divmod(np.unique((i * len(key) + j)[i < j]), len(key))
            a, b = [x[i] for x in fps], [x[j] for x in fps]
            first = (_apart(a, b) > WIDE_DISTANCE) | ~_met_before(key[i], a, b)  # what is joined through a third may be apart there
            i, j = i[first], j[first]
            if len(i):
                rep = np.bitwise_xor.reduce(fps)
                yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], schema=schema)

    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [x.to_numpy() for x in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        last = columns[0] == columns[0][-1]
        cut = len(last) - int(last.sum())
        held = [x[cut:] for x in columns]  # the last group may go on
        yield from made([x[:cut] for x in columns])
    if held is not None:
        yield from made(held)


def node_of(words: list[str]) -> Column:
    """A fingerprint's number. Two that share one differ in the same bits of several words, so they are near, and a group may hold both."""
    return reduce(Column.bitwiseXOR, map(F.col, words))


def wide_links(fps: DataFrame) -> DataFrame:
    """(u, v): links between the numbers of wide fingerprints that share an anchor and are near; ``fps`` has one row per fingerprint (f0, f1, ...).

    A pair may be told again by blocks of a hot anchor.
    """
    words = [f"f{i}" for i in range(len(WIDE))]
    key = F.shiftleft(F.col("half").cast("long"), 32).bitwiseOR(F.col("anchor"))

    def met(of: DataFrame) -> DataFrame:
        near = anchors(of.withColumn("rep", F.lit(0)), tuple(words))
        return near.select("half", F.explode(F.concat(F.array("home"), F.col("more"))).alias("anchor"), *words).select(key.alias("key"), *words)

    # which anchors are dealt out is estimated, as it changes who compares what, but not what is found
    some = met(fps.where(F.pmod(F.xxhash64(*words), F.lit(SAMPLED)) == 0)).groupBy("key").count().where(F.col("count") * SAMPLED > WIDE_BLOCK)
    hot = checkpointed(some.select(F.col("key").alias("hot"), F.ceil(F.col("count") * SAMPLED / WIDE_BLOCK).cast("int").alias("blocks")))
    n_hot = hot.count()
    rows = met(fps.repartition(2 * fps.sparkSession.sparkContext.defaultParallelism))  # each row becomes some seventy
    if n_hot:  # a hot anchor's members are dealt out as pairs of blocks
        joined = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_HOT else hot, F.col("key") == F.col("hot"), "left")
        own = F.pmod(F.xxhash64(*words), F.col("blocks")).cast("long")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, own) * F.col("blocks") + F.greatest(x, own))
        salted = joined.withColumn("salt", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)))
        rows = salted.select(F.shiftleft("salt", 40).bitwiseOR(F.col("key")).alias("key"), *words)
    bounded_batches(fps.sparkSession)
    return rows.repartition("key").sortWithinPartitions("key", *words).mapInArrow(_meet, "u long, v long")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near-copies of rows that stay; all columns as they are.

    Of rows with the same text the one with the smallest id stays; null ids come
    last, and of rows that also share the id the first in order of their JSON.
    Of different texts each stays unless its set of five-word runs has a Jaccard
    similarity of 0.8 or more to that of one that stays already of its group of
    candidates, taken in the same order in groups of up to ``leaders.FIRST``. So
    what goes has a near-copy that stays, and no two that stay are near-copies
    that the search brought together.
    """
    words = [f"f{i}" for i in range(len(WIDE))]
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *leaders.identity(F.col(text_col)))
    made = map_texts(texts, _wide_fingerprinter, ", ".join(f"{w} long" for w in words), "id", "text", ("t1", "t2"))
    kinds = checkpointed(made.groupBy("t1", "t2").agg(F.count("*").alias("rows"), F.min("id").alias("id"), *[F.min(w).alias(w) for w in words]))
    fps = checkpointed(kinds.groupBy(*words).agg(F.count("*").alias("texts")))
    component = connected_components(wide_links(fps))
    of = fps.join(component, node_of(words) == F.col("node"), "left").select(*words, "texts", F.coalesce(F.col("component"), node_of(words)).alias("component"))
    sums = of.groupBy("component").agg(F.sum("texts").alias("texts"))
    several = checkpointed(of.drop("texts").join(sums.where("texts > 1").select("component"), "component"))
    rivals = checkpointed(kinds.join(several, words).select("t1", "t2", "id", "component"))
    alone = kinds.join(rivals.select("t1", "t2"), ["t1", "t2"], "left_anti").select("t1", "t2")
    staying = alone.unionByName(leaders.staying(rivals, texts)).withColumn("stays", F.lit(True))
    stay = kinds.join(staying, ["t1", "t2"]).select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("id").alias("_id"), F.col("rows").alias("_rows"))
    stay = checkpointed(stay)
    t1, t2 = leaders.identity(F.col(text_col))
    row = F.struct(*[F.col(c) for c in df.columns])
    keyed = df.select(row.alias("_row"), t1.alias("_t1"), t2.alias("_t2"), F.col(id_col).alias("_id"))
    joined = lambda of: keyed.join(of.select("_t1", "_t2", F.col("_id").alias("_least")).hint("shuffle_hash"), ["_t1", "_t2"]).where(F.col("_id").eqNullSafe(F.col("_least")))
    out = joined(stay.where("_rows = 1")).select("_row")
    if stay.where("_rows > 1").head(1):
        first = joined(stay.where("_rows > 1")).groupBy("_t1", "_t2").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
        out = out.unionByName(first.select("_row"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])
