"""Exact substring dedup by suffix arrays over shards.

What is removed are the bytes covered by a string of ``WIDTH`` bytes that
starts anywhere else too. Such strings are called windows here.

Sharding. Each window is assigned to the least hash of the ``GRAM``-byte strings
in it. Neighbouring windows with the same one form a segment, and segments with
the same one a bucket. Equal windows have equal hashes, so they are always in
one bucket, and each window is in one segment. A bucket with one segment that
holds its hash once has no repeated window and is dropped. In a bucket whose
segments are all the same bytes, every window is repeated. Of the others, the
distinct segments' bytes are fetched, once each, and buckets are packed in
shards of about ``SHARD_BYTES``.

Suffix arrays. A shard's suffixes are sorted by their first eight bytes, and
groups of equal ones refined by Larsson-Sadakane doubling in numpy, until they
are single or sorted to a window's width. Kasai's pass gives the common prefix of each
window with the one sorted before it: all segments step by step together, each
step keeping what the last one found, less one, if the successors of the two
are sorted alike. A window is repeated if it shares its width with a neighbour.

Buckets larger than a shard are split into blocks. Each block has its own
suffix array, and blocks are merged in pairs by binary search of one block's
windows among those of the other, every pair in a task of its own. As the pairs
grow with the square of the blocks, a bucket of more than ``MOST_BLOCKS`` is dealt
anew before: equal windows have the bucket's hash at the same distance from their
start, so its segments are cut by that distance into a few pieces, and all windows
of a piece share the bytes around the hash, whose own hash names a new bucket.
What is still too large then is cut into more pieces, up to one for each distance,
where the shared bytes are the window.

Spans depend on the text alone, so rows with the same text share them, and
null or repeated ids do no harm; of rows that repeat a text, each loses all of
it that windows cover. Null texts read as empty. Texts shorter than a window
keep all bytes; very long ones are hashed some ``BUFFER`` bytes at a time and lose
windows like any other. Windows that tie are all repeated: none is kept as the
first. An empty table gives an empty one. Columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm._common import bounded_batches, checkpointed, scratch, stored

WIDTH = 400
GRAM = 32
SHARD_BYTES = 1 << 20
MOST_PARTITIONS = 20_000
#: Blocks of a bucket that are merged in pairs; a larger one is cut into pieces, in turn into so many.
MOST_BLOCKS = 8
PIECES = (4, 32, WIDTH - GRAM + 1)
#: Bytes that windows are hashed over at once.
BUFFER = 1 << 20
SEGMENT_SCHEMA = "key long, s1 long, s2 long, t1 long, t2 long, ident string, start int, windows int, several boolean"
_LOW = np.uint64(0xFFFFFF)  # places in a buffer; the 40 bits above are compared
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BUFFER + 4 * WIDTH)
        base = 0x9E3779B97F4A7C15
        _POWERS[:] = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A mixed hash of the ``GRAM`` bytes at each position."""
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(raw) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours, by running minima forward and back within blocks of ``w``."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    forth = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    return np.minimum(back[: n - w + 1], forth[w - 1 : n])


def segments(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, windows, several) of the segments of texts laid end to end; ``ends``: where each text ends.

    several: the bucket's hash occurs more than once in the segment.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < WIDTH:
        return none, none, none, none.astype(bool)
    h = gram_hashes(raw)
    at = np.arange(len(h), dtype=np.uint64)
    span = WIDTH - GRAM + 1
    top = h & ~_LOW
    left = (sliding_min(top | at, span) & _LOW).astype(np.int64)
    right = (_LOW - (sliding_min(top | (_LOW - at), span) & _LOW)).astype(np.int64)
    n = len(left)
    text = np.searchsorted(ends, np.arange(n), side="right")
    ok = np.arange(n) + WIDTH <= ends[np.minimum(text, len(ends) - 1)]
    key = h[left]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    several = left != right
    several[1:] |= ~new[1:] & (left[1:] != left[:-1])
    keep = np.nonzero(ok)[0]
    if not len(keep):
        return none, none, none, none.astype(bool)
    new = new[keep]
    new[1:] |= keep[1:] != keep[:-1] + 1
    new[0] = True
    first = np.nonzero(new)[0]
    return key[keep[first]].view(np.int64), keep[first], np.diff(np.append(first, len(keep))), np.logical_or.reduceat(several[keep], first)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the batches' texts (t1, t2, ident, text)."""

    def of(raws: list[bytes], rows: list[int], bases: list[int], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        joined = b"".join(raws)
        ends = np.cumsum([len(r) for r in raws])
        key, start, windows, several = segments(np.frombuffer(joined, np.uint8), ends)
        if not len(key):
            return
        digest = xxhash.xxh3_128_digest
        hashed = b"".join(digest(joined[a : a + w + WIDTH - 1]) for a, w in zip(start.tolist(), windows.tolist(), strict=True))
        s = np.frombuffer(hashed, np.int64).reshape(-1, 2)
        part = np.searchsorted(ends, start, side="right")
        row = np.array(rows)[part]
        own = start - (ends - np.array([len(r) for r in raws]))[part] + np.array(bases)[part]
        take = pa.array(row)
        columns = [pa.array(key), pa.array(s[:, 0]), pa.array(s[:, 1]), *[batch.column(i).take(take) for i in range(3)], pa.array(own.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(several)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "s1", "s2", "t1", "t2", "ident", "start", "windows", "several"])

    for batch in batches:
        raws: list[bytes] = []
        rows: list[int] = []
        bases: list[int] = []
        held = 0
        for i, text in enumerate(batch.column(3).to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for base in range(0, max(1, len(raw) - WIDTH + 1), BUFFER):  # a longer text in parts that have all windows between them
                part = raw[base : base + BUFFER + WIDTH - 1]
                if len(part) >= WIDTH:
                    raws.append(part)
                    rows.append(i)
                    bases.append(base)
                    held += len(part)
                if held >= BUFFER:
                    yield from of(raws, rows, bases, batch)
                    raws, rows, bases, held = [], [], [], 0
        if raws:
            yield from of(raws, rows, bases, batch)


class SuffixArray:
    """The sorted windows of some segments, each of at least ``WIDTH`` bytes."""

    def __init__(self, parts: list[bytes]) -> None:
        sizes = np.array([len(p) for p in parts], np.int64)
        self.text = np.frombuffer(b"".join(parts) + bytes(WIDTH + 8), np.uint8)
        self.n = n = len(self.text) - WIDTH - 8
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        # the eight bytes at each position, as one number in sorting order
        self.eight = np.zeros(n + WIDTH, np.uint64)
        for k in range(8):
            self.eight |= self.text[k : k + n + WIDTH].astype(np.uint64) << np.uint64(56 - 8 * k)
        self.valid = np.zeros(n, bool)
        for a, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            self.valid[a : e - WIDTH + 1] = True
        self._sort()

    def _sort(self) -> None:
        """Larsson-Sadakane: rank holds the last place of a suffix's group; groups that are single stay."""
        n = self.n
        sa = np.argsort(self.eight[:n], kind="stable")
        value = self.eight[sa]
        rank = np.zeros(n + WIDTH, np.int64)  # beyond the end: zero, least
        h = 8
        last = np.append(value[1:] != value[:-1], True)
        place = np.arange(n)
        group = np.minimum.accumulate(np.where(last, place, n)[::-1])[::-1]
        rank[sa] = group + 1
        open_ = np.nonzero(~(last & np.append(True, last[:-1])))[0]
        while h < WIDTH and len(open_):
            s = sa[open_]
            major, minor = rank[s], rank[np.minimum(s + h, n + WIDTH - 1)]
            order = np.argsort(major * (n + 2) + minor, kind="stable")
            s, major, minor = s[order], major[order], minor[order]
            sa[open_] = s
            last = np.append((major[1:] != major[:-1]) | (minor[1:] != minor[:-1]), True)
            end = np.minimum.accumulate(np.where(last, open_, n)[::-1])[::-1]
            rank[s] = end + 1
            open_ = open_[~(last & np.append(True, last[:-1]))]
            h *= 2
        self.windows = sa[self.valid[sa]]
        # windows of one group are equal, so its first is searched for and among, in place of all
        self.first = np.append(True, np.diff(rank[self.windows]) != 0)[: len(self.windows)]

    def repeated(self) -> np.ndarray:
        """Of every position: does a window start there that another position of these segments has too?"""
        out = np.zeros(self.n, bool)
        w = self.windows
        if len(w) < 2:
            return out
        before = np.full(self.n, -1, np.int64)
        before[w[1:]] = w[:-1]
        place = np.full(self.n, self.n, np.int64)
        place[w] = np.arange(len(w))
        common = np.zeros(self.n, np.int64)
        # Kasai's pass, all stretches of windows in step; a carried length holds only if the earlier neighbour's successor is a window too,
        # and is sorted before this one's: where two tie on all that is sorted by, it need not be
        starts, counts = _stretches(self.starts, self.ends - self.starts - WIDTH + 1)
        carry = np.zeros(len(starts), np.int64)
        for t in range(int(counts[0])):
            live = int(np.searchsorted(-counts, -t, side="left"))
            i = starts[:live] + t
            j = before[i]
            has = np.nonzero(j >= 0)[0]
            found = carry[:live].copy()
            found[j < 0] = 0
            rows = has[found[has] < WIDTH]
            while len(rows):
                d = self.eight[i[rows] + found[rows]] ^ self.eight[j[rows] + found[rows]]
                equal = d == 0
                found[rows] += np.where(equal, 8, _leading(d))
                rows = rows[equal]
                rows = rows[found[rows] < WIDTH]
            found = np.minimum(found, WIDTH)
            common[i] = found
            after = np.minimum(np.maximum(j, 0) + 1, self.n - 1)
            follow = (j >= 0) & self.valid[after] & (place[after] < place[np.minimum(i + 1, self.n - 1)])
            carry[:live] = np.where(follow, np.maximum(found - 1, 0), 0)
        same = common[w[1:]] >= WIDTH
        out[w[1:][same]] = True
        out[w[:-1][same]] = True
        return out

    def found_in(self, other: SuffixArray) -> np.ndarray:
        """Of every position: does a window start there that ``other`` has? By binary search of all windows at once."""
        out = np.zeros(self.n, bool)
        w, o = self.windows[self.first], other.windows[other.first]
        if not len(w) or not len(o):
            return out
        low, high = np.zeros(len(w), np.int64), np.full(len(w), len(o), np.int64)
        # what a window has in common with those at both bounds, it has with all between them
        below, above = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        while (act := np.nonzero(low < high)[0]).size:
            mid = (low[act] + high[act]) // 2
            common, greater = self._compare(w[act], other, o[mid], np.minimum(below[act], above[act]))
            up, down = act[greater], act[~greater]
            low[up], below[up] = mid[greater] + 1, common[greater]
            high[down], above[down] = mid[~greater], common[~greater]
        out[self.windows[(above >= WIDTH)[np.cumsum(self.first) - 1]]] = True
        return out

    def _compare(self, mine: np.ndarray, other: SuffixArray, theirs: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(common bytes by eights, whether mine is greater) of windows whose first ``common`` bytes are known to be equal."""
        common, greater = common.copy(), np.zeros(len(mine), bool)
        rows = np.nonzero(common < WIDTH)[0]
        while len(rows):
            a, b = self.eight[mine[rows] + common[rows]], other.eight[theirs[rows] + common[rows]]
            greater[rows] = a > b
            rows = rows[a == b]
            common[rows] += 8
            rows = rows[common[rows] < WIDTH]
        return common, greater


def _stretches(starts: np.ndarray, counts: np.ndarray, most: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(start, windows) of segments cut into stretches of at most so many windows, the longest first."""
    pieces = -(-counts // most)
    owner = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(counts[owner] - nth * most, most)
    order = np.argsort(-size, kind="stable")
    return (starts[owner] + nth * most)[order], size[order]


def _leading(d: np.ndarray) -> np.ndarray:
    """Whole zero bytes at the top of each number that is not zero."""
    out = np.zeros(len(d), np.int64)
    for size in (4, 2, 1):
        small = d < np.uint64(1 << (64 - 8 * size))
        out += size * small
        d = np.where(small, d << np.uint64(8 * size), d)
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True))


def _solve(table: pa.Table) -> pa.Table:
    """One shard, or one pair of blocks: the runs of repeated windows of each distinct segment."""
    seen: dict[tuple[int, int, int], tuple[int, bytes]] = {}
    for k, a, b, block, raw in zip(*[table.column(c).to_pylist() for c in ("key", "s1", "s2", "block", "raw")], strict=True):
        seen.setdefault((k, a, b), (block, raw))
    names = list(seen)
    blocks = sorted({x for x, _ in seen.values()})
    arrays = {x: (own := [n for n in names if seen[n][0] == x], SuffixArray([seen[n][1] for n in own])) for x in blocks}
    pair = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    out: dict[str, list] = {"key": [], "s1": [], "s2": [], "a": [], "b": []}
    for x, (own, array) in arrays.items():
        if pair:
            flags = np.zeros(array.n, bool)
            for y, (_, other) in arrays.items():
                if y != x:
                    flags |= array.found_in(other)
        else:
            flags = array.repeated()
        for name, s, e in zip(own, array.starts.tolist(), array.ends.tolist(), strict=True):
            for a, b in _runs(flags[s:e]):
                for c, v in zip(out, (*name, a, b), strict=True):
                    out[c].append(v)
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2
    return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments wanted (text, wanted) with what they are dealt by."""
    for batch in batches:
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            made = {c: [w[c] for w in wanted] for c in ("key", "s1", "s2", "shard", "block", "i", "j")}
            kinds = [pa.int64()] * 4 + [pa.int32()] * 3
            columns = [pa.array(v, k) for v, k in zip(made.values(), kinds, strict=True)]
            columns.append(pa.array([raw[w["start"] : w["start"] + w["windows"] + WIDTH - 1] for w in wanted], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[*made, "raw"])


def pieces_of(raw: bytes, key: int, at: int, pieces: int) -> Iterator[tuple[int, int, int, int]]:
    """(place, windows, place of the hash, bucket) of the pieces of a segment; ``at``: place of its hash, -1 where it is to be looked for."""
    span = WIDTH - GRAM + 1
    starts = np.arange(len(raw) - WIDTH + 1)
    if at >= 0:
        least = np.full(len(starts), at)
    else:
        places = np.nonzero((gram_hashes(np.frombuffer(raw, np.uint8)) ^ np.array(key, np.int64).view(np.uint64)) & ~_LOW == 0)[0]
        least = places[np.searchsorted(places, starts)]
    piece = (least - starts) * pieces // span
    new = np.append(True, (piece[1:] != piece[:-1]) | (least[1:] != least[:-1]))
    first = np.nonzero(new)[0]
    for a, n in zip(first.tolist(), np.diff(np.append(first, len(starts))).tolist(), strict=True):
        k, where = int(piece[a]), int(least[a])
        nearest, farthest = -(-k * span // pieces), -(-(k + 1) * span // pieces) - 1
        shared = raw[where - nearest : where + WIDTH - farthest]
        yield a, n, where, xxhash.xxh3_64_intdigest(shared, seed=pieces * span + k)


def _split(pieces: int):
    """Segments (key, s1, s2, at, raw) to their pieces, as segments of new buckets, with the names of those that they are of.

    Of equal pieces that are written together the first has the bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held: set[tuple[int, int]] = set()
            for key, s1, s2, at, raw in zip(*[batch.column(c).to_pylist() for c in ("key", "s1", "s2", "at", "raw")], strict=True):
                for a, n, where, bucket in pieces_of(raw, key, at, pieces):
                    own = raw[a : a + n + WIDTH - 1]
                    t1, t2 = np.frombuffer(xxhash.xxh3_128_digest(own), np.int64).tolist()
                    out.append((key, s1, s2, a, bucket - (1 << 64) if bucket >> 63 else bucket, t1, t2, where - a, None if (t1, t2) in held else own))
                    held.add((t1, t2))
                    if len(out) == 4096:
                        yield _pieces_batch(out)
                        out, held = [], set()
            if out:
                yield _pieces_batch(out)

    return run


def _pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["of_key", "of_s1", "of_s2", "place", "key", "s1", "s2", "at", "raw"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans of repeated windows) to the digest of what stays."""
    for batch in batches:
        sizes, removed, count, sha = [], [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            merged = merge_spans([(s["a"], s["b"]) for s in spans or []])
            kept = hashlib.sha256()
            at = 0
            for a, b in merged:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            sizes.append(len(raw))
            removed.append(sum(b - a for a, b in merged))
            count.append(len(merged))
            sha.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha)], names=[batch.schema.names[0], "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _identity(text_col: str) -> list[Column]:
    """Two independent 64-bit hashes of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def _too_large() -> Column:
    return F.col("size") > MOST_BLOCKS * SHARD_BYTES


def _deal(mixed: DataFrame, size: Column, *carry: str) -> tuple[DataFrame, int]:
    """(key, s1, s2, carry, block, shard, i, j) of segments (with their bucket's size), and the number of shards; of too large buckets i and j are -1."""
    small = F.when(~_too_large(), size.cast("long"))
    shards = max(1, round((mixed.agg(F.sum(small)).first()[0] or 0) / SHARD_BYTES))
    blocks = F.when(_too_large(), 0).otherwise(F.ceil(F.col("size") / SHARD_BYTES)).cast("int")
    own = F.when(blocks > 1, F.pmod(F.xxhash64("s1", "s2"), blocks).cast("int")).otherwise(0)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.col("blocks"), F.lit(1)) - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    pairs = F.when(F.col("blocks") == 0, F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j")))).otherwise(pairs)
    shard = F.when(F.col("blocks") != 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards)))
    dealt = mixed.withColumns({"blocks": blocks, "block": own}).select("key", "s1", "s2", *carry, "block", shard.alias("shard"), F.explode(pairs).alias("p"))
    return dealt.select("key", "s1", "s2", *carry, "block", "shard", "p.i", "p.j"), shards


def _solved(raw: DataFrame, shards: int) -> DataFrame:
    """Runs of repeated windows of the segments dealt out; shards are of one size, so a partition for each."""
    return raw.repartition(min(shards, MOST_PARTITIONS), "shard", "i", "j").groupBy("shard", "i", "j").applyInArrow(_solve, "key long, s1 long, s2 long, a int, b int")


def _runs_in_pieces(hot: DataFrame, turn: int, folder: str | None) -> DataFrame:
    """(key, s1, s2, a, b): runs of repeated windows of the segments (key, s1, s2, at, raw) of too large buckets, by their pieces."""
    name = ["key", "s1", "s2"]
    # rows that repeat a text and its id repeat its segments too, which are repeated wherever they are
    parts = stored(hot.mapInArrow(_split(PIECES[turn]), "of_key long, of_s1 long, of_s2 long, place int, key long, s1 long, s2 long, at int, raw binary"), "suffix", folder)
    again = parts.groupBy("key").agg(F.count("*").alias("all")).where("all > 1").select("key")
    parts = stored(parts.join(again, "key", "left_semi"), "suffix", folder)
    # a window's distance from the hash differs all through a piece, so none is in it twice
    distinct = stored(parts.groupBy(*name).agg(F.count("*").alias("times"), F.any_value("at").alias("at"), F.any_value("raw", F.lit(True)).alias("raw")), "suffix", folder)
    size = F.octet_length("raw")
    buckets = stored(distinct.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("kinds"), F.sum(size.cast("long")).alias("size")), "suffix", folder)
    known = distinct.join(buckets, F.col("key") == F.col("_key")).drop("_key")
    runs = known.where("times > 1").select(*name, F.lit(0).alias("a"), (size - (WIDTH - 1)).alias("b"))
    mixed = known.where("kinds > 1")
    if turn + 1 < len(PIECES):
        if buckets.where(_too_large() & (F.col("kinds") > 1)).head(1):
            runs = runs.unionByName(_runs_in_pieces(mixed.where(_too_large()).select(*name, "at", "raw"), turn + 1, folder))
        mixed = mixed.where(~_too_large())
    dealt, shards = _deal(mixed, size, "raw")
    runs = runs.unionByName(_solved(dealt, shards))
    at = [(F.col("place") + F.col(x)).alias(x) for x in ("a", "b")]
    return stored(parts.join(runs, name).select(F.col("of_key").alias("key"), F.col("of_s1").alias("s1"), F.col("of_s2").alias("s2"), *at), "suffix", folder)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """(t1, t2, spans): for each distinct text with any, the byte ranges of runs of repeated windows.

    ``folder`` holds the tables that it is made of; without one, the shared checkpoint folder does.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("ident")
    rows = df.select(*_identity(text_col), ident, F.col(text_col).alias("text"))
    found = stored(rows.where(F.octet_length("text") >= WIDTH).mapInArrow(_emit, SEGMENT_SCHEMA), "suffix", folder)
    # most keys occur once: they go before anything wider is dealt out
    again = found.groupBy("key").agg(F.count("*").alias("all"), F.max("several").alias("several")).where("all > 1 or several").select("key")
    found = stored(found.join(again, "key", "left_semi"), "suffix", folder)
    name = ["key", "s1", "s2"]
    distinct = found.groupBy(*name).agg(F.count("*").alias("times"), F.max("several").alias("several"), F.min(F.struct("t1", "t2", "ident", "start", "windows")).alias("one"))
    distinct = stored(distinct, "suffix", folder)
    size = F.col("one.windows") + (WIDTH - 1)
    buckets = distinct.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("kinds"), F.max("several").alias("_several"), F.sum(size.cast("long")).alias("size"))
    buckets = stored(buckets, "suffix", folder)  # else the join is tied to the sums' exchange, and a large bucket's rows cannot be split
    known = stored(distinct.join(buckets, F.col("key") == F.col("_key")).drop("_key"), "suffix", folder)
    whole = known.where("times > 1").select(*name, F.lit(0).alias("a"), F.col("one.windows").alias("b"))
    # segments that occur once are searched for, among them and those that occur more often
    mixed = known.where("kinds > 1 or (times = 1 and _several)")
    dealt, shards = _deal(mixed, size, "one")
    wanted = dealt.groupBy("one.t1", "one.t2", "one.ident").agg(
        F.collect_list(F.struct(*name, "shard", "block", "i", "j", F.col("one.start").alias("start"), F.col("one.windows").alias("windows"))).alias("wanted")
    )
    long = rows.where(F.octet_length("text") >= WIDTH)
    cut = long.join(wanted.hint("shuffle_hash"), ["t1", "t2", "ident"]).select("text", "wanted")
    raw = cut.mapInArrow(_cut, "key long, s1 long, s2 long, shard long, block int, i int, j int, raw binary")
    runs = whole
    if buckets.where(_too_large()).head(1):
        raw = stored(raw, "suffix", folder)
        runs = runs.unionByName(_runs_in_pieces(raw.where("i < 0").select(*name, F.lit(-1).alias("at"), "raw"), 0, folder))
        raw = raw.where("i >= 0")
    runs = runs.unionByName(_solved(raw, shards))
    at = F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + (WIDTH - 1)).alias("b"))
    return found.join(runs, name).groupBy("t1", "t2").agg(F.collect_set(at).alias("spans"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``df``."""
    with scratch(df.sparkSession) as folder:
        spans = checkpointed(repeated_spans(df, id_col, text_col, folder))
    rows = df.select(F.col(id_col), F.col(text_col).alias("text"), *_identity(text_col))
    long = F.coalesce(F.octet_length("text") >= WIDTH, F.lit(False))
    joined = rows.where(long).join(spans.hint("shuffle_hash"), ["t1", "t2"], "left").select(id_col, "text", "spans")
    joined = joined.unionByName(rows.where(~long).select(id_col, "text"), allowMissingColumns=True)
    kind = df.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(_keep, f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
