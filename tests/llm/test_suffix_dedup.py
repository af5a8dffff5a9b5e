import collections
import hashlib
import random

import numpy as np
from llm_helpers import ODD, sentence

from marlstone.llm import queries
from marlstone.llm import suffix_dedup as S

SF = "/root/testdata/sf0.01"


def brute(raws, width):
    counts = collections.Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        covered = np.zeros(len(r) + 1, int)
        for i in range(len(r) - width + 1):
            if counts[r[i : i + width]] > 1:
                covered[i] += 1
                covered[i + width] -= 1
        c = np.cumsum(covered)[: len(r)] > 0
        kept = np.frombuffer(r, np.uint8)[~c].tobytes()
        out.append((len(r), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(docs, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(docs).collect()}
    want = brute([(t or "").encode() for t in texts], S.WIDTH)
    for i, w in enumerate(want):
        assert got[i] == w, (i, got[i], w)


def planted(draw):
    passage = sentence(draw, 100)
    texts = [sentence(draw, draw.randrange(1, 400)) for _ in range(30)]
    texts += [sentence(draw, 50) + passage + sentence(draw, 30), passage, "x" + passage[:450] + "y", passage[:399], texts[3], texts[3], texts[4] + texts[5]]
    texts += ["for " * 700, "ab" * 1000, "é日" * 300, sentence(draw, 90) * 3]
    for _ in range(6):  # near copies
        words = texts[7].split() + sentence(draw, 200).split()
        words[draw.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    return texts


def test_removed_bytes_equal_brute_force(make_docs, clashing, draw):
    texts = [*ODD, *planted(draw)]
    check(make_docs(texts, extra=clashing), texts)


def test_blocks_of_large_buckets(make_docs, draw, monkeypatch):
    texts = planted(draw)
    monkeypatch.setattr(S, "SHARD_BYTES", 700)
    check(make_docs(texts), texts)


def test_large_buckets_are_dealt_anew_by_pieces(make_docs, draw, monkeypatch):
    texts = planted(draw)
    common = "of one line that is in all of them, and of which no byte differs from text to text. " * 2
    texts += [sentence(draw, draw.randrange(20, 90)) + common + sentence(draw, draw.randrange(20, 90)) for _ in range(60)]
    near = sentence(draw, 60)
    texts += [sentence(draw, draw.randrange(3)) + near + common + near[: draw.randrange(len(near))] + str(i) for i in range(40)]
    turns = []
    deal = S._runs_in_pieces
    monkeypatch.setattr(S, "_runs_in_pieces", lambda hot, turn, folder: turns.append(turn) or deal(hot, turn, folder))
    monkeypatch.setattr(S, "SHARD_BYTES", 700)
    monkeypatch.setattr(S, "MOST_BLOCKS", 2)
    texts += [texts[-1], texts[-1]]
    check(make_docs(texts, ids=[*range(len(texts) - 2), len(texts) - 2, len(texts) - 2]), texts[:-1])
    assert turns == [0, 1, 2]


def test_pieces_hold_each_window_once_and_equal_windows_meet():
    draw = random.Random(4)
    raw = bytes(draw.choice(b"abc ") for _ in range(2500))
    raw += raw[300:1300] + b"for " * 300 + raw[:700]
    key, start, windows, _ = S.segments(np.frombuffer(raw, np.uint8), np.array([len(raw)]))
    for pieces in S.PIECES:
        met = {}
        for k, s, n in zip(key.tolist(), start.tolist(), windows.tolist(), strict=True):
            own = raw[s : s + n + S.WIDTH - 1]
            seen = []
            for a, m, where, bucket in S.pieces_of(own, k, -1, pieces):
                assert [(b, c) for _, b, c, _ in S.pieces_of(own[a : a + m + S.WIDTH - 1], 0, where - a, pieces)] == [(m, where - a)]
                for p in range(a, a + m):
                    seen.append(p)
                    assert met.setdefault(own[p : p + S.WIDTH], (k, bucket)) == (k, bucket)
            assert seen == list(range(n))


def test_long_texts_in_parts(make_docs, draw, monkeypatch):
    texts = planted(draw)
    texts.append(" ".join(texts))
    monkeypatch.setattr(S, "BUFFER", 1500)
    check(make_docs(texts), texts)


def test_intermediate_tables_are_removed(spark, make_docs, draw):
    texts = planted(draw)
    out = S.remove_repeats(make_docs(texts))
    folder = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    left = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    assert not [x for x in left if x.getPath().getName().startswith(("scratch-", "suffix-"))]
    assert out.count() == len(texts)  # what is returned does not need them


def test_null_and_repeated_ids(make_docs, draw):
    a, b = sentence(draw, 120), sentence(draw, 130)
    out = S.remove_repeats(make_docs([a, b, a, b, None], ids=[1, 1, None, None, None])).collect()
    assert len(out) == 5
    assert all(r.n_removed == r.n_bytes for r in out)
    assert S.remove_repeats(make_docs([])).count() == 0


def test_suffix_array_order_and_common_prefixes(monkeypatch):
    monkeypatch.setattr(S, "WIDTH", 40)
    draw = random.Random(9)
    parts = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(40, 200))) for _ in range(30)]
    parts += [parts[0][5:60], parts[1] + parts[2], b"a" * 100]
    array = S.SuffixArray(parts)
    text = b"".join(parts)
    windows = [text[p : p + 40] for p in array.windows.tolist()]
    assert windows == sorted(windows)
    counts = collections.Counter(windows)
    repeated = array.repeated()
    assert all(repeated[p] == (counts[w] > 1) for p, w in zip(array.windows.tolist(), windows, strict=True))
    other = S.SuffixArray([parts[3], bytes(draw.choice(b"ab") for _ in range(90))])
    theirs = {bytes(other.text[p : p + 40]) for p in other.windows.tolist()}
    found = array.found_in(other)
    assert all(found[p] == (w in theirs) for p, w in zip(array.windows.tolist(), windows, strict=True))


def test_windows_beside_long_ties_are_not_repeated():
    draw = random.Random(11)
    some = lambda n: bytes(draw.choice(b"ab") for _ in range(n))
    parts = []
    for n in range(513, 768, 3):  # each pair shares more than what suffixes are sorted by, and differs before and after
        shared = some(n)
        parts += [b"a" + some(20) + b"c" + shared + b"d" + some(60), b"b" + some(20) + b"e" + shared + b"a" + some(60)]
        parts += [shared[k : k + 300] + b"c" + some(150) for k in (1, 40, 110)]
    array = S.SuffixArray(parts)
    text = b"".join(parts)
    windows = [text[p : p + S.WIDTH] for p in array.windows.tolist()]
    counts = collections.Counter(windows)
    repeated = array.repeated()
    assert all(repeated[p] == (counts[w] > 1) for p, w in zip(array.windows.tolist(), windows, strict=True))


def test_equal_windows_share_a_bucket():
    draw = random.Random(8)
    raw = bytes(draw.choice(b"abc ") for _ in range(3000))
    raw += raw[500:1500] + b"for " * 400
    a = np.frombuffer(raw, np.uint8)
    keys = {}
    key, start, windows, _ = S.segments(a, np.array([1200, 1200, len(raw)]))
    assert (start + windows + S.WIDTH - 1 <= len(raw)).all()
    total = 0
    for k, s, n in zip(key.tolist(), start.tolist(), windows.tolist(), strict=True):
        for p in range(s, s + n):
            assert keys.setdefault(raw[p : p + S.WIDTH], k) == k
            total += 1
    assert total == (1200 - S.WIDTH + 1) + (len(raw) - 1200 - S.WIDTH + 1)


def test_query_equals_brute_force_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op9_suffix_dedup"](spark, SF).collect()}
    for d, w in zip(docs.doc_id, brute([t.encode() for t in docs.text], S.WIDTH), strict=True):
        assert got[d] == w


def rolling(raws, width):
    """Bytes covered by repeated windows, by rolling hashes of all windows at once."""
    sizes = np.array([len(r) for r in raws])
    x = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint64) + np.uint64(1)
    ends, total, odd = np.cumsum(sizes), int(sizes.sum()), 0x9E3779B97F4A7C15
    power, hashes, at, made = 1, x, 0, np.zeros(total - width + 1, np.uint64)
    while power <= width:  # a window is made of stretches of powers of two
        if width & power:
            made = made * np.uint64(pow(odd, power, 1 << 64)) + hashes[at : at + len(made)]
            at += power
        hashes = hashes[:-power] * np.uint64(pow(odd, power, 1 << 64)) + hashes[power:]
        power *= 2
    text = np.searchsorted(ends, np.arange(len(made)), side="right")
    whole = np.nonzero(np.arange(len(made)) + width <= ends[text])[0]
    _, back, times = np.unique(made[whole], return_inverse=True, return_counts=True)
    starts = whole[times[back] > 1]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:-1] > 0, ends - sizes, ends


def test_query_equals_rolling_hashes_on_the_large_table(spark):
    large = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{large}/documents.parquet").toPandas()
    raws = [(t or "").encode() for t in docs.text]
    gone, starts, ends = rolling(raws, S.WIDTH)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in queries.QUERIES["op9_suffix_dedup"](spark, large).collect()}
    for i, raw, a, b in zip(docs.doc_id, raws, starts.tolist(), ends.tolist(), strict=True):
        own = gone[a:b]
        kept = np.frombuffer(raw, np.uint8)[~own].tobytes()
        assert got[i] == (int(own.sum()), hashlib.sha256(kept).hexdigest())


def test_many_passages_longer_than_what_is_sorted():
    """Shared passages of 520 to 900 bytes that go on differently, in random order."""
    for seed in range(6):
        draw = random.Random(seed)
        some = lambda n: bytes(draw.choice(b"abcd") for _ in range(n))
        shared = [some(draw.randrange(520, 900)) for _ in range(8)]
        parts = [some(draw.randrange(0, 90)) + draw.choice(shared) + some(draw.randrange(400, 500)) for _ in range(40)]
        array = S.SuffixArray(parts)
        text = b"".join(parts)
        windows = [text[p : p + S.WIDTH] for p in array.windows.tolist()]
        counts = collections.Counter(windows)
        assert array.repeated()[array.windows].tolist() == [counts[w] > 1 for w in windows]
