import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from llm_helpers import ODD, sentence

from marlstone.llm import queries, simhash
from marlstone.llm.components import connected_components

SF = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.nonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= simhash.DISTANCE)[0]:
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(f)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(f))]


def test_fingerprints_and_odd_rows(make_docs, clashing, draw):
    texts = [*ODD, sentence(draw, 500), "Ünï CODE Ä x y z", "one two", "one two three", "one two three four"]
    out = {r.doc_id: r for r in simhash.near_duplicates(make_docs(texts, extra=clashing)).collect()}
    for i, t in enumerate(texts):
        assert int(out[i].fingerprint, 16) == brute_fingerprint(t), t
        assert len(out[i].fingerprint) == 16
    assert out[0].component_id == out[1].component_id == out[2].component_id == 0
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_components_equal_brute_force_on_the_table(spark):
    out = queries.QUERIES["op8_simhash_dedup"](spark, SF).toPandas().sort_values("doc_id")
    fps = [int(x, 16) for x in out.fingerprint]
    assert out.component_id.tolist() == brute_components(fps, out.doc_id.tolist())


def fingerprint_table(spark, fps):
    return spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")


def components_of(spark, fps):
    nodes = {r.node: r.component for r in connected_components(simhash.links(fingerprint_table(spark, fps))).collect()}
    return [nodes.get(i, i) for i in range(len(fps))]


def test_links_at_all_bit_positions(spark):
    draw = random.Random(2)
    fps = []
    for k in range(120):  # far apart, each with one neighbour at three bits and one at four
        base = draw.getrandbits(64)
        bits = draw.sample(range(64), 7) if k % 3 else [31, 63, draw.randrange(31), 0, 1, 2, 3]
        fps += [base, base ^ sum(1 << b for b in bits[:3]), base ^ sum(1 << b for b in bits[3:7])]
    fps = list(dict.fromkeys(fps))
    assert components_of(spark, fps) == brute_components(fps, list(range(len(fps))))


def test_dense_groups_dealt_out_in_blocks(spark, monkeypatch):
    draw = random.Random(4)
    base = draw.getrandbits(64)
    near = {base ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(6))) for _ in range(600)}
    fps = list(near | {draw.getrandbits(64) for _ in range(100)})
    want = brute_components(fps, list(range(len(fps))))
    assert components_of(spark, fps) == want
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert components_of(spark, fps) == want
    monkeypatch.setattr(simhash, "BROADCAST_HOT", 0)
    assert components_of(spark, fps) == want
    monkeypatch.setattr(simhash, "MEMBERS", 20)
    monkeypatch.setattr(simhash, "SAMPLED", 2)
    assert components_of(spark, fps) == want


def test_components_of_graphs(spark):
    draw = random.Random(6)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 100)]
    edges = chain + star + [(5000, 5000), (1, 0), (1, 0)] + [(2000 + draw.randrange(60), 2000 + draw.randrange(60)) for _ in range(40)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one_row_of_each_group(make_docs, clashing, draw):
    texts = [sentence(draw, 60) for _ in range(5)]
    rows = [*texts, texts[0], texts[1], texts[2], None, "", texts[3], texts[3], texts[4], "only null ids", "only null ids"]
    ids = [10, 11, 12, 13, 14, 3, 20, 12, 30, 31, None, None, 14, None, None]
    docs = make_docs(rows, ids=ids, extra=clashing)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert sorted(str(d) for d, _ in got) == sorted(["3", "11", "12", "13", "14", "30", "None"])
    assert simhash.keep_one(make_docs([])).count() == 0


def five_word_runs(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute_kept(ids, texts):
    """In order of ids, each text that is not like one kept before it."""
    kept = []
    for i, own in sorted(zip(ids, map(five_word_runs, texts), strict=True), key=lambda x: x[0]):
        if not any(alike(own, other) for _, other in kept):
            kept.append((i, own))
    return {i for i, _ in kept}


def edited(draw, text, n):
    words = text.split()
    for k in draw.sample(range(0, len(words), 6), n):
        words[k] = f"edit{draw.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_equal_brute_force(make_docs, draw, monkeypatch):
    texts = [sentence(draw, n) for n in (300, 200, 250, 90)]
    texts += [edited(draw, texts[k % 3], e) for k in range(60) for e in (1, 3, 6, 9)]
    texts += [sentence(draw, 120) for _ in range(40)] + [t or "" for t in ODD]
    draw.shuffle(texts)
    docs = make_docs(texts)
    want = brute_kept(range(len(texts)), texts)
    monkeypatch.setattr(simhash.leaders, "FIRST", 1000)
    whole = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert whole == want
    monkeypatch.setattr(simhash, "WIDE_BLOCK", 16)
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    monkeypatch.setattr(simhash, "FEW", 4)
    monkeypatch.setattr(simhash.leaders, "FIRST", 2)
    monkeypatch.setattr(simhash.leaders, "PART_BYTES", 4000)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}  # decided in another order
    sets = [five_word_runs(t) for t in texts]
    assert not any(alike(sets[i], sets[j]) for i in kept for j in kept if i < j)
    assert all(any(alike(sets[i], sets[j]) for j in kept) for i in range(len(texts)))


def test_what_goes_has_a_near_copy_that_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    kept = {r.doc_id for r in simhash.keep_one(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    sets = dict(zip(docs.doc_id, map(five_word_runs, docs.text), strict=True))
    for i in sets.keys() - kept:
        assert any(alike(sets[i], sets[j]) for j in kept)
    assert kept == brute_kept(docs.doc_id, docs.text)


def codewords_near(x):
    """All words of the covering code within two bits of a half, by trying each."""
    syndrome = lambda y: np.bitwise_xor.reduce([i for i in range(1, 32) if y >> i - 1 & 1] or [0])
    flips = [0, *(1 << i for i in range(32)), *(1 << i | 1 << j for i in range(32) for j in range(i))]
    return [x ^ f for f in flips if syndrome(x ^ f) == 0]


def wide_copies(draw, groups, apart):
    """Fingerprints of 128 bits, of distinct numbers: groups of so many, each member up to ``apart`` bits from its group's middle."""
    out = []
    for n in groups:
        middle = draw.getrandbits(128)
        out += [middle ^ sum(1 << b for b in draw.sample(range(128), draw.randrange(apart + 1))) for _ in range(n)]
    return list({(x & (1 << 64) - 1) ^ x >> 64: x for x in out}.values())


def test_near_copies_are_linked_by_one_of_the_anchors_that_they_share(draw):
    """All that is near at an anchor is joined, and no pair is told twice, however many anchors it shares."""
    fps = wide_copies(draw, (300, 3, 3, 20), 18)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [(signed(x & (1 << 64) - 1), signed(x >> 64)) for x in fps]
    rows, groups = [], {}
    for n, x in enumerate(fps):
        for half in range(4):
            for anchor in codewords_near(x >> 32 * half & 0xFFFFFFFF):
                rows.append((half << 32 | anchor, *words[n]))
                groups.setdefault((half, anchor), []).append(n)
    columns = [pa.array(c, pa.int64()) for c in zip(*sorted(rows), strict=True)]
    table = pa.RecordBatch.from_arrays(columns, names=["key", "f0", "f1"])
    cuts = range(0, len(rows), 700)
    told = [(u, v) for b in simhash._meet(table.slice(k, 700) for k in cuts) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    number = {a ^ b: n for n, (a, b) in enumerate(words)}
    pairs = [tuple(sorted((number[u], number[v]))) for u, v in told]

    def joined(edges):
        parent = list(range(len(fps)))

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(fps))]

    near = {(i, j) for g in groups.values() for i in g for j in g if i < j and (fps[i] ^ fps[j]).bit_count() <= simhash.WIDE_DISTANCE}
    assert joined(pairs) == joined(near)
    apart = [p for p in pairs if p not in near]  # joined through a third
    direct = [p for p in pairs if p in near]
    assert len(direct) == len(set(direct)) and len(apart) <= len(fps)
