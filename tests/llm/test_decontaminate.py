import math
import re
from collections import Counter

import numpy as np
import pytest
from llm_helpers import ODD, sentence

from marlstone.llm import decontaminate as D
from marlstone.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture
def items(spark, draw):
    texts = [sentence(draw, n).capitalize() + ". " + sentence(draw, 8).capitalize() + "." for n in (12, 20, 40, 150)] + ["Short.", "", None, "Twice the same item text for all to find here. And so it is."] + ["Twice the same item text for all to find here. And so it is."]
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def brute(index, text):
    """Every item by its definition: all passages against all units, then the overlaps."""
    words = D.words_of(text)
    found = {}
    for a in range(0, max(1, len(words) - (D.PASSAGE - D.STRIDE)), D.STRIDE):
        terms = {index.term[w] for w in words[a : a + D.PASSAGE] if w in index.term}
        scores = {}
        for tier in index.tiers:
            for t in terms & tier.units.keys():
                for u, w in zip(tier.units[t], tier.impacts[t], strict=True):
                    scores[u] = scores.get(u, 0) + w
        for u, s in scores.items():
            if s >= D.THRESHOLD - 1e-6:
                item = index.items[index.unit_item[u]]
                q, an = item.overlap(words[max(0, a - item.size) : a + D.PASSAGE + item.size])
                if q >= D.OVERLAP and an >= D.OVERLAP:
                    found[item.item_id] = max(found.get(item.item_id, 0), s)
    return found


def test_block_max_wand_finds_all_that_brute_force_finds(draw, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 3)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(6, 40)))) for i in range(150)]
    index = D.Index(items)
    for _ in range(60):
        terms = sorted({index.term[w] for w in rng.choice(vocabulary, 60) if w in index.term})
        for tier in index.tiers:
            want = {}
            for t in terms:
                for u, w in zip(tier.units.get(t, []), tier.impacts.get(t, []), strict=True):
                    want[u] = want.get(u, 0) + w
            for at in (0.3, 0.5, 0.7):
                got = dict(tier.search(terms, at))
                assert got.keys() == {u for u, s in want.items() if s >= at - 1e-6}
                assert all(abs(got[u] - want[u]) < 1e-9 for u in got)


def test_planted_items_are_found_and_clean_texts_left(make_docs, items, clashing, draw):
    texts = {r.item_id: r.text for r in items.collect()}
    filler = lambda n: sentence(draw, n)
    docs = [filler(300), filler(200) + " " + texts[0] + " " + filler(100), texts[1], filler(2000) + "\n" + texts[3] + "\n" + filler(50), texts[2].upper(), texts[2].split(".")[0], "x " + texts[7]]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(make_docs(docs + ODD, extra=clashing), items).collect()}
    assert got == {(1, 0), (2, 1), (3, 3), (4, 2), (6, 7), (6, 8)}


def test_short_and_unspaced_items_are_found(spark, make_docs, draw):
    short, unspaced = "What is two? Two.", "日本の首都はどこですか。東京です。"
    items = spark.createDataFrame([(1, short), (2, unspaced), (3, "日本。東京。"), (4, "One word more than four.")], "item_id long, text string")
    around = [sentence(draw, 90), sentence(draw, 70)]
    docs = make_docs([f"{around[0]} {short} {around[1]}", f"{around[0]} {unspaced} {around[1]}", "what is TWO, two", "What is two or two", "two what is two", "昔の日本、東京の話", *around])
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()}
    assert got == {(0, 1), (1, 2), (2, 1), (5, 3)}
    assert {r.doc_id for r in D.clean(docs, items).collect()} == {3, 4, 6, 7}
    assert [h[0] for h in D.find(D.Index([(1, short)]), f"x {short} y")] == [1]


def test_long_texts_in_stretches(items, draw, monkeypatch):
    rows = [(r.item_id, r.text) for r in items.collect()]
    index = D.Index(rows)
    text = " ".join([sentence(draw, 400), rows[2][1], sentence(draw, 700), rows[3][1], sentence(draw, 90)])
    whole = D.find(index, text)
    assert {h[0] for h in whole} == {2, 3}
    for n in (1, 2, 5):
        monkeypatch.setattr(D, "PASSAGES", n)
        assert [h[0] for h in D.find(index, text)] == [h[0] for h in whole]


def test_results_equal_brute_force_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    (index,) = D.shards(spark.read.parquet(f"{SF}/benchmark.parquet"))
    got = {(r.doc_id, r.item_id): r.score for r in queries.QUERIES["op1_decontamination"](spark, SF).collect()}
    want = {(d, i): s for d, t in zip(docs.doc_id, docs.text, strict=True) for i, s in brute(index, t).items()}
    assert got.keys() == want.keys() and len(got) > 10
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)
    exact = {(d, i) for d, t in zip(docs.doc_id, docs.text, strict=True) for i, b in zip(*[spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()[c] for c in ("item_id", "text")], strict=True) if b in t}
    assert exact <= got.keys()


def test_shards_and_empty_tables(spark, make_docs, items, monkeypatch):
    docs = make_docs([r.text for r in items.collect()])
    whole = {(r.doc_id, r.item_id): r.score for r in D.contaminated(docs, items).collect()}
    monkeypatch.setattr(D, "SHARD_ITEMS", 3)
    assert len(list(D.shards(items))) == 3
    again = {(r.doc_id, r.item_id): r.score for r in D.contaminated(docs, items).collect()}
    assert again.keys() == whole.keys() and all(abs(again[k] - whole[k]) < 1e-6 for k in whole)
    assert D.contaminated(docs, items.where("false")).count() == 0
    assert D.contaminated(docs.where("false"), items).count() == 0
    kept = {r.doc_id for r in D.clean(docs, items).collect()}
    assert kept == {4, 5, 6} and D.clean(docs, items).columns == docs.columns


def plain_bm25(items, text):
    """Scores and overlaps by their definitions, from the items' texts alone."""
    find = lambda t: re.findall(r"\w+", (t or "").lower())
    units = []
    for i, t in items:
        w = find(t)
        n = math.ceil(len(w) / 64) if len(w) >= 5 else 0
        units += [(i, t, w[k * len(w) // n : (k + 1) * len(w) // n]) for k in range(n)]
    df = Counter(x for _, _, w in units for x in set(w))
    mean = sum(len(w) for _, _, w in units) / len(units)
    words, found = find(text), {}
    for a in range(0, max(1, len(words) - 64), 64):
        passage = set(words[a : a + 128])
        for i, t, w in units:
            weight = {x: math.log(1 + (len(units) - df[x] + 0.5) / (df[x] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, n in Counter(w).items()}
            score = sum(v for x, v in weight.items() if x in passage) / sum(weight.values())
            if score < 0.7 - 1e-6:
                continue
            size = len(find(t))
            around = words[max(0, a - size) : a + 128 + size]
            parts = [p for p in map(find, re.split(r"(?<=[.!?])\s+", t)) if p]
            half = (len(parts[0]) + 1) // 2
            sides = ([x for p in parts[:-1] for x in p], parts[-1]) if len(parts) > 1 else (parts[0][:half], parts[0][half:])
            shares = []
            for side in sides:
                k = min(5, len(side))
                own = {tuple(side[j : j + k]) for j in range(len(side) - k + 1)}
                shares.append(len(own & {tuple(around[j : j + k]) for j in range(len(around) - k + 1)}) / len(own))
            if min(shares) >= 0.8:
                found[i] = max(found.get(i, 0), score)
    return found


def test_query_equals_a_plain_bm25_on_the_table(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.score for r in queries.QUERIES["op1_decontamination"](spark, small).collect()}
    want = {(d.doc_id, i): s for d in docs for i, s in plain_bm25(items, d.text).items()}
    assert got.keys() == want.keys() and want
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_repeated_rows_ids_and_items(spark, make_docs, draw):
    text = sentence(draw, 30).capitalize() + ". " + sentence(draw, 9) + "."
    items = spark.createDataFrame([(1, text), (1, text), (2, text), (None, None)], "item_id long, text string")
    docs = make_docs([f"x {text} y {text}"] * 3, ids=[7, 7, None])
    got = sorted(((r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()), key=str)
    assert got == sorted([(7, 1), (7, 2)] * 2 + [(None, 1), (None, 2)], key=str)
    assert D.clean(docs, items).count() == 0


def test_long_texts_share_their_words(items, draw, monkeypatch):
    rows = [(r.item_id, r.text) for r in items.collect()]
    text = " ".join([sentence(draw, 400), rows[2][1], sentence(draw, 200)])
    whole = D.find(D.Index(rows), text)
    monkeypatch.setattr(D.longtext, "LONG", 50)
    monkeypatch.setattr(D.longtext, "STRETCH", 60)
    assert D.find(D.Index(rows), text) == whole
