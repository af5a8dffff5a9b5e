import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import ODD, sentence
from pyspark.sql import functions as F

from marlstone.llm import langid, longtext, quality_rules, queries, ranker, simhash, toxicity

SF = "/root/testdata/sf0.01"


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = set()
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            marked |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_text_counts_equal_brute_force(draw):
    texts = [t or "" for t in ODD if not t or len(t) < 6000] + [sentence(draw, n) for n in (1, 2, 3, 60, 200)] + ["a b c a b c d\nx\nx\n \n \nx", "É É É Ü", "one\x1ftwo\x85three"]
    for t in texts:
        assert quality_rules.text_counts(t)[:5] == brute_counts(t), repr(t)[:60]


def test_rules_keep_clean_and_drop_junk(make_docs, clashing, draw):
    clean = [sentence(draw, 80) for _ in range(300)]
    junk = ["## ** " * 5 + sentence(draw, 60).replace(" ", "$$$ ") for _ in range(40)] + ["SHOUT!! " * 5 + sentence(draw, 70).upper().replace(" ", "!! ") for _ in range(40)]
    n = len(clean) + len(junk)
    df = make_docs(clean + junk, langs=["en"] * n, sources=["hot"] * (n - 50) + ["small"] * 50, extra=clashing)
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert len(got) == n
    assert all(got[i].kept for i in range(300)) and not any(got[i].kept for i in range(300, n))


def test_rules_take_odd_rows(make_docs):
    out = quality_rules.quality_rules(make_docs(ODD)).collect()
    assert len(out) == len(ODD)
    assert all(r.base_failed and not r.kept for r in out if r.n_words < 50)
    assert quality_rules.quality_rules(make_docs([])).count() == 0
    assert quality_rules.quality_rules(make_docs(["x y"] * 4, ids=[1, 1, None, None])).count() == 4


def test_sketches_merge_and_are_accurate(spark, make_docs):
    rng = np.random.default_rng(0)
    values = np.exp(rng.normal(3, 1, 4000)).astype(int) + 1
    rows = [(i, int(v), 100, "g%d" % (i % 3)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id long, n_symbols long, n_words long, g string").withColumns({c: F.lit(1).cast("long") for c in quality_rules.COUNTS if c not in ("n_symbols", "n_words")})
    sketch = quality_rules.sketches(df, ("g",))
    direct = quality_rules.sketches(df, ()).collect()
    merged = quality_rules.merged(sketch, ()).collect()
    assert sorted(map(tuple, direct)) == sorted(map(tuple, merged))
    q = quality_rules.quantiles(quality_rules.merged(sketch, ()).withColumn("_all", F.lit(0)), ("_all",), (0.1, 0.5, 0.9)).where("ratio = 'symbols'").first()
    for at, got in zip((0.1, 0.5, 0.9), (q.q0, q.q1, q.q2), strict=True):
        want = np.quantile(values / 100, at, method="inverted_cdf")
        assert abs(got - want) <= 0.011 * want


def test_rules_equal_their_sql(spark):
    import duckdb

    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(queries.ORACLES["op3_quality_rules"]).fetchdf().sort_values("doc_id").reset_index(drop=True)
    got = queries.QUERIES["op3_quality_rules"](spark, small).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c


def test_salted_fences_equal_broadcast(make_docs, draw, monkeypatch):
    df = make_docs([sentence(draw, 60) for _ in range(60)])
    a = sorted(map(tuple, quality_rules.quality_rules(df).collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, quality_rules.quality_rules(df).collect())) == a


def test_language_backs_off_and_marks_undecided(make_docs, clashing):
    train = make_docs(["the house and the garden with trees"] * 5 + ["das haus und der garten mit bäumen"] * 5, langs=["en"] * 5 + ["de"] * 5)
    model = langid.train(train)
    texts = [*ODD, "the trees", "der garten", "gartens mitten", "12 34 !?", "THE HOUSE"]
    got = {r.doc_id: r for r in langid.identify(make_docs(texts, extra=clashing), model).collect()}
    at = len(ODD)
    assert [got[at + i].lang_pred for i in range(5)] == ["en", "de", "de", "und", "en"]
    for i, t in enumerate(texts):
        assert (got[i].lang_pred == "und") == (t is None or not any(map(str.isalpha, t)))
        assert 0 <= got[i].score <= 1
    empty = langid.train(make_docs([]))
    assert {r.lang_pred for r in langid.identify(make_docs(["some text"]), empty).collect()} == {"und"}
    assert langid.train(make_docs(["a"], langs=[None])).langs == []


def test_small_and_many_languages_keep_their_words(make_docs, monkeypatch):
    monkeypatch.setattr(langid, "MAX_WORDS", 20)
    large = " ".join(f"big{chr(97 + i % 26)}{chr(97 + i // 26)} " * 3 for i in range(60))
    train = make_docs([large] * 3 + ["quokka wallaby numbat"], langs=["aa"] * 3 + ["zz"])
    model = langid.train(train)
    assert model.langs == ["aa", "zz"]
    got = [r.lang_pred for r in langid.identify(make_docs(["quokka numbat", "wallabies"]), model).orderBy("doc_id").collect()]
    assert got == ["zz", "zz"]
    code = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    many = make_docs([f"{code(i) * 4} {code(i) * 3}" for i in range(300)], langs=[f"l{i:03}" for i in range(300)])
    assert len(langid.train(many).langs) == 300
    monkeypatch.setattr(langid, "DENSE", 0)
    sparse = langid.train(train)
    assert all((sparse.word(w) == model.word(w)).all() for w in ("quokka", "wallabies", "bigaa"))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = queries.QUERIES["op4_language_id"](spark, SF).join(docs, "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = queries.QUERIES["op5_quality_classifier"](spark, SF).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert ((out.score >= 0.7) == (out.predicted == 1)).all() and out.score.between(0, 1).all()


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = queries.QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").toPandas()
    held = out[out.held_out].merge(texts, on="doc_id")
    assert held[held.toxic == 0].predicted.mean() < 0.02
    # of the texts marked toxic, 44 of 97 have none of the words that the others have, and can be found by copies of them alone
    insults = "clown idiot scum trash stupid moron loser pathetic worthless disgusting".split()
    named = held[held.text.str.contains(rf"\b(?:{'|'.join(insults)})\b")]
    assert len(named) > 50 and named.predicted.mean() > 0.95
    assert held[held.toxic == 1].predicted.mean() > 0.7


@pytest.mark.parametrize("module", [ranker, toxicity])
def test_classifiers_take_odd_and_empty_tables(spark, make_docs, clashing, module):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] + [(None, 1, 1), (3, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    docs = make_docs([("fine words here " if i % 2 else "bad ### text ### ") * 5 for i in range(20)])
    model = module.train(docs, labels)
    out = module.score(make_docs(ODD, extra=clashing), model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    untrained = module.train(docs, labels.where("false"))
    assert len({r.score for r in module.score(docs, untrained).collect()}) == 1
    assert module.score(make_docs([]), model).count() == 0


def fit(texts, y):
    bags = [toxicity.weights(t) for t in texts]
    seen = Counter(w for words, _ in bags for w in words)
    vocabulary = sorted(w for w, n in seen.items() if n >= toxicity.MIN_DOCS)
    index = {w: i for i, w in enumerate(vocabulary)}
    rows = []
    for words, share in bags:
        known = [(index[w], x) for w, x in zip(words, share, strict=True) if w in index]
        rows.append((np.array([i for i, _ in known], np.int64), np.array([x for _, x in known])))
    return toxicity.Model(vocabulary, rows, y)


def test_misspellings_share_vectors():
    texts = ["plain words about rivers and hills number %d" % (i % 7) for i in range(60)] + ["plain words about a horrible rivers number %d" % (i % 7) for i in range(60)]
    model = fit(texts, np.array([0] * 60 + [1] * 60))
    assert model.word("horrible") > model.word("horribble") > max(model.word("rivers"), 0)


def test_long_texts_are_read_in_stretches(monkeypatch, draw):
    texts = [t or "" for t in ODD] + ["\n".join(sentence(draw, draw.randrange(1, 90)) for _ in range(6)) + "\nÉ UP! A,b\n" + "same line here\n" * 3 for _ in range(8)]
    small = langid.Model()
    read = lambda: [(quality_rules.text_counts(t), ranker.features(t), simhash.fingerprint(t), sorted(longtext.counted(t, toxicity.words_of).items())) for t in texts]
    whole = read()
    monkeypatch.setattr(longtext, "LONG", 30)
    monkeypatch.setattr(longtext, "STRETCH", 40)
    assert read() == whole
    assert all("".join(longtext.stretches(t)) == t for t in texts)
    assert langid.predictor(small)(texts)[0] == ["und"] * len(texts)


def trained_tables(spark, make_docs, draw, order):
    """Training tables with repeated ids, labels and rows, in some order."""
    texts = [sentence(draw, 60) + (" ### junk" if i % 2 else "") + (" nasty nasti" if i % 3 == 0 else "") for i in range(60)]
    ids = [i if i < 50 else i - 50 for i in range(60)]
    labels = [(i, 1 - i % 2, int(i % 3 == 0)) for i in range(50)] + [(3, 0, 1), (3, 0, 1), (None, 1, 1)]
    rows = list(zip(texts, ids, strict=True))
    if order:
        rows, labels = rows[::-1] + rows[:4], labels[::-1]
    return make_docs([t for t, _ in rows], ids=[i for _, i in rows]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_models_do_not_hang_on_the_order_of_rows(spark, make_docs):
    import random

    made = [[m.train(*trained_tables(spark, make_docs, random.Random(3), order)) for order in (0, 1)] for m in (ranker, toxicity)]
    (a, b), (c, d) = made
    assert (a.weights == b.weights).all() and a.cut == b.cut
    assert (c.bucket == d.bucket).all() and c.bias == d.bias


def test_ranker_minimises_the_loss_of_pairs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 14)) * 3 + 1
    y = (x[:, 1] + rng.normal(size=60) > 1).astype(int)
    model = ranker.Ranker(x, y)
    z = (x - model.mean) / model.scale
    draw = np.random.default_rng(ranker.SEED)
    win, lose = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    pairs = list(zip(draw.choice(win, ranker.PAIRS).tolist(), draw.choice(lose, ranker.PAIRS).tolist(), strict=True))
    times = Counter(pairs)

    def loss(w):
        s = z @ w
        return sum(n * math.log1p(math.exp(s[b] - s[a])) for (a, b), n in times.items()) / len(pairs) + ranker.L2 * float(w @ w)

    best = loss(model.weights)
    for k in range(14):
        for step in (-0.01, 0.01):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(moved) > best


def test_quality_query_equals_a_plain_scorer(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = ranker.train(docs, spark.read.parquet(f"{small}/labels.parquet").where(~ranker.held_out()))
    got = {r.doc_id: r for r in queries.QUERIES["op5_quality_classifier"](spark, small).collect()}
    for d in docs.collect():
        s = sum((x - m) / c * w for x, m, c, w in zip(ranker.features(d.text or ""), model.mean, model.scale, model.weights, strict=True))
        score = 1 / (1 + math.exp(-min(60, max(-60, (s - model.cut) / model.spread)) - math.log(ranker.CUT / (1 - ranker.CUT))))
        assert abs(got[d.doc_id].score - score) < 1e-9 and got[d.doc_id].predicted == int(got[d.doc_id].score >= 0.7)


def test_toxicity_query_equals_a_plain_scorer(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet").where(~toxicity.held_out()))
    got = {r.doc_id: r for r in queries.QUERIES["op10_toxicity"](spark, small).collect()}
    for d in docs.collect():
        counts = Counter(re.findall(r"[^\W_]+", (d.text or "").lower()))
        logit, mass = 0.0, sum(n**toxicity.DAMP for n in counts.values()) + toxicity.PAD
        for word, n in counts.items():
            marked = f"<{word}>".encode()
            bag = [zlib.crc32(marked) % toxicity.BUCKETS] + [zlib.crc32(marked[i : i + k], k) % toxicity.BUCKETS for k in (3, 4, 5) for i in range(len(marked) - k + 1)]
            logit += n**toxicity.DAMP / mass * sum(float(model.bucket[b]) for b in bag) / len(bag)
        assert abs(got[d.doc_id].score - 1 / (1 + math.exp(-logit - model.bias))) < 1e-4
        assert got[d.doc_id].predicted == int(got[d.doc_id].score >= 0.5)


def test_language_query_equals_a_plain_scorer(spark):
    """Counts and scores by their definitions, in plain Python, from the whole training fold."""
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    find = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    tables = [defaultdict(Counter) for _ in range(6)]
    train = [(t, lang) for i, t, lang in zip(docs.doc_id, docs.text, docs.lang, strict=True) if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    words = defaultdict(Counter)
    for t, lang in train:
        words[lang].update(find(t))
    for lang, counts in words.items():
        for word, n in counts.items():
            tables[0][word][lang] += n
            for k in (5, 4, 3, 2, 1):
                for i in range(len(word) + 3 - k):
                    tables[6 - k][f"<{word}>"[i : i + k]][lang] += math.sqrt(n)
    langs = sorted(words)
    sums = [{x: sum(c[x] for c in t.values()) for x in langs} for t in tables]

    def row(level, key):
        logs = [math.log((tables[level][key][x] + 0.5) / (sums[level][x] + 0.5 * len(tables[level]))) for x in langs]
        return [v - max(logs) for v in logs]

    def of(word):
        if word in tables[0]:
            return row(0, word)
        for k in (5, 4, 3, 2, 1):
            known = [row(6 - k, g) for g in (f"<{word}>"[i : i + k] for i in range(len(word) + 3 - k)) if g in tables[6 - k]]
            if known:
                return [sum(x) / len(known) for x in zip(*known, strict=True)]
        return [0.0] * len(langs)

    got = {r.doc_id: r for r in queries.QUERIES["op4_language_id"](spark, small).collect()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        counts = Counter(find(t))
        mean = [sum(n * x for n, x in zip(counts.values(), column, strict=True)) / max(1, sum(counts.values())) for column in zip(*map(of, counts), strict=True)]
        p = [math.exp(langid.WEIGHT * (m - max(mean))) for m in mean]
        assert abs(got[i].score - max(p) / sum(p)) < 1e-4
        assert got[i].lang_pred == langs[p.index(max(p))]


def test_chance_does_not_fail_a_rule(make_docs, draw):
    """One repeated line among three is no evidence, and twenty of sixty are."""
    clean = ["\n".join(sentence(draw, 30) for _ in range(3)) for _ in range(220)]
    line = sentence(draw, 5)
    few = line + "\n" + sentence(draw, 80) + "\n" + line
    many = "\n".join(x for _ in range(21) for x in (sentence(draw, 30), sentence(draw, 30), line))
    out = {r.doc_id: r for r in quality_rules.quality_rules(make_docs([*clean, few, many], langs=["en"] * 222, sources=["a"] * 222)).collect()}
    assert out[220].kept and not out[220].base_failed
    assert "dup_lines" in out[221].failed_rules


def test_pairwise_loss_falls(draw):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 14))
    y = (x[:, 0] - 0.5 * x[:, 3] + 0.1 * rng.normal(size=400) > 0).astype(int)
    model = ranker.Ranker(x, y)
    s = model.scores(x)
    assert ((s >= ranker.CUT) == (y == 1)).mean() > 0.93
