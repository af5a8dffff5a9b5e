import numpy as np
import pytest
from llm_helpers import ODD, sentence

from marlstone.llm import pieces, queries

MODEL = "piece_bpe_32k.model"


def brute(vocabulary, segment):
    """The best segmentation by plain dynamic programming over all substrings."""
    known = {}
    for i, (text, score, kind) in enumerate(pieces.model_pieces(_path())):
        if kind == "normal":
            known.setdefault(text.replace("▁", " ").encode(), (i, score))
    n = len(segment)
    best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
    for e in range(1, n + 1):
        for s in range(max(0, e - 48), e):
            if segment[s:e] in known and best[s] + known[segment[s:e]][1] > best[e]:
                best[e], back[e] = best[s] + known[segment[s:e]][1], (s, [known[segment[s:e]][0]])
        s = e - 1
        while s and segment[s] & 0xC0 == 0x80:
            s -= 1
        ends = e == n or segment[e] & 0xC0 != 0x80
        if ends and segment[s:e] not in known and best[s] + vocabulary.unknown_score > best[e]:
            best[e], back[e] = best[s] + vocabulary.unknown_score, (s, [int(vocabulary.byte_id[b]) for b in segment[s:e]])
    out, e = [], n
    while e:
        s, ids = back[e]
        out = ids + out
        e = s
    return out, best[n]


def unigram():
    """The same pieces, their file's scores taken as a unigram model's."""
    return pieces.Vocabulary(pieces.model_pieces(_path()))


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=_path())


def _path():
    import public_tokenizers

    return str(public_tokenizers.path(MODEL))


def test_viterbi_equals_brute_force(draw):
    v = unigram()
    texts = [t or "" for t in ODD if not t or len(t) < 100] + [sentence(draw, 30), "naïve café 東京 \n x  y   z", "unthinkable preprocessing"]
    for t in texts:
        for s in pieces._SEGMENT.findall(pieces.marked(t)) if t else []:
            assert v._single(s) == brute(v, s)[0], s
            assert v._segmented([s])[0].tolist() == brute(v, s)[0], s


@pytest.mark.parametrize("make", [unigram, lambda: pieces.load(MODEL)])
def test_lockstep_equals_single(draw, make):
    v = make()
    segments = list({s for _ in range(50) for s in pieces._SEGMENT.findall(pieces.marked(sentence(draw, 40) + " é東 ☃"))})
    ids, start, count = v._segmented(segments)
    for s, a, k in zip(segments, start.tolist(), count.tolist(), strict=True):
        assert ids[a : a + k].tolist() == v._single(s)


def test_equals_the_library_on_the_same_scores():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(_path(), "rb").read())
    m.trainer_spec.model_type = 1  # its own lattice over the same pieces; a single best takes another route
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    v = unigram()
    for w in "the unthinkable preprocessing of international running shoes thentionable".split():
        assert v.encode([w])[0].tolist() == library.nbest_encode_as_ids(w, 4)[0]


def test_round_trip_and_odd_rows(make_docs, clashing, draw):
    texts = [*ODD, sentence(draw, 20000), " lead", "trail ", "a  b", "same", "same"]
    out = {r.doc_id: r for r in pieces.encode(make_docs(texts, extra=clashing)).collect()}
    for i, t in enumerate(texts):
        assert out[i].n_pieces == len(out[i].ids)
        assert out[i].round_trip == (t is None or "▁" not in t), repr(t)[:40]
    assert out[0].ids == [] and out[1].ids == []
    assert pieces.encode(make_docs([])).count() == 0


def test_long_texts_in_parts(monkeypatch, draw):
    texts = [sentence(draw, 300) + "  double  " + sentence(draw, 50), "", "y" * 900 + " z", sentence(draw, 100)]
    whole = pieces.encoder(MODEL)(texts)
    monkeypatch.setattr(pieces, "CHUNK_BYTES", 100)
    parts = pieces.encoder(MODEL)(texts)
    assert parts[0].tolist() == whole[0].tolist() and parts[1].to_pylist() == whole[1].to_pylist() and all(parts[2])


def test_decode_column(spark, make_docs):
    texts = ["hello  there\nworld 😀", "", None, "x"]
    coded = pieces.encode(make_docs(texts))
    back = {r.doc_id: r.t for r in coded.select("doc_id", pieces.decoder(MODEL)("ids").alias("t")).collect()}
    assert [back[i] for i in range(4)] == ["hello  there\nworld 😀", "", "", "x"]


def test_vocabulary_with_marks_inside_is_not_split():
    v = pieces.Vocabulary([("<unk>", 0.0, "unknown"), ("a", -1.0, "normal"), ("▁", -1.0, "normal"), ("▁a▁a", -0.5, "normal"), ("b", -1.0, "normal")])
    assert not v.splits
    ids, counts = v.encode(["a a b"])
    assert counts.tolist() == [3] and ids.tolist() == [3, 2, 4]


def test_merging_equals_the_library(draw):
    odd = [t or "" for t in ODD] + ["aaaaaaaaaaaaa abababababab " * 9, "xyz" * 400, "é日é日" * 90, "a  b   c    d", "🙂🙂 naïve ☃☃", "\x1f\x85"]
    noise = ["".join(draw.choice("abcehinorst  \n.ü東☃") for _ in range(draw.randrange(1, 120))) for _ in range(300)]
    _, ids, _ = pieces.encoder(MODEL)(odd + noise)
    assert ids.to_pylist() == library().encode(odd + noise)


def test_merging_and_cleared_pairs(monkeypatch, draw):
    monkeypatch.setattr(pieces, "MOST_PAIRS", 5)
    texts = [sentence(draw, 30)]
    v = pieces.Vocabulary(pieces.model_pieces(_path()), True)
    assert v.encode(texts)[0].tolist() == library().encode(texts)[0]


def test_repeated_rows_and_ids(make_docs):
    out = pieces.encode(make_docs(["one two"] * 3 + [None], ids=[4, 4, None, None])).collect()
    assert sorted(len(r.ids) for r in out)[0] == 0 and len(out) == 4 and len({tuple(r.ids) for r in out}) == 2


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_the_library_on_the_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").toPandas()
    got = {r.doc_id: r for r in queries.QUERIES["op2_sentencepiece"](spark, f"/root/testdata/{sf}").collect()}
    assert len(got) == len(docs)
    for i, ids in zip(docs.doc_id, library().encode(docs.text.tolist()), strict=True):
        assert list(got[i].ids) == ids and got[i].n_pieces == len(ids) and got[i].round_trip
