"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton is built over the pieces' bytes, with the space mark as one byte.
At each position its state names the longest piece that ends there, and output
links lead on to the shorter ones; each relaxes the best score of the
position from that of the piece's start. Characters that are no piece become
byte pieces.

What a path scores depends on the model's kind. Of a unigram model a piece has
the score of the model file, and unknown characters one below all of them; ties
go to the longer last piece. Of a BPE model the file's scores are the order of
merging and no log-probabilities, so adding them up would give another
segmentation. There a piece costs nothing after a piece that merging would
leave beside it, and is barred after any other. Every prefix of a text has
one end piece that merging gives it, and a path is what merging gives if and
only if each two neighbours are, so just one path to each position is open, and
it is the library's own encoding. Whether merging leaves two pieces alone is
worked out by merging their characters, once a pair.

Where no piece has a space mark after another character, as in the usual
vocabularies, a boundary lies before every run of spaces, so texts are cut
there and each distinct segment is segmented once per batch, all segments in
lock step in numpy. Long segments go through the same automaton one by one.

Null and empty texts have no pieces. A text that holds the space mark itself
decodes to one with spaces, as in the library. Texts of any length are encoded
whole, some ``CHUNK_BYTES`` at a time. Rows are independent, so repeated rows and
ids give repeated results, an empty table an empty one, and columns of any other
name are not read.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._common import map_texts

MARK = "▁"
#: Segments of more bytes than this are not put in the matrix; text bytes and matrix cells worked on at once.
LONG = 64
CHUNK_BYTES = 4 << 20
CELLS = 1 << 20
#: Pairs of pieces remembered, some 100 bytes each.
MOST_PAIRS = 1 << 19
_LOADED: dict[str, Vocabulary] = {}


class _Pairs(dict):
    """By left * size + right: 0 if merging the two pieces' characters ends with these two, else minus infinity.

    A left piece of -1 is the start of a text or an unknown character, across which nothing merges.
    """

    def __init__(self, bytes_of: list[bytes], order: dict[bytes, float]) -> None:
        self.bytes_of, self.order, self.size = bytes_of, order, len(bytes_of)

    def __missing__(self, key: int) -> float:
        if len(self) >= MOST_PAIRS:
            self.clear()
        left, right = divmod(key, self.size)
        want = [self.bytes_of[i] for i in (left, right) if i >= 0]
        self[key] = x = 0.0 if merge(b"".join(want), self.order) == want else -math.inf
        return x

    def between(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        return np.fromiter(map(self.__getitem__, keys.tolist()), float, len(keys))


def merge(text: bytes, order: dict[bytes, float]) -> list[bytes]:
    """The text's characters with the two neighbours joined, again and again, whose union comes first in order; the leftmost of equals."""
    parts = [c.encode() for c in text.decode()]
    while True:
        found = [(order[x], -i) for i, x in enumerate(map(bytes.__add__, parts, parts[1:])) if x in order]
        if not found:
            return parts
        i = -max(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


class Vocabulary:
    """Pieces, scores and the automaton. ``pieces``: (text, score, kind) by id; kind: normal, byte, unknown or control.

    merging: the scores are an order of merging, as in BPE models, the highest first.
    """

    def __init__(self, pieces: Iterable[tuple[str, float, str]], merging: bool = False) -> None:
        listed = list(pieces)
        self.bytes_of = [b"" for _ in listed]
        self.byte_id = np.full(256, -1, np.int32)
        self.unknown = 0
        normal: dict[bytes, int] = {}
        for i, (text, _, kind) in enumerate(listed):
            if kind == "byte":
                value = int(text[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of[i] = bytes([value])
            elif kind == "unknown":
                self.unknown = i
                self.bytes_of[i] = " ⁇ ".encode()
            elif kind == "normal":
                self.bytes_of[i] = text.replace(MARK, " ").encode()
                normal.setdefault(self.bytes_of[i], i)
        self.byte_id[self.byte_id < 0] = self.unknown
        self.splits = not any(b" " in p.lstrip(b" ") for p in normal)
        self.merging = merging
        self.pairs = _Pairs(self.bytes_of, {x: listed[i][1] for x, i in normal.items()})
        scores = [listed[i][1] for i in normal.values()]
        self.unknown_score = 0.0 if merging else min(scores, default=0.0) - 10
        self._build(normal, [0.0 if merging else s for _, s, _ in listed])
        sizes = np.fromiter(map(len, self.bytes_of), np.int64, len(listed))
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.blob_size = sizes
        self.blob_start = np.cumsum(sizes) - sizes

    def _build(self, normal: dict[bytes, int], scores: list[float]) -> None:
        children: list[dict[int, int]] = [{}]
        ends: dict[int, tuple[int, int]] = {}
        for piece, i in normal.items():
            node = 0
            for b in piece:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                node = nxt
            ends[node] = (i, len(piece))
        n = len(children)
        self.step = np.zeros((n, 256), np.int32)
        fail = np.zeros(n, np.int32)
        self.piece, self.size, self.score = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n)
        for node, (i, size) in ends.items():
            self.piece[node], self.size[node], self.score[node] = i, size, scores[i]
        #: output: the node itself or the nearest one on its failure path that ends a piece (0: none); link: the one after that.
        self.output, self.link = np.zeros(n, np.int32), np.zeros(n, np.int32)
        queue: deque[int] = deque()
        for b, node in children[0].items():
            self.step[0, b] = node
            queue.append(node)
            self.output[node] = node if node in ends else 0
        while queue:
            node = queue.popleft()
            row = self.step[fail[node]].copy()
            for b, child in children[node].items():
                fail[child] = row[b]
                row[b] = child
                queue.append(child)
                after = self.output[fail[child]]
                self.output[child] = child if child in ends else after
                self.link[child] = after
            self.step[node] = row

    def _single(self, segment: bytes) -> list[int]:
        """One segment, position by position."""
        n = len(segment)
        best = [0.0] + [-np.inf] * n
        back: list[tuple[int, int]] = [(-1, 0)] * (n + 1)
        state, char = 0, 0
        for t, b in enumerate(segment):
            state = int(self.step[state, b])
            if b & 0xC0 != 0x80:
                char = t
            out, known = int(self.output[state]), False
            while out:
                size, piece = int(self.size[out]), int(self.piece[out])
                x = best[t + 1 - size] + self.score[out]
                if self.merging and x > best[t + 1]:
                    x += self.pairs[back[t + 1 - size][0] * self.pairs.size + piece]
                if x > best[t + 1]:
                    best[t + 1], back[t + 1] = x, (piece, size)
                known |= t + 1 - size == char
                out = int(self.link[out])
            if not known and (t + 1 == n or segment[t + 1] & 0xC0 != 0x80):
                x = best[char] + self.unknown_score
                if x > best[t + 1]:
                    best[t + 1], back[t + 1] = x, (-1, t + 1 - char)
        ids: list[int] = []
        while n:
            piece, size = back[n]
            ids.extend([piece] if piece >= 0 else self.byte_id[list(segment[n - size : n])][::-1].tolist())
            n -= size
        return ids[::-1]

    def _lockstep(self, segments: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Short segments, sorted by falling size, at once: (ids of all, count of each)."""
        n, width = len(segments), int(sizes[0])
        text = np.frombuffer(b"".join(s.ljust(width + 1, b"\0") for s in segments), np.uint8).reshape(n, width + 1)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        piece = np.full((n, width + 1), -1, np.int32)
        back = np.zeros((n, width + 1), np.int32)
        state, char = np.zeros(n, np.int32), np.zeros(n, np.int32)
        live = np.searchsorted(-sizes, -np.arange(width), side="left")  # segments longer than t
        for t in range(width):
            k = int(live[t])
            b = text[:k, t]
            state = self.step[state[:k], b]
            char = np.where(b & 0xC0 != 0x80, t, char[:k])
            known = np.zeros(k, bool)
            out = self.output[state]
            rows = np.nonzero(out)[0]
            out = out[rows]
            while len(rows):
                size = self.size[out]
                x = best[rows, t + 1 - size] + self.score[out]
                if self.merging:
                    open_ = np.nonzero(x > best[rows, t + 1])[0]
                    x[open_] += self.pairs.between(piece[rows[open_], t + 1 - size[open_]], self.piece[out[open_]])
                up = x > best[rows, t + 1]
                to = rows[up]
                best[to, t + 1], piece[to, t + 1], back[to, t + 1] = x[up], self.piece[out[up]], size[up]
                known[rows[t + 1 - size == char[rows]]] = True
                out = self.link[out]
                more = out > 0
                rows, out = rows[more], out[more]
            ends = (text[:k, t + 1] & 0xC0 != 0x80) | (sizes[:k] == t + 1)
            rows = np.nonzero(ends & ~known)[0]
            if len(rows):
                x = best[rows, char[rows]] + self.unknown_score
                up = x > best[rows, t + 1]
                to = rows[up]
                best[to, t + 1], piece[to, t + 1], back[to, t + 1] = x[up], -1, t + 1 - char[to]
        # back from the ends, the last piece of every segment first
        at, rows = sizes.astype(np.int32), np.arange(n)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            p, size = piece[rows, at], back[rows, at]
            found.append((rows[p >= 0], p[p >= 0]))
            if (u := p < 0).any():
                for j in range(1, int(size[u].max()) + 1):
                    has = u & (size >= j)
                    found.append((rows[has], self.byte_id[text[rows[has], at[has] - j]]))
            at = at - size
            rows, at = rows[at > 0], at[at > 0]
        owner, ids = (np.concatenate(x)[::-1] for x in zip(*found, strict=True))
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=n)

    def _segmented(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, count): where the ids of each segment are."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        order = np.argsort(-sizes, kind="stable")
        start, count = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
        parts, at, k = [], 0, 0
        while k < len(order):
            i = order[k]
            if sizes[i] > LONG:
                ids = np.array(self._single(segments[i]), np.int32)
                start[i], count[i] = at, len(ids)
                k += 1
            else:
                rows = order[k : k + max(1, CELLS // int(sizes[i]))]
                ids, each = self._lockstep([segments[j] for j in rows.tolist()], sizes[rows])
                count[rows] = each
                start[rows] = at + np.cumsum(each) - each
                k += len(rows)
            parts.append(ids)
            at += len(ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), start, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, count of each)."""
        return self.encode_marked([marked(t) if t else b"" for t in texts])

    def encode_marked(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        index: dict[bytes, int] = {}
        used: list[int] = []
        per_text = np.zeros(len(raws), np.int64)
        for i, raw in enumerate(raws):
            found = _SEGMENT.findall(raw) if self.splits else [raw] if raw else []
            per_text[i] = len(found)
            used += [index.setdefault(s, len(index)) for s in found]
        ids, start, count = self._segmented(list(index))
        at = np.array(used, np.int64)
        lengths = count[at]
        stops = np.cumsum(lengths)
        out = ids[np.repeat(start[at] - (stops - lengths), lengths) + np.arange(int(stops[-1]) if len(stops) else 0)]
        bounds = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(per_text)])]
        return out, np.diff(bounds)

    def decode_marked(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        sizes = self.blob_size[ids]
        stops = np.cumsum(sizes)
        raw = self.blob[np.repeat(self.blob_start[ids] - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)].tobytes()
        bounds = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]  # noqa: B905  pairs

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids; the space put before a text is taken away again."""
        return [(x[1:] if x[:1] == b" " else x).decode("utf-8", "replace") for x in self.decode_marked(ids, counts)]


_SEGMENT = re.compile(rb" *[^ ]+| +")


def marked(text: str) -> bytes:
    """The text as the automaton reads it: a space in front, and spaces for marks."""
    return b" " + text.replace(MARK, " ").encode("utf-8", "surrogatepass")


def model_pieces(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id, from a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) or sp.is_unused(i) else "normal"
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


def is_merging(path: str) -> bool:
    """Is the model file one of BPE?"""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model.trainer_spec.model_type == model.trainer_spec.BPE


def load(tokenizer: str) -> Vocabulary:
    """The vocabulary of a public file's name or a path, kept for the life of a worker."""
    if tokenizer not in _LOADED:
        path = tokenizer
        if "/" not in tokenizer:
            import public_tokenizers

            path = str(public_tokenizers.path(tokenizer))
        _LOADED[tokenizer] = Vocabulary(model_pieces(path), is_merging(path))
    return _LOADED[tokenizer]


_CUT = re.compile(rb"(?<=[^ ]) ")


def _chunks(texts: list[str], splits: bool) -> Iterator[tuple[list[int], list[bytes]]]:
    """Marked texts and whose they are, some ``CHUNK_BYTES`` at a time; a longer text in parts, each from a run of spaces on."""
    owners: list[int] = []
    raws: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        raw, at = marked(text) if text else b"", 0
        while at < len(raw):
            cut = _CUT.search(raw, at + CHUNK_BYTES) if splits and len(raw) - at > CHUNK_BYTES else None
            stop = cut.start() if cut else len(raw)
            owners.append(i)
            raws.append(raw[at:stop])
            size += stop - at
            at = stop
            if size >= CHUNK_BYTES:
                yield owners, raws
                owners, raws, size = [], [], 0
    if raws:
        yield owners, raws


def encoder(tokenizer: str) -> Callable[[list[str]], list]:
    vocabulary = load(tokenizer)

    def run(texts: list[str]) -> list:
        n = np.zeros(len(texts), np.int64)
        back = np.array([MARK not in t for t in texts], bool)
        ids = [np.zeros(0, np.int32)]
        for owners, raws in _chunks(texts, vocabulary.splits):
            found, counts = vocabulary.encode_marked(raws)
            ids.append(found)
            np.add.at(n, owners, counts)
            back[[o for o, a, b in zip(owners, vocabulary.decode_marked(found, counts), raws, strict=True) if a != b]] = False
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return [n, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))), back]

    return run


def encode(df: DataFrame, tokenizer: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``carry``, n_pieces, ids and round_trip (decoding gives the text again) of every row."""
    return map_texts(df, lambda: encoder(tokenizer), "n_pieces long, ids array<int>, round_trip boolean", id_col, text_col, carry)


def decoder(tokenizer: str):
    """Column function from an array of ids to the text; null gives null."""
    import pandas as pd

    def run(series: pd.Series) -> pd.Series:
        vocabulary = load(tokenizer)
        given = [np.zeros(0, np.int32) if x is None else np.asarray(x, np.int32) for x in series]
        texts = vocabulary.decode(np.concatenate([np.zeros(0, np.int32), *given]), np.array([len(x) for x in given], np.int64))
        return pd.Series(texts)

    run.__annotations__ = {"series": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(run, "string")
    return lambda column: F.when(F.col(column).isNotNull(), udf(F.col(column)))
