"""Token counts: lengths only, batches balanced by bytes, long texts split where no token can cross.

A text is cut only at a single space between two characters that are neither
spaces nor the library's own space mark. In such a vocabulary no piece has a
space mark after another character, and the mark that the library puts before
a text stands in for the space that the cut removes, so the counts of the
parts add up to the count of the whole. A vocabulary for which that does not
hold is detected when it is loaded and its texts stay whole.

Null and empty texts have no tokens. Very long texts are counted whole, in parts
of about ``SPLIT_CHARS`` where that is safe. A text of just ``LIMIT_TOKENS`` tokens is
not over the limit. Rows with a null id are counted like any other. Repeated
rows give repeated results, an empty table an empty one. Columns of other names
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from marlstone.llm._common import map_texts

#: Bytes encoded in one call, and the length beyond which a text is split.
CALL_BYTES = 1 << 20
SPLIT_CHARS = 1 << 16
LIMIT_TOKENS = 4096

_LOADED: dict[str, tuple] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def split_safely(text: str, size: int = SPLIT_CHARS) -> list[str]:
    """Parts of about ``size`` characters whose token counts add up to the whole's."""
    if len(text) <= size:
        return [text]
    parts, start, safe = [], 0, re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")
    while len(text) - start > size:
        cut = safe.search(text, start + size)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.end()
    parts.append(text[start:])
    return parts


def _load(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """A function from texts to token counts, and whether texts may be split."""
    if path in _LOADED:
        return _LOADED[path]
    if path.endswith(".model"):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (library.id_to_piece(i) for i in range(library.get_piece_size()))
        whole = any("▁" in p.lstrip("▁") for p in pieces)
        # without the mark put before a text, the part after a cut would lose its space
        prefix = library.decode(library.encode("a")) == "a" and library.encode("a", out_type=str)[0].startswith("▁")
        found = (lambda xs: [len(x) for x in library.encode(xs, num_threads=1)]), prefix and not whole
    else:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        found = (lambda xs: [len(x.ids) for x in library.encode_batch(xs, add_special_tokens=False)]), False
    _LOADED[path] = found
    return found


def counter(name: str) -> Callable[[list[str]], list[np.ndarray]]:
    count, may_split = _load(name if "/" in name else tokenizer_path(name))

    def run(texts: list[str]) -> list[np.ndarray]:
        n_bytes = np.fromiter((len(t.encode("utf-8")) for t in texts), np.int64, len(texts))
        tokens = np.zeros(len(texts), np.int64)
        call: list[str] = []
        owner: list[int] = []
        held = 0

        def flush() -> None:
            if call:
                np.add.at(tokens, owner, count(call))
                call.clear()
                owner.clear()

        for i, text in enumerate(texts):
            for part in split_safely(text) if may_split else [text]:
                call.append(part)
                owner.append(i)
                held += len(part.encode("utf-8"))
                if held >= CALL_BYTES:
                    flush()
                    held = 0
        flush()
        return [n_bytes, tokens]

    return run


def count_tokens(df: DataFrame, tokenizer: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens of every row; ``tokenizer`` is a public file's name or a path."""
    return map_texts(df, lambda: counter(tokenizer), "n_bytes long, n_tokens long", id_col, text_col)
