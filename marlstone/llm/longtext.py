"""Word passes over texts of any length in bounded memory: stretch by stretch, words as 64-bit hashes.

A list of a text's words takes some ten times the text's size. Texts above
``LONG`` characters are read in stretches that end at white space, and what must
be remembered of all of their words is one number each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import xxhash

#: Characters from which a text is read in stretches, and of one stretch.
LONG = 1 << 20
STRETCH = 1 << 18
_SPACE = re.compile("[\x09-\x0d\x20]")
_LINE = re.compile("\n")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def stretches(text: str, end: re.Pattern = _SPACE) -> Iterator[str]:
    """The text in order, in stretches of about ``STRETCH`` characters, each from where ``end`` matches; a short one whole."""
    at = 0
    while len(text) - at > max(LONG, STRETCH):
        cut = end.search(text, at + STRETCH)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def counted(text: str, words_of: Callable[[str], list[str]]) -> Counter:
    """How often each word occurs; ``words_of`` must not find words across white space."""
    if len(text) <= LONG:
        return Counter(words_of(text))
    counts: Counter = Counter()
    for part in stretches(text):
        counts.update(words_of(part))
    return counts


def _hashed(parts: Iterator[list[bytes]]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    found = [np.fromiter(map(digest, x), np.uint64, len(x)) for x in parts]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def word_hashes(text: str, lower: bool = False) -> np.ndarray:
    """A hash of each run of other than ASCII white space, in order; ``lower``: A-Z as a-z."""
    raw = (x.encode("utf-8", "surrogatepass") for x in stretches(text))
    return _hashed((x.lower() if lower else x).split() for x in raw)


def line_hashes(text: str) -> np.ndarray:
    """A hash of each line that has a word."""
    return _hashed([y for y in x.encode("utf-8", "surrogatepass").split(b"\n") if y.strip()] for x in stretches(text, _LINE))


def tuples(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` neighbouring words."""
    n = len(words) - k + 1
    if n < 1 or k < 1:
        return words[:0]
    out = words[:n].copy()
    for i in range(1, k):
        out = out * _ODD + words[i : i + n]
    return out


def triples(words: np.ndarray) -> np.ndarray:
    return tuples(words, 3)


def several(hashes: np.ndarray) -> np.ndarray:
    """Does each occur more than once?"""
    order = np.argsort(hashes, kind="stable")
    same = np.diff(hashes[order]) == 0
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def distinct(hashes: np.ndarray) -> int:
    return int((np.diff(np.sort(hashes)) != 0).sum()) + 1 if len(hashes) else 0
