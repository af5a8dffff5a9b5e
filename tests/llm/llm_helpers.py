"""Texts for the operators' tests."""

import random

#: Texts that every operator must take: null, empty, blank, symbols, other scripts, one word, very long, repeated.
ODD = [None, "", "  \n\t ", "!!! ### $$$", "日本語のテキスト 😀", "word", "x" * 5000, "again and " * 3000, "\n\n\n", "a b c", "▁ literal mark"]


def sentence(draw: random.Random, n: int) -> str:
    words = ["the", "stone", "river", "under", "quiet", "hill", "of", "and", "north", "wind", "carries", "old", "songs", "to", "valley", "lamp", "seven", "doors"]
    return " ".join(draw.choice(words) + draw.choice(["", "", "s", "ing", str(draw.randrange(50))]) for _ in range(n))
