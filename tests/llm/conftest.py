"""Small corpora for the corpus operators."""

from __future__ import annotations

import random

import pytest

SYLLABLES = "an be ca do er fi go hu in jo ka le mo no or pe qui ra so tu".split()


class Writer:
    """Invented prose, the same for a seed."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, n: int) -> list[str]:
        return [self.word() for _ in range(n)]

    def text(self, n: int) -> str:
        out = []
        while len(out) < n:
            s = self.words(self.r.randint(4, 14))
            out += [s[0].capitalize(), *s[1:-1], s[-1] + self.r.choice([".", ".", "!", ".\n"])]
        return " ".join(out)

    def edited(self, text: str, share: float) -> str:
        return " ".join(self.word() if self.r.random() < share else w for w in text.split(" "))


@pytest.fixture
def writer():
    return Writer(7)


@pytest.fixture
def docs_of(spark):
    def make(texts: dict | list):
        rows = list(texts.items()) if isinstance(texts, dict) else list(enumerate(texts))
        return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    return make
