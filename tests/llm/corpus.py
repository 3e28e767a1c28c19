"""Small corpora for the tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, key long"


def sentence(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def vocabulary(rng: random.Random, n: int = 400, letters: str = "abcdefghijklmnopqrstuvwxyz") -> list[str]:
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n)]


def table(spark, texts, langs=None, ids=None):
    """documents with columns whose names clash with those of the operators."""
    rows = [(i if ids is None else ids[i], t, None if langs is None else langs[i], "s", len(t) if t is not None else None, 0.5, 1, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)
