"""Fixtures of the training-data tests: documents with nulls, repeats and columns whose names clash with internal ones."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, n_chars long, _text string, n long, k1 long, hi long, start long, row_hash long, part int, piece int"


def frame(spark, rows, parts=3):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None if r[1] is None else len(r[1]), "x", 1, 2, 3, 4, 5, 6, 7) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join("w" + str(rng.randrange(vocabulary)) for _ in range(words))
