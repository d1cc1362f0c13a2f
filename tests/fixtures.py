"""Small inputs with known answers."""

import numpy as np


def planted_groups(seed: int = 42) -> list[tuple[int, list[float], int]]:
    """Rows ``(doc_id, embedding, truth)``: four Gaussian groups (200, 120, 60, 8) and 40 uniform points, for tests."""
    rng = np.random.default_rng(seed)
    rows, doc = [], 0
    for group, size in enumerate((200, 120, 60, 8)):
        centre = np.zeros(16)
        centre[group] = 10.0
        for x in rng.normal(centre, 0.5, (size, 16)):
            rows.append((doc, x.tolist(), group))
            doc += 1
    for x in rng.uniform(-10, 20, (40, 16)):
        rows.append((doc, x.tolist(), -1))
        doc += 1
    return rows


TINY = [
    (0, 0, "care home visit care"),
    (1, 0, "care home money"),
    (2, 1, "memory clinic test"),
    (3, 1, "memory memory loss care"),
    (4, -1, "hello world"),
]

WORD_LISTS = [["care", "home", "visit"], ["care", "memory", "loss"], ["memory", "clinic", "care"], ["money", "home", "care"]]


def tiny(spark):
    return spark.createDataFrame(TINY, "doc_id bigint, topic int, document string")


def listed(spark):
    rows = [(t, r + 1, w) for t, words in enumerate(WORD_LISTS) for r, w in enumerate(words)]
    return spark.createDataFrame(rows, "topic int, rank int, word string")


def planted_vocabulary(seed: int = 42) -> list[tuple[int, str, int]]:
    """Rows ``(doc_id, document, truth)``: three vocabularies of 20 words, 60 documents of 30 words each."""
    rng = np.random.default_rng(seed)
    rows = []
    for doc in range(180):
        truth = doc // 60
        words = [f"{'abc'[truth]}word{i:02d}" for i in rng.integers(0, 20, 30)]
        rows.append((doc, " ".join(words), truth))
    return rows
