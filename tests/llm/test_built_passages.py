"""Different passages that are built to share a polynomial hash are no repeats of each other."""

from __future__ import annotations

import random

import numpy as np

from quantloom.llm import suffix_dedup
from quantloom.llm import text as tx
from tests.llm import brute

WORDS = "jvab", "ybfz"  # their hashes agree in their last 25 bits


def _built() -> list[str]:
    """The Thue-Morse sequence of 64 words, and the same with the words exchanged."""
    turns = [k.bit_count() & 1 for k in range(64)]
    return ["".join(WORDS[t ^ x] for t in turns) for x in (0, 1)]


def test_built_passages_stay(spark):
    hashes = [tx.prefix_hashes(np.frombuffer(t.encode(), np.uint8))[-1] for t in _built()]
    assert hashes[0] == hashes[1]
    rng = random.Random(4)
    texts = []
    for _ in range(120):
        before, after = ("".join(rng.choices("abcdefgh ", k=600)) for _ in range(2))
        texts += [before + t + after for t in _built()]
    found = suffix_dedup.digest(suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 400))
    assert [tuple(r)[1:] for r in found.orderBy("doc_id").collect()] == brute.repeats(texts, 400)
