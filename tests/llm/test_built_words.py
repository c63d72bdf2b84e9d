"""Two different words that a polynomial modulo 2**64 takes for one: they must not link, hit or count as one."""

from __future__ import annotations

import numpy as np
import pytest

from quantloom.llm import decontaminate, lm_scoring, near_dedup
from quantloom.llm import text as tx


def pair(bits: int) -> tuple[str, str]:
    """A Thue-Morse word of 2**bits letters, and its complement."""
    ones = [bin(i).count("1") % 2 for i in range(1 << bits)]
    return "".join("ab"[x] for x in ones), "".join("ba"[x] for x in ones)


@pytest.mark.parametrize("bits", [6, 7, 8, 9, 10, 12])
def test_hashes_differ(bits):
    buf = np.frombuffer(" ".join(pair(bits)).encode(), np.uint8)
    n = 1 << bits
    a, b = tx.span_hashes(buf, np.array([0, n + 1]), np.array([n, 2 * n + 1]))
    assert a != b


def test_operators(spark):
    one, other = pair(10)
    docs = spark.createDataFrame([(0, one), (1, other), (2, one), (3, f"x {one} y"), (4, f"x {other} y")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, shingle=4, percent=80).collect()}
    assert found == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}
    items = spark.createDataFrame([("i", one)], "item_id string, text string")
    hits = {r["doc_id"]: r["n_hit"] for r in decontaminate.find_contamination(docs, items).collect()}
    assert hits == {0: 1, 1: 0, 2: 1, 3: 1, 4: 0}
    scored, _ = lm_scoring.score_documents(docs, ~docs["doc_id"].isin(1, 4))
    assert {r["doc_id"]: r["n_known"] for r in scored.collect()} == {0: 2, 1: 1, 2: 2, 3: 4, 4: 3}
