"""Pieces that two runs of one document make at the same place are no repeats of each other."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import zstandard

from quantloom.llm import suffix_dedup


def _removed(text: bytes, width: int) -> int:
    places: dict[bytes, list[int]] = {}
    for p in range(len(text) - width + 1):
        places.setdefault(text[p : p + width], []).append(p)
    return len({b for own in places.values() if len(own) > 1 for p in own for b in range(p, p + width)})


def test_periodic_passages_end_where_they_end(spark):
    rng = random.Random(3)
    other = lambda: "".join(rng.choices("bcdfgklm ", k=500))
    word = lambda n: "".join(rng.choices("aeiou", k=n - 2)) + ", "
    texts = [other() + (word(n) * 120)[:size] + other() for n in (4, 8, 12, 16) for size in range(400 + n, 440, 3)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 400).toPandas().set_index("doc_id")["n_removed"]
    assert [int(found[i]) for i in range(len(texts))] == [_removed(t.encode(), 400) for t in texts]


def test_a_run_cut_in_two_makes_each_piece_once():
    data = np.random.default_rng(1).integers(97, 123, 900, dtype=np.uint8).tobytes()
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("lo", "hi", "a")]))
    runs = [[{"lo": 100, "hi": 127, "a": 300}, {"lo": 128, "hi": 190, "a": 300}]]
    names, rows = ["doc_id", "text_key", "text", "runs"], [pa.array([1]), pa.array([2]), pa.array([zstandard.compress(data)])]
    (out,) = suffix_dedup._third_digits(400, 128)(iter([pa.record_batch([*rows, pa.array(runs, kind)], names)]))
    (whole,) = suffix_dedup._third_digits(400, 128)(iter([pa.record_batch([*rows, pa.array([[{"lo": 100, "hi": 190, "a": 300}]], kind)], names)]))
    assert out.equals(whole)
