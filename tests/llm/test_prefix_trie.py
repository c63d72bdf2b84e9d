"""The prefix trie against a plain one, with long, hot, equal and odd conversations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quantloom.llm import prefix_trie, queries
from tests.conftest import SF
from tests.oracle import connect


def plain_trie(rows: list[tuple]) -> list[tuple]:
    """The contract on Python objects; ties of a turn by digest, as the operator says."""
    own: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()[:30]
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(np.fmod(c, 20))
        rebuilt[c] = tuple(turns.get(c - base, [])[:h] + v[h:])
    members: dict[tuple, list] = {}
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids: dict[tuple, list] = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids.get(node, []))
        leaves[node] = sum(leaves[k] for k in kids.get(node, [])) or 1
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if rebuilt[c] == node)
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def check(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth long, words string").repartition(3)
    found = prefix_trie.prefix_trie(table, **options)
    assert found.columns == list(COLUMNS)
    assert sorted(map(tuple, found.collect()), key=str) == plain_trie(rows)


def talk(rng: random.Random, convs: int, turns: int, texts: int) -> list[tuple]:
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, turns)):
            rows.append((c, t, rng.choice(["user", "assistant"]), " ".join(["hi\n"] * rng.randrange(texts))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rows = talk(rng, 120, 7, 2 + seed)
    rows += [(c, t, None if t % 3 else "user", None) for c in range(-45, 0) for t in range(4)]
    rng.shuffle(rows)
    check(spark, rows, hot=1 << seed)


def test_long_and_hot(spark, monkeypatch):
    """A conversation over several chunks, its copies, and one that leaves it late."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)  # the driver's value goes to the tasks with the function
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    long = [(t, "user" if t % 2 else "assistant", f"turn {t % 7} of many") for t in range(2500)]
    rows = [(c, *t) for c in (40, 41, 47) for t in long] + [(60, *t) for t in long[:1700]] + [(61, *t) for t in long[:1690]] + [(61, 9999, "user", "bye")]
    rows += [(c, 0, "user", "hello there") for c in range(1000, 1400)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(0, None, "user", "null turn first"), (0, 0, None, None), (0, 0, "", ""), (0, 0, "", ""), (1, 5, "a", "b:c"), (2, 5, "a:b", "c"), (3, 1, "user", "x  y\t z"), (None, 0, "user", "nobody's")]
    rows += [(5, 1, "user", "same")] * 5 + [(6, 1, "user", "same")] * 5 + [(23, 0, "user", "no base"), (2**62, 0, "user", "far"), (-(2**62), 0, "user", "far")]
    check(spark, rows)
    check(spark, [(c, 0, "user", "alone") for c in (3, 4, 7)])  # turnless once rebuilt, some of them
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")).count() == 0


def test_hash_arithmetic():
    rng = random.Random(1)
    p = prefix_trie.PRIME
    a, b = ([rng.choice([0, 1, p - 1, rng.randrange(p)]) for _ in range(300)] for _ in range(2))
    assert prefix_trie.times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % p for x, y in zip(a, b, strict=True)]
    at = [0, 1, 4095, 4096, 123456789]
    assert prefix_trie.powers(prefix_trie.BASES[0], np.array(at)).tolist() == [pow(prefix_trie.BASES[0], k, p) for k in at]


def test_query(spark):
    found, sql = queries.op13_prefix_trie(spark, SF), connect(SF).sql(queries.OP13_SQL)
    assert sorted(found.columns) == sorted(sql.columns)
    assert sorted(map(tuple, found.select(*sql.columns).collect()), key=str) == sorted(sql.fetchall(), key=str)
