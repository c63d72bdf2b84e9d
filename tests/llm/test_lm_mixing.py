"""The fast forms of context mixing against plain ones."""

from __future__ import annotations

import numpy as np

from quantloom.llm import lm_scoring as lm


def test_pairs_count_like_single_tokens():
    rng = np.random.default_rng(5)
    context, code = rng.integers(0, 1 << 32, 40, dtype=np.uint32)[rng.integers(0, 40, 5000)], rng.integers(0, 1 << 13, 5000).astype(np.int32) >> 9
    a, b, n = lm._pairs(context, code)
    want: dict[tuple[int, int], int] = {}
    for pair in zip(context.tolist(), code.tolist(), strict=True):
        want[pair] = want.get(pair, 0) + 1
    assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == want and len(a) == len(want)
    assert [len(x) for x in lm._pairs(context[:0], code[:0])] == [0, 0, 0]


def test_lanes_in_step_order_equal_one_token_after_the_other(monkeypatch):
    monkeypatch.setattr(lm, "PART", 7)
    rng = np.random.default_rng(6)
    for follows in (False, True):
        size = np.array([3, 9, 1, 6])
        n, begin = size.sum(), np.cumsum(size) - size
        tree = rng.uniform(0.2, 0.8, 1 << lm.CODE_BITS).astype(np.float32)
        tables = rng.integers(0, 9, (lm.CONTEXTS + lm.LETTERS, 1 << lm.TABLE_BITS, 2)).astype(np.float32)
        tables[:, :, 1] += tables[:, :, 0]
        model = lm.LanguageModel(1, 1, 1, None, None, None, None, None, tables, None, None)
        code, predicted = (rng.integers(0, 1 << lm.CODE_BITS, n).astype(np.int32) for _ in range(2))
        predicted = np.where(rng.random(n) < 0.5, code, predicted)
        contexts = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for _ in range(lm.CONTEXTS)]
        known, trust = rng.random(n) < 0.8, rng.integers(0, len(lm.FOLLOWED), n) * follows
        found = lm._mixed_lanes(model, tree, lm._stretch(tree), code, contexts, known, predicted, trust, begin, size)
        many = lm.CONTEXTS + 1 + follows
        for b, s in zip(begin, size, strict=True):
            weights = np.tile(lm.START[:many].astype(float), (lm.GATES, lm.CODE_BITS, 1))
            for i in range(b, b + s):
                x, sign = np.zeros((lm.CODE_BITS, many)), np.zeros(lm.CODE_BITS)
                for k in range(lm.CODE_BITS):
                    node, bit = lm._nodes(code[i : i + 1], lm.CODE_BITS, k)
                    sign[k] = bit[0]
                    p = float(tree[node[0]])
                    x[k, 0] = lm._stretch(np.float32(p))
                    for j in range(lm.CONTEXTS):
                        ones, both = tables[j, lm._slots(contexts[j][i : i + 1], node)[0]].tolist()
                        p = (ones + lm.SMOOTH[j] * p) / (both + lm.SMOOTH[j])
                        x[k, j + 1] = lm._stretch(np.float32(p))
                    ahead, bit = lm._nodes(predicted[i : i + 1], lm.CODE_BITS, k)
                    if follows and ahead[0] == node[0]:
                        x[k, -1] = np.log((1 + lm.FOLLOWED[trust[i]]) / (1 - lm.FOLLOWED[trust[i]])) * (2 * bit[0] - 1)
                gate = 2 + trust[i] if trust[i] else (both > 0.5) + (both > 3.5)
                dot = (x * weights[gate]).sum(1)
                assert np.isclose(found[i], -np.log1p(np.exp(np.where(sign > 0, -dot, dot))).sum(), atol=1e-3)
                weights[gate] += (known[i] * lm.RATE * (sign - 1 / (1 + np.exp(-dot))))[:, None] * x
