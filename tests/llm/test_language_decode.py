"""The language decoder against a plain one, on many languages in bounded memory, and with tied codewords."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np

from quantloom.llm import language_id


def plain(model: language_id.LanguageModel, margin: np.ndarray) -> list[tuple]:
    out = []
    for m in margin.tolist():
        losses = []
        for word in model.code.tolist():
            each = [t * (math.log1p(math.exp(-abs(x))) + max(0.0, -x if bit else x)) for x, bit, t in zip(m, word, model.trust.tolist(), strict=True)]
            losses.append(sum(each) / len(m))
        shares = [math.exp(min(losses) - x) for x in losses]
        shares = [s / sum(shares) for s in shares]
        order = sorted(range(len(shares)), key=lambda i: (-shares[i], i))
        out.append((order[0], shares[order[0]], shares[order[0]] - (shares[order[1]] if len(order) > 1 else 0)))
    return out


def model_of(languages: int, seed: int = 1) -> language_id.LanguageModel:
    code = language_id.codewords(languages).astype(float)
    rng = np.random.default_rng(seed)
    return language_id.LanguageModel(tuple(f"l{i:04}" for i in range(languages)), code, np.zeros((8, code.shape[1])), rng.uniform(0.2, 2, code.shape[1]))


def test_plain_decoder():
    rng = np.random.default_rng(2)
    for languages in (1, 2, 4, 30):
        model = model_of(languages)
        margin = rng.normal(0, 30, (50, model.code.shape[1])) * rng.choice([0, 0.1, 1], (50, 1))
        for at_once in (7, 256):
            for got, want in zip(zip(*language_id.decode(model, margin, at_once), strict=True), plain(model, margin), strict=True):
                assert np.allclose(got[1:], want[1:], atol=1e-12) and (got[0] == want[0] or want[2] < 1e-12)


def test_tied_codewords():
    model = language_id.LanguageModel(("a", "b", "c"), np.array([[0.0, 1], [1, 0], [1, 0]]), np.zeros((8, 2)), np.ones(2))
    choice, score, apart = language_id.decode(model, np.array([[5.0, -5.0], [0.0, 0.0]]))
    assert choice.tolist() == [1, 0] and apart.tolist() == [0, 0] and abs(score[1] - 1 / 3) < 1e-12


def test_no_language():
    model = language_id.LanguageModel((), np.zeros((0, 1)), np.zeros((8, 1)), np.ones(1))
    assert [x.tolist() for x in language_id.decode(model, np.zeros((2, 1)))] == [[0, 0], [0, 0], [0, 0]]


def test_many_languages_in_bounded_memory():
    model = model_of(500)
    margin = np.random.default_rng(3).normal(0, 10, (4096, model.code.shape[1]))
    tracemalloc.start()
    language_id.decode(model, margin)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
