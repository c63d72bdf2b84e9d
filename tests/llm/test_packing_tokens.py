"""Ids of pre-tokens that only go through the tokenizer's model."""

from __future__ import annotations

import public_tokenizers

from quantloom.llm import packing

TEXTS = [
    "", " ", "İstanbul ŉ ß ſ", "it's ''s 's's we'll'd", "a\tb\r\nc 12345 ¡¿½²³ ªº µ ÿ Ÿ ɏ </w> w</w>", "é" * 3000, "x" * 5000, "\x00\x01 a", "日本語 текст", "a <|endoftext|> b",
    "".join(map(chr, range(32, 0x250))), "".join(f"{chr(c)} {chr(c)}a" for c in range(0xA1, 0x250)), " ".join(f"w{i}ord" for i in range(3 * packing.MODEL_WORDS)),
]


def test_new_words_of_plain_texts_only_go_through_the_model():
    words = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want = [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in words.whole.encode_batch(TEXTS, add_special_tokens=False)]
    assert words.encode(TEXTS) == want and words.encode(TEXTS[::-1]) == want[::-1]
    seen: list[str] = []
    whole = words._encode
    words._encode = lambda texts: seen.extend(texts) or whole(texts)
    plain = ["Plain words, naïve Ünïcode and 42 n'ames"]
    want = words.whole.encode(plain[0], add_special_tokens=False).ids
    assert words.encode(plain) == [b"".join(i.to_bytes(4, "little") for i in want)] and not seen


def test_a_model_that_does_not_close_words_falls_back():
    words = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want = words.encode(["three new words"])
    words.known.clear()
    words.closes[:] = False
    assert words.encode(["three new words"]) == want
