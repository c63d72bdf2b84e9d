"""Packing of token sequences: best-fit decreasing over a segment tree of remaining capacities.

Each Spark task tokenises its own documents and packs them; nothing is shuffled. A task keeps one small
tuple per document (no ids), cuts overlong documents into full windows first, and puts the remainders,
longest first, each into the open sequence with the tightest room.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words whose ids a worker remembers; it starts anew beyond that.
CACHE_WORDS = 400_000

# Below U+0250 lower-casing and the classes of characters are the same for Python and for the tokenizer;
# any other text goes through the tokenizer as a whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-ɏ]*")


def _class(first: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == first)


_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\\s{_class('L')}{_class('N')}]+")


def _byte_letters() -> str:
    """The letter that stands for each byte in the tokenizer's vocabulary: printable ones for themselves, others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


_LETTERS = _byte_letters()
#: Words that go through the model at once.
MODEL_WORDS = 2048


class WordTokenizer:
    """Token ids as little-endian unsigned 32-bit bytes, equal to those of the tokenizer file.

    The file's tokenizer treats every pre-token on its own, so ids are remembered by pre-token. A new pre-token of a plain text is
    normalised and split already, so it only goes through the tokenizer's model.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.model = Tokenizer(self.whole.model)
        vocabulary = self.whole.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens: a run of them goes through the model, and each ends with the id that closes a word."""
        out: list[bytes] = []
        for at in range(0, len(pieces), MODEL_WORDS):
            run = pieces[at : at + MODEL_WORDS]
            letters = [p if p.isascii() else p.encode().decode("latin-1").translate(_LETTERS) for p in run]
            ids = np.array(self.model.encode_batch_fast([letters], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype="<u4")
            ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            if len(ends) != len(run):  # a model without closing ids
                out += self._encode(run)
                continue
            data, begin = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(data[begin:end])
                begin = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [bool(_PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        pieces = [_PIECES.findall(t.lower()) if p else [] for t, p in zip(texts, plain, strict=True)]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        new = list(set().union(*pieces).difference(known))
        known.update(zip(new, self._encode_pieces(new), strict=True))
        get = known.__getitem__
        return [b"".join(map(get, w)) if p else self._encode([t])[0] for t, w, p in zip(texts, pieces, plain, strict=True)]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each file and worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class BestFit:
    """Open sequences by remaining room; a segment tree finds the smallest room that suffices."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest open sequence with need or more room."""
        k = need + self.leaves
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def place(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece of at most size tokens, best-fit decreasing, ties in the given order."""
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    tree, used = BestFit(size), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found, used = (size, used), used + 1
        room, sequence = found
        out[i] = (sequence, size - room)
        if room > lengths[i]:
            tree.put(room - lengths[i], sequence)
    return out


def _pack(path: str, size: int, end_id: int):
    tail = end_id.to_bytes(4, "little")

    def run(batches):
        encode = tokenizer(path).encode
        pieces: list[tuple] = []
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = batch.column(0).to_pylist()
            at = 0
            while at < len(texts):
                to, seen = at, 0
                while to < len(texts) and (to == at or seen + len(texts[to]) <= 1 << 20):
                    seen += len(texts[to])
                    to += 1
                for doc, data in zip(ids[at:to], encode(texts[at:to]), strict=True):
                    data += tail
                    n = len(data) // 4
                    for s in range(0, n, size):
                        own = data[4 * s : 4 * (s + size)]
                        pieces.append((doc, s, len(own) // 4, zlib.crc32(own), n))
                at = to
        first = TaskContext.get().partitionId() << 40
        where = place([p[2] for p in pieces], size)
        for at in range(0, len(pieces), 20_000):
            rows = [(*p, first + s, o) for p, (s, o) in zip(pieces[at : at + 20_000], where[at : at + 20_000], strict=True)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """Packs all documents into sequences of at most size tokens; one row per piece.

    A document's tokens are the tokenizer's ids of its whole text, then end_id; a null or empty text has
    end_id alone. Documents longer than size are cut into full windows and a remainder. Ties between equal
    lengths go by input order. Repeated rows and null doc_ids are documents of their own. An empty table
    gives no rows. Sequence ids are unique over all tasks (the task's number in the upper bits); offsets in
    a sequence are gapless from 0. Only doc_id and text are read.
    """
    return docs.select("doc_id", "text").mapInArrow(_pack(tokenizer_path, size, end_id), RESULT)
