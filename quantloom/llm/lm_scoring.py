"""Language-model scores by online logistic context mixing of hashed-context bit predictors.

A token (a word, or the end of a document) is coded in binary decisions: is it known from the training
documents; if so, the bits of its code (of its first two bytes, its last two, and all of it, hashed), one after
the other, and then the word among the known words of that code by its count; if not, its bytes, bit by bit.
Each decision of the code is predicted by the corpus alone and by two hashed contexts (the last of the most
frequent words, which tells the language, and the previous two words, which know repeated passages); a
context's counts are smoothed by the predictor before it. A fourth predictor follows passages of the training
documents: at an anchor (a place whose ANCHOR words before it have a hash of a certain form) the words are looked
up, and what came after them predicts each next word until the next known anchor; it is trusted by how many
words it has got right in a row. A mixer adds the stretched probabilities with weights gated by the code's bit
and by that trust or, where no passage is followed, by how often the longest context was seen, and refines the
weights after every token by the coding error. The weights start anew for every SEGMENT
tokens, so documents never learn from each other while they are scored.

What is learned comes from the training documents alone and grows with them: exact counts of all distinct words
and the passages after all anchors, joined to the words and anchors of each chunk of documents. A training document
only follows passages that the training documents hold twice at least. What is broadcast has a fixed size: the context tables
(TABLE_BITS), which are summed over all training documents in two streaming rounds, the counts of the
2**CODE_BITS codes, and those of the FREQUENT most frequent words, which so need no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm import text as tx

_U = np.uint64
#: Bits of a word's code from its first two bytes, its last two bytes and the whole word.
CODE = (5, 4, 4)
CODE_BITS = sum(CODE)
TABLE_BITS = 19
#: Words that contexts remember, and words whose counts are broadcast.
TOP = 256
FREQUENT = 1 << 16
CONTEXTS = 2
#: The bytes of unknown words are predicted from so many bytes before.
ORDERS = (2, 3)
LETTERS = len(ORDERS)
#: Words that make an anchor, log2 of the number of places to one anchor, and the most words that are remembered after it.
ANCHOR, ANCHOR_BITS, RUN = 4, 4, 256
#: Bits of a remembered word: its code and some more of its hash.
ID_BITS = 16
#: Share of predicted words that come, by trust: none followed; the last was wrong; new; 1-3, 4-15 and more right ones before.
FOLLOWED = np.array([0, 0.25, 0.6, 0.9, 0.97, 0.99])
STRENGTH = np.log((1 + FOLLOWED) / (1 - FOLLOWED)).astype(np.float32)
SEGMENT = 1024
BLOCK = 1 << 14
#: Bytes of text of a chunk; a longer document is a chunk of its own. Its tokens are scored so many at a time.
CHUNK = 4 << 20
TOKENS = 160_000
#: Tokens whose predictions are made at once.
PART = 1 << 13
#: Pseudo-counts of the smoothing by the predictor before, by context.
SMOOTH = (20.0, 2.0)
LETTER_SMOOTH = (0.5, 2.0)
#: Weights of the stretched letter predictors.
LETTER_WEIGHTS = (0.4, 0.8)
START = np.array([0.1, 0.6, 0.5, 1.0], dtype=np.float32)
RATE = 0.06
#: Tokens that the corpus-wide share of unknown words weighs for in a document.
UNKNOWN_WEIGHT = 60.0
END = np.uint64(0x9B97F4A7C15D1CE4)
GATES = 3 + len(FOLLOWED) - 1

CHUNK_SCHEMA = "chunk long, doc_ids array<long>, learn array<boolean>, sizes array<int>, tokens binary, spelling binary"
RESULT = "doc_id long, learned boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"


def _word_ids(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit ids of words: the code in the upper bits, the hash of the word in the rest."""
    whole = tx.span_hashes(low, starts, ends)
    a, b, c, d = (low[x].astype(_U) for x in (starts, np.minimum(starts + 1, ends - 1), np.maximum(ends - 2, starts), ends - 1))
    first, last = tx.mix(a << _U(8) | b) >> _U(64 - CODE[0]), tx.mix(c << _U(8) | d | _U(1 << 20)) >> _U(64 - CODE[1])
    code = ((first << _U(CODE[1]) | last) << _U(CODE[2])) | (whole >> _U(64 - CODE[2]))
    return (code << _U(64 - CODE_BITS)) | ((whole << _U(CODE[2])) >> _U(CODE_BITS))


def _chunks(batches):
    """Documents to chunks: token numbers, and the spellings of the distinct words in the order of their ids."""
    pack = zstandard.ZstdCompressor(level=1).compress
    key = TaskContext.get().partitionId() << 32
    for batch in batches:
        learn = np.array([bool(x) for x in batch.column(2).to_pylist()], dtype=bool)
        for row, end, buf, offsets in tx.text_chunks(batch, "text", CHUNK):
            low = tx.LOWER[buf]
            starts, ends, before = tx.words(low, offsets, tx.SPACE_SEPARATORS)
            n = end - row
            sizes = np.diff(before) + 1
            at = np.cumsum(sizes)
            tokens = np.full(int(at[-1]), END, dtype=_U)
            own = np.ones(len(tokens), bool)
            own[at - 1] = False
            tokens[own] = _word_ids(low, starts, ends)
            _, first, number = np.unique(tokens, return_index=True, return_inverse=True)
            number = number.ravel()
            position = np.cumsum(own) - 1
            data = low.tobytes()
            s, e = starts[position[first]] if len(starts) else first * 0, ends[position[first]] if len(starts) else first * 0
            spelled = b" ".join(data[a:b] if w else b"" for a, b, w in zip(s.tolist(), e.tolist(), own[first].tolist(), strict=True))
            one = lambda x, kind: pa.array([x], kind)
            yield pa.record_batch(
                [
                    one(key, pa.int64()), one(batch.column(0).slice(row, n).to_pylist(), pa.list_(pa.int64())), one(learn[row:end].tolist(), pa.list_(pa.bool_())),
                    one(sizes.astype(np.int32), pa.list_(pa.int32())),
                    one(pack(number.astype(np.uint32).tobytes()), pa.binary()), one(pack(spelled), pa.binary()),
                ],
                ["chunk", "doc_ids", "learn", "sizes", "tokens", "spelling"],
            )
            key += 1


class _Chunk:
    """One row of chunks, unpacked."""

    def __init__(self, row: dict[str, pa.Array], i: int):
        values = lambda k: row[k][i].values.to_numpy(zero_copy_only=False)
        unpack = zstandard.ZstdDecompressor().decompress
        self.sizes, self.learn = values("sizes").astype(np.int64), values("learn").astype(bool)
        self.tokens = np.frombuffer(unpack(row["tokens"][i].as_py()), dtype=np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(unpack(row["spelling"][i].as_py()) + b" ", dtype=np.uint8)
        self.ends = np.flatnonzero(self.data == 0x20)
        self.begins = np.concatenate([[0], self.ends[:-1] + 1])
        full = self.ends > self.begins
        self.words = np.full(len(self.ends), END, dtype=_U)
        self.words[full] = _word_ids(self.data, self.begins[full], self.ends[full])
        self.codes = (self.words >> _U(64 - CODE_BITS)).astype(np.int32)

    def contexts(self, top: np.ndarray) -> list[np.ndarray]:
        """32-bit hashes of every token's contexts."""
        h = self.words[self.tokens]
        begin = np.repeat(self.starts, self.sizes)
        place = np.arange(len(h))
        first, second = np.zeros_like(h), np.zeros_like(h)
        first[1:] = np.where(place[1:] > begin[1:], h[:-1], _U(1))
        second[2:] = np.where(place[2:] > begin[2:] + 1, h[:-2], _U(2))
        frequent = _find(top, self.words) >= 0
        last = np.maximum.accumulate(np.where(frequent[self.tokens], place, -1))
        last = np.concatenate([[-1], last[:-1]])
        near = np.where(last >= begin, h[np.maximum(last, 0)], _U(3))
        out = [near, tx.mix(first * _U(3) ^ tx.mix(second + _U(7)))]
        return [(x >> _U(32)).astype(np.uint32) * np.uint32(2 * k + 3) for k, x in enumerate(out)]

    def ids(self) -> np.ndarray:
        return (self.words >> _U(64 - ID_BITS)).astype(np.uint16)[self.tokens]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the anchors and their places in ascending order, the tokens from each to the next or to the end of its document, and whether that is a training document."""
        hashes = tx.windows_hash(self.words[self.tokens], ANCHOR)[:-1]
        at = np.flatnonzero(hashes >> _U(64 - ANCHOR_BITS) == 0) + ANCHOR
        doc = np.searchsorted(self.starts, at, side="right") - 1
        own = at - self.starts[doc] >= ANCHOR
        at, doc = at[own], doc[own]
        size = np.minimum(np.append(at[1:], len(self.tokens)), (self.starts + self.sizes)[doc]) - at
        return hashes[at - ANCHOR], at, size, self.learn[doc]

    def letters(self, which: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Bytes of these words (each closed by a blank), their contexts (the bytes before), and the word of each byte."""
        data, begins = self.data, self.begins
        size = (self.ends - begins + 1)[which]
        owner = np.repeat(np.arange(len(which)), size)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = begins[which][owner] + inner
        context, out = np.zeros(len(at), np.uint32), []
        for k in range(max(ORDERS)):
            context = (context * np.uint32(257) + np.where(inner > k, data[np.maximum(at - k - 1, 0)], 0).astype(np.uint32) + np.uint32(1)) * np.uint32(0x297A2D39)
            if k + 1 in ORDERS:
                out.append(context)
        return data[at].astype(np.int32), out, owner


def _rows(batches):
    for batch in batches:
        row = dict(zip(batch.schema.names, batch.columns, strict=True))
        for i in range(batch.num_rows):
            yield row, i, _Chunk(row, i)


def _counts(batches):
    """Words of the training documents and how often each occurs, by chunk."""
    for _, _, c in _rows(batches):
        n = np.bincount(c.tokens[np.repeat(c.learn, c.sizes)], minlength=len(c.words))
        own = np.flatnonzero(n)
        yield pa.record_batch([tx.as_long(c.words[own]), pa.array(n[own])], ["word", "n"])


def _stretches(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places at[k], at[k] + 1, ... of size[k] tokens each, one after the other."""
    return np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())


def _passages(batches):
    """Anchors of the training documents, how often each occurs, and the words after it: the most; of as many, those of the highest hash."""
    for _, _, c in _rows(batches):
        key, at, size, learn = c.anchors()
        key, at, size = key[learn], at[learn], np.minimum(size[learn], RUN)
        if not len(key):
            continue
        ids, flat = c.ids(), _stretches(at, size)
        inner = flat - np.repeat(at, size)
        value = np.add.reduceat(tx.mix(ids[flat].astype(_U) + (inner.astype(_U) << _U(ID_BITS))), np.cumsum(size) - size)
        rank = (size.astype(np.int64) << 48) | (value >> _U(16)).astype(np.int64)
        order = np.lexsort((-rank, key))
        first = np.flatnonzero(np.append(True, np.diff(key[order].view(np.int64)) != 0))
        n, own = np.diff(np.append(first, len(key))), order[first]
        data = ids[_stretches(at[own], size[own])].astype("<u2").tobytes()
        after = tx.binary_rows(data, 2 * np.append(0, np.cumsum(size[own])))
        yield pa.record_batch([tx.as_long(key[own]), pa.array(n, pa.int64()), pa.array(rank[own]), after], ["anchor", "n", "rank", "after"])


def _anchors(batches):
    """(chunk, anchor, least) of all anchors: least is how often the training documents must hold it."""
    for row, i, c in _rows(batches):
        key, _, _, learn = c.anchors()
        key, number = np.unique(key, return_inverse=True)
        free = np.bincount(number.ravel(), weights=~learn, minlength=len(key)) > 0
        yield pa.record_batch([pa.array(np.full(len(key), row["chunk"][i].as_py(), np.int64)), tx.as_long(key), pa.array(np.where(free, 1, 2), pa.int32())], ["chunk", "anchor", "least"])


def _follow(c: _Chunk, found: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The id that passages predict for every token (or -1), and how far to trust it (0: no prediction)."""
    ids = c.ids().astype(np.int32)
    predicted = np.full(len(ids), -1, dtype=np.int32)
    if not found:
        return predicted, np.zeros(len(ids), np.int64)
    known = np.array([x["anchor"] for x in found], dtype=np.int64).view(_U)
    order = np.argsort(known)
    many = np.array([x["n"] for x in found])
    length = np.array([len(x["after"]) // 2 for x in found])
    after = np.frombuffer(b"".join(x["after"] for x in found), dtype="<u2")
    key, at, _, learn = c.anchors()
    k = _find(known[order], key)
    k = np.where(k >= 0, order[k], -1)
    use = (k >= 0) & (many[k] >= 1 + learn)
    k, at = k[use], at[use]
    end = (c.starts + c.sizes)[np.searchsorted(c.starts, at, side="right") - 1]
    size = np.minimum(np.minimum(length[k], np.append(at[1:], len(ids)) - at), end - at)  # the next known anchor takes over
    predicted[_stretches(at, size)] = after[_stretches((np.cumsum(length) - length)[k], size)]
    right, place = predicted == ids, np.arange(len(ids))
    wrong = np.maximum.accumulate(np.where(right, -1, place))
    before = np.zeros(len(ids), np.int64)
    before[1:] = place[:-1] - wrong[:-1]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = predicted[:-1] < 0
    trust = np.where(before > 0, 3 + (before > 3) + (before > 15), 1 + fresh)
    return predicted, np.where(predicted >= 0, trust, 0)


def _find(sorted_words: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The place of each word in the sorted ones, or -1."""
    if not len(sorted_words):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(sorted_words, words), len(sorted_words) - 1)
    return np.where(sorted_words[at] == words, at, -1)


def _rare(frequent):
    """(chunk, word) of the words whose counts are not broadcast."""

    def run(batches):
        for row, i, c in _rows(batches):
            words = c.words[_find(frequent.value, c.words) < 0]
            yield pa.record_batch([pa.array(np.full(len(words), row["chunk"][i].as_py(), np.int64)), tx.as_long(words)], ["chunk", "word"])

    return run


def _slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    x = context ^ (node.astype(np.uint32) * np.uint32(0x9E3779B1))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return (x >> np.uint32(32 - TABLE_BITS)).astype(np.int64)


def _nodes(code: np.ndarray, bits: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The node of the code tree before bit k, and the bit."""
    return (1 << k) | (code >> (bits - k)), (code >> (bits - 1 - k)) & 1


def _pairs(context: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a context and a code (of 16 bits at most), and how often each occurs."""
    both = (context.astype(_U) << _U(16)) | code.astype(_U)
    both.sort()
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    n, both = np.diff(np.append(first, len(both))), both[first]
    return (both >> _U(16)).astype(np.uint32), (both & _U(0xFFFF)).astype(np.int32), n


def _tables(top, spread: int):
    """Counts of zeros and ones by slot, for each context; a task adds up all its chunks and gives their non-zero blocks."""

    def run(batches):
        known = top.value
        total = np.zeros((CONTEXTS + LETTERS, 2 << TABLE_BITS), dtype=np.int64)
        for _, _, c in _rows(batches):
            use = np.repeat(c.learn, c.sizes)
            if not use.any():
                continue
            letters, before, _ = c.letters(np.unique(c.tokens[use]))
            for k, (context, code, bits) in enumerate([*((x[use], c.codes[c.tokens[use]], CODE_BITS) for x in c.contexts(known)), *((x, letters, 8) for x in before)]):
                context, code, n = _pairs(context, code)
                for lo in range(0, len(code), PART):
                    own = slice(lo, lo + PART)
                    for b in range(bits):
                        node, bit = _nodes(code[own], bits, b)
                        np.add.at(total[k], 2 * _slots(context[own], node) + bit, n[own])
        pack = zstandard.ZstdCompressor(level=1).compress
        task = TaskContext.get().partitionId() % spread
        for k in range(CONTEXTS + LETTERS):
            for b in range((2 << TABLE_BITS) // BLOCK):
                part = total[k, b * BLOCK : (b + 1) * BLOCK]
                if part.any():
                    yield pa.record_batch([pa.array([k * ((2 << TABLE_BITS) // BLOCK) + b], pa.int32()), pa.array([task], pa.int32()), pa.array([pack(part.tobytes())], pa.binary())], ["block", "spread", "counts"])

    return run


def _sum_blocks(batches):
    """Sums rows of equal (block, spread), which come sorted, one after the other."""
    pack, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    held, total = None, None

    def done():
        return pa.record_batch([pa.array([held[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([pack(total.tobytes())], pa.binary())], ["block", "spread", "counts"])

    for batch in batches:
        for block, spread, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            counts = np.frombuffer(unpack(data), dtype=np.int64)
            if held != (block, spread):
                if held is not None:
                    yield done()
                held, total = (block, spread), counts.copy()
            else:
                total += counts
    if held is not None:
        yield done()


@dataclass(frozen=True)
class LanguageModel:
    train_tokens: int
    distinct: int
    single: int
    ids: np.ndarray  # training tokens of each id of ID_BITS
    codes: np.ndarray  # and of each code
    top: np.ndarray  # ids of the TOP most frequent words, sorted
    frequent: np.ndarray  # and of the FREQUENT ones
    counts: np.ndarray  # and how often these occur
    tables: np.ndarray  # contexts x slots x (ones, all)
    words: DataFrame  # word, n: all distinct words of the training documents
    passages: DataFrame  # anchor, n, after: all their anchors

    def shared(self) -> LanguageModel:
        return replace(self, words=None, passages=None)


def chunk_documents(docs: DataFrame, learn: Column) -> DataFrame:
    """Tokenised chunks of all documents, kept in the checkpoint folder."""
    rows = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    return tx.reliable(rows.mapInArrow(_chunks, CHUNK_SCHEMA))


def learn_model(chunks: DataFrame) -> LanguageModel:
    """Learns from the documents marked in the chunks. Without any, every word is unknown."""
    spark = chunks.sparkSession
    counted = chunks.mapInArrow(_counts, "word long, n long")
    words = tx.released(counted.groupBy("word").agg(F.sum("n").alias("n")))
    whole = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("one")).first()
    ids = np.zeros(1 << ID_BITS)
    counts = words.groupBy(F.shiftrightunsigned("word", 64 - ID_BITS).alias("id")).agg(F.sum("n").alias("n")).toArrow()  # 2**ID_BITS rows at most
    ids[counts.column("id").to_numpy()] = counts.column("n").to_numpy()
    codes = ids.reshape(1 << CODE_BITS, -1).sum(1)
    passages = chunks.mapInArrow(_passages, "anchor long, n long, rank long, after binary").groupBy("anchor").agg(F.sum("n").alias("n"), F.max(F.struct("rank", "after")).alias("x"))
    passages = passages.select("anchor", "n", "x.after")
    often = words.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    frequent, counts = often.column("word").to_numpy().view(_U), often.column("n").to_numpy()
    top, order = np.sort(frequent[:TOP]), np.argsort(frequent)
    spread = math.isqrt(chunks.rdd.getNumPartitions()) + 1  # so both rounds below add up about as many rows of a block
    parts = chunks.mapInArrow(_tables(spark.sparkContext.broadcast(top), spread), "block int, spread int, counts binary")
    for _ in range(2):  # first over the tasks of one remainder, then over the remainders
        parts = parts.repartition("block", "spread").sortWithinPartitions("block", "spread").mapInArrow(_sum_blocks, "block int, spread int, counts binary")
    tables = np.zeros((CONTEXTS + LETTERS, 2 << TABLE_BITS), dtype=np.float32)
    unpack = zstandard.ZstdDecompressor().decompress
    for block, data in tx.released(parts.select("block", "counts")).collect():  # a fixed number of blocks of fixed size
        k, b = divmod(block, (2 << TABLE_BITS) // BLOCK)
        tables[k, b * BLOCK : (b + 1) * BLOCK] += np.frombuffer(unpack(bytes(data)), dtype=np.int64)
    pairs = tables.reshape(CONTEXTS + LETTERS, 1 << TABLE_BITS, 2)
    return LanguageModel(whole["n"], whole["v"], whole["one"], ids, codes, top, frequent[order], counts[order], np.stack([pairs[:, :, 1], pairs.sum(2)], axis=2), words, passages)


def _code_tree(codes: np.ndarray) -> np.ndarray:
    """By node of the code tree: the share of ones below it."""
    bits = int(np.log2(len(codes)))
    p = np.zeros(len(codes), dtype=np.float32)
    for k in range(bits):
        below = codes.reshape(1 << (k + 1), -1).sum(1)
        p[1 << k : 2 << k] = (below[1::2] + 0.05) / (below[0::2] + below[1::2] + 0.1)
    return p


def _stretch(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, np.float32(1e-5), np.float32(1 - 1e-5))
    return np.log(p / (1 - p))


def _counted(table: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ones and all counts of these slots; both lie side by side and are fetched at once."""
    found = table.view(np.float64)[:, 0].take(slots).view(np.float32).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _mixed(m: LanguageModel, tree: np.ndarray, c: _Chunk, known: np.ndarray, predicted: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Natural log probability of each known token's code."""
    contexts, plain = c.contexts(m.top), _stretch(tree)
    whole = -(-c.sizes // SEGMENT)
    doc = np.repeat(np.arange(len(c.sizes)), whole)
    part = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
    begin, size = c.starts[doc] + part * SEGMENT, np.minimum(SEGMENT, c.sizes[doc] - part * SEGMENT)
    out = np.empty(len(c.tokens))
    for own in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(begin // TOKENS)) + 1):
        lo, hi = int(begin[own[0]]), int(begin[own[-1]] + size[own[-1]])
        code = c.codes[c.tokens[lo:hi]]
        out[lo:hi] = _mixed_lanes(m, tree, plain, code, [x[lo:hi] for x in contexts], known[lo:hi], predicted[lo:hi] >> (ID_BITS - CODE_BITS), trust[lo:hi], begin[own] - lo, size[own])
    return out


def _mixed_lanes(m: LanguageModel, tree, plain, code, contexts, known, predicted, trust, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    n = len(code)
    follows = bool(trust.any())
    many = CONTEXTS + 1 + follows
    # A segment is a lane, longest first; step t takes token t of every lane that has one. All below is in the order of the steps.
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    alive = np.searchsorted(-size, -np.arange(1, int(size.max()) + 1), side="right")
    cuts = np.cumsum(alive)
    lane = np.arange(n) - np.repeat(cuts - alive, alive)
    at = begin[lane] + np.repeat(np.arange(len(alive)), alive)
    inputs = np.empty((n, many, CODE_BITS), dtype=np.float32)
    sign = np.empty((n, CODE_BITS), dtype=np.float32)
    rows = lane * GATES
    for lo in range(0, n, PART):  # temporaries stay in the processor's cache
        own = at[lo : lo + PART]
        _inputs(m, tree, plain, code[own], [x[own] for x in contexts], predicted[own], trust[own] if follows else None, inputs[lo : lo + PART], sign[lo : lo + PART], rows[lo : lo + PART])
    weights = np.tile(START[:many, None], (len(size) * GATES, 1, CODE_BITS))  # of lane and gate
    dots = np.empty((n, CODE_BITS), dtype=np.float32)
    rate = (known[at].astype(np.float32) * np.float32(RATE))[:, None]
    for live, end in zip(alive.tolist(), cuts.tolist(), strict=True):
        own = slice(end - live, end)
        x, row = inputs[own], rows[own]
        w = weights.take(row, axis=0)
        error = np.negative(np.einsum("nkb,nkb->nb", x, w, out=dots[own]))
        np.exp(error, out=error)
        error += 1
        np.divide(1, error, out=error)
        np.subtract(sign[own], error, out=error)
        error *= rate[own]
        x *= error[:, None]
        w += x
        weights[row] = w
    # log of the probability of the bit that came
    np.negative(dots, out=dots, where=sign > 0)
    loss = np.abs(dots)
    np.exp(np.negative(loss, out=loss), out=loss)
    loss += 1
    np.log(loss, out=loss)
    loss += np.maximum(dots, 0, out=dots)
    out = np.empty(n)
    out[at] = -loss.sum(1, dtype=np.float64)
    return out


def _inputs(m: LanguageModel, tree, plain, code, contexts, predicted, trust, inputs: np.ndarray, sign: np.ndarray, rows: np.ndarray) -> None:
    """Fills in the stretched predictions and the bits of these tokens, and adds each one's gate to its row. trust: None if no passage is followed."""
    n, many = inputs.shape[:2]
    flat, bits = np.empty((CODE_BITS, many, n), dtype=np.float32), np.empty((CODE_BITS, n), dtype=np.float32)
    if trust is not None:
        strength = STRENGTH[trust]
    for b in range(CODE_BITS):
        node, bits[b] = _nodes(code, CODE_BITS, b)
        p, flat[b, 0] = tree.take(node), plain.take(node)
        for k in range(CONTEXTS):
            smooth = np.float32(SMOOTH[k])
            ones, both = _counted(m.tables[k], _slots(contexts[k], node))
            p *= smooth
            p += ones
            p /= both + smooth
            flat[b, k + 1] = _stretch(p)
        if trust is not None:  # the predicted bit, as long as those before it came
            ahead = _nodes(predicted, CODE_BITS, b)
            flat[b, -1] = np.where(ahead[0] == node, strength * (2 * ahead[1] - 1), 0)
    gate = (both > 0.5).astype(np.int64) + (both > 3.5)
    rows += gate if trust is None else np.where(trust > 0, 2 + trust, gate)
    inputs[:], sign[:] = flat.transpose(2, 1, 0), bits.T


def _spelled(m: LanguageModel, c: _Chunk, which: np.ndarray) -> np.ndarray:
    """Natural log probability of these words' bytes."""
    letters, before, owner = c.letters(which)
    total = np.zeros(len(letters))
    for b in range(8):
        node, bit = _nodes(letters, 8, b)
        p = np.full(len(letters), 0.5, dtype=np.float32)
        dot = np.zeros(len(letters), dtype=np.float32)
        for k in range(LETTERS):
            smooth = np.float32(LETTER_SMOOTH[k])
            ones, both = _counted(m.tables[CONTEXTS + k], _slots(before[k], node))
            p = (ones + smooth * p) / (both + smooth)
            dot += _stretch(p) * np.float32(LETTER_WEIGHTS[k])
        total -= np.logaddexp(0, np.where(bit > 0, -dot, dot))
    return np.bincount(owner, weights=total, minlength=len(which))


def _inside(m: LanguageModel, n: np.ndarray, ids: np.ndarray, predicted: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Natural log probability of each known token (it occurs n times) given its code: whether it has the predicted id, if its code came, and its share of what is left."""
    own, code = m.ids[ids], m.codes[ids >> (ID_BITS - CODE_BITS)]
    left = np.log(np.maximum(n, 1) / np.maximum(code, 1))
    at = np.flatnonzero((trust > 0) & (predicted >> (ID_BITS - CODE_BITS) == ids >> (ID_BITS - CODE_BITS)))
    other = code[at] - m.ids[predicted[at]]
    sure = np.where(other > 0, FOLLOWED[trust[at]], 1)
    right = predicted[at] == ids[at]
    count = np.maximum(n[at], 1)
    left[at] = np.where(right, np.log(sure * count / np.maximum(own[at], 1)), np.log(np.where(other > 0, 1 - sure, 1) * count / np.maximum(other, 1)))
    return left


def _scores(model):
    def run(batches):
        m = model.value
        tree = _code_tree(m.codes)
        for row, i, c in _rows(batches):
            at = _find(m.frequent, c.words)
            count = np.where(at >= 0, m.counts[at], 0) if len(m.counts) else np.zeros(len(c.words), np.int64)
            if row["known"][i].is_valid:
                found = row["known"][i].values
                count[_find(c.words, found.field(0).to_numpy(zero_copy_only=False).view(_U))] = found.field(1).to_numpy(zero_copy_only=False)
            n = count[c.tokens]
            known = n > 0
            base = np.log10((n + 1) / (m.train_tokens + m.distinct + 1))
            predicted, trust = _follow(c, row["passages"][i].as_py())
            logs = _mixed(m, tree, c, known, predicted, trust)
            logs += _inside(m, n, c.ids(), predicted, trust)
            place = np.arange(len(n)) - np.repeat(c.starts, c.sizes)
            missed = np.cumsum(~known) - ~known
            missed = missed - np.repeat(missed[c.starts], c.sizes)
            share = (m.single + 1) / (m.train_tokens + 2)
            new = (missed + UNKNOWN_WEIGHT * share) / (place + UNKNOWN_WEIGHT) * (1 - FOLLOWED[trust])
            spelled = np.zeros(len(c.words))
            rare = np.flatnonzero(count == 0)
            if len(rare):
                spelled[rare] = _spelled(m, c, rare)
            logs = np.where(known, np.log1p(-new) + logs, np.log(new) + spelled[c.tokens])
            add = lambda x, at=c.starts: np.add.reduceat(x, at)
            score = add(logs) / np.log(10)
            size = add((c.ends - c.begins + 1)[c.tokens])
            yield pa.record_batch(
                [
                    row["doc_ids"][i].values, pa.array(c.learn), pa.array(size, pa.int64()), pa.array(c.sizes), pa.array(add(known.astype(np.int64))),
                    pa.array(add(base)), pa.array(score), pa.array(-score * np.log2(10) / size),
                ],
                ["doc_id", "learned", "n_bytes", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"],
            )

    return run


def score_chunks(chunks: DataFrame, model: LanguageModel) -> DataFrame:
    """Scores of every document of the chunks."""
    spark = chunks.sparkSession
    wanted = chunks.mapInArrow(_rare(spark.sparkContext.broadcast(model.frequent)), "chunk long, word long")
    known = wanted.join(model.words, "word").groupBy("chunk").agg(F.collect_list(F.struct("word", "n")).alias("known"))  # the words of one chunk
    met = chunks.mapInArrow(_anchors, "chunk long, anchor long, least int").join(model.passages, "anchor").where("n >= least")
    met = tx.released(met.select("chunk", "anchor", "n", "after"))  # few of the passages are met again: the shuffle of them all goes
    met = met.groupBy("chunk").agg(F.collect_list(F.struct("anchor", "n", "after")).alias("passages"))  # the anchors of one chunk
    rows = chunks.join(known, "chunk", "left").join(met, "chunk", "left")
    return rows.mapInArrow(_scores(spark.sparkContext.broadcast(model.shared())), RESULT)


def score_documents(docs: DataFrame, learn: Column) -> tuple[DataFrame, LanguageModel]:
    """doc_id, learned, n_tokens, n_known, base_score, score and bits_per_byte of every row, and the model.

    learn: which rows the model learns from (null: not). Whole texts; a null or empty text has one token, the
    end. score is the model's log10 probability of the text, base_score that of the smoothed word counts.
    n_bytes: bytes of the words and one for what ends each. Repeated rows and null doc_ids each get their row.
    Other columns are not read. An empty table gives no rows.
    """
    chunks = chunk_documents(docs, learn)
    model = learn_model(chunks)
    return score_chunks(chunks, model), model
