"""Repeated passages by a depth-limited radix sort of suffixes, most significant digit first.

A suffix is ordered only through its first `width` bytes (its window). Every pass looks at one more digit
and goes on with groups that are still tied; a suffix that is alone drops out. What is tied through all
digits is exactly the set of repeated windows. Neighbouring suffixes are carried as runs, so that no pass
holds a row for each byte of the corpus:

1. The first digit of a window is its anchor: the smallest hash among its grams (GRAM bytes), leftmost on ties.
   Equal windows have equal anchors at equal distances. A run is all neighbouring windows of one anchor
   (some 130); runs with an anchor of their own leave here.
2. Second digit: the whole text under the run. Equal runs repeat in all their windows and are done.
3. Third digit, of the rest: pieces of 16 windows at fixed distances from the anchor. The bytes that all 16
   share (the core) must repeat, or the piece leaves; if all bytes under it repeat, it is done.
4. Last digit, of the rest: each single window.

Spark spreads the groups by digit and counts them with partial sums before each shuffle, so a digit that a
third of all suffixes share costs one row per task there. The counts are written before the rows are joined with
them: both sides of such a join then have exchanges of their own, and adaptive execution splits a partition
that one digit fills. Digits are 64-bit hashes of the bytes; only the anchor's, which finds but does not judge, is a
polynomial. Runs, cores and pieces have a cryptographic one, as built strings of a window's length share a polynomial
modulo 2**64; a window's comes from its core's and the 15 bytes around it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm import text as tx

_U = np.uint64
#: Bytes of a gram; the shorter it is against the windows, the fewer anchors there are, and the more chance ties.
GRAM = 128
PIECE = 16
#: Windows of a very long document that a task hashes at once.
SEGMENT = 4 << 20
#: Pieces whose windows a task hashes at once.
PIECES = 1 << 16
_LOW = _U((1 << 24) - 1)
RESULT = "doc_id long, text_key long, n_bytes long, n_removed long, kept binary, spans array<struct<start: long, end: long>>"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=_U)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def _digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cryptographic 64-bit hashes of byte spans, which may overlap."""
    data = memoryview(np.ascontiguousarray(buf))
    found = [hashlib.blake2b(data[s:e], digest_size=8).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), dtype=_U)


def _runs(buf: np.ndarray, room: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """First and last window, anchor, anchor hash and text hash of every run; room: bytes to the document's end."""
    sums = tx.prefix_hashes(buf)
    _, down = tx.powers(len(buf) + 1)
    grams = tx.mix((sums[gram:] - sums[:-gram]) * down[: len(buf) - gram + 1])
    ranked = (grams & ~_LOW) | np.arange(len(grams), dtype=_U)
    least = _sliding_min(ranked, width - gram + 1)
    starts = np.flatnonzero(room[: len(least)] >= width)
    anchor = (least[starts] & _LOW).astype(np.int64)
    if not len(starts):
        return starts, starts, anchor, grams[:0], grams[:0]
    new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(starts)]]) - 1
    lo, hi, a = starts[first], starts[last], anchor[first]
    under = _digests(buf, lo, hi + width)
    shape = tx.mix((a - lo).astype(_U) * _U(1_000_003) + (hi - lo).astype(_U))
    return lo, hi, a, grams[a], tx.mix(under ^ shape)


def _first_digits(width: int, gram_bytes: int):
    def run(batches):
        for batch in batches:
            for row, end, buf, offsets in tx.text_chunks(batch, "text"):
                found = []
                for at in range(0, max(0, len(buf) - width + 1), SEGMENT):
                    part = buf[at : at + SEGMENT + width - 1]
                    doc = np.searchsorted(offsets, np.arange(at, at + len(part)), side="right") - 1 if len(offsets) > 2 else np.zeros(len(part), np.int64)
                    room = offsets[doc + 1] - np.arange(at, at + len(part))
                    lo, hi, a, gram, under = _runs(part, room, width, gram_bytes)
                    owner = doc[lo]
                    base = at - offsets[owner]
                    found.append((owner + row, lo + base, hi + base, a + base, gram, under))
                if not found:
                    continue
                owner, lo, hi, a, gram, under = (np.concatenate(x) for x in zip(*found, strict=True))
                ids, keys = batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner))
                yield pa.record_batch([ids, keys, pa.array(lo), pa.array(hi), pa.array(a), tx.as_long(gram), tx.as_long(under)], ["doc_id", "text_key", "lo", "hi", "a", "gram", "run"])

    return run


def _pieces(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, a: np.ndarray, width: int, gram: int):
    """Third digits of one document's runs: first window, core, text (and whether it is whole) and the 16 last digits."""
    back = width - gram  # the first window of an anchor starts so far before it
    q0, q1 = (lo - a + back) // PIECE, (hi - a + back) // PIECE
    n = q1 - q0 + 1
    owner = np.repeat(np.arange(len(lo)), n)
    q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + q0[owner]
    first = a[owner] - back + PIECE * q
    order = np.argsort(first, kind="stable")
    first, owner, q = first[order], owner[order], q[order]
    core, text, leaves = np.zeros(len(q), _U), np.zeros(len(q), _U), np.zeros((len(q), PIECE), _U)
    whole = (first >= 0) & (first + PIECE - 1 + width <= len(buf))
    around = np.concatenate([np.arange(PIECE - 1), np.arange(width, width + PIECE - 1)])  # before and after the core
    for at in range(0, len(q), PIECES):
        to = min(at + PIECES, len(q))
        s, ok = first[at:to], whole[at:to]
        turn = q[at:to].astype(_U) * _U(0xC2B2AE3D27D4EB4F)  # two anchors can make a piece at one place, which is no repeat of itself
        core[at:to] = tx.mix(_digests(buf, s + PIECE - 1, s + width) ^ turn)
        text[at:to][ok] = tx.mix(_digests(buf, s[ok], s[ok] + PIECE - 1 + width) ^ turn[ok])
        edge = np.zeros((to - at, 2 * PIECE), np.uint8)
        edge[:, : len(around)] = buf[np.clip(s[:, None] + around, 0, len(buf) - 1)]
        for j in range(PIECE):
            w = s + j
            own = (w >= lo[owner[at:to]]) & (w <= hi[owner[at:to]])
            # the window's bytes beside the core are edge[j : j + 15]
            low, high = (np.ascontiguousarray(edge[own, k : k + 8]).view(_U).ravel() for k in (j, j + 7))
            leaves[at:to, j][own] = np.maximum(tx.mix(tx.mix(low ^ core[at:to][own]) ^ high), _U(1))
    return first, core, text, whole, leaves


def _third_digits(width: int, gram: int):
    names = ["doc_id", "text_key", "first", "core", "whole", "leaves"]

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            runs = batch.column(3)
            for i in range(batch.num_rows):
                own = runs[i].values
                lo, hi, a = (own.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                a, group = np.unique(a, return_inverse=True)  # the end of a segment can cut the windows of an anchor in two
                first, last = np.full(len(a), np.iinfo(np.int64).max), np.full(len(a), -1)
                np.minimum.at(first, group, lo)
                np.maximum.at(last, group, hi)
                lo, hi = first, last
                buf = np.frombuffer(unpack(batch.column(2)[i].as_py()), dtype=np.uint8)
                first, core, text, whole, leaves = _pieces(buf, lo, hi, a, width, gram)
                n = len(first)
                data = tx.binary_rows(leaves.tobytes(), np.arange(n + 1) * 8 * PIECE)
                same = [batch.column(k).slice(i, 1).take(pa.array(np.zeros(n, np.int64))) for k in (0, 1)]
                yield pa.record_batch([*same, pa.array(first), tx.as_long(core), pa.array(text.view(np.int64), mask=~whole), data], names)

    return run


def _last_digits(batches):
    for batch in batches:
        leaves = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=_U).reshape(-1, PIECE)
        row, j = np.nonzero(leaves)
        core = batch.column(3).to_numpy(zero_copy_only=False).view(_U)
        key = tx.mix(core[row] ^ tx.mix(leaves[row, j] ^ tx.mix(j.astype(_U))))
        at = pa.array(row)
        window = batch.column(2).to_numpy(zero_copy_only=False)[row] + j
        yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(window), tx.as_long(key)], ["doc_id", "text_key", "first", "digit"])


def _tied(df: DataFrame, digit: str, following: str | None = None) -> DataFrame:
    """The rows whose digit is not alone; open: whether the following digit tells some of its group apart."""
    group = df.groupBy(digit).agg(F.count("*").alias("_n"), *([F.expr(f"count({following}) < count(*) or min({following}) <> max({following})").alias("open")] if following else []))
    several = tx.released(group.where("_n > 1").drop("_n").withColumnRenamed(digit, "_digit"))
    return df.join(several, F.col(digit) == F.col("_digit")).drop("_digit")


def _judged(df: DataFrame, digit: str, place: str) -> DataFrame:
    """done: the row is tied in this digit. rest: it goes on to the next pass, being alone so far in a group
    that is still open, or being the one that stands there for all that are equal to it."""
    me = F.struct("doc_id", "text_key", place)
    tied = df.where(F.col(digit).isNotNull()).groupBy(F.col(digit).alias("_digit")).agg(F.count("*").alias("_n"), F.min(me).alias("_first")).where("_n > 1")
    out = df.join(tx.released(tied), F.col(digit) == F.col("_digit"), "left").withColumn("done", F.col("_n").isNotNull())
    return out.withColumn("rest", F.col("open") & (~F.col("done") | me.eqNullSafe(F.col("_first")))).drop("_digit", "_n", "_first")


def _packed(rows: DataFrame) -> DataFrame:
    """rows with their last column, the text, compressed."""
    return rows.mapInArrow(tx.pack_texts, T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.BinaryType())]))


def repeated_windows(docs: DataFrame, width: int, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key and runs (first, last) of windows that also start anywhere else."""
    gram = min(gram, width)
    anchors = docs.mapInArrow(_first_digits(width, gram), "doc_id long, text_key long, lo long, hi long, a long, gram long, run long")
    runs = _judged(tx.released(_tied(anchors, "gram", "run")), "run", "lo").where("done or rest")
    runs = tx.released(runs.select("doc_id", "text_key", "lo", "hi", "a", "done", "rest"))
    done = runs.where("done").select("doc_id", "text_key", F.col("lo").alias("first"), F.col("hi").alias("last"))
    rest = runs.where("rest").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set(F.struct("lo", "hi", "a")).alias("runs"))
    packed = _packed(docs)
    pieces = packed.join(rest, packed["doc_id"].eqNullSafe(F.col("_id")) & (packed["text_key"] == F.col("_key")))
    pieces = pieces.select("doc_id", "text_key", "text", "runs").mapInArrow(_third_digits(width, gram), "doc_id long, text_key long, first long, core long, whole long, leaves binary")
    pieces = _judged(tx.released(_tied(tx.released(pieces), "core", "whole")), "whole", "first").where("done or rest")
    pieces = tx.released(pieces.select("doc_id", "text_key", "first", "done", "rest", *[F.when(F.col("rest"), F.col(c)).alias(c) for c in ("core", "leaves")]))
    done = done.unionByName(pieces.where("done").select("doc_id", "text_key", "first", (F.col("first") + PIECE - 1).alias("last")))
    single = pieces.where("rest").select("doc_id", "text_key", "first", "core", "leaves").mapInArrow(_last_digits, "doc_id long, text_key long, first long, digit long")
    return done.unionByName(tx.released(_tied(tx.released(single), "digit").select("doc_id", "text_key", "first", F.col("first").alias("last"))))


def _spans(data: bytes, found: pa.Scalar, width: int, whole_characters: bool) -> list[list[int]]:
    """Maximal removed runs (start, end) of one text; found: its repeated windows as (first, last), or null."""
    own: list[list[int]] = []
    if found.is_valid:
        first = found.values.field(0).to_numpy(zero_copy_only=False)
        last = found.values.field(1).to_numpy(zero_copy_only=False) + width
        order = np.argsort(first)
        for s, e in zip(first[order].tolist(), last[order].tolist(), strict=True):
            while whole_characters and data[s] & 0xC0 == 0x80:
                s -= 1
            while whole_characters and e < len(data) and data[e] & 0xC0 == 0x80:
                e += 1
            if own and s <= own[-1][1]:
                own[-1][1] = max(own[-1][1], e)
            else:
                own.append([s, e])
    return own


def _rest(data: bytes, spans: list[list[int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)) if spans else data


def _cut(width: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            kept, removed, size, spans = [], [], [], []
            for data, found in zip(batch.column(2), batch.column(3), strict=True):
                data = unpack(data.as_py()) if data.is_valid else b""
                own = _spans(data, found, width, False)
                size.append(len(data))
                removed.append(sum(e - s for s, e in own))
                kept.append(_rest(data, own))
                spans.append([{"start": s, "end": e} for s, e in own])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["doc_id", "text_key", "n_bytes", "n_removed", "kept", "spans"])

    return run


def _cut_texts(width: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = []
            for data, found in zip(batch.column(1), batch.column(2), strict=True):
                data = unpack(data.as_py()) if data.is_valid else None
                texts.append(None if data is None else _rest(data, _spans(data, found, width, True)).decode())
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    return run


def _found(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """_id, _key and found (first and last window of each repeated run) of the texts that have any."""
    found = tx.released(repeated_windows(docs, width, gram).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("found")))
    return found.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})


def remove_repeats(docs: DataFrame, width: int = 400, gram: int = GRAM) -> DataFrame:
    """Removes every byte covered by a width-byte string that also starts anywhere else in the corpus.

    Works on the UTF-8 bytes of whole texts; strings never cross documents, may overlap themselves, and are
    judged on the input. Per row of docs: doc_id, text_key (hash of the text), n_bytes, n_removed, kept (the
    remaining bytes) and spans (maximal removed runs). Null and empty texts, and texts shorter than width,
    keep all they have. Every row counts as a document: rows that are repeated (with one doc_id, or a null
    one) repeat each other's text. Other columns are not read. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).select("doc_id", "text_key", "text")
    found = _found(docs, width, gram)
    packed = _packed(docs)
    both = packed.join(found, packed["doc_id"].eqNullSafe(found["_id"]) & (packed["text_key"] == found["_key"]), "left")
    return both.select("doc_id", "text_key", "text", "found").mapInArrow(_cut(width), RESULT)


def without_repeats(docs: DataFrame, width: int = 400, gram: int = GRAM) -> DataFrame:
    """docs with all their columns, and text without its repeated bytes. A character that is cut through goes whole.

    Texts without repeats, and null ones, stay as they are. Rows that share doc_id and text share their cut.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    found = _found(rows.select("doc_id", "text_key", "text"), width, gram)
    packed = _packed(rows)
    both = packed.join(found, packed["doc_id"].eqNullSafe(found["_id"]) & (packed["text_key"] == found["_key"]), "left")
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    cut = both.select("row", "text", "found").mapInArrow(_cut_texts(width), schema)
    return cut.select(*["text" if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def digest(result: DataFrame) -> DataFrame:
    """The columns of a removal that a check compares."""
    return result.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
