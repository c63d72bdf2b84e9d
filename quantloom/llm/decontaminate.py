"""Benchmark decontamination with suffix arrays of the training text.

Every shard of the documents (a run of whole documents inside a Spark task) gets a suffix array over
its words, depth-limited to the window. Every window of every benchmark item is binary-searched in
it; the equal range gives all places where the window occurs verbatim. Suffixes whose first words
occur nowhere in the benchmark cannot match and are left out of the array before it is sorted.
The longest verbatim match of a document comes from a second suffix array, without a depth limit, over
the hit words of the shard's documents and the found windows of the items.

The benchmark is split into blocks of a bounded number of words. One block (the usual case) is broadcast, and
the result needs no shuffle at all. More blocks never reach the driver: the documents are read once, past a
sieve of bounded size that knows all windows of all blocks, and are left as the runs of words that may be hit.
These runs meet every block, in tasks that hold one block each, and the hits are merged per document row.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.durable import small
from quantloom.llm import text as tx

#: Words of benchmark text that one pass broadcasts at most (8 bytes a word and 80 a window, so below 200 MB).
BLOCK_WORDS = 1_000_000
#: Words of one row of the block table; longer items are cut, with an overlap.
PART_WORDS = 50_000
#: The sieve has 16 bits for a benchmark word, 2**SIEVE_BITS of them at most (64 MB); beyond, more runs pass it in vain.
SIEVE_BITS = 29
SIEVE_PROBES = 4
#: Words of runs that a task compares with a block, about, and at once.
SHARE_WORDS = 20_000_000
CHUNK_WORDS = 1 << 18
_FILTER_BITS = 22
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, match_start long, items array<string>, spans array<struct<start: long, end: long>>"


def _lead(hashes: np.ndarray, width: int) -> np.ndarray:
    return (tx.windows_hash(hashes, min(width, 3)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _keys(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The first width words of each suffix as one comparable byte string."""
    rows = hashes[at[:, None] + np.arange(width)]
    return np.ascontiguousarray(rows.astype(">u8")).view(f"S{8 * width}").ravel()


def _item_words(window: int):
    """Benchmark rows to (item, words of a part): a long item is cut, with window - 1 words in common."""

    def run(batches):
        for batch in batches:
            for row, end, buf, offsets in tx.text_chunks(batch, "text"):
                buf = tx.LOWER[buf]
                starts, ends, before = tx.words(buf, offsets, tx.ALNUM_SEPARATORS)
                hashes = tx.span_hashes(buf, starts, ends)
                ids, parts, data, sizes = [], [], [], []
                for i, name in enumerate(batch.column(0).slice(row, end - row).to_pylist()):
                    own = hashes[before[i] : before[i + 1]]
                    for k in range(0, max(0, len(own) - window + 1) or bool(len(own)), PART_WORDS):
                        ids.append(name)
                        parts.append(k // PART_WORDS)
                        piece = own[k : k + PART_WORDS + window - 1]
                        data.append(piece.tobytes())
                        sizes.append(len(piece))
                yield pa.record_batch([pa.array(ids, pa.string()), pa.array(parts, pa.int32()), pa.array(data, pa.binary()), pa.array(sizes, pa.int64())], ["item", "part", "words", "n"])

    return run


class _Tests:
    """The windows of a block, by length: sorted keys, and where each key is; words: all its words, a part after the other."""

    def __init__(self, rows, window: int):
        self.items = sorted({r[0] for r in rows if r[0] is not None})
        number = {x: i for i, x in enumerate(self.items)} | {None: -1}
        parts = [np.frombuffer(data, dtype=np.uint64) for _, data in rows]
        ends = np.cumsum([len(x) for x in parts], dtype=np.int64)
        self.words = np.concatenate([np.zeros(0, np.uint64), *parts])
        self.owner = np.repeat(np.array([number[r[0]] for r in rows], dtype=np.int64), [len(x) for x in parts])
        self.part = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        widths = np.array([min(window, len(x)) for x in parts], dtype=np.int64)
        self.by_width = {}
        for width in np.unique(widths[widths > 0]).tolist():
            at = np.concatenate([np.arange(e - len(x), e - width + 1) for x, e, w in zip(parts, ends.tolist(), widths, strict=True) if w == width])
            unique, first, inverse = np.unique(_keys(self.words, at, width), return_index=True, return_inverse=True)
            lead = _lead(self.words, width)[at[first]]
            order = np.argsort(inverse.ravel(), kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
            seen[lead] = True
            self.by_width[width] = (unique, lead, np.searchsorted(inverse.ravel()[order], np.arange(len(unique) + 1)), at[order], seen)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges lo[i]..hi[i], and the i that each comes from."""
    n = hi - lo
    owner = np.repeat(np.arange(len(lo)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[owner], owner


def _covered(n: int, places: np.ndarray, widths: np.ndarray | int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the places."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + widths, -1)
    return np.cumsum(steps)[:-1] > 0


def _search(hashes: np.ndarray, before: np.ndarray, tests: _Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard: which words are hit, distinct (document, item) pairs, and which words of the tests were found."""
    hit, found = np.zeros(len(hashes), bool), np.zeros(len(tests.words), bool)
    pairs = [np.zeros((0, 2), dtype=np.int64)]
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    for width, (keys, lead, key_at, where, seen) in tests.by_width.items():
        first = _lead(hashes, width)
        at = np.flatnonzero(seen[first])
        at = at[at + width <= before[doc[at] + 1]] if len(at) else at
        if not len(at):
            continue
        suffixes = _keys(hashes, at, width)
        order = np.argsort(suffixes, kind="stable")  # the suffix array
        suffixes, at = suffixes[order], at[order]
        here = np.zeros(1 << _FILTER_BITS, dtype=bool)
        here[first[at]] = True
        asked = np.flatnonzero(here[lead])
        lo, hi = np.searchsorted(suffixes, keys[asked], "left"), np.searchsorted(suffixes, keys[asked], "right")
        places, which = _ranges(lo, hi)
        places, which = at[places], asked[which]
        if not len(places):
            continue
        hit |= _covered(len(hashes), places, width)
        met = np.unique(which)
        k, owner = _ranges(key_at[met], key_at[met + 1])
        found |= _covered(len(found), where[k], width)
        items = np.unique(np.stack([met[owner], tests.owner[where[k]]], 1), axis=0)  # of each key, its items once
        item_at = np.searchsorted(items[:, 0], np.arange(len(keys) + 1))
        both = np.unique(np.stack([doc[places], which], 1), axis=0)
        k, owner = _ranges(item_at[both[:, 1]], item_at[both[:, 1] + 1])
        pairs.append(np.unique(np.stack([both[owner, 0], items[k, 1]], 1), axis=0))
    return hit, np.unique(np.concatenate(pairs), axis=0), found


def _longest(hashes: np.ndarray, doc: np.ndarray, hit: np.ndarray, tests: _Tests, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every hit word, in order: how many words match verbatim from there on, in any one item.

    One suffix array over the hit words and the found test words, each run of them closed by an end of its own,
    sorted by doubling; a word's longest match stands next to it among the test suffixes.
    """
    mine, theirs = np.flatnonzero(hit), np.flatnonzero(found)
    codes = np.concatenate([hashes[mine], tests.words[theirs]])
    run = np.concatenate([doc[mine], tests.part[theirs] + (doc[-1] + 1)])
    place = np.concatenate([mine, theirs])
    last = np.append((run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1), True)
    shift = np.concatenate([[0], np.cumsum(last)[:-1]]) + np.arange(len(codes))
    n = len(codes) + int(last.sum())
    rank = np.full(n, -1, dtype=np.int64)
    rank[shift] = np.unique(codes, return_inverse=True)[1].ravel()
    ends = np.flatnonzero(rank < 0)
    rank[ends] = len(codes) + np.arange(len(ends))
    levels = [rank]
    longest = int(np.diff(np.concatenate([[-1], ends])).max())
    while 1 << (len(levels) - 1) < longest:
        step = 1 << (len(levels) - 1)
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (2 * n + 1) + after, return_inverse=True)[1].ravel()
        levels.append(rank)
    order = np.argsort(rank, kind="stable")
    is_test = np.zeros(n, bool)
    is_test[shift[len(mine) :]] = True
    tested = is_test[order]
    at = np.arange(n)
    previous = np.maximum.accumulate(np.where(tested, at, -1))
    following = np.minimum.accumulate(np.where(tested, at, n)[::-1])[::-1]
    spot = np.empty(n, np.int64)
    spot[order] = at
    own = shift[: len(mine)]
    best = np.zeros(len(own), np.int64)
    for near in (previous[spot[own]], following[spot[own]]):
        ok = (near >= 0) & (near < n)
        x, y, m = own[ok], order[near[ok]], np.zeros(int(ok.sum()), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            m += (levels[k][x + m] == levels[k][y + m]).astype(np.int64) << k
        best[ok] = np.maximum(best[ok], m)
    return mine, best


def _result(ids, n_words, hit_spans, found, matches) -> pa.RecordBatch:
    """By document: hit_spans, maximal runs of hit words; found, its items; matches, its longest one as (words, start)."""
    names = [sorted(set(x)) for x in found]
    n_hit = [sum(e - s for s, e in x) for x in hit_spans]
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.record_batch(
        [
            ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()),
            pa.array([m[0] for m in matches], pa.int64()), pa.array([m[1] for m in matches], pa.int64()), pa.array(names, pa.list_(pa.string())),
            pa.array([[{"start": s, "end": e} for s, e in x] for x in hit_spans], kinds),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "match_start", "items", "spans"],
    )


def _shards(batch: pa.RecordBatch):
    """Runs of whole documents: first row, end row, word hashes, and the words before each document."""
    for row, end, buf, offsets in tx.text_chunks(batch, "text"):
        buf = tx.LOWER[buf]
        starts, ends, before = tx.words(buf, offsets, tx.ALNUM_SEPARATORS)
        yield row, end, tx.span_hashes(buf, starts, ends), before


def _runs(marked: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of marked words; none spans two documents."""
    inner = marked[1:] & marked[:-1] & (doc[1:] == doc[:-1])
    return np.flatnonzero(marked & ~np.concatenate([[False], inner])), np.flatnonzero(marked & ~np.concatenate([inner, [False]])) + 1


def _evidence(hashes: np.ndarray, before: np.ndarray, owner: np.ndarray, first: np.ndarray, n: int, tests: _Tests):
    """Hit spans, items and longest match of n documents, given as pieces of words: piece i is of document owner[i] and begins at its word first[i]."""
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    found: list[list[str]] = [[] for _ in range(n)]
    matches: list[tuple[int, int | None]] = [(0, None)] * n
    hit, pairs, met = _search(hashes, before, tests)
    if hit.any():
        piece = np.repeat(np.arange(len(owner)), np.diff(before))
        shift = first - before[:-1]
        s, e = _runs(hit, piece)
        for d, x, y in zip(owner[piece[s]].tolist(), (s + shift[piece[s]]).tolist(), (e + shift[piece[s]]).tolist(), strict=True):
            spans[d].append((x, y))
        for i, item in pairs.tolist():
            if item >= 0:
                found[owner[i]].append(tests.items[item])
        place, size = _longest(hashes, piece, hit, tests, met)
        doc, place = owner[piece[place]], place + shift[piece[place]]
        order = np.lexsort([place, -size, doc])  # by document the longest one first, then the earliest
        for k in order[np.unique(doc[order], return_index=True)[1]].tolist():
            matches[doc[k]] = (int(size[k]), int(place[k]))
    return spans, found, matches


def _scan(block):
    def run(batches):
        tests = block.value
        for batch in batches:
            for row, end, hashes, before in _shards(batch):
                n = end - row
                yield _result(batch.column(0).slice(row, n), np.diff(before), *_evidence(hashes, before, np.arange(n), np.zeros(n, np.int64), n, tests))

    return run


def _probes(hashes: np.ndarray, width: int, bits: int) -> Iterator[np.ndarray]:
    """The sieve's slots of all windows of a width."""
    value = tx.mix(tx.windows_hash(hashes, width) + np.uint64(width))
    step = tx.mix(value) | np.uint64(1)
    for _ in range(SIEVE_PROBES):
        yield (value >> np.uint64(64 - bits)).astype(np.int64)
        value = value + step


def _marks(window: int, bits: int):
    """Parts (words) to the sieve's bits: 64 of them a row."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                own = np.frombuffer(data, dtype=np.uint64)
                slots = np.unique(np.concatenate(list(_probes(own, min(window, len(own)), bits))))
                at, first = np.unique(slots >> 6, return_index=True)
                yield pa.record_batch([pa.array(at), tx.as_long(np.bitwise_or.reduceat(np.uint64(1) << (slots & 63).astype(np.uint64), first))], ["at", "mask"])

    return run


def _sift(sieve, bits: int, widths: list[int]):
    """Document rows to (doc_id, n_words, firsts, sizes, words): the runs of words that windows may cover; null if there are none."""

    def run(batches):
        marks = sieve.value
        for batch in batches:
            for row, end, hashes, before in _shards(batch):
                doc = np.repeat(np.arange(end - row), np.diff(before))
                may = np.zeros(len(hashes), bool)
                for width in widths:
                    at = None
                    for slots in _probes(hashes, width, bits):
                        at = np.arange(len(slots)) if at is None else at
                        own = slots[at]
                        at = at[(marks[own >> 6] >> (own & 63).astype(np.uint64)) & np.uint64(1) == 1]
                    at = at[at + width <= before[doc[at] + 1]]
                    may |= _covered(len(hashes), at, width)
                s, e = _runs(may, doc)
                runs = np.searchsorted(doc[s], np.arange(end - row + 1))
                kept = np.concatenate([[0], np.cumsum(may)])[before]
                none = pa.array(np.diff(runs) == 0)
                cells = [(s - before[doc[s]], runs), (e - s, runs), (hashes[may].view(np.int64), kept)]
                columns = [pc.if_else(none, pa.scalar(None, pa.binary()), tx.binary_rows(x.astype(np.int64).tobytes(), to * 8)) for x, to in cells]
                yield pa.record_batch([batch.column(0).slice(row, end - row), pa.array(np.diff(before), pa.int64()), *columns], ["doc_id", "n_words", "firsts", "sizes", "words"])

    return run


def _meet(window: int):
    """Rows (block, share, row, n_words, item, firsts, sizes, words), sorted; of each share of a block, the block's parts (row is null)
    come first and then runs of documents. Yields what _scan does, of documents with hits, by row."""

    def hits(held, tests):
        sizes = [np.frombuffer(r["sizes"], dtype=np.int64) for r in held]
        owner = np.repeat(np.arange(len(held)), [len(x) for x in sizes])
        before = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        hashes = np.frombuffer(b"".join(r["words"] for r in held), dtype=np.uint64)
        first = np.frombuffer(b"".join(r["firsts"] for r in held), dtype=np.int64)
        spans, found, matches = _evidence(hashes, before, owner, first, len(held), tests)
        at = [i for i, x in enumerate(spans) if x]
        of = lambda x: [x[i] for i in at]
        return _result(pa.array([held[i]["row"] for i in at], pa.int64()), [held[i]["n_words"] for i in at], of(spans), of(found), of(matches))

    def run(batches):
        key, parts, tests, held, n = None, [], None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if (r["block"], r["share"]) != key or n > CHUNK_WORDS:
                    if held:
                        yield hits(held, tests)
                    held, n = [], 0
                if (r["block"], r["share"]) != key:
                    key, parts, tests = (r["block"], r["share"]), [], None
                if r["row"] is None:
                    parts.append((r["item"], r["words"]))
                    continue
                if tests is None:
                    tests, parts = _Tests(parts, window), []
                held.append(r)
                n += len(r["words"]) // 8
        if held:
            yield hits(held, tests)

    return run


def _clean(block):
    """Whether a text has no hit."""

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            verdict = np.ones(len(text), bool)
            for row, end, hashes, before in _shards(pa.record_batch([text], ["text"])):
                hit = np.concatenate([[0], np.cumsum(_search(hashes, before, block.value)[0])])
                verdict[row:end] = hit[before[1:]] == hit[before[:-1]]
            yield pa.array(verdict)

    return clean


def _merged(table: pa.Table) -> pa.Table:
    """One row of a document from its rows of several blocks."""
    rows = table.to_pylist()
    spans: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for r in rows for x in r["spans"]):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    match = min(((r["longest_match"], r["match_start"]) for r in rows), key=lambda m: (-m[0], m[1] or 0))
    return pa.Table.from_batches([_result(table.column("doc_id").combine_chunks().slice(0, 1), [rows[0]["n_words"]], [spans], [[i for r in rows for i in r["items"]]], [match])])


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> tuple[DataFrame, int]:
    """Parts (item, words, n, block) of the benchmark in blocks of block_words words at most (an item's part is never cut further), and how many blocks."""
    parts = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(_item_words(window), "item string, part int, words binary, n long")
    parts = parts.select("item", "words", "n").distinct()
    count = max(1, -(-(parts.agg(F.sum("n")).first()[0] or 0) // block_words))
    if count > 1:
        parts = tx.reliable(parts)
    while True:
        own = parts.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(count)))
        most, large = own.groupBy("block").agg(F.sum("n").alias("n"), F.max("n").alias("m")).agg(F.max("n"), F.max("m")).first()
        if (most or 0) <= max(block_words, 2 * (large or 0)) or count == 1:
            return own, count
        count *= 2


def _shared(parts: DataFrame, window: int):
    """The only block, broadcast."""
    return parts.sparkSession.sparkContext.broadcast(_Tests([(r[0], bytes(r[1])) for r in parts.select("item", "words").collect()], window))


def _hits(docs: DataFrame, parts: DataFrame, count: int, window: int) -> tuple[DataFrame, DataFrame]:
    """Of documents (doc_id, text) and a benchmark of several blocks: a row (row, doc_id, n_words) for each document, and what _merged has of those with hits, by row."""
    words, *widths = parts.agg(F.sum("n"), *(F.max(F.least("n", F.lit(window)) == w) for w in range(1, window + 1))).first()
    bits = min(SIEVE_BITS, max(16, int(16 * words).bit_length()))
    found = parts.select("words").mapInArrow(_marks(window, bits), "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()  # 2**SIEVE_BITS bits at most
    marks = np.zeros(1 << (bits - 6), dtype=np.uint64)
    marks[found.column("at").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    sieve = docs.sparkSession.sparkContext.broadcast(marks)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sifted = docs.mapInArrow(_sift(sieve, bits, [w for w, there in enumerate(widths, 1) if there]), f"doc_id {kind}, n_words long, firsts binary, sizes binary, words binary")
    sifted = tx.reliable(sifted.withColumn("row", F.monotonically_increasing_id()))  # a key of each row's own, which outlives a retry
    runs = sifted.where("words is not null")
    shares = max(1, -(-(runs.agg(F.sum(F.length("words"))).first()[0] or 0) // (8 * SHARE_WORDS)))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tests = parts.select(F.col("block").cast("int").alias("block"), numbers(shares).alias("share"), none("row", "long"), none("n_words", "long"), "item", none("firsts", "binary"), none("sizes", "binary"), "words")
    runs = runs.select(numbers(count).alias("block"), F.pmod(F.xxhash64("row"), F.lit(shares)).cast("int").alias("share"), "row", "n_words", none("item", "string"), "firsts", "sizes", "words")
    both = tests.unionByName(runs).repartition("block", "share").sortWithinPartitions("block", "share", F.col("row").asc_nulls_first())
    return sifted.select("row", "doc_id", "n_words"), both.mapInArrow(_meet(window), RESULT).groupBy("doc_id").applyInArrow(_merged, RESULT).withColumnRenamed("doc_id", "row")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Where benchmark windows occur verbatim in the documents, one row per document row.

    Texts are lower-cased (A-Z) and cut into words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A window is `window`
    consecutive words of an item, or the whole item if it has fewer; a document word inside any
    occurrence of a window is hit. longest_match: the most words in a row that a document shares with one item
    (0 without a hit; of an item that is cut into parts, with a part), and match_start, the first word of the
    earliest such match. Only doc_id, item_id and text are read; other columns don't matter.

    Null or empty text: no words, never contaminated. An item with a null item_id hits like any other, but has no
    name to be listed or counted by. A repeated item counts once; repeated document rows (also of one doc_id, also
    a null one) each get their row. Empty benchmark: no hits.
    """
    docs = docs.select("doc_id", "text")
    parts, count = _blocks(benchmark, window, block_words)
    if count == 1:
        return docs.mapInArrow(_scan(_shared(parts, window)), RESULT)
    rows, hits = _hits(docs.withColumn("doc_id", F.col("doc_id").cast("long")), parts, count, window)
    missing = {"n_hit": F.lit(0), "n_items": F.lit(0), "items_sha256": F.sha2(F.lit(""), 256), "contaminated": F.lit(False), "longest_match": F.lit(0), "items": F.array(), "spans": F.array()}
    both = rows.join(hits.drop("n_words"), "row", "left")
    return both.select([(F.coalesce(c, missing[c].cast(hits.schema[c].dataType)) if c in missing else F.col(c)).alias(c) for c in ("doc_id", *hits.drop("row").columns)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without any hit, with all their columns. Each row is judged by its text alone. With a benchmark of
    one block nothing is shuffled; with more, contaminated texts are known by their SHA-256."""
    parts, count = _blocks(benchmark, window, block_words)
    if count == 1:
        return docs.where(_clean(_shared(parts, window))(docs["text"]))
    rows, hits = _hits(docs.select(F.sha2(F.col("text").cast("binary"), 256).alias("doc_id"), "text"), parts, count, window)
    bad = tx.reliable(rows.join(hits.select("row"), "row").select(F.col("doc_id").alias("_hit")).distinct())
    return docs.join(small(bad), F.sha2(docs["text"].cast("binary"), 256) == bad["_hit"], "left_anti")
