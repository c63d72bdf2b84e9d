"""Prefix trie of rebuilt conversations: mergeable partial node tables and one rollup, whatever the depth.

A node is known by its depth and two hashes of its turns, modulo 2**61 - 1. Such a hash is a sum over turns, so a conversation
is cut into chunks that find their prefix hashes apart: a chunk needs only the sum of those before it. So no task holds a
conversation, and none of its turns waits for another's.

Every partition emits the nodes of its chunks and combines them locally (a partial aggregate); the tables are then merged by
node key. Lists of conversation ends are sorted in pieces of bounded size; only pieces meet at their node. The rollup from the
leaves up is a suffix sum along each path, merged by node: a member adds to a node the words from there to its end, and takes
off those of the nodes it stands for (of which it is the smallest member), so that each node of the subtree counts once for
every member but one. A round per level would need as many shuffles as the longest conversation has turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import text as tx

#: Turns of a chunk, ids of a piece of an end list, and the most parents whose children are met by broadcast.
CHUNK, PIECE, HOT = 1024, 1 << 16, 1 << 16
#: Modulus and bases of the two hashes.
PRIME, BASES = (1 << 61) - 1, (0x1B873593A4C1E6D7, 0x0E6546B64C2F91B5)
_U, _STEP = np.uint64, 4096


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of unsigned values below it."""
    low, mask = _U(31), _U((1 << 31) - 1)
    ah, al, bh, bl = a >> low, a & mask, b >> low, b & mask
    mid = ah * bl + al * bh
    return rest(ah * bh * _U(2) + (mid >> _U(30)) + ((mid & _U((1 << 30) - 1)) << low) + al * bl)


def rest(x: np.ndarray) -> np.ndarray:
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.where(x >= _U(PRIME), x - _U(PRIME), x)


_tables: dict[int, np.ndarray] = {}


def powers(base: int, at: np.ndarray) -> np.ndarray:
    """base ** at modulo PRIME."""
    if base not in _tables:
        out = [1]
        for _ in range(_STEP - 1):
            out.append(out[-1] * base % PRIME)
        _tables[base] = np.array(out, _U)
    high, inverse = np.unique(at // _STEP, return_inverse=True)
    return times(_tables[base][at % _STEP], np.array([pow(base, int(q) * _STEP, PRIME) for q in high], _U)[inverse])


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums modulo PRIME inside runs of these sizes, which begin at starts."""
    out = np.zeros(len(values), _U)
    for shift in (_U(0), _U(32)):
        part = np.concatenate([np.zeros(1, _U), np.cumsum((values >> shift) & _U(0xFFFFFFFF))])
        own = rest(part[1:] - np.repeat(part[starts], sizes))
        out = rest(out + (times(own, np.full(1, 1 << 32, _U)) if shift else own))
    return out


def _flat(column: pa.Array, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int64)))


_CHUNK_TYPE = "conv_id long, part long, at long, n long, d1 array<long>, d2 array<long>, words array<long>"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv_id, part, d1, d2, words) to chunks of one conversation."""
    made = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, part, *rows = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        new = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        place = np.arange(len(conv)) - np.repeat(new, np.diff(np.append(new, len(conv))))
        first = np.flatnonzero(place % CHUNK == 0)
        sizes = np.diff(np.append(first, len(conv)))
        yield pa.record_batch([pa.array(conv[first]), pa.array(part[first].astype(np.int64)), pa.array(made + np.arange(len(first))), pa.array(sizes), *[_lists(r, sizes) for r in rows]], ["conv_id", "part", "at", "n", "d1", "d2", "words"])
        made += len(first)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their heads to chunks of the rebuilt conversation: its first ones begin with the head, own turns before h go."""
    for batch in batches:
        get = dict(zip(batch.schema.names, batch.columns, strict=True))
        offset, n, h, m = (get[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("offset", "n", "h", "m"))
        skip = np.clip(h - offset, 0, n)
        lead = np.where(offset == 0, m, 0)
        kept = n - skip
        size = lead + kept
        start = np.where(offset == 0, 0, m + np.maximum(0, offset - h))
        own_from, head_from = np.cumsum(n) - n, np.cumsum(m) - m
        which = np.repeat(np.arange(len(n)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        headed = place < lead[which]
        columns = []
        for own, head in (("d1", "head1"), ("d2", "head2"), ("words", "head_words")):
            both = np.concatenate([_flat(get[own]), _flat(get[head])])
            at = np.where(headed, n.sum() + head_from[which] + place, own_from[which] + skip[which] + place - lead[which])
            columns.append(both[at])
        at = start[which] + place
        totals = []
        ends = np.cumsum(size)
        for d, base in zip(columns, BASES, strict=False):
            run = _sums(times(d.astype(_U), powers(base, at)), ends - size, size) if len(d) else np.zeros(0, _U)
            totals.append(np.where(size > 0, np.append(run, _U(0))[np.maximum(ends, 1) - 1], _U(0)).astype(np.int64))
        words = np.append(np.cumsum(columns[2]), 0)
        total = np.where(size > 0, words[np.maximum(ends, 1) - 1] - np.where(ends > size, words[np.maximum(ends - size, 1) - 1], 0), 0)
        names = ["conv_id", "offset", "start", "d1", "d2", "words", "t1", "t2", "total"]
        yield pa.record_batch([get["conv_id"], get["offset"], pa.array(start), *[_lists(c, size) for c in columns], *map(pa.array, totals), pa.array(total.astype(np.int64))], names)


_PLACED = "conv_id long, offset long, start long, d1 array<long>, d2 array<long>, words array<long>, t1 long, t2 long, total long"


def placed_chunks(rows: DataFrame) -> DataFrame:
    """The rebuilt conversations in chunks, with what comes before each: hash sums (before_*), words, and whether it is the last."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat_ws(":", F.length(role), role, text))
    turns = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("d1"), F.conv(F.substring(digest, 16, 15), 16, 10).cast("long").alias("d2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "d1", "d2", "tie"]  # equal turns are alike, and may be dealt out by the last
    turns = turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *order)
    chunks = tx.reliable(turns.select("conv_id", "part", "d1", "d2", "words").mapInArrow(_pack, _CHUNK_TYPE))
    before = Window.partitionBy("conv_id").orderBy("part", "at").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    first = chunks.where("offset < 3 and conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.posexplode(F.slice(F.arrays_zip("d1", "d2", "words"), 1, 3)).alias("_in", "x"), (F.col("offset") + F.col("_in")).alias("place"))
    heads = first.where("place < 3").groupBy("base").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("head"))  # three turns at most
    chunks = chunks.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4)).withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int"))
    field = lambda f: F.transform("head", lambda t: t["x"][f])
    chunks = chunks.withColumn("head", head).select("conv_id", "offset", "n", "h", F.size("head").cast("long").alias("m"), "d1", "d2", "words", field("d1").alias("head1"), field("d2").alias("head2"), field("words").alias("head_words"))
    rebuilt = chunks.mapInArrow(_rebuild, _PLACED).where("size(d1) > 0 or offset = 0")
    in_order = Window.partitionBy("conv_id").orderBy("offset")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(e).over(earlier), F.lit(0)).alias(n) for n, e in (("low1", F.expr("t1 & 4294967295")), ("high1", F.expr("t1 >> 32")), ("low2", F.expr("t2 & 4294967295")), ("high2", F.expr("t2 >> 32")), ("words_before", F.col("total")))]
    return tx.reliable(rebuilt.select("conv_id", "offset", "start", "d1", "d2", "words", *sums, F.sum("total").over(Window.partitionBy("conv_id")).alias("words_all"), F.lead("offset").over(in_order).isNull().alias("last")))


def _paths(ends_only: bool = False, extra: int = 0):
    """Chunks to the nodes on their conversations' paths; the first chunk brings the root. The last `extra` columns follow their chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = dict(zip(batch.schema.names, batch.columns, strict=True))
            number = lambda k: get[k].to_numpy(zero_copy_only=False)  # noqa: E731, B023
            size = get["d1"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            start, ends = number("start"), np.cumsum(size)
            which = np.repeat(np.arange(len(size)), size)
            at = np.arange(size.sum()) - np.repeat(ends - size, size) + start[which]
            first = np.flatnonzero(start + np.where(number("offset") == 0, 0, 1) == 0)
            hashes, parents = [], []
            for k, base in enumerate(BASES, 1):
                low, high = number(f"low{k}").astype(_U), number(f"high{k}").astype(_U)
                before = rest(rest(low) + times(rest(high), np.full(1, 1 << 32, _U)))
                own = rest(_sums(times(_flat(get[f"d{k}"], _U), powers(base, at)), ends - size, size) + before[which])
                parent = np.append(_U(0), own)[: len(own)]
                opens = (ends - size)[size > 0]
                parent[opens] = before[size > 0]
                hashes.append(np.concatenate([own, np.zeros(len(first), _U)]).astype(np.int64))
                parents.append(np.concatenate([parent, np.zeros(len(first), _U)]).astype(np.int64))
            words = _flat(get["words"])
            run_words = np.append(0, np.cumsum(words))
            left = number("words_all")[which] - number("words_before")[which] - (run_words[:-1] - np.repeat(run_words[ends - size], size))
            last = number("last").astype(bool)
            end = np.zeros(len(which) + len(first), np.int64)
            end[ends[last & (size > 0)] - 1] = 1
            end[len(which) :] = (last & (size == 0))[first]
            which = np.concatenate([which, first])
            columns = [np.concatenate([at + 1, np.zeros(len(first), np.int64)]), *hashes, *parents, np.concatenate([words, np.zeros(len(first), np.int64)]), np.concatenate([left, number("words_all")[first]]), end]
            keep = np.flatnonzero(end) if ends_only else slice(None)
            which = pa.array(which[keep])
            names = ["depth", "h1", "h2", "p1", "p2", "words", "rest", "end"]
            passed = [(n, get[n].take(which)) for n in ["conv_id", *batch.schema.names[len(batch.schema.names) - extra :]]] if extra else [("conv_id", get["conv_id"].take(which))]
            yield pa.record_batch([*[pa.array(c[keep]) for c in columns], *[c for _, c in passed]], [*names, *[n for n, _ in passed]])

    return run


_NODE = "depth long, h1 long, h2 long, p1 long, p2 long, words long, rest long, end long, conv_id long"
_KEY = ["depth", "h1", "h2"]


def _end_lists(placed: DataFrame) -> DataFrame:
    """depth, h1, h2 and ends_sha256 of the nodes where conversations end: sorted pieces first, which are then hashed in order."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, h1, h2, conv = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(conv):
                continue
            cut = np.flatnonzero(np.concatenate([[True], (depth[1:] != depth[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
            cut = sorted({a for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(conv)], strict=True) for a in range(s, e, PIECE)})
            texts = [",".join(map(str, conv[s:e].tolist())) for s, e in zip(cut, [*cut[1:], len(conv)], strict=True)]
            yield pa.record_batch([*[pa.array(c[cut]) for c in (depth, h1, h2, conv)], pa.array(texts)], [*_KEY, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(4), strict=True):
                if key != held:
                    if held:
                        done.append((*held, state.hexdigest()))
                    held, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            yield pa.record_batch([pa.array([d[k] for d in done], pa.string() if k == 3 else pa.int64()) for k in range(4)], [*_KEY, "ends_sha256"])
        if held:
            yield pa.record_batch([pa.array([x], pa.string() if k == 3 else pa.int64()) for k, x in enumerate((*held, state.hexdigest()))], [*_KEY, "ends_sha256"])

    ends = placed.where("last").mapInArrow(_paths(ends_only=True), _NODE).select(*_KEY, "conv_id")
    sorted_ends = ends.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    parts = sorted_ends.mapInArrow(pieces, "depth long, h1 long, h2 long, first long, ids string")
    return parts.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digest, "depth long, h1 long, h2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then by a digest of role and text; repeated rows are turns of their own. Null role or
    text: empty. Rows without a conv_id are left out. Every conversation begins with the first turns of conv_id - conv_id % 20, as
    many as its id's CRC-32 modulo 4 says. An empty table has no nodes, not even a root. Other columns are not read.
    hot: no more parents than that are broadcast to their children, by a bound on how many can have so many of them.
    """
    placed = placed_chunks(rows)
    members = placed.mapInArrow(_paths(), _NODE)
    nodes = members.groupBy(*_KEY).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.sum("end").alias("n_ends"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("words").alias("words"))
    nodes = tx.reliable(nodes)
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")
    stands = nodes.groupBy(F.col("rep").alias("conv_id")).agg(F.min("depth").alias("top"), F.sum("words").alias("own_words"), F.max(leaf).alias("leaf"))  # from a depth on, a conversation stands for its path
    known = placed.join(stands, "conv_id", "left").select(*placed.columns, "top", "own_words", "leaf")
    paths = known.mapInArrow(_paths(extra=3), _NODE + ", top long, own_words long, leaf long")
    saved = F.when(F.col("depth") >= F.col("top"), F.lit(0)).otherwise(F.col("rest") - F.coalesce("own_words", F.lit(0)))
    zero = F.lit(0).cast("long")
    parts = [
        nodes.select(*_KEY, "p1", "p2", "rep", "n_convs", zero.alias("child"), zero.alias("leaf"), zero.alias("saved"), F.lit(False).alias("opens"), F.lit(None).cast("string").alias("ends_sha256")),
        nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2"), F.lit(1).cast("long").alias("child")),
        paths.select(*_KEY, F.coalesce("leaf", F.lit(0)).alias("leaf"), saved.alias("saved"), F.coalesce(F.col("depth") == F.col("top"), F.lit(False)).alias("opens")),
        _end_lists(placed),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    own = [F.max(c).alias(c) for c in ("p1", "p2", "rep", "n_convs", "opens", "ends_sha256")] + [F.coalesce(F.sum(c), zero).alias(c) for c in ("child", "leaf", "saved")]
    table = tx.reliable(every.groupBy(*_KEY).agg(*own))
    # A node has its parent's conversation unless it is the first that its own stands for. Parents of many children are few.
    least = max(4096, -(-table.count() // hot))
    up = table.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("rep").alias("parent"), "child")
    first = table.where("opens and depth > 0").join(F.broadcast(up.where(F.col("child") >= least).drop("child")), ["depth", "p1", "p2"], "left")  # hot rows at most
    met = first.where("parent is not null")
    others = first.where("parent is null").drop("parent").join(up.where(F.col("child") < least).drop("child"), ["depth", "p1", "p2"])
    rest_of = table.where("not (opens and depth > 0)").withColumn("parent", F.when(F.col("depth") > 0, F.col("rep")))
    out = met.unionByName(others).unionByName(rest_of)
    return out.select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.col("child").alias("n_children"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
