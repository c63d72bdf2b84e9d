"""Near-duplicate documents with an LSH forest over MinHash signatures.

Equal shingle sets are one node. Every tree of the forest sorts the nodes by its own order of the
signature; nodes that share the first DEPTH entries form a region. Inside a region the depth adapts: in a
small one every two nodes are candidates, in a larger one each node meets its neighbours by longest common
prefix and the region's pivots (the nodes closest to the most common signature, one after the other, until
every node has been near one). So a group of n copies costs O(n) candidates, not n * n / 2.

Candidates are confirmed on full shingle sets, and links are contracted to components. What such a region has
left is tried once and for all: its nodes of different components are compared by sketch, all of them, and
those with candidates meet again with their texts, so that a candidate pair is confirmed or refused where it is
found and never travels. A pair that shares several regions is tried in the first of them; a pair that links
have connected meanwhile is not tried at all.

In the first round a region's rows stream through one task in sorted order, at most BLOCK of them in memory
at once; each block shares a row with the next. Then a region of more than BLOCK rows is dealt into cells: its
nodes outside the largest component meet in pairs of half blocks, and each half block of them meets each half
block of the largest component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import text as tx

_U = np.uint64
HASHES = 64
DEPTH = 3
TREES = HASHES // DEPTH
BLOCK = 8192
SMALL = 8
#: Bytes of shingle sets that a task keeps at once.
KEPT_BYTES = 256 << 20
#: Of the 64 4-bit sketch entries so many agree at least in a candidate; at a similarity of 0.8, 52 do on average (sd 3.1).
AGREE = 37

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.int64).astype(_U) | _U(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.int64).astype(_U)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 52-bit hashes of every document's distinct shingles, and where each document's begin.

    A document of fewer words has its whole word sequence as one shingle; one without words has none.
    """
    buf = tx.LOWER[buf]
    starts, ends, before = tx.words(buf, offsets, tx.SPACE_SEPARATORS)
    hashes = tx.span_hashes(buf, starts, ends)
    n = np.diff(before)
    grams = tx.windows_hash(hashes, size)
    doc = np.repeat(np.arange(len(n)), n)
    ok = np.arange(len(grams)) + size <= before[doc[: len(grams)] + 1] if len(grams) else np.zeros(0, bool)
    keys, owner = [grams[ok]], [doc[: len(grams)][ok]]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            own = before[short]
            value = np.zeros(len(short), dtype=_U)
            for j in range(k):
                value = tx.mix(value * _U(31) + hashes[own + j])
            keys.append(tx.mix(value ^ _U(k)))
            owner.append(short)
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    packed = np.unique((owner.astype(_U) << _U(52)) | (keys >> _U(12)))
    at = np.append(np.searchsorted(packed, np.arange(len(n), dtype=_U) << _U(52)), len(packed))  # of 4096 documents, the end has no 64 bits
    return packed & _U((1 << 52) - 1), at


def _signatures(size: int):
    names = ["doc_id", "text_key", "n_shingles", "node", "sig"]

    def run(batches):
        for batch in batches:
            for row, end, buf, offsets in tx.text_chunks(batch, "text", 1 << 20):
                sets, at = shingle_sets(buf, offsets, size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                sig = np.zeros((end - row, HASHES), dtype=np.uint32)
                node = np.zeros(end - row, dtype=_U)
                if len(full):
                    first = at[full]
                    work = np.empty_like(sets)
                    for k in range(HASHES):
                        np.multiply(sets, _A[k], out=work)
                        work += _B[k]
                        sig[full, k] = (np.minimum.reduceat(work, first) >> _U(32)).astype(np.uint32)
                    node[full] = tx.mix(np.add.reduceat(tx.mix(sets + _U(1)), first) ^ n[full].astype(_U))
                data = tx.binary_rows(sig.tobytes(), np.arange(end - row + 1) * 4 * HASHES)
                yield pa.record_batch([batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(n, pa.int64()), pa.array(node.view(np.int64), mask=n == 0), data], names)

    return run


def _sigs_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


def _regions(sig: np.ndarray):
    """A hash of every node's region in each tree."""
    for t in range(TREES):
        value = np.full(len(sig), t + 1, dtype=_U)
        for k in range(DEPTH):
            value = tx.mix(value * _U(0x9E3779B97F4A7C15) + sig[:, (DEPTH * t + k) % HASHES])
        yield value


def _labels(batches):
    """A node's place in each tree: the region (its first DEPTH entries) and the order inside (the next eight, a byte of each)."""
    for batch in batches:
        sig, node = _sigs_of(batch.column(1)), batch.column(0)
        region, order = [], []
        for t, value in enumerate(_regions(sig)):
            tail = np.zeros(len(sig), dtype=_U)
            for k in range(8):
                tail = (tail << _U(8)) | (sig[:, (DEPTH * (t + 1) + k) % HASHES] & np.uint32(255)).astype(_U)
            region.append(value)
            order.append(tail)
        yield pa.record_batch([tx.as_long(np.concatenate(region)), tx.as_long(np.concatenate(order)), pa.concat_arrays([node] * TREES)], ["region", "place", "node"])


def _groups(batches, key: int, most: float = BLOCK):
    """Arrow rows, sorted by their key column, as lists of slices, one list for each key (or for each block of most rows); streaming."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and keys[s] != last:
                yield held
                held = []
            last = keys[s]
            held.append(batch.slice(s, e - s))
            if sum(b.num_rows for b in held) >= most and e == len(keys):
                yield held
                held = [held[-1].slice(held[-1].num_rows - 1, 1)]  # the next block of this region begins with the last row of this one
    if held:
        yield held


def _with_company(batches):
    """Only the rows of regions with several nodes."""
    carry = None  # a region may go on in the next batch
    for batch in batches:
        batch = pa.record_batch(batch.columns, batch.schema.names)
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        n = batch.num_rows
        if not n:
            continue
        region = batch.column(0).to_numpy(zero_copy_only=False)
        keep = np.zeros(n, bool)
        keep[1:] = region[1:] == region[:-1]
        keep[:-1] |= region[1:] == region[:-1]
        known = carry is not None and carry.schema.metadata == {b"kept": b"1"}
        if n > 1:
            yield batch.slice(int(known), n - 1 - int(known)).filter(pa.array(keep[int(known) : n - 1]))
        elif known:
            carry = batch
            continue
        if keep[n - 1]:  # it is kept whatever follows
            yield batch.slice(n - 1, 1)
        carry = batch.slice(n - 1, 1).replace_schema_metadata({"kept": "1"} if keep[n - 1] else None)


def _agreement(nib: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (nib == one).sum(1)


def _region_pairs(node, size, nib, numerator: int, denominator: int) -> set[tuple[int, int]]:
    """The first round's candidate pairs (row numbers) of one block of a region: all of a small one."""
    m = len(node)
    found: set[tuple[int, int]] = set()
    close = lambda i, at: at[(node[at] != node[i]) & (_agreement(nib[at], nib[i]) >= AGREE) & (np.minimum(size[at], size[i]) * denominator >= np.maximum(size[at], size[i]) * numerator)]
    note = lambda i, at: found.update((min(i, j), max(i, j)) for j in at.tolist())
    if m <= SMALL:
        for i in range(m - 1):
            note(i, close(i, np.arange(i + 1, m)))
        return found
    for i in range(m - 1):  # neighbours by longest common prefix
        note(i, close(i, np.arange(i + 1, min(m, i + 2))))
    rest = np.arange(m)
    while len(rest) > 1:
        counts = np.bincount((np.arange(HASHES) * 16 + nib[rest]).ravel(), minlength=16 * HASHES).reshape(HASHES, 16)
        pivot = int(rest[_agreement(nib[rest], counts.argmax(1)).argmax()])
        rest = rest[rest != pivot]
        near = close(pivot, rest)
        note(pivot, near)
        rest = np.setdiff1d(rest, near, assume_unique=True)
    return found


def _nibbles(column: pa.ChunkedArray) -> np.ndarray:
    sketch = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, HASHES // 2)
    return np.concatenate([sketch >> 4, sketch & 15], axis=1)


def _candidates(numerator: int, denominator: int):
    """The first round's candidate pairs of regions."""

    def run(batches):
        a, b = [], []
        for held in _groups(batches, 0):
            rows = pa.Table.from_batches(held)
            if rows.num_rows < 2:
                continue
            node, size = rows.column(2).to_numpy(), rows.column(3).to_numpy()
            for i, j in _region_pairs(node, size, _nibbles(rows.column(4)), numerator, denominator):
                a.append(min(node[i], node[j]))
                b.append(max(node[i], node[j]))
            if len(a) > 50_000:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


class _Cell:
    """Rows (cell, node, comp, size, sketch, labels) of one cell."""

    def __init__(self, held: list[pa.RecordBatch], numerator: int, denominator: int):
        rows = pa.Table.from_batches(held)
        self.rows, self.numerator, self.denominator = rows, numerator, denominator
        self.node, self.comp, self.size = (rows.column(k).to_numpy() for k in (1, 2, 3))
        self.nib = _nibbles(rows.column(4))
        labels = np.frombuffer(b"".join(rows.column(5).to_pylist()), dtype=np.uint32).reshape(-1, TREES)
        self.before = labels[:, : int((labels == labels[0]).all(0).argmax())]  # regions of earlier trees

    def partners(self, i: int, at: np.ndarray) -> np.ndarray:
        """Those of the rows `at` that are candidates of row i and share no earlier region with it; the closest first."""
        at = at[(self.comp[at] != self.comp[i]) & (np.minimum(self.size[at], self.size[i]) * self.denominator >= np.maximum(self.size[at], self.size[i]) * self.numerator)]
        agree = _agreement(self.nib[at], self.nib[i])
        at, agree = at[agree >= AGREE], agree[agree >= AGREE]
        first = ~(self.before[at] == self.before[i]).any(1)
        return at[first][np.argsort(-agree[first], kind="stable")]


def _company(numerator: int, denominator: int):
    """(cell, node) of the nodes that have candidates in their cell."""

    def run(batches):
        for held in _groups(batches, 0, np.inf):  # a cell has BLOCK rows or so
            c = _Cell(held, numerator, denominator)
            _, number, many = np.unique(c.comp, return_inverse=True, return_counts=True)
            met, every = np.zeros(len(c.node), bool), np.arange(len(c.node))
            for i in np.flatnonzero(number != many.argmax()).tolist():
                at = c.partners(i, every)
                met[at] = True
                met[i] |= len(at) > 0
            yield pa.record_batch([c.rows.column(0).combine_chunks().filter(pa.array(met)), pa.array(c.node[met])], ["cell", "node"])

    return run


class _Sets:
    """Shingle sets of rows with compressed texts, made when they are asked for; some KEPT_BYTES are kept."""

    def __init__(self, packed: list[bytes], size: int):
        self.packed, self.size, self.kept, self.bytes = packed, size, {}, 0

    def __getitem__(self, i: int) -> np.ndarray:
        if i not in self.kept:
            if self.bytes > KEPT_BYTES:
                self.kept, self.bytes = {}, 0
            unpack = zstandard.ZstdDecompressor().decompress
            texts: list[bytes] = []
            while i + len(texts) < len(self.packed) and len(texts) < 1000 and sum(map(len, texts)) < 1 << 18:
                texts.append(unpack(self.packed[i + len(texts)]))
            sets, at = shingle_sets(np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), self.size)
            for k in range(len(texts)):
                self.kept[i + k] = sets[at[k] : at[k + 1]]
            self.bytes += sets.nbytes
        return self.kept[i]


def _linked(size: int, numerator: int, denominator: int):
    """Rows of _Cell with the compressed text as the last column: the confirmed links of each cell, without those inside of what links connect already."""

    def run(batches):
        for held in _groups(batches, 0, np.inf):
            c = _Cell(held, numerator, denominator)
            sets = _Sets(c.rows.column(6).to_pylist(), size)
            of = {x: x for x in c.comp.tolist()}

            def top(x, of=of):
                while of[x] != x:
                    of[x] = x = of[of[x]]
                return x

            a, b = [], []
            for i in range(len(c.node) - 1):
                for j in c.partners(i, np.arange(i + 1, len(c.node))).tolist():
                    x, y = top(int(c.comp[i])), top(int(c.comp[j]))
                    if x == y:
                        continue
                    own, other = sets[i], sets[j]
                    k = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    both = int((own[k] == other).sum())
                    if denominator * both >= numerator * (len(own) + len(other) - both):
                        of[x] = y
                        a.append(c.node[i])
                        b.append(c.node[j])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _sketches(batches):
    for batch in batches:
        low = (_sigs_of(batch.column(2)) & np.uint32(15)).astype(np.uint8)
        half = HASHES // 2
        data = ((low[:, :half] << 4) | low[:, half:]).tobytes()
        labels = np.stack([x.astype(np.uint32) for x in _regions(_sigs_of(batch.column(2)))], axis=1)
        yield pa.record_batch([batch.column(0), batch.column(1), tx.binary_rows(data, np.arange(len(low) + 1) * half), tx.binary_rows(labels.tobytes(), np.arange(len(low) + 1) * 4 * TREES)], ["node", "size", "sketch", "labels"])


def _compressed(batches):
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([pack(t or b"") for t in batch.column(1).to_pylist()], pa.binary())], ["node", "packed"])


def _confirm(size: int, numerator: int, denominator: int):
    """Rows (hub, part, member, packed), sorted, a hub's own text (null member) first; yields the confirmed links."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        hub, own = None, None
        for batch in batches:
            hubs, members = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = [unpack(x) for x in batch.column(3).to_pylist()]
            a, b, at = [], [], 0
            while at < len(texts):
                to, seen = at, 0
                while to < len(texts) and (to == at or seen + len(texts[to]) <= 1 << 20) and to - at < 4096:
                    seen += len(texts[to])
                    to += 1
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts[at:to]])])
                sets, begin = shingle_sets(np.frombuffer(b"".join(texts[at:to]), dtype=np.uint8), offsets, size)
                for i in range(at, to):
                    mine = sets[begin[i - at] : begin[i - at + 1]]
                    if members[i] is None:
                        hub, own = hubs[i], mine.copy()
                        continue
                    assert hub == hubs[i]
                    k = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                    both = int((own[k] == mine).sum())
                    if denominator * both >= numerator * (len(own) + len(mine) - both):
                        a.append(hubs[i])
                        b.append(members[i])
                at = to
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _cells(rows: DataFrame, block: int) -> DataFrame:
    """cell and node for the rows (region, node, comp) of regions of more than SMALL nodes in several components; every
    two nodes of a region that are not both in its largest component share a cell, and a cell has some block rows at most."""
    half = max(1, block // 2)
    comps = rows.groupBy("region", "comp").agg(F.count("*").alias("n"))
    tops = comps.groupBy("region").agg(F.sum("n").alias("_n"), F.max(F.struct("n", "comp")).alias("_top"), F.count("*").alias("_comps")).where(f"_comps > 1 and _n > {SMALL}")
    tops = tx.reliable(tops.select("region", "_n", F.col("_top.comp").alias("_main"), F.ceil((F.col("_n") - F.col("_top.n")) / half).alias("_r"), F.ceil(F.col("_top.n") / half).alias("_l")))
    rows = rows.join(tops, "region").withColumn("_in", F.col("comp") == F.col("_main"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("node"), F.when(F.col("_in"), F.col("_l")).otherwise(F.col("_r"))))
    cell = F.expr(f"""case when _n <= {block} then array(0L)
        when _in then transform(sequence(0L, _r - 1), s -> s * (_r + _l) + _r + _own)
        else concat(transform(sequence(0L, _r - 1), s -> least(s, _own) * (_r + _l) + greatest(s, _own)), transform(sequence(0L, _l - 1), t -> _own * (_r + _l) + _r + t)) end""")
    return rows.select("region", F.explode(cell).alias("_cell"), "node").select(F.xxhash64("region", "_cell").alias("cell"), "node")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node that it is connected with), for the nodes of edges (a, b).

    Alternates large-star and small-star steps, each a grouped minimum and a join, until nothing changes.
    """
    edges = tx.reliable(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    measure = lambda e: e.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)"))).first()
    state = measure(edges)
    while True:
        if not state[0]:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("comp"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        large = tx.reliable(large)
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.select(F.col("m").alias("u"), "v").unionByName(small.select(F.col("m").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
        edges = tx.reliable(small)
        before, state = state, measure(edges)
        if state == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("comp")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct())


def _links(pairs: DataFrame, texts: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """The pairs that full shingle sets confirm. A node with many partners is the hub: its text travels once for each 500 of them."""
    ends = pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x"))).groupBy("x").agg(F.count("*").alias("n"))
    at_a, at_b = (tx.reliable(ends.select(F.col("x").alias(x), F.col("n").alias(f"n{x}"))) for x in "ab")  # written, so that the joins can split a hub
    both = pairs.join(at_a, "a").join(at_b, "b")
    swap = F.col("nb") > F.col("na")
    both = both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("member"), F.greatest("na", "nb").alias("n"))
    both = tx.reliable(both.withColumn("part", F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / 500)).cast("int")).select("hub", "part", "member"))
    members = both.join(texts, both["member"] == texts["node"]).select("hub", "part", "member", "packed")
    hubs = both.select("hub", "part").distinct().join(texts, F.col("hub") == texts["node"]).select("hub", "part", F.lit(None).cast("long").alias("member"), "packed")
    rows = hubs.unionByName(members).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("member").asc_nulls_first())
    return rows.mapInArrow(_confirm(size, numerator, denominator), "a long, b long")


def _merged(state: DataFrame, links: DataFrame) -> DataFrame:
    """state with its components merged by the links (a, b) of nodes."""
    of = state.select("node", "comp")
    met = links.join(of.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(of.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    merged = connected_components(met.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return tx.reliable(state.join(merged, "comp", "left").select("node", "size", "sketch", "labels", F.coalesce("to", "comp").alias("comp")))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept for every row of docs.

    Lower-cases A-Z and takes words [^\\x20\\x09-\\x0D]+ of whole texts. A document's set: its distinct
    shingles of `shingle` words; with fewer words the whole sequence as one; without words or text, empty,
    and then it is linked with nothing. Documents are linked if 100 * intersection >= percent * union.
    component_id is the smallest doc_id that links reach (null doc_ids come last: null only if there is no
    other); kept says that it is the row's own. Repeated rows and rows that share a doc_id are linked by their
    texts like any others and each get their row. Only doc_id and text are read; an empty table gives no rows.

    Equal sets always meet. Different ones share a region with a probability of 1 - (1 - J**3)**21 per
    pair of similarity J (0.9999997 at 0.8); all that share one and agree in AGREE sketch entries are tried,
    unless links connect them already. block: rows of a region that one task holds at once.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    sigs = tx.reliable(docs.mapInArrow(_signatures(shingle), "doc_id long, text_key long, n_shingles long, node long, sig binary"))
    nodes = sigs.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", F.col("n_shingles").alias("size"))).alias("x"), F.min("sig").alias("sig"))
    nodes = tx.reliable(nodes.select("node", "x.doc_id", "x.text_key", "x.size", "sig"))
    places = nodes.select("node", "sig").mapInArrow(_labels, "region long, place long, node long").repartition("region").sortWithinPartitions("region", "place", "node")
    places = tx.reliable(places.mapInArrow(_with_company, "region long, place long, node long"))
    company = tx.reliable(places.select("node").distinct())
    wanted = nodes.join(company, "node", "left_semi").select("node", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["text_key"] == F.col("_key"))).select("node", F.col("text").cast("binary").alias("text"))
    texts = tx.reliable(texts.mapInArrow(_compressed, "node long, packed binary").dropDuplicates(["node"]))
    state = nodes.join(company, "node", "left_semi").select("node", "size", "sig").mapInArrow(_sketches, "node long, size long, sketch binary, labels binary")
    state = tx.reliable(state)
    rows = places.join(state, "node").select("region", "place", "node", "size", "sketch").repartition("region").sortWithinPartitions("region", "place", "node")
    pairs = tx.reliable(rows.mapInArrow(_candidates(percent, 100), "a long, b long").distinct())
    state = _merged(state.withColumn("comp", F.col("node")), _links(pairs, texts, shingle, percent, 100))
    cells = _cells(places.join(state.select("node", "comp"), "node").select("region", "node", "comp"), block)
    rows = cells.join(state, "node").select("cell", "node", "comp", "size", "sketch", "labels").repartition("cell").sortWithinPartitions("cell", "node")
    met = tx.reliable(rows.mapInArrow(_company(percent, 100), "cell long, node long"))
    rows = met.join(state, "node").join(texts, "node").select("cell", "node", "comp", "size", "sketch", "labels", "packed").repartition("cell").sortWithinPartitions("cell", "node")
    state = _merged(state, rows.mapInArrow(_linked(shingle, percent, 100), "a long, b long"))
    final = nodes.select("node", "doc_id").join(state.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = tx.reliable(final.groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    final = final.join(least, "comp").select(F.col("node").alias("_node"), "component_id")
    out = sigs.select("doc_id", "text_key", "n_shingles", "node").join(final, F.col("node") == F.col("_node"), "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_first_of_groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns; repeated rows (one doc_id, one text) become one."""
    kept = near_duplicates(docs, shingle, percent).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.struct(*docs.columns).alias("row"))
    own = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (rows["text_key"] == kept["_key"]), "left_semi")
    return own.dropDuplicates(["doc_id", "text_key"]).select("row.*")
