"""Approximate nearest neighbours with learned partitions of a neighbour graph.

1. A bounded sample (SAMPLE vectors, chosen by hash of the id) gets an exact neighbour graph, by blocks in Spark tasks.
2. The graph is partitioned in balance: from a balanced clustering, vectors move to the partition that
   most of their neighbours have, as long as no partition outgrows its share.
3. A small classifier (one hidden layer) learns the partition of a vector, with its neighbours' partitions
   as soft labels. It routes every vector of the table to its most probable partition.
4. A partition of more than LEAF vectors is divided again in the same way, by a task that fits a classifier on a sample
   of its vectors; so partitions grow in number with the table, and not only in size.
5. A query goes to its most probable partitions and their most probable parts; how many, the samples tell: as many as
   hold TARGET of true neighbours. There it is compared with all vectors, in blocks, in double precision, and the best are merged.

Equal vectors are one vector with the smallest ids it needs, so a vector that a third of all rows hold is
compared once. Partitions are cut into blocks of bounded size; a block of vectors meets a block of queries
in one group, and nothing is emitted but each query's nearest.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import text as tx

#: Vectors that the index is fitted on, at most (4 MB of 64 floats each way).
SAMPLE = 12_288
PARTITIONS = 32
#: A partition of more vectors is divided again, into parts of PART vectors or so, MOST_PARTS of them at most (which a sample can tell apart).
LEAF = 8192
PART = 1024
MOST_PARTS = SAMPLE // 32
HIDDEN = 96
NEIGHBOURS = 10
#: Of a sample vector's true neighbours, so many lie in the partitions that a query visits.
TARGET = 0.97
#: Vectors of a block that are compared with a block of queries at once.
BLOCK = 8192
QUERY_BLOCK = 4096


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """key, vector and ids (the k + 1 smallest) of every distinct usable vector: more copies never rank."""
    use = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    use = use.select("vec_id", "vector", F.xxhash64("vector").alias("key")).dropDuplicates(["key", "vec_id"])
    order = Window.partitionBy("key").orderBy("vec_id")  # Spark limits every task's rows of a key before it shuffles them
    few = use.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    return few.groupBy("key").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List values of one length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)


def _centred(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """data around its mean, in units of its largest deviation, so that squares keep their digits; the mean and the unit."""
    shift = (data / len(data)).sum(0)
    unit = max(float(np.abs(data - shift).max()) or 1.0, 1e-290)
    return (data - shift) / unit, shift, unit


def _distances(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact distances of the rows of v from q; where squares overflow, in units of the largest difference."""
    diff = v - q
    with np.errstate(over="ignore"):
        out = np.sqrt((diff**2).sum(1))
    far = np.isinf(out)
    unit = np.abs(diff[far]).max(1, initial=0)
    out[far] = unit * np.sqrt(((diff[far] / unit[:, None]) ** 2).sum(1))
    return out


def _neighbours(data: np.ndarray, rows: np.ndarray):
    """Neighbours (row numbers) of the rows, 512 of them at a time: (rows, neighbours)."""
    k = min(NEIGHBOURS, len(data) - 1)
    for at in range(0, len(rows), 512):
        own = rows[at : at + 512]
        d = _squared(data[own], data)
        d[np.arange(len(own)), own] = np.inf
        yield own, np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(own), 0), int)


def _graph(sample):
    """Neighbours (row numbers in the sample) of the sample rows numbered in the batches."""

    def run(batches):
        for batch in batches:
            for own, near in _neighbours(sample.value, batch.column(0).to_numpy()):
                yield pa.record_batch([pa.array(own), pa.array(near.tolist(), pa.list_(pa.int64()))], ["id", "near"])

    return run


def balanced_partition(data: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """The part of each vector: no part has more than 1.1 times its share, and few edges cross."""
    n = len(data)
    most = int(np.ceil(1.1 * n / parts))
    rng = np.random.default_rng(7)
    centres = data[rng.choice(n, parts, replace=False)]
    for _ in range(rounds):
        d = _squared(data, centres)
        part = _fill(d, most)
        centres = np.stack([data[part == p].mean(0) if (part == p).any() else data[rng.integers(n)] for p in range(parts)])
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1)
        np.add.at(votes, (near.ravel(), np.repeat(part, near.shape[1])), 1)
        part = _fill(-votes - 1e-3 * (part[:, None] == np.arange(parts)), most)
    return part


def _fill(cost: np.ndarray, most: int) -> np.ndarray:
    """Each row to its cheapest part, the surest rows first, none beyond its share; the rest go to their next."""
    n, parts = cost.shape
    part = np.full(n, -1)
    room = np.full(parts, most)
    order = np.argsort(cost, axis=1)
    for k in range(parts):
        left = np.flatnonzero(part < 0)
        if not len(left):
            break
        want = order[left, k]
        gain = cost[left, want] - cost[left, order[left, min(k + 1, parts - 1)]]
        for p in np.unique(want):
            mine = left[want == p]
            take = mine[np.argsort(gain[want == p], kind="stable")[: room[p]]]
            part[take] = p
            room[p] -= len(take)
    return part


@dataclass(frozen=True)
class Router:
    """A classifier of one hidden layer: vector -> probabilities of partitions; visits: partitions of a query."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.shift) * self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def fit_router(data: np.ndarray, near: np.ndarray, parts: int, epochs: int = 12) -> Router:
    """Fits on the sample; near: each row's neighbours in the sample."""
    n, dim = data.shape
    even, shift, unit = _centred(data)
    scale = 1 / np.maximum(even.std(0), 1e-12) / unit
    parts = max(1, min(parts, n // 32))
    if parts == 1:
        return Router(shift, scale, np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    part = balanced_partition(even, near, parts)
    goal = np.zeros((n, parts))
    np.add.at(goal, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 0.5 / near.shape[1])
    goal[np.arange(n), part] += 0.5
    rng = np.random.default_rng(11)
    x = (data - shift) * scale
    net = [rng.normal(0, np.sqrt(2 / dim), (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    first, second, step = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs)
        for own in np.array_split(rng.permutation(n), max(1, n // 256)):
            h = np.maximum(x[own] @ net[0] + net[1], 0)
            z = h @ net[2] + net[3]
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - goal[own]) / len(own)
            back = (g @ net[2].T) * (h > 0)
            step += 1
            for k, d in enumerate([x[own].T @ back, back.sum(0), h.T @ g, g.sum(0)]):
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                net[k] = net[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    found = Router(shift, scale, *net, 1)
    # A neighbour counts as found if its own partition (as the classifier routes it) is among a query's first ones.
    logits = found.logits(data)
    rank = np.argsort(np.argsort(-logits, axis=1), axis=1)
    needed = rank[np.arange(n)[:, None], logits.argmax(1)[near]]
    share = np.array([(needed < m).mean() for m in range(1, parts + 1)])
    return Router(shift, scale, *net, int(np.searchsorted(share, TARGET) + 1))


def learn_partitions(vectors: DataFrame, sample: int = SAMPLE, parts: int = PARTITIONS) -> Router | None:
    """The router of distinct vectors (key, vector); None if there are none. Sample and graph are bounded by `sample`."""
    spark = vectors.sparkSession
    picked = vectors.select("key", "vector").orderBy(F.xxhash64("key"), "key").limit(sample)
    data = _matrix(picked.select("vector").toArrow().column(0)).astype(np.float64)
    if not len(data):
        return None
    shared = spark.sparkContext.broadcast(_centred(data)[0])
    found = spark.range(0, len(data), 1, min(64, -(-len(data) // 512))).mapInArrow(_graph(shared), "id long, near array<long>").toArrow()
    near = _matrix(found.column("near")).astype(np.int64)[np.argsort(found.column("id").to_numpy())]
    return fit_router(data, near, parts)


@dataclass(frozen=True)
class Tree:
    """Routers of two levels: of all vectors, and of each partition that is divided again. A leaf is numbered partition * MOST_PARTS + part."""

    top: Router
    below: dict[int, Router]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The most probable leaf of each vector."""
        part = self.top.logits(x).argmax(1)
        leaf = part * MOST_PARTS
        for p in self.below.keys() & set(part.tolist()):
            own = np.flatnonzero(part == p)
            leaf[own] += self.below[p].logits(x[own]).argmax(1)
        return leaf

    def visit(self, x: np.ndarray, visits: int, counts: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and the leaves that they visit: parts of the first `visits` partitions, and as many more as it takes to
        meet `need` vectors; counts: vectors of each leaf."""
        order = np.argsort(-self.top.logits(x), axis=1, kind="stable")
        least = np.maximum(visits, (counts.reshape(-1, MOST_PARTS).sum(1)[order].cumsum(1) < need).sum(1) + 1)
        goes = np.zeros(order.shape, bool)
        np.put_along_axis(goes, order, np.arange(order.shape[1])[None] < least[:, None], axis=1)
        chosen = [(rows := np.flatnonzero(goes[:, p]), np.full(len(rows), p * MOST_PARTS)) for p in range(goes.shape[1]) if p not in self.below]
        rest = []
        for p, router in self.below.items():
            rows = np.flatnonzero(goes[:, p])
            if len(rows):
                rank = np.argsort(np.argsort(-router.logits(x[rows]), axis=1, kind="stable"), axis=1)
                for out, (i, part) in ((chosen, np.nonzero(rank < router.visits)), (rest, np.nonzero(rank >= router.visits))):
                    out.append((rows[i], p * MOST_PARTS + part))
        row, leaf = (np.concatenate([c[k] for c in chosen]) for k in (0, 1))
        short = np.bincount(row, counts[leaf], minlength=len(x)) < need
        more = [(r[short[r]], to[short[r]]) for r, to in rest]
        return np.concatenate([row, *(r for r, _ in more)]), np.concatenate([leaf, *(to for _, to in more)])


def _route(tree, visits: int | None = None, counts: np.ndarray | None = None, need: int = 0):
    """Rows (id, vector, ...) get their leaf as part (visits None), or come once for each leaf that they visit."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                own = pa.record_batch(batch.columns, batch.schema.names).slice(at, 1024)
                x = _matrix(own.column(1))
                row, leaf = (np.arange(len(x)), tree.value.place(x)) if visits is None else tree.value.visit(x, visits, counts, need)
                yield pa.record_batch([*(c.take(pa.array(row)) for c in own.columns), pa.array(leaf.astype(np.int32))], [*own.schema.names, "part"])

    return run


def _divide(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The router of one partition from a sample of its vectors (leaf, parts, vector)."""
    data = _matrix(table.column("vector")).astype(np.float64)
    near = np.concatenate([n for _, n in _neighbours(_centred(data)[0], np.arange(len(data)))])
    router = fit_router(data, near, int(table.column("parts")[0].as_py()))
    return pa.table({"leaf": pa.array([key[0].as_py()], pa.int32()), "router": pa.array([pickle.dumps(router)], pa.binary())})


def _divided(placed: DataFrame, top: Router, sample: int, leaf: int) -> Tree:
    """The tree over the partitions of placed (key, vector, part): those of more than leaf vectors are divided, each by a
    task that sees a sample of them. The driver gets a router of some 40,000 weights for each partition."""
    counts = placed.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > leaf)
    per = max(1, leaf * PART // LEAF)
    counts = counts.select(F.col("part").alias("leaf"), F.least(F.ceil(F.col("n") / per), F.lit(MOST_PARTS)).alias("parts"), F.least(F.lit(1.0), F.lit(sample) / F.col("n")).alias("share"))
    picked = placed.join(F.broadcast(counts), placed["part"] == counts["leaf"]).where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    found = picked.select("leaf", "parts", "vector").groupBy("leaf").applyInArrow(_divide, "leaf int, router binary")
    return Tree(top, {r["leaf"] // MOST_PARTS: pickle.loads(r["router"]) for r in found.collect()})


def _compare(k: int):
    """A block of queries against a block of vectors: each query's k nearest there, ties to smaller ids."""
    names = ["query_id", "vec_id", "score"]

    def run(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = [pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)]
        if queries.num_rows and vectors.num_rows:
            q, v = _matrix(queries.column("vector")), _matrix(vectors.column("vector"))
            own, ids = queries.column("query_id").to_numpy(), vectors.column("ids").to_pylist()
            even, shift, unit = _centred(v)
            size = (even * even).sum(1).max()
            for at in range(0, len(q), 256):
                asked = (q[at : at + 256] - shift) / unit
                d = _squared(asked, even)
                m = min(k + 1, d.shape[1])  # its own vector may be among them
                edge = np.partition(d, m - 1, axis=1)[:, m - 1]
                slack = 1e-14 * (q.shape[1] + 8) * ((asked * asked).sum(1) + size)
                for i in range(len(d)):
                    near = np.flatnonzero(d[i] <= edge[i] + slack[i])  # rounding of the product form cannot lose a tie
                    exact = _distances(v[near], q[at + i])
                    found = sorted((s, x) for s, j in zip(exact.tolist(), near.tolist(), strict=True) for x in ids[j] if x != own[at + i])[:k]
                    n = len(found)
                    out.append(pa.record_batch([pa.array(np.full(n, own[at + i])), pa.array([x for _, x in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())], names))
        return pa.Table.from_batches(out)

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, sample: int = SAMPLE, parts: int = PARTITIONS, visits: int | None = None, leaf: int = LEAF) -> DataFrame:
    """The k nearest rows found of every query: query_id, rank (from 1), vec_id, score (Euclidean distance).

    rows and queries have vec_id and embedding; a query's own id is never its neighbour. Vectors that are
    null, empty, zero, or hold a null or non-finite component, and rows of a null id, take no part. A query's
    candidates are the vectors of its own length (each length is searched by itself). Ties go to the smaller vec_id. A repeated id counts once for each distinct vector.
    A query id that comes with several vectors gets one list, the nearest of all of them.
    visits: partitions of a query; by default as many as the sample asks for. leaf: vectors of a partition beyond
    which it is divided again. No rows: no result.
    """
    spark = rows.sparkSession
    vectors = tx.reliable(distinct_vectors(rows, k))
    asked = queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")).distinct()
    lengths = [n for (n,) in vectors.select(F.size("vector")).distinct().collect()]  # a row for each length
    if len(lengths) > 1:
        own = lambda df, n: df.where(F.size("embedding") == n)
        return reduce(DataFrame.unionByName, [nearest(own(rows, n), own(queries, n), k, sample, parts, visits, leaf) for n in lengths])
    asked = asked.where(F.size("vector").isin(lengths))
    router = learn_partitions(vectors, sample, parts)
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    schema = "key long, vector array<double>, ids array<long>, part int"
    tree = Tree(router, {})
    placed = tx.reliable(vectors.select("key", "vector", "ids").mapInArrow(_route(spark.sparkContext.broadcast(tree)), schema))
    tree = _divided(placed, router, sample, leaf)
    shared = spark.sparkContext.broadcast(tree)
    if tree.below:
        placed = tx.reliable(placed.drop("part").mapInArrow(_route(shared), schema))
    sizes = placed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each leaf
    placed = placed.join(F.broadcast(sizes), "part").withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), "blocks").cast("int"))
    counts = np.zeros(len(router.b2) * MOST_PARTS, dtype=np.int64)
    for p, n in placed.groupBy("part").count().collect():  # a row for each leaf
        counts[p] = n
    routed = asked.mapInArrow(_route(shared, visits or router.visits, counts, k + 1), "query_id long, vector array<double>, part int")
    count = routed.groupBy("part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks"))
    both = F.broadcast(sizes.join(count, "part"))
    routed = routed.join(both, "part").withColumn("own", F.pmod(F.xxhash64("query_id", F.lit(2)), "query_blocks").cast("int"))
    left = routed.select("query_id", "vector", "part", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = placed.join(F.broadcast(count), "part").select("vector", "ids", "part", "block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("own"))
    meet = left.groupBy("part", "block", "own").cogroup(right.groupBy("part", "block", "own"))
    found = meet.applyInArrow(_compare(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id"))), 1, k).alias("best"))  # k for each visit
    return best.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
