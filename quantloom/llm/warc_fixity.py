"""Merkle fixity audit of WARC archives: record digests, trees over ordered offset ranges, guided descent.

The records of an archive are hashed; a file is cut into ranges of RANGE_BYTES offsets, and a range's node
hashes the ordered (offset, length, digest) of the records that begin in it. FANOUT neighbouring nodes
make one node of the next level; when every file has one node, files are joined the same way up to one root.
An audit compares the roots of two replicas and goes down a level at a time, only below nodes that differ;
the records of differing ranges tell what is damaged.

Every group is bounded: a record has at least its header, so a range begins fewer than
RANGE_BYTES / MIN_RECORD records, and a node has FANOUT children. All of it is Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import text as tx

RANGE_BYTES = 64 << 10
FANOUT = 64
PAGES_PER_FILE = 512
#: Digits of a digest by which a page's records are dealt; the place of null page ids, before all others.
PREFIX, NO_PAGE = 3, -(1 << 63)
#: Copies of one record that are made from one row at once.
COPIES = 4096


def _content(page: Column) -> Column:
    return F.coalesce(page, F.lit(""))


def record_text(url: Column, html: Column) -> Column:
    """The bytes of a WARC/1.0 resource record, as text. Null url or html: empty."""
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), _content(url))
    return F.concat(head, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(_content(html)).cast("string"), F.lit("\r\n\r\n"), _content(html), F.lit("\r\n\r\n"))


def layout(pages: DataFrame, pages_per_file: int = PAGES_PER_FILE, **more: Column) -> DataFrame:
    """file, offset, length, digest and page_id of the records of pages, laid out in files of neighbouring page_ids.

    A file's records stand in order of page_id, then digest; null page_ids have file -1. Equal rows are
    records of their own, one after the other. more: columns made of `record`, `digest` and `page_id` that come along.
    Other columns of pages are not read. An empty table gives no rows.

    Texts are hashed where they are read and go no further. Equal records are counted before they are shuffled, and a
    file's offsets are added up by page and PREFIX digits of the digest first, so neither a page id nor a file (that of
    the null ids, say) with a third of all rows is ordered in one task. The result is kept in the checkpoint folder.
    """
    page_id = F.col("page_id").cast("long")
    file = F.coalesce(F.floor(page_id / pages_per_file), F.lit(-1)).cast("long")
    rows = pages.select(page_id.alias("page_id"), record_text(F.col("url"), F.col("html")).alias("record"), file.alias("file"))
    rows = rows.withColumns({"page": F.coalesce("page_id", F.lit(NO_PAGE)), "length": F.octet_length("record").cast("long"), "digest": F.sha2("record", 256)})
    rows = rows.select("file", "page", "digest", "length", F.substring("digest", 1, PREFIX).alias("part"), *[c.alias(name) for name, c in more.items()])
    groups = rows.groupBy("file", "page", "part", "digest", "length", *more).agg(F.count("*").alias("n"))
    sizes = groups.groupBy("file", "page", "part").agg(F.sum(F.col("length") * F.col("n")).alias("bytes"))
    before = lambda what, order: F.coalesce(F.sum(what).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.select("file", "page", "part", before("bytes", Window.partitionBy("file").orderBy("page", "part")).alias("base"))  # a row per page and prefix
    inner = before(F.col("length") * F.col("n"), Window.partitionBy("file", "page", "part").orderBy("digest"))
    placed = groups.join(parts, ["file", "page", "part"]).withColumn("start", F.col("base") + inner)
    copies = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    copies = copies.withColumn("copy", F.explode(F.sequence("block", F.least(F.col("block") + COPIES, F.col("n")) - 1)))
    page_id = F.when((F.col("file") != -1) | (F.col("page") != NO_PAGE), F.col("page"))
    return tx.reliable(copies.select("file", (F.col("start") + F.col("copy") * F.col("length")).alias("offset"), "length", "digest", page_id.alias("page_id"), *more))


def archive(pages: DataFrame, pages_per_file: int = PAGES_PER_FILE) -> DataFrame:
    """The layout of pages with url and record (the text itself), for writing files: file, offset, length, page_id, url, record.

    A null url is empty. Texts are shuffled once here, each different record of a page once.
    """
    places = layout(pages, pages_per_file).withColumnsRenamed({"page_id": "_page", "digest": "_digest"})
    record = record_text(F.col("url"), F.col("html"))
    texts = pages.select(F.col("page_id").cast("long").alias("page_id"), _content(F.col("url")).alias("url"), record.alias("record"), F.sha2(record, 256).alias("digest")).dropDuplicates(["page_id", "digest"])
    both = places.join(texts, (F.col("_digest") == F.col("digest")) & F.col("_page").eqNullSafe(F.col("page_id")))
    return both.select("file", "offset", "length", "page_id", "url", "record")


def leaves(records: DataFrame) -> DataFrame:
    """file, offset, length and digest of records that have file, offset and record, or length and digest in its stead.

    A null record counts as empty; rows without file or offset cannot be placed and are left out. Of several
    records at one place, the digest covers all (their sorted digests), so a repeated row is one leaf still.
    """
    rows = records.where("file is not null and offset is not null")
    if "record" in records.columns:
        rows = rows.select("file", "offset", F.octet_length(_content(F.col("record"))).cast("long").alias("length"), F.sha2(_content(F.col("record")), 256).alias("digest"))
    one = rows.groupBy("file", "offset", "digest").agg(F.max("length").alias("length"))
    places = one.groupBy("file", "offset").agg(F.max("length").alias("length"), F.count("*").alias("n"), F.max("digest").alias("top"), F.sha2(F.array_join(F.array_sort(F.collect_set("digest")), ","), 256).alias("all"))
    return places.select("file", "offset", "length", F.when(F.col("n") == 1, F.col("top")).otherwise(F.col("all")).alias("digest"))


def _node(columns: list[str]) -> Column:
    """Hash of a group's children in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*columns))), lambda x: F.concat_ws(":", *[x[c].cast("string") for c in columns])), "\n"), 256)


class Tree:
    """levels[0]: range nodes (file, node, hash); then coarser ones; the last level has one node, the root."""

    def __init__(self, records: DataFrame, range_bytes: int = RANGE_BYTES):
        self.range_bytes = range_bytes
        self.leaves = tx.reliable(leaves(records))
        place = self.leaves.select("file", F.floor(F.col("offset") / range_bytes).alias("node"), "offset", "length", "digest")
        self.levels = [tx.reliable(place.groupBy("file", "node").agg(_node(["offset", "length", "digest"]).alias("hash")))]

    def depth(self) -> tuple[int, int]:
        """How many levels join the nodes of every file, and then all files."""
        most = self.levels[0].agg(F.max("node").alias("n"), F.max("file").alias("f"), F.min("file").alias("g")).first()
        steps = lambda n: next(k for k in range(64) if FANOUT**k > n)
        return steps(most["n"] or 0), steps(max(abs(most["f"] or 0), abs(most["g"] or 0), 1))

    def build(self, depth: tuple[int, int]) -> Tree:
        """Adds the coarser levels: `depth` inside files, and over files, the same for the trees that are compared."""
        for k in range(sum(depth)):
            self.levels.append(tx.reliable(self.levels[-1].groupBy(*parent(k < depth[0])).agg(_node(["file", "node", "hash"]).alias("hash"))))
        return self

    def root(self) -> DataFrame:
        """One row, or none of an empty archive."""
        return self.levels[-1]


def parent(in_file: bool) -> list[Column]:
    """The parent of a node, inside its file or over files (of which a few may have negative numbers)."""
    if in_file:
        return [F.col("file"), F.floor(F.col("node") / FANOUT).alias("node")]
    return [F.floor(F.abs("file") / FANOUT).alias("file"), F.lit(0).cast("long").alias("node")]


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.withColumnRenamed("hash", "ha").join(b.withColumnRenamed("hash", "hb"), ["file", "node"], "full")
    return both.where(~F.col("ha").eqNullSafe(F.col("hb"))).select("file", "node")


def damaged_ranges(a: Tree, b: Tree, depth: tuple[int, int]) -> DataFrame:
    """Ranges (file, node) that differ, found from the root down; nodes below an equal one are never compared."""
    bad = tx.reliable(_differing(a.levels[-1], b.levels[-1]))
    for k in reversed(range(sum(depth))):
        if bad.isEmpty():
            return bad
        up = bad.select(F.col("file").alias("up_file"), F.col("node").alias("up_node"))

        def below(level: DataFrame, up=up, k=k) -> DataFrame:
            own = level.withColumns(dict(zip(("of", "at"), parent(k < depth[0]), strict=True)))
            return own.join(up, (F.col("of") == F.col("up_file")) & (F.col("at") == F.col("up_node")), "left_semi").select("file", "node", "hash")

        bad = tx.reliable(_differing(below(a.levels[k]), below(b.levels[k])))
    return bad


def audit(original: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, offset, length, digest and status of every record of two archives (file and offset, with record, or with its length and digest).

    status: ok; changed (other bytes in the replica); lost (none there); extra (only there: its own length and
    digest). replica_digest is null where the replica has none. Two empty archives give no rows.
    """
    a, b = Tree(original, range_bytes), Tree(replica, range_bytes)
    depth = tuple(map(max, a.depth(), b.depth()))
    bad = damaged_ranges(a.build(depth), b.build(depth), depth)
    at = F.floor(F.col("offset") / range_bytes)
    suspect = bad.select(F.col("file").alias("bad_file"), F.col("node").alias("bad_node"))
    inside = (F.col("file") == F.col("bad_file")) & (at == F.col("bad_node"))
    fine = a.leaves.join(suspect, inside, "left_anti").select("file", "offset", "length", "digest", F.col("digest").alias("replica_digest"), F.lit("ok").alias("status"))
    mine = a.leaves.join(suspect, inside, "left_semi")
    other = b.leaves.join(suspect, inside, "left_semi").select("file", "offset", F.col("length").alias("other_length"), F.col("digest").alias("replica_digest"))
    both = mine.join(other, ["file", "offset"], "full")
    status = F.when(F.col("digest").isNull(), "extra").when(F.col("replica_digest").isNull(), "lost").when(F.col("digest") == F.col("replica_digest"), "ok").otherwise("changed")
    judged = both.select("file", "offset", F.coalesce("length", "other_length").alias("length"), F.coalesce("digest", "replica_digest").alias("digest"), "replica_digest", status.alias("status"))
    return fine.unionByName(judged)
