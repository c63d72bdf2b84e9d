"""Exact token counts from a length histogram.

Documents are encoded once and aggregated by length; the histogram holds one row per distinct length,
however many documents there are. Suffix sums over it answer, for every context limit: how many
documents are longer, all tokens, tokens left after truncation, and quantiles.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import text as tx

_tokenizers: dict = {}
#: Lengths of one range of the two-level suffix sums.
RANGE = 1024


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import base64

        if path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            own = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            _tokenizers[path] = lambda texts: [len(own.encode_ordinary(t)) for t in texts]
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            _tokenizers[path] = lambda texts: [len(x.ids) for x in own.encode_batch_fast(texts, add_special_tokens=False)]
    return _tokenizers[path]


def _lengths(path: str):
    def run(batches):
        count = _tokenizer(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: list[int] = []
            at = 0
            while at < len(texts):
                to, seen = at, 0
                while to < len(texts) and (to == at or seen + len(texts[to]) <= 1 << 20):
                    seen += len(texts[to])
                    to += 1
                out += count(texts[at:to])
                at = to
            yield pa.record_batch([batch.column(0), pa.array(out, pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and n_tokens of every row (whole text; null or empty text: 0). Strings of special tokens are ordinary text.

    Repeated rows and null doc_ids each get their row; other columns are not read. The path names a
    `.tiktoken` rank file or a tokenizer `.json`.
    """
    return docs.select("doc_id", "text").mapInArrow(_lengths(tokenizer_path), "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each distinct n_tokens, with suffix sums over all longer documents.

    n_docs: documents of this length; n_tokens_total: their tokens; docs_longer, tokens_longer: of all
    documents strictly longer; truncated_total: tokens left of the whole corpus if each document is cut to
    this length; rank: documents of this length or less. An empty table gives no rows; a null length is left out.
    """
    base = tx.reliable(lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs")))  # else each use below would tokenize again
    base = base.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("n_tokens_total"), F.floor(F.col("n_tokens") / RANGE).alias("part"))
    # Two levels, so that no task holds all lengths: sums of ranges of lengths, and suffix sums inside each.
    after = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = base.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens_total").alias("t"))
    parts = parts.select(F.col("part").alias("own_part"), F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"))
    inside = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    everything = base.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("all_docs"), F.coalesce(F.sum("n_tokens_total"), F.lit(0)).alias("all_tokens"))
    longer = base.join(parts, base["part"] == parts["own_part"]).crossJoin(F.broadcast(everything))  # one row
    longer = longer.withColumns(
        {"docs_longer": F.col("d_after") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)), "tokens_longer": F.col("t_after") + F.coalesce(F.sum("n_tokens_total").over(inside), F.lit(0))}
    )
    return longer.select(
        "n_tokens", "n_docs", "n_tokens_total", "docs_longer", "tokens_longer",
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_total"),
        (F.col("all_docs") - F.col("docs_longer")).alias("rank"), F.col("all_docs"), F.col("all_tokens"),
    )


def quantile(histogram: DataFrame, q: float) -> Column | DataFrame:
    """The smallest length whose rank reaches q of all documents (exact)."""
    return histogram.where(F.col("rank") >= F.greatest(F.lit(1), F.ceil(F.col("all_docs") * q))).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens left of the corpus if every document is cut to limit tokens (any limit, also one that no document has)."""
    kept = F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(limit))
    return histogram.agg(F.coalesce(F.sum(kept), F.lit(0)).alias("tokens"))
