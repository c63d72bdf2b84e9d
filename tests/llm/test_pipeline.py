"""The stages of the corpus pipeline, each on what the stage before it kept, against brute force."""

from __future__ import annotations

import random

import public_tokenizers
import pytest

import corpus_pipeline as P
from quantloom.llm import decontaminate, language_id, near_dedup, packing, suffix_dedup
from tests.llm import brute
from tests.llm.test_operators import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(5, 150)) for _ in range(50)]
    passage, test = prose(rng, 60), prose(rng, 25)
    texts += [texts[0], texts[1] + " one more", passage + " " + texts[2], texts[3] + " " + passage, texts[4] + " " + test + " end", "123 456", "", None]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, test), (2, "short item")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, folder):
    assert [name for name, _ in P.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontaminate", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(P.STAGES)
    first = stage["language_id"](spark, docs, folder)
    assert set(rows(docs)) - set(rows(first)) == {55, 56, 57} and first.columns == docs.columns

    second = stage["near_dedup"](spark, first, folder)
    groups = brute.near_groups([(d, r["text"]) for d, r in rows(first).items()], P.SHINGLE, P.PERCENT)
    assert set(rows(second)) == {d for d, (_, top) in groups.items() if d == top} and second.columns == docs.columns

    third = stage["suffix_dedup"](spark, second, folder)
    before, after = rows(second), rows(third)
    wanted = dict(zip(before, brute.repeats([r["text"] for r in before.values()], P.REPEAT_BYTES), strict=True))
    assert set(after) == {d for d, w in wanted.items() if w[0] > w[1]} and third.columns == docs.columns
    for d, r in after.items():
        size, removed = wanted[d][:2]
        assert size - removed - 3 * wanted[d][2] <= len(r["text"].encode()) <= size - removed and r["n_chars"] == len(r["text"])
    assert sum(w[1] > 0 for w in wanted.values()) >= 2

    fourth = stage["decontaminate"](spark, third, folder)
    hits = brute.hits([r["text"] for r in after.values()], [(1, spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first()["text"]), (2, "short item")], 10)
    assert set(rows(fourth)) == {d for d, h in zip(after, hits, strict=True) if not h[1]} and 54 not in rows(fourth)
    assert fourth.columns == docs.columns

    last = P.run(spark, folder).toPandas()
    encode = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json")).encode
    assert last.groupby("doc_id")["length"].sum().to_dict() == {d: len(encode([r["text"]])[0]) // 4 + 1 for d, r in rows(fourth).items()}


def test_clashing_columns_null_ids_and_shared_ids(spark):
    schema = "doc_id long, text string, _bad long, _id long, _key long, row string, text_key long, found string, k long, item string"
    texts = [(7, "one two three four five six"), (7, "seven eight nine ten eleven twelve"), (7, "seven eight nine ten eleven twelve"), (None, "a b c d e f g"), (None, "h i j k l m n"), (None, None), (8, "the benchmark text is here")]
    docs = spark.createDataFrame([(d, t, 1, 1, 1, "r", 1, "f", 1, "i") for d, t in texts], schema)
    model = language_id.learn_languages(spark.createDataFrame([("one two three", "en"), ("un deux trois", "fr")], "text string, lang string"))
    bench = spark.createDataFrame([(1, "benchmark text")], "item_id long, text string")
    stages = [lambda d: language_id.keep_identified(d, model, 0.0), near_dedup.keep_first_of_groups, suffix_dedup.without_repeats, lambda d: decontaminate.decontaminate(d, bench)]
    sizes = []
    for stage in stages:
        out = stage(docs)
        assert out.columns == docs.columns and {r["row"] for r in out.collect()} == {"r"}
        sizes.append(out.count())
    assert sizes == [6, 6, 7, 6]
    assert near_dedup.keep_first_of_groups(docs.where("false")).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert P.ORACLE_SQL is None


def test_passages_of_just_over_50_words_go(spark):
    rng = random.Random(11)
    passage = " ".join(["of the by"] * 13 + [prose(rng, 12)])
    assert len(passage.split()) > 50 and P.REPEAT_BYTES <= len(passage) < 320
    docs = [(i, prose(rng, 40) + "." + passage + "." + prose(rng, 40), "en", "s", 0) for i in range(2)]
    out = rows(P.repeats(spark, spark.createDataFrame(docs, SCHEMA), ""))
    assert all(passage not in r["text"] and len(r["text"]) <= len(t[1]) - len(passage) for r, t in zip((out[0], out[1]), docs, strict=True))
