"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from quantloom.llm import ann_search, chat_format, decontaminate, language_id, lm_scoring, near_dedup, packing, suffix_dedup, token_counts, warc_fixity
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, _id long, _key long, words string"  # the last three clash with inner names


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def documents(spark, texts):
    return table(spark, [(i, t, "en", 5, 5, "w") for i, t in enumerate(texts)], DOCS)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "été", "ünd", "zeta", "eta", "theta", "iota"]) + str(rng.randrange(300)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    shared = prose(rng, 30)
    out = [prose(rng, rng.randrange(1, 120)) for _ in range(40)]
    out += [out[0], out[0], out[1] + " more", shared + out[2], out[3] + shared + out[4], shared * 3, "", None, "a", "A a\ta", "é" * 300, "x" * 900, "x" * 900 + "y"]
    out += [" ".join(out[5].split()[:-1]), "tiny one", "tiny one"]
    return out


# 1 ----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [40, 150, 400])
def test_suffix_dedup(spark, texts, width):
    found = suffix_dedup.digest(suffix_dedup.remove_repeats(documents(spark, texts), width)).toPandas().set_index("doc_id")
    for i, want in enumerate(brute.repeats(texts, width)):
        assert tuple(found.loc[i]) == want, i


def test_suffix_dedup_texts(spark):
    text = "é" * 100
    out = suffix_dedup.without_repeats(table(spark, [(1, "start " + text + "!"), (2, "a" + text[:-1] + "è?"), (3, None), (None, "alone")]), 41)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: "start !", 2: "a?", 3: None, None: "alone"}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "x" * 500), (None, "x" * 500), (7, "y")]])
def test_suffix_dedup_odd(spark, rows):
    found = suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, rows), 400)).toPandas()
    assert len(found) == len(rows)
    assert sorted(found["n_removed"]) == sorted(500 if t and len(t) == 500 else 0 for _, t in rows)


# 2 ----------------------------------------------------------------------------------------------------------------------


def test_token_counts(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    lengths = token_counts.token_lengths(documents(spark, texts), path).toPandas()
    count = token_counts._tokenizer(path)
    assert dict(zip(lengths["doc_id"], lengths["n_tokens"], strict=True)) == dict(enumerate(count([t or "" for t in texts])))
    n = np.array(sorted(lengths["n_tokens"]))
    hist = token_counts.length_histogram(table(spark, [(int(x),) for x in n] + [(None,)], "n_tokens long"))
    for r in hist.collect():
        k = r["n_tokens"]
        assert (r["n_docs"], r["docs_longer"], r["tokens_longer"], r["rank"]) == ((n == k).sum(), (n > k).sum(), n[n > k].sum(), (n <= k).sum())
        assert r["truncated_total"] == np.minimum(n, k).sum() and r["all_tokens"] == n.sum()
    for q in (0.0, 0.1, 0.5, 1.0):
        assert token_counts.quantile(hist, q).first()[0] == n[max(1, int(np.ceil(len(n) * q))) - 1]
    for limit in (0, 3, 10**6):
        assert token_counts.truncated_total(hist, limit).first()[0] == np.minimum(n, limit).sum()
    assert token_counts.length_histogram(hist.where("false").select("n_tokens")).count() == 0


def test_token_counts_of_a_json_tokenizer(spark):
    out = token_counts.token_lengths(table(spark, [(1, "a <|endoftext|> b"), (None, None)]), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r[0]: r[1] for r in out}[None] == 0 and {r[0]: r[1] for r in out}[1] > 5


# 3 ----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")


def test_lm_scoring(spark, corpus):
    rows = [(r[0], r[1]) for r in corpus.collect()] + [(-1, None), (-2, ""), (-3, "The THE"), (-4, "word " * 30_000)]
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    scored, model = lm_scoring.score_documents(table(spark, rows), learn)
    found = scored.toPandas().set_index("doc_id")
    want = brute.base_scores(rows, lambda d: brute.crc(d) % 7 != 2)
    assert model.train_tokens == want[None] and len(found) == len(rows)
    for d, _ in rows:
        own = found.loc[d]
        assert (own["n_tokens"], own["n_known"]) == want[d][:2] and own["base_score"] == pytest.approx(want[d][2])
    assert np.isfinite(found["score"]).all() and (found["score"] < 0).all()
    copies = found[found["learned"]]
    assert copies["score"].sum() > copies["base_score"].sum()


def test_lm_follows_passages(spark):
    """Predictions and their trust against a plain dictionary of passages; a copy of a training text costs far less than the text itself did."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 150)) for i in range(12)]
    rows += [(20, rows[0][1]), (21, prose(rng, 20) + " " + rows[1][1] + " tail"), (22, rows[2][1]), (23, " ".join(x if i % 40 else "other" for i, x in enumerate(rows[3][1].split())))]
    rows += [(30, None), (31, "a b"), (32, "same " * 500), (33, "same " * 90)]
    learn = F.col("doc_id") < 22
    chunks = lm_scoring.chunk_documents(table(spark, rows).coalesce(1), learn)
    passages = [r.asDict() for r in lm_scoring.learn_model(chunks).passages.collect()]
    ((row, i, c),) = lm_scoring._rows(chunks.toArrow().combine_chunks().to_batches())
    predicted, trust = lm_scoring._follow(c, passages)
    ids, hashes = c.ids(), c.words[c.tokens]
    docs = row["doc_ids"][i].as_py()
    tokens = {d: list(zip(ids[s : s + n].tolist(), hashes[s : s + n].tolist(), strict=True)) for d, s, n in zip(docs, c.starts, c.sizes, strict=True)}
    width, bits = lm_scoring.ANCHOR, lm_scoring.ANCHOR_BITS
    is_anchor = lambda window: int(lm_scoring.tx.windows_hash(np.array([h for _, h in window], dtype=np.uint64), width)[0]) >> (64 - bits) == 0
    want = brute.followed(tokens, lambda d: d < 22, is_anchor, width, lm_scoring.RUN)
    met = 0
    for d, s in zip(docs, c.starts, strict=True):
        for k, (options, run) in enumerate(want[d]):
            p, t = predicted[s + k], trust[s + k]
            assert len(options) < 2 and (p == next(iter(options))[0] if options else p == -1), (d, k)
            level = 5 if run > 15 else 4 if run > 3 else 3 if run > 0 else 1 if run == -1 else 2
            assert t == (level if options else 0), (d, k)
            met += bool(options)
    assert met > 300
    scored = lm_scoring.score_documents(table(spark, rows), learn)[0].toPandas().set_index("doc_id")["score"]
    assert scored[22] > 0.5 * scored[2]


def test_lm_is_a_distribution(spark, corpus):
    """The probabilities of all known one-word texts, the escape included, add up to no more than one."""
    chunks = lm_scoring.chunk_documents(corpus, F.lit(True))
    model = lm_scoring.learn_model(chunks)
    known = {w for r in corpus.collect() for w in brute.words(r[1])}
    ones = table(spark, list(enumerate(sorted(known))))
    scored = lm_scoring.score_chunks(lm_scoring.chunk_documents(ones, F.lit(False)), model).toPandas()
    end = lm_scoring.score_chunks(lm_scoring.chunk_documents(table(spark, [(0, "")]), F.lit(False)), model).first()["score"]
    total = (10 ** scored["score"]).sum()
    assert 0 < total < 1 and 10**end < 1


@pytest.mark.parametrize("rows", [[], [(1, None)], [(2, "some words"), (2, "some words"), (None, "x")]])
def test_lm_odd(spark, rows):
    for learn in (F.lit(True), F.lit(None).cast("boolean")):
        assert lm_scoring.score_documents(table(spark, rows), learn)[0].count() == len(rows)


# 4 ----------------------------------------------------------------------------------------------------------------------


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("bits", F.lit(1))
    out = language_id.held_out(F.col("doc_id"), 4, 2)
    model = language_id.learn_languages(docs.where(~out))
    found = language_id.identify(docs.where(out & (F.length("text") > 100)), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() > 0.97 * found.count()
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_id_odd(spark):
    rows = [(1, None), (2, ""), (3, "12 34 !"), (None, "the house"), (None, "the house"), (4, "ß"), (5, "la maison " * 50_000)]
    model = language_id.learn_languages(table(spark, [("the house and the dog", "en"), ("la maison et le chien", "fr"), (None, "de"), ("x", None)], "text string, lang string"))
    assert model.languages == ("en", "fr")
    found = language_id.identify(table(spark, rows), model).toPandas()
    assert len(found) == 7 and set(found[found["doc_id"].isin([1, 2, 3])]["lang_pred"]) == {"und"}
    assert found[found["doc_id"] == 5]["lang_pred"].item() == "fr" and set(found[found["doc_id"].isna()]["lang_pred"]) == {"en"}
    kept = language_id.keep_identified(table(spark, rows), model)
    assert sorted(r["doc_id"] or 0 for r in kept.collect())[-1] == 5 and kept.where("doc_id in (1, 2, 3)").count() == 0
    nothing = language_id.learn_languages(table(spark, [], "text string, lang string"))
    assert {r["lang_pred"] for r in language_id.identify(table(spark, rows), nothing).collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 4, 6, 9, 40])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert len({tuple(c) for c in code}) == n and 0 < code.sum(0).min() and code.sum(0).max() < n


# 5 ----------------------------------------------------------------------------------------------------------------------


def test_warc_fixity(spark):
    pages = table(spark, [(i, f"http://x/{i}", "h" * (i * 37 % 5000)) for i in range(700)] + [(None, None, None), (3, "again", ""), (3, "again", ""), (-5, "u", "x")], "page_id long, url string, html string")
    records = warc_fixity.archive(pages, 64)
    assert records.groupBy("file", "offset").count().where("count > 1").count() == 0
    bad = records.withColumn("record", F.when(F.col("page_id") % 100 == 7, F.overlay("record", F.lit("?"), 3)).otherwise(F.col("record"))).where("page_id is null or page_id <> 33")
    extra = table(spark, [(10**6, 0, "new")], "file long, offset long, record string")
    found = warc_fixity.audit(records, bad.select("file", "offset", "record").unionByName(extra), 4096)
    counts = {r["status"]: r["count"] for r in found.groupBy("status").count().collect()}
    assert counts == {"ok": 704 - 8, "changed": 7, "lost": 1, "extra": 1}
    tree = [warc_fixity.Tree(x, 4096) for x in (records, bad)]
    depth = tuple(map(max, *(t.depth() for t in tree)))
    a, b = (t.build(depth).root().collect() for t in tree)
    assert len(a) == len(b) == 1 and a[0]["hash"] != b[0]["hash"]
    assert warc_fixity.damaged_ranges(tree[0], tree[0], depth).count() == 0


def test_warc_layout_of_hot_pages(spark):
    """Null ids, one id with many records and many equal records stand where a plain walk through the files puts them."""
    rows = [(None, f"n{i}", "x" * (i % 7), 1) for i in range(300)] + [(5, f"v{i}", "", 1) for i in range(300)] + [(6, "same", "y", 1)] * (warc_fixity.COPIES + 300) + [(-1, None, None, 1), (-513, "a", "b", 1), (None, "n1", "x", 1)]
    pages = table(spark, rows, "page_id long, url string, html string, digest int")  # the last clashes with an inner name
    found = warc_fixity.layout(pages, 512).select("file", "offset", "length", "digest", "page_id").collect()
    records: dict = {}
    for page, url, html, _ in rows:
        text = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(html or '')}\r\n\r\n{html or ''}\r\n\r\n".encode()
        records.setdefault(-1 if page is None else page // 512, []).append((page is not None, page or 0, hashlib.sha256(text).hexdigest(), len(text), page))
    want = []
    for file, own in records.items():
        at = 0
        for _, _, digest, size, page in sorted(own, key=lambda r: r[:3]):
            want.append((file, at, size, digest, page))
            at += size
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert warc_fixity.layout(pages.limit(0)).count() == 0


def test_warc_fixity_of_nothing(spark):
    empty = table(spark, [], "file long, offset long, record string")
    assert warc_fixity.audit(empty, empty).count() == 0
    one = table(spark, [(0, 0, None), (None, 1, "x")], "file long, offset long, record string")
    assert [r["status"] for r in warc_fixity.audit(one, empty).collect()] == ["lost"]


# 6 ----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("size", "percent"), [(4, 80), (5, 80), (1, 50)])
def test_near_dedup(spark, texts, size, percent):
    rng = random.Random(9)
    base = [prose(rng, 60) for _ in range(6)]
    chain = [" ".join(w if rng.random() > 0.02 else "other" for w in b.split()) for b in base for _ in range(25)]
    docs = list(enumerate(texts + base + chain))
    found = near_dedup.near_duplicates(table(spark, [(i, t, 1, 1) for i, t in docs], "doc_id long, text string, node long, comp long"), size, percent).toPandas().set_index("doc_id")
    for i, want in brute.near_groups(docs, size, percent).items():
        assert (found.loc[i]["n_shingles"], found.loc[i]["component_id"]) == want, i
        assert found.loc[i]["kept"] == (want[1] == i)


def test_near_dedup_odd(spark):
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0
    rows = [(None, "same words here"), (4, "same words here"), (4, "same words here"), (5, None), (None, None), (6, "long " * 40_000)]
    found = near_dedup.near_duplicates(table(spark, rows)).toPandas()
    assert len(found) == 6 and set(found[found["n_shingles"] == 1]["component_id"].dropna()) == {4, 6}
    kept = near_dedup.keep_first_of_groups(table(spark, rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "5", "6", "None"]


# 7 ----------------------------------------------------------------------------------------------------------------------


def test_chat_format_round_trip(spark):
    rng = random.Random(2)
    parts = ["<|im_end|>\n", "<|im_start|>", "<|turn|>", "<\\|", "\\", "\n", "<", "|", "a", "é", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "sy\nst\\nem", "<|x|>"]), "".join(rng.choices(parts, k=rng.randrange(6)))) for c in range(40) for t in range(rng.randrange(1, 6))]
    rows += [(53, t, "assistant" if t % 3 else "user", f"{t}<|") for t in range(2 * chat_format.BLOCK + 3)]
    rows += [(50, None, None, None), (50, 1, "assistant", None), (None, 0, "user", "x"), (51, 0, "assistant", "twice"), (51, 0, "assistant", "twice"), (52, 0, "assistant", "long " * 50_000)]
    done = chat_format.format_chat(table(spark, [(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int"))
    read = done.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want: dict = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", (r[3] or ""))):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(x) for x in r["turns"]] for r in read} == want
    assert {r["conv_id"]: r["loss"] for r in read} == {c: "".join(x for role, x in v if role == "assistant") for c, v in want.items()}


# 8 ----------------------------------------------------------------------------------------------------------------------


def test_packing(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = [*enumerate([*texts, "naïve it's 3rd <|endoftext|> 日本 İ", "word " * 9000]), (None, "x"), (None, None)]
    found = packing.pack(table(spark, docs), path, 64).toPandas()
    whole = packing.tokenizer(path).whole
    ids = {d: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for d, t in docs if d is not None}
    for d, own in found[found["doc_id"].notna()].groupby("doc_id"):
        at = 0
        for r in own.sort_values("start").itertuples():
            piece = ids[d][r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids[d]) and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    used = 0
    for _, own in found.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 64
        used += own["length"].sum()
    assert used == found["length"].sum() and packing.pack(table(spark, []), path).count() == 0


def test_best_fit_takes_the_tightest_room():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 101) for _ in range(500)]
    places = packing.place(lengths, 100)
    open_rooms: list[int] = []
    for i in sorted(range(500), key=lambda i: -lengths[i]):
        fits = [r for r in open_rooms if r >= lengths[i]]
        if fits:
            assert 100 - places[i][1] == min(fits)
            open_rooms.remove(min(fits))
        else:
            assert places[i][1] == 0
        open_rooms.append(100 - places[i][1] - lengths[i])


# 9 ----------------------------------------------------------------------------------------------------------------------


def vectors(spark, data, start=0):
    return table(spark, [(start + i, [float(x) for x in v] if v is not None else None, 0, "k") for i, v in enumerate(data)], "vec_id long, embedding array<float>, part int, key string")


def nearest_brute(data, ids, q, k=10):
    d = sorted((float(np.sqrt(((data[i].astype(float) - data[q].astype(float)) ** 2).sum())), ids[i]) for i in range(len(ids)) if i != q)
    return d[:k]


def test_nearest_recall_and_distances(spark):
    rng = np.random.default_rng(0)
    data = (rng.normal(0, 1, (20, 16))[rng.integers(0, 20, 3000)] + rng.normal(0, 0.3, (3000, 16))).astype(np.float32)
    rows = vectors(spark, data)
    found = ann_search.nearest(rows, rows.where("vec_id % 100 = 0"), sample=1024, parts=16).toPandas()
    hit = 0
    for q, own in found.groupby("query_id"):
        own = own.sort_values("rank")
        want = nearest_brute(data, range(3000), q)
        hit += len(set(own["vec_id"]) & {x for _, x in want})
        assert own["rank"].tolist() == list(range(1, 11)) and own["score"].is_monotonic_increasing and q not in set(own["vec_id"])
        for r in own.itertuples():
            assert r.score == pytest.approx(float(np.sqrt(((data[r.vec_id].astype(float) - data[q].astype(float)) ** 2).sum())), abs=1e-12)
    assert hit >= 0.9 * 300 and found["query_id"].nunique() == 30


def test_nearest_ties_copies_and_odd_vectors(spark):
    data = [[1, 0], [1, 0], [0, 1], [-1, 0], [0, -1], [0, 0], None, [float("nan"), 1], [float("inf"), 1], [1, 0]] + [[5, 5]] * 40
    rows = vectors(spark, data).unionByName(vectors(spark, [[1, 0]]))  # a repeated row
    found = ann_search.nearest(rows, rows.where("vec_id % 10 = 0"), k=10).orderBy("query_id", "rank").collect()
    first = [(r["vec_id"], round(r["score"], 6)) for r in found if r["query_id"] == 0]
    assert first == [(1, 0), (9, 0), (2, 1.414214), (4, 1.414214), (3, 2), *[(10 + i, 6.403124) for i in range(5)]]
    assert [r["vec_id"] for r in found if r["query_id"] == 10] == list(range(11, 21))
    assert ann_search.nearest(rows.where("false"), rows.where("false")).count() == 0
    assert ann_search.nearest(rows.where("vec_id = 6"), rows).count() == 0
    few = rows.where("vec_id < 4")
    assert ann_search.nearest(few, few.where("vec_id = 0")).count() == 3


def test_nearest_of_shifted_huge_and_unequal_vectors(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(0, 1, (300, 8))
    for far in (data + 1e8, data * 1e160):
        rows = table(spark, [(i, v.tolist()) for i, v in enumerate(far)] + [(900, [1.0, 2.0]), (901, [1.0, 3.0]), (902, [5.0])], "vec_id long, embedding array<double>")
        found = ann_search.nearest(rows, rows.where("vec_id % 100 = 0"), k=10).orderBy("query_id", "rank").collect()
        for q in (0, 100, 200):
            unit = np.abs(far).max()
            want = sorted((float(np.sqrt((((far[i] - far[q]) / unit) ** 2).sum())), i) for i in range(300) if i != q)[:10]
            own = [r for r in found if r["query_id"] == q]
            assert [r["vec_id"] for r in own] == [i for _, i in want] and [r["score"] / unit for r in own] == pytest.approx([d for d, _ in want], rel=1e-9)
        assert [(r["vec_id"], r["score"]) for r in found if r["query_id"] == 900] == [(901, 1.0)]


def test_nearest_divides_large_partitions(spark):
    """Two levels: clustered vectors meet few others and are found; unstructured ones are found as well; scores are exact, no query falls short."""
    rng = np.random.default_rng(6)
    for data, most in ((rng.normal(0, 1, (300, 16))[rng.integers(0, 300, 6000)] + rng.normal(0, 0.2, (6000, 16)), 0.5), (rng.normal(0, 1, (6000, 8)), 0.95)):
        data = data.astype(np.float32)
        rows = vectors(spark, data)
        vec = ann_search.distinct_vectors(rows, 10)
        router = ann_search.learn_partitions(vec, 2048, 8)
        placed = vec.select("key", "vector", "ids").mapInArrow(ann_search._route(spark.sparkContext.broadcast(ann_search.Tree(router, {}))), "key long, vector array<double>, ids array<long>, part int")
        tree = ann_search._divided(placed, router, 2048, 256)
        assert tree.below and len(tree.below) <= len(router.b2)
        leaf = tree.place(data.astype(float))
        counts = np.bincount(leaf, minlength=len(router.b2) * ann_search.MOST_PARTS)
        row, to = tree.visit(data.astype(float)[:500], router.visits, counts, 11)
        assert len(set(zip(row.tolist(), to.tolist(), strict=True))) == len(row) and (np.bincount(row, counts[to], minlength=500) >= 11).all()
        assert np.bincount(row, counts[to]).mean() <= most * 6000  # the vectors that a query meets
        all_row, all_to = tree.visit(data.astype(float)[:20], 1, counts, 6000)  # a need that only the whole table meets
        assert (np.bincount(all_row, counts[all_to], minlength=20) == 6000).all()
        found = ann_search.nearest(rows, rows.where("vec_id % 100 = 0"), sample=2048, parts=8, leaf=256).toPandas()
        hit = 0
        for q, own in found.groupby("query_id"):
            own = own.sort_values("rank")
            assert own["rank"].tolist() == list(range(1, 11)) and own["score"].is_monotonic_increasing and q not in set(own["vec_id"])
            hit += len(set(own["vec_id"]) & {x for _, x in nearest_brute(data, range(6000), q)})
            for r in own.itertuples():
                assert r.score == pytest.approx(float(np.sqrt(((data[r.vec_id].astype(float) - data[q].astype(float)) ** 2).sum())), abs=1e-12)
        assert found["query_id"].nunique() == 60 and hit >= 0.9 * 600, hit


def test_nearest_of_one_query_id_with_two_vectors(spark):
    rows = vectors(spark, [[1, 0], [1.5, 0], [0, 1], [0, 1.25]])
    asked = table(spark, [(9, [1.0, 0.0], 1), (9, [0.0, 1.0], 2), (9, [0.0, 1.0], 2)], "vec_id long, embedding array<float>, rank int")
    found = ann_search.nearest(rows, asked, k=3).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(9, 1, 0, 0.0), (9, 2, 2, 0.0), (9, 3, 3, 0.25)]


def test_balanced_partition():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.normal(c, 0.1, (n, 4)) for c, n in ((0, 700), (5, 200), (9, 100))])
    d = ann_search._squared(data, data)
    near = np.argsort(d, axis=1)[:, 1:6]
    part = ann_search.balanced_partition(data, near, 8)
    assert part.min() >= 0 and np.bincount(part, minlength=8).max() <= np.ceil(1.1 * 1000 / 8)


# 10 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("window", "block"), [(10, 1_000_000), (4, 60), (1, 1_000_000)])
def test_decontaminate(spark, texts, window, block):
    items = [(100 + i, " ".join((t or "").split()[: 3 + 2 * i])) for i, t in enumerate(texts[:20])] + [(7, None), (8, ""), (9, "!!"), (12, "tiny"), (12, "tiny"), (None, "tiny one")]
    bench = table(spark, items, "item_id long, text string")
    found = decontaminate.find_contamination(documents(spark, texts), bench, window, block).toPandas().set_index("doc_id")
    for i, want in enumerate(brute.hits(texts, items, window)):
        own = found.loc[i][["n_words", "n_hit", "n_items", "items_sha256", "longest_match", "match_start"]]
        assert tuple(None if x != x else x for x in own) == want, i
    clean = decontaminate.decontaminate(documents(spark, texts), bench, window, block)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(found[found["n_hit"] == 0].index)
    assert clean.columns == documents(spark, texts).columns


def test_decontaminate_nothing(spark):
    docs, none = table(spark, [(1, "a b"), (None, None)]), table(spark, [], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.find_contamination(docs, none).collect()} == {0}
    assert decontaminate.find_contamination(docs.where("false"), none).count() == 0


def test_near_dedup_full_chunks_of_short_texts():
    texts = [f"some {i % 7} words of text {i}" for i in range(4095)]
    for last in ("the same few words of text", ""):
        data = [t.encode() for t in [*texts, last]]
        buf, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
        sets, at = near_dedup.shingle_sets(buf, offsets, 5)
        alone, ends = near_dedup.shingle_sets(np.frombuffer(last.encode(), np.uint8), np.array([0, len(last)]), 5)
        assert (np.diff(at) >= 0).all() and sets[at[-2] : at[-1]].tolist() == alone[ends[0] : ends[1]].tolist()
    batch = pa.record_batch([pa.array(range(10_000)), pa.array(range(10_000)), pa.array(["a b c d e f g"] * 4095 + [""] + ["a b c d e f g"] * 5904)], ["doc_id", "text_key", "text"])
    out = pa.Table.from_batches(list(near_dedup._signatures(5)([batch]))).to_pydict()
    assert out["n_shingles"] == [0 if i == 4095 else 3 for i in range(10_000)] and len(set(out["node"]) - {None}) == 1
    pack = zstandard.ZstdCompressor().compress
    rows = pa.record_batch([pa.array([1] * 5000), pa.array([0] * 5000), pa.array([None, *range(2, 5001)]), pa.array([pack(b"a b c d e f g")] * 5000)], ["hub", "part", "member", "packed"])
    assert sum(b.num_rows for b in near_dedup._confirm(5, 80, 100)([rows])) == 4999


def test_last_digits_are_64_bits():
    """Windows with one core: whole hashes differ though 31 bits of them agree."""
    leaves = np.zeros((2, suffix_dedup.PIECE), np.uint64)
    leaves[:, 0] = [0x1234567800000001, 0x1234567900000002]
    batch = pa.record_batch([pa.array([1, 2]), pa.array([1, 2]), pa.array([0, 0]), pa.array([7, 7]), pa.array([r.tobytes() for r in leaves])], ["doc_id", "text_key", "first", "core", "leaves"])
    out = pa.Table.from_batches(list(suffix_dedup._last_digits([batch]))).to_pydict()
    assert out["first"] == [0, 0] and len(set(out["digit"])) == 2
    data = np.frombuffer(b"the bytes of one document, with all windows of their own" * 2, np.uint8)
    at = np.array([0]), np.array([20]), np.array([8])
    own = suffix_dedup._pieces(data, *at, 40, 16)[-1]
    assert own.dtype == np.uint64 and (own[own > 0] >> np.uint64(33) > 0).all() and len(set((own[own > 0] & np.uint64(0xFFFFFFFF)).tolist())) == 21


@pytest.mark.parametrize("more", [{}, {"block": 64}])
def test_near_dedup_links_behind_closer_failures(spark, more):
    """A text links with its partner at a similarity of 0.81; most others are candidates too, many of them closer by sketch."""
    rng = random.Random(3)
    base = prose(rng, 1500).split()
    docs = []
    for i in range(80):  # 20 words of 300 places differ from the base; partners have 7 places in common, others one or two
        at = rng.sample(range(0, 1500, 5), 33)
        docs += [(2 * i + k, " ".join(f"x{rng.randrange(10**9)}" if j in own else w for j, w in enumerate(base))) for k, own in enumerate((set(at[:20]), set(at[13:])))]
    wanted = {d: top for d, (_, top) in brute.near_groups(docs, 5, 80).items()}
    assert len(set(wanted.values())) > 50
    found = near_dedup.near_duplicates(table(spark, docs), **more).toPandas()
    assert dict(zip(found["doc_id"], found["component_id"], strict=True)) == wanted


def test_near_dedup_cells_bring_all_pairs_together(spark):
    for size, main in ((50, 30), (50, 0), (50, 49), (7, 3)):
        rows = [(1, n, 0 if n < main else n) for n in range(size)]
        cells = near_dedup._cells(table(spark, rows, "region long, node long, comp long"), 8).toPandas()
        met = {(a, b) for _, c in cells.groupby("cell") for a in c["node"] for b in c["node"]}
        assert size <= near_dedup.SMALL and not met or all((a, b) in met for a in range(size) for b in range(main, size)) and cells.groupby("cell").size().max() <= 24


def test_decontaminate_blocks_keep_rows_apart(spark):
    item, other = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = [(1, item), (1, "a clean text of six words"), (None, other), (None, "some other text of six words"), (2, item), (2, item), (None, None)]
    bench = table(spark, [(1, item), (1, other), (1, item), (2, "no text has this")], "item_id long, text string")
    found = [sorted(map(str, decontaminate.find_contamination(table(spark, docs), bench, 5, block_words=n).collect())) for n in (1_000_000, 6)]
    assert found[0] == found[1] and len(found[0]) == len(docs)


def test_decontaminate_reads_documents_once_whatever_the_benchmark(spark, tmp_path):
    """Equal rows with 1, 3 and 30 blocks and more; a long item, a hot window, empty, null and repeated texts, clashing names."""
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice((2, 5, 12, 40)))) for i in range(60)] + [(60, prose(rng, 900)), (None, prose(rng, 12)), (61, ""), (62, None)]
    texts = [prose(rng, 60) + " " + rng.choice(items[:60])[1].upper() + ", " + prose(rng, 30) for _ in range(60)]
    texts += [prose(rng, 80) for _ in range(60)] + [items[60][1] + " and more", items[61][1], items[3][1], items[3][1], "", None, "!?"] + [prose(rng, 5) + " " + items[5][1]] * 40
    docs = [(None if i % 50 == 7 else i // 2, t, i, "x") for i, t in enumerate(texts)]
    table(spark, docs, "doc_id long, text string, row long, block string").write.parquet(str(tmp_path / "docs"))
    docs, bench = spark.read.parquet(str(tmp_path / "docs")), table(spark, items, "item_id long, text string")
    total = sum(len((t or "").split()) for _, t in items)
    found, clean = [], []
    for blocks in (1, 3, 30, 200):
        hits = decontaminate.find_contamination(docs, bench, 10, -(-total // blocks))
        found.append(sorted(map(str, hits.collect())))
        kept = decontaminate.decontaminate(docs, bench, 10, -(-total // blocks))
        clean.append(sorted(map(str, kept.collect())))
        assert kept.columns == docs.columns and hits.columns[0] == "doc_id"
        assert ("parquet" in hits._jdf.queryExecution().executedPlan().toString()) == (blocks == 1)  # more blocks: the documents have been read by then, once
    assert all(x == found[0] for x in found) and all(x == clean[0] for x in clean)
    assert 60 <= len(clean[0]) < len(texts) == len(found[0])
    none = docs.where("false")
    assert decontaminate.find_contamination(none, bench, 10, 50).count() == 0 and decontaminate.decontaminate(none, bench, 10, 50).count() == 0
