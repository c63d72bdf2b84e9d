"""Language identification by error-correcting output codes.

Every language gets a binary codeword. For each bit, a binary classifier over hashed byte n-grams is
learned from corpus counts: its weight for an n-gram is the log odds between the languages whose bit is
one and those whose bit is zero, with every language given the same say. A text's margins are decoded to
the nearest codeword, every bit's logistic loss being weighted by how well it separates the training
languages; a text whose two nearest codewords are close together is flagged as ambiguous.

Learning is one counting pass (n-gram counts per language, summed by Spark); what reaches the driver is
languages x buckets numbers. Scoring is one pass without a shuffle.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm import text as tx

UNDETERMINED = "und"
RESULT = "doc_id long, lang_pred string, score double, margin double, ambiguous boolean, bits string"

#: Bytes that are no letters become blanks before n-grams are taken; bytes from 0x80 on stay.
_FOLD = tx.LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def _grams(buf: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigrams and trigrams of all texts, and the text of each; none crosses a text's end or is all blank."""
    b = _FOLD[buf].astype(np.uint32)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    found, owner = [], []
    for width, salt in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        n = len(b) - width + 1
        if n <= 0:
            continue
        code = np.full(n, salt, dtype=np.uint32)
        for k in range(width):
            code = (code ^ b[k : k + n]) * np.uint32(0x01000193)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        keep = (doc[:n] == doc[width - 1 :]) & ((b[:n] != 0x20) | (b[1 : n + 1] != 0x20))
        found.append((code >> np.uint32(12))[keep] % np.uint32(buckets))
        owner.append(doc[:n][keep])
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(found), np.concatenate(owner)


def _counts(buckets: int):
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for row, end, buf, offsets in tx.text_chunks(batch, "text"):
                names = sorted(set(langs[row:end]))
                number = np.array([names.index(x) for x in langs[row:end]])
                gram, doc = _grams(buf, offsets, buckets)
                here = np.bincount(number[doc] * buckets + gram, minlength=len(names) * buckets).reshape(len(names), buckets)
                for i, x in enumerate(names):
                    total[x] = total.get(x, 0) + here[i]
        for x, c in total.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])

    return run


def codewords(languages: int) -> np.ndarray:
    """A row of bits for each language: a random dense code of 10 bits for each doubling of their number, the best of
    50 draws by least distance of two rows. No bit is the same for all languages."""
    if languages < 2:
        return np.ones((languages, 1), dtype=int)
    bits = 10 * int(np.ceil(np.log2(languages)))
    best, apart = None, -1
    for seed in range(50):
        rng = np.random.default_rng(seed)
        code = rng.integers(0, 2, (languages, bits))
        while len(same := np.flatnonzero(code.min(0) == code.max(0))):
            code[:, same] = rng.integers(0, 2, (languages, len(same)))
        sign = (2 * code - 1).astype(np.float32)
        alike = sign @ sign.T
        np.fill_diagonal(alike, -bits)
        least = int(bits - alike.max()) // 2
        if least > apart:
            best, apart = code, least
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # of each bit


def learn_languages(docs: DataFrame, buckets: int = 1 << 13) -> LanguageModel:
    """Learns from all rows with a text and a non-null lang; only these two columns are read.

    All values of lang are learned; the driver holds `buckets` numbers for each (64 KB, so 450 MB for 7,000
    languages), however many documents there are. Without any row there is no language, and every text is undetermined.
    """
    seen = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = seen.mapInArrow(_counts(buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = counts.toArrow()  # languages x buckets rows at most
    langs, number = np.unique(counts.column("lang").to_numpy(zero_copy_only=False), return_inverse=True) if counts.num_rows else ((), None)
    names = tuple(map(str, langs))
    if not names:
        return LanguageModel((), np.zeros((0, 1)), np.zeros((buckets, 1)), np.ones(1))
    table = np.zeros((len(names), buckets))
    table[number.ravel(), counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    share = (table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * buckets)
    code = codewords(len(names))
    if len(names) == 1:
        return LanguageModel(names, code, np.ones((buckets, 1)), np.ones(1))
    one = code.T @ share / code.sum(0)[:, None]
    zero = (1 - code).T @ share / (1 - code).sum(0)[:, None]
    weights = np.log(one / zero).T
    margins = share @ weights  # each language's expected margin on each bit
    trust = np.maximum((margins * (2 * code - 1)).min(0), 1e-3)
    return LanguageModel(names, code, weights, trust / trust.mean())


def _has_letter(data: bytes) -> bool:
    return any(c.isalpha() for c in data.decode("utf-8", "replace"))


def decode(model: LanguageModel, margin: np.ndarray, at_once: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text's margins (texts x bits): the nearest codeword by trusted logistic loss, its share, and how far the second is.

    A bit's loss has two values, by the code's bit, so two matrix products give all losses; texts are taken `at_once`, so that
    no array has more than that many rows of a number per language.
    """
    n = len(margin)
    choice, score, apart = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    for k in range(0, n if model.languages else 0, at_once):
        m = margin[k : k + at_once]
        losses = ((np.logaddexp(0, -m) * model.trust) @ model.code.T + (np.logaddexp(0, m) * model.trust) @ (1 - model.code).T) / m.shape[1]
        p = np.exp(losses.min(1, keepdims=True) - losses)
        p /= p.sum(1, keepdims=True)
        choice[k : k + at_once] = p.argmax(1)
        top = np.partition(p, -2, axis=1)[:, -2:] if p.shape[1] > 1 else np.column_stack([np.zeros(len(p)), p])
        score[k : k + at_once], apart[k : k + at_once] = top[:, 1], top[:, 1] - top[:, 0]
    return choice, score, apart


def _predict(model, ambiguous_below: float):
    def run(batches):
        m = model.value
        buckets, bits = m.weights.shape
        letter = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
        for batch in batches:
            for row, end, buf, offsets in tx.text_chunks(batch, "text", 1 << 20):
                n = end - row
                total, size = np.zeros((n, bits)), np.zeros(n)
                gram, doc = _grams(buf, offsets, buckets)
                for k in range(0, n, 64):  # 64 texts at a time: small dense count tables
                    own = (doc >= k) & (doc < k + 64)
                    many = min(64, n - k)
                    table = np.bincount((doc[own] - k) * np.int64(buckets) + gram[own], minlength=many * buckets).reshape(many, buckets)
                    total[k : k + many], size[k : k + many] = table @ m.weights, table.sum(1)
                ascii_letters = np.concatenate([[0], np.cumsum(letter[buf])])
                known = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
                for i in np.flatnonzero(~known):
                    known[i] = _has_letter(buf[offsets[i] : offsets[i + 1]].tobytes())
                if not m.languages:
                    known[:] = False
                margin = total / np.maximum(size, 1)[:, None] * np.minimum(size, 100)[:, None]
                best, read = [], []
                choice, score, apart = decode(m, margin)
                flag = apart < ambiguous_below if m.languages else np.zeros(n, bool)
                for i in range(n):
                    best.append(m.languages[choice[i]] if known[i] else UNDETERMINED)
                    read.append("".join("1" if x > 0 else "0" for x in margin[i]) if known[i] else None)
                score, apart = np.where(known, score, 0.0), np.where(known, apart, 0.0)
                yield pa.record_batch([batch.column(0).slice(row, n), pa.array(best, pa.string()), pa.array(score), pa.array(apart), pa.array(flag & known), pa.array(read, pa.string())], ["doc_id", "lang_pred", "score", "margin", "ambiguous", "bits"])

    return run


def identify(docs: DataFrame, model: LanguageModel, ambiguous_below: float = 0.2) -> DataFrame:
    """Predicts the language of every row from its text alone: lang_pred, score, margin, ambiguous and the bits read.

    A text that is null, empty or without a letter is `und` with score 0, and so is every text if the model
    has no language. Ties between codewords go to the first language by name. Rows with a null or repeated
    doc_id each get their row. Very long texts count as a whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_predict(shared, ambiguous_below), RESULT)


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    """Whether crc32 of the id's text leaves the remainder which; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(False))


def keep_identified(docs: DataFrame, model: LanguageModel, reject_below: float = 0.5) -> DataFrame:
    """The documents with all their columns, without the undetermined and those ambiguous with a score under reject_below.

    A row is judged where it stands: only its text goes to Python, and nothing is shuffled.
    """
    predict = _predict(docs.sparkSession.sparkContext.broadcast(model), 0.2)

    @F.arrow_udf("boolean")
    def clear(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            rows = pa.record_batch([pa.nulls(len(text), pa.int64()), text], ["doc_id", "text"])
            verdicts = [pa.array([], pa.bool_())]
            for found in predict([rows]):
                lang, score, flag = (found.column(found.schema.get_field_index(c)) for c in ("lang_pred", "score", "ambiguous"))
                bad = pc.or_(pc.equal(lang, UNDETERMINED), pc.and_(flag, pc.less(score, reject_below)))
                verdicts.append(pc.invert(bad))
            yield pa.concat_arrays(verdicts)

    return docs.where(clear(docs["text"]))
