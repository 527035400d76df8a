"""Language identification by a mixture of n-gram models.

Learning counts hashed character n-grams (bytes, words padded by a space) of every labelled training row by language.
A document's language proportions are then estimated by expectation-maximisation over its n-grams' likelihoods; the
language set is the one of the greatest penalised likelihood (BIC: half the log of the n-gram count for each language),
found by leaving out the weakest language as long as the penalised likelihood grows. lang_pred is the language with the
greatest share, score that share.

Defined cases: null or letterless texts are `und` with score 0 and no languages; rows with null text or lang are not
learned from; repeated rows count each time; ties go to the language that sorts first; without any labelled row every
text is `und`; an empty table gives no rows; further columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, small_batches
from .textvec import LOWER, U, mix, pieces

BUCKETS = 1 << 15
#: Trigrams; each language's table has BUCKETS counts.
N = 3
EM_ROUNDS, SMOOTH = 12, 0.5
#: Tables of more languages than this would pass the broadcast bound.
MAX_LANGS = 400


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def gram_buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram and the first trigram of each row (len+1). White space and ASCII digits and signs are one byte: 0x20; trigrams of separators only are left out by their bucket -1."""
    low = LOWER[data]
    letter = ((low >= ord("a")) & (low <= ord("z"))) | (low >= 0x80)
    low = np.where(letter, low, np.uint8(0x20))
    if len(low) < N:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    code = low[:-2].astype(np.uint64) << U(16) | low[1:-1].astype(np.uint64) << U(8) | low[2:].astype(np.uint64)
    bucket = (mix(code) & U(BUCKETS - 1)).astype(np.int64)
    middle = letter[1:-1]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = middle & (row[:-2] == row[2:])
    index = np.flatnonzero(keep)
    return bucket[index], np.searchsorted(index, off)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for a, b, data, off in pieces(batch.column(1)):
            bucket, first = gram_buckets(data, off)
            for lang in set(langs[a:b]):
                rows = np.repeat(langs[a:b] == lang, np.diff(first))
                counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                counts[lang] += np.bincount(bucket[rows], minlength=BUCKETS)
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([0] * len(counts), pa.int32()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], ["lang", "salt", "counts"])


def _merge(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, lang, salt = np.zeros(BUCKETS, np.int64), None, 0
    for t in tables:
        for x in t.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.int64)
    lang, salt = key[0].as_py(), key[1].as_py()
    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([salt], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["lang", "salt", "counts"])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their log-probabilities by bucket: (languages, BUCKETS) float32."""
    schema = "lang string, salt int, counts binary"
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    part = train.select("lang", "text").mapInArrow(_count, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)).cast("int"))
    part = part.groupBy("lang", "salt").applyInArrow(_merge, schema)
    part = part.withColumn("salt", F.lit(0)).groupBy("lang", "salt").applyInArrow(_merge, schema)
    rows = sorted(part.limit(MAX_LANGS + 1).toLocalIterator(), key=lambda r: r.lang)
    if len(rows) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    counts = np.array([np.frombuffer(r.counts, np.int64) for r in rows], np.float64).reshape(len(rows), BUCKETS) + SMOOTH
    return [r.lang for r in rows], np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def mixture(log_p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Shares of the languages, summing to 1, for n-grams with these log-likelihoods (languages, n-grams) and counts."""
    total = float(weight.sum())
    top = log_p.max(0)
    p = np.exp(log_p - top)
    shift = float((weight * top).sum())

    def fit(active: np.ndarray) -> tuple[np.ndarray, float]:
        q, share = p[active], np.full(len(active), 1 / len(active))
        for _ in range(EM_ROUNDS if len(active) > 1 else 0):
            mass = share @ q
            share = share * (q @ (weight / np.maximum(mass, 1e-300))) / total
        return share, float((weight * np.log(np.maximum(share @ q, 1e-300))).sum()) + shift

    active = np.arange(len(p))
    share, like = fit(active)
    penalty = 0.5 * np.log(max(total, 2.0))
    while len(active) > 1:
        fewer = np.delete(active, int(share.argmin()))
        share2, like2 = fit(fewer)
        if like2 < like - penalty:
            break
        active, share, like = fewer, share2, like2
    out = np.zeros(len(p))
    out[active] = share / share.sum()
    return out


def _predict(column: pa.Array, langs: list[str], table: np.ndarray) -> tuple[list, list, list, list]:
    """lang_pred, score, language set and shares of each text."""
    lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    best, score, sets, shares = [], [], [], []
    for a, _, data, off in pieces(column):
        bucket, first = gram_buckets(data, off)
        for i, (s, e) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True), a):
            if not lettered[i] or not len(langs):
                best.append("und"), score.append(0.0), sets.append([]), shares.append([])
                continue
            grams, weight = np.unique(bucket[s:e], return_counts=True)
            share = mixture(table[:, grams].astype(np.float64), weight.astype(np.float64)) if len(grams) else np.full(len(langs), 1 / len(langs))
            k = int(share.argmax())
            on = np.flatnonzero(share > 0)
            best.append(langs[k]), score.append(min(1.0, float(share[k]))), sets.append([langs[j] for j in on]), shares.append(share[on].tolist())
    return best, score, sets, shares


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs, shares for each row, with models learned from docs itself."""
    small_batches(docs.sparkSession)
    langs, log_p = learn(docs)
    held = checked_broadcast(docs.sparkSession, log_p, log_p.nbytes, "the language model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, sets, shares = _predict(batch.column(2), langs, held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], ["doc_id", "held_out", "lang_pred", "score", "langs", "shares"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, langs array<string>, shares array<double>")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The whole rows of docs whose lang_pred is not `und`; rows without any letter go."""
    small_batches(docs.sparkSession)
    langs, log_p = learn(docs)
    held = checked_broadcast(docs.sparkSession, log_p, log_p.nbytes, "the language model")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = _predict(batch.column(at), langs, held.value)[0]
            yield batch.filter(pa.array([x != "und" for x in best], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
