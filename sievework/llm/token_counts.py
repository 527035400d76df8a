"""Token counts through a digest cache.

Texts are looked up by (tokenizer digest, content digest); only distinct texts without a stored count are encoded,
and their counts are appended to the cache: a table in the shared folder, partitioned by tokenizer, that later calls and
sessions with that folder find again. The content is normalised as the tokenizer does it: for an identity normaliser
that is the text itself, null being the empty text.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows and equal texts are encoded once and
each row is returned; null ids are kept; an empty table gives no rows; further columns are ignored; texts of any
length are encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialise, path_exists, shared_dir, small_batches

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
#: The cache's folder within the shared one.
CACHE = "sievework-token-cache"


def load_counter(kind: str, model: bytes):
    """Function from a list of texts to their token counts, without special tokens."""
    if kind == "model":
        import sentencepiece

        encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(x) for x in encoder.encode(texts, num_threads=1)] if texts else []
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_str(model.decode())
    encoder.no_truncation()
    encoder.no_padding()
    return lambda texts: [len(x.ids) for x in encoder.encode_batch(texts, add_special_tokens=False)]


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops texts that this task has seen, so copies do not travel."""
    seen: set[bytes] = set()
    for batch in batches:
        digests, texts = [], []
        for text in batch.column(0).fill_null("").to_pylist():
            digest = hashlib.sha256(text.encode()).digest()
            if digest not in seen:
                seen.add(digest)
                digests.append(digest)
                texts.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(texts, pa.string())], ["digest", "text"])


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row. The cache may be shared by many runs."""
    spark = docs.sparkSession
    small_batches(spark)
    model = Path(tokenizer_path).read_bytes()
    kind, version = Path(tokenizer_path).suffix[1:], hashlib.sha256(model).hexdigest()
    held = checked_broadcast(spark, model, len(model), "the tokenizer")
    cache_path = cache_path or f"{shared_dir(spark)}/{CACHE}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = load_counter(kind, held.value), set()
        for batch in batches:
            digests, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            fresh = {d: t for d, t in zip(digests, texts, strict=True) if d not in seen}
            seen.update(fresh)
            keys, values = list(fresh), list(fresh.values())
            for at in range(0, len(keys), 256):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 256], pa.binary()), pa.array(count(values[at : at + 256]), pa.int64())], ["digest", "n_tokens"])

    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    misses = text.mapInArrow(_distinct_texts, "digest binary, text string")
    if path_exists(spark, cache_path):
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
        misses = misses.join(stored.select("digest").distinct(), "digest", "left_anti")
    counted = misses.repartition("digest").mapInArrow(encode, "digest binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)

    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    # two runs may have counted one text; written out, so that the join can split a text with very many copies
    counts = materialise(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"),
    )
    return rows.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
