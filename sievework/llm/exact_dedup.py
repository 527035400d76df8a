"""Exact deduplication by recipes of content-defined chunks, in DataFrame functions only.

Each normalised text is cut where its content says so: at the first sentence end past MIN_CHUNK characters, or at
MAX_CHUNK. A chunk's identifier is its xxhash64 and length; the dictionary of distinct (identifier, SHA-256) verifies
it: identifiers that stand for two contents are replaced by the digest itself. A document is its ordered list of
verified identifiers, a few bytes for each chunk, and only these lists are grouped and compared: texts never move.

Defined cases: null counts as the empty text, whose recipe is the empty list; repeated rows are copies of each other,
and when ids tie the rows of the smallest id all stay; null ids come last and stay only if no other id has the text;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

MIN_CHUNK, MAX_CHUNK = 512, 4096
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?(?:[.!?] |\z)|.{{1,{MAX_CHUNK}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, recipe: array of (weak, size, strong)."""
    base = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    chunks = F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0))
    recipe = F.transform(chunks, lambda c: F.struct(F.xxhash64(c).alias("weak"), F.length(c).alias("size"), F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 32)).alias("strong")))
    return base.select("doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), recipe.alias("recipe"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks: one row per input row."""
    rows = materialise(_recipes(docs), "recipes")
    chunk = rows.select(F.explode("recipe").alias("c")).select("c.weak", "c.size", "c.strong")
    clash = chunk.groupBy("weak", "size").agg(F.min("strong").alias("low"), F.max("strong").alias("high")).where("low <> high")
    # about n^2 / 2^65 identifiers of n chunks clash: none below a billion chunks
    clashes = materialise(clash.select("weak"), "clashes").agg(F.collect_set("weak").alias("weak")).scalar()
    plain = rows.select("doc_id", "text_sha256", F.size("recipe").alias("n_chunks"), "recipe", clashes.alias("clashes"))
    ids = F.transform("recipe", lambda c: F.struct(c["weak"], c["size"], F.when(F.array_contains("clashes", c["weak"]), c["strong"]).otherwise(F.lit(b"")).alias("strong")))
    lists = plain.select("doc_id", "text_sha256", "n_chunks", ids.alias("ids")).withColumn("mark", F.xxhash64("ids"))
    # written out, so that the join deals both sides anew and can split a list with very many copies
    groups = materialise(lists.groupBy("mark", "ids").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return lists.join(groups, ["mark", "ids"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_chunks")
