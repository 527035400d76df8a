"""Queries opN_<name> over the whole documents table, and DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, jaccard_join, language_id, license_scan, line_dedup, mixing, quality, suffix_dedup, token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.selectExpr("doc_id", "n_lines", "n_removed", "length(text) AS kept_chars", "sha2(text, 256) AS kept_sha256")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "draws")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), keep_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.selectExpr("doc_id", "n_hits > 0 AS contaminated", "n_hits", "hits.item_id AS item_ids", "hits")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licences(documents(spark, sf_dir))
    return found.selectExpr("doc_id", "array_join(licences, ',') AS licences", "array_join(sentence_ids, ',') AS sentence_ids", "size(sentence_ids) AS n_known")


def queries() -> dict:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_line_dedup": op3_line_dedup,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_source_mixing": op5_source_mixing,
        "op6_language_id": op6_language_id,
        "op7_token_counts": op7_token_counts,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_decontaminate": op9_decontaminate,
        "op10_license_scan": op10_license_scan,
    }


OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""


def op10_sql() -> str:
    known = license_scan.known_sentences()
    number = {name: i for i, name in enumerate(license_scan.SENTENCES, 1)}
    table = ", ".join(f"('{text}', {i})" for text, i in known.items())
    cut = lambda text: rf"str_split(regexp_replace(regexp_replace(translate(regexp_replace({text}, '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), '{license_scan.UPPER}', '{license_scan.LOWER}'), '[^a-z0-9\n]+', ' ', 'g'), '\x20?\n\x20?', chr(10), 'g'), chr(10))"
    cases = []
    for name in sorted({n for n, _ in license_scan.RULES}):
        tests = " OR ".join(f"contains(',' || {c} || ',', ',{','.join(str(number[s]) for s in rule)},')" for n, rule in license_scan.RULES if n == name for c in ("a", "b"))
        cases.append(f"CASE WHEN {tests} THEN '{name}' END")
    ids = lambda col: f"(SELECT coalesce(string_agg(k.id::VARCHAR, ',' ORDER BY s.i), '') FROM (SELECT unnest({col}) AS t, generate_subscripts({col}, 1) AS i) s JOIN known k ON trim(s.t, ' ') = k.t)"
    return f"""
WITH known(t, id) AS (VALUES {table}),
     d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     s AS (SELECT doc_id, {cut("text")} AS lines, {cut("translate(text, chr(10) || chr(13), '  ')")} AS wrapped FROM d),
     f AS (SELECT doc_id, {ids("lines")} AS a, {ids("wrapped")} AS b FROM s)
SELECT doc_id, concat_ws(',', {', '.join(cases)}) AS licences, a AS sentence_ids,
       CAST(CASE WHEN a = '' THEN 0 ELSE len(str_split(a, ',')) END AS INTEGER) AS n_known
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op10_license_scan": op10_sql()}
