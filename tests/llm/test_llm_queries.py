"""Registered queries on the smallest tables: whole results, SQL where there is some, the pipeline."""

import random
from collections import Counter

import duckdb
import pytest
import test_llm

from sievework.llm import mixing, queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf, name):
    frame = queries.queries()[name](spark, sf)
    rows = frame.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    if sql := queries.oracle_sql().get(name):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        relation = con.sql(sql)
        at = [relation.columns.index(c) for c in frame.columns]
        assert sorted(tuple(r) for r in rows) == sorted(tuple(r[i] for i in at) for r in relation.fetchall())


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == columns, name
        docs = after
    found = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in found} <= {r.doc_id for r in docs.collect()} and all(r.copies in (1, 2) for r in found)
    assert all(n == found_copies for (_, found_copies), n in Counter((r.doc_id, r.copies) for r in found).items())
    assert 100 < len({r.doc_id for r in found}) < 200


def test_pipeline_against_loops(spark, tmp_path):
    """run() on a small corpus with odd rows: each stage by the loops of test_llm, then the mix of what these leave."""
    import corpus_pipeline

    rng = random.Random(41)
    paragraph = lambda n=12: "\n".join(test_llm.prose(rng, rng.randint(6, 14), 5000) for _ in range(n))
    items = [(i, test_llm.prose(rng, 40, 5000) + "\n" + test_llm.prose(rng, 8, 5000)) for i in range(6)]
    base = [paragraph() for _ in range(60)]
    texts = list(base)
    for text in base[:20]:
        words = text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))  # near copies, line for line
    for text in base[20:30]:
        texts.append(" ".join(x for x in text.split()))  # near copies of one line
    texts += [base[31] + "\n" + items[k][1] + "\n" + paragraph(3) for k in range(4)] + [items[5][1].replace("\n", " ")]
    texts += [paragraph(2) + "\n" + "\n".join(base[40].split("\n")[3:9]) + "\n" + paragraph(2) for _ in range(6)]
    texts += [None, "", "1234 5678", base[50], base[51] + " ", "one word"]
    rows = [(i, t, ["en", "fr", None][i % 3], [f"s{i % 3}", None][i % 5 == 0], len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    kept = {d: t for d, t in test_llm.plain_line_dedup([r[:2] for r in left]) if t}
    left = [(d, kept[d], lang, source, n if kept[d] == t else len(kept[d])) for d, t, lang, source, n in left if d in kept]
    assert 0 < len(left) < len(rows) and any(kept[r[0]] != r[1] for r in rows if r[0] in kept)
    groups = {d: c for d, _, c in test_llm.components([r[:2] for r in left])}
    left = [r for r in left if groups[r[0]] == r[0]]
    assert len(left) < len(kept)
    clean = [r for r in left if not any(test_llm.plain_hit(item, r[1]) for _, item in items)]
    assert len(left) - len(clean) == 5
    want = mixing.mixed_rows(mixing.mix(spark.createDataFrame(clean, schema))).collect()
    assert Counter(corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(want)
