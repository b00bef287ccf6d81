"""The stages of the pipeline on planted cases, and the registry."""

from __future__ import annotations

import random

import pytest

from .helpers import SF

pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(7)
    vocabulary = ["".join(r.choice("bcdfgmnprst") + r.choice("aeou") for _ in range(r.randint(1, 4))) for _ in range(600)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows, labels = {}, []
    for k in range(500):
        rows[k] = text(r.randint(60, 200))
        if k % 6 == 0:
            words = rows[k].split()
            words[5:8] = ["zorgle", "frimbad", "zorgle"]
            rows[k] = " ".join(words)
        labels.append((k, 1, int(k % 6 == 0)))
    rows[901] = rows[901 - 900 + 6]  # a copy of 7
    rows[902] = "too short"
    rows[903] = text(80) + " mail jo.81@mail7.example.com"
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}", rows


def test_stages_take_effect(spark, corpus):
    import corpus_pipeline

    from tessera.llm import common

    sf, rows = corpus
    docs, ids = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf), "test")
        assert docs.columns == columns
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    toxic = {k for k in rows if "zorgle" in rows[k]}
    assert ids["toxicity"] == set(rows) - toxic
    assert 902 not in ids["quality rules"] and len(ids["quality rules"]) >= len(ids["toxicity"]) - 4
    assert 901 not in ids["SimHash near-dedup"] and ids["SimHash near-dedup"] == ids["quality rules"] - {901}
    text = docs.filter("doc_id = 903").first()["text"]
    assert "jo.81@" not in text and text.startswith(rows[903][:50])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == ids["PII"] and sum(r["length"] for r in packed) == sum({r["doc_id"]: r["doc_tokens"] for r in packed}.values())
    assert sorted((r["doc_id"], r["start"]) for r in corpus_pipeline.run(spark, sf).collect()) == sorted((r["doc_id"], r["start"]) for r in packed)


def test_empty_documents(spark, corpus, tmp_path):
    import corpus_pipeline

    sf, _ = corpus
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_registry(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_queries_run_on_the_smallest_tables(spark):
    from tessera.llm import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op2_winnowing", "op4_pii", "op6_sentencepiece", "op9_simhash", "op10_quality", "op3_toxicity", "op7_mixcoder"):
        assert queries.QUERIES[name](spark, SF).count() == docs, name
