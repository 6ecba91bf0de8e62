"""The pipeline's stages on rows with known answers, and whole on a small table."""

import collections
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from runledger.llm import decontaminate, mixing, near_dedup, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returns, written and read again."""
    docs, found = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs)
    return found


def test_stages_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert [s.columns for s in stages[:-1]] == [columns] * 4
    assert "shard" in stages[-1].columns


def test_each_stage_on_what_the_one_before_kept(spark, stages):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = corpus_pipeline.toxic_field(spark, FOLDER)
    rows = docs.select("doc_id", "text").collect()
    scores = toxicity.score_texts(model, [r.text for r in rows])
    assert {r.doc_id for r in stages[0].collect()} == {r.doc_id for r, (s, _) in zip(rows, scores) if s < 0.7}
    groups = near_dedup.near_groups(stages[0]).collect()
    assert {r.doc_id for r in stages[1].collect()} == {r.component_id for r in groups}
    flags = decontaminate.flag_leaks(stages[1], spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()
    assert {r.doc_id for r in stages[2].collect()} == {r.doc_id for r in flags if not r.contaminated}
    assert {r.doc_id for r in stages[3].collect()} <= {r.doc_id for r in stages[2].collect()}
    last = stages[4].collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in stages[3].collect())
    bytes_of = collections.Counter()
    for r in last:
        bytes_of[r.shard] += r["size"]
    assert max(bytes_of.values()) - min(bytes_of.values()) <= 0.01 * np.mean(list(bytes_of.values()))


def test_run_equals_its_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect()), key=repr) == sorted(map(tuple, stages[-1].collect()), key=repr)


def test_stages_on_odd_rows(spark):
    rows = [(1, "a b c", "en", "src0"), (1, "a b c", "en", "src0"), (2, None, None, None), (3, "", "xx", "s"), (None, "some words here", "en", None), (4, "w " * 100_000, "de", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text")).withColumn("shard", F.lit(9))
    for table in (docs, docs.limit(0)):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "/root/testdata/sf0.001")
            assert now.columns == table.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, "/root/testdata/sf0.001").count() <= table.count()


def test_languages_without_a_target_survive_the_mixing(spark):
    langs = ["en", "en", "de", "fr", "es", None, "xx", "ja"]
    rows = [(i, f"w{i} two three four", langs[i % 8], f"src{i % 3}") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    left = collections.Counter(r.lang for r in corpus_pipeline.mixing(spark, docs, FOLDER).collect())
    # Three in eight have no target: they keep that share of the mix.
    assert all(abs(left[lang] - 0.75 * 1000) < 75 for lang in (None, "xx", "ja")), left
    only = docs.where("lang is null")
    assert abs(corpus_pipeline.mixing(spark, only, FOLDER).count() - 750) < 75


def test_sources_are_mixed_against_each_other(spark):
    # Of 10,000 tokens src0 has 20 %, hot 50 %, b 20 %, c 9.5 %, and many small ones and null the rest.
    source = lambda i: "src0" if i % 10 < 2 else "hot" if i % 10 < 7 else "b" if i % 10 < 9 else None if i % 400 == 9 else f"small{i}" if i % 400 == 199 else "c"
    docs = spark.createDataFrame([(i, f"w{i}", "en", source(i)) for i in range(10_000)], "doc_id long, text string, lang string, source string")
    rows = mixing.draw_documents(docs, corpus_pipeline.margins(), 0.4).select("source", F.col("mix_cell")[0].alias("cls"), "mix_probability").collect()
    assert {r.cls for r in rows if r.source is None or r.source.startswith("small")} == {mixing.REST}
    got = collections.Counter()
    for r in rows:
        got[r.cls] += r.mix_probability / 4000
    # The rest is smaller than its target and taken whole; the others divide what it leaves.
    have = collections.Counter(source(i) if source(i) in ("src0", "hot", "b", "c") else mixing.REST for i in range(10_000))
    assert np.isclose(got[mixing.REST], have[mixing.REST] / 4000)
    for a, b in (("hot", "b"), ("b", "c")):
        assert np.isclose(got[a] / got[b], (have[a] / have[b]) ** 0.5, rtol=1e-3), (a, b)
    assert abs(got["src0"] - 0.3) < 0.03 and np.isclose(sum(got.values()), 1)
