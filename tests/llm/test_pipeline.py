"""The pipeline's stages against brute force, each on what the stage before it kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import packing, quality
from tests.llm.conftest import SF
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_line_dedup import brute as line_deduped
from tests.llm.test_near_copies import holds
from tests.llm.test_quality import BIG
from tests.llm.test_packing import held as packed_well


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the output of each stage."""
    out, docs = [spark.read.parquet(f"{SF}/documents.parquet")], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_copies", "decontamination", "packing"]
    assert all(x.columns == stages[0].columns and x.dtypes == stages[0].dtypes for x in stages[1:5])


def test_quality_decides_by_the_score(spark, stages):
    kept = {d for d, _ in pairs(stages[1])}
    scores = quality.score(stages[0], quality.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet")))
    assert kept == {r.doc_id for r in scores.where("_score >= 0.3").collect()}


def test_quality_keeps_the_good_and_rejects_the_bad(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, BIG).select("doc_id").collect()}
    rows = labels.where(quality.held_out(F.col("doc_id"))).collect()
    good, bad = [r.doc_id for r in rows if r.quality], [r.doc_id for r in rows if not r.quality]
    assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in bad) <= 0.5 * len(bad)


def test_lines(stages):
    got = stages[2].withColumn("s", F.sha2("text", 256)).collect()
    assert sorted((r.doc_id, r.s) for r in got) == sorted((e[0], e[3]) for e in map(eval, line_deduped(pairs(stages[1]))))
    assert all(r.n_chars == len(r.text) for r in got)


def test_near_copies(stages):
    holds(pairs(stages[3]), pairs(stages[2]))


def test_benchmark(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {eval(x)[0] for x in contaminated(pairs(stages[3]), items)}
    assert sorted(pairs(stages[4])) == sorted((d, t) for d, t in pairs(stages[3]) if d not in found)


def test_packing(stages):
    packed_well(stages[5], pairs(stages[4]), packing.CONTEXT, packing.TOKEN_BUDGET, packing.BUCKETS)


def test_run_is_the_stages_in_turn(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[5].collect()))
