import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import quality
from logloom.llm.queries import PIECES
from test_llm_simhash import plain_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The table before and after every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('pipeline')}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_names_and_columns(spark, steps):
    assert list(steps) == ["quality", "simhash", "mixing", "sentencepiece"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(steps[n][1].columns == columns for n in list(steps)[:-1])


def test_quality_stage_drops_what_scores_low(spark, steps):
    before, after = steps["quality"]
    model = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(before, model).collect() if r.score >= 0.3}
    assert {r.doc_id for r in after.select("doc_id").collect()} == good
    assert after.exceptAll(before).count() == 0 and 0 < after.count() < before.count()


def test_simhash_stage_keeps_one_of_each_group(steps):
    before, after = steps["simhash"]
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted({c for _, _, c in plain_components(rows)})
    assert after.exceptAll(before).count() == 0


def test_mixing_stage_repeats_and_drops(steps):
    before, after = steps["mixing"]
    assert after.exceptAll(before.union(before)).count() == 0
    words = lambda d: d.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words(after) == pytest.approx(1.5 * words(before), rel=0.2)


def test_encoding_stage_against_the_library(steps):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    before, after = steps["sentencepiece"]
    assert after.count() == before.count()
    for r in after.collect():
        assert r.n_pieces == len(sp.encode(r.text or ""))
        assert r.decoded_crc32 == zlib.crc32(sp.decode(sp.encode(r.text or "")).encode())


def test_run_gives_the_stages_result(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    want = steps["sentencepiece"][1]
    assert got.schema == want.schema
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
