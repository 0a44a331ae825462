"""Spark hands the rows of a stage to Python by bytes."""

import corpus_pipeline
import pyarrow as pa
import pytest


@pytest.fixture
def unset(spark):
    spark.conf.unset(corpus_pipeline.BATCH_SETTING)
    yield
    spark.conf.unset(corpus_pipeline.BATCH_SETTING)


def batches(spark):
    """(bytes, rows) of the batches that Python gets of 2,000 texts of 10,000 characters, in one task."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "rows": [batch.num_rows]})

    docs = spark.range(0, 2000, 1, 1).selectExpr("id", "repeat(cast(id % 10 as string), 10000) as text")
    work = corpus_pipeline.stage(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "bytes long, rows long"))
    return work(spark, docs, "").collect()


def test_batches_are_small_and_whole(spark, unset):
    got = batches(spark)
    assert sum(r["rows"] for r in got) == 2000
    assert max(r["bytes"] for r in got) < 2 * corpus_pipeline.BATCH_BYTES


def test_a_setting_of_the_session_stays(spark, unset):
    spark.conf.set(corpus_pipeline.BATCH_SETTING, "1m")
    assert max(r["bytes"] for r in batches(spark)) < 2 << 20
    assert spark.conf.get(corpus_pipeline.BATCH_SETTING) == "1m"
