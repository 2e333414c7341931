"""The mixture's order past the files that it is written to."""

import os

from lakemill.llm import mixing
from tests.llm.conftest import SF


def in_order(docs):
    return [r.doc_id for r in mixing.mix(docs)[0].orderBy("_mix_slot", "_mix_rank").collect()]


def test_run_keeps_the_mixture(spark, monkeypatch):
    import corpus_pipeline

    fourth = {}
    mixture = corpus_pipeline.STAGES[3][1]

    def kept(spark, docs, sf_dir):
        fourth["docs"] = docs
        return mixture(spark, docs, sf_dir)

    stages = [*corpus_pipeline.STAGES]
    stages[3] = ("mixing", kept)
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.position for r in rows) == list(range(len(rows)))
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.position)] == in_order(fourth["docs"])


def test_positions_of_written_rows(spark, tmp_path):
    # later files are larger, and one task writes several: read back, the rows stand in another order
    df = spark.range(3000).selectExpr("id as doc_id", "concat('s', id % 3) as source", "repeat(md5(cast(id as string)), int(id / 300)) as text")
    want = in_order(df)
    path = str(tmp_path / "mixed")
    mixing.mixed_order(df).write.option("maxRecordsPerFile", 200).parquet(path)
    assert sum(f.endswith(".parquet") for f in os.listdir(path)) > 12
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for bytes_ in ("8k", "64k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
            back = spark.read.parquet(path)
            assert [r.doc_id for r in back.collect()] != want
            rows = mixing.positions(back).collect()
            assert [r.doc_id for r in sorted(rows, key=lambda r: r.position)] == want
            assert sorted(r.position for r in rows) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    rows = mixing.positions(mixing.mixed_order(df).cache()).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.position)] == want
    assert mixing.positions(mixing.mixed_order(df.where("false"))).count() == 0
