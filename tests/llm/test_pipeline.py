"""The pipeline: each stage's contract, and the whole against its parts."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import DATA


def test_stages(spark):
    sf = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for name, stage in P.STAGES[:-1]:
        out = P.materialize(stage(spark, seen, sf), "test")
        assert out.columns == docs.columns, name
        if name != "source mixing":
            assert out.exceptAll(seen).isEmpty() and 0 < out.count() <= seen.count(), name
        if name == "language ID":
            assert out.count() > 0.99 * docs.count()
        if name == "toxicity":
            kept = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").agg(F.avg("toxic")).first()[0]
            assert kept < 0.05
        seen = out
    packed = P.STAGES[-1][1](spark, seen, sf)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    assert packed.select("doc_id").distinct().count() == seen.select("doc_id").distinct().count()


def test_run_of_odd_and_empty_documents(spark, odd_docs, tmp_path):
    """Every stage on odd rows with clashing columns, and the run as a whole against its stages."""
    cols = ["doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars")]
    clash = [F.lit("clash").alias(c) for c in ("score", "lang_pred", "toxicity", "evidence", "size", "start", "round", "row", "spans", "tie", "own_id", "stays", "node", "piece", "length")]
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd_docs), ("none", odd_docs.where("false"))):
        docs.select(*cols, *clash).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    sf = str(tmp_path / "odd")
    seen = [spark.read.parquet(f"{sf}/documents.parquet")]
    for stage_name, stage in P.STAGES[:-1]:
        out = P.materialize(stage(spark, seen[-1], sf), "test")
        assert out.columns == seen[0].columns, stage_name
        assert out.where("score <> 'clash' or piece <> 'clash'").isEmpty(), stage_name
        seen.append(out)
    ids = [[r["doc_id"] for r in s.collect()] for s in seen]
    assert {2, 3, 4}.isdisjoint(ids[1]) and set(ids[1]) <= set(ids[0]) and set(ids[2]) <= set(ids[1])
    assert len(ids[3]) == len(set(ids[3])) and (None not in ids[3] or 1 not in ids[3])  # the row without an id is a copy of 1
    packed = P.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == set(ids[4])
    assert sum(r["length"] for r in packed if r["doc_id"] == 1) == sum(r["length"] for r in P.pack(spark, seen[4], sf).collect() if r["doc_id"] == 1)
    assert P.run(spark, str(tmp_path / "none")).collect() == []
