import brute
from pyspark.sql import functions as F

import corpus_pipeline
from dayproof.llm import catalog, quality_embed, rules

SF = "/root/testdata/sf0.001"


def test_every_dealt_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES if n.startswith("op")) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "exact_dedup", "near_dedup", "packing"]


def test_stages_against_plain_versions(spark, tmp_path):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = raw.withColumn("kept", F.lit(1)).unionByName(raw.limit(3).withColumn("kept", F.lit(2)))
    passed = {r["doc_id"] for r in rules.quality_rules(raw, labels).where("kept").collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        ids = [r["doc_id"] for r in after.collect()]
        if number < 4:
            assert after.columns == docs.columns and {tuple(r) for r in after.collect()} <= {tuple(r) for r in before}
        if name == "quality_rules":
            assert set(ids) == passed and len(ids) == sum(r["doc_id"] in passed for r in before)
        if name == "quality_classifier":
            assert set(ids) == {r["doc_id"] for r in quality_embed.classify_quality(docs, labels).where("predicted = 1").collect()}
        if name == "exact_dedup":
            firsts = {}
            for r in before:
                key = " ".join([" " * r["text"][:1].isspace(), *brute.words(r["text"])])
                firsts[key] = min(firsts.get(key, r["doc_id"]), r["doc_id"])
            assert sorted(ids) == sorted(firsts.values())
        if name == "near_dedup":
            found = brute.near_components([(r["doc_id"], r["text"]) for r in before])
            assert sorted(ids) == sorted(set(found.values()))
        if name == "packing":
            assert set(ids) == {r["doc_id"] for r in before}
        docs = after


def test_run_gives_the_rows_of_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({(r["doc_id"], r["start"]) for r in rows}) == len(rows)
