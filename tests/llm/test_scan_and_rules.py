import random
import tracemalloc
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from dayproof.llm import quality_embed, rules, textscan
from dayproof.llm.ngrams import document_features, labelled_sample, mean_weights, train
from dayproof.llm.textscan import Block, blocks

LABELS = "doc_id long, quality int, toxic int"
ODD = ["", None, " ", "a", "\n\n", "é ü x\ty", "a\x0bb\x0cc", "x " * 50, "日本 語", "line\nline\n line\nline", "word***", "€" * 3]


def test_words_are_those_of_the_pattern():
    block = Block.of(ODD)
    starts, ends, first = block.word_edges()
    for i, text in enumerate(ODD):
        own = [bytes(block.data[a:b]).decode() for a, b in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]], strict=True)]
        assert own == brute.words(text)


def test_blocks_keep_documents_whole():
    import pyarrow as pa

    texts = ["ab" * 10, None, "c", "", "d" * 100, "e"]
    parts = list(blocks([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])], "text", 25))
    assert [b.text(i).decode() for b in parts for i in range(len(b))] == [t or "" for t in texts]
    assert len(parts) > 2


def test_arrays_of_a_scan_stay_small(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    texts = [brute.sentence(rng, 600, ["word", "of", "some", "letters", "again"]) for _ in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert batch.nbytes > 3_000_000
    table = np.zeros(1 << 16, np.float32)
    monkeypatch.setattr(textscan, "_powers", (np.ones(0, np.uint64), np.ones(0, np.uint64)))
    words = []
    tracemalloc.start()
    try:
        for block in blocks([batch], "text"):
            words += rules.counts_of(block)["n_words"].tolist()
            mean_weights(block, table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert words == [600] * len(texts)
    assert peak < 80_000_000


def test_batches_of_long_texts_stay_small(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64()), pa.array([batch.nbytes], pa.int64())], ["n", "size"])

    docs = spark.range(2500).select(F.repeat(F.lit("x"), 6000).alias("text")).coalesce(1)
    found = docs.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 2500
    assert max(r["size"] for r in found) < 5 << 20


def test_scores_are_the_mean_over_the_same_features():
    table = np.random.default_rng(0).normal(size=1 << 10).astype(np.float32)
    block = Block.of(ODD)
    expected = [float(shares @ table[found]) if len(found) else 0.0 for found, shares in document_features(block, 10)]
    assert np.allclose(mean_weights(block, table), expected, atol=1e-5)


def test_rule_counts_match_a_plain_version(documents, spark):
    rng = random.Random(1)
    texts = ODD + [brute.sentence(rng, rng.randint(1, 90), list("abcdefgh") + ["p\np", "#x", "|"]) for _ in range(60)]
    texts += ["many words in this line of text here " * 400]
    docs = documents([*enumerate(texts), (None, "no id"), (3, "a repeated id")])
    empty = spark.createDataFrame([], LABELS)
    found = rules.quality_rules(docs, empty).collect()
    assert len(found) == len(texts) + 2
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] not in (None, 3)}
    for i, text in enumerate(texts):
        if i != 3:
            counts = brute.rule_counts(text)
            assert tuple(by_id[i][c] for c in rules.COUNTS) == counts, text
            failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
            # Without labels the base rule decides alone.
            assert (by_id[i]["base_failed"], by_id[i]["kept"]) == (failed, not failed)


def labelled(documents, spark, n=300):
    rng = random.Random(2)
    good = [f"{a}{b}" for a in ("the", "on", "re", "in") for b in ("ing", "er", "tion", "ly", "")]
    rows, labels = [], []
    for i in range(n):
        junk = i % 4 == 0
        text = brute.sentence(rng, 40, good)
        rows.append((i, " ".join(w + "%%%" for w in text.split()) if junk else text))
        labels.append((i, 0 if junk else 1, 0))
    labels += [(None, 1, 0), (1, None, None), (2, 7, 0), (100_000, 0, 0)]
    return documents(rows), spark.createDataFrame(labels, LABELS)


def test_classifier_learns_without_the_held_out_fold(documents, spark):
    docs, labels = labelled(documents, spark)
    rows = quality_embed.classify_quality(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r["predicted"] == (r["doc_id"] % 4 != 0) == (r["score"] >= 0.7) for r in rows)
    # Labels of the held-out fold change nothing.
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 0).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality_embed.classify_quality(docs, flipped).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in rows)


def test_verdict_is_a_calibrated_probability(documents, spark):
    docs, labels = labelled(documents, spark)
    rows = rules.quality_rules(docs, labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in rows)
    assert all(0 < r["probability"] < 1 for r in rows)


@pytest.mark.parametrize("keep", [rules.keep_passing, quality_embed.keep_good])
def test_filters_keep_columns_and_survive_odd_input(documents, spark, keep):
    docs, labels = labelled(documents, spark)
    clashing = docs.withColumn("kept", F.lit("x")).withColumn("row", F.lit(1)).withColumn("score", F.lit(None).cast("string"))
    rest = clashing.unionByName(clashing.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")))
    found = keep(rest, labels)
    assert found.columns == clashing.columns
    assert {r["doc_id"] for r in found.collect()} - {None} == {i for i in range(300) if i % 4}
    assert keep(docs.limit(0), labels).count() == 0


def test_without_labels_every_score_is_one_half(documents, spark):
    found = quality_embed.classify_quality(documents([(1, "a b"), (2, None), (None, "")]), spark.createDataFrame([], LABELS)).collect()
    assert [r["score"] for r in found] == [0.5] * 3
    one = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert quality_embed.classify_quality(documents([(1, "a b"), (2, "")]), one).count() == 2
    assert quality_embed.classify_quality(documents([]), one).count() == 0


def test_labels_of_absent_documents_take_no_place_of_the_sample(documents, spark):
    docs, labels = labelled(documents, spark)
    wide = labels.unionByName(spark.range(1_000, 61_000).selectExpr("id as doc_id", "0 as quality", "0 as toxic"))
    found = labelled_sample(docs, wide, "quality", 100, F.lit(True)).collect()
    assert len(found) == 100 and all(r["doc_id"] < 300 and r["y"] == (r["doc_id"] % 4 != 0) for r in found)
    for keep in (rules.keep_passing, quality_embed.keep_good):
        assert {r["doc_id"] for r in keep(docs, wide).collect()} == {i for i in range(300) if i % 4}


@pytest.mark.parametrize("keep", [rules.keep_passing, quality_embed.keep_good])
def test_filters_keep_all_when_nothing_is_labelled(documents, spark, keep):
    docs, _ = labelled(documents, spark)
    for ids in ([], [(1_000, 1, 0), (1_001, 0, 0)]):
        assert keep(docs, spark.createDataFrame(ids, LABELS)).count() == 300


def test_a_repeated_id_teaches_once(documents, spark):
    docs, labels = labelled(documents, spark)
    texts = docs.where("doc_id = 1").unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(1).cast("long")))
    many = docs.where("doc_id <> 1").unionByName(texts.crossJoin(spark.range(200)).drop("id"))

    def fit(rows):
        return [np.array([len(rows)], np.float32)]

    seen = train(many, labelled_sample(many, labels, "quality", 1000, F.lit(True)), 16, fit)
    assert seen[0][0] == 300
