import random

import brute
import numpy as np
from pyspark.sql import functions as F

from dayproof.llm import exact, neardup
from dayproof.llm.textscan import Block
from dayproof.sources.scratch import Scratch


def norm(text):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def groups(rows):
    best, size = {}, {}
    for i, t in rows:
        key = norm(t)
        size[key] = size.get(key, 0) + 1
        known = best.get(key)
        best[key] = i if key not in best or known is None else known if i is None else min(known, i)
    return {(i, best[norm(t)], size[norm(t)]) for i, t in rows}


def copies():
    rng = random.Random(3)
    texts = [brute.sentence(rng, rng.randint(0, 30), ["a", "b\n", "\tc", "é"]) for _ in range(40)] + ["", None, " ", "x" * 30_000]
    rows = [(i, rng.choice(texts)) for i in range(200)] + [(1000 + i, "hot  text" if i % 2 else "hot\ttext") for i in range(90)]
    rows += [(None, "only here"), (None, "hot text"), (5000, "twice"), (5000, "twice")]
    rng.shuffle(rows)
    return rows


def test_exact_groups_with_hot_texts(documents, monkeypatch):
    for hot in (10, 10_000):
        monkeypatch.setattr(exact, "HOT_ROWS", hot)
        monkeypatch.setattr(exact, "PIECE_ROWS", 7)
        rows = copies()
        found = exact.exact_groups(documents(rows)).collect()
        assert len(found) == len(rows)
        assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in found} == groups(rows)
        kept = [r for r in found if r["kept"]]
        assert len(kept) == len({norm(t) for _, t in rows}) == len({r["text_sha256"] for r in kept})
        assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_an_id_that_very_many_rows_repeat(spark, documents, monkeypatch):
    monkeypatch.setattr(exact, "HOT_ROWS", 10)
    monkeypatch.setattr(exact, "PIECE_ROWS", 7)
    rows = [(7, "same")] * 60 + [(None, "same")] * 30 + [(8, "sa me")] * 5 + [(None, "only  null")] * 25 + [(None, "only null")] * 20
    docs = documents(rows)
    found = exact.exact_groups(docs).collect()
    assert len(found) == len(rows) and {(r["doc_id"], r["keep_id"], r["group_size"]) for r in found} == groups(rows)
    assert sorted(str(r["keep_id"]) for r in found if r["kept"]) == ["7", "8", "None"]
    assert exact.drop_copies(docs).count() == 3
    _, hot = exact._split(docs, Scratch(spark, "t"))
    sizes = [r["count"] for r in hot.groupBy("content", "salt").count().collect()]
    assert max(sizes) <= 14 and len(sizes) > 15


def test_exact_dedup_keeps_columns(documents, monkeypatch):
    monkeypatch.setattr(exact, "HOT_ROWS", 10)
    rows = copies()
    docs = documents(rows).withColumn("norm", F.lit(1)).withColumn("digest", F.lit("d")).withColumn("row", F.lit(2))
    found = exact.drop_copies(docs)
    assert found.columns == docs.columns
    assert sorted(norm(r["text"]) for r in found.collect()) == sorted({norm(t) for _, t in rows})
    assert exact.drop_copies(docs.limit(0)).count() == 0 and exact.exact_groups(docs.limit(0)).count() == 0


def test_exact_dedup_shuffles_a_text_once_and_stays_native(documents):
    plan = exact.drop_copies(documents(copies()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    cold = plan.split("== Physical Plan ==")[1].split("BroadcastExchange")[0]
    assert cold.count("rangepartitioning") == 1 and "hashpartitioning(lead" not in plan


def test_keys_meet_the_pigeonhole_guarantee():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << neardup.BITS, (200, neardup.VALUES)).astype(np.uint64)
    changed = values.copy()
    for row in changed:
        row[rng.permutation(neardup.VALUES)[: 2 * neardup.CHUNKS - 1]] ^= np.uint64(1)
    a, b = neardup.chunk_keys(values), neardup.chunk_keys(changed)
    assert all((x == y).any() for x, y in zip(a, b, strict=True))
    assert not (a[:-1] == a[1:]).any()


def test_shingle_sets_and_signatures():
    texts = ["A b c d e F", "a B c d e f g", "x y", "", None, "a b c d e f"]
    sets = neardup.shingle_sets(Block.of(texts))
    assert [len(s) for s in sets] == [len(brute.shingles(t)) for t in texts]
    assert (sets[0] == sets[5]).all() and len(np.intersect1d(sets[0], sets[1])) == 2
    big = np.arange(1, 10_000, dtype=np.uint64)
    assert (neardup.signature(big) == neardup.signature(big, 77)).all()


def test_near_components_match_a_plain_version(documents):
    rows = brute.near_copies()
    found = {r["doc_id"]: r for r in neardup.near_duplicates(documents(rows)).collect()}
    expected = brute.near_components(rows)
    assert {i: r["component_id"] for i, r in found.items()} == expected
    assert all(r["n_shingles"] == len(brute.shingles(t)) for i, t in rows for r in [found[i]])
    assert all(r["kept"] == (i == expected[i]) for i, r in found.items())


def test_near_components_of_a_large_group_and_a_shared_passage(documents):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = brute.sentence(rng, 100, vocabulary).split()
    rows = []
    for i in range(80):  # near copies of one text, some beyond the threshold from it
        text = list(base)
        for _ in range(i % 9):
            text[rng.randrange(100)] = rng.choice(vocabulary)
        rows.append((i, " ".join(text)))
    passage = brute.sentence(rng, 60, vocabulary)
    rows += [(100 + i, f"{brute.sentence(rng, 30, vocabulary)} {passage} {brute.sentence(rng, 30, vocabulary)}") for i in range(40)]
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents(rows)).collect()}
    assert found == brute.near_components(rows)


def test_near_duplicates_of_odd_rows(documents):
    text = "a b c d e f g h"
    rows = [(5, text), (3, text), (None, text), (9, "q r s t u v"), (9, text.upper()), (4, "q r s t u v"), (7, None), (8, "")]
    found = neardup.near_duplicates(documents(rows)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(5, 3), (3, 3), (None, None), (9, 3), (4, 3), (7, 7), (8, 8)}
    assert len(found) == len(rows)
    docs = documents([*rows, (3, text)]).withColumn("kept", F.lit(True)).withColumn("n", F.lit(1))
    kept = neardup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 7, 8]
    assert neardup.near_duplicates(documents([])).count() == 0 and neardup.drop_near_copies(documents([])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 90), (90, 95)], "a long, b long")
    found = {r["node"]: r["root"] for r in neardup.components(edges, Scratch(spark, "chain")).collect()}
    assert found == {**{i: 0 for i in range(31)}, 100: 90, 95: 90, 90: 90}
