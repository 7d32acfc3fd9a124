import hashlib
import math
import random
import re
import zlib

import brute
import pytest

from dayproof.llm import resample as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, runs):
    words = WORD.findall((text or "").translate(brute.LOWER))
    return words, [" ".join(words[i:i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def drawn(rows, target, buckets=10_000, runs=1, percent=10, min_words=20, seed=2024):
    """(doc_id, n_features, weight, score, rank) of each row, by the definition."""
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f in features(text, runs)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    found = []
    for doc, text in rows:
        words, own = features(text, runs)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        found.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in found if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, row in enumerate(able[:percent * len(able) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, (r[:5] for r in found)), key=str)


def collected(frame):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in frame.collect()), key=str)


def corpus(rng, n):
    common, wanted = [f"w{i}" for i in range(200)], [f"Ziel{i}" for i in range(30)]
    rows = [(i, brute.sentence(rng, rng.randint(0, 60), common + wanted * (i % 3))) for i in range(n)]
    return rows, [brute.sentence(rng, 30, wanted) for _ in range(10)]


@pytest.mark.parametrize(("buckets", "runs", "percent"), [(10_000, 1, 10), (50, 2, 37), (10_000, 1, 100), (10_000, 1, 0)])
def test_against_the_definition(spark, documents, buckets, runs, percent):
    rng = random.Random(8)
    rows, target = corpus(rng, 300)
    rows += [(1000, None), (1001, ""), (1002, "-- !! __"), (1003, "x" * 300_000), (1004, "ÄÖ 日本 a1 b-c"), (None, rows[7][1]), (None, rows[7][1]), (5, rows[5][1]), (5, rows[9][1])]
    docs = documents(rows).selectExpr("*", "1 as score", "2 as weight", "3 as words", "4 as rank")
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate([*target, None])], "item_id long, text string")
    found = rs.resample(docs, wanted, buckets, runs, percent)
    assert collected(found) == drawn(rows, [*target, None], buckets, runs, percent)


def test_many_rows_tied_at_the_cutoff(spark, documents):
    text = brute.sentence(random.Random(9), 25, ["a", "b", "c"])
    rows = [(7, text)] * 150 + [(8, text)] * 50 + [(None, text)] * 40
    target = spark.createDataFrame([(0, "a b")], "item_id long, text string")
    for percent in (3, 50, 80, 95):
        found = collected(rs.resample(documents(rows), target, percent=percent))
        assert found == drawn(rows, ["a b"], percent=percent)


def test_nothing_to_draw(spark, documents):
    target = spark.createDataFrame([], "item_id long, text string")
    assert rs.resample(documents([]), target).count() == 0
    rows = [(i, "only a few words") for i in range(30)]
    assert collected(rs.resample(documents(rows), target)) == drawn(rows, [])


def test_nth_value_by_counts(spark):
    rng = random.Random(10)
    values = [rng.randint(-5000, 5000) for _ in range(500)] + [77] * 100
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    for n in (1, 2, 250, 599, 600):
        assert rs.nth_value(frame, "v", n) == sorted(values)[n - 1]
        assert rs.nth_value(frame, "v", n, descending=True) == sorted(values, reverse=True)[n - 1]
