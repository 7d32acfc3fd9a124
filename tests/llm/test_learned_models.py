"""The quality classifier and the language identifier against plain Python."""

import collections
import math
import random
import zlib

import brute
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from dayproof.llm import langid, ngrams
from dayproof.llm import quality_embed as qe
from dayproof.llm.textscan import Block, windows

LABELS = "doc_id long, quality int, toxic int"


def word_hash(word):
    return Block.of([word]).word_hashes()[0][:1]


def grams_of(text, bits):
    """Bucket of every n-gram of one text, gram by gram."""
    text, found = text or "", []
    words = brute.words(text)
    for word in words:
        found.append(int(word_hash(word)[0] >> np.uint64(64 - bits)))
    for a, b in zip(words, words[1:], strict=False):
        pair = ngrams.REPEAT if a == b else windows(np.concatenate([word_hash(a), word_hash(b)]), 2)[0]
        found.append(int(pair >> np.uint64(64 - bits)))
    for size in ngrams.CHAR_RUNS:
        for k in range(len(text) - size + 1):
            block = Block.of([text[k:k + size]])
            found.append(int(block.span_hashes(block.bounds[:1], block.bounds[1:])[0] >> np.uint64(64 - bits)))
    return found


def plain_fit(rows, bits, dim, epochs, rate):
    """The classifier's descent, one number at a time."""
    rng = np.random.default_rng(1)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).tolist()
    layer = rng.uniform(-1, 1, (dim, 2)).tolist()
    share = (sum(y for y, _, _ in rows) + 1) / (len(rows) + 2)
    bias, steps, total = [math.log(1 - share), math.log(share)], 0, epochs * len(rows)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, buckets, shares = rows[k]
            step = rate * (1 - steps / total)
            steps += 1
            hidden = [sum(float(s) * vectors[b][d] for b, s in zip(buckets, shares, strict=True)) for d in range(dim)]
            logits = [sum(hidden[d] * layer[d][c] for d in range(dim)) + bias[c] for c in (0, 1)]
            top = max(logits)
            powers = [math.exp(x - top) for x in logits]
            error = [p / sum(powers) - (c == y) for c, p in enumerate(powers)]
            back = [sum(layer[d][c] * error[c] for c in (0, 1)) for d in range(dim)]
            for d in range(dim):
                for c in (0, 1):
                    layer[d][c] -= step * hidden[d] * error[c]
            for c in (0, 1):
                bias[c] -= 0.05 * step * error[c]
            for b, s in zip(buckets, shares, strict=True):
                for d in range(dim):
                    vectors[b][d] -= step * 20 * float(s) * back[d]
    return vectors, layer, bias


def labelled(rng, n):
    good, bad = ["clear", "careful", "reasoned", "précis"], ["spam", "click", "win!!", "$$$"]
    return [(i, brute.sentence(rng, rng.randint(1, 12), good if i % 2 else bad) if i % 17 else None) for i in range(n)]


def test_fit_is_the_plain_descent():
    rng = random.Random(4)
    rows = []
    for i, text in labelled(rng, 24):
        counts = collections.Counter(grams_of(text, 6))
        found = sorted(counts)
        rows.append((i % 2, np.array(found, np.int32), np.array([counts[b] / max(1, sum(counts.values())) for b in found], np.float32)))
    own = qe.fit_embeddings(rows, bits=6, dim=3, epochs=3, rate=1.0)
    for mine, plain in zip(own, plain_fit(rows, 6, 3, 3, 1.0), strict=True):
        assert np.allclose(mine, np.array(plain).ravel(), atol=1e-8)


def test_scores_are_those_of_the_mean_vector(spark, documents):
    rng = random.Random(5)
    rows = [*labelled(rng, 60), (100, ""), (101, "x"), (102, "word " * 30_000), (None, "spam click")]
    docs = documents(rows).withColumnRenamed("source", "_score_of").withColumn("words", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], LABELS)
    vectors = ngrams.train(
        docs, ngrams.labelled_sample(docs, labels, "quality", qe.SAMPLE_ROWS, qe.fold("doc_id", 4) != 2), qe.BITS, qe.fit_embeddings
    )
    table, layer, bias = vectors[0].reshape(-1, qe.DIM).astype(float), vectors[1].reshape(qe.DIM, 2).astype(float), vectors[2].astype(float)
    found = {r["doc_id"]: r for r in qe.classify_quality(docs, labels).collect()}
    for doc, text in rows:
        if doc == 102:
            continue
        grams = grams_of(text, qe.BITS)
        mean = np.mean([table[g] for g in grams], axis=0) if grams else np.zeros(qe.DIM)
        logits = mean @ layer + bias
        score = 1 / (1 + math.exp(logits[0] - logits[1]))
        assert found[doc]["score"] == pytest.approx(score, abs=1e-4), (doc, text)
        assert found[doc]["predicted"] == int(found[doc]["score"] >= 0.7)
        assert found[doc]["held_out"] == (doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2)
    assert 0 <= found[102]["score"] <= 1


def test_language_by_sizes_under_brute_dictionaries(spark, documents):
    rng = random.Random(6)
    words = {"en": ["the", "and", "thing", "of", "water"], "de": ["der", "und", "nicht", "über", "wasser"], "fr": ["le", "et", "école", "avec", "eau"]}
    rows = [(i, brute.sentence(rng, rng.randint(1, 40), words[lang]), lang) for i, lang in enumerate(["en", "de", "fr", "en", "de"] * 60)]
    rows += [(400, None, "en"), (401, "12 34", "de"), (402, "eau " * 50_000, None), (403, "Éa", "fr"), (None, "water of the", "en")]
    docs = documents(rows).selectExpr("*", "1 as score", "2 as texts")
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit("lang")).alias("h")).collect()}
    slots, learnt = collections.defaultdict(dict), collections.Counter()
    for doc, text, lang in rows:
        if doc is not None and lang is not None and text and zlib.crc32(str(doc).encode()) % 5 != 0:
            learnt[lang] += 1
            slot = hashes[doc] % langid.SLOTS
            slots[lang][slot] = min(slots[lang].get(slot, (hashes[doc], doc, text)), (hashes[doc], doc, text))
    compressors = {}
    for lang, chosen in slots.items():
        counts = collections.Counter()
        for _, _, text in chosen.values():
            lowered = "".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in text)
            counts.update(set(lowered.split(" ")) - {""})
        ranked = sorted(counts, key=lambda w: (-counts[w], w.encode()))
        raw = zstandard.ZstdCompressionDict(" ".join(reversed(ranked)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressors[lang] = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)
    order = sorted(compressors, key=lambda lang: (-learnt[lang], lang))
    found = {(r["doc_id"]): r for r in langid.language_of(docs).collect()}
    assert len(found) == len(rows)
    same = 0
    for doc, text, _ in rows:
        row = found[doc]
        if not any(map(str.isalpha, text or "")):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        plain = " ".join("".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in text).split(" "))
        plain = " ".join(w for w in plain.split(" ") if w).encode()
        sizes = [len(compressors[lang].compress(plain)) for lang in order]
        # The operator prepares its dictionaries for the level at once, which may cost or spare a byte.
        near = [lang for lang, size in zip(order, sizes, strict=True) if size <= min(sizes) + 1]
        assert row["lang_pred"] in near, (doc, sizes)
        same += row["lang_pred"] == order[sizes.index(min(sizes))]
        assert 1 / len(order) <= row["score"] <= 1
    assert same >= 0.98 * (len(rows) - 2)
