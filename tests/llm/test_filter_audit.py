import collections
import itertools
import random
import re

import brute
import numpy as np

from dayproof.llm import filter_audit as fa
from dayproof.llm.textscan import Block

LABELS = "doc_id long, quality int, toxic int"


def failures(text):
    text = text or ""
    words = brute.words(text)
    return [
        len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)),
    ]


def audit(rows, labels):
    """Every order run filter by filter over the documents, as (part, order, step) -> counts."""
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    docs = [(d, p or "", dict(zip("ABCDE", [*failures(t), d is not None and d > least[t or ""]], strict=True))) for d, t, p in rows]
    found = {}
    for part in {p for _, p, _ in docs}:
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            alive = [d for d in docs if d[1] == part]
            for step, f in enumerate(order, 1):
                out = [d for d in alive if d[2][f]]
                failing = sum(d[2][f] for d in docs if d[1] == part)
                alone = sum(d[2][f] and sum(d[2].values()) == 1 for d in docs if d[1] == part)
                alive = [d for d in alive if not d[2][f]]
                shapley[f] += len(out)
                lost = [sum(d[0] is not None and d[0] in s for d in out) for s in (good, toxic)]
                found[part, "".join(order), step] = [len(alive), len(out), failing - len(out), alone, *lost]
        for (p, order, step), counts in found.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return found


def made(seed):
    rng = random.Random(seed)
    many = [f"w{i}" for i in range(2000)]
    texts = [None, "", "short", "ALL CAPS HERE", "price $5", brute.sentence(rng, 150, many), brute.sentence(rng, 150, ["few", "words"]), "Ünï日本 " * 120,
             brute.sentence(rng, 120, [w.upper() for w in many]), brute.sentence(rng, 130, many) + " #tag", " \t\n ", "word" * 40_000]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(80)] + [(None, "", "en"), (None, "short", None), (3, "short", "en"), (3, "short", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(60)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (999, 1, 1)]
    return rows, labels


def test_audit_against_running_every_order(spark, documents):
    rows, labels = made(6)
    docs = documents(rows).selectExpr("*", "1 as part", "2 as bits", "3 as digest", "4 as good")
    found = fa.filter_audit(docs, spark.createDataFrame(labels, LABELS).selectExpr("*", "'x' as n", "'y' as part")).collect()
    own = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in found}
    assert own == audit(rows, labels) and len(found) == 600 * 3


def test_no_documents_and_no_labels(spark, documents):
    none = spark.createDataFrame([], LABELS)
    assert fa.filter_audit(documents([]), none).count() == 0
    rows = [(1, "a b"), (2, "a b")]
    own = {(r["part"], r["filter_order"], r["step"]): r["removed"] for r in fa.filter_audit(documents(rows), none).collect()}
    assert own == {k: v[1] for k, v in audit([(d, t, None) for d, t in rows], []).items()}


def test_transducer_counts_what_patterns_count():
    rng = random.Random(7)
    texts = ["".join(rng.choice("aBZ \t\n\x0b\x1cé日😀#$|_") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "", "x", " ", "x"]
    block = Block.of(texts)
    starts, ends, classes, bounds = fa.transduce(block)
    doc = np.searchsorted(bounds, starts, "right") - 1
    raw = block.data.tobytes()
    words = collections.defaultdict(list)
    for d, a, b in zip(doc.tolist(), starts.tolist(), ends.tolist(), strict=True):
        words[d].append(raw[a:b].decode())
    assert [words[i] for i in range(len(texts))] == [brute.words(t) for t in texts]
    assert fa.distinct_words(block, starts, ends, doc).tolist() == [len(set(brute.words(t))) for t in texts]
    assert [[bool(b >> k & 1) for k in range(4)] for b in fa.block_failures(block)] == [failures(t) for t in texts]


def test_words_of_one_hash_are_told_apart():
    texts = ["a b a c", "a a", "d e f d"]
    block = Block.of(texts)
    starts, ends, _, bounds = fa.transduce(block)
    doc = np.searchsorted(bounds, starts, "right") - 1
    same = np.full(len(starts), 42, np.uint64)
    assert fa.distinct_words(block, starts, ends, doc, same).tolist() == [3, 1, 3]
