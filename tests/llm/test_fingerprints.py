import hashlib
import random

import brute
import numpy as np
import pytest

from dayproof.llm import prefixhash as ph
from dayproof.llm.textscan import Block


def texts_like(rng, n):
    """Texts over a small alphabet with characters of one to four bytes, so that equal spans are common."""
    return ["".join(rng.choice("ab é日😀") for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_span_equality_is_that_of_the_bytes():
    rng = random.Random(1)
    block = Block.of([*texts_like(rng, 40), "a" * 300, "ab" * 150])
    hashes, raw = ph.PrefixHashes(block), block.data.tobytes()
    spans = [sorted(rng.sample(range(len(raw) + 1), 2)) for _ in range(4000)]
    spans += [(a, a + rng.randint(1, 12)) for a in range(len(raw) - 12)]
    starts, ends = np.array(spans).T
    by_hash = {}
    for (a, b), h in zip(spans, hashes.spans(starts, ends).tolist(), strict=True):
        assert by_hash.setdefault(h, raw[a:b]) == raw[a:b]
    assert len(by_hash) == len({raw[a:b] for a, b in spans})


def test_thue_morse_strings_do_not_collide():
    bits = "a"
    while len(bits) < 1 << 13:
        bits += bits.translate(str.maketrans("ab", "ba"))
    hashes = ph.PrefixHashes(Block.of([bits, bits.translate(str.maketrans("ab", "ba"))])).documents()
    assert hashes[0] != hashes[1]


def test_common_extension_against_a_scan():
    rng = random.Random(2)
    left, right = texts_like(rng, 200), texts_like(rng, 200)
    right[:60] = [t[:rng.randint(0, len(t))] + rng.choice(["", "x", "é"]) for t in left[:60]]
    a, b = ph.PrefixHashes(Block.of(left)), ph.PrefixHashes(Block.of(right))
    here = np.arange(200)
    start_a = np.array([rng.randint(0, len(t)) for t in left])
    start_b = np.array([rng.randint(0, len(t)) for t in right])
    for i, j in ((np.zeros(200, int), np.zeros(200, int)), (start_a, start_b)):
        found = ph.common_extension(a, here, b, here, i, j)
        for k in here:
            x, y, n = left[k][i[k]:], right[k][j[k]:], 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            assert found[k] == n


def spans_of(text):
    counts = {}
    for i in range(len(text)):
        span = text[max(0, i + 1 - ph.WINDOW):i + 1]
        counts[span] = counts.get(span, 0) + 1
    return {(span, k) for span, n in counts.items() for k in range(n)}


def test_likeness_is_near_the_share_of_spans_in_common():
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(300)]
    errors = []
    for _ in range(60):
        base = brute.sentence(rng, rng.randint(30, 300), vocabulary)
        cut = rng.randint(0, len(base))
        other = base[:cut] + brute.sentence(rng, rng.randint(1, 300), vocabulary)
        a, b = spans_of(base), spans_of(other)
        exact = 2 * len(a & b) / (len(a) + len(b))
        sketch = ph.PrefixHashes(Block.of([base, other]))
        one, two = ph.fingerprints(sketch, ph.sketches(sketch))
        errors.append(abs(ph.fingerprint_likeness(one, two) - exact))
    assert max(errors) < 0.25 and sum(errors) / len(errors) < 0.05


def expected(rows):
    """(doc_id, n_chars, sha256 of the edited text, common beginnings) in order of id."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    found = []
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        quarter = len(text) // 4
        changed = text[:len(text) - quarter] + after[:quarter]
        common = [next((n for n, (x, y) in enumerate(zip(text, o, strict=False)) if x != y), min(len(text), len(o))) for o in (changed, after)]
        found.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), *common))
    return found


@pytest.mark.parametrize("tasks", [1, 7])
def test_neighbours_against_plain_python(spark, documents, tasks):
    rng = random.Random(4)
    rows = [(i * 3, brute.sentence(rng, rng.randint(1, 80), ["eins", "zwei", "drü", "日本"])) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "x" * 200_000), (203, "x" * 200_000), (204, "😀"), (None, "last of all")]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        docs = documents(rows).withColumnRenamed("source", "task").selectExpr("*", "'x' as head", "1 as tie", "2 as salt")
        found = ph.compare_neighbours(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["common_edited"], r["common_next"]) for r in found), key=key)
    assert got == expected(rows)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[202]["fingerprint"] == by_id[203]["fingerprint"] and by_id[202]["near_next"] == 1.0
    assert by_id[200]["fingerprint"] == by_id[201]["fingerprint"]
    assert by_id[200]["near_edited"] == by_id[200]["near_next"] == 1.0 and by_id[201]["near_next"] == 0.0
    for r in found:
        assert r["near_edited"] == pytest.approx(ph.fingerprint_likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) == 16 + ph.BINS
    long_ones = [r for r in found if r["n_chars"] > 100 and r["doc_id"] is not None and r["doc_id"] < 190]
    assert all(0.5 < r["near_edited"] < 0.95 for r in long_ones)


def test_repeated_ids_one_row_and_no_row(documents):
    rows = [(5, "one text here"), (5, "one text here"), (5, "another text"), (5, None)] * 3
    found = ph.compare_neighbours(documents(rows)).collect()
    assert len(found) == 12 and sum(r["near_next"] == 1.0 for r in found) >= 8
    only = ph.compare_neighbours(documents([(1, "abcdefgh")])).collect()
    assert only[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and only[0]["near_next"] == 1.0
    assert ph.compare_neighbours(documents([])).count() == 0
