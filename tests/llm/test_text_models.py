import collections
import itertools
import math
import random
import time
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dayproof.llm import langid, lm, packing, pieces
from dayproof.llm.textscan import Block
from dayproof.sources.scratch import Scratch

ODD = [
    "", None, " ", "It's   don't!!! we'LL 'S", "ÉTÉ çà, naïvé Straße ΣΑΣ", "a1b22c", "<|endoftext|> x<|startoftext|>y", "x's,y'd", "́abc",
    "日本語 text", "tab\tand\nline", "mixed—dash,é,", "İstanbul", "a" * 5000, "▁ sign", "#$%abc***", "e.g. foo.bar@x.org",
]


def test_token_ids_are_the_tokenizers_own(documents):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab C,.'é1<|>\ń") for _ in range(30)) for _ in range(200)] + [brute.sentence(rng, 9000, ["the", "Thing,", "été."])]
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    encoder = packing.UnitEncoder(path)
    for _ in range(2):  # the second time from what is remembered
        ids, first = encoder.block_ids(Block.of(texts))
        for i, text in enumerate(texts):
            assert ids[first[i]:first[i + 1]].tolist() == [*own.encode(text or "", add_special_tokens=False).ids, 2], text
    docs = documents([*enumerate(texts), (None, "no id"), (1, "again")])
    placed = packing.packed_documents(docs).collect()
    by_doc = collections.defaultdict(list)
    for r in placed:
        by_doc[r["doc_id"]].append(r)
    for i, text in enumerate(texts):
        if i == 1:
            continue
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        assert [r["start"] for r in parts] == list(itertools.accumulate([0, *[r["length"] for r in parts]]))[:-1]
        assert sum(r["length"] for r in parts) == len(ids) == parts[0]["doc_tokens"]
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes())
    assert len(by_doc[None]) == 1 and len(by_doc[1]) == 2
    check_sequences(placed)
    # The sequences themselves.
    unique = docs.where("doc_id > 1")
    layout = packing.pack(Scratch(docs.sparkSession, "t").save(packing.token_pieces(unique).drop("ids"), "p"))
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(unique, layout).collect()}
    for r in layout.collect():
        ids = [*own.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2][r["start"]:r["start"] + r["length"]]
        assert whole[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == ids
    assert packing.packed_documents(documents([])).count() == 0


def test_case_stays_where_the_tokenizer_looks_at_it():
    texts = [
        "<|ENDOFTEXT|>", "<|EndOfText|> x", "Ab<|StartOfText|>Cd<|endoftext|>EF", "x<|endoftexT|><|startoftext|>", "A <| B |> C", "<|", "END<", "|X|>",
        "J\u030cA T\u0308 H\u0331x W\u030aY\u030a T\u0344", "ABC <|ENDOFTEXT|>\u3000Def\xa0É", "\u0130stanbul",
    ]
    path = public_tokenizers.path("word_bpe_49k.json")
    own, encoder = Tokenizer.from_file(path), packing.UnitEncoder(path)
    for some in (texts, [t.lower() for t in texts], texts):  # both spellings from what is remembered
        ids, first = encoder.block_ids(Block.of(some))
        for i, text in enumerate(some):
            assert ids[first[i]:first[i + 1]].tolist() == [*own.encode(text, add_special_tokens=False).ids, 2], text


def check_sequences(placed, capacity=4096):
    by_sequence = collections.defaultdict(list)
    for r in placed:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity


@pytest.mark.parametrize("histogram", [
    {10: 100_000}, {5: 50_000, 300: 2_000}, {200: 10_000, 1500: 500, 4096: 100}, {3000: 1_000}, {3000: 700, 2999: 4, 17: 1},
])
def test_runs_fill_the_sequences(histogram):
    used, ranks = collections.defaultdict(list), collections.defaultdict(list)
    for length, rank, count, first, offset, span in packing.fill_gaps(histogram):
        ranks[length].append((rank, count))
        for i in range(count):
            lo, hi = i * length, (i + 1) * length
            for cell in range(lo // span, (hi - 1) // span + 1):
                a, b = max(lo, cell * span), min(hi, (cell + 1) * span)
                used[first + cell].append((offset + a - cell * span, b - a))
    for length, n in histogram.items():
        ends = list(itertools.accumulate([0, *[c for _, c in sorted(ranks[length])]]))
        assert [r for r, _ in sorted(ranks[length])] == ends[:-1] and ends[-1] == n
    for parts in used.values():
        ends = list(itertools.accumulate([0, *[n for _, n in sorted(parts)]]))
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    assert sorted(used) == list(range(len(used)))
    assert sum(n * c for n, c in histogram.items()) >= 0.99 * 4096 * (len(used) - 1)


def test_short_texts_are_packed_densely_and_cut_pieces_keep_their_ids(documents):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["one", "two", "tree", "house"]) for _ in range(rng.choice([60, 60, 60, 2]))) for _ in range(300)]
    rows = [*enumerate(texts), (None, texts[0]), (0, texts[0]), (0, "other"), (301, None)]
    placed = packing.packed_documents(documents(rows), capacity=100).collect()
    check_sequences(placed, 100)
    tokens = sum(r["length"] for r in placed)
    assert tokens >= 0.95 * 100 * len({r["sequence_id"] for r in placed})
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = collections.Counter()
    for i, text in rows:
        expected[i, (*own.encode(text or "", add_special_tokens=False).ids, 2)] += 1
    pieces_of = collections.defaultdict(list)
    for r in placed:
        pieces_of[r["doc_id"], r["doc_tokens"]].append(r)
    assert sum(r["length"] < min(100, r["doc_tokens"]) for r in placed) > 0  # some pieces are cut
    for (i, ids), n in expected.items():
        spans = [r for r in pieces_of[i, len(ids)] if zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
        assert sum(r["length"] for r in spans) >= n * len(ids)


def test_placements_cover_each_rank_once():
    rng = random.Random(4)
    histogram = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(60)} | {1: 100_000, 100: 3}
    used, ranks = collections.defaultdict(list), collections.Counter()
    for length, rank, count, first, offset in packing.place_lengths(histogram, 100):
        assert rank == ranks[length]
        ranks[length] += count
        for s in range(first, first + count):
            used[s].append((offset, length))
    assert ranks == histogram
    for parts in used.values():
        ends = list(itertools.accumulate([0, *[n for _, n in sorted(parts)]]))
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 100
    total = sum(n * c for n, c in histogram.items())
    assert len(used) <= total / 100 + 2


def test_pieces_nbest_match_all_segmentations():
    model = pieces.model_at(None)
    rng = random.Random(3)
    alphabet = ["a", "b", "the ", "  ", "\n", "é", "▁", "ing", "\t", "日", "x"]
    texts = ["", "a", "hello you"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(120)]

    def every(text):
        text, found = " " + text if text else text, []

        def walk(end, score, ids):
            if not end:
                found.append((score, ids))
                return
            for start, own, s in model.edges(text, end):
                walk(start, score + s, own + ids)

        walk(len(text), 0.0, [])
        return sorted(found, key=lambda f: -f[0])

    for n in (1, 4):
        for text, own in zip(texts, model.encode_block(Block.of(texts), n), strict=True):
            expected = every(text)[:n]
            assert np.allclose([s for s, _ in own], [s for s, _ in expected]), text
            assert len({tuple(ids.tolist()) for _, ids in own}) == len(own)
            scores = {tuple(i): s for s, i in every(text)}
            assert all(math.isclose(scores[tuple(ids.tolist())], s) for s, ids in own)
            assert all(model.decode(ids) == text for _, ids in own)
            assert np.allclose([s for s, _ in model.nbest(" " + text if text else "", n)], [s for s, _ in expected])


def test_pieces_of_documents_decode(documents):
    rows = [*enumerate(ODD), (None, "no id"), (0, "again")]
    docs = documents(rows)
    found = pieces.nbest_digests(docs).collect()
    assert len(found) == len(rows) and all(r["round_trip"] for r in found)
    assert all(1 <= len(r["scores"]) <= 3 and r["scores"] == sorted(r["scores"], reverse=True) for r in found)
    best = pieces.encode_nbest(docs).selectExpr("doc_id", "nbest[0].ids as ids")
    texts = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in pieces.decode_ids(best).collect())
    assert texts == sorted((i if i is not None else -1, t or "") for i, t in rows)
    assert pieces.nbest_digests(documents([])).count() == 0


def test_language_by_compression(documents):
    rng = random.Random(8)
    words = {"en": ["the", "and", "thing", "of", "water", "under"], "de": ["der", "und", "nicht", "über", "wasser", "schön"], "fr": ["le", "et", "école", "avec", "eau", "sous"]}
    rows = [(i, brute.sentence(rng, 30, words[lang]).capitalize() + ", 12!", lang) for i, lang in enumerate(["en", "de", "fr", "en"] * 40)]
    odd = [(1000, None, "en"), (1001, "123 ... €", "de"), (1002, "", None), (None, "the water under the thing and of the water", "fr"), (1003, "é", None)]
    found = langid.language_of(documents([*rows, *odd])).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[i]["lang_pred"] == lang for i, _, lang in rows)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in by_id.items() if i is not None)
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[None]["lang_pred"] == "en"
    assert by_id[1003]["lang_pred"] in words and by_id[1003]["rejected"] and by_id[1003]["lang_or_und"] == "und"
    assert all(0 <= r["score"] <= 1 for r in found)
    # Labels of the held-out fold teach nothing.
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.language_of(documents(wrong)).collect()} == {
        (i, by_id[i]["lang_pred"], by_id[i]["score"]) for i, _, _ in rows
    }
    assert {r["lang_pred"] for r in langid.language_of(documents([(1, "abc", None)])).collect()} == {"und"}
    assert langid.language_of(documents([])).count() == 0


def test_a_repeated_id_is_one_text_of_its_language(documents, monkeypatch):
    monkeypatch.setattr(langid, "make_dictionary", lambda texts: " ".join(map(bytes.decode, texts)).encode())
    rows = [(1, f"text number {i}", "en") for i in range(300)] + [(2, "noch ein text", "de"), (3, "und einer", "de")]
    found = langid.train_dictionaries(documents(rows))
    assert len(found["en"].split()) == 3 and len(found["de"].split()) == 5


@pytest.fixture
def corpus():
    rng = random.Random(6)
    vocabulary = [f"k{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 40)))) for i in range(150)]
    return [*rows, (200, None), (201, ""), (202, "K1 k1\tK1"), (203, "never seen words"), (None, "k1 k2"), (5, "k3 repeated id")]


def test_language_model_matches_a_plain_version(documents, spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "DELETED_SHARE", 4)
    monkeypatch.setattr(lm, "BLOCK_TEXT", 2000)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)
    docs = documents(corpus)
    found = lm.score_documents(docs).collect()
    assert len(found) == len(corpus)
    parts = {(r["doc_id"], r["text"]): r["deleted"] for r in docs.selectExpr("doc_id", "text", "pmod(xxhash64(coalesce(text, ''), 'deleted'), 4) = 0 as deleted").collect()}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in corpus}
    tokens = [(i, [*brute.words((t or "").translate(brute.LOWER)), None], held[i], parts[i, t]) for i, t in corpus]

    def count(texts):
        single, pair = collections.Counter(), collections.Counter()
        for own in texts:
            single.update(own)
            pair.update(itertools.pairwise(["", *own]))
        return single, pair, len(texts)

    def terms(own, model):
        single, pair, docs_ = model
        total, types = sum(single.values()), len(single)
        for v, w in itertools.pairwise(["", *own]):
            c = docs_ if v == "" else single[v]
            yield (int(math.log2(c)) + 1 if c else 0), (1 / (types + 1), single[w] / total, pair[v, w] / c if c else 0.0)

    full = count([own for _, own, h, _ in tokens if not h])
    main = count([own for _, own, h, d in tokens if not h and not d])
    events = [e for _, own, h, d in tokens if not h and d for e in terms(own, main)]
    weights = {b: ((0.5, 0.5, 0.0) if b == 0 else (1 / 3,) * 3) for b, _ in events}
    for _ in range(lm.MAX_STEPS):
        sums, n = {b: [1.0, 0.0, 0.0] for b in weights}, collections.Counter()
        for b, p in events:
            mixed = [x * y for x, y in zip(weights[b], p, strict=True)]
            n[b] += 1
            for k in range(3):
                sums[b][k] += mixed[k] / sum(mixed)
        new = {b: tuple(s / (n[b] + 1) for s in sums[b]) for b in weights}
        moved = max(abs(x - y) for b in new for x, y in zip(new[b], weights[b], strict=True))
        weights = new
        if moved < lm.TOLERANCE:
            break
    table = lm.weight_table(weights)
    total, types = sum(full[0].values()), len(full[0])
    expected = []
    for i, own, h, _ in tokens:
        score = sum(math.log10(sum(x * y for x, y in zip(table[b], p, strict=True))) for b, p in terms(own, full))
        base = sum(math.log10((full[0][w] + 1) / (total + types + 1)) for w in own)
        expected.append((i if i is not None else -1, h, len(own), sum(full[0][w] > 0 for w in own), total, round(base, 6), round(score, 3)))
    key = [(r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 3)) for r in found]
    assert sorted(key) == sorted(expected)


def test_language_model_of_nothing(documents):
    assert lm.score_documents(documents([])).count() == 0
    rows = lm.score_documents(documents([(1, None), (2, "a")])).collect()
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)


def test_one_very_long_word_of_random_letters_is_searched_in_seconds():
    rng = random.Random(31)
    model = pieces.model_at(None)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    start = time.monotonic()
    found = model.nbest(" " + word, 3)
    assert time.monotonic() - start < 30 and len(found) == 3
    assert found[0][0] >= found[1][0] >= found[2][0]
    assert all(model.decode(ids) == word for _, ids in found)
