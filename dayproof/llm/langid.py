"""Operator 6: language identification by compression.

Texts are reduced to words of letters: A-Z in lower case, other ASCII characters as one
space. For each language a raw-content zstandard dictionary is made from a bounded sample
of its texts (the one with the smallest hash in each of SLOTS slots): its words, those of
most texts last and so nearest, up to DICTIONARY_BYTES. A text is compressed, whole, with
every dictionary; the smallest output names the language. If the runner-up is not larger by
MARGIN_BYTES and MARGIN_SHARE of the smallest, the decision is marked ``rejected``
(``lang_or_und`` is then ``und``).

Defined cases: a null text and one without any letter are ``und`` with score 0; a null
language teaches nothing; equal sizes go to the language with most
learnt texts; without
any language to learn, all is ``und``; repeated rows are judged once each; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayproof.llm.common import fold
from dayproof.llm.ngrams import one_text
from dayproof.llm.textscan import blocks

SLOTS = 192
DICTIONARY_BYTES = 32 << 10
LEVEL = 6
MARGIN_BYTES = 2
MARGIN_SHARE = 0.005
FOLDS, HELD_OUT = 5, 0

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters_only(text: bytes) -> bytes:
    return b" ".join(text.translate(_LETTERS).split())


def make_dictionary(texts: list[bytes], limit: int = DICTIONARY_BYTES) -> bytes:
    """The words of most texts, up to ``limit`` bytes, the commonest at the end."""
    counts: Counter[bytes] = Counter()
    for text in texts:
        counts.update(set(letters_only(text).split()))
    chosen, size = [], 0
    for word, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0])):
        size += len(word) + 1
        if size > limit:
            break
        chosen.append(word)
    return b" ".join(reversed(chosen))


def train_dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary of each language, the one with most learnt texts first; rows of the
    held-out fold teach nothing."""
    order = F.xxhash64("doc_id", F.lit("lang"))
    learnt = docs.where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & (F.col("text") != "") & F.col("doc_id").isNotNull())
    chosen = (
        learnt.select("lang", "doc_id", F.pmod(order, F.lit(SLOTS)).alias("slot"), order.alias("hash"))
        .groupBy("lang", "slot").agg(F.min_by("doc_id", F.struct("hash", "doc_id")).alias("doc_id"), F.count(F.lit(1)).alias("texts"))
        .groupBy("doc_id", "lang").agg(F.sum("texts").alias("texts"))
    )

    def build(table: pa.Table) -> pa.Table:
        texts = [t.encode() for t in sorted(set(table["text"].to_pylist()))]
        return pa.table({"lang": [table["lang"][0].as_py()], "texts": [sum(table["texts"].to_pylist())], "dictionary": pa.array([make_dictionary(texts)], pa.binary())})

    # At most SLOTS texts for each language: a bounded broadcast of ids, and a bounded group.
    sampled = one_text(learnt.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]), ["doc_id", "lang", "texts"])
    rows = sampled.groupBy("lang").applyInArrow(build, "lang string, texts long, dictionary binary").collect()
    return {r["lang"]: bytes(r["dictionary"]) for r in sorted(rows, key=lambda r: (-r["texts"], r["lang"])) if r["dictionary"]}


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, rejected, lang_or_und of every row of ``docs`` (doc_id, text)."""
    languages = list(dictionaries)

    def judge(batches):
        compressors = []
        for lang in languages:
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            compressors.append(zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_dict_id=False))
        for block in blocks(batches, "text"):
            lower = block.data | 0x20
            ascii_letters = np.zeros(len(block.data) + 1, np.int64)
            np.cumsum((lower >= 97) & (lower <= 122), out=ascii_letters[1:])
            lettered = np.diff(ascii_letters[block.bounds]) > 0
            names, scores, rejected = [], [], []
            for i in range(len(block)):
                text = block.text(i)
                if not languages or not (lettered[i] or any(map(str.isalpha, text.decode("utf-8", "replace")))):
                    names.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                words = letters_only(text)
                sizes = np.array([len(c.compress(words)) for c in compressors])
                best = int(sizes.argmin())
                share = np.exp2((sizes[best] - sizes) / 2.0)
                second = np.sort(sizes)[1] if len(sizes) > 1 else sizes[best] * 2 + 8
                names.append(languages[best])
                scores.append(float(1 / share.sum()))
                rejected.append(bool(second - sizes[best] < max(MARGIN_BYTES, MARGIN_SHARE * sizes[best])))
            yield pa.RecordBatch.from_arrays(
                [block.batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    found = docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.withColumn("lang_or_und", F.when(F.col("rejected"), "und").otherwise(F.col("lang_pred")))


def language_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the decision for every row of ``docs``, learnt from its other folds."""
    found = identify(docs, train_dictionaries(docs))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected", "lang_or_und")
