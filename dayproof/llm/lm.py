"""Operator 10: language-model scores by deleted interpolation.

The model is a mixture of the maximum-likelihood bigram and unigram and of a uniform
distribution. The weights depend on how often the context was seen (buckets by powers of
two) and are learned by expectation-maximisation on counts of a part of the training
texts that the counts they are mixed from leave out ("deleted"). Copies of a text fall
into the same part. Scores use the counts of all training texts.

How it is spread out:

1. Documents are gathered, task by task, into blocks of about BLOCK_TEXT bytes, stored
   compressed. A block's distinct n-grams are what is shuffled, not its tokens.
2. Blocks send their n-grams and counts to shards by hash, whose number follows the
   number of tokens; a shard adds up and answers each block with the counts from elsewhere.
3. Blocks of the deleted part meet their answers: tuples of counts, added up; each
   expectation step is one aggregation of them, a row per bucket goes to the driver.
4. All blocks meet their answers and score their documents.

No vocabulary is collected or broadcast. A block's arrays are those of one kind of n-gram at a time. The rows
of a shard are bounded by its tokens, except that an n-gram of all blocks (the end token) has one entry a block.

Defined cases: a null or empty text is its end token; a null id is in fold 0; repeated
rows are counted and scored once each; a text is never cut, so a very long one is a block of its own
(about 100 bytes of memory a token); other columns are not looked at; without training texts counts are 0 and weights
uniform; a bucket without deleted counts takes the weights of the next lower one; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayproof.llm.common import fold
from dayproof.llm.textscan import blocks, mix, pair_hashes
from dayproof.sources.scratch import Scratch

BLOCK_TEXT = 3 << 20
SHARD_TOKENS = 500_000
#: The deleted part is one in so many training texts, by hash; a small corpus that has none in it takes the next larger part.
DELETED_SHARE, LARGER_SHARES = 50, (20, 8, 3, 2)
MAX_STEPS, TOLERANCE = 20, 1e-4
FOLDS, HELD_OUT = 7, 2
MAIN, DELETED, UNSEEN = 0, 1, 2

END = np.uint64(0x5851F42D4C957F2D)
BEGIN = np.uint64(0x14057B7EF767814F)


def gather_blocks(docs: DataFrame, share: int) -> DataFrame:
    """block, part, docs, tokens, payload: documents of one part each, compressed together."""
    part = F.when(fold("doc_id", FOLDS) == HELD_OUT, UNSEEN).when(
        F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit("deleted")), F.lit(share)) == 0, DELETED
    ).otherwise(MAIN)

    def gather(batches):
        held: dict[int, list] = {MAIN: [], DELETED: [], UNSEEN: []}
        sizes, serial = dict.fromkeys(held, 0), 0
        task = TaskContext.get().partitionId() << 32

        def close(p: int):
            nonlocal serial
            whole = pa.Table.from_batches(held[p])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(whole)
            held[p], sizes[p], serial = [], 0, serial + 1
            tokens = len(block_tokens(whole)[0])
            return pa.RecordBatch.from_arrays(
                [pa.array([task + serial], pa.int64()), pa.array([p], pa.int32()), pa.array([len(whole)], pa.int64()),
                 pa.array([tokens], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                ["block", "part", "docs", "tokens", "payload"],
            )

        for batch in batches:
            which = np.array(batch.column(2).to_numpy(zero_copy_only=False))
            for p in held:
                own = batch.filter(pa.array(which == p)).select(["doc_id", "text"])
                # Cut where the block is full; a document stays whole.
                weights = np.cumsum([0 if n is None else n for n in pa.compute.binary_length(own.column(1)).to_pylist()])
                lo = 0
                while lo < len(own):
                    done = int(weights[lo - 1]) if lo else 0
                    hi = min(int(np.searchsorted(weights, done + BLOCK_TEXT - sizes[p], "right")) + 1, len(own))
                    held[p].append(own.slice(lo, hi - lo))
                    sizes[p] += int(weights[hi - 1]) - done
                    lo = hi
                    if sizes[p] >= BLOCK_TEXT:
                        yield close(p)
        for p in held:
            if held[p]:
                yield close(p)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", part.alias("part"))
    return narrow.mapInArrow(gather, "block long, part int, docs long, tokens long, payload binary")


def block_tokens(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, first token of each document with one more entry); each document ends with END."""
    tokens, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    # Bytes are scanned a block of textscan at a time; only the tokens' hashes are held for the whole block.
    for block in blocks(docs.to_batches(), "text"):
        words, first = block.lowered().word_hashes()
        tokens.append(np.insert(words, first[1:], END))
        counts.append(np.diff(first) + 1)
    return np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def block_grams(tokens: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes at each token: of the unigram, then of the bigram, one at a time. The context of a first token is BEGIN."""
    yield mix(tokens + np.uint64(1))
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[first[:-1]] = BEGIN
    yield pair_hashes(context, tokens)


def read_payload(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def shard_edges(distinct: np.ndarray, shards: int) -> np.ndarray:
    """First of the sorted grams of each shard, with one more entry: the leading bits choose the
    shard, so the order of hashes is the order of shards."""
    shard = ((distinct >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


def gram_counts(table: DataFrame, shards: int) -> DataFrame:
    """kind, shard, block, part, grams, counts: what each block asks of each shard."""

    def ask(batches):
        for batch in batches:
            for block, part, payload in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                for kind, grams in enumerate(block_grams(*block_tokens(read_payload(payload))), 1):
                    distinct, counts = np.unique(grams, return_counts=True)
                    first = shard_edges(distinct, shards)
                    own = np.flatnonzero(np.diff(first))
                    ends = pa.array(np.append(first[own], len(distinct)).astype(np.int32))
                    n = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, kind), pa.int32()), pa.array(own, pa.int32()), pa.array(np.full(n, block), pa.int64()), pa.array(np.full(n, part), pa.int32()),
                         pa.ListArray.from_arrays(ends, pa.array(distinct.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))],
                        ["kind", "shard", "block", "part", "grams", "counts"],
                    )

    schema = "kind int, shard int, block long, part int, grams array<long>, counts array<long>"
    return table.select("block", "part", "payload").mapInArrow(ask, schema)


def _answer(asked: pa.Table) -> pa.Table:
    """Counts of a shard's grams in other blocks: all training (``train``) and without the deleted part (``main``)."""
    asked = asked.combine_chunks()
    part, lists = asked["part"].to_numpy(), asked["grams"].chunk(0) if asked["grams"].num_chunks else pa.array([], pa.list_(pa.int64()))
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    grams, counts = lists.flatten().to_numpy().view(np.uint64), asked["counts"].chunk(0).flatten().to_numpy()
    distinct, which = np.unique(grams, return_inverse=True)
    size = np.diff(ends)
    row_part = np.repeat(part, size)
    own_main = np.where(row_part == MAIN, counts, 0)
    own_train = np.where(row_part == UNSEEN, 0, counts)
    totals = []
    for own in (own_train, own_main):
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, which, own)
        totals.append(total)
    train = pa.ListArray.from_arrays(lists.offsets.cast(pa.int32()) if not ends[0] else pa.array(ends.astype(np.int32)), pa.array(totals[0][which] - own_train))
    # Only blocks of the deleted part are asked about the counts without it.
    deleted = row_part == DELETED
    main_ends = np.concatenate([[0], np.cumsum(np.where(part == DELETED, size, 0))]).astype(np.int32)
    main = pa.ListArray.from_arrays(pa.array(main_ends), pa.array(totals[1][which][deleted]))
    kind, shard = asked["kind"][0].as_py(), asked["shard"][0].as_py()
    rows = pa.table({"kind": asked["kind"], "shard": asked["shard"], "block": asked["block"], "part": asked["part"], "train": train, "main": main})
    seen = [int((t > 0).sum()) for t in totals]
    extra = pa.table({
        "kind": pa.array([kind], pa.int32()), "shard": pa.array([shard], pa.int32()), "block": pa.array([-1], pa.int64()), "part": pa.array([-1], pa.int32()),
        "train": pa.array([[seen[0]]], pa.list_(pa.int64())), "main": pa.array([[seen[1]]], pa.list_(pa.int64())),
    })
    return pa.concat_tables([rows.cast(extra.schema), extra])


def counts_of_tokens(payload: bytes, answers: pa.Table, part: int, column: str) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents, first token of each, bigram, context and token count of every token), in
    all training texts (``train``) or in the main part (``main``)."""
    docs = read_payload(payload)
    tokens, first = block_tokens(docs)
    found = []
    for kind, grams in enumerate(block_grams(tokens, first), 1):
        _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
        # A block's answers side by side in order of shard are in the order of its grams.
        mine = answers.filter(pa.compute.equal(answers["kind"], kind)).sort_by("shard")[column].combine_chunks()
        own = mine.flatten().to_numpy().astype(np.int64)
        if column == "train" and part != UNSEEN:
            own += counts
        found.append(own[which])
        del grams, which, counts, mine, own
    singles, pairs = found
    context = np.empty_like(singles)
    context[1:] = singles[:-1]
    context[first[:-1]] = -1  # BEGIN: as often as there are training documents
    return docs, first, pairs, context, singles


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole binary logarithm of its count."""
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def learn_weights(tuples: DataFrame, tokens: int, types: int, max_steps: int = MAX_STEPS) -> dict[int, tuple[float, float, float]]:
    """(uniform, unigram, bigram) weights of each bucket by expectation-maximisation over
    stored tuples (bucket, pair, context, single, n)."""
    weights: dict[int, tuple[float, float, float]] = {}
    for _ in range(max_steps):
        known = F.lit(None).cast("array<double>")
        for bucket, w in weights.items():
            known = F.when(F.col("bucket") == bucket, F.array(*[F.lit(x) for x in w])).otherwise(known)
        start = F.when(F.col("bucket") == 0, F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))).otherwise(F.array(*[F.lit(1 / 3)] * 3))
        shares = tuples.select(
            "bucket", "n", F.coalesce(known, start).alias("w"), F.lit(1.0 / (types + 1)).alias("p0"),
            (F.col("single") / F.lit(float(max(tokens, 1)))).alias("p1"),
            F.coalesce(F.try_divide(F.col("pair").cast("double"), F.col("context").cast("double")), F.lit(0.0)).alias("p2"),
        )
        mixed = [F.col("w")[k] * F.col(f"p{k}") for k in range(3)]
        total = mixed[0] + mixed[1] + mixed[2]
        rows = shares.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * m / total).alias(f"s{k}") for k, m in enumerate(mixed)]).collect()
        # One token is added to the uniform share: no text gets probability 0.
        new = {r["bucket"]: tuple((r[f"s{k}"] + (k == 0)) / (r["n"] + 1) for k in range(3)) for r in rows}
        moved = max((abs(a - b) for k in new for a, b in zip(new[k], weights.get(k, (9, 9, 9)), strict=True)), default=0)
        weights = new
        if moved < TOLERANCE:
            break
    return weights


def weight_table(weights: dict[int, tuple[float, float, float]]) -> np.ndarray:
    """Weights by bucket number, gaps filled from the next lower bucket."""
    table = np.zeros((65, 3))
    table[0] = weights.get(0, (0.5, 0.5, 0.0))
    for k in range(1, 65):
        table[k] = weights.get(k, table[k - 1] if k > 1 else (1 / 3, 1 / 3, 1 / 3))
    return table


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    for share in (DELETED_SHARE, *LARGER_SHARES):
        table = scratch.save(gather_blocks(docs, share), "blocks")
        sums = {r["part"]: (r["tokens"], r["docs"]) for r in table.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).collect()}
        if DELETED in sums or MAIN not in sums:
            break
    total = sum(t for t, _ in sums.values())
    train_tokens, train_docs = (sum(sums.get(p, (0, 0))[k] for p in (MAIN, DELETED)) for k in range(2))
    main_tokens, main_docs = sums.get(MAIN, (0, 0))
    shards = max(8, -(-total // SHARD_TOKENS))

    schema = "kind int, shard int, block long, part int, train array<long>, main array<long>"
    answers = scratch.save(gram_counts(table, shards).groupBy("kind", "shard").applyInArrow(_answer, schema), "answers")
    types = answers.where("block = -1 and kind = 1").agg(F.sum(F.col("train")[0]).alias("train"), F.sum(F.col("main")[0]).alias("main")).first()
    train_types, main_types = (types["train"] or 0), (types["main"] or 0)
    answers = answers.where("block >= 0")

    def meet(part, column: str, function, out: str) -> DataFrame:
        """Blocks and answers of the same parts, so every group has its one block."""
        replies = answers.where(part).select("block", "kind", "shard", column)
        return table.where(part).groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(function, out)

    def tuples(block: pa.Table, own: pa.Table) -> pa.Table:
        _, _, pair, context, single = counts_of_tokens(block["payload"][0].as_py(), own, DELETED, "main")
        context = np.where(context < 0, main_docs, context)
        # Tuples are told apart by a hash of their three numbers; the bucket follows from the context.
        key = pair_hashes(pair_hashes(pair.view(np.uint64), context.view(np.uint64)), single.view(np.uint64))
        _, at, n = np.unique(key, return_index=True, return_counts=True)
        pair, context, single = pair[at], context[at], single[at]
        columns = {"bucket": bucket_of(context), "pair": pair, "context": context, "single": single, "n": n}
        return pa.table({name: pa.array(values, pa.int64()) for name, values in columns.items()})

    seen = meet(F.col("part") == DELETED, "main", tuples, "bucket long, pair long, context long, single long, n long")
    seen = scratch.save(seen.groupBy("bucket", "pair", "context", "single").agg(F.sum("n").alias("n")), "tuples")
    weights = weight_table(learn_weights(seen, main_tokens, main_types))

    def score(block: pa.Table, own: pa.Table) -> pa.Table:
        found, first, pair, context, single = counts_of_tokens(block["payload"][0].as_py(), own, block["part"][0].as_py(), "train")
        context = np.where(context < 0, train_docs, context)
        lam = weights[bucket_of(context)]
        p = lam[:, 0] / (train_types + 1) + lam[:, 1] * single / max(1, train_tokens) + lam[:, 2] * pair / np.maximum(context, 1)
        base = np.log10((single + 1) / (train_tokens + train_types + 1))
        at = first[:-1]
        return pa.table({
            "doc_id": found["doc_id"].cast(pa.int64()), "n_tokens": pa.array(np.diff(first), pa.int64()),
            "n_known": pa.array(np.add.reduceat((single > 0).astype(np.int64), at), pa.int64()),
            "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(np.log10(p), at),
        })

    scored = meet(F.lit(True), "train", score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"), "base_score", "score",
    )
