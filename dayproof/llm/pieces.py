"""Operator 2: N-best SentencePiece segmentation, and decoding.

A text is a lattice of the model's pieces; a segmentation's score is the sum of its pieces'
scores. Forward Viterbi gives the best score up to each position, which is the exact
remaining cost of a backward A* search: complete paths leave its queue in order of score.

No piece of the model reaches over the start of a run of spaces or over a line break, so the
lattice falls into chunks there. Each distinct chunk of a block is solved once, all at the
same time, position by position (best and second best score, and the best path). A text's
N best segmentations differ from the best one only in chunks whose loss is among its N-1
smallest; the A* search runs on those chunks alone, and their alternatives are combined.

A character without a piece of its own becomes its UTF-8 bytes' pieces, at a penalty
below the worst piece. U+2581, the model's sign for a space, is such a character, so
decoding gives back any text exactly.

Defined cases: a null or empty text has one segmentation, without pieces; fewer than N
segmentations give a shorter list; equal scores go to longer last pieces, then to the order
of the search; a very long text without spaces is one chunk, solved position by position; a null id is kept; repeated rows are encoded once each; an empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayproof.llm.textscan import Block, blocks

N_BEST = 3
#: Chunks that a Python worker remembers between blocks; the store starts anew beyond that.
REMEMBERED = 1_000_000
#: Characters of the chunks whose searches are remembered; the oldest go first.
SEARCHED = 500_000
#: Texts below the penalty of a character without piece: below the worst of the usual scores.
PENALTY = 10.0
SPACE = "▁"


class PieceModel:
    """Pieces and scores of a model file, and the segmentations they give."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes_at, self.text_of = {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_at[int(piece[3:5], 16)] = i
                self.text_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace(SPACE, " ")
                self.pieces[text] = (i, float(model.get_score(i)))
                self.text_of[i] = text.encode()
        self.longest = max(map(len, self.pieces))
        across = [t for t in self.pieces if " " in t.lstrip(" ") or ("\n" in t and t != "\n")]
        if across:
            raise ValueError(f"pieces reach over the edge of a chunk: {across[:3]}")
        usual = [s for _, s in self.pieces.values() if s > -1e8]
        self.fallback = min(usual) - PENALTY
        # The same pieces by hash, for whole blocks.
        texts = list(self.pieces)
        block = Block.of(texts)
        hashes = block.span_hashes(block.bounds[:-1], block.bounds[1:])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array([self.pieces[t][0] for t in texts], np.int32)[order]
        self.scores = np.array([self.pieces[t][1] for t in texts])[order]
        # Which leading bits occur at all: most spans of a text are no piece.
        self.leads = np.zeros(1 << 20, bool)
        self.leads[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        # The bytes of every id one behind the other, to decode many ids at once.
        size = np.zeros(model.get_piece_size() + 1, np.int64)
        for i, text in self.text_of.items():
            size[i + 1] = len(text)
        self.text_at = np.cumsum(size)
        self.text_pool = np.frombuffer(b"".join(self.text_of.get(i, b"") for i in range(len(size) - 1)), np.uint8)
        self.searches: OrderedDict[str, list] = OrderedDict()
        self.searched = 0
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.loss, self.pool = np.zeros(0), np.zeros(0), np.zeros(0, np.int32)

    # One chunk, with its N best segmentations.

    def edges(self, text: str, end: int) -> list[tuple[int, list[int], float]]:
        """(start, ids, score) of the pieces that end at ``end``, longest first."""
        found = []
        for start in range(max(0, end - self.longest), end):
            piece = self.pieces.get(text[start:end])
            if piece is not None:
                found.append((start, [piece[0]], piece[1]))
        if not found or found[-1][0] != end - 1:
            found.append((end - 1, [self.bytes_at[b] for b in text[end - 1:end].encode("utf-8", "surrogatepass")], self.fallback))
        return found

    def nbest(self, text: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """The ``n`` best (score, ids) of one chunk or any text: forward Viterbi, then backward A*."""
        into = [self.edges(text, end) for end in range(1, len(text) + 1)]
        best = [0.0]
        for own in into:
            best.append(max(best[start] + score for start, _, score in own))
        # By what is lost against the best path, which is exactly 0 along it, then nearest the start: so
        # no more than N paths are followed where sums in another order would differ in the last bits.
        queue, serial, found = [(0.0, len(text), 0, 0.0, None)], 0, []
        while queue and len(found) < n:
            lost, end, _, done, path = heapq.heappop(queue)
            if not end:
                ids = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                found.append((done, ids))
                continue
            for start, ids, score in into[end - 1]:
                serial += 1
                heapq.heappush(queue, (lost + (best[end] - (best[start] + score)), start, serial, done + score, (ids, path)))
        return found

    def alternatives(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """(loss against the best, ids) of the N best of a chunk, remembered for a while."""
        if chunk not in self.searches:
            found = self.nbest(chunk, n)
            self.searches[chunk] = [(found[0][0] - s, ids) for s, ids in found]
            self.searched += len(chunk)
            while self.searched > SEARCHED and len(self.searches) > 1:
                self.searched -= len(self.searches.popitem(last=False)[0])
        return self.searches[chunk]

    # All distinct chunks of a block at once.

    def solve(self, block: Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(best score, loss of the second best, number of ids, all ids) of the chunks."""
        char_at, _ = block.char_starts()
        first, last = np.searchsorted(char_at, starts), np.searchsorted(char_at, ends)
        order = np.argsort(first - last, kind="stable")  # longest first
        first, size = first[order], (last - first)[order]
        base = np.concatenate([[0], np.cumsum(size + 1)])
        # Position p of chunk c is base[c] + p; its byte is char_at[first[c] + p].
        chunk = np.repeat(np.arange(len(size)), size + 1)
        place = np.arange(base[-1]) - base[chunk]
        byte = char_at[first[chunk] + place]
        best, second = np.full(base[-1], -np.inf), np.full(base[-1], -np.inf)
        best[base[:-1]] = 0
        step, piece = np.zeros(base[-1], np.int32), np.full(base[-1], -1, np.int32)
        reach = min(self.longest, int(size.max(initial=0)))
        # Pieces of each length, ordered by the position where they end.
        ends_at = []
        longest = int(size.max(initial=0))
        for k in range(1, reach + 1):
            at = np.flatnonzero(place >= k)
            hashes = block.span_hashes(byte[at - k], byte[at])
            maybe = np.flatnonzero(self.leads[(hashes >> np.uint64(44)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            hit = self.hashes[slot] == hashes[maybe]
            maybe, slot = maybe[hit], slot[hit]
            if k == 1:  # every character has an edge, if only its bytes'
                ids, scores = np.full(len(at), -1, np.int32), np.full(len(at), self.fallback)
                ids[maybe], scores[maybe] = self.ids[slot], self.scores[slot]
            else:
                at, ids, scores = at[maybe], self.ids[slot], self.scores[slot]
            turn = np.argsort(place[at], kind="stable")
            at = at[turn]
            ends_at.append((at, ids[turn], scores[turn], np.searchsorted(place[at], np.arange(longest + 2))))
        for p in range(1, longest + 1):
            for k in range(min(p, reach), 0, -1):
                at, ids, scores, part = ends_at[k - 1]
                lo, hi = part[p], part[p + 1]
                if lo == hi:
                    continue
                at, score = at[lo:hi], scores[lo:hi]
                a, b, top = best[at - k] + score, second[at - k] + score, best[at]
                better = a > top
                second[at] = np.maximum(np.maximum(np.minimum(top, a), second[at]), b)
                best[at] = np.where(better, a, top)
                won = at[better]
                step[won], piece[won] = k, ids[lo:hi][better]
        # Walk back; a piece of -1 stands for the bytes of one character.
        at = base[1:] - 1
        pieces, owners, spots = [], [], []
        live = np.flatnonzero(size > 0)
        at = at[live]
        while len(live):
            pieces.append(piece[at]), owners.append(live), spots.append(byte[at - step[at]])
            at = at - step[at]
            more = at > base[live]
            live, at = live[more], at[more]
        pieces, owners, spots = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pieces, owners, spots))
        turn = np.lexsort((spots, owners))
        pieces, owners, spots = pieces[turn], owners[turn], spots[turn]
        lone = np.flatnonzero(pieces < 0)
        if len(lone):
            stops = char_at[np.searchsorted(char_at, spots[lone]) + 1]
            many = np.ones(len(pieces), np.int64)
            many[lone] = stops - spots[lone]
            into = np.repeat(np.arange(len(pieces)), many)
            within = np.arange(len(into)) - np.repeat(np.cumsum(many) - many, many)
            table = np.array([self.bytes_at.get(b, 0) for b in range(256)], np.int32)
            wide = pieces[into]
            mask = wide < 0
            wide[mask] = table[block.data[spots[into[mask]] + within[mask]]]
            pieces, owners = wide, owners[into]
        counts = np.bincount(owners.astype(np.int64), minlength=len(size))
        at = np.cumsum(counts) - counts
        # Back to the order of the arguments.
        back = np.argsort(order, kind="stable")
        last_at = base[1:] - 1
        gather = np.repeat(at[back], counts[back]) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts[back]) - counts[back], counts[back])
        return best[last_at][back], (best[last_at] - second[last_at])[back], counts[back], pieces[gather].astype(np.int32)

    def encode_block(self, block: Block, n: int = N_BEST) -> list[list[tuple[float, np.ndarray]]]:
        """The ``n`` best (score, ids) of each document."""
        filled = np.diff(block.bounds) > 0
        data = np.insert(block.data, block.bounds[:-1][filled], 32)
        block = Block(data, block.bounds + np.concatenate([[0], np.cumsum(filled)]))
        space, line = block.data == 32, block.data == 10
        cut = np.zeros(len(block.data), bool)
        cut[block.bounds[:-1][filled]] = True
        cut[1:] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(block.data))
        first = np.searchsorted(starts, block.bounds)
        hashes = block.span_hashes(starts, ends)
        distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.known, distinct)
        old = place < len(self.known)
        old[old] = self.known[place[old]] == distinct[old]
        fresh = np.flatnonzero(~old)
        if len(fresh):
            score, loss, counts, ids = self.solve(block, starts[example[fresh]], ends[example[fresh]])
            where = place[fresh]
            for name, values in (("at", len(self.pool) + np.cumsum(counts) - counts), ("length", counts), ("score", score), ("loss", loss), ("known", distinct[fresh])):
                setattr(self, name, np.insert(getattr(self, name), where, values))
            self.pool = np.append(self.pool, ids)
            place = np.searchsorted(self.known, distinct)
        unit = place[which]
        length, loss = self.length[unit], self.loss[unit]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(self.at[unit] - total[:-1], length) + np.arange(total[-1])]
        scores = np.concatenate([[0], np.cumsum(self.score[unit])])
        results = []
        for i in range(len(block)):
            lo, hi = first[i], first[i + 1]
            own = ids[total[lo]:total[hi]]
            best = float(self.score[unit[lo:hi]].sum())
            some = np.argpartition(loss[lo:hi], n - 2)[:n - 1] if hi - lo > n - 1 > 0 else np.arange(hi - lo)
            ways: list[tuple[float, int, tuple]] = [(0.0, 0, ())]
            for k in sorted(some.tolist()):
                if np.isinf(loss[lo + k]) or n < 2:
                    continue
                raw = block.data[starts[lo + k]:ends[lo + k]].tobytes().decode("utf-8", "surrogateescape")
                options = self.alternatives(raw, n)
                ways = sorted((w + d, c + j, (*changes, *([(k, new)] if j else []))) for w, c, changes in ways for j, (d, new) in enumerate(options))[:n]
            found = []
            for lost, _, changes in ways:
                parts, done = [], total[lo]
                for k, new in changes:
                    parts += [ids[done:total[lo + k]], np.array(new, np.int32)]
                    done = total[lo + k + 1]
                found.append((best - lost, np.concatenate([*parts, ids[done:total[hi]]]) if changes else own))
            results.append(found)
        return results

    def raw_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, first byte of each id with one more entry)."""
        size = np.diff(self.text_at)[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.text_pool[np.repeat(self.text_at[ids] - total[:-1], size) + np.arange(total[-1])], total

    def decode(self, ids) -> str:
        """The text of ids; the space that encoding puts in front is taken off."""
        return self.raw_bytes(np.asarray(ids, np.int64))[0].tobytes()[1:].decode("utf-8", "replace")

    def decodes_to(self, ways: list[np.ndarray], texts: list[bytes]) -> list[bool]:
        raw, total = self.raw_bytes(np.concatenate(ways).astype(np.int64))
        at = total[np.concatenate([[0], np.cumsum([len(w) for w in ways])])]
        raw = raw.tobytes()
        return [raw[a:b] == (b" " + t if t else b"") for a, b, t in zip(at[:-1], at[1:], texts, strict=True)]


_models: dict[str, PieceModel] = {}


def model_at(path: str | None) -> PieceModel:
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_nbest(docs: DataFrame, n: int = N_BEST, model: str | None = None, decode: bool = False) -> DataFrame:
    """doc_id and nbest (score, ids as little-endian 32-bit), best first, of every row of
    ``docs``; with ``decode``, also whether every segmentation decodes to the whole text."""

    def encode(batches):
        pieces = model_at(model)
        for block in blocks(batches, "text", 1 << 20):
            found = pieces.encode_block(block, n)
            ways = [way for own in found for way in own]
            ids = pa.array([w[1].astype("<i4").tobytes() for w in ways], pa.binary())
            structs = pa.StructArray.from_arrays([pa.array([w[0] for w in ways], pa.float64()), ids], ["score", "ids"])
            counts = [len(own) for own in found]
            columns = [block.batch.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]).astype(np.int32)), structs)]
            if decode:
                texts = [block.text(i) for i in range(len(block))]
                same = pieces.decodes_to([w[1] for w in ways], [t for t, c in zip(texts, counts, strict=True) for _ in range(c)])
                at = np.cumsum([0, *counts])
                columns.append(pa.array([all(same[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "nbest", "round_trip"][:len(columns)])

    schema = "doc_id long, nbest array<struct<score: double, ids: binary>>" + (", round_trip boolean" if decode else "")
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def decode_ids(rows: DataFrame, column: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id and text of rows with ids as ``encode_nbest`` gives them; null decodes to an empty text."""

    def back(batches):
        pieces = model_at(model)
        for batch in batches:
            texts = [pieces.decode(np.frombuffer(ids or b"", "<i4")) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", column).mapInArrow(back, "doc_id long, text string")


def nbest_digests(docs: DataFrame, n: int = N_BEST, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces of the best, scores and CRC-32 of the ids of the N best segmentations,
    and whether each decodes to the whole text."""
    found = encode_nbest(docs, n, model, decode=True)
    return found.select(
        "doc_id", (F.octet_length(F.col("nbest")[0]["ids"]) / 4).cast("long").alias("n_pieces"),
        F.transform("nbest", lambda w: w["score"]).alias("scores"), F.transform("nbest", lambda w: F.crc32(w["ids"])).alias("ids_crc32"), "round_trip",
    )
