"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Each partition packs its own rows, block by block, so nothing is shuffled. An open sequence takes, of the pieces that fit, the one
whose demand has the greatest dot product with the room that is left in all dimensions.
"""

from __future__ import annotations

import binascii
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, sole_memory

#: Distinct pieces of text whose ids a task remembers; then it starts anew.
MOST_PIECES = 1_200_000

#: Text that is cut and looked up at once.
SLICE = 4_000_000

#: Loose pieces that are packed together; bounds the memory and time of a block.
BLOCK = 4_096


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2048


def pack(tokens: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length) of items with so many tokens, of which the last `loss` bear loss (all in one bin at most).

    Items are no longer than limits.tokens and bear no more loss than limits.loss_tokens. With cut, a bin that no item fits is filled
    with the front of one, and the last bin, only partly full, is dealt out to bins of powers of two, so that none is padded.
    Without cut, every item stays whole. Loss is counted as the item's share, rounded up.
    """
    order = np.argsort(-tokens, kind="stable")
    need = np.stack([tokens / limits.tokens, np.full(len(tokens), 1 / limits.segments), loss / max(1, limits.loss_tokens)], axis=1)[order]
    size, bears = tokens[order].astype(np.int64), loss[order].astype(np.int64)
    start = np.zeros(len(order), np.int64)
    alive = np.arange(len(order))
    bins: list[list[tuple[int, int, int]]] = []
    while len(alive):
        room, left, segments, budget, inside = np.ones(3), limits.tokens, limits.segments, limits.loss_tokens, []
        gone = np.zeros(len(alive), bool)
        a_need, a_size, a_loss = need[alive], size[alive], bears[alive]
        while left and segments:
            # sizes fall along alive, so that all that fit in tokens are behind one place
            at = int(np.searchsorted(-a_size, -left))
            ok = ~gone[at:] & (a_loss[at:] <= budget)
            if not ok.any():
                break
            score = np.where(ok, a_need[at:] @ room, -1.0)
            i = at + int(np.argmax(score))
            gone[i] = True
            inside.append((int(alive[i]), int(start[alive[i]]), int(a_size[i])))
            left, segments, budget = left - int(a_size[i]), segments - 1, budget - int(a_loss[i])
            room = np.array([left / limits.tokens, segments / limits.segments, budget / max(1, limits.loss_tokens)])
        rest = alive[~gone]
        if cut and left and segments and len(rest) and limits.loss_tokens >= limits.tokens:
            i = rest[0]  # the largest: its front fills the bin, the rest of it stays, in its place by size
            inside.append((int(i), int(start[i]), left))
            start[i] += left
            size[i] -= left
            bears[i] = min(bears[i], size[i])
            need[i] = size[i] / limits.tokens, 1 / limits.segments, bears[i] / max(1, limits.loss_tokens)
            rest = rest[1:]
            rest = np.insert(rest, np.searchsorted(-size[rest], -size[i]), i)
        bins.append([(int(order[i]), s, n) for i, s, n in inside])
        alive = rest
    if cut:
        bins = [x for b in bins for x in powers(b, limits.tokens)]
    return bins


def powers(inside: list[tuple[int, int, int]], full: int) -> list[list[tuple[int, int, int]]]:
    """A bin as bins whose lengths are powers of two: itself if it is full."""
    total = sum(n for _, _, n in inside)
    if total == full:
        return [inside]
    out, parts = [], list(inside)
    for k in reversed(range(total.bit_length())):
        if not total >> k & 1:
            continue
        want, one = 1 << k, []
        while want:
            i, s, n = parts.pop(0)
            take = min(n, want)
            one.append((i, s, take))
            want -= take
            if take < n:
                parts.insert(0, (i, s + take, n - take))
        out.append(one)
    return out


#: Marks that may follow a word in a piece; the tokenizer's pattern takes them apart from it.
MARKS = {".", ",", "!", "?", ":", ";"}


def plain_word(piece: str) -> bool:
    """If a piece is Latin letters, after a blank or not: for the tokenizer one unit."""
    body = piece[1:] if piece[:1] == " " else piece
    return body.isalpha() and (body.isascii() or max(body) < "\u0250")


#: How byte-level vocabularies spell the bytes of Latin letters and the blank: the bytes that print as themselves, others from U+0100 on.
_SPELL = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


def byte_spelling(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_SPELL)


class PieceTokens:
    """Ids of texts by a byte-level tokenizer, of each distinct piece once.

    A piece is a run without blanks and the blank before it. The tokenizer's pattern never joins what stands before a blank to
    the blank, if no white space is beside that blank, so the pieces' ids in a row are the text's. Special strings have no blank
    inside and are taken whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = MOST_PIECES
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[i]: end of piece i - 1
        self.n = 0

    def learn(self, new: list[str]) -> None:
        """Ids of new pieces: of a word (after a blank or not) by the tokenizer's model at once, of a word and a mark after it by parts."""
        words, marked, others = [], [], []
        for p in new:
            if plain_word(p):
                words.append(p)
            elif p[-1:] in MARKS and plain_word(p[:-1]):
                marked.append(p)
            else:
                others.append(p)
        parts = {p[:-1] for p in marked} | {p[-1] for p in marked}
        more = list(parts.difference(self.index, words, others))
        words += [p for p in more if p not in MARKS]
        others += [p for p in more if p in MARKS]
        model = self.tokenizer.model.tokenize
        self.store(words, [[t.id for t in model(byte_spelling(p))] for p in words])
        for at in range(0, len(others), 4096):
            part = others[at : at + 4096]
            self.store(part, [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)])
        of = self.index
        self.store(marked, [[*self.one(of[p[:-1]]), *self.one(of[p[-1]])] for p in marked])

    def one(self, i: int) -> list[int]:
        return self.flat[self.ends[i] : self.ends[i + 1]].tolist()

    def store(self, pieces: list[str], ids: list[list[int]]) -> None:
        flat = np.array([x for e in ids for x in e], np.uint32)
        have = int(self.ends[self.n])
        while have + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(pieces) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[have : have + len(flat)] = flat
        self.ends[self.n + 1 : self.n + len(pieces) + 1] = have + np.cumsum([len(e) for e in ids])
        self.index.update(zip(pieces, range(self.n, self.n + len(pieces)), strict=True))
        self.n += len(pieces)

    def places(self, pieces: list[str]) -> np.ndarray:
        """Numbers of pieces, new ones learned first."""
        new = list(set(pieces).difference(self.index))
        if new:
            self.learn(new)
        return np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column of strings; null: none.

        Texts are cut at blanks and the distinct parts looked up once. Where a part is empty or has white space at an end, the text
        is cut piece by piece instead.
        """
        if self.n > self.most:
            self.clear()
        lists = pc.split_pattern(pc.fill_null(column, ""), " ")
        offsets = np.asarray(lists.offsets, np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        distinct = coded.dictionary.to_pylist()
        part = coded.indices.to_numpy(zero_copy_only=False)
        odd = np.array([not x or x[0].isspace() or x[-1].isspace() for x in distinct], bool)
        place = self.places([" " + x for x in distinct])[part]
        heads = np.flatnonzero(np.diff(offsets))
        place[offsets[:-1][heads]] = self.places([distinct[i] for i in part[offsets[:-1][heads]]])
        # an empty text is one empty part, of no ids
        slow = np.add.reduceat(odd[part], offsets[:-1]) > 0 if len(part) else np.zeros(0, bool)
        ids, ends = self.ids(place)
        cuts = np.concatenate([[0], ends])[offsets]
        return [self.ids(self.places(split_pieces(column[i].as_py() or "")))[0] if slow[i] else ids[cuts[i] : cuts[i + 1]] for i in range(len(column))]

    def ids(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and where each piece's end."""
        lo, n = self.ends[place], self.ends[place + 1] - self.ends[place]
        ends = np.cumsum(n)
        return self.flat[np.repeat(lo - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


_encoders: dict[str, PieceTokens] = {}


def encoder_of(path: str) -> PieceTokens:
    """One encoder a process, so that a worker's next task knows the last one's pieces."""
    sole_memory("packing", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = PieceTokens(path)
    return _encoders[path]


def split_pieces(text: str) -> list[str]:
    """The text cut before each blank between two characters that are no white space."""
    if not text:
        return []
    parts = text.split(" ")
    out, held = [], parts[0]
    for p in parts[1:]:
        if p and held and not p[0].isspace() and not held[-1].isspace():
            out.append(held)
            held = " " + p
        else:
            held += " " + p
    out.append(held)
    return out


def pack_texts(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 1, most_pieces: int = MOST_PIECES) -> DataFrame:  # noqa: B008
    """Pieces of all texts, each text's ids followed by end_id, in sequences of at most limits.tokens.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A text is cut into whole sequences and a rest; the
    rests, of blocks of BLOCK rows of a partition, are packed with cuts (pack). Sequences are full, or their lengths are powers of
    two, so none is padded, unless the limit on segments closes one early; then it is dealt to powers of two also. sequence_id: the
    partition's number times 2^33, plus a count. Null and empty texts: the end id alone. Null ids stay null; repeated rows are
    packed each. Only doc_id and text are read. An empty table gives an empty result.
    """
    assert limits.loss_tokens >= limits.tokens, "each token of a document bears loss"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        encoder.most = most_pieces
        next_id = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        loose: list[tuple] = []

        def put(bins: list[list[tuple]]) -> None:
            nonlocal next_id
            for b in bins:
                at = 0
                for doc, start, ids, total in b:
                    rows.append((doc, start, len(ids), binascii.crc32(ids.tobytes()), total, next_id, at))
                    at += len(ids)
                next_id += 1

        def pack_loose() -> None:
            sizes = np.array([len(x[2]) for x in loose], np.int64)
            for b in pack(sizes, sizes, limits, cut=True):
                put([[(loose[i][0], loose[i][1] + s, loose[i][2][s : s + n], loose[i][3]) for i, s, n in b]])
            loose.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
                rows.clear()

        for batch in batches:
            for part in slices(batch, most=SLICE):
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    whole = len(ids) // limits.tokens * limits.tokens
                    put([[(doc, s, ids[s : s + limits.tokens], len(ids))] for s in range(0, whole, limits.tokens)])
                    if whole < len(ids):
                        loose.append((doc, whole, ids[whole:].copy(), len(ids)))
                    if len(loose) >= BLOCK:
                        pack_loose()
                yield from flush()
        if loose:
            pack_loose()
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_examples(examples: DataFrame, limits: Limits, id_col: str = "id", tokens_col: str = "tokens", loss_col: str = "loss_tokens") -> DataFrame:
    """Whole examples (instruction data) to sequences under all three limits: id, sequence_id, slot, tokens, loss_tokens.

    Null counts are 0. An example over a limit by itself is put alone into a sequence of its own and marked oversize. Column names
    of the result replace any of the same names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                n, loss = (pc.fill_null(part.column(i), 0).to_numpy(zero_copy_only=False) for i in (1, 2))
                over = (n > limits.tokens) | (loss > limits.loss_tokens)
                fit = np.flatnonzero(~over)
                bins = [[int(fit[i]) for i, _, _ in b] for b in pack(n[fit], loss[fit], limits, cut=False)] + [[int(i)] for i in np.flatnonzero(over)]
                rows = [(i, next_id + k, s) for k, b in enumerate(bins) for s, i in enumerate(b)]
                next_id += len(bins)
                take = [r[0] for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array(n[take]), pa.array(loss[take]), pa.array(over[take])], names=["id", "sequence_id", "slot", "tokens", "loss_tokens", "oversize"])

    source = examples.select(F.col(id_col).alias("id"), F.col(tokens_col).cast("long").alias("tokens"), F.col(loss_col).cast("long").alias("loss_tokens"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, sequence_id long, slot int, tokens long, loss_tokens long, oversize boolean")


def pack_conversations(conversations: DataFrame, tokenizer_path: str, limits: Limits = Limits(2048, 8, 1024)) -> DataFrame:  # noqa: B008
    """Conversations (conv_id, turn, role, text) as whole examples to sequences under all three limits: id, sequence_id, slot, tokens, loss_tokens, oversize.

    An example's tokens are those of all its turns, with an end each; loss is borne by the assistant's turns. Null texts have the end alone;
    a null role bears no loss; turns without conv_id are one conversation. Turns are counted where they lie and summed by conversation.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for batch in batches:
            for part in slices(batch, most=SLICE):
                n = pa.array([len(ids) + 1 for ids in encoder.encode(part.column(2))], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n], names=["id", "role", "n"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    turns = conversations.select("conv_id", "role", "text").mapInArrow(counted, f"id {kind}, role string, n long")
    sums = turns.groupBy("id").agg(F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.col("n"))), F.lit(0)).alias("loss_tokens"))
    return pack_examples(sums, limits)
