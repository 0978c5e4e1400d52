"""Token counts by compiled finite-state transducers.

Two deterministic transducers run in turn. The first, over classes of characters, marks where words start; texts are cut into chunks
of one length, each chunk gets the map of entry state to exit state and words started, and the maps compose through a parallel
prefix scan, which gives each chunk its entry state. The second, over the bytes of a word, annotates each transition with the tokens
that it adds (or takes back); it is the determinized form of byte-pair merging, compiled as far as the words at hand need it, and
runs over all words of a slice in lockstep. Long words are cut into chunks as well: a chunk's map holds the entry states that may reach it,
first the one that the chunk before ends in if it is taken for a word's start, then all that maps lead to; once they are closed the scan
composes them.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema, texts, with_columns

#: Characters in a chunk of the scan.
CHUNK = 128

#: Transitions that a task keeps compiled; beyond it starts anew.
MOST_TRANSITIONS = 3_000_000
#: Bytes of a word beyond which it is cut into chunks, and of the words that are counted at once.
LONG, AT_ONCE = 512, 1 << 20
#: Rounds in which maps are closed; after that the one true entry state goes from chunk to chunk.
ROUNDS = 12

# classes of characters for the word transducer
SPACE, LETTER, NUMBER, OTHER, QUOTE, ONE, R, V, L, E = range(10)

@cache
def char_classes(path: str) -> np.ndarray:
    """The class of each code point, as the file's own cutting into words has it: blocks that are all of one class are found whole."""
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    out = np.full(0x110000, OTHER, np.uint8)

    def find(lo: int, hi: int) -> None:
        if lo < 0xE000 and hi > 0xD800:  # surrogates stand in no text
            for a, b in ((lo, min(hi, 0xD800)), (max(lo, 0xE000), hi)):
                if a < b:
                    find(a, b)
            return
        block = "".join(map(chr, range(lo, hi)))
        whole = (0, hi - lo + 1)
        if [x for _, x in cut("a" + block)] == [whole]:
            out[lo:hi] = LETTER
        elif [x for _, x in cut("!" + block)] == [whole]:
            return
        elif hi - lo == 1:
            out[lo] = NUMBER if cut(block) else SPACE
        else:
            find(lo, (lo + hi) // 2)
            find((lo + hi) // 2, hi)

    for lo in range(0, 0x110000, 1024):
        find(lo, lo + 1024)
    out[ord("'")] = QUOTE
    for c in "stmd":
        out[ord(c)] = ONE
    for c, k in zip("rvle", (R, V, L, E), strict=True):
        out[ord(c)] = k
    return out


# states: between words; in letters; in a run of others; in a lone quote; in a quote and r, v or l, which may end a contraction
BETWEEN, LETTERS, OTHERS, QUOTED, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
STATES = 7
# a transition's output: a word starts here, at the character before, or both
HERE, BEFORE = 1, 2


@cache
def word_transducer() -> tuple[np.ndarray, np.ndarray]:
    """next and output by state and class, for the pattern: contractions ('s 't 'm 'd 're 've 'll), letters, one number, others."""
    nxt = np.zeros((STATES, 10), np.uint8)
    out = np.zeros((STATES, 10), np.uint8)
    letters = (LETTER, ONE, R, V, L, E)
    for state in range(STATES):
        for c in range(10):
            if c == SPACE:
                to = (BETWEEN, 0)
            elif c in letters:
                to = (LETTERS, 0 if state == LETTERS else HERE)
            elif c == NUMBER:
                to = (BETWEEN, HERE)
            elif state in (OTHERS, QUOTED):
                to = (OTHERS, 0)
            else:
                to = (QUOTED if c == QUOTE else OTHERS, HERE)
            if state == QUOTED and c == ONE:
                to = (BETWEEN, 0)
            elif state == QUOTED and c in (R, V, L):
                to = ({R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], 0)
            elif state in (QUOTE_R, QUOTE_V, QUOTE_L):
                if c == (L if state == QUOTE_L else E):
                    to = (BETWEEN, 0)
                else:  # no contraction: the letter before began a word
                    to = (LETTERS, BEFORE) if c in letters else (to[0], to[1] | BEFORE)
            nxt[state, c], out[state, c] = to
    return nxt, out


def chunk_maps(symbols: np.ndarray, nxt: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exit state, words started) of each chunk (a column of symbols) from each entry state.

    All entry states run side by side until they have met in every chunk; from there on one lane serves them all.
    """
    n = symbols.shape[1]
    started = np.array([0, 1, 1, 2])[out]
    state = np.repeat(np.arange(len(nxt), dtype=np.uint8)[:, None], n, axis=1)
    count = np.zeros((len(nxt), n), np.int64)
    j, width = 0, nxt.shape[1]
    while j < len(symbols) and (state != state[0]).any():
        count += started[state, symbols[j]]
        state = nxt[state, symbols[j]]
        j += 1
    one, more = state[0], np.zeros(n, np.int64)
    flat, flat_started = nxt.ravel(), started.ravel()
    for j in range(j, len(symbols)):
        at = one.astype(np.int64) * width + symbols[j]
        more += flat_started[at]
        one = flat[at]
    if j < len(symbols):
        state = np.repeat(one[None], len(nxt), axis=0) if (state == state[0]).all() else state
    return state, count + more


def prefix_scan(state: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composes the maps of chunk 0 to i, for all i, in as many steps as the logarithm of the chunks."""
    state, count = state.copy(), count.copy()
    step = 1
    while step < state.shape[1]:
        before, after = state[:, :-step], state[:, step:]
        cols = np.arange(after.shape[1])
        joined = after[before, cols]
        joined_count = count[:, :-step] + count[:, step:][before, cols]
        state[:, step:], count[:, step:] = joined, joined_count
        step *= 2
    return state, count


def word_starts(classes: np.ndarray) -> np.ndarray:
    """For each character, if a word starts there."""
    n = len(classes)
    chunks = -(-(n + 1) // CHUNK)
    padded = np.zeros(chunks * CHUNK, np.uint8)
    padded[:n] = classes
    symbols = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    nxt, out = word_transducer()
    ends, counts = prefix_scan(*chunk_maps(symbols, nxt, out))
    state = np.concatenate([np.array([BETWEEN], np.uint8), ends[BETWEEN, :-1]])
    marks = np.zeros((CHUNK, chunks), np.uint8)
    flat, flat_out = nxt.ravel(), out.ravel()
    for j in range(CHUNK):
        at = state.astype(np.int16) * 10 + symbols[j]
        marks[j] = flat_out[at]
        state = flat[at]
    marks = np.ascontiguousarray(marks.T).ravel()
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BEFORE) > 0
    assert int(counts[BETWEEN, -1]) == int(starts.sum())
    return starts[:n]


class MergeTransducer:
    """Byte-pair merging as a deterministic transducer over bytes (the last of a word as byte + 256), compiled on demand.

    A sequence of tokens is what merging gives just if every two neighbours are, and the front of such a sequence is one, so each
    front of a word has one last token. A state holds, for every start from which the bytes so far may still grow into a token, that
    place in the tree of tokens, the last token before it and how many tokens fewer lie before it. Those are finitely many.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"]
        letters = byte_letters()
        base = {c: b for b, c in letters.items()} | {c + suffix: b + 256 for b, c in letters.items()}
        rank = dict(base)
        self.split: list[tuple[int, int]] = [(i, i) for i in range(512)]
        self.merged: dict[tuple[int, int], int] = {}
        spell: list[tuple[int, ...]] = [(i,) for i in range(512)]
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for i in range(512):
            self._grow((i,), i)
        for a, b in model["merges"]:
            ids = rank[a], rank[b]
            t = len(self.split)
            self.split.append(ids)
            self.merged.setdefault(ids, t)
            spell.append(spell[ids[0]] + spell[ids[1]])
            rank.setdefault(a + b, t)
            self._grow(spell[t], t)
        self.valid: dict[tuple[int, int], bool] = {}
        self.clear()

    def _grow(self, symbols: tuple[int, ...], token: int) -> None:
        at = 0
        for s in symbols:
            to = self.children[at].get(s)
            if to is None:
                to = self.children[at][s] = len(self.children)
                self.children.append({})
                self.token.append(-1)
            at = to
        if self.token[at] < 0:
            self.token[at] = token

    def clear(self) -> None:
        start = ((0, -1, 0),)
        self.states: dict[tuple, int] = {start: 0}
        self.kept: list[tuple] = [start]
        self.size = 1 << 16
        self.keys = np.full(self.size, -1, np.int64)
        self.values = np.zeros(self.size, np.int64)
        self.n = 0

    def stays(self, a: int, b: int) -> bool:
        """If merging leaves the tokens a, b side by side.

        Undoes the later of the two merges that made the facing ends; whatever merge joins the ends must come after what was undone.
        """
        found = self.valid.get((a, b))
        if found is not None:
            return found
        x, y, before = a, b, len(self.split)
        ok = True
        while True:
            t = self.merged.get((x, y))
            if t is not None and t < before:
                ok = False
                break
            if x < 512 and y < 512:
                break
            if x > y:  # a later merge than the left end of b, so undone first
                before, x = x, self.split[x][1]
            else:  # on a tie the left one comes first: y was made after what stands at x
                before, y = y + 1, self.split[y][0]
        if len(self.valid) > MOST_TRANSITIONS:
            self.valid.clear()
        self.valid[a, b] = ok
        return ok

    def compile(self, state: int, symbol: int) -> int:
        """The value of a transition: next state << 8 | tokens added + 128."""
        live, last, added = [], -1, 0
        for node, before, rel in self.kept[state]:
            to = self.children[node].get(symbol)
            if to is None:
                continue
            t = self.token[to]
            if t >= 0 and last < 0 and (before < 0 or self.stays(before, t)):
                last, added = t, rel + 1
            if self.children[to]:
                live.append((to, before, rel))
        if symbol >= 256:
            return added + 128
        new = tuple((node, before, rel - added) for node, before, rel in live) + ((0, last, 0),)
        to = self.states.get(new)
        if to is None:
            to = self.states[new] = len(self.kept)
            self.kept.append(new)
        return to << 8 | added + 128

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(-7046029254386353131)) >> np.int64(20)) & np.int64(self.size - 1)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        if 2 * (self.n + len(keys)) > self.size:
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            while 2 * len(keys) > self.size:
                self.size *= 2
            self.keys, self.values, self.n = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int64), 0
        self.n += len(keys)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several at one place the last stays
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & (self.size - 1)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        at = self._slot(keys)
        got = self.keys[at]
        out = self.values[at]
        odd = np.flatnonzero(got != keys)
        while len(odd):
            missing = got[odd] < 0
            out[odd[missing]] = -1
            odd = odd[~missing]
            at[odd] = (at[odd] + 1) & (self.size - 1)
            got[odd] = self.keys[at[odd]]
            hit = got[odd] == keys[odd]
            out[odd[hit]] = self.values[at[odd[hit]]]
            odd = odd[~hit]
        return out

    def run(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit state, tokens added) of each stretch data[start : start + length] from its entry state; last: if it ends its word."""
        order = np.argsort(-length.astype(np.int32), kind="stable")
        first, size, state, last = start[order], length[order], entry[order], last[order]
        total = np.zeros(len(order), np.int32)
        # stretches in use at each step: those longer than it
        active = len(size) - np.cumsum(np.bincount(size, minlength=int(size[0]) + 1 if len(size) else 1))
        for j in range(int(size[0]) if len(size) else 0):
            n = int(active[j])
            symbol = data[first[:n] + j].astype(np.int64)
            at = int(active[j + 1])
            symbol[at:] += 256 * last[at:n]
            keys = state[:n] * 512 + symbol
            value = self._find(keys)
            lost = np.flatnonzero(value < 0)
            if len(lost):
                new, where = np.unique(keys[lost], return_inverse=True)
                made = np.array([self.compile(k >> 9, k & 511) for k in new.tolist()], np.int64)
                self._insert(new, made)
                value[lost] = made[where]
            state[:n] = value >> 8
            total[:n] += (value & 255).astype(np.int32) - 128
        exits, added = np.empty_like(state), np.empty_like(total)
        exits[order], added[order] = state, total
        return exits, added

    def long_count(self, data: np.ndarray) -> int:
        """Tokens of one long word, by maps of its chunks."""
        n = -(-len(data) // CHUNK)
        first = np.arange(n) * CHUNK
        size = np.minimum(CHUNK, len(data) - first)
        # chunks of the same bytes have one map
        kinds, kind = np.unique(data[: first[-1]].reshape(n - 1, CHUNK), axis=0, return_inverse=True) if n > 1 else (None, np.zeros(0, np.int64))
        kind = np.r_[kind.ravel(), len(kinds) if n > 1 else 0]
        sample = np.zeros(int(kind.max()) + 1, np.int64)
        sample[kind] = np.arange(n)
        maps: list[dict[int, tuple[int, int]]] = [{} for _ in sample]

        def work(todo: list[tuple[int, int]]) -> None:
            k = np.array([x for x, _ in todo])
            at = sample[k]
            exits, added = self.run(data, first[at], size[at], np.array([e for _, e in todo], np.int64), at == n - 1)
            for (x, e), to, c in zip(todo, exits.tolist(), added.tolist(), strict=True):
                maps[x][e] = to, c

        work([(k, 0) for k in range(len(sample))])
        pairs = np.unique(np.stack([kind[:-1], kind[1:]], axis=1), axis=0).tolist()
        for _ in range(ROUNDS):
            todo = sorted({(b, to) for a, b in pairs for to, _ in maps[a].values() if to not in maps[b]})
            if not todo:
                break
            work(todo)
        else:
            state, total = 0, 0
            for k in kind.tolist():
                if state not in maps[k]:
                    work([(k, state)])
                state, c = maps[k][state]
                total += c
            return total
        # closed: a chunk's entry states by their place in its map
        place = [{e: i for i, e in enumerate(m)} for m in maps]
        to = np.zeros((max(map(len, maps)), n), np.int64)
        count = np.zeros_like(to)
        after = [*kind.tolist()[1:], -1]
        for i, (k, then) in enumerate(zip(kind.tolist(), after, strict=True)):
            for e, (x, c) in enumerate(maps[k].values()):
                to[e, i], count[e, i] = place[then][x] if then >= 0 else 0, c
        return int(prefix_scan(to, count)[1][0, -1])  # the first entry of a map is the start of a word

    def count(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each word, data[start : start + length]."""
        out = np.zeros(len(start), np.int64)
        whole = np.flatnonzero(length <= LONG)
        ends = np.cumsum(length[whole])
        at = 0
        while at < len(whole):
            if self.n > MOST_TRANSITIONS:
                self.clear()
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            some = whole[at:to]
            out[some] = self.run(data, start[some], length[some], np.zeros(len(some), np.int64), np.ones(len(some), bool))[1]
            at = to
        for i in np.flatnonzero(length > LONG).tolist():
            if self.n > MOST_TRANSITIONS:
                self.clear()
            out[i] = self.long_count(data[start[i] : start[i] + length[i]])
        return out


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    return out | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}


class TokenCounter:
    """Counts of a word-end byte-pair tokenizer file (lower case, NFC, white space dropped)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.merges = MergeTransducer(path)
        self.classes = char_classes(path)

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and how many of these it has."""
        parts, n = [text], 0
        if any(s in text for s in self.special):
            import re

            parts = re.split("|".join(map(re.escape, self.special)), text)
            n = len(parts) - 1
        return parts, n

    def counts(self, many: list[str]) -> np.ndarray:
        own, found, sizes = [], np.zeros(len(many), np.int64), []
        for i, text in enumerate(many):
            parts, found[i] = self.segments(text)
            size = 0
            for p in parts:
                # below U+0250 nothing composes, and lower case is a matter of one character
                p = p.lower() if p.isascii() or max(p) < "ɐ" else self.normalize(p)
                own.append(p)
                size += len(p) + 1
            sizes.append(size)
        joined = "\n".join(own) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = self.classes[points]
        starts = word_starts(classes)
        edges = np.flatnonzero(starts | (classes == SPACE))
        is_start = starts[edges]
        first, after = edges[:-1][is_start[:-1]], edges[1:][is_start[:-1]]  # the last edge is the final newline
        data = np.frombuffer(joined.encode(), np.uint8)
        if len(data) != len(points):
            at = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
            begin, end = at[first], at[after]
        else:
            begin, end = first, after
        tokens = self.merges.count(data, begin, end - begin)
        doc = np.searchsorted(np.cumsum(sizes), first, "right")
        return found + np.bincount(doc, tokens, len(many)).astype(np.int64)


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter a process."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). Nothing is shuffled.

    Null text: as empty, 0 bytes and tokens. Null ids and repeated rows stay. Texts of any length are counted whole, runs without blanks
    too. An empty table gives an empty result. Only doc_id and text are read.
    """

    def made(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        many = texts(batch)
        n = counter(tokenizer_path).counts(many)
        return {"n_bytes": pa.array([len(t.encode()) for t in many], pa.int64()), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}

    return with_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), made, schema(n_bytes="long", n_tokens="long", over_limit="boolean"), ["doc_id"])
