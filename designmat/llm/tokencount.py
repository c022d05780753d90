"""Token counts by finite-state transducers.

Two deterministic machines: one over character classes that finds where pre-tokens begin, one over bytes whose
transitions carry the number of tokens they add. The first has a dozen states, so each chunk of a batch of texts
becomes a map from entry state to leaving state; the maps compose by a parallel prefix scan, and a second look at
each chunk from its known entry state places the borders. Each border takes the second machine back to its start
state, so its chunks are cut at borders and their maps have one entry: all chunks of a batch are run side by side
through one transition table, the counts on the transitions are kept by place, and a prefix sum over them gives
the tokens of every text. The table is compiled as transitions are met and is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from designmat.llm.bpe import Vocabulary, byte_letters, default_path
from designmat.llm.common import table
from designmat.llm.signs import LETTER, NUMBER, OTHER, SPACE, Signs

# Character classes. R, V, E, L, and STMD are the letters that contractions are spelt with.
BLANK, QUOTE, STMD, R_, V_, E_, L_, END = 3, 5, 6, 7, 8, 9, 10, 11
# States: at a text's start; in letters, numbers, others; after a run of white space (one or more signs, the last a
# blank or not); after a quote that begins a pre-token, and it with r, v or l; after a whole contraction.
START, LET, NUM, OTH, B1, S1, B2, S2, Q, QR, QV, QL, DONE = range(13)


def machine() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and border bits (1: before this sign, 2: before the one before it)."""
    nxt, out = np.zeros((13, 12), np.uint8), np.zeros((13, 12), np.uint8)
    kind = [LET, NUM, OTH, B1, S1, Q, LET, LET, LET, LET, LET, START]
    for s in range(13):
        for c in range(12):
            begin, bits = kind[c], 1
            word = begin == LET
            if c == END:
                begin, bits = START, 2 if s in (QR, QV, QL) else 0
            elif s == LET and word or s == NUM and c == NUMBER:
                bits = 0
            elif s == OTH and c in (OTHER, QUOTE):
                begin, bits = OTH, 0
            elif s in (B1, S1, B2, S2):
                if c in (BLANK, SPACE):
                    begin, bits = (B2, 0) if c == BLANK else (S2, 0)
                else:
                    glued = s in (B1, B2)
                    if glued:  # the blank begins the next pre-token, in which a quote is no contraction
                        begin = OTH if c == QUOTE else begin
                    bits = (0 if glued else 1) | (2 if s in (B2, S2) else 0)
            elif s == Q:
                if c == STMD:
                    begin, bits = DONE, 0
                elif c in (R_, V_, L_):
                    begin, bits = {R_: QR, V_: QV, L_: QL}[c], 0
                elif c in (OTHER, QUOTE):
                    begin, bits = OTH, 0
            elif s in (QR, QV, QL):
                if c == (L_ if s == QL else E_):
                    begin, bits = DONE, 0
                else:
                    bits = 2 if word else 3
            nxt[s, c], out[s, c] = begin, bits
    return nxt, out


@lru_cache(maxsize=1)
def classes() -> Signs:
    """Class of each code point."""
    own = {" ": BLANK, "'": QUOTE, "r": R_, "v": V_, "e": E_, "l": L_}
    return Signs(own | dict.fromkeys("stmd", STMD))


def borders(kinds: np.ndarray, chunk: int = 256) -> np.ndarray:
    """True where a pre-token begins, for class codes of texts that each end with END."""
    nxt, out = machine()
    n = len(kinds)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, END, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    flat, states = nxt.ravel(), np.tile(np.arange(13, dtype=np.uint8), (rows, 1))
    for col in grid:
        states = flat[states.astype(np.intp) * 12 + col[:, None]]
    step = 1
    while step < rows:  # inclusive scan: the map of chunks 0..i
        states[step:] = np.take_along_axis(states[step:], states[:-step].astype(np.intp), axis=1)
        step *= 2
    now = np.concatenate([[START], states[:-1, START]]).astype(np.intp)
    bits = np.empty((chunk, rows), np.uint8)
    flat_out = out.ravel()
    for i, col in enumerate(grid):
        at = now * 12 + col
        bits[i] = flat_out[at]
        now = flat[at].astype(np.intp)
    bits = bits.T.ravel()[:n]
    begins = (bits & 1).astype(bool)
    begins[:-1] |= (bits[1:] & 2).astype(bool)
    return begins


class Transducer:
    """Counts tokens byte by byte.

    A state holds, for each place whose suffix may still grow into a token, the trie node reached from it, the
    token that ends there and the token count there relative to now; equal states merge whatever text led there.
    State 0 is the start.
    """

    LIMIT = 200_000  # states kept from batch to batch
    CHUNK, LONG = 256, 512

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        back = {c: b for b, c in enumerate(byte_letters())}
        trie: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for t, i in vocab.ids.items():
            if t in vocab.special:
                continue
            node = 0
            for b in (back[c] for c in t):
                if b not in trie[node]:
                    trie[node][b] = len(trie)
                    trie.append({})
                    ends.append(-1)
                node = trie[node][b]
            ends[node] = i
        # byte -> (node reached, token that ends there or -1, whether it grows further), by node
        self.trie = [{b: (to, ends[to], bool(trie[to])) for b, to in node.items()} for node in trie]
        self.reset()

    def reset(self) -> None:
        first = ((0, -1, 0),)
        self.key, self.state = [first], {first: 0}
        self.used, self.bits = 0, 16
        self.table()

    def table(self) -> None:
        """An empty table of transitions: place of 256 x state + byte by hashing, state reached, tokens added."""
        size = 1 << self.bits
        self.step, self.to, self.plus = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int8)

    def places(self, step: np.ndarray) -> np.ndarray:
        """Where each transition stands in the table, or the free place it would take."""
        mask = (1 << self.bits) - 1
        at = (step * 0x9E3779B1 >> 7) & mask
        held = self.step[at]
        off = np.flatnonzero((held != step) & (held >= 0))
        while len(off):
            at[off] = (at[off] + 1) & mask
            held = self.step[at[off]]
            off = off[(held != step[off]) & (held >= 0)]
        return at

    def enter(self, step: int, to: int, plus: int) -> None:
        if self.used * 2 >= len(self.step):
            steps, tos, adds = (x[self.step >= 0] for x in (self.step, self.to, self.plus))
            self.bits += 2
            self.table()
            while len(steps):  # those that want one free place take turns
                at = self.places(steps)
                first = np.unique(at, return_index=True)[1]
                self.step[at[first]], self.to[at[first]], self.plus[at[first]] = steps[first], tos[first], adds[first]
                steps, tos, adds = (np.delete(x, first) for x in (steps, tos, adds))
        mask = len(self.step) - 1
        at = (step * 0x9E3779B1 >> 7) & mask
        held = self.step.item(at)
        while held >= 0 and held != step:
            at = (at + 1) & mask
            held = self.step.item(at)
        self.used += held < 0
        self.step[at], self.to[at], self.plus[at] = step, to, plus

    def move(self, key: tuple, b: int) -> tuple[tuple, int]:
        """The state after one more byte, and the tokens it adds."""
        trie, fits = self.trie, self.v.fits
        live, token, plus = [], -1, 0
        for node, last, rel in key:
            hit = trie[node].get(b)
            if hit is None:
                continue
            to, t, grows = hit
            if t >= 0 and token < 0:
                ok = last < 0 or fits.get((last, t))
                if ok or ok is None and self.v.compatible(last, t):
                    token, plus = t, rel + 1
            if grows:
                live.append((to, last, rel))
        if plus:
            live = [(x, y, r - plus) for x, y, r in live]
        live.append((0, token, 0))
        return tuple(live), plus

    def compile(self, s: int, b: int) -> tuple[int, int]:
        """Enter the transition from state s by byte b; the state it leads to and the tokens it adds."""
        key, plus = self.move(self.key[s], b)
        to = self.state.get(key)
        if to is None:
            to = self.state[key] = len(self.key)
            self.key.append(key)
        self.enter(s * 256 + b, to, plus)
        return to, plus

    def counts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The tokens that each byte adds; at places where a pre-token begins the machine starts anew."""
        if len(self.key) > self.LIMIT:
            self.reset()
        n = len(data)
        out = np.zeros(n, np.int8)
        marks = np.append(np.flatnonzero(begins), n)
        long = np.diff(marks) > self.LONG
        for a, b in zip(marks[:-1][long].tolist(), marks[1:][long].tolist(), strict=True):
            key = self.key[0]
            for i, x in enumerate(data[a:b].tolist(), a):  # without keeping its states
                key, out[i] = self.move(key, x)
        skip = marks[:-1][long]
        starts = marks[np.searchsorted(marks, np.arange(0, n, self.CHUNK))]
        starts = np.unique(np.concatenate([[0], starts, skip, marks[1:][long]]))
        starts = starts[starts < n]
        width = np.diff(np.append(starts, n))
        order = np.argsort(-width, kind="stable")  # the longest first
        order = order[~np.isin(starts[order], skip)]
        starts, width = starts[order], width[order]
        state = np.zeros(len(starts), np.int64)
        running = len(starts)
        for i in range(int(width[0]) if running else 0):
            while width[running - 1] <= i:
                running -= 1
            at = starts[:running] + i
            step = np.where(begins[at], 0, state[:running] << 8) + data[at]
            place = self.places(step)
            new = self.step[place] < 0
            if new.any():
                for x in dict.fromkeys(step[new].tolist()):
                    self.compile(x >> 8, x & 255)
                place = self.places(step)
            out[at] = self.plus[place]
            state[:running] = self.to[place]
        return out


class Counter:
    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.bytes = Transducer(self.v)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings count one each and part the text around them."""
        parts, owner, extra = [], [], [0] * len(texts)
        for k, t in enumerate(texts):
            bits = self.v.split_special.split(t) if "<|" in t else [t]
            for p in bits:
                if p in self.v.special:
                    extra[k] += 1
                elif p:
                    parts.append(p)
                    owner.append(k)
        start = 0
        while start < len(parts):  # about a million signs at a time, whole texts
            stop, size = start, 0
            while stop < len(parts) and (stop == start or size + len(parts[stop]) < 1_000_000):
                size += len(parts[stop])
                stop += 1
            self._batch(parts[start:stop], owner[start:stop], extra)
            start = stop
        return extra

    def _batch(self, parts: list[str], owner: list[int], total: list[int]) -> None:
        joined = "\0".join(parts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = classes().of(points)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        kinds[ends] = END
        first = borders(kinds)
        first[ends] = True
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.cumsum(width) - width  # of each sign among the bytes
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        begins = np.zeros(len(data), bool)
        begins[place[first]] = True
        sums = np.cumsum(self.bytes.counts(data, begins), dtype=np.int64)
        at = place[ends]  # the mark after each part, which counts for none
        upto, mark = sums[at - 1], np.concatenate([[0], sums[at[:-1]]])
        for k, c in zip(owner, (upto - mark).tolist(), strict=True):
            total[k] += c


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row; a null text counts as empty; extra columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(path or default_path("byte_bpe_50k.json"))
        for b in batches:
            texts = [t or "" for t in b["text"]]
            n = np.array(c.counts(texts), np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": n > limit})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
