"""Exact BPE: backtracking encoder over Aho-Corasick longest matches, and offset-table decoding.

A sequence of tokens is the BPE encoding of a text exactly if each adjacent pair is compatible (no merge of the
merge list would have crossed their border before either was complete). The encoder takes the longest token
that starts at a place, steps back to shorter ones where a pair is incompatible, and marks places it has left,
so each place is left once and the whole is linear in the text.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from designmat.llm.common import table
from designmat.llm.signs import OTHER, PATTERNS, Signs


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    at = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [at[b] for b in range(256)]


class Vocabulary:
    """Tokens, merges and the pair-compatibility table of a tokenizers BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = {i: t for t, i in (self.ids | self.special).items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b, c = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[a, b] = r
            self.parts.setdefault(c, (a, b))
        self.born = {c: self.rank[p] for c, p in self.parts.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.spines: tuple[dict[int, list], dict[int, list]] = {}, {}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """(subtoken, rank at which it is used up) along the right (1) or left (0) edge of a token."""
        out = self.spines[side].get(token)
        if out is None:
            out, dies, at = [], float("inf"), token
            while at in self.parts:
                out.append((at, dies))
                dies, at = self.born[at], self.parts[at][side]
            out.append((at, dies))
            self.spines[side][token] = out
        return out

    def compatible(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            left, rank, known = self.spine(b, 0), self.rank, True
            for x, dx in self.spine(a, 1):
                for y, dy in left:
                    r = rank.get((x, y))
                    if r is not None and r < dx and r <= dy:
                        known = False
            self.fits[a, b] = known
            if len(self.fits) > 2_000_000:
                self.fits.clear()
        return known


class Encoder:
    """Encodes pre-tokenised words (as byte letters plus word end) by backtracking."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        # Words are encoded as a row of symbols; the word-end mark is one symbol joined to the last letter.
        self.end = "\x00" if vocab.suffix else ""
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.spell: dict[int, str] = {}
        self.token: dict[str, int] = {}
        for t, i in vocab.ids.items():
            s = t[: -len(vocab.suffix)] + self.end if vocab.suffix and t.endswith(vocab.suffix) and len(t) > len(vocab.suffix) else t
            self.spell[i], self.token[s] = s, i
            self.machine.add_word(s[::-1], i)
        self.machine.make_automaton()
        self.size = {i: len(s) for i, s in self.spell.items()}
        self.less: dict[int, int] = {}

    def starts(self, s: str) -> list[int]:
        """The longest token that starts at each place: the automaton runs over the reversed text."""
        n, found = len(s), [-1] * len(s)
        for at, i in self.machine.iter(s[::-1]):
            p = n - 1 - at
            if found[p] < 0:  # the automaton gives the longest match of each place first
                found[p] = i
        return found

    def shorter(self, token: int) -> int:
        """The next shorter token that is a prefix of this one, or -1."""
        known = self.less.get(token)
        if known is None:
            s = self.spell[token]
            known = self.less[token] = next((i for k in range(len(s) - 1, 0, -1) if (i := self.token.get(s[:k], -1)) >= 0), -1)
        return known

    def encode(self, word: str) -> list[int]:
        s = word + self.end
        longest, n = self.starts(s), len(s)
        out: list[int] = []
        at, dead, nxt = 0, bytearray(n + 1), longest[0]
        while True:
            while nxt >= 0:
                to = at + self.size[nxt]
                # the word-end mark belongs to the last letter and is no token of its own
                if not dead[to] and not (self.end and to == n - 1) and (not out or self.v.compatible(out[-1], nxt)):
                    break
                nxt = self.shorter(nxt)
            if nxt >= 0:
                out.append(nxt)
                at = to
                if at == n:
                    return out
                nxt = longest[at]
            else:
                if not out:
                    raise ValueError("text has symbols outside the vocabulary")
                dead[at] = 1
                last = out.pop()
                at -= self.size[last]
                nxt = self.shorter(last)


SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
OWN = [(k, regex.compile(p)) for k, p in PATTERNS]


class Memo(dict):
    """Words already encoded: ids as packed integers, or as decimal text; bounded by being emptied between texts."""

    def __init__(self, make, limit: int = 500_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, w: str):
        made = self.make(w)
        if len(w) <= self.longest:
            self[w] = made
        return made

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


class WordCodec:
    """Encoding and decoding with a lower-casing word-end vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.v = Vocabulary(path)
        self.enc = Encoder(self.v)
        self.normal = Tokenizer.from_file(path).normalizer
        self.signs = Signs()
        self.agree: set[str] = set(map(chr, range(128)))  # signs that the pattern's own classes are right for
        self.letters = byte_letters()
        self.ids = Memo(lambda w: array("i", self.word(w)).tobytes())
        self.texts = Memo(lambda w: " ".join(map(str, array("i", self.ids[w]))))
        size = max(self.v.words) + 1
        words = [(self.v.words.get(i, "") + " ").encode() for i in range(size)]
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(w) for w in words])])

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text; a special string gives itself after a zero sign."""
        out: list[str] = []
        for part in self.v.split_special.split(text) if "<|" in text else (text,):
            if part in self.v.special:
                out.append(f"\0{part}")
                continue
            if part.isascii():
                out += SPLIT.findall(part.lower())
            else:  # case, composition and classes beyond ASCII are the library's own
                part = self.normal.normalize_str(part)
                out += SPLIT.findall(part) if self.agree.issuperset(part) or self.same(part) else self.signs.split(SPLIT, part)
        return out

    def same(self, part: str) -> bool:
        """Whether the pattern's own classes of all signs are the library's."""
        new = sorted(set(part) - self.agree)
        kinds = self.signs.of(np.array(list(map(ord, new)), np.uint32))
        for sign, kind in zip(new, kinds.tolist(), strict=True):
            if kind == next((k for k, p in OWN if p.match(sign)), OTHER):
                self.agree.add(sign)
        return self.agree.issuperset(new)

    def word(self, w: str) -> list[int]:
        if w[0] == "\0" and w[1:] in self.v.special:
            return [self.v.special[w[1:]]]
        return self.enc.encode("".join(map(self.letters.__getitem__, w.encode())))

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a whole text; null and empty give none; special strings become their ids."""
        self.ids.trim()
        return np.frombuffer(b"".join(map(self.ids.__getitem__, self.words(text or ""))), np.int32)

    def encode_text(self, text: str | None) -> tuple[np.ndarray, str]:
        """Ids, and their decimal numbers joined by one space."""
        words = self.words(text or "")
        self.ids.trim()
        self.texts.trim()
        ids = np.frombuffer(b"".join(map(self.ids.__getitem__, words)), np.int32)
        return ids, " ".join(map(self.texts.__getitem__, words))

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' own strings with one space between them, gathered from the offset table."""
        if not len(ids):
            return b""
        start = self.offset[ids]
        size = self.offset[ids + 1] - start
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        return self.blob[at][:-1].tobytes()


@lru_cache(maxsize=2)
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row; null texts count as empty, other columns are ignored.

    ``path`` is opened on each executor; by default it is looked up there, so nothing is sent along.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = word_codec(path or default_path("word_bpe_49k.json"))
        for b in batches:
            rows = []
            for t in b["text"]:
                ids, text = codec.encode_text(t)
                rows.append((len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
