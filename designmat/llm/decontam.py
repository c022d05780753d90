"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

An alignment that reaches the limit leaves at least a certain number of an item's n-grams whole (see ``shared``), so
of its g n-grams any g - shared + 1 hold one that such an alignment meets. The document frequency of the n-grams is
counted over the whole corpus, and the rarest that many are the item's seeds: none of the alignments is lost. Where
a seed meets a document, and the words around it hold as many of the item's n-grams as they must, the item is
aligned with them. Benchmark items go to the tasks in blocks of bounded size; a larger benchmark takes more passes
over the corpus, never more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designmat.llm.common import table

SIGNS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation; null gives none."""
    return (text or "").lower().encode().translate(SIGNS).split()


def shared(size: int, n: int, least: float) -> int:
    """How many n-grams of an item of ``size`` words any alignment of score ``least`` x size leaves whole, at least.

    A mismatch or a word left out lowers the score by 2 and breaks n of them, an inserted word lowers it by 1 and
    breaks n - 1, and so does a word beyond the alignment's ends, which breaks one more.
    """
    return int(np.ceil(size - n + 1 - (1 - least) * size * max(n / 2, n - 1, 1) - 1e-9))


class Items:
    """A block of benchmark items as word numbers, with their n-grams of all lengths up to n that can be seeds."""

    def __init__(self, rows: list[tuple[int, str | None]], n: int, least: float):
        self.ids = [i for i, _ in rows]
        split = [words(t) for _, t in rows]
        self.vocab = {w: k for k, w in enumerate(dict.fromkeys(w for s in split for w in s))}
        self.words = [np.array([self.vocab[w] for w in s], np.int64) for s in split]
        self.reach = [int((1 - least) * len(w)) + 1 for w in self.words]  # words that an alignment can insert
        self.lengths = [[q for q in range(2, n + 1) if shared(len(w), q, least) > 0] or [1] for w in self.words]
        self.must = [max(1, shared(len(w), ls[0], least)) for w, ls in zip(self.words, self.lengths, strict=True)]
        self.least = least
        grams = [self.grams(w, q) for w, ls in zip(self.words, self.lengths, strict=True) for q in ls]
        self.known = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.int64)
        self.sizes = sorted({q for ls in self.lengths for q in ls})

    @staticmethod
    def grams(ids: np.ndarray, n: int) -> np.ndarray:
        """Hash of each n words in a row; -1 where one of them is no benchmark word."""
        m = len(ids) - n + 1
        if m <= 0:
            return np.empty(0, np.int64)
        h, ok = np.full(m, n, np.uint64), np.ones(m, bool)
        for k in range(n):
            part = ids[k : k + m]
            ok &= part >= 0
            h = h * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1)
            h ^= h >> np.uint64(29)
        return np.where(ok, (h >> np.uint64(1)).astype(np.int64), -1)

    def numbers(self, text: str | None) -> np.ndarray:
        w = words(text)
        return np.fromiter((self.vocab.get(x, -1) for x in w), np.int64, len(w))

    def keep(self, gram: np.ndarray, often: np.ndarray) -> None:
        """Seeds: the rarest n-grams of each item, as many as it takes for no alignment to miss them all; of its
        lengths the one whose seeds are met least often. n-grams of no document meet nothing and are left out."""
        order = np.argsort(gram)
        gram, often = gram[order], often[order]
        seeds = []
        for k, w in enumerate(self.words):
            best = None
            for q in self.lengths[k] if len(w) else []:
                g = self.grams(w, q)
                at = np.minimum(np.searchsorted(gram, g), max(len(gram) - 1, 0))
                n = np.where(gram[at] == g, often[at], 0) if len(gram) else np.zeros(len(g), np.int64)
                use = np.argsort(n, kind="stable")[: len(g) - max(1, shared(len(w), q, self.least)) + 1]
                if best is None or n[use].sum() <= best[0]:
                    use = use[n[use] > 0]
                    best = n[use].sum(), g[use], use
            if best:
                seeds.append((best[1], np.full(len(best[1]), k), best[2]))
        self.gram, self.item, self.at = (np.concatenate(x).astype(np.int64) if seeds else np.empty(0, np.int64) for x in (zip(*seeds, strict=True) if seeds else [()] * 3))
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.at = self.gram[order], self.item[order], self.at[order]

    def windows(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first word, end) of the stretches of a document that hold seeds of an item and enough of its n-grams."""
        hits, grams = [], {n: self.grams(ids, n) for n in self.sizes}
        for g in grams.values():
            p = np.flatnonzero(g >= 0)
            lo, hi = np.searchsorted(self.gram, g[p], "left"), np.searchsorted(self.gram, g[p], "right")
            for i, a, b in zip(p[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                hits += [(int(self.item[j]), i - int(self.at[j])) for j in range(a, b)]
        out: list[tuple[int, int, int]] = []
        for item, start in sorted(set(hits)):
            size = len(self.words[item])
            a, b = max(0, start - self.reach[item]), min(len(ids), start + size + self.reach[item])
            if out and out[-1][0] == item and a <= out[-1][2]:
                out[-1] = (item, out[-1][1], max(b, out[-1][2]))
            else:
                out.append((item, a, b))
        return [x for x in out if self.enough(grams[self.lengths[x[0]][0]], *x)]

    def enough(self, grams: np.ndarray, item: int, a: int, b: int) -> bool:
        n = self.lengths[item][0]
        return int(np.isin(self.grams(self.words[item], n), grams[a : b - n + 1]).sum()) >= self.must[item]


def align(item: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of an item against each row, and the end of each best alignment.

    A match counts 1, a mismatch and a gap -1. Rows are filled line by line; gaps along the line come from a
    running maximum, so a whole batch moves at once.
    """
    k, m = rows.shape
    slope = np.arange(m + 1, dtype=np.int32)
    above, best, end = np.zeros((k, m + 1), np.int32), np.zeros(k, np.int32), np.zeros(k, np.int64)
    for w in item:
        line = np.zeros((k, m + 1), np.int32)
        line[:, 1:] = np.maximum(above[:, :-1] + np.where(rows == w, 1, -1), above[:, 1:] - 1)
        np.maximum(line, 0, out=line)
        line = np.maximum.accumulate(line + slope, axis=1) - slope
        top = line.max(axis=1)
        better = top > best
        end[better] = line[better].argmax(axis=1)
        best = np.maximum(best, top)
        above = line
    return best, end


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str | None]]]:
    held, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        if held and size + len(r["text"] or "") > most:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += len(r["text"] or "") + 50
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, least: float = 0.6, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, score (share of the item's own score), matched words score as n_score, end_word; one row
    for each document row and item whose alignment reaches ``least``.

    Null and empty texts and items match nothing; n is the greatest length of a seed; repeated rows give repeated
    results. Documents are only mapped: no row of the corpus is shuffled.
    """
    docs, out = docs.select("doc_id", "text"), None
    for rows in _blocks(benchmark, block_chars):
        items = Items(rows, n, least)

        def count(batches: Iterator[pd.DataFrame], items: Items = items) -> Iterator[pd.DataFrame]:
            known = items.known
            total = np.zeros(len(known), np.int64)
            for b in batches:
                for t in b["text"]:
                    ids = items.numbers(t)
                    for size in items.sizes:
                        g = items.grams(ids, size)
                        g = np.unique(g[g >= 0])
                        at = np.searchsorted(known, g)
                        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == g)] if len(known) else at[:0]
                        total[at] += 1
            yield pd.DataFrame({"gram": known[total > 0], "n": total[total > 0]})

        often = docs.mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most the block's n-grams
        items.keep(often["gram"].to_numpy(), often["n"].to_numpy())

        def find(batches: Iterator[pd.DataFrame], items: Items = items) -> Iterator[pd.DataFrame]:
            for b in batches:
                todo: dict[tuple[int, int], list] = {}
                for row, (doc, t) in enumerate(zip(b["doc_id"], b["text"], strict=True)):
                    ids = items.numbers(t)
                    for item, lo, hi in items.windows(ids):
                        todo.setdefault((item, max(16, 1 << (hi - lo - 1).bit_length())), []).append((row, doc, lo, ids[lo:hi]))
                best: dict[tuple[int, int], tuple] = {}
                for (item, width), found in todo.items():
                    step = max(1, 2_000_000 // width)
                    for i in range(0, len(found), step):
                        part = found[i : i + step]
                        grid = np.full((len(part), width), -2, np.int64)
                        for k, (_, _, _, ids) in enumerate(part):
                            grid[k, : len(ids)] = ids
                        score, end = align(items.words[item], grid)
                        for (row, doc, lo, _), s, e in zip(part, score.tolist(), end.tolist(), strict=True):
                            if s >= least * len(items.words[item]) and s > best.get((row, item), (0, 0))[1]:
                                best[row, item] = (doc, s, lo + e)
                rows = [(d, items.ids[item], s / len(items.words[item]), s, e) for (_, item), (d, s, e) in sorted(best.items())]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "n_score", "end_word"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

        hits = docs.mapInPandas(find, "doc_id long, item_id long, score double, n_score int, end_word long")
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, n_score int, end_word long")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
