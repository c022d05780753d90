"""SimHash near-duplicates: tiled exact comparison of fingerprints with exclusive-or and bit counts.

Equal fingerprints are first collapsed to one row. Two fingerprints within ``radius`` bits agree wholly on at
least one of radius + 1 bit segments, so only rows that share a segment value meet; within a segment value the
rows are sorted by population count, cut into tiles, and tile pairs whose population counts differ by more than
the radius are skipped. Nothing is capped: a crowded value only makes more tiles, which are dealt out as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designmat.llm.common import components, cut, forest, named, runs, table, together

TILE = 16384


def fingerprint(text: str | None, words_each: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles; null, empty and wordless texts give 0."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    if len(w) < words_each:
        parts = [b" ".join(w)]
    else:
        whole, n = b" ".join(w), len(w)
        ends = np.cumsum([len(x) + 1 for x in w])
        starts = np.concatenate([[0], ends[:-1]])[: n - words_each + 1].tolist()
        parts = [whole[a:b] for a, b in zip(starts, (ends[words_each - 1 :] - 1).tolist(), strict=True)]
    h = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64, len(parts))
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        count += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """(doc_id, fp signed long) per row; extra columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, words_each) for t in b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def _links(x: pd.DataFrame, y: pd.DataFrame, radius: int) -> pd.DataFrame:
    fx, fy = x["fp"].to_numpy().view(np.uint64), y["fp"].to_numpy().view(np.uint64)
    ox, oy = x["own"].to_numpy(bool), y["own"].to_numpy(bool)
    a, b = [], []
    for i in range(0, len(fx), 256):
        hit = np.bitwise_count(fx[i : i + 256, None] ^ fy[None, :]) <= radius
        hit &= ox[i : i + 256, None] | oy[None, :]
        p, q = np.nonzero(hit)
        a.append(x["id"].to_numpy()[i + p])
        b.append(y["id"].to_numpy()[q])
    a, b = np.concatenate(a), np.concatenate(b)
    a, b = forest(a[a != b], b[a != b])
    return pd.DataFrame({"a": a, "b": b})


def link_components(fps: DataFrame, radius: int = 2, sized: bool = False) -> DataFrame:
    """(fp, cls, component_id): component_id is the smallest doc_id whose fingerprint is reachable by links.

    With ``sized`` only rows whose size classes (column cls) are equal or neighbours are compared."""
    reps = cut((fps if sized else fps.withColumn("cls", F.lit(0))).groupBy("fp", "cls").agg(F.min("doc_id").alias("id")).where("id is not null"))
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    segs = F.array(*[
        F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("val"))
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))
    ])
    # Each row meets its own class and, as a guest, the next one's rows; two guests don't compare there.
    blocks = F.array(*[F.struct((F.col("cls") + k).alias("block"), F.lit(k == 0).alias("own")) for k in range(1 + sized)])
    rows = reps.select("id", "fp", F.expr("bit_count(fp)").cast("int").alias("pop"), F.explode(blocks).alias("b")).select("id", "fp", "pop", "b.*")
    rows = rows.select("id", "fp", "pop", "block", "own", F.explode(segs).alias("s")).select("id", "fp", "pop", "own", "s.seg", F.struct("block", "s.val").alias("at"))
    rows = rows.select("id", "fp", "pop", "own", "seg", F.xxhash64("at").alias("val"))  # values that share a hash only compare more
    sizes = rows.groupBy("seg", "val").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["seg", "val"])
    plain = rows.where(F.col("n") <= TILE)

    def links(keys: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in runs(batches, keys):
                yield tiled(g, radius)

        return run

    small = together(plain, "seg", "val").mapInPandas(links(["seg", "val"]), "a long, b long")
    # Crowded segment values: rows are dealt to tiles, each pair of tiles to one task.
    big = rows.where(F.col("n") > TILE).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    big = big.withColumn("t", F.expr("cast(pmod(xxhash64(fp), tiles) as int)"))
    big = big.withColumn("o", F.explode(F.expr("sequence(0, tiles - 1)"))).withColumn("ti", F.least("t", "o")).withColumn("tj", F.greatest("t", "o"))
    pair = ["seg", "val", "ti", "tj"]
    large = together(big, *pair).mapInPandas(links(pair), "a long, b long")
    comp = components(small.unionByName(large))
    return reps.join(comp, reps["id"] == comp["node"], "left").select("fp", "cls", F.coalesce("component", "id").alias("component_id"))


def tiled(g: pd.DataFrame, radius: int, tile: int = 512) -> pd.DataFrame:
    """Links of one segment value: popcount-sorted tiles, skipping pairs of tiles too far apart in population count."""
    g = g.sort_values("pop", kind="stable")
    parts = [g.iloc[i : i + tile] for i in range(0, len(g), tile)]
    out = [
        _links(x, y, radius)
        for i, x in enumerate(parts)
        for j, y in enumerate(parts[i:], i)
        if y["pop"].iloc[0] - x["pop"].iloc[-1] <= radius
    ]
    out = pd.concat(out)
    a, b = forest(out["a"].to_numpy(np.int64), out["b"].to_numpy(np.int64))
    return pd.DataFrame({"a": a, "b": b})


def near_duplicates(docs: DataFrame, radius: int = 2, words_each: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; one row per input row, null doc_ids keep a null component."""
    fps = cut(fingerprints(docs, words_each))
    comp = link_components(fps, radius).drop("cls")
    return fps.join(comp, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


BINS, NONE = 256, 0xFFFF


def sketch(text: str | None, words_each: int = 5, seed: int = 43) -> tuple[bytes, int]:
    """One-permutation MinHash of the set of word shingles, the least hash of each of 256 bins in two bytes, and the
    size of the set."""
    w = (text or "").encode().lower().split()
    parts = {b" ".join(x) for x in zip(*(w[i:] for i in range(words_each)), strict=False)} if len(w) >= words_each else {b" ".join(w)} if w else set()
    out = np.full(BINS, NONE, np.uint16)
    if parts:
        h = np.sort(np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64, len(parts)))
        bins, first = np.unique(h >> np.uint64(56), return_index=True)
        out[bins.astype(np.int64)] = np.minimum(h[first] & np.uint64(0xFFFF), NONE - 1)
    return out.tobytes(), len(parts)


def shingle_hashes(text: str | None, words_each: int = 5, seed: int = 43) -> np.ndarray:
    """Sorted four-byte hashes of the set of word shingles; a shorter text is one shingle, a wordless one has none."""
    w = (text or "").encode().lower().split()
    parts = {b" ".join(x) for x in zip(*(w[i:] for i in range(words_each)), strict=False)} if len(w) >= words_each else {b" ".join(w)} if w else set()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, seed) >> 32 for p in parts), np.uint32, len(parts)))


def _alike(x: pd.DataFrame, y: pd.DataFrame, radius: int, similarity: float) -> pd.DataFrame:
    """Links of two tiles as spanning stars. Sketches decide where they are three standard errors off the
    similarity; in between, pairs that aren't joined yet are decided by their whole shingle sets."""
    fx, fy = x["fp"].to_numpy().view(np.uint64), y["fp"].to_numpy().view(np.uint64)
    sx, sy = (np.stack([np.frombuffer(v, np.uint16) for v in t["sketch"]]) for t in (x, y))
    ix, iy = x["id"].to_numpy(), y["id"].to_numpy()
    full_y, a, b, unsure = sy != NONE, [], [], []
    for i in range(len(fx)):
        near = np.flatnonzero((np.bitwise_count(fx[i] ^ fy) <= radius) & (iy != ix[i]))
        if len(near):
            used = ((sx[i] != NONE) | full_y[near]).sum(1)
            share = ((sy[near] == sx[i]) & full_y[near]).sum(1) / np.maximum(used, 1)
            margin = 3 * np.sqrt(similarity * (1 - similarity) / np.maximum(used, 1))
            sure = (share >= similarity + margin) | (used == 0)
            a.append(np.full(sure.sum(), ix[i]))
            b.append(iy[near[sure]])
            unsure += [(i, j) for j in near[~sure & (share >= similarity - margin)].tolist()]
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
    a, b = forest(a, b)
    top = dict(zip(a.tolist(), b.tolist(), strict=True))
    more = []

    def find(k: int) -> int:
        while k in top:
            k = top[k]
        return k

    hashes = lambda t, k: np.frombuffer(t["hashes"].iloc[k], np.uint32)
    for i, j in unsure:
        p, q = sorted((find(int(ix[i])), find(int(iy[j]))))
        if p != q:
            hx, hy = hashes(x, i), hashes(y, j)
            both = len(np.intersect1d(hx, hy, assume_unique=True))
            if both >= similarity * (len(hx) + len(hy) - both):
                top[q] = p
                more.append((p, q))
    out = pd.DataFrame({"a": a, "b": b})
    return pd.concat([out, pd.DataFrame(more, columns=["a", "b"])]).astype(np.int64) if more else out.astype(np.int64)


def surplus(docs: DataFrame, radius: int = 11, similarity: float = 0.8, tile: int = 1024) -> DataFrame:
    """(doc_id) of all documents but the smallest of each group of near copies.

    Groups are joined by links: fingerprints of three-word shingles within ``radius`` and sets of five-word
    shingles alike to ``similarity``. Fingerprint links of documents of like size first give coarse groups; sketches
    and, where they leave doubt, whole sets are compared only within these, in tiles. Documents without words are
    copies of each other; null doc_ids never appear.
    """
    step = np.log(1 / similarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((fingerprint(t) for t in b["text"]), np.uint64, len(b))
            made = [sketch(t) for t in b["text"]]
            cls = [int(np.log(n) / step) if n else -1 for _, n in made]
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64), "cls": cls, "sketch": [v for v, _ in made]})

    docs = docs.where("doc_id is not null").select("doc_id", "text")
    rows = cut(docs.mapInPandas(run, "doc_id long, fp long, cls int, sketch binary"))
    reps = cut(rows.groupBy("fp", "cls", "sketch").agg(F.min("doc_id").alias("id")))
    coarse = cut(reps.join(link_components(rows.select("doc_id", "fp", "cls"), radius, sized=True), ["fp", "cls"]).select("component_id", "id", "fp", "sketch"))
    sizes = coarse.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(hashes=[shingle_hashes(t).tobytes() for t in b["text"]])

    found = coarse.join(sizes, "component_id").join(docs.withColumnRenamed("doc_id", "id"), "id").select("component_id", "tiles", "id", "fp", "sketch", "text")
    dealt = found.mapInPandas(hashed, "component_id long, tiles int, id long, fp long, sketch binary, hashes binary")
    dealt = dealt.withColumn("t", F.expr("cast(pmod(xxhash64(id), tiles) as int)"))
    dealt = dealt.withColumn("o", F.explode(F.expr("sequence(0, tiles - 1)"))).withColumn("ti", F.least("t", "o")).withColumn("tj", F.greatest("t", "o"))
    keys = ["component_id", "ti", "tj"]

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, keys):
            left = (g["t"] == g["ti"]).to_numpy()
            x = g[left]
            y = x if g["ti"].iloc[0] == g["tj"].iloc[0] else g[~left]
            if len(x) and len(y):
                yield _alike(x, y, radius, similarity)

    edges = together(dealt.select(*keys, "t", "id", "fp", "sketch", "hashes"), *keys).mapInPandas(check, "a long, b long")
    gone = components(edges).where("node <> component").select(F.col("node").alias("doc_id"))
    copies = rows.join(reps, ["fp", "cls", "sketch"]).where("doc_id <> id").select("doc_id")
    return copies.unionByName(gone).distinct()


def one_of_each(docs: DataFrame, radius: int = 11, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: one document of each group stays; rows that repeat a doc_id are one document, of
    which one row stays. Rows without a doc_id stay. Columns may have any names."""
    gone = cut(surplus(docs, radius, similarity))
    all_ = [named(c) for c in docs.columns]
    kept = docs.join(gone, "doc_id", "left_anti").select(all_)
    again = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").select(all_).unionByName(once.select(all_))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
