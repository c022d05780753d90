"""Embedding near-duplicates by sorted projection passes.

Each pass hashes every vector by the signs of seeded random projections, concatenated to one key, and orders all
vectors by it; a vector is compared with a bounded window of neighbours in that order, in double precision. Links
found in any pass are united. The window only has to join a group: once its members are known, the links inside
a group are counted exactly, tile of members against tile, so a large group loses none of its links.

Two vectors at an angle a agree in a sign with probability 1 - a / pi, and meet in a pass when they agree in about the
log2(rows / window) signs that narrow the order down to a window. The number of passes follows from this, with two
signs to spare, so that a lone pair right at the threshold is met with the same probability whatever the number of
rows. In a crowded direction more signs would be needed: vectors that agree in all counted signs with the one a
whole window away, in any of a few probing passes, are compared with each other exactly, tile against tile. A pair
with one end outside the crowd is met from that end. Neighbours on either side of a partition's edge are not
compared in that pass; where partitions hold few rows the passes are counted for a window of a quarter of them, so
that few pairs are lost to edges. Copies of one vector are one class throughout; a class with very many copies gets
its outcome by broadcast, all others by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designmat.llm.common import components, cut, forest, runs, table, together

TILE = 256
BLOCK = 256
PROBES = 4


def passes_for(rows: int, threshold: float, window: int, recall: float) -> int:
    """Passes after which a pair at the threshold has met with probability ``recall``; 4 at least."""
    agree = 1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi
    meet = agree ** max(0.0, np.log2(max(rows, 1) / window))
    return max(4, int(np.ceil(np.log(1 - recall) / np.log(1 - meet)))) if meet < 1 else 4


def neighbours(x: np.ndarray, old: int, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j <= i + window, j not before ``old``, of rows whose product is at least the threshold.

    Products in single precision tell most pairs; those within its error of the threshold are told in double."""
    a, b, rough = [], [], x.astype(np.float32)
    error = 2e-7 * (x.shape[1] + 4)
    for i in range(0, len(x), BLOCK):
        top = min(i + BLOCK, len(x))
        lo = max(i, old)
        near = rough[i:top] @ rough[lo : top + window].T
        p, q = np.nonzero(near >= np.float32(threshold - error))
        sure = near[p, q] >= threshold + error
        p, q = p + i, q + lo
        fine = (p < q) & (q <= p + window)
        doubt = np.flatnonzero(fine & ~sure)
        fine[doubt] = np.einsum("ij,ij->i", x[p[doubt]], x[q[doubt]]) >= threshold
        a.append(p[fine])
        b.append(q[fine])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow, no underflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, passes: int | None = None, window: int = 512, seed: int = 7, recall: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per input row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different lengths never link; equal vectors are one class while comparing and count as links of one another.
    """
    rows = vectors.select("vec_id", "embedding")
    fine = F.expr(
        "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        " and exists(embedding, x -> x <> 0)"
    )
    rows = rows.withColumn("embedding", F.when(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull(), F.col("embedding")))
    classes = cut(rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))

    many = classes.count()
    counted = min(64, int(np.ceil(np.log2(many / window))) + 2) if many > window else 0
    if passes is None:
        parts, narrow = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), window
        for _ in range(3):
            bits = min(64, int(np.ceil(np.log2(many / narrow))) + 2) if many > narrow else 0
            passes = passes_for(narrow << bits, threshold, narrow, recall)
            narrow = int(min(window, max(8, passes * many // parts // 4)))

    def keyed(batches: Iterator[pd.DataFrame], passes: int = passes) -> Iterator[pd.DataFrame]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for dim, g in b.groupby(b["embedding"].map(len)):
                x = _unit(g["embedding"])
                for p in range(passes):
                    if (p, dim) not in planes:
                        planes[p, dim] = np.random.default_rng([seed, p, dim]).standard_normal((dim, 64))
                    bits = np.packbits(x @ planes[p, dim] > 0, axis=1)
                    yield pd.DataFrame({"p": p, "dim": dim, "sig": [r.tobytes() for r in bits], "id": g["id"].to_numpy(), "embedding": list(g["embedding"])})

    kind = vectors.schema["embedding"].dataType.simpleString()
    schema = f"p int, dim int, sig binary, id long, embedding {kind}"
    order = ["p", "dim", "sig", "id"]
    ordered = classes.mapInPandas(keyed, schema).repartitionByRange(*order).sortWithinPartitions(*order)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail, ids, at = np.empty((0, 0)), np.empty(0, np.int64), None
        for b in batches:
            for key, g in b.groupby(["p", "dim"], sort=True):
                x, i = _unit(g["embedding"]), g["id"].to_numpy()
                if key == at:
                    x, i = np.concatenate([tail, x]), np.concatenate([ids, i])
                old = len(tail) if key == at else 0
                p, q = neighbours(x, old, window, threshold)
                at, tail, ids = key, x[-window:], i[-window:]
                if len(p):
                    a, c = forest(i[p], i[q])
                    yield pd.DataFrame({"a": a, "b": c})

    def crowded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail, ids, at = np.empty(0, np.uint64), np.empty(0, np.int64), None
        for b in batches:
            for key, g in b.groupby(["p", "dim"], sort=True):
                s, i = np.frombuffer(b"".join(g["sig"]), ">u8").astype(np.uint64), g["id"].to_numpy()
                if key == at:
                    s, i = np.concatenate([tail, s]), np.concatenate([ids, i])
                same = (s[:-window] ^ s[window:]) >> np.uint64(64 - counted) == 0
                at, tail, ids = key, s[-window:], i[-window:]
                yield pd.DataFrame({"id": np.union1d(i[:-window][same], i[window:][same])})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, ["dim", "ti", "tj"]):
            x, i, left = _unit(g["embedding"]), g["id"].to_numpy(), (g["t"] == g["ti"]).to_numpy()
            right = left if g["ti"].iloc[0] == g["tj"].iloc[0] else ~left
            p, q = np.nonzero(x[left] @ x[right].T >= threshold)
            a, c = i[left][p], i[right][q]
            a, c = forest(a[a != c], c[a != c])
            yield pd.DataFrame({"a": a, "b": c})

    pairs = ordered.mapInPandas(near, "a long, b long")
    if counted:
        probe = lambda batches: keyed(batches, PROBES)
        probes = classes.mapInPandas(probe, schema).drop("embedding").repartitionByRange(*order).sortWithinPartitions(*order)
        crowd = cut(probes.mapInPandas(crowded, "id long").distinct())
        tiles = -(-crowd.count() // TILE)
        if tiles:
            hot = classes.join(crowd, "id").select("id", "embedding", F.size("embedding").alias("dim"), F.expr(f"cast(pmod(xxhash64(id), {tiles}) as int)").alias("t"))
            hot = hot.withColumn("o", F.explode(F.expr(f"sequence(0, {tiles - 1})"))).withColumn("ti", F.least("t", "o")).withColumn("tj", F.greatest("t", "o"))
            pairs = pairs.unionByName(together(hot.select("dim", "ti", "tj", "t", "id", "embedding"), "dim", "ti", "tj").mapInPandas(compare, "a long, b long"))
    groups = components(pairs)
    members = classes.join(groups, classes["id"] == groups["node"]).drop("node")
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    members = members.join(sizes, "component").withColumn("t", F.expr("cast(pmod(xxhash64(id), tiles) as int)"))
    members = members.withColumn("o", F.explode(F.expr("sequence(0, tiles - 1)"))).withColumn("ti", F.least("t", "o")).withColumn("tj", F.greatest("t", "o"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, ["component", "ti", "tj"]):
            t = g["t"].to_numpy()
            x, n, i = _unit(g["embedding"]), g["n"].to_numpy(), g["id"].to_numpy()
            if g["ti"].iloc[0] == g["tj"].iloc[0]:
                links = (x @ x.T >= threshold).astype(np.int64)
                np.fill_diagonal(links, 0)
                yield pd.DataFrame({"id": i, "links": links @ n})
            else:
                left = t == g["ti"].iloc[0]
                links = (x[left] @ x[~left].T >= threshold).astype(np.int64)
                yield pd.DataFrame({"id": np.concatenate([i[left], i[~left]]), "links": np.concatenate([links @ n[~left], links.T @ n[left]])})

    links = together(members.select("component", "ti", "tj", "t", "id", "n", "embedding"), "component", "ti", "tj").mapInPandas(count, "id long, links long")
    links = links.groupBy("id").agg(F.sum("links").alias("links"))
    name = lambda c: [F.xxhash64(F.lit(k), c).alias(f"h{k}") for k in (1, 2)]  # noqa: E731  # 128 bits name a class
    known = classes.join(groups, classes["id"] == groups["node"], "left").join(links, "id", "left")
    known = cut(known.select(*name("embedding"), "n", F.coalesce("component", "id").alias("c"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("l")))
    copies = max(1000, (known.agg(F.sum("n")).first()[0] or 0) // 100_000)  # so 100,000 classes at most have more
    told = rows.select("vec_id", F.col("embedding").isNotNull().alias("fine"), *name("embedding"))
    common = F.broadcast(known.where(F.col("n") > copies).drop("n"))
    told = told.join(common.withColumnsRenamed({"c": "c1", "l": "l1"}), ["h1", "h2"], "left")
    some, rest = told.where("c1 is not null or not fine").withColumnsRenamed({"c1": "c", "l1": "l"}), told.where("c1 is null and fine").drop("c1", "l1")
    out = some.unionByName(rest.join(known.where(F.col("n") <= copies).drop("n"), ["h1", "h2"], "left"))
    c = F.when(F.col("fine"), F.col("c"))
    return out.select(
        "vec_id", F.coalesce(F.when(F.col("fine"), F.col("l")), F.lit(0)).alias("n_links"), F.coalesce(c, "vec_id").alias("component_id"),
        F.coalesce(F.coalesce(c, "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
