"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives and unlabelled web text give the risk pi E_P[l(z)] + max(0, E_U[l(-z)] - pi E_P[l(-z)]) of a
linear score z on text-shape features, l the logistic loss. It is minimised by Newton steps whose sums run over
all rows on the cluster; only sums of a fixed size reach the driver, so no sample is taken at any corpus size.
The class prior pi is estimated from the two score distributions of a first positive-against-unlabelled fit: the
least ratio of their upper tails.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designmat.llm.common import cut, table

UPPER, LOWER, DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
CALM = b" .,\n'\"-()"
LOUD = bytes(b for b in range(33, 127) if b not in CALM + UPPER + LOWER + DIGIT)


def features(text: str | None) -> np.ndarray:
    """Shares that describe a whole text's shape; null, empty and blank texts give zeros but for the constant."""
    b = (text or "").encode()
    w = b.split()
    if not w:
        return np.array([1.0] + [0.0] * 22)
    n, k = len(b), len(w)
    share = [(n - len(b.translate(None, c))) / n for c in (UPPER, DIGIT, LOUD, CALM)]
    counts = Counter(w)
    top = (counts.most_common(1)[0][1] - 1) / k  # 0 where no word recurs, however short the text
    lines = [x for x in b.split(b"\n") if x.strip()]
    once = sum(c for c in Counter(lines).values() if c > 1) / len(lines)
    again = sum(map(bytes.__eq__, w, w[1:])) / k
    stops = b.count(b".") / k
    bars = b.count(b"|") / k
    bangs = b.count(b"!") / k
    distinct = len(counts) / k
    length = sum(map(len, counts)) / len(counts) / 20
    raw = np.array([*share, top, once, again, min(stops, 0.25), min(bars, 2.0), min(bangs, 4.0), distinct, min(length, 3.0), min(n / k / 20, 3.0)])
    steep = np.sqrt(raw[[0, 1, 2, 4, 5, 6, 8, 9]])
    return np.concatenate([[1.0], raw, steep, [np.log1p(k) / 10]])


def _table(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": [features(t) for t in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, x array<double>")


def _sums(rows: DataFrame, w: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over trusted positives and unlabelled rows that a Newton step needs."""
    d = len(w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(2 * (2 + d + d * d + d))
        for b in batches:
            x = np.stack(b["x"].to_numpy())
            z = np.clip(x @ w, -30, 30)
            s, soft = 1 / (1 + np.exp(-z)), np.logaddexp(0, z)
            parts = []
            for m in (b["pos"].to_numpy(bool), b["free"].to_numpy(bool)):
                y, q = x[m], s[m]
                parts += [[m.sum(), soft[m].sum()], y.sum(0), q @ y, ((q * (1 - q))[:, None] * y).T @ y]
            out += np.concatenate([np.ravel(p) for p in parts])
        yield pd.DataFrame({"k": np.arange(len(out)), "v": out})

    got = rows.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 * (2 + d + d * d + d))
    for r in got:
        flat[r["k"]] = r["v"]
    out, i = {}, 0
    for side in "pu":
        for name, size in (("n", 1), ("soft", 1), ("x", d), ("sx", d), ("h", d * d)):
            out[side + name] = flat[i : i + size]
            i += size
    return out


def _newton(rows: DataFrame, d: int, prior: float | None, steps: int, ridge: float) -> np.ndarray:
    """Minimise the risk; without a prior, tell positives from unlabelled rows in equal parts.

    pi E_P[l(z)] + max(0, R) with R the risk of negatives is the greater of two convex functions. Where R stays above
    zero it is minimised by plain Newton steps. Where it would fall below, the minimum lies on R = 0: the steps are
    then those of the Lagrange conditions, with a multiplier between 0 and 1 for the weight that the clipped part
    takes from R, until the multiplier falls to zero again.
    """
    w, part = np.zeros(d), 0.0
    for _ in range(steps):
        s = _sums(rows, w)
        n, m = s["pn"][0], s["un"][0]
        if not n or not m:
            return np.zeros(d)
        hp, hu = s["ph"].reshape(d, d) / n, s["uh"].reshape(d, d) / m
        pull = np.full(d, ridge + 0.3 / n)  # few positives pull more
        pull[0] = ridge / 100
        if prior is None:
            grad, hess = (s["psx"] - s["px"]) / n + s["usx"] / m, hp + hu
            step = np.linalg.solve(hess + np.diag(pull), grad + pull * w)
        else:
            risk = s["usoft"][0] / m - prior * s["psoft"][0] / n
            slope = s["usx"] / m - prior * s["psx"] / n
            grad = s["usx"] / m - prior * s["px"] / n + pull * w
            hess = hu - part * (hu - prior * hp) + np.diag(pull)
            if risk < 0 or part:
                whole = np.block([[hess, -slope[:, None]], [-slope[None, :], np.zeros((1, 1))]])
                got = np.linalg.solve(whole, np.append(grad, -risk))  # of w and of the multiplier, which enters as it will be
                step, part = got[:d], float(np.clip(-got[d], 0.0, 1.0))
            else:
                step = np.linalg.solve(hess, grad)
        size = np.abs(step).max()
        w = w - step * min(1.0, 8.0 / max(size, 1e-12))
        if size < 1e-3:
            break
    return w


def _prior(rows: DataFrame, w: np.ndarray) -> float:
    """Least upper bound (one standard error) of the ratio of the tails of unlabelled and positive scores, where
    half the positives still are; the bound keeps noise from making the least ratio too small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = np.clip(np.stack(b["x"].to_numpy()) @ w, -10, 10)
            yield pd.DataFrame({"bin": np.floor(z * 50).astype(np.int64), "pos": b["pos"], "free": b["free"]})

    bins = rows.mapInPandas(run, "bin long, pos boolean, free boolean").groupBy("bin").agg(
        F.sum(F.col("pos").cast("int")).alias("p"), F.sum(F.col("free").cast("int")).alias("u")).orderBy(F.desc("bin")).collect()
    if not bins:
        return 0.5
    p, u = (np.cumsum([float(r[k] or 0) for r in bins]) for k in "pu")
    if not p[-1] or not u[-1]:
        return 0.5
    a, b = p / p[-1], u / u[-1]
    use = a >= 0.5
    a, b = a[use], b[use]
    error = np.sqrt(b * (1 - b) / u[-1]) / a + b / a * np.sqrt((1 - a) / (a * p[-1]))
    return float(np.clip((b / a + error).min(), 0.05, 0.99))


def _rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    trusted = labels.where("doc_id is not null").where(~held).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id", F.lit(True).alias("pos"))
    return cut(_table(docs).join(trusted, "doc_id", "left").select("doc_id", "x", held.alias("held_out"), F.coalesce("pos", F.lit(False)).alias("pos")))


def _fit(rows: DataFrame, steps: int, ridge: float) -> np.ndarray:
    fit = rows.where("not held_out").select("x", "pos", F.lit(True).alias("free"))
    d = len(features(""))
    return _newton(fit, d, _prior(fit, _newton(fit, d, None, 6, ridge)), steps, ridge)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, labels: DataFrame, steps: int = 12, ridge: float = 1e-4) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row.

    Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1; repeated labels of a document
    count as positive if all are 1, null labels as none. Without positives every score is 0.5. Null, empty and blank
    texts are scored by their features, which are zeros; repeated rows get equal scores; extra columns are ignored.
    The estimated class prior is kept within 0.05 and 0.99, and is 0.5 where there is nothing to tell it from.
    """
    rows = _rows(docs, labels)
    w = _fit(rows, steps, ridge)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = _sigmoid(np.stack(b["x"].to_numpy()) @ w)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, steps: int = 12, ridge: float = 1e-4) -> DataFrame:
    """The rows of docs, all columns, whose own text scores 0.5 or more; no text is shuffled.

    Texts that are null, empty or blank are scored like any other; repeated rows and rows without a doc_id too;
    columns may have any names. Without positive labels every score is 0.5 and every row stays.
    """
    w = _fit(_rows(docs, labels), steps, ridge)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(_sigmoid(np.stack([features(t) for t in texts]) @ w) >= 0.5)

    return docs.where(good("text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
