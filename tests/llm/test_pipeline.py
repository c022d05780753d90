"""The pipeline against a brute-force version of each stage on its own input."""

import hashlib

import pytest

import corpus_pipeline as P
from designmat.llm import decontam, secrets, simhash
from test_operators import SF, base_spans, slow_align, slow_fingerprint, ODD, odd  # noqa: F401


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    top, docs, out = tmp_path_factory.mktemp("p"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        df = stage(spark, docs, SF)
        df.write.parquet(f"{top}/{k}")
        df = spark.read.parquet(f"{top}/{k}")
        out.append((docs.columns, {r["doc_id"]: r for r in docs.collect()}, df.columns, {r["doc_id"]: r for r in df.collect()}))
        docs = df
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_quality(spark, steps):
    _, before, cols, after = steps[0]
    q = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["doc_id"] in before}
    assert cols == steps[0][0] and set(after) < set(before)
    assert sum(i in after for i in q if q[i] == 1) >= 0.97 * sum(q.values())
    assert sum(i in after for i in q if q[i] == 0) <= 0.1 * sum(v == 0 for v in q.values())


def test_near_copies(steps):
    _, before, cols, after = steps[1]
    assert cols == steps[1][0] and set(after) < set(before)
    sets = {i: shingles(r["text"]) for i, r in before.items()}
    fps = {i: slow_fingerprint(r["text"]) for i, r in before.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0
    ids = sorted(before)
    for a in ids:  # what went has a like document, and no two linked ones stay
        if a not in after:
            assert any(like(a, b) >= 0.8 for b in ids if b != a)
    left = sorted(after)
    pairs = [(a, b) for k, a in enumerate(left) for b in left[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 11 and like(a, b) >= 0.8]
    assert not pairs


def test_decontaminated(spark, steps):
    _, before, cols, after = steps[2]
    items = [decontam.words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {i: f" {' '.join(map(bytes.decode, decontam.words(r['text'])))} " for i, r in before.items()}
    holds = {i for i, t in texts.items() if any(f" {b' '.join(w).decode()} " in t for w in items)}
    assert cols == steps[2][0] and holds and not holds & set(after)
    for i in set(before) - set(after) - holds:
        assert max(slow_align(w, decontam.words(before[i]["text"])) / len(w) for w in items) >= 0.6


def test_redacted(steps):
    _, before, cols, after = steps[3]
    assert cols == steps[3][0] and set(after) == set(before)
    for i, r in before.items():
        if not base_spans(r["text"]):
            assert after[i]["text"].count("[SECRET]") or after[i]["text"] == r["text"]
        else:
            assert "[SECRET]" in after[i]["text"] and not any(r["text"][a:b] in after[i]["text"] for a, _, b in base_spans(r["text"]))
        assert after[i]["n_chars"] == len(after[i]["text"])


def test_encoded(steps):
    from tokenizers import Tokenizer

    from designmat.llm.bpe import default_path

    lib = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    _, before, _, after = steps[4]
    assert set(after) == set(before)
    for i, r in before.items():
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        assert (after[i]["n_tokens"], after[i]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_run_and_odd_rows(spark, steps, odd):  # noqa: F811
    assert P.run(spark, SF).count() == len(steps[4][3])
    for name, stage in P.STAGES:
        out = stage(spark, odd, SF)
        assert out.count() <= len(ODD) and stage(spark, odd.limit(0), SF).count() == 0, name
    kept = [r["doc_id"] for r in P.near_dedup(spark, odd, SF).collect()]
    assert sorted(i for i in kept if i) == [1, 4, 5, 6, 7] and kept.count(None) == 2


@pytest.mark.parametrize("tile", [1024, 2])
def test_groups_by_tiles(spark, tile):
    rows = [(i, " ".join(f"w{j}" if j != 40 + i else "edit" for j in range(100))) for i in range(12)] + [(50, "something else altogether in this one")]
    gone = simhash.surplus(spark.createDataFrame(rows, "doc_id long, text string"), radius=20, tile=tile)
    assert {r["doc_id"] for r in gone.collect()} == set(range(1, 12))
