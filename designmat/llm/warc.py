"""WARC archives with a two-level capture index.

Pages are ordered by their reversed-host URL key and written as WARC files, one gzip member a record, beside an
index of the same order: capture lines in compressed blocks. A sparse directory keeps the first and last key and
the byte range of each block. Keys are looked up in three steps: binary search of the directory for the blocks that
may hold them, binary search of a block's lines, and reads of the records by their byte ranges. Many keys at once
are dealt to tasks by ranges of the directory, then by block, so that the captures of one very common URL, which
fill many blocks, are read by many tasks.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from designmat.llm.common import SALTS, cut, qualified, runs, shared_dir, table

BLOCK = 1000
DIRECTORY = "first string, last string, index string, archive string, offset long, length long, lines int"


def url_key(url: Column) -> Column:
    """Sortable key: host labels reversed, then the rest; null gives the empty key."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "^[a-z][a-z0-9+.-]*://(www[.])?", "")
    host = F.regexp_extract(bare, "^([^/?#]*)", 1)
    rest = F.regexp_replace(bare, "^[^/?#]*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), rest)
    return F.regexp_replace(key, r"[\t\r\n]", " ")


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"file:///{path[5:].lstrip('/')}" if path.startswith("file:") else path)


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _record(page, url: str, payload: bytes, digest: str, kind: str, refers) -> bytes:
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Target-URI: {' '.join(url.split())}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """One record: its headers by lower-case name, and its payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    body = rest[: int(fields["content-length"])]
    return fields | {"payload": body.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else None}


def write(pages: DataFrame, path: str, shortest: int = 100) -> DataFrame:
    """Write archives and index under ``path``; returns the block directory.

    Of records with equal payloads of at least ``shortest`` bytes the one with the smallest page_id (nulls last)
    is a response and the others are revisits; rows that repeat that page_id are responses too. Null payloads and
    urls count as empty. Files of failed attempts are left behind but no directory row names them.
    """
    path = qualified(pages.sparkSession, path)
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), url_key(F.col("url")).alias("key"))
    pages = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    narrow = pages.where(F.octet_length("html") >= shortest)
    firsts = cut(narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"))
    if firsts.count() <= 50_000:  # about 100 bytes each
        rows = pages.join(F.broadcast(firsts), "digest", "left")
    else:  # one payload may be that of very many pages, so each is dealt to many tasks
        firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        rows = pages.withColumn("salt", salt).join(firsts, ["digest", "salt"], "left")
    rows = rows.withColumn("refers", F.expr("case when first <> page_id or page_id is null then first end"))
    order = [F.col("key"), F.col("page_id")]
    rows = rows.select("page_id", "url", "html", "key", "digest", "refers").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = _fs(path)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out = index = None
        lines, made, at, end = [], [], 0, 0

        def flush() -> None:
            nonlocal end
            block = _member("\n".join(x for _, x in lines).encode())
            index.write(block)
            made.append((lines[0][0], lines[-1][0], f"{name}.cdx.gz", f"{name}.warc.gz", end, len(block), len(lines)))
            end += len(block)
            lines.clear()

        for b in batches:
            for r in b.itertuples(index=False):
                if out is None:
                    fs.create_dir(top, recursive=True)
                    out, index = (fs.open_output_stream(f"{top}/{name}.{x}.gz", compression=None) for x in ("warc", "cdx"))
                page, revisit = (None if pd.isna(r.page_id) else int(r.page_id)), not pd.isna(r.refers)
                data = _member(_record(page, r.url, r.html.encode(), r.digest, "revisit" if revisit else "response", int(r.refers) if revisit else None))
                out.write(data)
                lines.append((r.key, f"{r.key}\t{page}\t{at}\t{len(data)}"))
                at += len(data)
                if len(lines) == BLOCK:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            index.close()
        yield pd.DataFrame(made, columns=["first", "last", "index", "archive", "offset", "length", "lines"])

    return cut(rows.mapInPandas(run, DIRECTORY))


def _block(fs, top: str, r) -> list[list[str]]:
    with fs.open_input_file(f"{top}/{r.index}") as f:
        return [x.rsplit("\t", 3) for x in zlib.decompress(f.read_at(r.length, r.offset), 31).decode().split("\n")]


def search(directory: DataFrame, keys: DataFrame, most: int = 10_000) -> DataFrame:
    """Directory rows with ``wanted``, the keys (column key) that may stand in the block, each pair once.

    The directory is cut into ranges at no more than ``most`` keys, which is all that reaches the driver; blocks and
    keys of a range meet in one task, where each block's keys are found by bisection.
    """
    blocks = directory.count()
    ranges = max(1, min(most, blocks // 64))
    cuts = directory.select("first").repartitionByRange(ranges, "first").groupBy(F.spark_partition_id()).agg(F.min("first").alias("k")).collect()
    cuts = np.array(sorted(r["k"] for r in cuts)[1:], dtype=object)
    names = directory.columns

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lo = np.searchsorted(cuts, b["first"].to_numpy(object), "right")
            hi = np.searchsorted(cuts, b["last"].to_numpy(object), "right")
            again = b.iloc[np.repeat(np.arange(len(b)), hi - lo + 1)]
            yield again.assign(part=np.concatenate([np.arange(x, y + 1) for x, y in zip(lo, hi, strict=True)]) if len(b) else lo)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, ["part"]):
            want = np.sort(g["last"][g["index"].isna()].to_numpy(object))
            held = g[g["index"].notna()]
            lo, hi = np.searchsorted(want, held["first"].to_numpy(object), "left"), np.searchsorted(want, held["last"].to_numpy(object), "right")
            for i in np.flatnonzero(hi > lo).tolist():
                for k in range(lo[i], hi[i], 10_000):
                    yield held.iloc[i : i + 1][names].assign(wanted=[want[k : min(k + 10_000, hi[i])].tolist()])

    asked = keys.select("key").where("key is not null").distinct().select(F.col("key").alias("first"), F.col("key").alias("last"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in directory.schema[2:]])
    dealt = directory.unionByName(asked).mapInPandas(place, f"{DIRECTORY}, part int")
    return dealt.repartition(ranges, "part").sortWithinPartitions("part").mapInPandas(match, f"{DIRECTORY}, wanted array<string>")


def read(directory: DataFrame, path: str, keys: DataFrame | None = None) -> DataFrame:
    """The captures of some keys (column key), or all of them: found by the index and read by byte range."""
    spark = directory.sparkSession
    path, blocks = qualified(spark, path), directory.count()
    asked = directory.withColumn("wanted", F.lit(None).cast("array<string>")) if keys is None else search(directory, keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = _fs(path)
        for b in batches:
            for r in b.itertuples(index=False):
                lines, rows = _block(fs, top, r), []
                with fs.open_input_file(f"{top}/{r.archive}") as f:
                    for _, _, offset, length in lines if r.wanted is None else _of(lines, r.wanted):
                        x = parse(zlib.decompress(f.read_at(int(length), int(offset)), 31))
                        digest, page = x["warc-payload-digest"].removeprefix("sha256:"), x["warc-record-id"][10:-1]
                        if x["payload"] is not None and hashlib.sha256(x["payload"]).hexdigest() != digest:
                            raise ValueError(f"payload of {page} does not match its digest")
                        refers = x.get("warc-refers-to")
                        rows.append((None if page == "None" else int(page), int(x["warc-payload-length"]), digest, x["warc-type"], int(refers[10:-1]) if refers else None, x["payload"]))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    # A directory row stands for many records, so tasks are counted by blocks and not by the directory's own bytes.
    tasks = max(1, min(blocks, max(-(-blocks // 16), spark.sparkContext.defaultParallelism)))
    return asked.repartition(tasks, F.xxhash64("index", "offset")).mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _of(lines: list[list[str]], keys) -> Iterator[list[str]]:
    """The lines of these keys, each found by bisection."""
    for key in keys:
        i = bisect.bisect_left(lines, key, key=lambda x: x[0])
        while i < len(lines) and lines[i][0] == key:
            yield lines[i]
            i += 1


def lookup(directory: DataFrame, path: str, url: str) -> list[dict]:
    """The captures of one url: directory by key range, bisection in the block, byte-range reads."""
    spark = directory.sparkSession
    key = spark.range(1).select(url_key(F.lit(url)).alias("k")).first()["k"]
    fs, top = _fs(qualified(spark, path))
    out = []
    for row in directory.where((F.col("first") <= key) & (F.col("last") >= key)).orderBy("first", "archive", "offset").toLocalIterator():
        r = SimpleNamespace(**row.asDict())
        with fs.open_input_file(f"{top}/{r.archive}") as f:
            out += [parse(zlib.decompress(f.read_at(int(x[3]), int(x[2])), 31)) for x in _of(_block(fs, top, r), [key])]
    return out


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is written, and found again by its own URL."""
    path, pages = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", table(spark, sf_dir, "pages")
    return read(write(pages, path), path, pages.select(url_key(F.col("url")).alias("key"))).drop("payload")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     q AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS d FROM p),
     f AS (SELECT d, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, q.d AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM q LEFT JOIN f ON q.d = f.d AND q.n >= 100
"""
