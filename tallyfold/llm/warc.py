"""WARC archives of pages, and a globally ordered capture index by external merge.

Archives are written by Spark's text writer: a record ends with two line ends, which is the writer's
separator, so files are complete WARC/1.0 and go through Spark's commit protocol to any file system. Reading
parses each file by content lengths and leaves a run of captures, sorted by URL key and time, in the shared
folder. Runs are then cut into key ranges, and each range is one k-way merge by a loser tree.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.session import BROADCAST_ROWS, bounded_batches, dealt_join, materialise, scratch

#: The base32 alphabet of RFC 4648; a fixed value.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

#: Records in one archive file by the largest payload they may have. A file is parsed in one piece, so it has about
#: 64 MB at most, or else one record.
FILE_RECORDS = {1 << 16: 1000, 1 << 22: 16, 1 << 62: 1}

#: Captures that one merge task holds, about.
MERGE_ROWS = 200_000


def base32_sql(hex_digest: str) -> str:
    """SQL for the base32 form of a SHA-1 in hex: every five hex digits are four letters."""
    letters = []
    for i in range(8):
        number = f"cast(conv(substr({hex_digest}, {5 * i + 1}, 5), 16, 10) as int)"
        letters += [f"substr('{BASE32}', (shiftright({number}, {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0)]
    return "concat(" + ", ".join(letters) + ")"


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; line ends in a value are percent-encoded."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _record_id(page_id: Column) -> Column:
    digest = F.md5(F.coalesce(page_id.cast("string"), F.lit("none")).cast("binary"))
    parts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _default_time(page_id: Column) -> Column:
    """Pages have no capture time of their own: seconds after 2020 in the order of page_id."""
    return F.timestamp_seconds(F.lit(1577836800) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(1_000_000_000)))


def _payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), its key and bytes."""
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    return base.withColumn("key", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))


def repeated_payloads(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, dict[int, int]]:
    """key and latest (the largest page_id) of payloads that several rows have, and rows by the sizes of FILE_RECORDS.

    Found without the payloads themselves, which are hashed where they are read.
    """
    rows, sizes = _payloads(pages), sorted(FILE_RECORDS)
    seen = rows.agg(*[F.count_if(F.col("bytes") <= n).alias(f"n{n}") for n in sizes]).first()
    groups = rows.where(F.col("bytes") >= least_bytes).groupBy("key")
    groups = groups.agg(F.max("page_id").alias("latest"), F.count("*").alias("n"))
    found = materialise(groups.where("n > 1").select("key", "latest"), "latest")
    return found, {n: seen[i] - (seen[i - 1] if i else 0) for i, n in enumerate(sizes)}


def records(pages: DataFrame, least_bytes: int = 0, captured_at: Column | None = None) -> DataFrame:
    """One column ``value``: a WARC record of every row of pages (page_id, url, html), without its end.

    The payload is the html in UTF-8 (null: empty). Of payloads that are equal and have at least
    least_bytes, the one with the largest page_id is a response and the others revisit it; all else are
    responses. Rows that repeat the largest page_id are responses too; if no page of a group has an id,
    all are responses.
    """
    return _records(pages, repeated_payloads(pages, least_bytes)[0], captured_at).select("value")


def _records(pages: DataFrame, latest: DataFrame, captured_at: Column | None) -> DataFrame:
    """bytes and value of every row of pages.

    The payloads stay where they are if those that are repeated are few (counted); else they are joined with them,
    dealt so that Spark splits a payload of very many rows.
    """
    base = _payloads(pages)
    time = captured_at if captured_at is not None else _default_time(F.col("page_id"))
    if latest.count() <= BROADCAST_ROWS:
        joined = base.join(F.broadcast(latest), "key", "left")
    else:
        joined = dealt_join(base, latest, "key", "left")
    found = (
        joined
        .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest")))
        .withColumn("again", F.col("refers_to").isNotNull())
        .withColumn("digest", F.expr(base32_sql("sha1(html)")))
    )
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit(END),
    )
    block = F.concat(http, F.when(F.col("again"), F.lit("")).otherwise(F.col("html")))
    value = F.concat(
        F.lit("WARC/1.0\r\n"),
        _header("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        _header("WARC-Record-ID", _record_id(F.col("page_id"))),
        _header("WARC-Date", F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(F.col("again"), _record_id(F.col("refers_to")))),
        _header("WARC-Profile", F.when(F.col("again"), F.lit(PROFILE))),
        _header("X-Page-Id", F.col("page_id")),
        _header("X-Refers-To-Page-Id", F.col("refers_to")),
        _header("X-Payload-Length", F.col("bytes")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )
    return found.select("bytes", value.alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, captured_at: Column | None = None) -> None:
    """Write records() of pages as gzipped WARC files under path, each file one gzip stream.

    Payloads of the sizes of FILE_RECORDS go into files of their own, so that a file is bounded in bytes.
    """
    latest, rows = repeated_payloads(pages, least_bytes)
    found, least = _records(pages, latest, captured_at), -1
    wanted = [n for n in rows if rows[n]] or [max(rows)]
    for most in rows:
        if most in wanted:
            part = found.where((F.col("bytes") > least) & (F.col("bytes") <= most)) if len(wanted) > 1 else found
            writer = part.select("value").write.mode("append").option("lineSep", END)
            writer.option("maxRecordsPerFile", FILE_RECORDS[most]).option("compression", "gzip").text(path)
        least = most


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers (lower-case names), payload, offset and length of every record of an archive."""
    at = 0
    while at < len(data):
        start, body = at, data.index(b"\r\n\r\n", at) + 4
        version, *lines = data[at : body - 4].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        at = body + int(headers["content-length"])
        block = data[body:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {start} doesn't end at its length")
        at += 4
        yield headers, block[block.index(b"\r\n\r\n") + 4 :], start, at - start


def url_key(url: str | None) -> str:
    """The sort key of a URL: the host's labels from the last one, then path and query, in lower case.

    A null or empty URL has the key "", one that can't be taken apart itself in lower case.
    """
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}".lower()


CAPTURES = {
    "run": pa.string(), "pos": pa.int64(), "url_key": pa.string(), "captured_at": pa.string(),
    "page_id": pa.int64(), "record_type": pa.string(), "payload_digest": pa.string(),
    "payload_bytes": pa.int64(), "refers_to": pa.int64(), "offset": pa.int64(), "length": pa.int64(),
}
_SPARK_TYPES = {pa.string(): "string", pa.int64(): "long"}
_CAPTURE_SCHEMA = ", ".join(f"{k} {_SPARK_TYPES[t]}" for k, t in CAPTURES.items())


def capture_order(row: dict[str, Any]) -> tuple:
    """The order of the index: URL key, time, page id (null first), then the place in the archives."""
    page = row["page_id"]
    return row["url_key"], row["captured_at"], page is not None, page or 0, row["run"], row["offset"]


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _run_of(path: str, data: bytes) -> list[dict[str, Any]]:
    """The sorted captures of one archive. Digest and length of a response are those of what was read."""
    run = []
    for headers, payload, offset, length in parse(data):
        kind = headers["warc-type"]
        digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
        if kind == "response":
            digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
        moment = "".join(c for c in headers["warc-date"] if c.isdigit())
        run.append(
            {"run": path, "url_key": url_key(headers.get("warc-target-uri")), "captured_at": moment,
             "page_id": _number(headers.get("x-page-id")), "record_type": kind, "payload_digest": digest,
             "payload_bytes": size, "refers_to": _number(headers.get("x-refers-to-page-id")),
             "offset": offset, "length": length}
        )
    run.sort(key=capture_order)
    for pos, row in enumerate(run):
        row["pos"] = pos
    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            if run := _run_of(path, _unpacked(data.as_py())):
                yield pa.RecordBatch.from_pylist(run, pa.schema(CAPTURES))


def _unpacked(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Sorted runs of captures, one per archive file under path; offsets are those of the unpacked file."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_runs, _CAPTURE_SCHEMA)


class LoserTree:
    """Merges k sorted lists: each inner node keeps the loser of the match below it, the winner rises.

    Taking a row replays only the matches on its way up, about log2(k) of them.
    """

    def __init__(self, runs: list[list[dict[str, Any]]]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.keys = [capture_order(run[0]) if run else None for run in runs]
        self.losers = [-1] * max(1, self.k)
        self.winner = self._build()

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's next row comes before run b's; a run that is used up comes last."""
        ka, kb = self.keys[a], self.keys[b]
        return kb is None if ka is None or kb is None else ka <= kb

    def _build(self) -> int:
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return winners[1] if self.k > 1 else 0

    def __iter__(self) -> Iterator[dict[str, Any]]:
        while self.k and self.keys[self.winner] is not None:
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            more = self.at[run] < len(self.runs[run])
            self.keys[run] = capture_order(self.runs[run][self.at[run]]) if more else None
            node = (run + self.k) // 2
            while node:
                if not self._beats(run, self.losers[node]):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one key range, which come run by run, in global order."""
    runs: dict[str, list[dict[str, Any]]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            runs.setdefault(row["run"], []).append(row)
    out = []
    for row in LoserTree(list(runs.values())):
        out.append(row)
        if len(out) == 10_000:
            yield pa.RecordBatch.from_pylist(out, pa.schema(CAPTURES))
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, pa.schema(CAPTURES))


def merge_runs(runs: DataFrame) -> DataFrame:
    """Captures of all runs, ordered within and across partitions by URL key, time and page id.

    runs must have been materialised. Ranges are cut by the whole key, so a URL with very many captures
    is spread over several.
    """
    wanted = max(1, -(-runs.count() // MERGE_ROWS))
    parts = max(wanted, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = runs.repartitionByRange(parts, "url_key", "captured_at", "page_id")
    return ranged.sortWithinPartitions("run", "pos").mapInArrow(_merged, _CAPTURE_SCHEMA)


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write archives of pages, read them back, and return one row per page in the order of the index.

    page_id, payload_bytes, payload_digest (base32 SHA-1), record_type, refers_to, url_key, captured_at.
    Null and empty html is an empty payload, a null url has an empty key, repeated rows are captures of
    their own, an empty table gives no row; extra columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch(spark, "archives")
    write_archives(pages, path, least_bytes)
    merged = merge_runs(materialise(read_runs(spark, path), "runs"))
    return merged.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at"
    )
