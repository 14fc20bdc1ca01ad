"""WARC archives and a globally ordered capture index.

Writing.  Every page becomes one record; Spark's text writer puts the record bytes, with the blank lines that end a
WARC record as line separator, so archives are WARC files of about ``archive_mb`` each (gzip over the whole file;
offsets count bytes of the plain archive), written under Spark's commit protocol.  Of pages with equal payloads of at least ``REVISIT_FROM`` bytes the one with the
smallest id is the response and the others revisit it.

Reading.  Each archive is read whole (its size is bounded; a single larger page makes a larger archive), its records
are checked (Content-Length, payload digest) and its captures are put in local order: one sorted run per archive.

Merging.  Runs are cut at range boundaries of (URL key, capture time, page); in each range a loser tree merges
the k run segments, so the ranges together form one global order of capture histories.

Defined results: null html is empty; null url has no target URI and an empty key; line breaks in a URL are
percent-encoded; rows that repeat a page_id and payload are all responses, as none has a smaller id; a null page_id
is never a target, and revisits nothing.  Other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm.common import column, map_batches
from kohorta.session import scratch_path, settle

REVISIT_FROM = 100
END = "\r\n\r\n"
EPOCH = 1704067200  # capture clock where the pages have none: this many seconds plus the page id
RANGE_ROWS = 200_000  # captures that one merge task holds, about
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RUN = (
    "run string, seq long, urlkey string, captured string, page_id long, record_type string, offset long, "
    "length long, payload_bytes long, payload_digest string, refers_to long"
)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, record (bytes without the closing blank lines), size of every page's record."""
    page = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b"")).alias("payload"),
    )
    page = page.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.length("payload").cast("long"))
    groups = (
        page.where(F.col("bytes") >= REVISIT_FROM)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    page = page.join(groups, "digest", "left")
    revisit = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    seconds = F.lit(EPOCH) + F.coalesce(F.pmod("page_id", F.lit(1_000_000_000)), F.lit(0))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END)
    )
    body = F.concat(http.cast("binary"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    page = page.withColumn("body", body)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.concat(F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.lit("\r\nWARC-Date: "),
        F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.concat(F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(
            revisit,
            F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">")),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.length("body").cast("string"),
        F.lit(END),
    )
    return page.select("page_id", F.concat(head.cast("binary"), F.col("body")).alias("record"))


def write_archives(pages: DataFrame, path: str, archive_mb: int = 32, **columns: str) -> None:
    """Gzip archives below ``path``: one or more per task, cut at a number of records that makes about ``archive_mb``.

    The records are written where the join with their groups leaves them, so pages are shuffled once at most.
    """
    html = columns.get("html_col", "html")
    size = F.coalesce(F.octet_length(F.col(f"`{html}`")), F.lit(0)) + 700
    mean = pages.agg(F.avg(size).alias("b")).first()["b"] or 1
    out = records(pages, **columns).select(F.col("record").cast("string").alias("value"))
    most = max(1, int((archive_mb << 20) / mean))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, then path and query, lower case; user, port and fragment left out."""
    try:
        parts = urlsplit(url.strip().lower())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.strip().lower()
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + query


def captures(content: bytes) -> Iterator[tuple]:
    """The records of an archive: url key, time, page, type, offset, length, payload size and digest, target.

    A record is found by its Content-Length alone; a damaged one raises.
    """
    at = 0
    while at < len(content):
        split = content.index(b"\r\n\r\n", at)
        lines = content[at:split].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = split + 4
        stop = start + int(fields["Content-Length"])
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        http = content.index(b"\r\n\r\n", start) + 4
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
        size = int(re.search(rb"Content-Length: (\d+)", content[start:http])[1])
        if kind == "response" and (stop - http != size or hashlib.sha256(content[http:stop]).hexdigest() != digest):
            raise ValueError(f"payload of the record at byte {at} does not match its digest")
        page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
        target = fields.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
        key = url_key(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else ""
        yield (
            key, fields["WARC-Date"], int(page) if page else None, kind, at, stop + 4 - at, size, digest,
            int(target) if target else None,
        )
        at = stop + 4


def _order(row: tuple) -> tuple:
    """URL key, time, page (null first), offset."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[4]


def read_runs(spark, path: str) -> DataFrame:
    """One sorted run of captures per archive below ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [f.split()[0] for f in RUN.split(", ")][2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py()
                rows = sorted(captures(gzip.decompress(batch.column(1)[k].as_py())), key=_order)
                if not rows:
                    continue
                columns = {n: [r[i] for r in rows] for i, n in enumerate(names)}
                data = {"run": [name] * len(rows), "seq": list(range(len(rows)))} | columns
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pydict({n: v[lo : lo + 10_000] for n, v in data.items()}, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(RUN))
    return files.mapInArrow(run, RUN)


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so the next least row costs one path of matches."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs = runs
        self.at = [0] * len(runs)
        self.keys = [r[0][0] if r else None for r in runs]  # rows are (key, payload); None: run is used up
        self.losers = [-1] * max(1, len(runs))
        self.winner = self._build(1) if runs else -1

    def _beats(self, a: int, b: int) -> bool:
        ka, kb = self.keys[a], self.keys[b]
        return kb is None or ka is not None and (ka, a) <= (kb, b)

    def _build(self, node: int) -> int:
        k = len(self.runs)
        if node >= k:
            return node - k
        left, right = self._build(2 * node), self._build(2 * node + 1)
        won, lost = (left, right) if self._beats(left, right) else (right, left)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator:
        k = len(self.runs)
        while self.winner >= 0 and self.keys[self.winner] is not None:
            w = self.winner
            yield self.runs[w][self.at[w]][1]
            self.at[w] += 1
            self.keys[w] = self.runs[w][self.at[w]][0] if self.at[w] < len(self.runs[w]) else None
            node = (w + k) // 2
            while node >= 1:
                if self._beats(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in the global order of URL key, time and page; partitions follow each other."""
    n = max(1, -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(int(n), "urlkey", "captured", "page_id", "run", "seq")
    dealt = dealt.sortWithinPartitions("run", "seq")
    names = runs.columns

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[str, list[tuple]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                segments.setdefault(row[0], []).append((_order(row[2:7] + (row[6],))[:4] + (row[0], row[1]), row))
        held: list[tuple] = []
        for row in LoserTree(list(segments.values())):
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return dealt.select(*names).mapInArrow(merge, runs.schema)


def capture_index(pages: DataFrame, path: str | None = None, archive_mb: int = 32, **columns: str) -> DataFrame:
    """Write the archives of ``pages`` (below ``path``), read them back and merge their runs: one row per capture."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, archive_mb, **columns)
    return merge_runs(settle(read_runs(spark, path), "runs"))
