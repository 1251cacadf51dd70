"""WARC archives of pages, and their index as globally ordered capture histories."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .shared import BROADCAST_ROWS, shared_folder, split_join, stored

CRLF = "\r\n"
#: Payloads of at least so many bytes may be stored once and revisited.
REVISIT_BYTES = 1000
#: Bytes of payload that an archive file is meant to hold; the number of records follows from their mean.
ARCHIVE_BYTES = 16 << 20
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Capture times stand in for those that ``pages`` lacks: seconds from here on, by id.
FIRST_CAPTURE = 1_704_067_200

INDEX_SCHEMA = (
    "archive string, run_pos long, url_key string, captured string, page_id long, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, record_offset long, record_bytes long"
)


def page_body(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(id, sha256, refers_to): pages whose payload a page of larger id holds as well.

    A page is known by id and payload, so a repeated id with another payload
    is another record. Null ids are never revisits and never referred to.
    """
    body = page_body(F.col("html"))
    light = pages.select(F.col("page_id").alias("id"), F.sha2(body, 256).alias("sha256"), F.octet_length(body).alias("bytes"))
    light = light.where((F.col("bytes") >= least) & F.col("id").isNotNull()).select("id", "sha256")
    groups = stored(light.groupBy("sha256").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = split_join(light, groups.select("sha256", "refers_to"), "sha256", groups.select("sha256", "n"), F.col("id"), "inner")
    return met.where("id < refers_to").distinct()


def capture_time(page_id: Column) -> Column:
    """The stand-in capture time as text, whatever the session's time zone."""
    at = F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(10**8))
    day, second = F.floor(at / 86400).cast("int"), at % 86400
    parts = [F.lpad(x.cast("int").cast("string"), 2, "0") for x in (second / 3600, second / 60 % 60, second % 60)]
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd")
    return F.concat(date, F.lit("T"), F.concat_ws(":", *parts), F.lit("Z"))


def record(page_id: Column, url: Column, body: Column, refers_to: Column) -> Column:
    """One WARC record without its closing blank lines; a revisit has the HTTP headers only."""
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))
    uri = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = refers_to.isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(CRLF),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, body))
    return F.concat(
        F.lit(f"WARC/1.0{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(page_id)),
        F.when(url.isNull(), "").otherwise(line("WARC-Target-URI", uri)),
        line("WARC-Date", capture_time(page_id)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(body))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(refers_to)), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to gzipped archives under ``path``.

    Spark's own text writer ends each record with the two blank lines that the
    format asks for, so any file system and any retried task will do.
    """
    again = stored(revisits(pages, least))
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = pages.select("page_id", "url", page_body(F.col("html")).alias("body"))
    rows = rows.withColumn("sha256", F.sha2("body", 256))
    again = again.select(F.col("id").alias("page_id"), "sha256", "refers_to")
    rows = rows.join(F.broadcast(again) if few else again, ["page_id", "sha256"], "left")
    size = rows.agg(F.avg(F.octet_length("body")).alias("mean")).first()["mean"] or 0
    rows = rows.select(record(F.col("page_id"), F.col("url"), F.col("body"), F.col("refers_to")).alias("value"))
    writer = rows.write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
    writer.option("maxRecordsPerFile", max(1, int(archive_bytes / (size + 600)))).text(path)


def url_key(url: str | None) -> str:
    """The host's labels from right to left, then the rest in order: com,example)/path."""
    if not url:
        return ""
    host, slash, rest = url.partition("://")[2].partition("/") if "://" in url else ("", "", url)
    return ",".join(reversed(host.lower().split("."))) + ")" + slash + rest


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(offset, bytes, headers, block) of each record of an uncompressed archive, by Content-Length."""
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(headers["content-length"])
        yield at, stop + 4 - at, headers, view[start:stop]
        at = stop + 4


def inflate(data: bytes) -> bytes:
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def page_of(name: str | None) -> int | None:
    value = name[len("<urn:page:") : -1] if name else "null"
    return None if value == "null" else int(value)


def order(row: tuple) -> tuple:
    """URL key, time, id; a null id comes first. Equal rows stay in run order."""
    return row[2], row[3], row[4] is not None, row[4] or 0


def index_run(archive: str, data: bytes) -> list[tuple]:
    """The index of one archive, sorted: a run."""
    rows = []
    for offset, length, headers, block in read_records(data):
        head, _, payload = bytes(block).partition(b"\r\n\r\n")
        stated = headers["warc-payload-digest"].removeprefix("sha1:")
        size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        if headers["warc-type"] == "response":
            found = hashlib.sha1(payload).hexdigest()
            if (found, len(payload)) != (stated, size):
                raise ValueError(f"{archive}: the payload at byte {offset} is not the one that was written")
        key = url_key(headers.get("warc-target-uri"))
        rows.append((archive, 0, key, headers["warc-date"], page_of(headers["warc-record-id"]), headers["warc-type"],
                     page_of(headers.get("warc-refers-to")), size, stated, offset, length))
    rows.sort(key=order)
    return [(x[0], i, *x[2:]) for i, x in enumerate(rows)]


def _names() -> list[str]:
    return [x.split()[0] for x in INDEX_SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in INDEX_SCHEMA.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _names())


def archive_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) of archives to one sorted run of index rows for each."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            rows = index_run(path.as_py().rpartition("/")[2], inflate(content.as_py()))
            for i in range(0, len(rows), 10_000):
                yield _batch(rows[i : i + 10_000])


class LoserTree:
    """Merges k sorted runs; each inner node keeps the run that lost there, so a step costs one path of matches."""

    def __init__(self, runs: list[list], key: Callable):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.heads = [self._head(r) for r in range(self.k)]
        self.losers = [-1] * self.k
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.best = winners[1] if self.k > 1 else 0

    def _head(self, run: int):
        rows = self.runs[run]
        return self.key(rows[self.at[run]]) if self.at[run] < len(rows) else None

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def __iter__(self):
        while self.k and self.heads[self.best] is not None:
            run = self.best
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.heads[run] = self._head(run)
            node, best = (run + self.k) >> 1, run
            while node:
                other = self.losers[node]
                if self._before(other, best):
                    self.losers[node], best = best, other
                node >>= 1
            self.best = best


def merge_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices of all runs in one key range, each in its own order, merged to one."""
    runs: list[list[tuple]] = []
    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in _names())):
            if not runs or runs[-1][-1][0] != row[0]:
                runs.append([])
            runs[-1].append(row)
    part, position, held = TaskContext.get().partitionId(), 0, []

    def out(rows: list[tuple]) -> pa.RecordBatch:
        base = _batch(rows)
        places = [pa.array([part] * len(rows), pa.int32()), pa.array(range(position - len(rows), position), pa.int64())]
        return pa.record_batch([*base.columns, *places], [*base.schema.names, "part", "position"])

    for row in LoserTree(runs, order):
        held.append(row)
        position += 1
        if len(held) == 10_000:
            yield out(held)
            held = []
    if held:
        yield out(held)


def capture_histories(archives: str, spark) -> DataFrame:
    """The merged index of the archives under ``archives``: all captures by URL key, time and id.

    ``part`` and ``position`` give the global order. Each archive is one run,
    sorted where it is read and stored; key ranges of the runs then meet, and
    a task merges the slices of its range. Ranges are cut by URL key, time and
    id, so one URL with very many captures spreads over many tasks. Ids are
    read back from record names; null ids and null urls stay null and empty.
    """
    files = spark.read.format("binaryFile").load(archives).where("length > 0").select("path", "content")
    runs = stored(files.mapInArrow(archive_runs, INDEX_SCHEMA))
    ranged = runs.repartitionByRange("url_key", "captured", "page_id").sortWithinPartitions("archive", "run_pos")
    return ranged.mapInArrow(merge_part, INDEX_SCHEMA + ", part int, position long")


def archive_and_index(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Write the pages' archives to the shared folder and return their merged index.

    One row per page, repeated rows included. Null html is an empty payload.
    Payloads of at least ``least`` bytes that are equal are stored with the
    largest id; the others are revisits of it. Other columns are not read. No
    rows give no rows.
    """
    path = shared_folder(pages.sparkSession)
    write_archives(pages, path, least)
    return capture_histories(path, pages.sparkSession)
