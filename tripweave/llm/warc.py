"""Operator 3, WARC archives and their global index by external merging.

Captures are written as gzipped WARC records, one archive per task. A task's captures are
sorted by URL key and timestamp before they are written, so the index entries that it returns
are a locally sorted run. The runs are merged into one index in global order: their entries are
cut into key ranges of bounded size, and in each range a loser tree merges the parts of all
runs, k ways at once. Captures of one URL follow each other by time, also where a URL with very
many captures lies in several ranges.

Of captures with equal payloads, those with the least page id are response records, the others
revisit records that refer to it. Payloads below ``least_bytes`` are always responses.

Archives have names of their own per attempt, and only those that the committed index names
are part of the data set.

Defined results: a null html is the empty payload, a null url a record without target; page ids
may be null, such a capture revisits any other that has an id; repeated rows are written each
time, with the least page id as responses; an empty table gives an empty index and no archive;
other columns are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, running_totals, shuffle_partitions
from .token_records import _open

ENTRY = (
    "urlkey string, timestamp string, page_id long, path string, position long, offset long, "
    "length long"
)
#: Most index entries in one range of the merge.
RANGE_ROWS = 200_000
_COLUMNS = ["urlkey", "timestamp", "page_id", "path", "position", "offset", "length"]
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then path and query: ``com,example)/a?b=1``."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    host = F.lower(F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    labels = F.reverse(F.split(F.regexp_replace(host, r"^www\d*\.", ""), r"\."))
    rest = F.lower(F.regexp_replace(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""))
    return F.concat(F.array_join(labels, ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def capture_time(page_id: Column) -> Column:
    """A time for captures that have none: the id in seconds after the start of 2024."""
    return F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce(page_id, F.lit(0))), "yyyyMMddHHmmss")


def _record(page_id, url, payload: bytes, stamp: str, digest: str, first) -> bytes:
    revisit = first is not None
    name = "null" if page_id is None else page_id
    s = stamp
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{name}>",
        f"WARC-Date: {s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:x-page:{first}>"]
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def write_archives(
    pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url: str = "url",
    html: str = "html", stamp: Column | None = None,
) -> DataFrame:
    """Write all captures; returns the stored runs, one index entry per record."""
    made = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
        (capture_time(F.col(id_col).cast("long")) if stamp is None else stamp).alias("timestamp"),
    ).withColumn("digest", F.sha1("html")).withColumn("urlkey", url_key(F.col("url")))
    firsts = made.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = firsts.where((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    other = F.coalesce(F.col("page_id") != F.col("first"), F.lit(True))
    later = F.when(other & (F.octet_length("html") >= least_bytes), F.col("first"))
    runs = made.join(firsts, "digest", "left").select(
        "urlkey", "timestamp", "page_id", "url", "html", "digest", later.alias("first")
    ).sortWithinPartitions("urlkey", "timestamp", "page_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{path}/captures-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.warc.gz"
        out, position, offset = None, 0, 0
        for batch in batches:
            if out is None and batch.num_rows:
                system, place = _open(name)
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(place, compression=None)
            lengths = []
            narrow = batch.select(["urlkey", "timestamp", "page_id", "url", "digest", "first"]).to_pylist()
            for row, page in zip(narrow, batch.column("html"), strict=True):
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                record = _record(
                    row["page_id"], row["url"], page.as_py().encode(), row["timestamp"], digest, row["first"]
                )
                packed = gzip.compress(record, 1, mtime=0)
                out.write(packed)
                lengths.append(len(packed))
            n = len(lengths)
            offsets = [offset]
            for size in lengths:
                offsets.append(offsets[-1] + size)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in _COLUMNS[:3]], pa.array([name] * n, pa.string()),
                    pa.array(range(position, position + n), pa.int64()),
                    pa.array(offsets[:-1], pa.int64()), pa.array(lengths, pa.int64()),
                ],
                _COLUMNS,
            )
            position, offset = position + n, offsets[-1]
        if out is not None:
            out.close()

    runs.mapInArrow(write, ENTRY).write.parquet(f"{path}/runs")
    return pages.sparkSession.read.schema(ENTRY).parquet(f"{path}/runs")


class LoserTree:
    """Merge sorted sequences: each inner node keeps the loser of the match below it.

    Taking the least head and playing its successor against the losers on one way to the top
    costs log2 k comparisons, whatever the number k of sequences.
    """

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.losers: list[int | None] = [None] * self.k
        self.winner = None
        for run in range(self.k):
            self._play(run)

    def _beats(self, x: int, y: int) -> bool:
        if self.at[x] >= len(self.runs[x]):
            return False
        return self.at[y] >= len(self.runs[y]) or self.runs[x][self.at[x]] < self.runs[y][self.at[y]]

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node:
            rival = self.losers[node]
            if rival is None:
                self.losers[node] = run
                return
            if self._beats(rival, run):
                self.losers[node], run = run, rival
            node //= 2
        self.winner = run

    def __iter__(self) -> Iterator:
        while self.k and self.at[self.winner] < len(self.runs[self.winner]):
            yield self.runs[self.winner][self.at[self.winner]]
            self.at[self.winner] += 1
            self._play(self.winner)


def merge_runs(runs: DataFrame, path: str) -> DataFrame:
    """The index in global order: entries with ``ordinal``, their place in it, from 0.

    Entries are dealt to key ranges of about ``RANGE_ROWS`` at most, in each of which the runs
    still are sorted. Ranges follow each other, so their sizes give the first ordinal of each.
    """
    spark = runs.sparkSession
    ranges = max(shuffle_partitions(spark), math.ceil(runs.count() / RANGE_ROWS))
    key = ["urlkey", "timestamp", "page_id", "path", "position"]
    dealt = runs.repartitionByRange(ranges, *key).sortWithinPartitions("path", "position")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[str, list] = {}
        for batch in batches:
            batch["page_id"] = batch["page_id"].astype("Int64")
            absent = batch["page_id"].notna()  # null ids come first, as in Spark's order
            ids = batch["page_id"].fillna(0)
            keys = zip(batch["urlkey"], batch["timestamp"], absent, ids, batch["path"], batch["position"], batch["offset"], batch["length"], strict=True)
            for entry in keys:
                parts.setdefault(entry[4], []).append(entry)
        order, piece, rank = TaskContext.get().partitionId(), [], 0
        for entry in LoserTree(list(parts.values())):
            piece.append(entry)
            if len(piece) == 10_000:
                yield _entries(piece, order, rank)
                rank, piece = rank + len(piece), []
        if piece:
            yield _entries(piece, order, rank)

    merged = dealt.mapInPandas(merge, ENTRY + ", range int, rank long")
    merged.write.parquet(f"{path}/merged")
    merged = spark.read.schema(ENTRY + ", range int, rank long").parquet(f"{path}/merged")
    sizes = merged.groupBy("range").agg(F.count("*").alias("n"))
    starts = running_totals(sizes, "range", {"n": "start"}).select("range", "start")
    full = merged.join(F.broadcast(starts) if ranges <= 100_000 else starts, "range")
    return full.select(*_COLUMNS, (F.col("start") + F.col("rank")).alias("ordinal"))


def _entries(piece: list, order: int, rank: int) -> pd.DataFrame:
    out = pd.DataFrame(piece, columns=["urlkey", "timestamp", "named", *_COLUMNS[2:]])
    out["page_id"] = out["page_id"].astype("Int64").where(out.pop("named").astype(bool))
    return out.assign(range=order, rank=range(rank, rank + len(out)))


READ = (
    "path string, position long, page_id long, url string, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long"
)


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _number(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _decode(record: dict[str, str], block: bytes, where: str) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = record["warc-payload-digest"].removeprefix("sha1:")
    size = int(_parse(http)["content-length"])
    if record["warc-type"] == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"a payload in {where} does not fit its digest")
    return {
        "page_id": _number(record["warc-record-id"]), "url": record.get("warc-target-uri"),
        "payload_bytes": size, "payload_digest": digest, "record_type": record["warc-type"],
        "refers_to": _number(record.get("warc-refers-to")),
    }


def read_archives(runs: DataFrame) -> DataFrame:
    """Read all archives that ``runs`` names from end to end, one row per record.

    A task reads one archive after another as a stream and checks the digest of each payload.
    """
    # By a hash that Spark does not take for the distinct's own: the archives are dealt for good.
    files = runs.select("path").distinct().repartition(shuffle_partitions(runs.sparkSession), F.xxhash64("path"))
    schema = pa.schema([
        ("path", pa.string()), ("position", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows, system, place = [], *_open(path)
                with system.open_input_stream(place, compression=None, buffer_size=1 << 20) as raw:
                    with gzip.GzipFile(fileobj=raw, mode="rb") as f:
                        for position, (record, block) in enumerate(_stream(f)):
                            rows.append({"path": path, "position": position, **_decode(record, block, path)})
                            if len(rows) == 5000:
                                yield pa.RecordBatch.from_pylist(rows, schema)
                                rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(read, READ)


def _stream(f) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := f.readline():
        head = [line]
        while (line := f.readline()) not in (b"\r\n", b""):
            head.append(line)
        record = _parse(b"".join(head))
        block = f.read(int(record["content-length"]))
        f.read(4)
        yield record, block


def read_capture(path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: (headers, block)."""
    system, place = _open(path)
    with system.open_input_file(place) as f:
        raw = zlib.decompress(f.read_at(length, offset), wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    record = _parse(head + b"\r\n")
    return record, rest[: int(record["content-length"])]


def archive_digest(pages: DataFrame, **options) -> DataFrame:
    """Write, merge the index, read back: one row per page, with its place in the history."""
    scratch = Scratch(pages.sparkSession, "warc")
    runs = write_archives(pages, scratch.root, **options)
    index = merge_runs(runs, scratch.root).select("path", "position", "urlkey", "timestamp", "ordinal")
    # Stored, for its size cannot be told from the few paths it comes from.
    records = scratch.table(read_archives(runs), "records")
    return records.join(index.hint("merge"), ["path", "position"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey",
        "timestamp", "ordinal",
    )
