"""Operator 2, token-ID output: length-delimited binary records and an offset index.

A shard is a run of records, each framed as

    8 bytes  length of the payload, unsigned, little-endian
    4 bytes  masked CRC-32C of those 8 bytes
    payload  16 bytes head (id, 1 if it is not null, bytes per token id, 6 zero), then the ids
    4 bytes  masked CRC-32C of the payload

with ``mask(c) = rotate_right(c, 15) + 0xa282ead8``. Documents are range-partitioned and sorted
by id, so shard k holds smaller ids than shard k + 1. Each task writes one shard under a name of
its own and returns one index row per record; Spark commits the index as a Parquet table, and
what the index does not name (the file of a task that failed) is not part of the data set. The
index has the byte offset of each record, for reads in any order.

Defined results: a null or empty text is the end id alone; documents with a null id come first;
repeated rows are written each time, equal ids in the order of their texts; an empty table gives
an empty index and no shard; columns other than id and text are never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, running_totals, shuffle_partitions
from .tokens import default_tokenizer, encoder

HEAD = np.dtype([("id", "<i8"), ("has_id", "u1"), ("width", "u1"), ("zero", "V6")])
INDEX = (
    "shard int, path string, doc_id long, offset long, length long, n_tokens long, "
    "start_in_shard long"
)
#: Bytes of payload framed or checked at once.
CHUNK = 4 << 20
_LANE = 512
_MASK = 0xA282EAD8


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For CRC-32C: the effect of two bytes, and of a lane of zeros on each byte of the state."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0x82F63B78), one >> 1).astype(np.uint32)
    two = np.arange(65536, dtype=np.uint32)
    for _ in range(2):
        two = one[two & 0xFF] ^ (two >> 8)
    lane = np.empty((4, 256), np.uint32)
    for k in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(_LANE // 2):
            state = two[state & 0xFFFF] ^ (state >> 16)
        lane[k] = state
    return two, lane


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part (4 bytes or more), many at once.

    Zeros in front leave a zero state alone, so parts are filled up in front to whole lanes;
    all lanes run side by side, then the lanes of a part are joined.
    """
    two, lane = _tables()
    sizes = np.array([len(p) for p in parts])
    lanes = -(-sizes // _LANE)
    ends = np.cumsum(lanes)
    block = np.zeros((int(ends[-1]), _LANE), np.uint8)
    flat = block.reshape(-1)
    for part, size, end in zip(parts, sizes, ends * _LANE, strict=True):
        flat[end - size : end] = np.frombuffer(part, np.uint8)
        flat[end - size : end - size + 4] ^= 0xFF
    words = np.ascontiguousarray(block.view("<u2").T)
    state = np.zeros(len(block), np.uint32)
    for word in words:
        state = two[(state ^ word) & 0xFFFF] ^ (state >> 16)
    out = np.zeros(len(parts), np.uint32)
    order = np.argsort(-lanes, kind="stable")
    first, left = (ends - lanes)[order], lanes[order]
    for k in range(int(lanes.max())):
        live = int(np.searchsorted(-left, -k, side="left"))
        now = out[:live]
        moved = lane[0][now & 0xFF] ^ lane[1][(now >> 8) & 0xFF]
        moved ^= lane[2][(now >> 16) & 0xFF] ^ lane[3][now >> 24]
        out[:live] = moved ^ state[first[:live] + k]
    crcs = np.empty_like(out)
    crcs[order] = out
    return crcs ^ np.uint32(0xFFFFFFFF)


def masked(crcs: np.ndarray) -> np.ndarray:
    return ((crcs >> np.uint32(15)) | (crcs << np.uint32(17))) + np.uint32(_MASK)


def frame(payloads: list[bytes]) -> list[bytes]:
    """The records of the payloads, as they stand in a shard."""
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    heads, bodies = masked(crc32c(lengths)), masked(crc32c(payloads))
    return [
        n + h.tobytes() + p + b.tobytes()
        for n, h, p, b in zip(lengths, heads, payloads, bodies, strict=True)
    ]


def _checked(lengths: list[bytes], heads: list[bytes], payloads: list[bytes], bodies: list[bytes], path: str) -> None:
    for crcs, kept in ((crc32c(lengths), heads), (crc32c(payloads), bodies)):
        if masked(crcs).astype("<u4").tobytes() != b"".join(kept):
            raise ValueError(f"a checksum in {path} does not fit its record")


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def write_records(
    docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text",
    tokenizer: str | None = None, end_id: int = 0, width: int | None = None,
) -> DataFrame:
    """Encode all documents into shards below ``path``; returns the committed index.

    ``width`` is the number of bytes of a token id, 2 or 4: unless named, the least that holds
    every id of the vocabulary. One that does not hold them is an error.
    """
    vocabulary = tokenizer or default_tokenizer()
    largest = max(encoder(vocabulary).largest, end_id)
    width = width or (2 if largest < 1 << 16 else 4)
    if width not in (2, 4) or largest >= 1 << 8 * width:
        raise ValueError(f"token ids up to {largest} do not fit {width} bytes")
    kind = f"<u{width}"
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spread = F.xxhash64("text")
    placed = wanted.repartitionByRange(F.col("doc_id").asc_nulls_first(), spread)
    placed = placed.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), spread, "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        shard, out, offset, start = TaskContext.get().partitionId(), None, 0, 0
        name = f"{path}/records-{shard:07d}-{uuid.uuid4().hex}.bin"

        def flush(pending):
            nonlocal offset, start
            head = np.zeros(len(pending), HEAD)
            head["id"] = [x or 0 for x, _ in pending]
            head["has_id"] = [x is not None for x, _ in pending]
            head["width"] = width
            ids = [np.frombuffer(x, "<u4") for _, x in pending]
            payloads = [h.tobytes() + x.astype(kind).tobytes() for h, x in zip(head, ids, strict=True)]
            framed = frame(payloads)
            out.write(b"".join(framed))
            sizes, counts = [len(x) for x in framed], [len(x) for x in ids]
            n = len(pending)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * n, pa.int32()), pa.array([name] * n),
                    pa.array([x for x, _ in pending], pa.int64()),
                    pa.array(offset + np.cumsum([0, *sizes[:-1]]), pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(start + np.cumsum([0, *counts[:-1]]), pa.int64()),
                ],
                ["shard", "path", "doc_id", "offset", "length", "n_tokens", "start_in_shard"],
            )
            offset, start = offset + sum(sizes), start + sum(counts)

        pending, size = [], 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    system, place = _open(name)
                    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(place)
                ids = known.encode(value.as_py()) + end
                pending.append((doc_id, ids))
                size += len(ids)
                if size >= CHUNK:
                    yield from flush(pending)
                    pending, size = [], 0
        if pending:
            yield from flush(pending)
        if out is not None:
            out.close()

    placed.mapInArrow(shards, INDEX).write.parquet(f"{path}/index")
    return read_index(docs.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: shard, path, doc_id, offset, length, n_tokens, start_in_shard."""
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def shard_starts(index: DataFrame) -> DataFrame:
    """(shard, path, start): the number of ids in all shards before this one."""
    totals = index.groupBy("shard", "path").agg(F.sum("n_tokens").alias("n"))
    return running_totals(totals, "shard", {"n": "start"}).select("shard", "path", "start")


def read_records(index: DataFrame) -> DataFrame:
    """Read all shards from end to end: (doc_id, start, n_tokens, ids_crc32, ids).

    A task reads one shard after another and checks every frame. ``start`` counts the ids of all
    records before; ``ids_crc32`` is taken over the ids as little-endian 32-bit integers; ``ids``
    are the bytes of those integers.
    """
    spark = index.sparkSession
    files = shard_starts(index).repartition(shuffle_partitions(spark), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                system, place = _open(path)
                with system.open_input_stream(place, buffer_size=1 << 20) as f:
                    yield from _records(f, path, start)

    return files.mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    )


def _records(f, path: str, start: int) -> Iterator[pa.RecordBatch]:
    kept: list[tuple[bytes, bytes, bytes, bytes]] = []
    size = 0
    while length := f.read(8):
        head, payload = f.read(4), f.read(int.from_bytes(length, "little"))
        kept.append((length, head, payload, f.read(4)))
        size += len(payload)
        if size >= CHUNK:
            batch, start = _decoded(kept, path, start)
            yield batch
            kept, size = [], 0
    if kept:
        yield _decoded(kept, path, start)[0]


def _decoded(kept: list, path: str, start: int) -> tuple[pa.RecordBatch, int]:
    _checked(*map(list, zip(*kept, strict=True)), path)
    heads = np.frombuffer(b"".join(p[: HEAD.itemsize] for _, _, p, _ in kept), HEAD)
    ids = [
        np.frombuffer(p, f"<u{w}", offset=HEAD.itemsize).astype("<u4")
        for (_, _, p, _), w in zip(kept, heads["width"], strict=True)
    ]
    counts = np.array([len(x) for x in ids], np.int64)
    starts = start + np.concatenate([[0], np.cumsum(counts)[:-1]])
    texts = [x.tobytes() for x in ids]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(heads["id"].astype(np.int64), mask=heads["has_id"] == 0), pa.array(starts),
            pa.array(counts), pa.array([zlib.crc32(x) for x in texts], pa.int64()),
            pa.array(texts, pa.binary()),
        ],
        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
    )
    return batch, start + int(counts.sum())


def read_at(wanted: DataFrame) -> DataFrame:
    """Read single records by index rows in any order: (doc_id, n_tokens, ids), ids as bytes.

    Rows are read in the order in which they come, as a shuffled epoch needs it.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            parts = []
            for path, group in rows.groupby("path"):
                system, place = _open(path)
                with system.open_input_file(place) as f:
                    for at, offset, length in zip(group.index, group["offset"], group["length"], strict=True):
                        raw = f.read_at(length, offset)
                        kept = [(raw[:8], raw[8:12], raw[12:-4], raw[-4:])]
                        got = _decoded(kept, path, 0)[0].to_pydict()
                        parts.append((at, got["doc_id"][0], got["n_tokens"][0], got["ids"][0]))
            found = pd.DataFrame(parts, columns=["at", "doc_id", "n_tokens", "ids"]).set_index("at")
            found["doc_id"] = found["doc_id"].astype("Int64")
            yield found.loc[rows.index] if len(found) else found

    return wanted.select("path", "offset", "length").mapInPandas(
        read, "doc_id long, n_tokens long, ids binary"
    )


def token_digests(docs: DataFrame, **options) -> DataFrame:
    """Write all documents, read the shards back: doc_id, start, n_tokens, ids_crc32."""
    scratch = Scratch(docs.sparkSession, "records")
    index = write_records(docs, scratch.root, **options)
    return read_records(index).select("doc_id", "start", "n_tokens", "ids_crc32")
