"""Token ids in binary files of patched frame-of-reference blocks.

Documents in ascending id order are cut into segments of whole documents.  A
segment is one binary value: a header, an index of block starts, then blocks of
BLOCK ids.  A block stores its ids minus its minimum, packed with as many bits
as its cheapest percentile of PERCENTILES needs; ids that need more keep their
low bits there and their high bits in an exception list of the block.

Files are written as a Parquet table of segments (shard, segment, first id of
the segment in the shard, document ids and lengths, payload), one shard per
range partition, so any store that Spark writes to will do.

Null texts are empty (they hold the end id only).  Rows count one by one;
repeated ids keep the order of their texts; a null id comes first.  Extra
columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelflow.llm.common import map_arrow, text_chunks
from labelflow.llm.word_tokens import CHUNK_BYTES, word_tokens

BLOCK = 1024
PERCENTILES = (90, 95, 98, 99, 100)
#: Ids after which a segment ends with the document at hand.
SEGMENT_IDS = 1 << 16
END_ID = 2
MAGIC = b"PFR1"
SEGMENT_SCHEMA = "shard int, segment int, first long, doc_ids array<long>, lengths array<long>, payload binary"


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, n) unsigned values below 2**width as (rows, bytes), n * width bits
    each; n is a multiple of 8.  Eight values fill ``width`` bytes."""
    lanes = values.reshape(len(values), -1, 8).astype(np.uint64)
    out = np.zeros((*lanes.shape[:2], width), np.uint8)
    for k in range(width):  # bits 8k to 8k + 7 of the group, highest first
        byte = np.zeros(lanes.shape[:2], np.uint64)
        for lane in range(8 * k // width, min(7, (8 * k + 7) // width) + 1):
            shift = (lane + 1) * width - (8 * k + 8)  # low bits of the lane beyond this byte
            v = lanes[:, :, lane]
            byte |= v >> np.uint64(shift) if shift >= 0 else v << np.uint64(-shift)
        out[:, :, k] = byte & np.uint64(255)
    return out.reshape(len(values), -1)


def unpack(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    group = raw.reshape(len(raw), n // 8, width)
    out = np.empty((len(raw), n // 8, 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for lane in range(8):
        first, last = lane * width // 8, ((lane + 1) * width - 1) // 8
        v = np.zeros(group.shape[:2], np.uint64)
        for k in range(first, last + 1):
            v = v << np.uint64(8) | group[:, :, k]
        out[:, :, lane] = v >> np.uint64(8 * (last + 1) - (lane + 1) * width) & mask
    return out.reshape(len(raw), n)


def encode_ids(ids: np.ndarray) -> bytes:
    """The file format of one run of ids (unsigned 32-bit)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return MAGIC + struct.pack("<II", 0, 0)
    padded = np.full(blocks * BLOCK, ids[-1], np.uint32)
    padded[:n] = ids
    padded = padded.reshape(blocks, BLOCK)
    low = padded.min(1)
    delta = padded - low[:, None]
    need = _bit_length(delta)
    options = np.percentile(need, PERCENTILES, axis=1, method="lower").astype(np.int64)
    cost = np.stack([w * BLOCK + 48 * (need > w[:, None]).sum(1) for w in options])
    width = options[cost.argmin(0), np.arange(blocks)]
    body: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        d = delta[rows]
        over = need[rows] > w
        packed = pack(d & np.uint32((1 << int(w)) - 1), int(w)) if w else np.zeros((len(rows), 0), np.uint8)
        high = d >> np.uint32(w) if w < 32 else np.zeros_like(d)
        for k, r in enumerate(rows):
            at = np.flatnonzero(over[k])
            body[r] = (struct.pack("<IBH", int(low[r]), int(w), len(at)) + packed[k].tobytes()
                       + at.astype("<u2").tobytes() + high[k, at].astype("<u4").tobytes())
    starts = np.concatenate([[0], np.cumsum([len(b) for b in body])]).astype("<u4")
    return MAGIC + struct.pack("<II", n, blocks) + starts.tobytes() + b"".join(body)


def decode_ids(data: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """Ids of the blocks [first_block, last_block), found through the index."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    n, blocks = struct.unpack_from("<II", data, 4)
    last_block = blocks if last_block is None else min(last_block, blocks)
    count = max(0, last_block - first_block)
    if not count:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(data, "<u4", blocks + 1, 12).astype(np.int64) + 12 + 4 * (blocks + 1)
    head = [struct.unpack_from("<IBH", data, int(starts[first_block + b])) for b in range(count)]
    width = np.array([h[1] for h in head])
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((count, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        size = BLOCK * int(w) // 8
        at = starts[first_block + rows] + 7
        if w:
            out[rows] = unpack(raw[at[:, None] + np.arange(size)], int(w), BLOCK)
        for r, a in zip(rows, at + size):
            m = head[r][2]
            if m:
                where = np.frombuffer(data, "<u2", m, int(a)).astype(np.int64)
                out[r, where] |= np.frombuffer(data, "<u4", m, int(a) + 2 * m) << np.uint32(w)
    out += np.array([h[0] for h in head], np.uint32)[:, None]
    return out.ravel()[:min(n, last_block * BLOCK) - first_block * BLOCK]


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """Encode all texts and write the segment table to ``path``."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(shared.value)
        shard = TaskContext.get().partitionId()
        segment = first = held = 0
        parts: list[tuple[np.ndarray, np.ndarray, list]] = []

        def flush() -> pa.RecordBatch:
            counts = np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([[x for p in parts for x in p[2]]], pa.list_(pa.int64())),
                 pa.array([counts], pa.list_(pa.int64())),
                 pa.array([encode_ids(np.concatenate([p[0] for p in parts]))], pa.binary())],
                ["shard", "segment", "first", "doc_ids", "lengths", "payload"])

        for b in batches:
            for lo, hi in text_chunks(b, limit=CHUNK_BYTES):
                part = b.slice(lo, hi - lo)
                counts, ids = tokens.encode(part.column(1))
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32)
                counts = counts + 1
                names = part.column(0).to_pylist()
                cut = np.concatenate([[0], np.cumsum(counts)])
                row = 0
                while row < len(names):  # whole documents up to the segment size
                    stop = int(np.searchsorted(cut, cut[row] + SEGMENT_IDS - held, side="left"))
                    stop = min(max(stop, row + 1), len(names))
                    parts.append((ids[cut[row]:cut[stop]], counts[row:stop], names[row:stop]))
                    held += int(cut[stop] - cut[row])
                    row = stop
                    if held >= SEGMENT_IDS:
                        yield flush()
                        segment, first, held, parts = segment + 1, first + held, 0, []
        if parts:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(ordered, run, SEGMENT_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): the ids (with the end id) of each document, as
    little-endian unsigned 32-bit integers, and the ids of all documents before it."""
    table = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    sizes = table.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    # one row for each shard: as many as the writer had partitions
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = decode_ids(b.column(5)[i].as_py()).astype("<u4")
                lengths = np.asarray(b.column(4)[i].values)
                cut = np.concatenate([[0], np.cumsum(lengths)])
                raw, names = ids.tobytes(), b.column(3)[i].values
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(np.full(len(names), b.column(0)[i].as_py(), np.int32)),
                     pa.array(cut[:-1] + b.column(2)[i].as_py()),
                     pa.array([raw[4 * x:4 * y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary())],
                    ["doc_id", "shard", "at", "ids"])

    docs = map_arrow(table, run, "doc_id long, shard int, at long, ids binary")
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "ids")
