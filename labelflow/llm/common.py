"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.session import scratch_path

HELD_OUT_REMAINDER = 2
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of an Arrow batch: a batch bounded by rows alone grows with the texts.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per Spark context, and
    bound the bytes of an Arrow batch where the session does not."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_labelflow_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="labelflow-code-"), "labelflow_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("labelflow", os.path.relpath(path, root)))
    sc.addPyFile(out)
    sc._labelflow_shipped = True


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with this package importable on the executors.  When a task
    ends its worker gives its free memory back: workers live on between stages."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from fn(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):   # another C library
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back:
    computed once, lineage cut, safe when an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id"):
    """True for the rows no model may learn from (crc32 of the id as text)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a record batch whose texts add up to about ``limit``
    bytes (one longer text stands alone), so numpy work arrays stay bounded."""
    arr = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(arr), 0))
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array (null: empty) and the n + 1 row offsets."""
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=arr.offset + len(arr) + 1)[arr.offset:]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed)) | np.uint64(1)


# ---------------------------------------------------------------------------
# Fixed-size membership filter: which ids can be in a set of any size
# ---------------------------------------------------------------------------
FILTER_BITS = 1 << 23


def id_filter(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """Bits of the hashed ids, OR-ed on the executors.  At most bits / 64 rows
    reach the driver whatever the number of ids; a set bit only says "maybe", so
    every use is followed by an exact join."""
    words = (ids.select(filter_slot(column, bits).alias("slot"))
             .select(F.shiftright("slot", 6).alias("w"), F.expr("shiftleft(1L, CAST(slot % 64 AS INT))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b"))).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(words["w"], np.int64)] = np.asarray(words["b"], np.int64)
    return out


def filter_slot(column: str, bits: int = FILTER_BITS):
    """Column expression of the filter slot of an id (see ``maybe_in``)."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(bits))


def maybe_in(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    words = bits.view(np.uint64)[slots >> 6]
    return (words >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1


# ---------------------------------------------------------------------------
# Connected components
# ---------------------------------------------------------------------------
def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has
    a link.  Alternating large-star / small-star rounds: minima are aggregated
    with map-side combine, no neighbour list is gathered, and each round's edge
    table is written to the shared folder."""
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where("u <> v").distinct())
    e = staged(e, "cc")
    state = _fingerprint(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hook = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = staged(hook.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = _fingerprint(e)
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _fingerprint(e: DataFrame) -> tuple[int, int | None]:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
