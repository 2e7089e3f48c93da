"""Chunking, pooling and the learned scorer of all codes.

Long documents are cut into overlapping token chunks, each chunk becomes a
vector, chunk vectors are pooled to one document vector, and one linear head
scores all codes.  Chunk vectors are hashed TF-IDF counts, or come from a user's
encoder (``encode_chunks``: loaded once per worker by ``predict_batch_udf``).

The head is trained on all codes together: a step is one job in which every
partition adds the gradients of all codes over its documents (a codes x
dimensions matrix), and the partial sums are added up in two levels.  The number
of jobs is the number of steps, whatever the number of codes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, IDF, IDFModel
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from labelflow.session import stage

#: Groups in which the partitions' gradients are added up first.
ADD_PARTS = 64

#: Chunks that are pooled together.
POOL_ROWS = 2_000
#: Vectors that become one dense block.
HEAD_ROWS = 512
#: Columns of the packed training rows.
PACKED = ["n", "size", "lengths", "dims", "x", "y"]
#: Type of a vector with its non-zero dimensions only.
SPARSE = "struct<size: int, dims: array<int>, values: array<double>>"

TOKEN = r"\S+"


@dataclass
class ChunkConfig:
    content_size: int = 510
    stride: int = 460          # 0 = no overlap
    max_chunks: int | None = None   # all chunks unless a run config asks for fewer
    special_tokens: int = 2    # start / end markers counted in a chunk's length


def chunk_docs(docs: DataFrame, cfg: ChunkConfig) -> DataFrame:
    """O-K1/O-K2: (doc_id, chunk_no, start, tokens, n_tokens).

    Starts 0, stride, ... below the token count (at least one chunk, so an
    empty text gives one empty chunk); all of them unless ``max_chunks`` is
    given; n_tokens counts the special tokens too (the pooling weight).
    """
    step = cfg.stride if cfg.stride > 0 else cfg.content_size
    toks = F.regexp_extract_all(F.col("text"), F.lit(TOKEN), 0)
    n = F.size(toks)
    starts = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, F.lit(step))
    if cfg.max_chunks is not None:
        starts = F.slice(starts, 1, cfg.max_chunks)
    x = docs.select("doc_id", toks.alias("_t"), starts.alias("_s"))
    c = x.select("doc_id", "_t", F.posexplode("_s").alias("chunk_no", "start"))
    return c.select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.col("start").cast("int").alias("start"),
                    F.slice("_t", F.col("start") + 1, F.lit(cfg.content_size)).alias("tokens")) \
        .withColumn("n_tokens", (F.size("tokens") + cfg.special_tokens).cast("int"))


def pool(chunk_vecs: DataFrame, how: str = "mean", vec: str = "embedding", weight: str = "n_tokens") -> DataFrame:
    """O-K3: pool chunk vectors per document: ``mean`` = weight-weighted mean,
    ``max`` = element-wise max (of vectors that are the maxima over a chunk's
    tokens), ``cls`` = element-wise max over the chunks' first-token vectors.
    Output (doc_id, dim, value), one row per dimension, aggregated per (doc, dim)
    with map-side partial sums."""
    e = chunk_vecs.select("doc_id", F.col(weight).cast("double").alias("_w"),
                          F.posexplode(vec).alias("dim", "_x"))
    if how == "mean":
        agg = (F.sum(F.col("_w") * F.col("_x").cast("double")) / F.sum("_w")).alias("value")
    elif how in ("max", "cls"):
        agg = F.max(F.col("_x").cast("double")).alias("value")
    else:
        raise ValueError(f"unknown pooling {how!r}")
    return e.groupBy("doc_id", "dim").agg(agg)


def pooled_vectors(chunk_vecs: DataFrame, how: str = "mean", vec: str = "embedding", weight: str = "n_tokens") -> DataFrame:
    """(doc_id, x): the pooled vector of each document as one array."""
    rows = pool(chunk_vecs, how, vec, weight).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_v"))
    return rows.select("doc_id", F.col("_v.value").alias("x"))


def encode_chunks(chunks: DataFrame, make_predict_fn: Callable[[], Callable], batch_size: int = 64) -> DataFrame:
    """(doc_id, chunk_no, n_tokens, embedding): chunk vectors of a user's encoder.
    ``make_predict_fn`` loads the model, once per worker, and returns a function
    from an array of chunk texts to an array (texts, dimensions)."""
    encode = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return chunks.select("doc_id", "chunk_no", "n_tokens", encode(F.array_join("tokens", " ")).alias("embedding"))


def chunk_tf(chunks: DataFrame, num_features: int = 1 << 14) -> DataFrame:
    """Hashed term counts per chunk in column ``tf``."""
    return HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features).transform(
        chunks.withColumn("tokens", F.transform("tokens", F.lower)))


def fit_idf(tf: DataFrame) -> IDFModel:
    """Fit on the training documents' chunks only."""
    return IDF(inputCol="tf", outputCol="vec").fit(tf)


def chunk_features(chunks: DataFrame, idf: IDFModel, num_features: int = 1 << 14, how: str = "mean") -> DataFrame:
    """``pooled_tf`` of chunks that have not been hashed yet."""
    return pooled_tf(chunk_tf(chunks, num_features), idf, num_features, how)


def pooled_tf(tf: DataFrame, idf: IDFModel, num_features: int = 1 << 14, how: str = "mean") -> DataFrame:
    """IDF-weighted hashed counts pooled per document: (doc_id, x), ``x`` with its
    non-zero dimensions only (SPARSE).  ``mean`` weighs chunks by their length;
    ``max`` and ``cls`` take the largest value of each dimension (a hashed chunk
    is one vector, there is no first token)."""
    if how not in ("mean", "max", "cls"):
        raise ValueError(f"unknown pooling {how!r}")
    vec = idf.transform(tf).select("doc_id", F.col("n_tokens").cast("double").alias("_w"), "vec")
    placed = vec.repartition("doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None     # id, weight, dimensions and values of the document that a slice ends with
        for b in batches:
            for lo in range(0, len(b), POOL_ROWS):
                part = b.slice(lo, POOL_ROWS)
                ids, w = part.column(0).to_pylist(), np.asarray(part.column(1))
                lengths, dims, values = _cells(part.column(2))
                if how == "mean":
                    values = values * np.repeat(w, lengths)
                doc = np.cumsum([0] + [i != j for i, j in zip(ids, ids[1:])])
                cell, weight = np.repeat(doc, lengths) * num_features + dims, np.bincount(doc, w)
                if held is not None and held[0] == ids[0]:
                    weight[0] += held[1]
                    cell, values = np.concatenate([held[2], cell]), np.concatenate([held[3], values])
                elif held is not None:
                    yield _pooled([held[0]], *held[1:], num_features, how)
                cell, at = np.unique(cell, return_inverse=True)
                if how == "mean":
                    values = np.bincount(at, values, len(cell))
                else:
                    most = np.full(len(cell), -np.inf)
                    np.maximum.at(most, at, values)
                    values = most
                last = doc[-1]
                cut = int(np.searchsorted(cell, last * num_features))
                if last:
                    first = np.flatnonzero(np.diff(doc, prepend=-1))[:-1]
                    yield _pooled([ids[i] for i in first], weight[:-1], cell[:cut], values[:cut], num_features, how)
                held = ids[-1], weight[-1:], cell[cut:] - last * num_features, values[cut:]
        if held is not None:
            yield _pooled([held[0]], *held[1:], num_features, how)

    return placed.mapInArrow(run, f"doc_id {dict(vec.dtypes)['doc_id']}, x {SPARSE}")


def _cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sparse vectors: how many cells each has, and the dimension and value of all."""
    dims, values = column.flatten()[-2:]
    return np.asarray(dims.value_lengths()).astype(np.int64), np.asarray(dims.flatten()).astype(np.int64), np.asarray(values.flatten())


def _pooled(ids: list, weight: np.ndarray, cell: np.ndarray, values: np.ndarray, size: int, how: str) -> pa.RecordBatch:
    """Rows (doc_id, x) of documents 0, 1, ... whose cells are document * size + dimension."""
    doc = cell // size
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(ids)))]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(cell % size, pa.int32()), pa.array(values / weight[doc] if how == "mean" else values, pa.float64()))]
    x = pa.StructArray.from_arrays([pa.array([size] * len(ids), pa.int32()), *lists], ["size", "dims", "values"])
    return pa.RecordBatch.from_arrays([pa.array(ids), x], ["doc_id", "x"])


# ---------------------------------------------------------------------------
# The linear head
# ---------------------------------------------------------------------------
@dataclass
class TrainConfig:
    steps: int = 30
    lr: float = 0.05
    weight_decay: float = 0.0
    loss: str = "bce"           # bce: positives weighted by code; focal: unweighted
    gamma: float = 2.0
    optimizer: str = "adam"     # or gd: plain full-batch steps


@dataclass
class LinearHead:
    """score(code) = sigmoid(weights[code] . x + bias[code])."""

    codes: list[int]
    weights: np.ndarray
    bias: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        """(code, dim, value); dimension -1 is the bias."""
        data = [(int(c), int(d) - 1, float(v)) for c, row in zip(self.codes, np.column_stack([self.bias, self.weights])) for d, v in enumerate(row)]
        return spark.createDataFrame(data, "code INT, dim INT, value DOUBLE")

    @classmethod
    def of_rows(cls, rows: DataFrame) -> "LinearHead":
        t = rows.toPandas().pivot(index="code", columns="dim", values="value").sort_index()
        return cls([int(c) for c in t.index], t[[c for c in t.columns if c >= 0]].to_numpy(), t[-1].to_numpy())


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long arrays as the rows of a matrix, without Python lists."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _dense(size: int, lengths: np.ndarray, dims: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(rows, 1 + size): ones for the bias, then the vectors."""
    x = np.zeros((len(lengths), size + 1))
    x[:, 0] = 1
    x[np.repeat(np.arange(len(lengths)), lengths), dims + 1] = values
    return x


def _blocks(column: pa.Array) -> Iterator[tuple[slice, int, np.ndarray, np.ndarray, np.ndarray]]:
    """HEAD_ROWS vectors at a time: their place, size and cells."""
    for lo in range(0, len(column), HEAD_ROWS):
        part = column.slice(lo, HEAD_ROWS)
        if pa.types.is_struct(part.type):
            size, cells = part.flatten()[0][0].as_py(), _cells(part)
        else:
            x = _matrix(part)
            size, cells = x.shape[1], (np.full(len(x), x.shape[1]), np.tile(np.arange(x.shape[1]), len(x)), x.ravel())
        yield slice(lo, lo + len(part)), size, *cells


def loss_slope(z: np.ndarray, y: np.ndarray, weight: np.ndarray, loss: str, gamma: float) -> np.ndarray:
    """Derivative of the loss by the decision z, for each cell."""
    p = 1 / (1 + np.exp(-z))
    if loss == "bce":
        return np.where(y, -weight * (1 - p), p)
    if loss != "focal":
        raise ValueError(f"unknown loss {loss!r}")
    pt = np.where(y, p, 1 - p)
    log_pt = -np.logaddexp(0, np.where(y, -z, z))
    slope = gamma * pt * (1 - pt) ** gamma * log_pt - (1 - pt) ** (gamma + 1)
    return np.where(y, slope, -slope)


def fit_head(features: DataFrame, truth: DataFrame, weights: DataFrame, codes: Sequence[int], cfg: TrainConfig = TrainConfig()) -> LinearHead:
    """O-K4: the head of all ``codes`` on (doc_id, x), ``x`` an array or SPARSE;
    ``weights`` (code, pos_weight) weighs a code's positives in the bce loss."""
    codes = sorted(int(c) for c in codes)
    y = truth.where(F.col("code").isin(*codes)).groupBy("doc_id").agg(F.collect_set(F.col("code").cast("int")).alias("codes"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, at = b.column(1), np.array(codes)
            y = np.zeros((len(b), len(codes)), bool)
            y[np.repeat(np.arange(len(b)), np.asarray(own.value_lengths())), np.searchsorted(at, np.asarray(own.flatten()))] = True
            for where, size, lengths, dims, values in _blocks(b.column(0)):
                cells = [v.tobytes() for v in (lengths.astype(np.int32), dims.astype(np.int32), values, y[where])]
                yield pa.RecordBatch.from_arrays([pa.array([len(lengths)]), pa.array([size]), *[pa.array([c], pa.binary()) for c in cells]], PACKED)

    labelled = features.join(y, "doc_id", "left").select("x", F.coalesce("codes", F.array().cast("array<int>")).alias("codes"))
    # the steps read blocks of rows as they stand in memory
    rows = stage(labelled.mapInArrow(pack, "n long, size long, lengths binary, dims binary, x binary, y binary"), "head-rows")
    first = rows.agg(F.sum("n").alias("n"), F.max("size").alias("d")).first()
    if first["n"] is None or not codes:
        return LinearHead(codes, np.zeros((len(codes), 0)), np.zeros(len(codes)))
    n, dim, k = first["n"], first["d"], len(codes)
    by = {r["code"]: r["pos_weight"] for r in weights.where(F.col("code").isin(*codes)).collect()}    # a row per code
    pos_weight = np.array([by.get(c, 1.0) for c in codes])
    w = np.zeros((k, dim + 1))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    sc = rows.sparkSession.sparkContext
    for step in range(1, cfg.steps + 1):
        shared = sc.broadcast((w, codes, pos_weight))
        g = _gradient(rows, shared, cfg) / n
        g[:, 1:] += cfg.weight_decay * w[:, 1:]
        if cfg.optimizer == "gd":
            w = w - cfg.lr * g
        else:
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            w = w - cfg.lr * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
        shared.unpersist()
    return LinearHead(codes, w[:, 1:], w[:, 0])


def _gradient(rows: DataFrame, shared, cfg: TrainConfig) -> np.ndarray:
    """(codes, 1 + dimensions) sum of the gradients over all rows: one job."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, codes, pos_weight = shared.value
        total = np.zeros_like(w)
        for b in batches:
            for size, lengths, dims, values, y in zip(*[b.column(c).to_pylist() for c in PACKED[1:]]):
                x = _dense(size, np.frombuffer(lengths, np.int32), np.frombuffer(dims, np.int32), np.frombuffer(values))
                slope = loss_slope(x @ w.T, np.frombuffer(y, bool).reshape(len(x), -1), pos_weight, cfg.loss, cfg.gamma)
                total += slope.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(codes))), pa.array([g.tobytes() for g in total], pa.binary())], ["code_no", "g"])

    def add(table):
        return pa.table({"code_no": table["code_no"][:1], "g": pa.array([sum(np.frombuffer(g.as_py()) for g in table["g"]).tobytes()], pa.binary())})

    parts = rows.mapInArrow(partial, "code_no long, g binary").withColumn("part", F.spark_partition_id() % ADD_PARTS)
    some = parts.groupBy("code_no", "part").applyInArrow(add, "code_no long, g binary")
    out = some.groupBy("code_no").applyInArrow(add, "code_no long, g binary").toArrow().sort_by("code_no")
    return np.stack([np.frombuffer(g) for g in out["g"].to_pylist()])


def score(features: DataFrame, head: LinearHead) -> DataFrame:
    """O-K4/O-K5: (doc_id, code, score) with score = P(code | document), all
    codes in one pass; the head is one broadcast table of codes x dimensions."""
    shared = features.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for b in batches:
            if len(b):
                w = np.column_stack([h.bias, h.weights])
                z = np.concatenate([_dense(*cells) @ w.T for _, *cells in _blocks(b.column(1))])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(1 / (1 + np.exp(-z))), pa.list_(pa.float64()))], ["doc_id", "_s"])

    kind = dict(features.dtypes)["doc_id"]
    s = features.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, _s array<double>")
    names = F.array(*[F.lit(int(c)) for c in head.codes])
    return s.select("doc_id", F.explode(F.arrays_zip(names.alias("code"), F.col("_s").alias("score"))).alias("_z")) \
        .select("doc_id", "_z.code", "_z.score")


@dataclass
class Scorer:
    """Everything needed to score documents it has not seen.  Without ``idf`` the
    chunk vectors come from ``encoder`` (a ``make_predict_fn``), which is code and
    is given again when the scorer is loaded."""

    config: ChunkConfig
    num_features: int
    pooling: str
    idf: IDFModel | None
    head: LinearHead
    thresholds: dict[int, float] = field(default_factory=dict)
    encoder: Callable | None = None

    def vectors(self, docs: DataFrame) -> DataFrame:
        chunks = chunk_docs(docs, self.config)
        if self.idf is None:
            return pooled_vectors(encode_chunks(chunks, self.encoder), self.pooling)
        return chunk_features(chunks, self.idf, self.num_features, self.pooling)

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, code, score) of a document table (doc_id, text)."""
        return score(self.vectors(docs), self.head)

    def predict(self, docs: DataFrame, default: float = 0.5) -> DataFrame:
        """(doc_id, code, score, predicted): score above the code's threshold."""
        rows = [(int(c), float(self.thresholds.get(c, default))) for c in self.head.codes]
        th = docs.sparkSession.createDataFrame(rows, "code INT, threshold DOUBLE")
        return self.score(docs).join(th, "code").select("doc_id", "code", "score", (F.col("score") > F.col("threshold")).alias("predicted"))

    def save(self, spark: SparkSession, root: str) -> None:
        self.head.rows(spark).coalesce(1).write.mode("overwrite").parquet(f"{root}/head")
        if self.idf is not None:
            self.idf.write().overwrite().save(f"{root}/idf")
        meta = {**asdict(self.config), "num_features": self.num_features, "pooling": self.pooling, "hashed": self.idf is not None,
                "thresholds": {str(c): t for c, t in self.thresholds.items()}}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/meta")

    @classmethod
    def load(cls, spark: SparkSession, root: str, encoder: Callable | None = None) -> "Scorer":
        meta = json.loads(spark.read.text(f"{root}/meta").first()["value"])
        hashed, th = meta.pop("hashed"), {int(c): t for c, t in meta.pop("thresholds").items()}
        return cls(num_features=meta.pop("num_features"), pooling=meta.pop("pooling"), config=ChunkConfig(**meta),
                   idf=IDFModel.load(f"{root}/idf") if hashed else None,
                   head=LinearHead.of_rows(spark.read.parquet(f"{root}/head")), thresholds=th, encoder=encoder)
