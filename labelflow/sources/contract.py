"""Sources and sinks: documents (JSONL), the prediction contract, thresholds,
metrics, policy and run configs.

The prediction contract is the long table
``(doc_id, code, score FLOAT, predicted BOOLEAN, method)`` with one row per
(document, code of the label space) for every method, stored as Parquet
partitioned by ``method``.  Inside the engine scores stay sparse; the dense
grid is produced only here, at the edge.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The column names of the prediction file.
CONTRACT_COLUMNS = ("doc_id", "code", "score", "predicted", "method")
#: Cells of one method's grid that a task sorts or aggregates, about.
CELLS_PER_TASK = 250_000

DEED_SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("text", T.StringType()),
    # read as raw JSON text: may be an array, a bare scalar or null
    T.StructField("codes", T.StringType()),
])


# ---------------------------------------------------------------------------
# O-S1 / O-S2: documents from JSON lines
# ---------------------------------------------------------------------------
def normalise_codes(raw: F.Column, code_type: str = "int") -> F.Column:
    """A label field that is an array, a bare scalar or null -> ARRAY<code_type>."""
    trimmed = F.trim(raw)
    return (F.when(trimmed.startswith("["), F.from_json(trimmed, f"array<{code_type}>"))
            .when(raw.isNotNull() & (trimmed != "null"), F.array(trimmed.cast(code_type)))
            .otherwise(F.array().cast(f"array<{code_type}>")))


def read_deeds(spark: SparkSession, path: str, id_type: str = "bigint", code_type: str = "int") -> DataFrame:
    """Scan JSON-lines documents, keep three columns, normalise the labels.

    Blank lines are skipped by the JSON reader; the schema is explicit so no
    inference pass runs over the data.  A malformed line, a missing id or an id
    that is no ``id_type`` fails the read; ids and codes may be strings.
    """
    raw = spark.read.schema(DEED_SCHEMA).option("mode", "FAILFAST").json(path)
    doc_id = F.when(F.col("doc_id").isNull(), F.raise_error(F.lit("a document has no doc_id"))).otherwise(F.col("doc_id"))
    return raw.select(doc_id.cast(id_type).alias("doc_id"), "text",
                      F.coalesce(normalise_codes(F.col("codes"), code_type), F.array().cast(f"array<{code_type}>")).alias("codes"))


def write_deeds(docs: DataFrame, truth: DataFrame, path: str) -> None:
    """Write documents with labels as JSON lines; a single code is written as a
    bare scalar and no code as null (the shapes the reader must accept)."""
    per_doc = truth.groupBy("doc_id").agg(F.array_sort(F.collect_set("code")).alias("c"))
    rows = docs.select("doc_id", "text").join(per_doc, "doc_id", "left")
    codes = (F.when(F.col("c").isNull(), F.lit("null"))
             .when(F.size("c") == 1, F.col("c")[0].cast("string"))
             .otherwise(F.to_json(F.col("c"))))
    head = F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    # {"doc_id":..,"text":..} without its closing brace, then the raw codes field
    line = F.concat(F.expr("substr(_h, 1, length(_h) - 1)"), F.lit(',"codes":'), codes, F.lit("}"))
    rows = rows.withColumn("_h", head)
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def split_sizes(train: DataFrame, test: DataFrame) -> DataFrame:
    """O-S2: row counts of a train and a test document set."""
    return (train.select(F.lit("train").alias("part")).unionAll(test.select(F.lit("test")))
            .groupBy("part").agg(F.count(F.lit(1)).alias("n_docs")))


def sample_head(docs: DataFrame, n: int) -> DataFrame:
    """O-S12: deterministic quick-run sample: the first ``n`` documents by id.

    The limit is the feature here (a smoke-run switch); it runs as a
    TakeOrderedAndProject, i.e. a per-partition top-n then a merge.
    """
    return docs.orderBy("doc_id").limit(n)


# ---------------------------------------------------------------------------
# O-S3 / O-S4 / O-S5 / O-Q1: the prediction contract
# ---------------------------------------------------------------------------
def key_grid(docs: DataFrame, space: DataFrame) -> DataFrame:
    """Every (doc_id, code) of the label space.

    The label space is collapsed to one array row and exploded per document:
    a single-row broadcast, so documents are never shuffled for the grid.
    """
    classes = space.agg(F.array_sort(F.collect_list("code")).alias("_classes"))
    return (docs.select("doc_id").crossJoin(F.broadcast(classes))
            .select("doc_id", F.explode("_classes").alias("code")))


def _tasks(docs: DataFrame, space: DataFrame) -> int:
    """Partitions that leave CELLS_PER_TASK cells of a method's grid to a task; 0
    if the session's own parallelism does."""
    spark = docs.sparkSession
    n = -(-docs.count() * space.count() // CELLS_PER_TASK)
    # as many as the session's shuffles have at least, else joins deal the rows anew
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))) if n > spark.sparkContext.defaultParallelism else 0


def dealt_grid(docs: DataFrame, space: DataFrame) -> DataFrame:
    """``key_grid`` for a join by (doc_id, code): a large one is dealt to tasks of
    bounded size, so that their sorts do not grow with the table."""
    grid, n = key_grid(docs, space), _tasks(docs, space)
    return grid.repartition(n, "doc_id", "code") if n else grid


def dense_contract(scores: DataFrame, docs: DataFrame, space: DataFrame, method: str) -> DataFrame:
    """Sparse (doc_id, code, score, predicted) -> dense contract rows of ``method``.

    Missing cells mean score 0 and not predicted.
    """
    s = scores.select("doc_id", "code", "score", "predicted")
    return (dealt_grid(docs, space).join(s, ["doc_id", "code"], "left")
            .select("doc_id", "code",
                    F.coalesce(F.col("score"), F.lit(0.0)).cast("float").alias("score"),
                    F.coalesce(F.col("predicted"), F.lit(False)).alias("predicted"),
                    F.lit(method).alias("method")))


def write_predictions(contract: DataFrame, root: str) -> None:
    """Write contract rows, one partition per method; rewriting one method
    leaves the others in place (dynamic partition overwrite)."""
    (contract.select(*CONTRACT_COLUMNS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("method").parquet(root))


def read_predictions(spark: SparkSession, root: str, method: str) -> DataFrame:
    """O-S4: one method's contract; the partition filter prunes the other files."""
    jvm = spark.sparkContext._jvm
    part = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/method={method}")
    fs = part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(part):
        raise FileNotFoundError(f"no predictions for method {method!r} under {root}")
    return spark.read.parquet(root).where(F.col("method") == method).select(*CONTRACT_COLUMNS)


def freeze(df: DataFrame, path: str) -> None:
    """O-S5: write once; a second write of the same artefact fails."""
    df.write.mode("errorifexists").parquet(path)


def contract_violations(contract: DataFrame, docs: DataFrame, space: DataFrame) -> DataFrame:
    """O-Q1/O-P12: per method, counts of each kind of contract violation.

    Rows are dealt by document to tasks of bounded size.  One aggregation by
    (method, doc, code) counts rows, duplicates and distinct valid keys, and one
    by (method, doc) adds them up before documents are looked up; missing cells
    are documents x codes minus the valid keys, so no grid is built."""
    n = _tasks(docs, space)
    if n:
        contract = contract.repartition(n, "doc_id")
    null = F.col("score").isNull() | F.col("predicted").isNull() | F.col("doc_id").isNull() | F.col("code").isNull()
    keys = contract.groupBy("method", "doc_id", "code").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(F.when((F.col("score") < 0) | (F.col("score") > 1), 1).otherwise(0)).alias("out_of_range"),
        F.sum(F.when(null, 1).otherwise(0)).alias("null_cells"))
    known = keys.join(F.broadcast(space.select("code", F.lit(1).alias("_c"))), "code", "left")
    sums = known.groupBy("method", "doc_id").agg(
        F.sum("k").alias("k"), F.sum("out_of_range").alias("out_of_range"), F.sum("null_cells").alias("null_cells"),
        F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).alias("duplicate_keys"),
        F.sum(F.when(F.col("_c").isNotNull(), 1).otherwise(0)).alias("valid"),
        F.sum(F.when(F.col("_c").isNull(), F.col("k")).otherwise(0)).alias("unknown_code_rows"))
    by_doc = sums.join(docs.select("doc_id", F.lit(1).alias("_d")), "doc_id", "left")
    size = docs.agg(F.count(F.lit(1)).alias("_nd")).crossJoin(space.agg(F.count(F.lit(1)).alias("_nc")))   # one row
    per = by_doc.groupBy("method").agg(
        F.sum("k").alias("n_rows"), *[F.sum(c).alias(c) for c in ("out_of_range", "null_cells", "duplicate_keys", "unknown_code_rows")],
        F.sum(F.when(F.col("_d").isNotNull(), F.col("valid")).otherwise(0)).alias("_valid"))
    return per.crossJoin(F.broadcast(size)).select(
        "method", "n_rows", "out_of_range", "null_cells", "duplicate_keys",
        (F.col("_nd") * F.col("_nc") - F.col("_valid")).alias("missing_cells"), "unknown_code_rows")


def pred_wide(contract: DataFrame, classes: list[int]) -> DataFrame:
    """O-M6 wide form: one row per document, one score column per code."""
    return (contract.groupBy("method", "doc_id")
            .pivot("code", classes).agg(F.first("score")))


def align(contract: DataFrame, target_ids: DataFrame, space: DataFrame, strict: bool = False):
    """O-M6/O-M7: align contract rows to ``target_ids`` x label space.

    Unknown ids/codes are dropped, missing cells become score 0 / false.
    Returns (aligned, missing_ids); with ``strict`` an absent id is an error.
    """
    grid = key_grid(target_ids, space)
    s = contract.select("doc_id", "code", "score", "predicted")
    aligned = (grid.join(s, ["doc_id", "code"], "left")
               .select("doc_id", "code", F.coalesce("score", F.lit(0.0)).alias("score"),
                       F.coalesce("predicted", F.lit(False)).alias("predicted")))
    missing = target_ids.select("doc_id").join(contract.select("doc_id").distinct(),
                                               "doc_id", "left_anti")
    if strict and not missing.isEmpty():
        raise ValueError(f"predictions are missing for document {missing.first()['doc_id']!r} and maybe more")
    return aligned, missing


# ---------------------------------------------------------------------------
# O-S8: per-code thresholds, O-S6/O-S7/O-S10 sinks, O-S11 configs
# ---------------------------------------------------------------------------
def threshold_lookup(codes: DataFrame, thresholds: DataFrame, default: float = 0.5,
                     strict: bool = False) -> DataFrame:
    """Per-code threshold with a default for missing codes; with ``strict`` a
    missing code is an error."""
    t = codes.select("code").join(thresholds.select("code", "threshold"), "code", "left")
    if strict:
        lost = t.where("threshold IS NULL").first()
        if lost is not None:
            raise ValueError(f"no threshold for code {lost['code']!r}")
    return t.select("code", F.coalesce("threshold", F.lit(default)).alias("threshold"))


def read_threshold_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object {"code": threshold, ...} -> (code, threshold)."""
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.from_json("value", "map<string,double>").alias("m"))
    return m.select(F.explode("m").alias("k", "threshold")).select(
        F.col("k").cast("int").alias("code"), "threshold")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", header: bool = True) -> None:
    """Metrics / per-class / sweep / policy sinks (Parquet, JSON or CSV)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", str(header).lower()).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


# The field names of a run config file.
CONFIG_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()), T.StructField("pooling", T.StringType()),
    T.StructField("content_size", T.IntegerType()), T.StructField("stride", T.IntegerType()),
    T.StructField("max_chunks", T.IntegerType()), T.StructField("epochs", T.IntegerType()),
    T.StructField("lr", T.DoubleType()), T.StructField("warmup_ratio", T.DoubleType()),
    T.StructField("weight_decay", T.DoubleType()), T.StructField("batch_size", T.IntegerType()),
    T.StructField("grad_accum", T.IntegerType()),
    T.StructField("loss", T.StructType([T.StructField("type", T.StringType()),
                                        T.StructField("gamma", T.DoubleType())])),
    T.StructField("pos_weight_cap", T.DoubleType()),
    T.StructField("thresh_min_support", T.IntegerType()),
    T.StructField("sample_size", T.IntegerType()),
])


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """O-S11: one row per run config file, nested ``loss`` flattened.

    The run name is the file name (``run.json``) or, for configs written by
    Spark, the folder name (``run.json/part-...``)."""
    raw = (spark.read.schema(CONFIG_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true")
           .json(path)
           .withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json(?:/[^/]*)?$", 1)))
    return raw.select("run", *[c for c in raw.columns if c not in ("loss", "run")],
                      F.col("loss.type").alias("loss_type"), F.col("loss.gamma").alias("loss_gamma"))


def write_config(spark: SparkSession, config: dict, root: str, run: str) -> None:
    """Write one run config as a JSON document under ``root/run.json`` (through
    Spark, so ``root`` may be any shared file system)."""
    import json
    spark.createDataFrame([(json.dumps(config),)], "value STRING").coalesce(1) \
        .write.mode("overwrite").text(f"{root.rstrip('/')}/{run}.json")
