"""Fixture views over the test tables (FIXTURES.md part B).

The test tables carry documents but no code labels, so labels, a label space,
a frozen split, two scored methods and a seed phrase table are derived from
them deterministically.  Every view is a lazy DataFrame over the Parquet
scans: its work grows with the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.sources import tables

# ---------------------------------------------------------------------------
# Fixed fixture parameters (FIXTURES.md part B)
# ---------------------------------------------------------------------------
PREFIX_RX = r"^[^.]{0,200}\.\s*"      # first sentence end counts as the prefix
PREFIX_WINDOW = 500
TITLE_LEN = 600
HEAD_SHARE = 0.3                       # head/tail cutoff as a share of documents
TIEBREAK_GROUP = (20, 30, 40)
TIEBREAK_RULES = ((r"für", 30), (r"los", 40))
TIEBREAK_DEFAULT = 20
METHODS = ("m1", "m2")                 # the two scored methods
MUTEX_PAIRS = ((10, 20), (30, 40), (1, 3))

# seed phrases: literal, non-ASCII, multi-word, gapped (…), title zone, non-letter edge
CURATED_ROWS = [
    (10, "seed", "the", "full"), (10, "seed", "and", "full"),
    (10, "seed", "that … the", "full"), (10, "seed", "this", "title"),
    (20, "seed", "les", "full"), (20, "seed", "dans", "full"),
    (20, "seed", "que … des", "full"), (20, "seed", "une", "title"),
    (30, "seed", "und", "full"), (30, "seed", "für", "full"),
    (30, "seed", "der … die", "full"), (30, "seed", "nicht", "title"),
    (40, "seed", "los", "full"), (40, "seed", "para", "full"),
    (40, "seed", "que … las", "full"), (40, "seed", "del", "title"),
    (2, "seed", "licensed under", "full"), (2, "seed", "apache license", "full"),
    (1, "seed", "released under the mit license", "full"), (3, "seed", "cc by-nc 4.0", "full"),
]


def truth_from(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, code): language code, source code, quality and toxic codes."""
    lang_code = (F.when(F.col("lang") == "en", 10).when(F.col("lang") == "fr", 20)
                 .when(F.col("lang") == "de", 30).otherwise(40))
    source_code = F.lit(100) + F.expr("CAST(substr(source, 4) AS INT)")
    quality_code = F.when(F.col("quality") == 1, 1).otherwise(3)
    # one scan of each table: a row's codes are exploded
    by_doc = documents.select("doc_id", F.explode(F.array(lang_code, source_code)).alias("code"))
    by_label = labels.select("doc_id", F.explode(
        F.when(F.col("toxic") == 1, F.array(quality_code, F.lit(2))).otherwise(F.array(quality_code))).alias("code"))
    return by_doc.unionAll(by_label)


def unit_hash(doc: str, code: str, salt: int) -> F.Column:
    """Deterministic pseudo-random number in [0, 1) per (doc, code)."""
    return ((F.col(doc) * 7919 + F.col(code) * 104729 + salt) % 10007).cast("double") / F.lit(10007.0)


@dataclass
class Fixtures:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str, *cols: str) -> DataFrame:
        return tables.table(self.spark, self.sf_dir, name, *cols)

    @property
    def documents(self) -> DataFrame:
        return self.table("documents", "doc_id", "text", "lang", "source")

    @property
    def docs(self) -> DataFrame:
        return self.table("documents", "doc_id", "text")

    @property
    def truth(self) -> DataFrame:
        return truth_from(self.table("documents", "doc_id", "lang", "source"),
                          self.table("labels", "doc_id", "quality", "toxic"))

    @property
    def label_space(self) -> DataFrame:
        from labelflow.operators import labels
        return labels.label_space(self.truth)

    @property
    def splits(self) -> DataFrame:
        from labelflow.operators import labels
        return labels.stratified_split(self.truth)

    @property
    def grid(self) -> DataFrame:
        """Dense (doc_id, code, y, u1, u2) over documents x label space."""
        from labelflow.sources import contract
        keys = contract.dealt_grid(self.table("documents", "doc_id"), self.label_space)
        t = self.truth.select("doc_id", "code", F.lit(1).alias("y"))
        return (keys.join(t, ["doc_id", "code"], "left")
                .select("doc_id", "code", F.coalesce("y", F.lit(0)).alias("y"),
                        unit_hash("doc_id", "code", 1299709).alias("u1"),
                        unit_hash("doc_id", "code", 2599418).alias("u2")))

    @property
    def preds(self) -> DataFrame:
        """Two methods of unequal quality in the prediction-contract shape."""
        g = self.grid
        y1 = F.col("y") == 1
        m1 = (F.when(y1, F.lit(3e-1) + F.lit(7e-1) * F.col("u1"))
              .otherwise(F.lit(75e-2) * F.col("u1") * F.col("u1") * F.col("u1")))
        m2 = F.when(y1, F.col("u2")).otherwise(F.lit(6e-1) * F.col("u2") * F.col("u2"))
        both = F.array(*[F.struct(F.lit(name).alias("method"), score.alias("score")) for name, score in zip(METHODS, (m1, m2))])
        return (g.select("doc_id", "code", F.explode(both).alias("_m"))
                .select("_m.method", "doc_id", "code", "_m.score")
                .withColumn("predicted", F.col("score") >= F.lit(5e-1)))

    @property
    def curated(self) -> DataFrame:
        rows = [(i + 1, *r) for i, r in enumerate(CURATED_ROWS)]
        return self.spark.createDataFrame(
            rows, "ord INT, code INT, source STRING, phrase STRING, match_zone STRING")

    @property
    def patterns(self) -> DataFrame:
        from labelflow.operators import patterns
        return patterns.from_phrases(self.curated)

    @property
    def chunk_vecs(self) -> DataFrame:
        e = self.table("embeddings", "vec_id", "embedding")
        return e.select(F.floor(F.col("vec_id") / 4).cast("bigint").alias("doc_id"),
                        (F.col("vec_id") % 4).cast("int").alias("chunk_no"), "embedding",
                        (1 + F.col("vec_id") % 7).cast("int").alias("n_tokens"))
