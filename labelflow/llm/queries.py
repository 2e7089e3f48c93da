"""The operators of this subpackage as queries over the given tables.

``QUERIES`` maps ``opN_<name>`` to a builder (spark, sf_dir) -> DataFrame,
``ORACLE`` holds SQL where SQL can express the result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.llm import (byte_bpe, conversation_repair, decontam, embedding_dedup, licences, merge_bpe, ngram_join,
                           quality, ranked_search, secrets, token_counts, token_files, toxicity)
from labelflow.llm.common import held_out
from labelflow.session import scratch_path
from labelflow.sources.tables import table

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *(cols or ("doc_id", "text")))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "quality")
    rows = quality.score(docs, quality.fit(docs, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_docs(spark, sf_dir))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = token_counts.CountCache(spark, scratch_path(spark, "token-cache"))
    return token_counts.count_tokens(_docs(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER), cache)


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(_docs(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER), path)
    return token_files.read_tokens(spark, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def byte_vocabulary() -> byte_bpe.ByteBpe:
    return byte_bpe.ByteBpe.read(public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_docs(spark, sf_dir), byte_vocabulary()).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_docs(spark, sf_dir, "doc_id", "text", "source"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"))


@query
def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return licences.report(docs, licences.fit(docs))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "toxic")
    rows = toxicity.score(docs, toxicity.fit(docs, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op11_merge_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_bpe.digests(merge_bpe.round_trip(_docs(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER)))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows that ``op13`` repairs: faults planted by the checksum of conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    return (conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), k.alias("k")).where("k <> 0")
            .select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversation_repair.Repair(damaged(rows)).report(rows)


_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[0-9a-z\x{80}-\x{10FFFF}]+')")

ORACLE["op8_decontamination"] = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item_id, w, least(10, len(w)) AS m FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[j:j + m - 1], ' ') AS k
        FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS j FROM bi) x),
dwin AS (SELECT doc_id, m, j, array_to_string(w[j:j + m - 1], ' ') AS k
         FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS j
               FROM dw, (SELECT DISTINCT m FROM bi) ms WHERE len(w) >= m) x),
hit AS (SELECT d.doc_id, d.j, d.m, w.item_id FROM dwin d JOIN win w ON w.m = d.m AND w.k = d.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(j, j + m)) AS p FROM hit) x GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256,
       coalesce(pos.n, 0) > 0 AS contaminated
FROM dw d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id"""


_TERMS = ("regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[0-9a-z\x{{80}}-\x{{10FFFF}}]+')")

ORACLE["op12_ranked_search"] = f"""
WITH d AS (SELECT doc_id, {_TERMS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
dn AS (SELECT row_number() OVER () AS r, doc_id, len(w) AS n, w FROM d WHERE len(w) > 0),
g AS (SELECT count(*) AS docs, sum(n) AS terms FROM dn),
it AS (SELECT item_id, unnest({_TERMS.format("text")}) AS t FROM benchmark WHERE text IS NOT NULL),
iq AS (SELECT item_id, t, count(*) AS q FROM it GROUP BY item_id, t),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM dn) x
       WHERE t IN (SELECT t FROM iq) GROUP BY r, t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * g.docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
       FROM (SELECT t, count(*) AS df FROM tf GROUP BY t) x, g),
dm AS (SELECT r, doc_id, 75 + CAST((25 * n * g.docs) // g.terms AS BIGINT) AS m FROM dn, g),
s AS (SELECT iq.item_id, dm.r, dm.doc_id, CAST(sum(iq.q * wt.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * dm.m))) AS BIGINT) AS score
      FROM tf JOIN iq ON iq.t = tf.t JOIN wt ON wt.t = tf.t JOIN dm ON dm.r = tf.r GROUP BY iq.item_id, dm.r, dm.doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
