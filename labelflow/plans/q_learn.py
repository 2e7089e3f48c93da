"""Queries: chunking, pooling, the learned scorer, batch scoring and the
config sweep."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from labelflow.operators import learn, metrics, thresholds
from labelflow.plans.catalog import register
from labelflow.plans.oracle_base import with_base
from labelflow.session import materialize, scratch_path
from labelflow.sources import contract
from labelflow.sources.fixtures import Fixtures

CFG = learn.ChunkConfig(content_size=510, stride=460)
MIN_SUPPORT = 5   # below it a code keeps the default decision threshold


@register("doc_chunks", with_base("""
tk AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS t FROM documents),
st AS (SELECT doc_id, t, unnest(range(0, greatest(len(t), 1), 460)) AS start FROM tk)""", """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INT) AS chunk_no,
       CAST(start AS INT) AS start, CAST(len(t[start + 1 : start + 510]) + 2 AS INT) AS n_tokens,
       md5(array_to_string(t[start + 1 : start + 510], ' ')) AS chunk_md5
FROM st"""))
def q_chunks(spark, sf):
    fx = Fixtures(spark, sf)
    c = learn.chunk_docs(fx.docs, CFG)
    return c.select("doc_id", "chunk_no", "start", "n_tokens", F.md5(F.array_join("tokens", " ")).alias("chunk_md5"))


@register("pool_mean", with_base("""
ex AS (SELECT doc_id, n_tokens, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM chunk_vecs)""", """
SELECT doc_id, CAST(dim AS INT) AS dim, round(sum(n_tokens * CAST(x AS DOUBLE)) / sum(n_tokens), 6) AS value
FROM ex GROUP BY doc_id, dim"""))
def q_pool_mean(spark, sf):
    p = learn.pool(Fixtures(spark, sf).chunk_vecs, "mean")
    return p.select("doc_id", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"))


@register("pool_max", with_base("""
ex AS (SELECT doc_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM chunk_vecs)""", """
SELECT doc_id, CAST(dim AS INT) AS dim, round(max(CAST(x AS DOUBLE)), 6) AS value FROM ex GROUP BY doc_id, dim"""))
def q_pool_max(spark, sf):
    p = learn.pool(Fixtures(spark, sf).chunk_vecs, "max")
    return p.select("doc_id", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"))


# a chunk's vector in the fixture is its first-token vector
@register("pool_cls", with_base("""
ex AS (SELECT doc_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM chunk_vecs)""", """
SELECT doc_id, CAST(dim AS INT) AS dim, round(max(CAST(x AS DOUBLE)), 6) AS value FROM ex GROUP BY doc_id, dim"""))
def q_pool_cls(spark, sf):
    p = learn.pool(Fixtures(spark, sf).chunk_vecs, "cls")
    return p.select("doc_id", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"))


HEAD_STEPS, HEAD_LR, HEAD_DECAY, HEAD_WEIGHT = 3, 0.5, 0.01, 2.0


def _head_sql() -> tuple[str, str]:
    """Full-batch steps on the pooled embeddings, for the bce and the focal loss."""
    ctes = ["""
ex AS (SELECT doc_id, n_tokens, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM chunk_vecs),
hx AS (SELECT doc_id, CAST(dim AS INT) AS dim, sum(n_tokens * CAST(x AS DOUBLE)) / sum(n_tokens) AS x FROM ex GROUP BY doc_id, dim
       UNION ALL SELECT DISTINCT doc_id, -1, 1.0 FROM chunk_vecs),
hn AS (SELECT count(DISTINCT doc_id) AS n FROM chunk_vecs),
w0 AS (SELECT m.loss, l.code, d.dim, 0.0 AS v FROM (VALUES ('bce'), ('focal')) m(loss), label_space l, (SELECT DISTINCT dim FROM hx) d)"""]
    for i in range(HEAD_STEPS):
        ctes.append(f"""
z{i} AS (SELECT w.loss, x.doc_id, w.code, sum(x.x * w.v) AS z FROM hx x JOIN w{i} w ON w.dim = x.dim GROUP BY w.loss, x.doc_id, w.code),
p{i} AS (SELECT z.loss, z.doc_id, z.code, t.code IS NOT NULL AS y,
           CASE WHEN t.code IS NOT NULL THEN 1 / (1 + exp(-z)) ELSE 1 - 1 / (1 + exp(-z)) END AS pt
         FROM z{i} z LEFT JOIN truth t ON t.doc_id = z.doc_id AND t.code = z.code),
d{i} AS (SELECT loss, doc_id, code, CASE WHEN y THEN s ELSE -s END AS d FROM (
         SELECT *, CASE loss WHEN 'bce' THEN -(1 - pt) * CASE WHEN y THEN {HEAD_WEIGHT} ELSE 1 END
                   ELSE 2 * pt * (1 - pt) * (1 - pt) * ln(pt) - (1 - pt) * (1 - pt) * (1 - pt) END AS s FROM p{i}) q),
g{i} AS (SELECT d.loss, d.code, x.dim, sum(d.d * x.x) / (SELECT n FROM hn) AS g FROM d{i} d JOIN hx x ON x.doc_id = d.doc_id
         GROUP BY d.loss, d.code, x.dim),
w{i + 1} AS (SELECT w.loss, w.code, w.dim, w.v - {HEAD_LR} * (g.g + CASE WHEN w.dim >= 0 THEN {HEAD_DECAY} * w.v ELSE 0 END) AS v
         FROM w{i} w JOIN g{i} g ON g.loss = w.loss AND g.code = w.code AND g.dim = w.dim)""")
    return ",".join(ctes), f"SELECT loss, code, dim, round(v, 6) AS value FROM w{HEAD_STEPS}"


@register("multilabel_head", with_base(*_head_sql()))
def q_head(spark, sf):
    """O-K4/O-K6: all codes in one job per step, with the weighted and the focal loss."""
    fx = Fixtures(spark, sf)
    x = materialize(learn.pooled_vectors(fx.chunk_vecs, "mean"))
    codes = [r["code"] for r in fx.label_space.select("code").collect()]
    w = spark.createDataFrame([(c, HEAD_WEIGHT) for c in codes], "code INT, pos_weight DOUBLE")
    truth = materialize(fx.truth.join(x.select("doc_id"), "doc_id", "left_semi"))
    out = None
    for loss in ("bce", "focal"):
        cfg = learn.TrainConfig(HEAD_STEPS, HEAD_LR, HEAD_DECAY, loss, 2.0, "gd")
        rows = learn.fit_head(x, truth, w, codes, cfg).rows(spark).select(F.lit(loss).alias("loss"), "code", "dim", F.round("value", 6).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def count_encoder():
    """A deterministic encoder: what share of a chunk's characters are vowels, spaces
    and digits, and its length in thousands."""
    import numpy as np

    def predict(texts):
        rows = [(len(t), *(sum(t.count(c) for c in g) for g in ("aeiou", " ", "0123456789"))) for t in texts.reshape(-1).tolist()]
        x = np.array(rows, np.float64).reshape(-1, 4)
        n = np.maximum(x[:, :1], 1)
        return np.hstack([x[:, 1:] / n, x[:, :1] / 1000]).astype(np.float32)
    return predict


ENCODER_HEAD = [(10, (8.0, -4.0, 0.0, 0.1), -1.0, 0.5), (20, (-6.0, 9.0, 20.0, 0.0), 0.5, 0.55), (30, (0.0, 0.0, 50.0, 0.2), -0.5, 0.45)]


@register("encoder_scores", with_base("""
tk AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS t FROM documents),
st AS (SELECT doc_id, t, unnest(range(0, greatest(len(t), 1), 460)) AS start FROM tk),
ch AS (SELECT doc_id, len(t[start + 1 : start + 510]) + 2 AS n, array_to_string(t[start + 1 : start + 510], ' ') AS c FROM st),
ft AS (SELECT doc_id, n, CAST((length(c) - length(translate(c, 'aeiou', ''))) / greatest(length(c), 1) AS FLOAT) AS f0,
         CAST((length(c) - length(replace(c, ' ', ''))) / greatest(length(c), 1) AS FLOAT) AS f1,
         CAST((length(c) - length(translate(c, '0123456789', ''))) / greatest(length(c), 1) AS FLOAT) AS f2,
         CAST(length(c) / 1000 AS FLOAT) AS f3 FROM ch),
pl AS (SELECT doc_id, sum(n * CAST(f0 AS DOUBLE)) / sum(n) AS f0, sum(n * CAST(f1 AS DOUBLE)) / sum(n) AS f1,
         sum(n * CAST(f2 AS DOUBLE)) / sum(n) AS f2, sum(n * CAST(f3 AS DOUBLE)) / sum(n) AS f3 FROM ft GROUP BY doc_id),
hd AS (SELECT * FROM (VALUES """ + ", ".join(f"({c}, {', '.join(map(str, w))}, {b}, {t})" for c, w, b, t in ENCODER_HEAD) + """)
       h(code, w0, w1, w2, w3, b, t)),
sc AS (SELECT doc_id, code, t, 1 / (1 + exp(-(f0 * w0 + f1 * w1 + f2 * w2 + f3 * w3 + b))) AS s FROM pl, hd)""", """
SELECT doc_id, code, round(s, 6) AS score, s > t AS predicted FROM sc"""))
def q_encoder(spark, sf):
    """O-K5: batch scoring with a user's encoder; the head and its thresholds are
    saved and loaded into a fresh object first."""
    import numpy as np
    head = learn.LinearHead([c for c, *_ in ENCODER_HEAD], np.array([w for _, w, _, _ in ENCODER_HEAD]), np.array([b for _, _, b, _ in ENCODER_HEAD]))
    root = scratch_path(spark, "encoder-scorer")
    learn.Scorer(CFG, 4, "mean", None, head, {c: t for c, _, _, t in ENCODER_HEAD}, count_encoder).save(spark, root)
    scorer = learn.Scorer.load(spark, root, encoder=count_encoder)
    return scorer.predict(Fixtures(spark, sf).docs).withColumn("score", F.round("score", 6))


class Learned:
    """A scorer of all codes that occur in the train split, fitted there (on
    ``sample`` of its documents, chosen by a hash of the id, if given)."""

    def __init__(self, spark, sf, cfg: learn.ChunkConfig = CFG, num_features: int = 1 << 12, pooling: str = "mean",
                 train: learn.TrainConfig = learn.TrainConfig(), cap: float = 200.0, sample: int | None = None):
        self.fx = Fixtures(spark, sf)
        self.splits = materialize(self.fx.splits)
        self.train = self.splits.where(F.col("split") == "train").select("doc_id")
        self.val = self.splits.where(F.col("split") == "val").select("doc_id")
        if sample is not None:
            self.train = materialize(self.train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
        docs = self.fx.docs.join(self.train, "doc_id", "left_semi")
        # the hashed counts are kept, not the tokens: the weights and the features are made of them
        tf = materialize(learn.chunk_tf(learn.chunk_docs(docs, cfg), num_features).select("doc_id", "n_tokens", "tf"))
        idf = learn.fit_idf(tf)
        features = learn.pooled_tf(tf, idf, num_features, pooling)
        t_train = materialize(self.fx.truth.join(self.train, "doc_id", "left_semi"))
        codes = [r["code"] for r in t_train.select("code").distinct().orderBy("code").collect()]   # the label space
        w = metrics.pos_weights(t_train, self.train, self.fx.label_space, cap=cap, digits=None)
        self.scorer = learn.Scorer(cfg, num_features, pooling, idf, learn.fit_head(features, t_train, w, codes, train))

    def thresholds(self, scores, min_support: int = MIN_SUPPORT):
        """Per code by grid search on the val scores; 0.5 for codes without one."""
        th = thresholds.tune_grid(scores.join(self.val, "doc_id", "left_semi").withColumn("method", F.lit("learned")),
                                  self.fx.truth.join(self.val, "doc_id", "left_semi"), ["method"], min_support)
        return contract.threshold_lookup(self.fx.label_space, th.drop("method"), default=0.5)


@register("learned_scores")
def q_learned(spark, sf):
    lr = Learned(spark, sf)
    return lr.scorer.score(lr.fx.docs).select("doc_id", "code", F.round("score", 6).alias("score"))


@register("score_batch")
def q_score_batch(spark, sf):
    """Tune a threshold per code, save the scorer with them, load it into a fresh
    object, score all documents (strict >) and emit the dense contract."""
    lr = Learned(spark, sf)
    s = lr.scorer.score(lr.fx.docs.join(lr.val, "doc_id", "left_semi"))
    lr.scorer.thresholds = {r["code"]: r["threshold"] for r in lr.thresholds(materialize(s)).collect()}   # a row per code
    root = scratch_path(spark, "scorer")
    lr.scorer.save(spark, root)
    p = materialize(learn.Scorer.load(spark, root).predict(lr.fx.docs))
    return contract.dense_contract(p, lr.fx.table("documents", "doc_id"), lr.fx.label_space, "learned")


_BCE = {"type": "bce", "gamma": 2.0}
_RUN = {"pooling": "mean", "content_size": 510, "stride": 460, "loss": _BCE, "thresh_min_support": 5, "epochs": 10, "lr": 0.1}
SWEEP = [
    _RUN | {"run": "short_chunks", "pooling": "max", "content_size": 128, "stride": 0, "weight_decay": 0.001},
    _RUN | {"run": "long_chunks", "thresh_min_support": 3, "pos_weight_cap": 20.0, "sample_size": 400},
    _RUN | {"run": "bad_config", "content_size": 0},
    _RUN | {"run": "bad_pooling", "pooling": "median"},
    _RUN | {"run": "focal", "loss": {"type": "focal", "gamma": 2.0}},
]
#: Run configs that are fitted at the same time.
SWEEP_THREADS = 3


def _run_config(spark, sf, c) -> tuple[float, float]:
    """(micro F1, macro F1) of one run config; fields that are missing keep the defaults."""
    if not c["content_size"] or c["content_size"] <= 0:
        raise ValueError("content_size must be positive")
    refused = [k for k in ("warmup_ratio", "batch_size", "grad_accum") if c[k] is not None]
    if refused:
        raise ValueError(f"{', '.join(refused)} cannot be applied: steps take all documents")
    given = lambda k, other: other if c[k] is None else c[k]
    base = learn.TrainConfig()
    train = learn.TrainConfig(int(given("epochs", base.steps)), float(given("lr", base.lr)), float(given("weight_decay", base.weight_decay)),
                              given("loss_type", base.loss), float(given("loss_gamma", base.gamma)))
    lr = Learned(spark, sf, learn.ChunkConfig(c["content_size"], c["stride"] or 0, c["max_chunks"]), pooling=c["pooling"], train=train,
                 cap=float(given("pos_weight_cap", 200.0)), sample=c["sample_size"])
    s = materialize(lr.scorer.score(lr.fx.docs.join(lr.val, "doc_id", "left_semi")))
    th = lr.thresholds(s, c["thresh_min_support"] or MIN_SUPPORT)
    p = s.join(th, "code").withColumn("method", F.lit(c["run"])).withColumn("predicted", F.col("score") > F.col("threshold"))
    m = metrics.evaluate(p, lr.fx.truth, lr.val, lr.fx.label_space).first()
    return float(m["micro_f1"]), float(m["macro_f1"])


@register("sweep_table")
def q_sweep(spark, sf):
    """O-K6/O-E10/O-S11: read run configs (JSON files) and fit the variants, some at
    a time; one that fails, for whatever reason, is a row with its message."""
    cfg_dir = scratch_path(spark, "configs")
    for c in SWEEP:
        contract.write_config(spark, {k: v for k, v in c.items() if k != "run"}, cfg_dir, c["run"])
    configs = contract.read_configs(spark, cfg_dir).orderBy("run").collect()   # a handful of config rows
    rows: dict[str, tuple] = {}

    def fit(c) -> None:
        head = (c["run"], c["pooling"], c["loss_type"], c["max_chunks"])
        try:
            rows[c["run"]] = (*head, *_run_config(spark, sf, c), None)
        except Exception as e:  # noqa: BLE001 - the other variants go on
            rows[c["run"]] = (*head, None, None, f"{type(e).__name__}: {e}"[:200])

    with ThreadPoolExecutor(SWEEP_THREADS) as pool:
        for job in [pool.submit(inheritable_thread_target(spark)(fit), c) for c in configs]:
            job.result()
    return spark.createDataFrame([rows[c["run"]] for c in configs], "run STRING, pooling STRING, loss STRING, chunks INT, "
                                 "micro_f1 DOUBLE, macro_f1 DOUBLE, error STRING")
