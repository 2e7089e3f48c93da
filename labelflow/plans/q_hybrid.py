"""Queries: head/tail buckets, champion selection, blending, tie-break group,
mutex pairs and the whole two-variant classifier."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from labelflow.operators import labels, matching, metrics, mining, scoring
from labelflow.plans import hybrid
from labelflow.plans.catalog import register
from labelflow.plans.oracle_base import with_base
from labelflow.plans.oracle_text import TEXT_CTES, bounded, esc
from labelflow.plans.q_mining import MINING_CTES
from labelflow.plans.q_text_matching import stripped_docs
from labelflow.session import materialize
from labelflow.sources.fixtures import (HEAD_SHARE, METHODS, MUTEX_PAIRS, PREFIX_RX, PREFIX_WINDOW, TIEBREAK_DEFAULT,
                                        TIEBREAK_GROUP, TIEBREAK_RULES, TITLE_LEN, Fixtures)

HYB_CTES = r"""
head AS (SELECT code FROM truth GROUP BY code HAVING count(DISTINCT doc_id) >= 3e-1 * (SELECT count(*) FROM documents)),
trd AS (SELECT doc_id FROM splits WHERE split = 'train'),
vd AS (SELECT doc_id FROM splits WHERE split = 'val'),
tc AS (SELECT p.method, p.code,
         sum(CASE WHEN p.predicted AND t.code IS NOT NULL THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN p.predicted AND t.code IS NULL THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN (NOT p.predicted) AND t.code IS NOT NULL THEN 1 ELSE 0 END) AS fn
       FROM preds p JOIN trd ON trd.doc_id = p.doc_id LEFT JOIN truth t ON t.doc_id = p.doc_id AND t.code = p.code
       GROUP BY p.method, p.code),
tf1 AS (SELECT method, code, CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END AS f1
        FROM tc),
champ AS (SELECT a.code, a.f1 AS f1_v1, b.f1 AS f1_v2, CASE WHEN a.f1 >= b.f1 THEN 1 ELSE 2 END AS champion
          FROM tf1 a JOIN tf1 b ON a.code = b.code AND a.method = 'm1' AND b.method = 'm2'),
bl AS (SELECT p.doc_id, p.code, p.score, p.predicted FROM preds p JOIN champ c ON c.code = p.code
         AND p.method = CASE WHEN c.champion = 1 THEN 'm1' ELSE 'm2' END),
fired AS (SELECT DISTINCT doc_id FROM bl WHERE predicted AND code IN (20, 30, 40)),
win AS (SELECT f.doc_id, CASE WHEN regexp_matches(d.text, '(?is)für') THEN 30
                              WHEN regexp_matches(d.text, '(?is)los') THEN 40 ELSE 20 END AS winner
        FROM fired f JOIN documents d ON d.doc_id = f.doc_id),
tb AS (SELECT b.doc_id, b.code, b.score,
         CASE WHEN w.winner IS NOT NULL AND b.code IN (20, 30, 40) THEN b.code = w.winner ELSE b.predicted END AS predicted
       FROM bl b LEFT JOIN win w ON w.doc_id = b.doc_id),
s1 AS (SELECT doc_id, code, score FROM preds WHERE method = 'm1')
"""


def _fx_preds(spark, sf):
    fx = Fixtures(spark, sf)
    s = materialize(fx.splits)
    return fx, s


def _champion(fx, s):
    train = s.where(F.col("split") == "train").select("doc_id")
    pc = materialize(metrics.per_class(fx.preds.join(train, "doc_id", "left_semi"), fx.truth, train, fx.label_space,
                                       digits=None, methods=METHODS))   # methods x codes rows
    return scoring.champion(pc.where(F.col("method") == "m1"), pc.where(F.col("method") == "m2"), fx.label_space)


def _blended(fx, s):
    p = fx.preds
    champ = materialize(_champion(fx, s))
    return scoring.blend(p.where(F.col("method") == "m1"), p.where(F.col("method") == "m2"), champ)


def _head(fx):
    n = fx.table("documents", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return labels.head_tail(fx.truth, share=HEAD_SHARE, n_docs=n).where(F.col("is_head")).select("code")


@register("tail_bucket", with_base(HYB_CTES, """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT t.doc_id FROM truth t JOIN head h ON h.code = t.code)"""))
def q_tail_bucket(spark, sf):
    fx = Fixtures(spark, sf)
    return scoring.tail_bucket(fx.table("documents", "doc_id"), fx.truth, _head(fx))


@register("tail_routed", with_base(HYB_CTES, """
SELECT doc_id FROM documents WHERE doc_id NOT IN (
  SELECT p.doc_id FROM preds p JOIN head h ON h.code = p.code WHERE p.method = 'm1' AND p.predicted)"""))
def q_tail_routed(spark, sf):
    fx = Fixtures(spark, sf)
    return scoring.tail_routed(fx.table("documents", "doc_id"), fx.preds.where(F.col("method") == "m1"), _head(fx))


@register("champion", with_base(HYB_CTES, """
SELECT code, round(f1_v1, 6) AS f1_v1, round(f1_v2, 6) AS f1_v2, champion FROM champ"""))
def q_champion(spark, sf):
    fx, s = _fx_preds(spark, sf)
    c = _champion(fx, s)
    return c.select("code", F.round("f1_v1", 6).alias("f1_v1"), F.round("f1_v2", 6).alias("f1_v2"), "champion")


@register("hybrid_scores", with_base(HYB_CTES, "SELECT doc_id, code, round(score, 9) AS score, predicted FROM bl"))
def q_hybrid_scores(spark, sf):
    fx, s = _fx_preds(spark, sf)
    b = _blended(fx, s)
    return b.select("doc_id", "code", F.round("score", 9).alias("score"), "predicted")


@register("tiebreak_group", with_base(HYB_CTES, """
SELECT doc_id, code, predicted FROM tb WHERE code IN (20, 30, 40)"""))
def q_tiebreak(spark, sf):
    fx, s = _fx_preds(spark, sf)
    b = materialize(_blended(fx, s))
    t = scoring.tiebreak(b, fx.docs, TIEBREAK_GROUP, TIEBREAK_RULES, TIEBREAK_DEFAULT, fx.label_space)
    return t.where(F.col("code").isin(*TIEBREAK_GROUP)).select("doc_id", "code", "predicted")


def _mutex_sql() -> str:
    cur = "tb"
    ctes = []
    for i, (a, b) in enumerate(MUTEX_PAIRS):
        nxt = f"mx{i}"
        ctes.append(f"""{nxt} AS (
  SELECT x.doc_id, x.code, x.score,
    CASE WHEN l.loser IS NOT NULL AND x.code = l.loser THEN false ELSE x.predicted END AS predicted
  FROM {cur} x LEFT JOIN (
    SELECT pa.doc_id, CASE WHEN coalesce(sa.score, 0.0) >= coalesce(sb.score, 0.0) THEN {b} ELSE {a} END AS loser
    FROM {cur} pa JOIN {cur} pb ON pb.doc_id = pa.doc_id AND pa.code = {a} AND pb.code = {b}
    LEFT JOIN s1 sa ON sa.doc_id = pa.doc_id AND sa.code = {a} LEFT JOIN s1 sb ON sb.doc_id = pa.doc_id AND sb.code = {b}
    WHERE pa.predicted AND pb.predicted) l ON l.doc_id = x.doc_id)""")
        cur = nxt
    return ",\n".join(ctes), cur


_MX_CTES, _MX_LAST = _mutex_sql()
_MX_CODES = ", ".join(str(c) for p in MUTEX_PAIRS for c in p)


@register("mutex_pairs", with_base(HYB_CTES + "," + _MX_CTES, f"""
SELECT doc_id, code, predicted FROM {_MX_LAST} WHERE code IN ({_MX_CODES})"""))
def q_mutex(spark, sf):
    fx, s = _fx_preds(spark, sf)
    b = materialize(_blended(fx, s))
    t = scoring.tiebreak(b, fx.docs, TIEBREAK_GROUP, TIEBREAK_RULES, TIEBREAK_DEFAULT, fx.label_space)
    ref = fx.preds.where(F.col("method") == "m1").select("doc_id", "code", "score")
    m = scoring.mutex(t, ref, MUTEX_PAIRS)
    codes = [c for p in MUTEX_PAIRS for c in p]
    return m.where(F.col("code").isin(*codes)).select("doc_id", "code", "predicted")


def _fixture_patterns(fx, truth):
    """Curated seed phrases plus terms mined from the given documents."""
    def build(codes, docs):
        n = mining.corpus_size(docs)
        index = mining.term_index(docs, truth, codes)
        vocab = mining.vocabulary(index.terms, n)
        chi = materialize(mining.mine_chi2(docs, vocab, truth, codes, n))
        tfi = materialize(mining.mine_tfidf(docs, vocab, truth, codes, n, index=index))
        hh = mining.terms_with_hits(chi.select("term").unionByName(tfi.select("term")), docs)
        merged = mining.merge_mined(chi, tfi, hh)
        titles = matching.zone_texts(docs, PREFIX_RX, PREFIX_WINDOW, TITLE_LEN, ("title",)).select(
            "doc_id", F.col("ztext").alias("title"))
        valid = mining.validate_candidates(fx.curated.select("code", "phrase", F.lit(None).cast("string").alias("name")),
                                           titles, truth)
        return mining.build_pattern_table(fx.curated, merged, valid, codes)
    return build


def _renamed(sql: str, names: list[str], suffix: str) -> str:
    return re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: m.group(1) + suffix, sql)


def _tiebreak_sql(name: str, src: str, space: str) -> str:
    """CTE ``name``: the predictions ``src`` after the tie-break group."""
    grp = ", ".join(map(str, TIEBREAK_GROUP))
    rules = ", ".join(f"CASE WHEN regexp_matches(d.text, '(?is){rx}') THEN {c} END" for rx, c in TIEBREAK_RULES)
    return f"""
{name}_k AS (SELECT list(code) AS ks FROM {space} WHERE code IN ({grp})),
{name}_w AS (SELECT * FROM (
  SELECT f.doc_id, list_filter([{rules}, {TIEBREAK_DEFAULT}], lambda c: c IS NOT NULL AND list_contains(k.ks, c))[1] AS winner
  FROM (SELECT DISTINCT doc_id FROM {src} WHERE predicted AND code IN ({grp})) f JOIN stripped d ON d.doc_id = f.doc_id,
       {name}_k k WHERE len(k.ks) >= 2) x WHERE winner IS NOT NULL),
{name} AS (
  SELECT s.doc_id, s.code, s.score,
    CASE WHEN w.winner IS NOT NULL AND s.code IN ({grp}) THEN s.code = w.winner ELSE s.predicted END AS predicted
  FROM {src} s LEFT JOIN {name}_w w ON w.doc_id = s.doc_id
  UNION ALL SELECT w.doc_id, w.winner AS code, 0.0 AS score, true AS predicted FROM {name}_w w
  WHERE NOT EXISTS (SELECT 1 FROM {src} s WHERE s.doc_id = w.doc_id AND s.code = w.winner))"""


def _variant_sql(v: int, docs: str, space: str, merged: str, validated: str) -> str:
    """Pattern table, weights, thresholds and cross-validated predictions."""
    return f"""
vp{v} AS (
  SELECT pattern_id, code, source_text, match_zone, parts FROM pat WHERE code IN (SELECT code FROM {space})
  UNION ALL SELECT 'm-' || source || '-' || code || '-' || term, code, term, 'full', [term] FROM {merged}
  UNION ALL SELECT 'v-' || v.code || '-' || v.phrase, v.code, v.phrase, 'title', p.parts
  FROM {validated} v JOIN (SELECT DISTINCT source_text, parts FROM pat) p ON p.source_text = v.phrase
  WHERE v.code IN (SELECT code FROM {space})),
h{v} AS (SELECT h.doc_id, p.pattern_id, p.code FROM term_hits h JOIN vp{v} p
         ON p.match_zone = h.match_zone AND p.source_text = h.source_text),
tt{v} AS (SELECT t.doc_id, t.code FROM truth t JOIN {docs} d ON d.doc_id = t.doc_id WHERE t.code IN (SELECT code FROM {space})),
hp{v} AS (SELECT p.pattern_id, CAST(count(t.doc_id) AS DOUBLE) / greatest(count(h.doc_id), 1) AS weight
  FROM vp{v} p LEFT JOIN (SELECT h.* FROM h{v} h JOIN {docs} d ON d.doc_id = h.doc_id) h ON h.pattern_id = p.pattern_id
  LEFT JOIN tt{v} t ON t.doc_id = h.doc_id AND t.code = h.code GROUP BY p.pattern_id),
sc{v} AS (SELECT * FROM (SELECT h.doc_id, h.code, round(sum(w.weight), 9) AS score
  FROM h{v} h JOIN hp{v} w ON w.pattern_id = h.pattern_id GROUP BY h.doc_id, h.code) x WHERE score > 0),
st{v} AS (SELECT s.*, f.fold, t.doc_id IS NOT NULL AS y FROM sc{v} s JOIN {docs} d ON d.doc_id = s.doc_id
          JOIN splits f ON f.doc_id = s.doc_id LEFT JOIN tt{v} t ON t.doc_id = s.doc_id AND t.code = s.code),
tn{v} AS (SELECT CAST(range AS INT) - 1 AS tune FROM range(6)),
per{v} AS (SELECT tune, code, score, count(*) AS n, count(*) FILTER (WHERE y) AS pos FROM st{v}, tn{v}
           WHERE tune < 0 OR tune <> fold GROUP BY tune, code, score),
sup{v} AS (SELECT tune, t.code, count(*) AS support FROM tt{v} t JOIN splits f ON f.doc_id = t.doc_id, tn{v}
           WHERE tune < 0 OR tune <> f.fold GROUP BY tune, t.code),
cum{v} AS (SELECT tune, code, score, sum(n) OVER w AS n_cum, sum(pos) OVER w AS pos_cum FROM per{v}
           WINDOW w AS (PARTITION BY tune, code ORDER BY score DESC)),
th{v} AS (SELECT tune, code, threshold FROM (
  SELECT c.tune, c.code, c.score AS threshold, row_number() OVER (PARTITION BY c.tune, c.code
    ORDER BY CAST(2 * c.pos_cum AS DOUBLE) / (c.n_cum + s.support) DESC, c.score) AS r
  FROM cum{v} c JOIN sup{v} s ON s.tune = c.tune AND s.code = c.code WHERE c.pos_cum > 0) x WHERE r = 1),
cvp{v} AS (SELECT s.doc_id, s.code, s.score, coalesce(s.score >= t.threshold, false) AS predicted
           FROM st{v} s LEFT JOIN th{v} t ON t.tune = s.fold AND t.code = s.code),
{_tiebreak_sql(f"cvt{v}", f"cvp{v}", space)},
f1{v} AS (SELECT l.code, CASE WHEN p.n + t.n > 0 THEN CAST(2 * p.tp AS DOUBLE) / (p.n + t.n) ELSE 0.0 END AS f1 FROM label_space l
  JOIN (SELECT l.code, count(p.doc_id) AS n, count(t.doc_id) AS tp FROM label_space l
        LEFT JOIN (SELECT * FROM cvt{v} WHERE predicted) p ON p.code = l.code
        LEFT JOIN tt1 t ON t.doc_id = p.doc_id AND t.code = p.code GROUP BY l.code) p ON p.code = l.code
  JOIN (SELECT l.code, count(t.doc_id) AS n FROM label_space l LEFT JOIN tt1 t ON t.code = l.code GROUP BY l.code) t ON t.code = l.code)"""


def _mark(x: str) -> str:
    return rf"regexp_replace({x}, '(\p{{L}}+)', chr(1) || '\1' || chr(2), 'g')"


def _hybrid_sql() -> tuple[str, str]:
    own = MINING_CTES[len(TEXT_CTES.strip()):].lstrip(",\n ")
    names = re.findall(r"(?:^|\n)(\w+) AS \(", own)
    second = _renamed(own, [*names, "label_space"], "_b")
    bucket = "SELECT doc_id, text FROM mdocs WHERE doc_id NOT IN (SELECT t.doc_id FROM truth t JOIN hd ON hd.code = t.code)"
    second = re.sub(r"mdocs_b AS \(SELECT.*?'train'\)", lambda m: f"mdocs_b AS ({bucket})", second, count=1, flags=re.S)
    mutex, at = [], "blended"
    for i, (a, b) in enumerate(MUTEX_PAIRS):
        mutex.append(f"""mu{i} AS (
  SELECT x.doc_id, x.code, x.score, x.predicted AND NOT (l.loser IS NOT NULL AND x.code = l.loser) AS predicted FROM {at} x LEFT JOIN (
    SELECT pa.doc_id, CASE WHEN coalesce(sa.score, 0.0) >= coalesce(sb.score, 0.0) THEN {b} ELSE {a} END AS loser
    FROM {at} pa JOIN {at} pb ON pb.doc_id = pa.doc_id AND pa.code = {a} AND pb.code = {b}
    LEFT JOIN q1 sa ON sa.doc_id = pa.doc_id AND sa.code = {a} LEFT JOIN q1 sb ON sb.doc_id = pa.doc_id AND sb.code = {b}
    WHERE pa.predicted AND pb.predicted) l ON l.doc_id = x.doc_id)""")
        at = f"mu{i}"
    ctes = [TEXT_CTES.strip(), own, f"""
hd AS (SELECT t.code FROM truth t JOIN mdocs d ON d.doc_id = t.doc_id GROUP BY t.code
       HAVING count(DISTINCT t.doc_id) >= {HEAD_SHARE} * (SELECT count(*) FROM mdocs)),
label_space_b AS (SELECT code FROM label_space WHERE code NOT IN (SELECT code FROM hd))""", second, f"""
vterm AS (SELECT DISTINCT match_zone, source_text, parts FROM (
  SELECT match_zone, source_text, parts FROM pat UNION ALL SELECT 'title', source_text, parts FROM pat
  UNION ALL SELECT 'full', term, [term] FROM merged UNION ALL SELECT 'full', term, [term] FROM merged_b) x),
zm AS (SELECT doc_id, zone, ztext, {_mark('ztext')} AS marked FROM ztexts),
vl AS (SELECT match_zone, source_text, lower(source_text) AS term, {_mark('lower(source_text)')} AS mterm,
         regexp_matches(lower(source_text), '^\\p{{L}}(.*\\p{{L}})?$') AS edged FROM vterm WHERE len(parts) = 1),
vpart AS (SELECT match_zone, source_text, parts, unnest(parts) AS part FROM vterm WHERE len(parts) >= 2),
term_hits AS (
  SELECT z.doc_id, l.match_zone, l.source_text FROM zm z JOIN vl l ON z.zone = l.match_zone
  WHERE CASE WHEN l.edged THEN contains(z.marked, l.mterm) ELSE contains(z.ztext, l.term) AND {bounded('z.ztext', 'l.term')} END
  UNION ALL
  SELECT c.doc_id, c.match_zone, c.source_text FROM (
    SELECT z.doc_id, z.zone, f.match_zone, f.source_text, f.parts FROM zm z JOIN vpart f ON z.zone = f.match_zone
    WHERE contains(z.ztext, f.part) AND {bounded('z.ztext', 'f.part')} GROUP BY ALL
    HAVING count(DISTINCT f.part) = len(list_distinct(f.parts))) c JOIN zm z ON z.doc_id = c.doc_id AND z.zone = c.zone
  WHERE regexp_matches(z.ztext, '(?s)' || array_to_string(list_transform(c.parts, lambda x: {esc('x')}), '.{{0,80}}')))""",
            _variant_sql(1, "mdocs", "label_space", "merged", "validated"),
            _variant_sql(2, "mdocs_b", "label_space_b", "merged_b", "validated_b"), """
hc AS (SELECT a.code, CASE WHEN a.f1 >= b.f1 THEN 1 ELSE 2 END AS champion FROM f11 a JOIN f12 b ON b.code = a.code),
a1 AS (SELECT s.doc_id, s.code, s.score, coalesce(s.score >= t.threshold, false) AS predicted
       FROM sc1 s LEFT JOIN th1 t ON t.tune = -1 AND t.code = s.code)""", _tiebreak_sql("q1", "a1", "label_space"), """
rd AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT q.doc_id FROM q1 q JOIN hd ON hd.code = q.code WHERE q.predicted)),
a2 AS (SELECT s.doc_id, s.code, s.score, coalesce(s.score >= t.threshold, false) AS predicted
       FROM sc2 s JOIN rd ON rd.doc_id = s.doc_id LEFT JOIN th2 t ON t.tune = -1 AND t.code = s.code)""",
            _tiebreak_sql("q2", "a2", "label_space_b"), """
blended AS (SELECT q.* FROM q1 q JOIN hc ON hc.code = q.code AND hc.champion = 1
            UNION ALL SELECT q.* FROM q2 q JOIN hc ON hc.code = q.code AND hc.champion = 2)""", *mutex]
    select = f"""
SELECT doc_id, code, round(least(greatest(score / (SELECT greatest(max(score), 1.0) FROM {at}), 0.0), 1.0), 9) AS score, predicted
FROM {at}"""
    return ",\n".join(c.strip().rstrip(",") for c in ctes), select


@register("hybrid_end_to_end", with_base(*_hybrid_sql()))
def q_hybrid_e2e(spark, sf):
    fx, s = _fx_preds(spark, sf)
    docs, truth = materialize(stripped_docs(fx)), materialize(fx.truth)
    train = docs.join(s.where(F.col("split") == "train").select("doc_id"), "doc_id", "left_semi")
    cfg = hybrid.HybridConfig(prefix_rx=PREFIX_RX, window=PREFIX_WINDOW, title_len=TITLE_LEN,
                              head_share=HEAD_SHARE, tiebreak_group=TIEBREAK_GROUP,
                              tiebreak_rules=TIEBREAK_RULES, tiebreak_default=TIEBREAK_DEFAULT,
                              mutex_pairs=MUTEX_PAIRS)
    out = hybrid.run_hybrid(train, docs, truth, labels.label_space(truth), s.select("doc_id", "fold"),
                            _fixture_patterns(fx, truth), cfg)
    return out["pred"].select("doc_id", "code", F.round("score", 9).alias("score"), "predicted")
