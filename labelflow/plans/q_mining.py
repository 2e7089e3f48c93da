"""Queries: n-grams, vocabulary, TF-IDF, mined terms, validation, pattern table.

The mining corpus is the train split of the prefix-stripped documents.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from labelflow.functions.stopwords import DUTCH_STOPWORDS
from labelflow.operators import matching, mining
from labelflow.plans.catalog import register
from labelflow.plans.oracle_base import with_base
from labelflow.plans.oracle_text import TEXT_CTES, esc
from labelflow.plans.q_text_matching import stripped_docs
from labelflow.session import materialize
from labelflow.sources.fixtures import PREFIX_RX, PREFIX_WINDOW, TITLE_LEN, Fixtures


class MinedFixture:
    def __init__(self, spark, sf):
        self.fx = Fixtures(spark, sf)
        train = materialize(self.fx.splits.where(F.col("split") == "train").select("doc_id"))
        self.docs = materialize(stripped_docs(self.fx).join(train, "doc_id", "left_semi"))
        self.dt = mining.doc_terms(self.docs)
        self.n = mining.corpus_size(self.docs)
        self.truth = materialize(self.fx.truth)
        self.codes = materialize(self.fx.label_space.select("code"))

    @cached_property
    def index(self):
        return mining.term_index(self.docs, self.truth, self.codes)

    @cached_property
    def vocab(self):
        return mining.vocabulary(self.index.terms, self.n)

    @property
    def dtv(self):
        return mining.restrict_to_vocab(self.index, self.vocab)

    @property
    def weights(self):
        return mining.tfidf(self.dtv, self.n)

    @cached_property
    def tfidf_top(self):
        return materialize(mining.mine_tfidf(self.docs, self.vocab, self.truth, self.codes, self.n, index=self.index))

    @cached_property
    def chi2_top(self):
        return materialize(mining.mine_chi2(self.docs, self.vocab, self.truth, self.codes, self.n))

    @cached_property
    def has_hits(self):
        terms = self.chi2_top.select("term").unionByName(self.tfidf_top.select("term"))
        return materialize(mining.terms_with_hits(terms, self.docs))

    @property
    def merged(self):
        return mining.merge_mined(self.chi2_top, self.tfidf_top, self.has_hits)

    @property
    def titles(self):
        z = matching.zone_texts(self.docs, PREFIX_RX, PREFIX_WINDOW, TITLE_LEN, ("title",))
        return z.select("doc_id", F.col("ztext").alias("title"))

    @property
    def candidates(self):
        return self.fx.curated.select("code", "phrase", F.lit(None).cast("string").alias("name"))

    @property
    def validated(self):
        return mining.validate_candidates(self.candidates, self.titles, self.truth)

    @property
    def pattern_table(self):
        return mining.build_pattern_table(self.fx.curated, self.merged, self.validated, self.codes)


_STOPS = "[" + ", ".join(f"'{w}'" for w in DUTCH_STOPWORDS) + "]"
_TOK = ("list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+'), "
        "lambda w: regexp_matches(w, '^[a-zA-ZÀ-ÖØ-öø-ÿ]{{3,}}$'){stop})")


def _tok(t, stop=True):
    return _TOK.format(t=t, stop=f" AND NOT list_contains({_STOPS}, w)" if stop else "")


def _grams(t):
    return (f"list_concat(list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])), "
            f"list_transform(range(1, len({t}) - 1), lambda i: {t}[i] || ' ' || {t}[i + 1] || ' ' || {t}[i + 2]))")


MINING_CTES = TEXT_CTES.strip() + f""",
mdocs AS (SELECT s.doc_id, s.text FROM stripped s JOIN splits p ON p.doc_id = s.doc_id WHERE p.split = 'train'),
mtok AS (SELECT doc_id, {_tok('text')} AS t, {_tok('text', False)} AS u FROM mdocs),
mgrams AS (SELECT doc_id, unnest({_grams('t')}) AS term FROM mtok),
mdt AS (SELECT doc_id, term, count(*) AS tf FROM mgrams GROUP BY doc_id, term),
mN AS (SELECT count(*) AS n_docs FROM mdocs),
mstats AS (SELECT term, count(*) AS df, sum(tf) AS tf_sum FROM mdt GROUP BY term),
vocab AS (SELECT term, df, tf_sum FROM mstats, mN WHERE df >= 2 AND df <= 5e-1 * n_docs),
mtf AS (SELECT d.doc_id, d.term, d.tf * (ln((1 + n.n_docs) / (1 + v.df)) + 1) AS w0
        FROM mdt d JOIN vocab v ON v.term = d.term, mN n),
mw AS (SELECT doc_id, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY doc_id)) AS w FROM mtf),
my AS (SELECT DISTINCT t.doc_id, t.code FROM truth t JOIN mdocs d ON d.doc_id = t.doc_id
       WHERE t.code IN (SELECT code FROM label_space)),
msz AS (SELECT l.code, coalesce(p.n_pos, 0) AS n_pos, n.n_docs FROM label_space l
        LEFT JOIN (SELECT code, count(DISTINCT doc_id) AS n_pos FROM my GROUP BY code) p ON p.code = l.code, mN n),
spos AS (SELECT y.code, w.term, sum(w.w) AS s_pos FROM mw w JOIN my y ON y.doc_id = w.doc_id GROUP BY y.code, w.term),
stot AS (SELECT term, sum(w) AS s_tot FROM mw GROUP BY term),
tf_sc AS (SELECT p.code, p.term,
            round(p.s_pos / z.n_pos - (t.s_tot - p.s_pos) / (z.n_docs - z.n_pos), 12) AS score
          FROM spos p JOIN stot t ON t.term = p.term JOIN msz z ON z.code = p.code
          WHERE z.n_pos >= 1 AND z.n_docs - z.n_pos > 0),
tf_top AS (SELECT code, term, score, CAST(rank AS INT) AS rank FROM (
   SELECT code, term, score, row_number() OVER (PARTITION BY code ORDER BY score DESC, term) AS rank
   FROM tf_sc WHERE score > 0) x WHERE rank <= 25),
ma AS (SELECT y.code, d.term, count(*) AS a FROM mdt d JOIN vocab v ON v.term = d.term JOIN my y ON y.doc_id = d.doc_id
       GROUP BY y.code, d.term),
chi_in AS (SELECT a.code, a.term, CAST(a.a AS DOUBLE) AS a, CAST(v.df AS DOUBLE) AS df,
             v.df * (z.n_pos / z.n_docs) AS e1, v.df * ((z.n_docs - z.n_pos) / z.n_docs) AS e0
           FROM ma a JOIN vocab v ON v.term = a.term JOIN msz z ON z.code = a.code WHERE z.n_pos >= 1),
chi_sc AS (SELECT code, term, round(CASE WHEN e0 > 0 THEN (a - e1) * (a - e1) / e1 + ((df - a) - e0) * ((df - a) - e0) / e0
                                    ELSE 0.0 END, 12) AS score FROM chi_in),
chi_top AS (SELECT code, term, score, CAST(rank AS INT) AS rank FROM (
   SELECT code, term, score, row_number() OVER (PARTITION BY code ORDER BY score DESC, term) AS rank
   FROM chi_sc WHERE score > 0) x WHERE rank <= 25),
mined_terms AS (SELECT term FROM chi_top UNION SELECT term FROM tf_top),
ugrams AS (SELECT DISTINCT unnest({_grams('u')}) AS term FROM mtok),
has_hits AS (SELECT term FROM mined_terms WHERE term IN (SELECT term FROM ugrams)),
merged AS (
  SELECT code, 'data-derived-chi2' AS source, term, rank FROM chi_top WHERE term IN (SELECT term FROM has_hits)
  UNION ALL
  SELECT t.code, 'data-derived-tfidf' AS source, t.term, t.rank FROM tf_top t
  WHERE t.term IN (SELECT term FROM has_hits)
    AND NOT EXISTS (SELECT 1 FROM chi_top c WHERE c.code = t.code AND c.term = t.term
                    AND c.term IN (SELECT term FROM has_hits))),
mtitles AS (SELECT t.doc_id, lower(substr(CASE WHEN m <> '' THEN substr(x.text, length(m) + 1) ELSE x.text END, 1, 600)) AS title
  FROM (SELECT doc_id, text, regexp_extract(substr(text, 1, 500), '^[^.]{{0,200}}\\.\\s*') AS m FROM mdocs) x
  JOIN mdocs t ON t.doc_id = x.doc_id),
vcand AS (SELECT row_number() OVER () AS cand_id, code, phrase FROM curated),
vhits AS (SELECT c.cand_id, c.code, c.phrase, t.doc_id FROM vcand c JOIN mtitles t
          ON regexp_matches(t.title, '(^|[^\\p{{L}}\\p{{N}}_])' || {esc('lower(c.phrase)')} || '([^\\p{{L}}\\p{{N}}_]|$)')),
validated AS (
  SELECT v.code, v.phrase, CAST(NULL AS VARCHAR) AS name,
         round(CAST(count(t.doc_id) AS DOUBLE) / count(*), 3) AS precision,
         CAST(count(t.doc_id) AS BIGINT) AS hits_pos, CAST(count(*) AS BIGINT) AS hits_total
  FROM vhits v LEFT JOIN truth t ON t.doc_id = v.doc_id AND t.code = v.code
  GROUP BY v.cand_id, v.code, v.phrase
  HAVING count(*) >= 3 AND CAST(count(t.doc_id) AS DOUBLE) / count(*) >= 85e-2)"""


@register("ngrams", with_base(MINING_CTES, """
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_grams FROM mdt GROUP BY doc_id"""))
def q_ngrams(spark, sf):
    m = MinedFixture(spark, sf)
    return m.dt.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_grams"))


@register("vocabulary", with_base(MINING_CTES, "SELECT term, CAST(df AS BIGINT) AS df, CAST(tf_sum AS BIGINT) AS tf_sum FROM vocab"))
def q_vocab(spark, sf):
    return MinedFixture(spark, sf).vocab.select("term", "df", "tf_sum")


@register("tfidf_weights", with_base(MINING_CTES, """
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, round(sum(w), 6) AS sum_w, round(max(w), 6) AS max_w
FROM mw GROUP BY doc_id"""))
def q_tfidf(spark, sf):
    w = MinedFixture(spark, sf).weights
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("w"), 6).alias("sum_w"),
                                   F.round(F.max("w"), 6).alias("max_w"))


@register("mined_tfidf", with_base(MINING_CTES, "SELECT code, term, round(score, 6) AS score, rank FROM tf_top"))
def q_mined_tfidf(spark, sf):
    t = MinedFixture(spark, sf).tfidf_top
    return t.select("code", "term", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@register("mined_chi2", with_base(MINING_CTES, "SELECT code, term, round(score, 6) AS score, rank FROM chi_top"))
def q_mined_chi2(spark, sf):
    t = MinedFixture(spark, sf).chi2_top
    return t.select("code", "term", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@register("mined_has_hits", with_base(MINING_CTES, "SELECT term FROM has_hits"))
def q_has_hits(spark, sf):
    return MinedFixture(spark, sf).has_hits


@register("mined_merged", with_base(MINING_CTES, "SELECT code, source, term, rank FROM merged"))
def q_merged(spark, sf):
    m = MinedFixture(spark, sf).merged
    return m.withColumn("rank", F.col("rank").cast("int"))


@register("validated_candidates", with_base(MINING_CTES, "SELECT * FROM validated"))
def q_validated(spark, sf):
    return MinedFixture(spark, sf).validated


@register("pattern_table", with_base(MINING_CTES + """,
cur_pat AS (SELECT pattern_id, code, source, source_text, match_zone FROM pat),
mined_pat AS (SELECT CAST(code AS VARCHAR) || '-' || source || '-' ||
                lpad(CAST(row_number() OVER (PARTITION BY code, source ORDER BY rank) AS VARCHAR), 3, '0') AS pattern_id,
                code, source, term AS source_text, 'full' AS match_zone FROM merged),
valid_pat AS (SELECT CAST(code AS VARCHAR) || '-manual-valuelist-' ||
                lpad(CAST(row_number() OVER (PARTITION BY code ORDER BY phrase) AS VARCHAR), 3, '0') AS pattern_id,
                code, 'manual-valuelist' AS source, phrase AS source_text, 'title' AS match_zone FROM validated)""", """
SELECT * FROM cur_pat UNION ALL SELECT * FROM mined_pat UNION ALL SELECT * FROM valid_pat"""))
def q_pattern_table(spark, sf):
    p = MinedFixture(spark, sf).pattern_table
    return p.select("pattern_id", "code", "source", "source_text", "match_zone")


@register("pattern_table_titles", with_base(MINING_CTES, """
SELECT code, source, source_text FROM (
  SELECT code, source, source_text FROM pat UNION ALL SELECT code, source, term FROM merged
  UNION ALL SELECT code, 'manual-valuelist', phrase FROM validated v WHERE NOT EXISTS (
    SELECT 1 FROM curated c WHERE c.match_zone = 'title' AND c.code = v.code AND lower(c.phrase) = lower(v.phrase))) x"""))
def q_pattern_table_titles(spark, sf):
    """O-N9: validated phrases that the title list already has are dropped."""
    m = MinedFixture(spark, sf)
    titles = m.fx.curated.where("match_zone = 'title'").select("code", "phrase")
    return mining.build_pattern_table(m.fx.curated, m.merged, m.validated, m.codes, titles).select("code", "source", "source_text")
