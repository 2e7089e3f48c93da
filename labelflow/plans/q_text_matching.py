"""Queries: text zones, phrase parsing, pattern ids and phrase matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.functions import text as tx
from labelflow.operators import matching, patterns
from labelflow.plans.catalog import register
from labelflow.plans.oracle_base import with_base
from labelflow.plans.oracle_text import TEXT_CTES, esc
from labelflow.sources.fixtures import PREFIX_RX, PREFIX_WINDOW, TITLE_LEN, Fixtures


def stripped_docs(fx: Fixtures):
    return fx.docs.select("doc_id", tx.strip_prefix(F.col("text"), PREFIX_RX, PREFIX_WINDOW).alias("text"))


def fixture_hits(fx: Fixtures, kinds=None, zones=("full", "title")):
    compiled = matching.compile_patterns(fx.patterns)
    if kinds:
        compiled = compiled.where(F.col("kind").isin(*kinds))
    compiled = compiled.where(F.col("zone").isin(*zones))
    z = matching.zone_texts(stripped_docs(fx), PREFIX_RX, PREFIX_WINDOW, TITLE_LEN, zones)
    return matching.match(z, compiled)


@register("strip_prefix", with_base(TEXT_CTES, """
SELECT doc_id, length(text) AS n_chars, md5(text) AS text_md5 FROM stripped"""))
def q_strip(spark, sf):
    d = stripped_docs(Fixtures(spark, sf))
    return d.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("title_zone", with_base(TEXT_CTES, "SELECT doc_id, title FROM title"))
def q_title(spark, sf):
    d = stripped_docs(Fixtures(spark, sf))
    return d.select("doc_id", tx.title_zone(F.col("text"), PREFIX_RX, PREFIX_WINDOW, TITLE_LEN).alias("title"))


# phrases cut from the benchmark texts: plain, gapped with an ellipsis, gapped with dots
_BENCH = r"""
bw AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
bphr AS (SELECT CAST(item_id AS INT) AS ord, CAST(item_id % 7 AS INT) AS code, 'bench' AS source,
           CASE WHEN item_id % 2 = 0 THEN 'full' ELSE 'title' END AS match_zone,
           CASE item_id % 3 WHEN 0 THEN w[1] || ' ' || w[2] WHEN 1 THEN w[1] || ' … ' || w[3]
                ELSE w[2] || '..' || w[4] || ' ... ' || w[5] END AS phrase FROM bw),
bpat AS (SELECT code, source, phrase AS source_text, match_zone,
           CAST(code AS VARCHAR) || '-' || source || '-' ||
             format('{:03d}', row_number() OVER (PARTITION BY code, source ORDER BY ord)) AS pattern_id,
           list_filter(list_transform(regexp_split_to_array(phrase, '\s*(?:…|\.{2,})\s*'), lambda x: lower(trim(x))),
                       lambda x: x <> '') AS parts FROM bphr)"""


def bench_patterns(fx: Fixtures):
    w = F.split("text", " ")
    phrase = (F.when(F.col("item_id") % 3 == 0, F.concat_ws(" ", w[0], w[1]))
              .when(F.col("item_id") % 3 == 1, F.concat(w[0], F.lit(" … "), w[2]))
              .otherwise(F.concat(w[1], F.lit(".."), w[3], F.lit(" ... "), w[4])))
    rows = fx.table("benchmark", "item_id", "text").select(
        F.col("item_id").cast("int").alias("ord"), (F.col("item_id") % 7).cast("int").alias("code"), F.lit("bench").alias("source"),
        phrase.alias("phrase"), F.when(F.col("item_id") % 2 == 0, "full").otherwise("title").alias("match_zone"))
    return patterns.from_phrases(rows)


@register("phrase_parts", with_base(_BENCH, """
SELECT pattern_id, CAST(len(parts) AS INT) AS n_parts, array_to_string(parts, '|') AS parts FROM bpat"""))
def q_parts(spark, sf):
    p = bench_patterns(Fixtures(spark, sf))
    parts = tx.phrase_parts(F.col("source_text"), F.col("fuzzy_gap"))
    return p.select("pattern_id", F.size(parts).cast("int").alias("n_parts"),
                    F.array_join(parts, "|").alias("parts"))


@register("phrase_kind", with_base(_BENCH, f"""
SELECT pattern_id,
  CASE WHEN len(parts) = 0 THEN 'empty' WHEN len(parts) >= 2 THEN 'fuzzy' ELSE 'literal' END AS kind,
  CASE WHEN len(parts) = 1 THEN '(?i)\\b' || {esc("list_filter(list_transform(regexp_split_to_array(source_text, '\\s*(?:…|\\.{2,})\\s*'), lambda x: trim(x)), lambda x: x <> '')[1]")} || '\\b'
       ELSE '(?is)' || array_to_string(list_transform(
          list_filter(list_transform(regexp_split_to_array(source_text, '\\s*(?:…|\\.{{2,}})\\s*'), lambda x: trim(x)), lambda x: x <> ''),
          lambda x: {esc('x')}), '.{{0,80}}') END AS regex
FROM bpat"""))
def q_kind(spark, sf):
    pats = bench_patterns(Fixtures(spark, sf))
    return (matching.compile_patterns(pats).join(pats.select("pattern_id", "regex"), "pattern_id")
            .select("pattern_id", F.when(F.col("kind").isin("literal", "edge"), "literal")
                    .otherwise(F.col("kind")).alias("kind"), "regex"))


@register("pattern_ids", with_base(_BENCH, """
SELECT pattern_id, code, source, source_text, match_zone FROM bpat"""))
def q_pattern_ids(spark, sf):
    return bench_patterns(Fixtures(spark, sf)).select("pattern_id", "code", "source", "source_text", "match_zone")


@register("match_literal", with_base(TEXT_CTES, """
SELECT doc_id, pattern_id, code FROM lit_hits WHERE zone = 'full'"""))
def q_match_literal(spark, sf):
    h = fixture_hits(Fixtures(spark, sf), kinds=("literal", "edge"), zones=("full",))
    return h.select("doc_id", "pattern_id", "code")


@register("match_fuzzy", with_base(TEXT_CTES, """
SELECT doc_id, pattern_id, code FROM fz_hits WHERE zone = 'full'"""))
def q_match_fuzzy(spark, sf):
    h = fixture_hits(Fixtures(spark, sf), kinds=("fuzzy",), zones=("full",))
    return h.select("doc_id", "pattern_id", "code")


@register("match_zones", with_base(TEXT_CTES, "SELECT doc_id, zone, pattern_id, code FROM hits"))
def q_match_zones(spark, sf):
    return fixture_hits(Fixtures(spark, sf))


# every third benchmark item gives a regex of its own: two words with any white space,
# an optional word between; with an alternative; or with a class, a count and no letter run that it requires
_REGEX = r"""
rw AS (SELECT CAST(item_id AS INT) AS ord, item_id, regexp_extract_all(text, '[a-zA-Z]{3,}') AS w FROM benchmark),
rpat AS (SELECT ord, CAST(item_id % 7 AS INT) AS code, CASE WHEN item_id % 4 = 0 THEN 'title' ELSE 'full' END AS match_zone,
           CASE item_id % 3 WHEN 0 THEN '\b' || w[1] || '\s+(?:' || w[2] || '\s+)?' || w[3] || '\b'
             WHEN 1 THEN '\b(?:' || w[1] || '|' || w[4] || ') ' || w[2] || '\b'
             ELSE '[' || substr(w[1], 1, 2) || ']{2,3}' || substr(w[2], 1, 3) END AS regex
         FROM rw WHERE len(w) >= 4),
rids AS (SELECT code || '-bench-' || lpad(CAST(row_number() OVER (PARTITION BY code ORDER BY ord) AS VARCHAR), 3, '0') AS pattern_id,
           code, match_zone, regex FROM rpat)"""


@register("match_regex", with_base(TEXT_CTES.strip() + "," + _REGEX, """
SELECT z.doc_id, z.zone, p.pattern_id, p.code FROM ztexts z JOIN rids p ON p.match_zone = z.zone
WHERE regexp_matches(z.ztext, '(?i)' || regexp_replace(regexp_replace(p.regex, '^\\\\b', '(?:^|[^\\\\p{L}\\\\p{N}_])'), '\\\\b$', '(?:[^\\\\p{L}\\\\p{N}_]|$)'))"""))
def q_match_regex(spark, sf):
    """O-N9: curated rows with their own regex join by a letter run they require."""
    fx = Fixtures(spark, sf)
    w = F.regexp_extract_all("text", F.lit("[a-zA-Z]{3,}"), 0)
    lit = F.lit
    b = fx.table("benchmark", "item_id", "text").select("item_id", w.alias("w")).where("size(w) >= 4")
    w = F.col("w")
    kind = F.col("item_id") % 3
    regex = (F.when(kind == 0, F.concat(lit(r"\b"), w[0], lit(r"\s+(?:"), w[1], lit(r"\s+)?"), w[2], lit(r"\b")))
             .when(kind == 1, F.concat(lit(r"\b(?:"), w[0], lit("|"), w[3], lit(") "), w[1], lit(r"\b")))
             .otherwise(F.concat(lit("["), F.substring(w[0], 1, 2), lit("]{2,3}"), F.substring(w[1], 1, 3))))
    rows = b.select(F.col("item_id").cast("int").alias("ord"), (F.col("item_id") % 7).cast("int").alias("code"), lit("bench").alias("source"),
                    lit(None).cast("string").alias("phrase"), regex.alias("regex"),
                    F.when(F.col("item_id") % 4 == 0, "title").otherwise("full").alias("match_zone"))
    compiled = matching.compile_patterns(patterns.from_phrases(rows))
    return matching.match(matching.zone_texts(stripped_docs(fx), PREFIX_RX, PREFIX_WINDOW, TITLE_LEN), compiled)
