"""Secret scan by corpus-wide ownership frequency, in SQL expressions only.

Candidates are the matches of three base patterns (assignments, access keys,
hexadecimal runs) and long mixed tokens that no base match touches.  The hash of
each candidate's value is counted over the distinct owners and repositories that
hold it, all documents included.  Values of more than ``max_owners`` owners or
more than ``max_repos`` repositories, be they of one owner, are widely copied
examples; the others, if they look random, are live.  Base matches
are always reported; a mixed token is reported (kind ``token``) only if it is
live.

Positions are code points, end exclusive.  Null texts are empty.  Null owners
count as one owner, null repositories as one repository of their owner.  Rows
count one by one, repeated ones too (a repeated row adds no owner).  Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import staged
from labelflow.llm.decontam import let

# The patterns of the contract (Java syntax).
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_MIN = 6
TOKEN = r"[A-Za-z0-9_-]{24,}"   # every hexadecimal match holds one, too
KINDS = ("assign", "access", "hex", "token")

#: A value that more owners hold is a widely copied example.
MAX_OWNERS = 2
#: So is a value that more repositories hold, whoever owns them.
MAX_REPOS = 20
#: Fewest different characters of a value that looks random.
MIN_DISTINCT = 5
#: Matches whose lengths are summed at a time when positions are derived.
BLOCK = 256
MARK = "[REDACTED]"


def _quote(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def matches_sql(pattern: str) -> str:
    """Array of (start, end, match) of all leftmost non-overlapping matches in
    column ``text``: offsets are running sums over the pieces between matches,
    taken in blocks so that a text of many matches stays cheap."""
    p = _quote(pattern)
    sums = let("transform(sequence(0, size(m) - 1), i -> length(g[i]) + length(m[i]))", "n", let(
        f"transform(sequence(0, (size(n) - 1) DIV {BLOCK}), b -> aggregate(slice(n, CAST(b * {BLOCK} + 1 AS INT), {BLOCK}), 0, (a, x) -> a + x))",
        "t", let(
            "transform(sequence(0, size(t) - 1), b -> aggregate(slice(t, 1, CAST(b AS INT)), 0, (a, x) -> a + x))", "o",
            f"""transform(sequence(0, size(m) - 1), i -> {let(
                f"o[CAST(i DIV {BLOCK} AS INT)] + aggregate(slice(n, CAST(i - i % {BLOCK} + 1 AS INT), CAST(i % {BLOCK} AS INT)), 0, (a, x) -> a + x) + length(g[i])",
                "s", "struct(s AS start, s + length(m[i]) AS end, m[i] AS match)")})""")))
    empty = "CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, match: STRING>>)"
    return f"""IF(text RLIKE {p}, {let(f"split(text, {p}, -1)", "g", let(f"regexp_extract_all(text, {p}, 0)", "m", sums))},
               {empty})"""


def _candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, owner, repo, kind, start, end, h, random): one row per candidate."""
    found = docs.where("text is not null").select(
        "doc_id", F.xxhash64("text").alias("text_key"), "owner", "repo",
        *(F.expr(matches_sql(p)).alias(k) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN))))
    value = {"assign": f"regexp_extract(x.match, {_quote(ASSIGN)}, 1)"}
    parts = [f"""transform({k}, x -> struct({n} AS kind, x.start AS start, x.end AS end, {value.get(k, 'x.match')} AS value))"""
             for n, k in enumerate(KINDS[:3])]
    base = f"filter(concat({', '.join(parts)}), x -> x.kind > 0 OR length(x.value) >= {ASSIGN_MIN})"
    found = found.withColumn("base", F.expr(base)).where("size(base) > 0 OR size(token) > 0")
    mixed = """filter(transform(token, x -> struct(3 AS kind, x.start AS start, x.end AS end, x.match AS value)),
               x -> x.value RLIKE '[0-9]' AND x.value RLIKE '[A-Z]' AND x.value RLIKE '[a-z]'
                    AND NOT exists(base, y -> y.start < x.end AND x.start < y.end))"""
    return (found.select("doc_id", "text_key", "owner", "repo", F.explode(F.concat("base", F.expr(mixed))).alias("x"))
            .select("doc_id", "text_key", "owner", "repo", "x.kind", "x.start", "x.end",
                    F.sha2("x.value", 256).alias("h"),
                    (F.size(F.array_distinct(F.split("x.value", ""))) >= MIN_DISTINCT).alias("random")))


def ownership(cands: DataFrame) -> DataFrame:
    """(h, n_owners, n_repos) over distinct owners and repositories; each step
    combines on the map side, so one value of a third of all rows is no hot key."""
    one = cands.select("h", "owner", "repo").distinct()
    per_owner = one.groupBy("h", "owner").agg(F.count("*").alias("r"))
    return per_owner.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repos"))


def secret_spans(docs: DataFrame, owner: str = "source", repo: str = "doc_id", max_owners: int = MAX_OWNERS,
                 max_repos: int = MAX_REPOS) -> DataFrame:
    """(doc_id, text_key, spans): per document with candidates, an array of
    (start, kind, end, n_owners, n_repos, live, copied) in order of start and kind."""
    d = docs.select("doc_id", "text", F.col(owner).alias("owner"), F.col(repo).cast("string").alias("repo"))
    cands = staged(_candidates(d).distinct(), "secret-candidates")
    judged = (cands.join(ownership(cands), "h")
              .withColumn("copied", (F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos))
              .withColumn("live", F.col("random") & ~F.col("copied")).where("kind < 3 OR live"))
    return (judged.select("doc_id", "text_key", F.struct("start", "kind", "end", "n_owners", "n_repos", "live", "copied").alias("x"))
            .distinct().groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("x")).alias("spans")))


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All rows of ``docs`` (as struct doc) with their spans (null: none)."""
    s = spans.select(F.col("doc_id").alias("s_id"), F.col("text_key").alias("s_key"), "spans")
    d = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("d_id"),
                    F.xxhash64(F.coalesce("text", F.lit(""))).alias("d_key"))
    return d.join(s, F.col("d_id").eqNullSafe(F.col("s_id")) & (F.col("d_key") == F.col("s_key")), "left").select("doc", "spans")


def _join(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"coalesce(array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ','), '')")


def report(docs: DataFrame, owner: str = "source", repo: str = "doc_id", max_owners: int = MAX_OWNERS,
           max_repos: int = MAX_REPOS) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live
    (owner-specific) and n_copied (held by more owners or repositories) spans,
    and n_owners and n_repos, the holders of each of ``spans``."""
    spans = secret_spans(docs, owner, repo, max_owners, max_repos)
    wide = _with_spans(docs.select("doc_id", "text"), spans)
    wide = wide.select(F.col("doc.doc_id").alias("doc_id"), "spans")
    count = [F.expr(f"CAST(coalesce(size(filter(spans, x -> x.kind = {n})), 0) AS BIGINT)").alias(f"n_{k}")
             for n, k in enumerate(KINDS[:3])]
    return wide.select(
        "doc_id", *count, F.sha2(_join("filter(spans, x -> x.kind < 3)"), 256).alias("base_sha256"),
        _join("spans").alias("spans"),
        F.expr("CAST(coalesce(size(filter(spans, x -> x.live)), 0) AS BIGINT)").alias("n_live"),
        F.expr("CAST(coalesce(size(filter(spans, x -> x.copied)), 0) AS BIGINT)").alias("n_copied"),
        *(F.expr(f"coalesce(transform(spans, x -> x.{c}), CAST(array() AS ARRAY<BIGINT>))").alias(c) for c in ("n_owners", "n_repos")))


def redact(docs: DataFrame, owner: str = "source", repo: str = "doc_id", max_owners: int = MAX_OWNERS,
           max_repos: int = MAX_REPOS) -> DataFrame:
    """``docs`` with every live span replaced by MARK; widely copied examples
    stay.  Only texts that match a pattern meet the spans; the others, null ones
    too, are passed on where they are."""
    spans = secret_spans(docs, owner, repo, max_owners, max_repos).where("exists(spans, x -> x.live)")
    may = F.expr("coalesce(" + " OR ".join(f"text RLIKE {_quote(p)}" for p in (ASSIGN, ACCESS, TOKEN)) + ", false)")
    wide = _with_spans(docs.where(may), spans)
    out = f"""aggregate(filter(spans, x -> x.live), struct('' AS s, 0 AS upto),
        (a, x) -> IF(x.end <= a.upto, a, struct(
            concat(a.s, IF(x.start >= a.upto, concat(substring(doc.text, a.upto + 1, x.start - a.upto), '{MARK}'), '')) AS s,
            x.end AS upto)), a -> concat(a.s, substring(doc.text, a.upto + 1)))"""
    text = F.when(F.expr("exists(spans, x -> x.live)"), F.expr(out)).otherwise(F.col("doc.text"))
    return (wide.select(*(text.alias(c) if c == "text" else F.col(f"doc.{c}").alias(c) for c in docs.columns))
            .union(docs.where(~may)))
