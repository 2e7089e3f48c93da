"""Phrase matching as joins between documents and a pattern table.

Semantics (fixed):
* a pattern is a phrase; a phrase with gap markers ('…' or '..') becomes an
  ordered list of parts, any other phrase is one literal term;
* a literal term matches when its lower-cased text occurs in the lower-cased
  zone text with no *letter* on either side (digits and '_' are boundaries);
  overlapping occurrences of different terms all count; one hit per
  (document, pattern); the same term may serve many patterns;
* a gapped pattern matches when every part occurs word-bounded and the parts
  occur in order with at most 80 characters between neighbours (the gap test
  itself has no boundary);
* ``match_zone`` 'full' = the whole text, 'title' = the title zone.

* a pattern with ``is_regex`` is tested as its own regex, case-insensitively.

Plan (one pass over the texts, no document x pattern product):
1. Every pattern has keys, each a span of complete letter runs that any match
   must hold: a letter-edged term or part as such, another part by its first
   letter run, a regex by a letter run that it requires.  A bitmap of the hashed
   keys, of fixed size for the number of keys, is a constant of the plan.
2. A document cuts its letter runs once and keeps, before anything is exploded,
   the runs whose bit is set; spans of several runs are built only where a run
   that opens a key stands.  What is left joins the key table exactly.
3. A literal is found by its key.  Any other pattern joins by its longest key,
   holds if all its keys are in the document's array, and is then tested by
   regex on the text, which stands in the same row: up to MAX_SENT_KEYS keys are
   sent to the texts, so no text is shuffled.  Beyond, key hits are shuffled
   without the text and only candidates are joined back to it.
   Few keys are looked up as a constant set instead of the bitmap.
4. Patterns without any key travel as one broadcast row.
5. Up to MAX_CONSTANT_TESTS patterns with some that a regex must settle, or as many
   that it must settle, are constants of the plan instead: a regex is compiled once, no text is repeated for it, and it is
   tried only where its keys and the letters that it requires stand.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.functions import text as tx
from labelflow.session import stage

#: Rows of the key table up to which it is sent to the texts; counted before.
MAX_SENT_KEYS = 100_000
#: Bits of the key bitmap: 16 for each key, within these bounds.
MIN_BITS, MAX_BITS = 1 << 14, 1 << 20
#: Keys, and patterns with a regex, up to which they are constants of the plan.
MAX_CONSTANT_KEYS, MAX_CONSTANT_TESTS = 400, 256
#: Letters other than a-z that match one of them in a regex that ignores case.
ODD_LETTERS = ("\u017f", "\u0131")

def zone_texts(docs: DataFrame, prefix_rx: str | None = None, window: int = 500,
               title_len: int = 600, zones=("full", "title")) -> DataFrame:
    """(doc_id, zone, ztext): lower-cased full text and title zone.

    The title zone is cut from the original-case text (prefix searched again
    when ``prefix_rx`` is given), then lower-cased.
    """
    t = F.col("text")
    title = (tx.title_zone(t, prefix_rx, window, title_len) if prefix_rx
             else F.substring(t, 1, title_len))
    items = []
    if "full" in zones:
        items.append(F.struct(F.lit("full").alias("zone"), F.lower(t).alias("ztext")))
    if "title" in zones:
        items.append(F.struct(F.lit("title").alias("zone"), F.lower(title).alias("ztext")))
    return (docs.select("doc_id", F.inline(F.array(*items))))


def compile_patterns(patterns: DataFrame) -> DataFrame:
    """Classify patterns and derive their match keys.

    Input columns: pattern_id, code, source_text, match_zone (NULL = full),
    fuzzy_gap (NULL = true), and, for patterns with a regex of their own,
    is_regex and regex.
    """
    p = patterns
    gap = F.coalesce(F.col("fuzzy_gap"), F.lit(True)) if "fuzzy_gap" in p.columns else F.lit(True)
    own = F.coalesce(F.col("is_regex"), F.lit(False)) if "is_regex" in p.columns else F.lit(False)
    parts = tx.phrase_parts(F.col("source_text"), gap)
    term = F.lower(F.col("source_text"))
    rx = F.when(own, F.col("regex")) if "regex" in p.columns else F.lit(None).cast("string")
    c = p.select("pattern_id", "code", F.coalesce(F.col("match_zone"), F.lit("full")).alias("zone"),
                 parts.alias("parts"), term.alias("term"), rx.alias("own_regex"))
    kind = (F.when(F.col("own_regex").isNotNull(), "regex").when(F.size("parts") == 0, "empty")
            .when(F.size("parts") >= 2, "fuzzy")
            .when(tx.letter_edged(F.col("term")), "literal")
            .otherwise("edge"))
    return c.withColumn("kind", kind).withColumn(
        "n_runs", F.when(F.col("kind") == "literal", F.size(tx.letter_runs(F.col("term")))))


def pattern_keys(compiled: DataFrame) -> DataFrame:
    """(pattern_id, code, zone, need, prx, rx) of all patterns but empty ones:
    the keys a document must hold, the regexes of parts that no key settles, and
    the regex of the whole (null: its keys settle it)."""
    c = compiled.where("kind <> 'empty'")
    qs = F.when(F.col("kind").isin("literal", "edge"), F.array("term")).when(F.col("kind") == "fuzzy", F.col("parts")).otherwise(
        F.array().cast("array<string>"))
    c = c.withColumn("qs", qs)
    of_part = F.transform("qs", lambda q: F.when(tx.letter_edged(q), q).otherwise(F.regexp_extract(q, r"\p{L}+", 0)))
    need = F.when(F.col("kind") == "regex", tx.required_runs(F.col("own_regex"))).otherwise(of_part)
    rx = (F.when(F.col("kind") == "fuzzy", F.concat(F.lit("(?s)"), F.array_join(F.transform("parts", tx.regex_escape), tx.GAP_REGEX)))
          .when(F.col("kind") == "regex", F.concat(F.lit("(?iu)"), F.col("own_regex"))))
    odd = F.transform(F.filter("qs", lambda q: ~tx.letter_edged(q)), tx.bounded_regex)
    return c.select("pattern_id", "code", "zone", F.array_distinct(F.filter(need, lambda k: k != "")).alias("need"), odd.alias("prx"), rx.alias("rx"))


def _own(rx: str):
    """The regex of a pattern without the flags that stand before each."""
    return F.regexp_replace(rx, r"^\(\?[a-z]+\)", "")


def _passes(ztext, prx, rx):
    return F.forall(prx, lambda q: F.regexp_like(ztext, q)) & (rx.isNull() | F.regexp_like(ztext, F.coalesce(rx, F.lit(""))))


def _constant_hits(rows, schema):
    """The (pattern_id, code) of the given patterns that a text holds, from ``ztext``,
    ``found`` and ``odd`` (whether it has ODD_LETTERS).  Regexes are compiled once, and tried on texts that hold the
    pattern's keys and the letters that its regex requires."""
    ztext, hits = F.col("ztext"), []
    for p in rows:
        test = F.col("zone") == p["zone"]
        for k in p["need"]:
            test = test & F.array_contains("found", k)
        within = [x for x in p["letters"] or [] if x not in p["need"]]
        if within:
            test = test & (functools.reduce(operator.and_, [F.contains(ztext, F.lit(x)) for x in within]) | F.col("odd"))
        for rx in [*p["prx"], *([p["rx"]] if p["rx"] is not None else [])]:
            test = test & F.regexp_like(ztext, F.lit(rx))
        hits.append(F.when(test, F.struct(*[F.lit(p[c]).cast(schema[c].dataType).alias(c) for c in ("pattern_id", "code")])))
    return F.array_compact(F.array(*hits))


def _bitmap(keys: DataFrame, n_keys: int):
    """A test (column, opens) -> bool for "may be a key" and, with ``opens``, "may
    open a key of several runs".  At most MAX_BITS / 64 words reach the driver."""
    bits = MIN_BITS
    while bits < min(16 * n_keys, MAX_BITS):
        bits *= 2

    def slot(x, opens):
        return F.pmod(F.xxhash64(F.lit(int(opens)), x), F.lit(bits))

    k = keys.select("key", F.regexp_extract("key", r"\p{L}+", 0).alias("first"))
    slots = k.select(F.explode(F.array(slot(F.col("key"), False), slot(F.col("first"), True))).alias("s"))
    rows = (slots.select((F.col("s") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, CAST(s % 64 AS INT))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")).collect())
    words = [0] * (bits // 64)
    for r in rows:
        words[r["w"]] = r["b"]
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")   # folded to a constant

    def test(x, opens=False):
        s = slot(x, opens)
        word = F.get(table, F.shiftright(s, 6).cast("int"))
        return F.call_function("shiftright", word, s.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    return test


def _run_counts(keys: DataFrame) -> dict[int, int]:
    """Number of letter runs -> number of keys."""
    return {r["k"]: r["n"] for r in keys.groupBy(F.size(tx.letter_runs(F.col("key"))).alias("k")).agg(F.count("*").alias("n")).collect()}


def _held(keys: DataFrame, counts: dict[int, int]):
    """The keys (or what may be one) that a text holds."""
    n_keys = sum(counts.values())
    if n_keys > MAX_CONSTANT_KEYS:
        return tx.spans_if(F.col("ztext"), counts, _bitmap(keys, n_keys))
    few = keys.select(F.size(tx.letter_runs(F.col("key"))), F.regexp_extract("key", r"\p{L}+", 0), "key").collect()
    return tx.spans_among(F.col("ztext"), map(tuple, few))


def match(zones: DataFrame, compiled: DataFrame) -> DataFrame:
    """Hits (doc_id, zone, pattern_id, code), one per (document, pattern)."""
    patterns = stage(pattern_keys(compiled), "patterns")
    out = []
    # small actions on the pattern table: its size and the run counts of its keys
    plain = "rx IS NULL AND size(prx) = 0"
    n_regex = patterns.where(f"NOT ({plain})").count()
    for some in ("true", f"NOT ({plain})") if n_regex else ():     # all in one pass over the texts, or those with a regex
        tested = patterns.where(some)
        every = tested.select(F.explode("need").alias("key"))
        n_tested, counts = tested.count(), _run_counts(every)
        if n_tested <= MAX_CONSTANT_TESTS and sum(counts.values()) <= MAX_CONSTANT_KEYS:
            break
    else:
        n_tested = 0
    if n_tested:
        rows = tested.withColumn("letters", tx.required_letters(_own("rx"))).collect()
        z = zones.withColumn("found", _held(every, counts) if counts else F.array().cast("array<string>"))
        z = z.withColumn("odd", functools.reduce(operator.or_, [F.contains("ztext", F.lit(x)) for x in ODD_LETTERS]))
        out.append(z.select("doc_id", "zone", F.explode(_constant_hits(rows, patterns.schema)).alias("p")).select("doc_id", "zone", "p.pattern_id", "p.code"))
        patterns = patterns.where(f"NOT ({some})")
        if patterns.isEmpty():
            return out[0]
    keyed = patterns.where("size(need) > 0")
    longest = F.array_sort("need", lambda x, y: F.length(y) - F.length(x))
    table = stage(keyed.withColumn("key", F.get(longest, F.lit(0))), "pattern-keys")
    every = keyed.select(F.explode("need").alias("key"))
    counts = _run_counts(every)
    if counts:
        found = zones.withColumn("found", _held(every, counts)).where("size(found) > 0")
        whole = F.forall("need", lambda k: F.array_contains("found", k))
        if sum(counts.values()) <= MAX_SENT_KEYS:
            found = found.drop("ztext") if out else found       # what is left needs no text
            rows = found.withColumn("key", F.explode("found")).join(F.broadcast(table), ["zone", "key"]).where(whole)
            rows = rows if out else rows.where(_passes(F.col("ztext"), F.col("prx"), F.col("rx")))
            out.append(rows.select("doc_id", "zone", "pattern_id", "code"))
        else:
            rows = found.drop("ztext").withColumn("key", F.explode("found")).join(table, ["zone", "key"]).where(whole)
            rows = stage(rows.select("doc_id", "zone", "pattern_id", "code", "prx", "rx"), "key-hits")
            out.append(rows.where(plain).select("doc_id", "zone", "pattern_id", "code"))
            out.append(zones.join(rows.where(f"NOT ({plain})"), ["doc_id", "zone"]).where(_passes(F.col("ztext"), F.col("prx"), F.col("rx")))
                       .select("doc_id", "zone", "pattern_id", "code"))
    bare = patterns.where("size(need) = 0")
    if not bare.isEmpty():
        spec = bare.agg(F.collect_list(F.struct("pattern_id", "code", "zone", "prx", "rx")).alias("_bare"))
        hit = F.filter("_bare", lambda p: (p["zone"] == F.col("zone")) & _passes(F.col("ztext"), p["prx"], p["rx"]))
        out.append(zones.crossJoin(F.broadcast(spec)).select("doc_id", "zone", F.explode(hit).alias("p"))   # one row
                   .select("doc_id", "zone", "p.pattern_id", "p.code"))
    if not out:
        return zones.sparkSession.createDataFrame([], "doc_id BIGINT, zone STRING, pattern_id STRING, code INT")
    hits = out[0]
    for more in out[1:]:
        hits = hits.unionByName(more)
    return hits


def match_patterns(docs: DataFrame, patterns: DataFrame, prefix_rx: str | None = None,
                   window: int = 500, title_len: int = 600) -> DataFrame:
    """Zones + compile + match in one call; only the zones patterns use are built."""
    compiled = compile_patterns(patterns)
    zs = [r["zone"] for r in compiled.select("zone").distinct().collect()]
    return match(zone_texts(docs, prefix_rx, window, title_len, tuple(zs)), compiled)
