"""Column expressions over document and phrase text.

All of these are built-in Spark expressions (JVM side, no Python per row).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letter = Unicode category L \p{L} (the same class as Python's str.isalpha).
# Gap separators inside a phrase: an ellipsis character or two or more dots.
GAP_SPLIT = r"\s*(?:…|\.{2,})\s*"
GAP_REGEX = ".{0,80}"
# Characters escaped when a phrase becomes a regex (the set Python's re.escape uses).
REGEX_SPECIALS = r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0B\f])"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Expressions referenced inside a higher-order function's lambda are
    re-evaluated for every element; binding them first keeps per-row work
    linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_prefix(text, rx: str, window: int = 500) -> Column:
    """Drop everything up to the end of the first match of ``rx`` inside the
    first ``window`` characters; keep the text when there is no match."""
    t = _c(text)
    head = F.substring(t, 1, window)
    pos = F.regexp_instr(head, F.lit(rx))
    mlen = F.length(F.regexp_extract(head, rx, 0))
    return F.when(pos > 0, F.substr(t, pos + mlen)).otherwise(t)


def title_zone(text, rx: str, window: int = 500, length: int = 600) -> Column:
    """The first ``length`` characters after the prefix (prefix searched again)."""
    return F.substring(strip_prefix(text, rx, window), 1, length)


def pstrip(x: Column) -> Column:
    """Strip surrounding whitespace (any, not only spaces)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def phrase_parts(phrase, gap: bool | Column = True) -> Column:
    """Split a phrase on '…' or 2+ dots into stripped lower-case parts; drop empties.

    With ``gap`` false the whole phrase is one part.
    """
    p = _c(phrase)
    split = F.filter(F.transform(F.split(p, GAP_SPLIT, -1), lambda x: F.lower(pstrip(x))),
                     lambda x: x != "")
    whole = F.filter(F.array(F.lower(pstrip(p))), lambda x: x != "")
    g = gap if isinstance(gap, Column) else F.lit(bool(gap))
    return F.when(g, split).otherwise(whole)


def regex_escape(x) -> Column:
    return F.regexp_replace(_c(x), REGEX_SPECIALS, r"\\$1")


def phrase_regex(phrase, gap: bool | Column = True) -> Column:
    """The regex a phrase stands for: one part -> bounded, case-insensitive
    literal; several parts -> parts in order with at most 80 characters between;
    no part -> empty string (the pattern is dropped)."""
    p = _c(phrase)
    g = gap if isinstance(gap, Column) else F.lit(bool(gap))
    raw = F.when(g, F.filter(F.transform(F.split(p, GAP_SPLIT, -1), pstrip), lambda x: x != "")) \
        .otherwise(F.filter(F.array(pstrip(p)), lambda x: x != ""))
    esc = F.transform(raw, regex_escape)
    return (F.when(F.size(esc) == 0, F.lit(""))
            .when(F.size(esc) == 1, F.concat(F.lit(r"(?i)\b"), esc[0], F.lit(r"\b")))
            .otherwise(F.concat(F.lit("(?is)"), F.array_join(esc, GAP_REGEX))))


def letter_edged(x) -> Column:
    """True when the string starts and ends with a letter."""
    return _c(x).rlike(r"(?s)^\p{L}(?:.*\p{L})?$")


def bounded_regex(x) -> Column:
    """Regex for a word-bounded occurrence of a string with non-letter edges."""
    return F.concat(F.lit(r"(?<!\p{L})"), regex_escape(x), F.lit(r"(?!\p{L})"))


def letter_runs(x) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(r"\p{L}+"), 0)


def run_spans(text, lengths: Iterable[int], letter: str = r"\p{L}") -> Column:
    """All distinct substrings that cover ``k`` consecutive complete runs of
    ``letter`` (with the text between them), for every k in ``lengths``.

    A string that starts and ends with such a letter occurs bounded in the text
    exactly when it equals one of these spans, so phrase matching becomes an
    equi-join on the span.  Runs and the pieces between them are cut once; the
    span of k runs that starts at run i is a concatenation.
    """
    ks = sorted(set(int(k) for k in lengths))
    t = _c(text)
    runs = F.regexp_extract_all(t, F.lit(f"{letter}+"), 0)
    if ks == [1]:
        return F.array_distinct(runs)
    gaps = F.split(t, f"{letter}+", -1)

    def spans_of(r, g, k):
        def span(i):
            pieces = [F.get(r, i)]
            for j in range(1, k):
                pieces += [F.get(g, i + j), F.get(r, i + j)]
            return F.concat(*pieces)
        return span

    def spans(r, g):
        parts = []
        for k in ks:
            starts = F.when(F.size(r) >= k, F.sequence(F.lit(0), F.size(r) - k)).otherwise(F.array().cast("array<int>"))
            parts.append(r if k == 1 else F.transform(starts, spans_of(r, g, k)))
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    return F.array_distinct(let(runs, lambda r: let(gaps, lambda g: spans(r, g))))


def spans_among(text, keys: Iterable[tuple[int, str, str]]) -> Column:
    """The distinct ``letter_spans`` among few ``keys`` (number of runs, first run,
    key): hash lookups in one expression, no test of each run."""
    keys = sorted(set(keys))
    single, many = [k for n, _, k in keys if n == 1], [k for n, _, k in keys if n > 1]
    if not many:
        return F.array_intersect(letter_runs(text), _constants(single))
    firsts = sorted(set(first for n, first, _ in keys if n > 1))

    def test(x, opens=False):
        return x.isin(firsts) if opens else x.isin(many)
    return spans_if(text, [n for n, _, _ in keys], test, lambda r: F.array_intersect(r, _constants(single)), lambda r: F.arrays_overlap(r, _constants(firsts)))


def _constants(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def spans_if(text, lengths: Iterable[int], test, single=None, opens=None) -> Column:
    """The distinct ``letter_spans`` that pass ``test(span)``.  Spans of several
    runs are built only where the first run passes ``test(run, True)``.  ``single``
    gives the runs that pass, ``opens`` whether any opens a span, where there is a
    cheaper way than to test each."""
    ks = sorted(set(int(k) for k in lengths))
    t = _c(text)
    none = F.array().cast("array<string>")

    def several(r):
        size = F.size(r)
        starts = F.filter(F.when(size > 1, F.sequence(F.lit(0), size - 2)).otherwise(F.array().cast("array<int>")),
                          lambda i: test(F.get(r, i), True))

        def span_of(g, k):
            def span(i):
                pieces = [F.get(r, i)]
                for j in range(1, k):
                    pieces += [F.get(g, i + j), F.get(r, i + j)]
                return F.concat(*pieces)    # null where the runs end
            return span

        def spans(s, g):
            return F.concat(*[F.filter(F.transform(s, span_of(g, k)), lambda x: x.isNotNull() & test(x)) for k in ks if k > 1])

        return let(starts, lambda s: F.when(F.size(s) > 0, let(F.split(t, r"\p{L}+", -1), lambda g: spans(s, g))).otherwise(none))

    def all_spans(r):
        one = none if 1 not in ks else single(r) if single else F.filter(F.array_distinct(r), lambda x: test(x))
        more = F.when(opens(r), several(r)).otherwise(none) if opens else several(r)
        return F.concat(one, more) if ks[-1] > 1 else one

    return F.array_distinct(let(F.regexp_extract_all(t, F.lit(r"\p{L}+"), 0), all_spans))


#: What may stand for itself or be left out in a regex, innermost groups first.
_GROUP = r"\((?:\\.|[^()\\])*\)"
_OPEN, _EDGE = "\u0001", "\u0002"


def required_runs(regex) -> Column:
    """Lower-case letter runs that every match of a regex holds as complete runs:
    literal letters outside of groups, classes and quantified atoms, with a word
    boundary, white space or a literal other than a letter on both sides.  A
    regex with an alternative outside of groups requires none."""
    x = F.regexp_replace(_c(regex), r"^\(\?[a-z]+\)", "")
    x = F.regexp_replace(x, r"\[(?:\\.|[^\]\\])*\]", _OPEN)
    for _ in range(6):
        x = F.regexp_replace(x, _GROUP, _OPEN)
    x = F.regexp_replace(x, r"(?:\\.|[^\\])(?:[*?]|\{0[^}]*\}|\{,[^}]*\})[+?]?", _OPEN)    # may be left out
    x = F.regexp_replace(x, r"\\[bs][+?]*|\\[^a-zA-Z]|\\d[+?]*", _EDGE)
    x = F.regexp_replace(x, r"\\.", _OPEN)
    x = F.regexp_replace(x, r"\p{L}(?:[+]|\{[^}]*\})[+?]?|[.]|[^\p{L}|" + _OPEN + _EDGE + r"](?=[+{])", _OPEN)
    x = F.regexp_replace(x, r"[^\p{L}|()\[\]{}^$+" + _OPEN + r"]", _EDGE)
    runs = F.regexp_extract_all(x, F.lit(f"(?<={_EDGE})(\\p{{L}}+)(?={_EDGE})"), 1)
    return F.when(x.contains("|") | x.rlike(r"[()\[\]]"), F.array().cast("array<string>")).otherwise(F.transform(runs, lambda r: F.lower(r)))


def required_letters(regex) -> Column:
    """The lower-cased sequences of letters a-z that every match of a regex holds,
    matched in either case, within runs or as whole ones, the longest first: literal
    letters outside of groups, classes and quantified atoms.  Empty where none is sure."""
    x = F.regexp_replace(_c(regex), r"\[(?:\\.|[^\]\\])*\]", _OPEN)
    for _ in range(6):
        x = F.regexp_replace(x, _GROUP, _OPEN)
    x = F.regexp_replace(x, r"(?:\\.|[^\\])(?:[*?+]|\{[^}]*\})[?+]?", _OPEN)
    x = F.regexp_replace(x, r"\\.", _OPEN)
    runs = F.transform(F.regexp_extract_all(x, F.lit("[a-zA-Z]+"), 0), lambda r: F.lower(r))
    longest = F.array_sort(F.array_distinct(runs), lambda a, b: F.length(b) - F.length(a))
    unsure = x.rlike(r"[|()\[\]]") | _c(regex).rlike(r"\(\?[^:]|\\[a-zA-Z0-9]" + r"(?<!\\[bsdwBSDW])")
    return F.coalesce(F.when(~unsure, longest), F.array().cast("array<string>"))


def letter_spans(text, lengths: Iterable[int]) -> Column:
    """``run_spans`` over runs of Unicode letters."""
    return run_spans(text, lengths, r"\p{L}")


def mining_tokens(text, stopwords: Iterable[str] = ()) -> Column:
    """Lower-cased mining tokens in order, stopwords removed.

    A token is a maximal run of word characters made only of Latin-1 letters,
    at least three long (one regex scan); stopwords are dropped with a hash
    set lookup per token.
    """
    wc = r"[\p{L}\p{N}_]"
    # letters of the Latin-1 range: × and ÷ lie in it but are no word characters
    rx = f"(?<!{wc})[a-zA-ZÀ-ÖØ-öø-ÿ]{{3,}}(?!{wc})"
    toks = F.regexp_extract_all(F.lower(_c(text)), F.lit(rx), 0)
    stops = sorted(set(w for w in stopwords if len(w) >= 3))   # shorter ones can never be tokens
    if stops:
        toks = F.filter(toks, lambda w: ~w.isin(*stops))
    return toks


def ngrams(tokens, n_min: int = 1, n_max: int = 3) -> Column:
    """All n-grams (space-joined) of a token array for n in [n_min, n_max].

    Tokens contain no spaces, so the space-joined token string is scanned
    once per n with a zero-width match at every token start capturing the
    next n tokens.
    """
    def body(t):
        joined = F.array_join(t, " ")
        parts = []
        for n in range(n_min, n_max + 1):
            if n == 1:
                parts.append(t)
            else:
                rx = r"(?<![^ ])(?=([^ ]+(?: [^ ]+){%d}))" % (n - 1)
                parts.append(F.regexp_extract_all(joined, F.lit(rx), 1))
        return F.concat(*parts) if len(parts) > 1 else parts[0]
    return let(_c(tokens), body)
