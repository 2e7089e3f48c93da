"""Faults of conversations, and the cheapest edits that repair them.

A conversation's rows stand in the order of turn (null first), then role, the
first 64 characters of the text, and a digest.  A row's first fault counts: blank (white space only), duplicate (role and
text seen earlier), truncated (its last other character is not one of .!?).
Edits are Keep (0), Rerole to user or assistant (1), Delete (2; blank and
duplicate rows must go), Insert an empty user or assistant row (5); a truncated
row that stays costs 5 more.  What stays must have roles of the initials
``(s?(ua)+)?``.  Of the cheapest edit lists the one whose initials sort first
(D < I < K < R) is taken.

The initials are a four-state automaton, so a row is a 4 x 4 matrix of costs
between states, and rows in sequence are a product of matrices in which + is the
minimum and * the sum.  Rows are cut into blocks of 2 ** ``BLOCK_BITS`` rows:

1. a block collapses equal consecutive symbols (initial and fault) into runs and
   multiplies the runs' matrices, each taken from cached binary powers;
2. a conversation's block matrices give the cost to the end behind every block;
3. each block unrolls its choices for every state it could start in (a
   conversation's first block only for the start state);
4. the states chain up over a conversation's blocks and pick the choices.

So a conversation of any length is spread over tasks by blocks, and equal rows are
counted.  Only its audit string, one value of the result, grows with it, and the
digest of its repaired rows, a sequential hash, streams through one task in
batches.

Null turns sort first and don't count for gaps; null roles and texts are one
space, so such texts are blank.  Null conv_ids are one conversation.  Repeated
rows are duplicates.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import map_arrow, staged

WHITE = " \t\n\x0b\f\r"
#: Rows of a block are 2 ** BLOCK_BITS at most.
BLOCK_BITS = 13
#: Remembered blocks of a task, by their runs (short ones only).
CACHE = 50_000
CACHED_RUNS = 24

# --- the automaton: states 0 nothing yet, 1 after s, 2 after u, 3 after a -------
NEVER = 1 << 60
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The only row that can be inserted, or take a new role, in a state.
FORCED = {0: "u", 1: "u", 2: "a", 3: "u"}
END = (0, NEVER, NEVER, 0)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: Symbols: "d" must go; else the initial (x: any other), upper case if truncated.
SYMBOLS = "dsuaxSUAX"


def _times(a, b):
    return tuple(tuple(min(NEVER, *(x + y for x, y in zip(row, col))) for col in zip(*b)) for row in a)


def _apply(a, v):
    return tuple(min(NEVER, *(x + y for x, y in zip(row, v))) for row in a)


def _matrix(steps: dict[tuple[int, int], int]):
    return tuple(tuple(steps.get((i, j), NEVER) for j in range(4)) for i in range(4))


def _inserts():
    one = _matrix({(i, i): 0 for i in range(4)} | {(i, NEXT[i, FORCED[i]]): INSERT for i in range(4)})
    return _times(_times(one, one), _times(one, one))


INSERTS = _inserts()
ONE = _matrix({(i, i): 0 for i in range(4)})


def _choices(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of a row's own edits, in order of the initials."""
    out = [("D", DELETE, state)]
    if symbol != "d":
        more = CUT_OFF if symbol.isupper() else 0
        if (state, symbol.lower()) in NEXT:
            out.append(("K", KEEP + more, NEXT[state, symbol.lower()]))
        out.append(("R", REROLE + more, NEXT[state, FORCED[state]]))
    return out


@cache
def power(symbol: str, bit: int):
    """The matrix of 2 ** bit rows of a symbol, inserts before each included."""
    if bit:
        half = power(symbol, bit - 1)
        return _times(half, half)
    steps: dict[tuple[int, int], int] = {}
    for i in range(4):
        for _, cost, j in _choices(symbol, i):
            steps[i, j] = min(cost, steps.get((i, j), NEVER))
    return _times(INSERTS, _matrix(steps))


def _bits(n: int) -> Iterator[int]:
    return (b for b in range(n.bit_length()) if n >> b & 1)


def collapse(symbols: list[str], counts: list[int]) -> tuple[tuple[str, int], ...]:
    """Runs of equal symbols; the copies of a row after its first must go."""
    runs: list[list] = []
    for s, n in zip(symbols, counts):
        for x, k in (((s, n),) if s == "d" else ((s, 1), ("d", n - 1))):
            if not k:
                continue
            if runs and runs[-1][0] == x:
                runs[-1][1] += k
            else:
                runs.append([x, k])
    return tuple(map(tuple, runs))


def block_matrix(runs) -> tuple:
    out = ONE
    for s, n in runs:
        for b in _bits(n):
            out = _times(out, power(s, b))
    return out


def unroll(runs, state: int, after: tuple, last: bool) -> tuple[str, list[str], str, int]:
    """The edits of a block from ``state`` on, ``after`` being the cost to the end
    behind it: their initials, what each row that may stay gives (see ``_one``),
    the roles inserted at the end, and the last state."""
    behind = [after]
    for s, n in reversed(runs):
        v = behind[-1]
        for b in _bits(n):
            v = _apply(power(s, b), v)
        behind.append(v)
    audit, rows = [], []
    for (s, n), v in zip(runs, reversed(behind[:-1])):
        inside = [v]
        while len(inside) < n and s != "d":
            inside.append(_apply(power(s, 0), inside[-1]))
        k = n
        while k:
            if s == "d":    # inserts can wait until these rows are gone: D sorts first
                audit.append("D" * k)
                break
            letters, row, state = _one(s, state, inside[k - 1])
            audit.append(letters)
            rows.append(row)
            k -= 1
    tail = ""
    if last:
        left = _apply(INSERTS, END)
        while END[state] != left[state]:
            tail += FORCED[state]
            state = NEXT[state, FORCED[state]]
        audit.append("I" * len(tail))
    return "".join(audit), rows, tail, state


def _one(symbol: str, state: int, after: tuple) -> tuple[str, str, int]:
    """A row's edits: inserts before it, then its own.  The row is written as the
    roles inserted before, then d, k or the capital of its new role."""
    before = _apply(power(symbol, 0), after)
    letters = row = ""
    while True:
        own = [x for x in _choices(symbol, state) if x[1] + after[x[2]] == before[state]]
        if own and own[0][0] == "D":
            return letters + "D", row + "d", state
        to = NEXT[state, FORCED[state]]
        if INSERT + before[to] == before[state]:
            letters, row, state = letters + "I", row + FORCED[state], to
            continue
        initial, _, to = own[0]
        return letters + initial, row + ("k" if initial == "K" else FORCED[state].upper()), to


@lru_cache(CACHE)
def _short_matrix(runs) -> list[int]:
    return [x for line in block_matrix(runs) for x in line]


_short_unroll = lru_cache(CACHE)(unroll)


def _matrix_of(runs) -> list[int]:
    return _short_matrix(runs) if len(runs) <= CACHED_RUNS else _short_matrix.__wrapped__(runs)


def _edits_of(runs, state: int, after: tuple, last: bool):
    return (_short_unroll if len(runs) <= CACHED_RUNS else unroll)(runs, state, after, last)


def _given(places: list[int], marks: list[str], rows: list[str], tail: str) -> list[tuple[int, str]]:
    """(place, what it gives) of the rows of a block that give any."""
    own = iter(rows)
    out = [(p, "" if m == "d" else next(own).replace("d", "")) for p, m in zip(places, marks)]
    out[-1] = (out[-1][0], out[-1][1] + tail)
    return [x for x in out if x[1]]


# ---------------------------------------------------------------------------
# Tables
# ---------------------------------------------------------------------------
def _rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, same, row): digests that tell a conversation's
    role and text, and its rows, apart."""
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = lambda x: F.coalesce(F.concat(F.lit("="), F.col(x).cast("string")), F.lit("-"))
    same = F.sha2(F.concat_ws(":", name("conv_id"), F.length("role").cast("string"), "role", "text"), 256)
    c = c.withColumn("same", F.unhex(same))
    return c.withColumn("row", F.unhex(F.sha2(F.concat(F.hex("same"), name("turn")), 256)))


def _symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, row, turn, role, initial, fault, n): one row for equal rows,
    ``pos`` ascending in a conversation's order."""
    bare = F.rtrim("text", F.lit(WHITE))
    fault = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    one = (rows.withColumn("fault", fault).withColumn("head", F.left("text", F.lit(64)))
           .groupBy("row", "same", "conv_id", "turn", "role", "fault", "head").agg(F.count("*").alias("n")))
    one = staged(one, "conversation-rows")
    again = one.where("fault <> 'blank'").groupBy("same").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("k")).where("k > 1")
    late = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.struct("turn"))
    one = one.join(again.drop("k"), "same", "left").withColumn("fault", F.when(late, "duplicate").otherwise(F.col("fault"))).drop("same", "first")
    order = ["conv_id", "turn", "role", "head", "row"]
    placed = (one.repartitionByRange(*order).sortWithinPartitions(*order).drop("head")
              .withColumn("initial", F.left("role", F.lit(1))).withColumn("pos", F.monotonically_increasing_id()))
    return staged(placed, "conversation-symbols")


def _blocks(symbols: DataFrame) -> DataFrame:
    """(conv_id, block, rows, counts, initials, marks, matrix, first, last, illegal)."""
    kept = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    mark = (F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(kept)).otherwise(kept))
    rows = (symbols.withColumn("mark", mark).withColumn("part", F.shiftright("pos", BLOCK_BITS))
            .groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "initial", "mark"))).alias("rows"))
            .select("conv_id", F.col("rows")[0]["pos"].alias("block"), F.col("rows.pos").alias("places"), F.col("rows.n").alias("counts"),
                    F.col("rows.initial").alias("initials"), F.col("rows.mark").alias("marks")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, bad = [], []
            for counts, initials, marks in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                runs = collapse(marks, counts)
                found.append(_matrix_of(runs))
                bad.append(sum(counts) - len(counts) + sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64())), pa.array(bad, pa.int64())],
                                             [*b.schema.names, "matrix", "illegal"])

    source = rows.select("block", "places", "counts", "initials", "marks", "conv_id")
    kind = dict(source.dtypes)["conv_id"]
    return staged(map_arrow(source, run, "block long, places array<long>, counts array<long>, initials array<string>, marks array<string>, "
                                         f"conv_id {kind}, matrix array<long>, illegal long"), "conversation-blocks")


def _ends(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, after, first, last), and (conv_id, illegal, cost)."""
    rows = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "block", "matrix", "illegal", F.element_at("initials", 1).alias("first"), F.element_at("initials", -1).alias("last")))).alias("b"))
    kind = dict(blocks.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = _apply(INSERTS, END)
                bad = sum(p["illegal"] for p in parts) + sum(x["last"] + y["first"] not in ("su", "ua", "au") for x, y in zip(parts, parts[1:]))
                for i in range(len(parts) - 1, -1, -1):
                    out.append([conv, parts[i]["block"], list(v), i == 0, i == len(parts) - 1, bad, None])
                    m = parts[i]["matrix"]
                    v = _apply((m[:4], m[4:8], m[8:12], m[12:]), v)
                out[-1][6] = v[0]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)],
                                             ["conv_id", "block", "after", "is_first", "is_last", "illegal", "cost"])

    ends = staged(map_arrow(rows, run, f"conv_id {kind}, block long, after array<long>, is_first boolean, is_last boolean, illegal long, cost long"),
                  "conversation-ends")
    return ends.select("block", "after", "is_first", "is_last"), ends.where("is_first").select("conv_id", "illegal", "cost")


def _edits(blocks: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv_id, block, audit, places, gives): the chosen edits of every block."""
    source = blocks.select("block", "places", "counts", "marks", "conv_id").join(ends, "block")
    kind = dict(blocks.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for block, places, counts, marks, conv, after, first, last in zip(*(c.to_pylist() for c in b.columns)):
                runs = collapse(marks, counts)
                for state in range(1 if first else 4):
                    audit, rows, tail, to = _edits_of(runs, state, tuple(after), last)
                    some = _given(places, marks, rows, tail)
                    out.append((conv, block, state, to, audit, [p for p, _ in some], [g for _, g in some]))
            kinds = [b.schema.field(4).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)],
                                             ["conv_id", "block", "state", "to", "audit", "places", "gives"])

    every = staged(map_arrow(source, run, f"conv_id {kind}, block long, state long, to long, audit string, places array<long>, gives array<string>"),
                   "conversation-edits")
    steps = every.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "state", "to"))).alias("steps")).select("steps")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks_, states = [], []
            for steps in b.column(0).to_pylist():
                by, state = {(s["block"], s["state"]): s["to"] for s in steps}, 0
                for block in dict.fromkeys(s["block"] for s in steps):
                    blocks_.append(block)
                    states.append(state)
                    state = by[block, state]
            yield pa.RecordBatch.from_arrays([pa.array(blocks_, pa.int64()), pa.array(states, pa.int64())], ["block", "state"])

    return every.join(map_arrow(steps, chain, "block long, state long"), ["block", "state"]).select("conv_id", "block", "audit", "places", "gives")


class Repair:
    """The faults and edits of a table of conversations (conv_id, turn, role, text)."""

    def __init__(self, conversations: DataFrame):
        self.source = _rows(conversations)
        self.symbols = _symbols(self.source)
        self.blocks = _blocks(self.symbols)
        ends, self.totals = _ends(self.blocks)
        self.edits = staged(_edits(self.blocks, ends), "conversation-chosen")

    def rows(self) -> DataFrame:
        """(conv_id, pos, k, role, text): the repaired rows, in order of pos, k."""
        gives = self.edits.select(F.explode(F.arrays_zip("places", "gives")).alias("x")).select("x.places", "x.gives")
        kept = self.symbols.join(gives, F.col("pos") == F.col("places")).select("row", "conv_id", "pos", "gives")
        text = self.source.groupBy("row").agg(F.first("role").alias("role"), F.first("text").alias("text"))
        each = kept.join(text, "row").select("conv_id", "pos", "role", "text", F.posexplode(F.split("gives", "")).alias("k", "g"))
        name = (F.when(F.lower("g") == "u", "user").when(F.lower("g") == "a", "assistant").otherwise(F.col("role")))
        inserted = F.col("g").isin("u", "a")
        return each.select("conv_id", "pos", "k", name.alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"))

    def faults(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated) from the rows."""
        n, fault = F.col("n"), F.col("fault")
        kinds = {k: F.sum(F.when(fault == k, n).otherwise(0)) for k in ("blank", "duplicate", "truncated")}
        # copies of a row are duplicates of it, unless it is one itself or blank
        kinds["duplicate"] += F.sum(F.when(fault.isin("", "truncated"), n - 1).otherwise(0))
        kinds["truncated"] -= F.sum(F.when(fault == "truncated", n - 1).otherwise(0))
        turns = self.symbols.groupBy("conv_id", "turn").agg(*(v.alias(k) for k, v in kinds.items()))
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
        return turns.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"), *(F.sum(k).alias(k) for k in kinds))

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256) of conversations with rows left; a task
        streams a conversation's rows in order."""
        lines = self.rows().select("conv_id", "pos", "k", F.concat_ws(":", "role", "text").alias("line"))
        sorted_ = lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "k").select("conv_id", "line")
        kind = dict(lines.dtypes)["conv_id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, digest, convs, found = None, None, [], []
            for b in batches:
                for conv, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if digest is None or conv != now:
                        if digest is not None:
                            convs.append(now)
                            found.append(digest.hexdigest())
                        now, digest = conv, hashlib.sha256()
                    else:
                        digest.update(b"\n")
                    digest.update(line.encode())
                if len(found) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(convs, b.schema.field(0).type), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])
                    convs, found = [], []
            if digest is not None:
                yield pa.RecordBatch.from_arrays([pa.array([*convs, now], b.schema.field(0).type), pa.array([*found, digest.hexdigest()], pa.string())],
                                                 ["conv_id", "repaired_sha256"])

        return map_arrow(sorted_, run, f"conv_id {kind}, repaired_sha256 string")

    def report(self, conv_ids: DataFrame) -> DataFrame:
        """One row for each conv_id of ``conv_ids``, also of those without rows."""
        audit = self.edits.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "audit"))).alias("a"))
        parts = [conv_ids.select("conv_id"), self.faults(), self.totals, self.digests(), audit.select("conv_id", F.array_join("a.audit", "").alias("audit"))]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        empty = hashlib.sha256(b"").hexdigest()
        numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        return rows.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers),
                                           F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                           F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))
