import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from labelflow.llm import conversation_repair as cr
from labelflow.llm.queries import QUERIES
from labelflow.sources.tables import table

SF = "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\f\r"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(c for c in text if c not in ".!?")
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(initials, kinds):
    """Dijkstra over (row, state); the smallest (cost, audit) comes off first."""
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(initials) and state in ("", "a"):
            return cost, audit, out
        for r in "ua":
            if (state, r) in STEP:
                heapq.heappush(queue, (cost + 5, audit + "I", i, r, (*out, (None, r))))
        if i == len(initials):
            continue
        heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, out))
        if kinds[i] not in ("blank", "duplicate"):
            more = 5 * (kinds[i] == "truncated")
            if (state, initials[i]) in STEP:
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, STEP[state, initials[i]], (*out, (i, None))))
            for r in "ua":
                if (state, r) in STEP:
                    heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, r, (*out, (i, r))))


def place(r):
    conv, turn = ("-" if x is None else f"={x}" for x in r[:2])
    same = hashlib.sha256(f"{conv}:{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest().upper()
    return r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.sha256((same + turn).encode()).hexdigest()


def brute(original, rows):
    by = {c: [] for c, *_ in original}
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for conv, own in by.items():
        own.sort(key=place)
        kinds = faults(own)
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, made = cheapest(initials, kinds)
        text = "\n".join(f"{NAMES[r] if r else own[i][2]}:{'' if i is None else own[i][3]}" for i, r in made)
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def as_dict(df):
    cols = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in cols) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations", "conv_id", "turn", "role", "text").collect()]
    assert as_dict(QUERIES["op13_conversation_repair"](spark, SF)) == brute(rows, damage(rows))


@pytest.mark.parametrize("n", range(5))
def test_runs_give_the_first_cheapest_edits(n):
    for word in itertools.product(cr.SYMBOLS, repeat=n):
        initials = ["d" if c == "d" else c.lower() for c in word]
        kinds = ["blank" if c == "d" else "truncated" if c.isupper() else "" for c in word]
        cost, audit, _ = cheapest(initials, kinds)
        if not n:
            continue
        runs = cr.collapse(list(word), [1] * n)
        after = cr._apply(cr.INSERTS, cr.END)
        assert cr._apply(cr.block_matrix(runs), after)[0] == cost
        assert cr.unroll(runs, 0, after, True)[0] == audit, word


def conversations(seed, n, rows):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "ux", "", None]
    texts = ["Yes.", "no", "What?\n", " ", "", None, "a b!", "Ünï \t", "x" * 100 + ".", "x" * 100 + "y."]
    return [(rng.randrange(n) if rng.random() > 0.05 else None, rng.choice([None, *range(1, 9), 40]), rng.choice(roles), rng.choice(texts))
            for _ in range(rows)]


@pytest.mark.parametrize("bits", [0, 1, 13])
def test_odd_rows_in_any_blocks(spark, tables, monkeypatch, bits):
    """Nulls, ties, repeated rows and clashing names; blocks of one row up."""
    monkeypatch.setattr(cr, "BLOCK_BITS", bits)
    rows = conversations(bits, 12, 300)
    df = tables([(*r, i, "x", 1) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, pos int, audit string, n int")
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert as_dict(cr.Repair(df).report(df)) == brute(rows, plain)


def test_a_long_conversation_and_many_copies(spark, tables):
    rng = random.Random(1)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice([f"t{i}.", f"t{i}", "same."])) for i in range(20_000)] + [(8, 1, "user", "again.")] * 3000
    got = as_dict((r := cr.Repair(df := tables(rows, "conv_id long, turn long, role string, text string"))).report(df))
    assert got == brute(rows, rows)
    assert r.blocks.where("conv_id = 7").count() > 1


def test_empty_table(spark, tables):
    df = tables([], "conv_id long, turn long, role string, text string")
    r = cr.Repair(df)
    assert r.report(df).count() == 0 and r.rows().count() == 0
    ids = tables([(1,), (1,), (None,)], "conv_id long")
    assert as_dict(r.report(ids)) == {i: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in (1, None)}
