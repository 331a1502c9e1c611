"""Conversation repair against a forward dynamic programme that carries whole audits and lines."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from foldwright.llm import turns
from llm_cases import SF, needs_data

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
ROLES = (("u", "user"), ("a", "assistant"))
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def best_edits(rows):
    """rows: (turn, role, text) in order; the result as the operator's tuple."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    def put(table, state, entry):
        if state not in table or entry[:2] < table[state][:2]:
            table[state] = entry
            return True
        return False

    def insert(table):
        todo = list(table)
        while todo:
            q = todo.pop()
            for initial, role in ROLES:
                if (q, initial) in STEP:
                    cost, audit, lines = table[q]
                    if put(table, STEP[q, initial], (cost + 5, audit + "I", lines + [f"{role}:"])):
                        todo.append(STEP[q, initial])

    table = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        insert(table)
        after = {}
        for q, (cost, audit, lines) in table.items():
            put(after, q, (cost + 2, audit + "D", lines))
            if fault in ("b", "d"):
                continue
            more = 5 if fault == "t" else 0
            if (q, role[:1]) in STEP:
                put(after, STEP[q, role[:1]], (cost + more, audit + "K", lines + [f"{role}:{text}"]))
            for initial, other in ROLES:
                if (q, initial) in STEP:
                    put(after, STEP[q, initial], (cost + more + 1, audit + "R", lines + [f"{other}:{text}"]))
        table = after
    insert(table)
    cost, audit, lines = min((table[q] for q in ("", "a") if q in table), key=lambda e: e[:2])
    numbers = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in "bdt"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def text_of(value):
    return " " if value is None else str(value)


def brute(rows):
    """(conv_id, turn, role, text) -> the whole query, damage included."""
    left = {}
    for conv, turn, role, text in rows:
        here = left.setdefault(conv, [])
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text_of(text)) if kind == 2 else text_of(text)
        if kind:
            here.extend([(turn, "user" if kind == 4 else text_of(role), text)] * (2 if kind == 3 else 1))
    for v in left.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    return {c: best_edits(v) for c, v in left.items()}


def found(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_all_short_sequences_have_the_cheapest_and_least_edits():
    rows = [("system", "s."), ("user", "u."), ("assistant", "a."), ("tool", "x."), ("user", "cut"), ("assistant", "cut"), ("user", " ")]
    for n in range(5):
        for chosen in itertools.product(rows, repeat=n):
            given = [(i, role, text if not text.strip() else f"{i}{text}") for i, (role, text) in enumerate(chosen)]
            want = best_edits(given)
            symbols = [turns._symbol(r, "blank" if not t.strip() else "truncated" if t.endswith("cut") else None) for _, r, t in given]
            cost, audit, _ = turns.cheapest(turns._runs(symbols))
            assert (cost, audit) == want[5:7], (chosen, want)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_a_run_advances_as_its_rows_one_by_one(n):
    for symbol in ("s", "u", "a", "o", "ut", "ot", "d"):
        v = turns._END
        for _ in range(n):
            v = turns._times(turns._power(symbol, 0), v)
        assert turns._advance(symbol, n, turns._END) == v
        assert turns._times(turns._run_matrix(symbol, n), turns._END) == v


def test_pieces_entered_in_any_state_chain_to_the_whole():
    draw = random.Random(3)
    for _ in range(200):
        symbols = [draw.choice(["s", "u", "a", "o", "ut", "at", "d"]) for _ in range(draw.randint(2, 30))]
        cut = draw.randint(1, len(symbols) - 1)
        first, second = turns._runs(symbols[:cut]), turns._runs(symbols[cut:])
        after = turns._times(turns._inserted(), turns._END)
        for symbol, n in reversed(second):
            after = turns._advance(symbol, n, after)
        cost, head, state = turns.cheapest(first, after=after, last=False)
        assert (cost, head + turns.cheapest(second, state)[1]) == turns.cheapest(turns._runs(symbols))[:2]


@pytest.mark.parametrize("chunks", [1, 3, 50])
def test_conversations_inside_and_across_chunks(spark, chunks):
    draw, rows = random.Random(5), []
    for conv, size in ((1, 40), (2, 300), (None, 60), (7, 1), (9, 40)):
        for i in range(size):
            rows.append((conv, draw.choice([None, *range(200)]), draw.choice(["system", "user", "assistant", "tool", None, ""]),
                         draw.choice(["Hi.", "Yes", "", None, "  \n", "No!  ", "What?", f"x{i}.", f"y{i}", "ü 漢." * (i % 3)])))
    rows += [(11, 5, "user", "Same."), (11, 5, "user", "Same.")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", _c int, _chunk string").repartition(3)
    assert found(turns.damaged_and_repaired(df, chunks)) == brute(rows)


def test_one_conversation_with_nearly_all_rows(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t % 700}.") for t in range(4000)] + [(2, 0, "user", "Hello.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found(turns.damaged_and_repaired(df, 12)) == brute(rows)


def test_nothing_left_and_no_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.")], SCHEMA)
    assert found(turns.damaged_and_repaired(df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert turns.damaged_and_repaired(df.limit(0)).count() == 0


@needs_data
def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert found(turns.damaged_and_repaired(df)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
