"""Repair of conversation structure by a run-length dynamic programme over min-plus matrices.

A conversation's rows, in turn order, become symbols: the role's initial (s, u, a or another) and the fault (none, to be
deleted, truncated). What the edits leave must read `(s?(ua)+)?`, an automaton of four states. The edits before and at one row
are a 4 x 4 min-plus matrix of its symbol. Equal consecutive symbols are one run; a run of n rows advances the cost vector by
the cached powers 1, 2, 4, ... of its matrix. The cheapest edits are then unrolled row by row, always the least letter that
keeps the cost.

Faults, the first one counts: blank (nothing but white space), duplicate (role and text seen earlier in the conversation),
truncated (the last character that is not white space is none of `.!?`). Edits: Keep 0, Rerole to user or assistant 1, Delete
2 (the only edit for blank and duplicate rows), Insert an empty user or assistant row 5; truncated rows that stay cost 5 more.

Rows are cut into chunks by range of (conversation, turn, role, digest). Conversations inside one chunk are done in one pass
over it. Those that lie across chunks, however long, are done piece by piece: each piece is summed up as one matrix, the
matrices of a conversation are chained, every piece is unrolled from each state it may be entered in, and the chain picks one.
Only the SHA-256 of a repaired conversation is sequential by its definition; its lines stream through one task in order.

Defined results: null roles and texts are one space; null turns come first and leave gaps alone; rows of one turn are ordered
by role and the SHA-256 of their text; repeated rows are duplicates; a null conv_id is a conversation like others. Further
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import store
from foldwright.operators.ordering import ordered_chunks

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
INF = 1 << 62
# States: nothing yet, after s, after u, after a. Only "nothing" and "after a" may end.
_START, _S, _U, _A = range(4)
_STEP = {(_START, "s"): _S, (_START, "u"): _U, (_S, "u"): _U, (_U, "a"): _A, (_A, "u"): _U}
#: The state after a user or assistant row that is put or changed here, and its role: one choice in every state.
_FORCED = {_START: (_U, "user"), _S: (_U, "user"), _U: (_A, "assistant"), _A: (_U, "user")}
_END = (0, INF, INF, 0)
_LEGAL = {"su", "ua", "au"}
_BLANK, _DUPLICATE, _CUT = "blank", "duplicate", "truncated"

Vector = tuple[int, int, int, int]


def _choices(symbol: str, state: int):
    """(letter, cost, next state) of the edits of a row, letters ascending. symbol: initial and fault, 'd' alone is deleted."""
    yield "D", DELETE, state
    if symbol != "d":
        more = TRUNCATED if symbol[1:] == "t" else 0
        if (state, symbol[0]) in _STEP:
            yield "K", KEEP + more, _STEP[state, symbol[0]]
        yield "R", REROLE + more, _FORCED[state][0]


@lru_cache(None)
def _inserted() -> tuple[Vector, ...]:
    """Least cost of going from state to state by insertions alone."""
    rows = []
    for state in range(4):
        cost, at, spent = [INF] * 4, state, 0
        while spent < cost[at]:
            cost[at], at, spent = spent, _FORCED[at][0], spent + INSERT
        rows.append(tuple(cost))
    return tuple(rows)


def _times(m: tuple[Vector, ...], v: Vector) -> Vector:
    return tuple(min(INF, *(a + b for a, b in zip(row, v))) for row in m)


def _product(m, n):
    columns = tuple(zip(*n))
    return tuple(tuple(min(INF, *(a + b for a, b in zip(row, c))) for c in columns) for row in m)


@lru_cache(None)
def _power(symbol: str, k: int) -> tuple[Vector, ...]:
    """The matrix of 2**k rows of a symbol, insertions before each included."""
    if k:
        return _product(_power(symbol, k - 1), _power(symbol, k - 1))
    rows = [[INF] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, after in _choices(symbol, state):
            rows[state][after] = min(rows[state][after], cost)
    return _product(_inserted(), tuple(map(tuple, rows)))


def _advance(symbol: str, n: int, v: Vector) -> Vector:
    """Costs to go before a run of n rows, from those after it."""
    k = 0
    while n:
        if n & 1:
            v = _times(_power(symbol, k), v)
        n, k = n >> 1, k + 1
    return v


def _run_matrix(symbol: str, n: int):
    m, k = None, 0
    while n:
        if n & 1:
            m = _power(symbol, k) if m is None else _product(_power(symbol, k), m)
        n, k = n >> 1, k + 1
    return m


def _runs(symbols) -> list[list]:
    runs: list[list] = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    return runs


@lru_cache(1 << 16)
def _edit(symbol: str, state: int, after: Vector) -> tuple[str, int]:
    """The least letters of the cheapest edits before and at one row, and the state they lead to."""
    letters, before = "", _times(_power(symbol, 0), after)
    while True:
        options = [(letter, cost + after[to], to) for letter, cost, to in _choices(symbol, state)]
        options.append(("I", INSERT + before[_FORCED[state][0]], None))
        letter, _, to = min(o for o in options if o[1] == before[state])  # letters differ, so None is never compared
        letters += letter
        if letter != "I":
            return letters, to
        state = _FORCED[state][0]


def _lowered(v: Vector) -> tuple[Vector, int]:
    least = min(v)
    return tuple(x - least if x < INF else INF for x in v), least


def cheapest(runs: list[list], state: int = _START, after: Vector = _END, last: bool = True) -> tuple[int, str, int]:
    """Cost to go, audit letters and last state of a sequence of runs that is entered in `state`.

    after: costs to go behind it; last: nothing follows, so insertions at the end belong to it.
    """
    v = _times(_inserted(), after) if last else after
    ends = []
    for symbol, n in reversed(runs):
        ends.append(v)
        v = _advance(symbol, n, v)
    cost, audit = v[state], []
    if cost >= INF:
        return INF, "", state
    for symbol, n in runs:
        to_go = [_lowered(ends.pop())[0]]
        for _ in range(n - 1):  # costs to go behind each row of the run, from its end
            to_go.append(_lowered(_times(_power(symbol, 0), to_go[-1]))[0])
        while to_go:
            letters, state = _edit(symbol, state, to_go.pop())
            audit.append(letters)
    if last:
        left = _times(_inserted(), after)[state]
        while after[state] != left:
            audit.append("I")
            left, state = left - INSERT, _FORCED[state][0]
    return cost, "".join(audit), state


class _Lines:
    """The repaired lines of a conversation as its rows and audit letters come in; only their SHA-256 is kept."""

    def __init__(self):
        self.sha, self.state, self.any, self.letters = hashlib.sha256(), _START, False, iter(())

    def _put(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode())
        self.any = True

    def _forced(self) -> str:
        self.state, role = _FORCED[self.state]
        return role

    def audit(self, letters: str) -> None:
        self.finish()
        self.letters = iter(letters)

    def row(self, role: str, text: str) -> None:
        for letter in self.letters:
            if letter == "I":
                self._put(self._forced(), "")
                continue
            if letter == "K":
                self.state = _STEP[self.state, role[:1]]
                self._put(role, text)
            elif letter == "R":
                self._put(self._forced(), text)
            return

    def finish(self) -> None:
        for _ in self.letters:  # insertions behind the last row
            self._put(self._forced(), "")


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "o"


def _symbol(role: str, fault: str | None) -> str:
    return "d" if fault in (_BLANK, _DUPLICATE) else _initial(role) + ("t" if fault == _CUT else "")


def _illegal(roles) -> int:
    initials = [_initial(r) for r in roles]
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))


def prepared(rows: DataFrame) -> DataFrame:
    """_c, _turn, _role, _text, _blank, _cut and _digest of every row."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select(F.col("`conv_id`").alias("_c"), F.col("`turn`").cast("bigint").alias("_turn"), role.alias("_role"), text.alias("_text"))
    return rows.select("*", (~F.col("_text").rlike(r"[^\x20\x09-\x0D]")).alias("_blank"),
                       (~F.col("_text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("_cut"),
                       F.unhex(F.sha2("_text", 256)).alias("_digest"))


_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_RESULT_NAMES = [c.split()[0] for c in _RESULT.split(", ")]


def _whole(rows: list[tuple]) -> tuple:
    """The result of a conversation whose rows (turn, role, text, blank, cut, digest) are all here."""
    seen, faults = set(), []
    for _, role, _, blank, cut, digest in rows:
        faults.append(_BLANK if blank else _DUPLICATE if (role, digest) in seen else _CUT if cut else None)
        seen.add((role, digest))
    turns = {r[0] for r in rows if r[0] is not None}
    cost, audit, _ = cheapest(_runs(_symbol(r[1], f) for r, f in zip(rows, faults)))
    lines = _Lines()
    lines.audit(audit)
    for _, role, text, *_ in rows:
        lines.row(role, text)
    lines.finish()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in (_BLANK, _DUPLICATE, _CUT)),
            _illegal([r[1] for r in rows]), cost, audit, lines.sha.hexdigest())


def _repair_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole conversations, in order, to one result each."""
    names, id_type = ["_turn", "_role", "_text", "_blank", "_cut", "_digest"], None
    conv, rows, done = None, [], []

    def flush():
        ids, results = zip(*done)
        columns = [pa.array(ids, id_type), *(pa.array(c) for c in zip(*results))]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *_RESULT_NAMES])

    for b in batches:
        id_type = b.column("_c").type
        for begin in range(0, b.num_rows, 1000):
            part = b.slice(begin, 1000)
            for c, *row in zip(part.column("_c").to_pylist(), *(part.column(n).to_pylist() for n in names)):
                if rows and c != conv:
                    done.append((conv, _whole(rows)))
                    rows = []
                conv = c
                rows.append(tuple(row))
            if len(done) >= 1000:
                yield flush()
    if rows:
        done.append((conv, _whole(rows)))
    if done:
        yield flush()


# --- conversations that lie across chunks: one piece per chunk ---------------------------------

_PIECE = ("_c {id}, _chunk int, m array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, "
          "last string, low bigint, high bigint, turns bigint, low_turn bigint, high_turn bigint")


def _faults(piece: pd.DataFrame) -> list:
    return [_BLANK if b else _DUPLICATE if not f else _CUT if t else None
            for b, f, t in zip(piece["_blank"], piece["_first"], piece["_cut"])]


def _sum_up(piece: pd.DataFrame) -> pd.DataFrame:
    piece = piece.sort_values("_pos")
    faults, roles = _faults(piece), piece["_role"].tolist()
    m = None
    for symbol, n in _runs(_symbol(r, f) for r, f in zip(roles, faults)):
        run = _run_matrix(symbol, n)
        m = run if m is None else _product(m, run)
    turns = sorted({int(t) for t in piece["_turn"] if not pd.isna(t)})
    low, high = (turns[0], turns[-1]) if turns else (None, None)
    return pd.DataFrame({
        "_c": piece["_c"].iloc[:1].array, "_chunk": piece["_chunk"].iloc[:1].array, "m": [[x for row in m for x in row]],
        "blank": faults.count(_BLANK), "duplicate": faults.count(_DUPLICATE), "truncated": faults.count(_CUT), "illegal": _illegal(roles),
        "first": _initial(roles[0]), "last": _initial(roles[-1]), "low": pd.array([low], "Int64"), "high": pd.array([high], "Int64"),
        "turns": len(turns), "low_turn": pd.array([low], "Int64"), "high_turn": pd.array([high], "Int64")})


_CHAINED = "_c {id}, _chunk int, last boolean, after array<bigint>, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def _chain(pieces: pd.DataFrame) -> pd.DataFrame:
    """Costs to go behind every piece of a conversation, and the conversation's counts; at most one piece per chunk."""
    pieces = pieces.sort_values("_chunk").reset_index(drop=True)
    v, after = _END, []
    for i in reversed(range(len(pieces))):
        after.append([int(x) for x in v])
        m = [int(x) for x in pieces["m"][i]]
        v = _times(_inserted(), v) if i == len(pieces) - 1 else v
        v = _times([tuple(m[r:r + 4]) for r in range(0, 16, 4)], v)
    known = pieces[pieces["low"].notna()]
    shared = sum(a == b for a, b in zip(known["high"], known["low"].iloc[1:]))  # a turn cut by a chunk's border
    gaps = int(known["high"].max() - known["low"].min()) + 1 - int(known["turns"].sum()) + shared if len(known) else 0
    illegal = int(pieces["illegal"].sum()) + sum(a + b not in _LEGAL for a, b in zip(pieces["last"], pieces["first"].iloc[1:]))
    return pd.DataFrame({"_c": pieces["_c"], "_chunk": pieces["_chunk"], "last": [i == len(pieces) - 1 for i in range(len(pieces))],
                         "after": after[::-1], "gaps": gaps, **{c: int(pieces[c].sum()) for c in ("blank", "duplicate", "truncated")},
                         "illegal": illegal, "cost": v[_START]})


_UNROLLED = "_c {id}, _chunk int, enter int, leave int, audit string"


def _unroll(piece: pd.DataFrame, chained: pd.DataFrame) -> pd.DataFrame:
    """The piece's edits from each state it may be entered in."""
    piece = piece.sort_values("_pos")
    runs = _runs(_symbol(r, f) for r, f in zip(piece["_role"], _faults(piece)))
    after, last = tuple(int(x) for x in chained["after"].iloc[0]), bool(chained["last"].iloc[0])
    found = [(state, *cheapest(runs, state, after, last)) for state in range(4)]
    found = [(state, to, audit) for state, cost, audit, to in found if cost < INF]
    return pd.DataFrame({"_c": [piece["_c"].iloc[0]] * len(found), "_chunk": piece["_chunk"].iloc[0],
                         "enter": [f[0] for f in found], "leave": [f[1] for f in found], "audit": [f[2] for f in found]}
                        ).astype({"_c": piece["_c"].dtype})


def _follow(pieces: pd.DataFrame) -> pd.DataFrame:
    """Of a conversation's unrolled pieces those that the chain enters."""
    by_place = {(c, e): i for i, (c, e) in enumerate(zip(pieces["_chunk"], pieces["enter"]))}
    state, chosen = _START, []
    for chunk in sorted(set(pieces["_chunk"])):
        chosen.append(by_place[chunk, state])
        state = pieces["leave"].iloc[chosen[-1]]
    return pieces.iloc[chosen][["_c", "_chunk", "audit"]]


def _digest_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams audits and rows of conversations in order; gives each conversation's audit and SHA-256."""
    conv, lines, audits, id_type, any_row = None, None, [], None, False

    def result():
        lines.finish()
        return pa.RecordBatch.from_arrays([pa.array([conv], id_type), pa.array(["".join(audits)]), pa.array([lines.sha.hexdigest()])],
                                          ["_c", "audit", "repaired_sha256"])

    for b in batches:
        id_type = b.column("_c").type
        for begin in range(0, b.num_rows, 1000):
            part = b.slice(begin, 1000)
            for c, audit, role, text in zip(*(part.column(n).to_pylist() for n in ("_c", "_audit", "_role", "_text"))):
                if not any_row or c != conv:
                    if any_row:
                        yield result()
                    conv, lines, audits, any_row = c, _Lines(), [], True
                if audit is not None:
                    audits.append(audit)
                    lines.audit(audit)
                else:
                    lines.row(role, text)
    if any_row:
        yield result()


def _across(rows: DataFrame, id_type: str) -> DataFrame:
    light = rows.select("_c", "_turn", "_role", "_blank", "_cut", "_digest", "_chunk", "_pos")
    # (_chunk, _pos) is unique, so this join has no hot key; the grouped minimum is taken before any shuffle.
    firsts = light.groupBy("_c", "_role", "_digest").agg(F.min(F.struct("_chunk", "_pos")).alias("_at"))
    firsts = firsts.select("_at._chunk", "_at._pos", F.lit(True).alias("_first"))
    light = store(light.join(firsts, ["_chunk", "_pos"], "left").withColumn("_first", F.coalesce("_first", F.lit(False))).drop("_digest"), "turns")
    pieces = light.groupBy("_c", "_chunk").applyInPandas(_sum_up, _PIECE.format(id=id_type))
    chained = store(pieces.groupBy("_c").applyInPandas(_chain, _CHAINED.format(id=id_type)), "turn-chains")
    unrolled = light.groupBy("_c", "_chunk").cogroup(chained.groupBy("_c", "_chunk")).applyInPandas(_unroll, _UNROLLED.format(id=id_type))
    chosen = unrolled.groupBy("_c").applyInPandas(_follow, f"_c {id_type}, _chunk int, audit string")
    null = F.lit(None).cast("string")
    stream = chosen.select("_c", "_chunk", F.lit(-1).cast("bigint").alias("_pos"), F.col("audit").alias("_audit"), null.alias("_role"), null.alias("_text"))
    stream = stream.unionByName(rows.select("_c", "_chunk", "_pos", null.alias("_audit"), "_role", "_text"))
    lines = stream.repartition("_c").sortWithinPartitions("_c", "_chunk", "_pos").mapInArrow(
        _digest_lines, f"_c {id_type}, audit string, repaired_sha256 string")
    counts = chained.where("last").drop("_chunk", "after", "last")
    return counts.join(lines.withColumnRenamed("_c", "_d"), F.col("_c").eqNullSafe(F.col("_d"))).select(F.col("_c").alias("conv_id"), *_RESULT_NAMES)


def repair(rows: DataFrame, chunks: int | None = None) -> DataFrame:
    """conv_id, the counts of faults, and the cheapest edits of every conversation of (conv_id, turn, role, text)."""
    ready = prepared(rows).withColumn("_salt", F.monotonically_increasing_id())
    ready = ordered_chunks(ready, [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_digest"), F.col("_salt")], ["_c"], chunks)
    id_type = dict(ready.dtypes)["_c"]
    # The first and the last conversation of every chunk: those found at the ends of two chunks lie across a border.
    key = F.struct("_c")
    ends = ready.groupBy("_chunk").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ends = ends.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("k")).groupBy("k").count()
    crossing = store(ends.where("count > 1").select(F.col("k._c").alias("_k")), "turns-across")  # fewer than chunks
    crosses = F.col("_c").eqNullSafe(F.col("_k"))
    inside = ready.join(F.broadcast(crossing), crosses, "left_anti")
    inside = inside.select("_c", "_turn", "_role", "_text", "_blank", "_cut", "_digest").mapInArrow(_repair_chunks, f"conv_id {id_type}, {_RESULT}")
    across = ready.join(F.broadcast(crossing), crosses, "left_semi")
    return inside.unionByName(_across(across, id_type))


def damage(rows: DataFrame) -> DataFrame:
    """Test damage by crc32(conv_id:turn) % 20: 0 drops the row, 1 empties its text, 2 removes its `.!?`, 3 repeats it, 4 makes it the user's."""
    conv, turn, role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = F.crc32(F.concat_ws(":", conv, turn)) % 20
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                       F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_n")).drop("_n")


def damaged_and_repaired(rows: DataFrame, chunks: int | None = None) -> DataFrame:
    """One row per conv_id of rows: what repair() finds after damage(); zeros and the empty text's hash where no row is left."""
    found = repair(damage(rows), chunks)
    ids = rows.select(F.col("conv_id").alias("_id")).distinct()
    out = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return out.select(F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(empty.get(c, 0))).alias(c) for c in _RESULT_NAMES])
