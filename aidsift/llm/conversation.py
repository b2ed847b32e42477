"""Repair of conversation structure (operator 13).

A conversation is right when its roles spell ``(s?(ua)+)?``: nothing, or an optional
system turn and then user and assistant in turn. Four states say what was read
last: nothing, system, user, assistant. Each row is kept, given another role or
deleted, and empty turns are inserted, at the least cost; among cheapest repairs
the one whose audit (the edits' initials in order) is least in ASCII order.

Hirschberg's divide and conquer rebuilds the repair: costs run forward to
the middle and backward to it, four states each, and of the crossings that
add up to the least cost the audit-least is taken; then both halves. What a
crossing's audit needs is an order of the four cheapest prefixes, not their
text: prefixes that consume the same rows end with the edit of the
same row, so none is the beginning of another, and an order of four
numbers is carried along (``_step``).

The same crossings join blocks of a conversation. Rows are sorted over all
partitions; blocks of at most ``BLOCK`` rows give a 4 x 4 table of costs and orders
each, the tables of a conversation are folded in order, and each block is
repaired by itself between its two crossings. So a conversation that holds a third
of all rows is spread over the cluster, except for the fold of its tables
(one row per block) and the hash of its repaired text, which is one sequence
by definition and streams through one task without being held.

* Null role and text are one space; a null turn sorts first; a null conversation id is an id.
* Rows of one turn are taken by role and text, so repeated rows are adjacent.
* Empty texts are blank. A very long text is compared by its hash and sorted by its beginning across partitions.
* A conversation without rows gives zeros, an empty audit and no repaired rows. An empty table gives no rows.
* Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

BLOCK = 4096
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
NO = 1 << 40
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
#: A row's symbol: role initial (0 s, 1 u, 2 a, 3 other) + 4 if it must go + 8 if it is truncated.
MUST_GO, TRUNCATED = 4, 8
ROLES = {"u": "user", "a": "assistant"}

_INSERTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
_STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def _inserts(state: int) -> list[tuple[int, str]]:
    """(state, roles) after inserting no, one or two turns; more would only come round."""
    out = [(state, "")]
    for _ in range(2):
        at, roles = out[-1]
        out.append((_STATE_OF[_INSERTED[at]], roles + _INSERTED[at]))
    return out


def _edits(symbol: int) -> list[list[tuple[int, int, str, str]]]:
    """For each state the ways over a row: (next state, cost, audit letters, inserted roles)."""
    initial, cut = symbol & 3, CUT_SHORT if symbol & TRUNCATED else 0
    ways: list[list[tuple[int, int, str, str]]] = []
    for state in STATES:
        found = []
        for at, roles in _inserts(state):
            cost, audit = INSERT * len(roles), "I" * len(roles)
            found.append((at, cost + DELETE, audit + "D", roles))
            if symbol & MUST_GO:
                continue
            turn = _STATE_OF[_INSERTED[at]]  # the one role, besides a first system turn, that may follow
            found.append((turn, cost + REROLE + cut, audit + "R", roles))
            if initial == 0 and at == START:
                found.append((SYSTEM, cost + cut, audit + "K", roles))
            elif initial in (1, 2) and turn == (USER, ASSISTANT)[initial - 1]:
                found.append((turn, cost + cut, audit + "K", roles))
        ways.append(found)
    return ways


WAYS = [_edits(symbol) for symbol in range(16)]
#: Ways to the end of the conversation: inserted turns, then nothing read or an assistant last.
ENDS = [[(INSERT * len(roles), "I" * len(roles), roles) for at, roles in _inserts(s) if at in (START, ASSISTANT)] for s in STATES]


def _ordered(best: list) -> tuple[list[int], list[int]]:
    """Costs and order numbers of the states from their (cost, order, letters)."""
    place = {key: i for i, key in enumerate(sorted(b[1:] for b in best if b is not None))}
    return [NO if b is None else b[0] for b in best], [0 if b is None else place[b[1:]] for b in best]


def _step(costs: list[int], order: list[int], symbol: int) -> tuple[list[int], list[int]]:
    """Costs and order of the cheapest prefixes, one row on."""
    best: list = [None] * 4
    for state in STATES:
        if costs[state] < NO:
            for to, cost, letters, _ in WAYS[symbol][state]:
                key = (costs[state] + cost, order[state], letters)
                if best[to] is None or key < best[to]:
                    best[to] = key
    return _ordered(best)


def _forward(symbols: bytes, state: int) -> tuple[list[int], list[int]]:
    costs, order = [NO] * 4, [0] * 4
    costs[state] = 0
    for symbol in symbols:
        costs, order = _step(costs, order, symbol)
    return costs, order


def _backward(symbols: bytes, state: int) -> list[int]:
    """Least cost from each state over all rows to ``state``."""
    costs = [NO] * 4
    costs[state] = 0
    for symbol in reversed(symbols):
        costs = [min((cost + costs[to] for to, cost, _, _ in WAYS[symbol][s]), default=NO) for s in STATES]
    return costs


def transfer(symbols: bytes) -> tuple[list[int], list[int]]:
    """Costs and orders of a block, from each state (four numbers each) to each state."""
    found = [_forward(symbols, s) for s in STATES]
    return [c for costs, _ in found for c in costs], [o for _, order in found for o in order]


def crossings(tables: list[tuple[list[int], list[int]]]) -> tuple[list[int], int, str]:
    """The state at each block's two ends, the least cost, and the roles inserted at the end."""
    costs, order, back = [0, NO, NO, NO], [0] * 4, []
    for cost, rank in tables:
        best: list = [None] * 4
        for s in STATES:
            for to in STATES:
                if costs[s] < NO and cost[4 * s + to] < NO:
                    key = (costs[s] + cost[4 * s + to], order[s], rank[4 * s + to], s)
                    if best[to] is None or key < best[to]:
                        best[to] = key
        back.append([None if b is None else b[3] for b in best])
        costs, order = _ordered([None if b is None else b[:3] for b in best])
    total, _, _, state, roles = min((costs[s] + cost, order[s], letters, s, roles) for s in STATES if costs[s] < NO for cost, letters, roles in ENDS[s])
    path = [state]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1], total, roles


def hirschberg(symbols: bytes, first: int, last: int) -> list[tuple[str, str, int]]:
    """(letter, roles inserted before it, state after it) of each row of the audit-least cheapest repair from
    state ``first`` to state ``last``, in space linear in the rows."""
    if len(symbols) == 1:
        _, letters, roles, to = min((cost, letters, roles, to) for to, cost, letters, roles in WAYS[symbols[0]][first] if to == last)
        return [(letters[-1], roles, to)]
    if not symbols:
        return []
    middle = len(symbols) // 2
    costs, order = _forward(symbols[:middle], first)
    rest = _backward(symbols[middle:], last)
    _, _, crossing = min((costs[s] + rest[s], order[s], s) for s in STATES if costs[s] < NO and rest[s] < NO)
    return hirschberg(symbols[:middle], first, crossing) + hirschberg(symbols[middle:], crossing, last)


# --- Spark ---

def damaged(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with the damage their id and turn draw: see the cases below."""
    draw = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), draw.alias("draw")).where("draw != 0")
    out = out.withColumns({
        "text": F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role"))})
    return out.withColumn("copy", F.explode(F.when(F.col("draw") == 3, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("draw", "copy")


def _key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def placed(rows: DataFrame) -> DataFrame:
    """Rows in their order, written: ``place`` rises along each conversation. ``symbol`` lacks what
    only other rows tell (16: blank, 8: truncated)."""
    keyed = rows.select(_key("conv_id").alias("c"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    turn = F.asc_nulls_first("turn")
    # sorted by the beginning of the text across partitions, so that the sample of the sort stays small
    dealt = keyed.repartitionByRange("c", turn, F.substring("role", 1, 32), F.substring("text", 1, 64)).sortWithinPartitions("c", turn, "role", "text")
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    symbol = _initial(F.col("role")) + F.when(F.length(F.btrim("text", F.lit(BLANKS))) == 0, 16).when(end.isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    return written(dealt.select("c", "turn", "role", "text", symbol.alias("symbol"), F.monotonically_increasing_id().alias("place")), "turns")


def _mapped(df: DataFrame, run: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """A row for each row, as dicts, a few hundred at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield pa.RecordBatch.from_pylist([run(r) for r in batch.slice(at, 256).to_pylist()], schema=kind)

    return df.mapInArrow(each, schema)


def _blocks(turns: DataFrame) -> DataFrame:
    """A row per conversation and block of places, with its rows' places and symbols, its cost table and counts."""
    block = F.expr(f"place div {BLOCK}").alias("block")
    said = turns.where("symbol < 16").groupBy("c", "role", F.md5(F.col("text").cast("binary")).alias("said")).agg(F.min("place").alias("place"))
    # a row is a duplicate unless it is the first of its kind: marks of first rows meet the rows in their block
    marks = said.select("c", block, "place", F.lit(32).alias("symbol"))
    gathered = turns.select("c", block, "place", "symbol").union(marks).groupBy("c", "block").agg(
        F.collect_list(F.struct("place", "symbol")).alias("rows"))

    def table(r: dict) -> dict:
        firsts = {x["place"] for x in r["rows"] if x["symbol"] == 32}
        rows = sorted((x["place"], x["symbol"]) for x in r["rows"] if x["symbol"] != 32)
        symbols, blank, twice, cut, illegal, before = bytearray(), 0, 0, 0, 0, None
        for place, symbol in rows:
            initial, must = symbol & 3, 0
            if symbol & 16:
                blank, must = blank + 1, MUST_GO
            elif place not in firsts:
                twice, must = twice + 1, MUST_GO
            elif symbol & TRUNCATED:
                cut, must = cut + 1, TRUNCATED
            symbols.append(initial | must)
            illegal += before is not None and (before, initial) not in ((0, 1), (1, 2), (2, 1))
            before = initial
        costs, order = transfer(bytes(symbols))
        return {"c": r["c"], "block": r["block"], "first": rows[0][1] & 3, "last": before, "places": [p for p, _ in rows], "symbols": bytes(symbols),
                "costs": costs, "order": order, "blank": blank, "twice": twice, "cut": cut, "illegal": illegal}

    return _mapped(gathered, table, "c string, block long, first int, last int, places array<long>, symbols binary, costs array<long>, order array<int>, "
                                    "blank long, twice long, cut long, illegal long")


def _fold(r: dict) -> dict:
    """A conversation's counts, and the states between its blocks."""
    blocks = sorted(r["blocks"], key=lambda b: b["block"])
    path, cost, roles = crossings([(b["costs"], b["order"]) for b in blocks])
    seams = sum((a["last"], b["first"]) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(blocks, blocks[1:]))
    return {"c": r["c"], "cost": cost, "roles": roles, "illegal": sum(b["illegal"] for b in blocks) + seams,
            **{k: sum(b[k] for b in blocks) for k in ("blank", "twice", "cut")},
            "between": [{"block": b["block"], "from_state": s, "to_state": t} for b, s, t in zip(blocks, path, path[1:])]}


def _repair(r: dict) -> dict:
    edits = hirschberg(r["symbols"], r["from_state"], r["to_state"])
    return {"c": r["c"], "block": r["block"], "audit": "".join("I" * len(roles) + letter for letter, roles, _ in edits),
            "edits": [{"place": p, "roles": roles, "letter": letter, "role": ("", "", "user", "assistant")[state] if letter == "R" else ""}
                      for p, (letter, roles, state) in zip(r["places"], edits)]}


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each edit row, followed by its turn, to the repaired turns; rows come sorted and none is held over but the edit."""
    schema = pa.schema([("c", pa.string()), ("place", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("text", pa.string())])
    edit = None
    for batch in batches:
        out, size = [], 0
        for i in range(batch.num_rows):
            c, place, roles, letter, role, text = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4, 5, 6))
            if letter is not None:
                out += [(c, place, k, ROLES[x], "") for k, x in enumerate(roles)]
                edit = (letter, role)
            elif edit[0] != "D":
                out.append((c, place, 2, edit[1] if edit[0] == "R" else role, text))
                size += len(text)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines, streamed."""
    c, state = None, None

    def row():
        return pa.RecordBatch.from_pydict({"c": [c], "repaired_sha256": [state.hexdigest()]})

    for batch in batches:
        for i in range(batch.num_rows):
            key = batch.column(0)[i].as_py()
            if state is None or key != c:
                if state is not None:
                    yield row()
                c, state = key, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(batch.column(3)[i].as_py().encode() + b":" + batch.column(4)[i].as_py().encode())
    if state is not None:
        yield row()


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repair of rows of (conv_id, turn, role, text).

    Returns a row per conversation (``c``, its key; gaps, blank, duplicate, truncated, illegal, cost, audit) and the
    repaired turns (``c, place, part, role, text``), each conversation's in order and in one partition.
    """
    turns = placed(conversations)
    by_turn = turns.groupBy("c", "turn").agg(F.lit(1).alias("one")).groupBy("c").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    blocks = written(_blocks(turns), "blocks")
    gathered = blocks.select("c", F.struct(*[x for x in blocks.columns if x not in ("c", "places", "symbols")]).alias("b")).groupBy("c").agg(
        F.collect_list("b").alias("blocks"))
    folded = written(_mapped(gathered, _fold, "c string, cost long, roles string, illegal long, blank long, twice long, cut long, "
                                              "between array<struct<block:long,from_state:int,to_state:int>>"), "folded")
    between = folded.select("c", F.explode("between").alias("x")).select("c", "x.block", "x.from_state", "x.to_state")
    edited = written(_mapped(blocks.select("c", "block", "places", "symbols").join(between, ["c", "block"]), _repair,
                             "c string, block long, audit string, edits array<struct<place:long,roles:string,letter:string,role:string>>"), "edits")
    audits = edited.groupBy("c").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    summary = (folded.join(audits, "c").join(by_turn, "c")
               .select("c", "gaps", "blank", F.col("twice").alias("duplicate"), F.col("cut").alias("truncated"), "illegal", "cost",
                       F.concat("audit", F.repeat(F.lit("I"), F.length("roles"))).alias("audit")))
    # an edit sorts before its turn; turns inserted at the end follow all
    edits = edited.select("c", F.explode("edits").alias("e")).select("c", "e.place", F.lit(0).alias("kind"), "e.roles", "e.letter", "e.role",
                                                                     F.lit(None).cast("string").alias("text"))
    tails = folded.where("roles != ''").select("c", F.lit((1 << 63) - 1).alias("place"), F.lit(0).alias("kind"), "roles", F.lit("I").alias("letter"),
                                               F.lit("").alias("role"), F.lit(None).cast("string").alias("text"))
    said = turns.select("c", "place", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("roles"), F.lit(None).cast("string").alias("letter"), "role", "text")
    lines = edits.union(tails).union(said).repartition("c").sortWithinPartitions("c", "place", "kind")
    return summary, lines.mapInArrow(_lines, "c string, place long, part int, role string, text string")


def audited(original: DataFrame, rows: DataFrame) -> DataFrame:
    """The repair of ``rows`` as a row for every ``conv_id`` of ``original``, with the hash of its repaired ``role:text`` lines."""
    summary, turns = repair(rows)
    digests = turns.mapInArrow(_digests, "c string, repaired_sha256 string")
    ids = original.select("conv_id").distinct().withColumn("c", _key("conv_id"))
    found = ids.join(summary, "c", "left").join(digests, "c", "left")
    zeros = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
