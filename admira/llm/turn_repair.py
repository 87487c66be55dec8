"""Conversation structure repair by depth-first branch-and-bound.

A conversation should be an optional system turn, then pairs of user and assistant, or nothing: role initials
``(s?(ua)+)?``. Edits of its rows, in order: Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert an empty turn 5; a
truncated row that isn't deleted adds 5; blank rows and repeats must be deleted. The cheapest edits are found, of equal ones
those whose initials (the audit) come first in ASCII.

Rows are dealt by ranges of their order and cut into blocks of ``BLOCK`` rows, so that a long conversation is spread over
tasks. For a block, and each state before and after it that its place allows, an explicit stack is searched depth first,
the most promising edit first. A suffix lower bound, the forced costs plus one for each of as many disjoint
illegal neighbours as possible among the rows to come, cuts what can't reach the incumbent (cost, audit); a table of the best
(cost, audit) at each node (row, state) cuts worse prefixes. The search ends with an empty stack: the incumbent is proved.
Blocks are then put together in order, per state; what the best edits of all states have in common is final, so little is
held. At one node two prefixes of equal cost have as many inserts, so neither begins the other and their order outlasts any
suffix: keeping one of them is exact.

The repaired texts come from one sorted pass over each conversation, which holds a batch of rows at a time. This pass, and
the digest of a whole conversation, is sequential by its nature: a conversation's texts go through one task.

Defined results: null roles and texts are one space; rows go by (turn, role, text), null turns first; equal rows are repeats
of each other, the first one stays; a null conv_id is a conversation; a role counts by its first character, case-sensitive;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .common import running, stage

#: Rows whose edits are searched together.
BLOCK = 64
_SPACE = " \t\n\x0b\x0c\r"
_FULL_STOPS = (".", "!", "?")
#: What is known of a row: free, cut off, or to be deleted.
FREE, CUT, GONE = 0, 1, 2
#: States: nothing written; a system turn; a user turn last; an assistant turn last. DONE ends a conversation.
START, SYSTEM, USER, ANSWER, DONE = range(5)
_AFTER = {"s": SYSTEM, "u": USER, "a": ANSWER}
_ENDS = frozenset((START, ANSWER))
_REACHED = {START: (START, SYSTEM, USER, ANSWER), SYSTEM: (SYSTEM, USER, ANSWER), USER: (USER, ANSWER), ANSWER: (USER, ANSWER)}


def _then(state: int, initial: str) -> int | None:
    """The state after a turn with this initial, or None where it may not follow."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == USER else USER
    return ANSWER if initial == "a" and state == USER else None


def _wanted(state: int) -> str:
    return "a" if state == USER else "u"


def _suffix_bound(rows: list[tuple[str, int]], goals: frozenset[int]):
    """A function of (row, state): what the rows from there on cost at least.

    A cut-off or unwanted row costs 2. Two free rows that follow each other and may not, cost 1 at least, if no other such
    pair shares a row with them; the state before and the end count as neighbours too.
    """
    n, free = len(rows), [k for k, (_, code) in enumerate(rows) if code == FREE]
    forced, first = [0] * (n + 1), [len(free)] * (n + 1)
    for i in range(n - 1, -1, -1):
        forced[i] = forced[i + 1] + (2 if rows[i][1] else 0)
        first[i] = first[i + 1] - (not rows[i][1])

    def clash(state: int | None, k: int) -> bool:
        return state is None or (state not in goals if k == len(free) else _then(state, rows[free[k]][0]) is None)

    pairs = [0] * (len(free) + 2)
    for k in range(len(free) - 1, -1, -1):
        pairs[k] = max(pairs[k + 1], clash(_AFTER.get(rows[free[k]][0]), k + 1) + pairs[k + 2])

    def bound(i: int, state: int) -> int:
        k = first[i]
        return forced[i] + max(pairs[k], clash(state, k) + pairs[k + 1])

    return bound


def cheapest(rows: list[tuple[str, int]], entry: int = START, goals: frozenset[int] = _ENDS) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of rows (initial, code) from the state ``entry`` to one of ``goals``."""
    n, bound = len(rows), _suffix_bound(rows, goals)
    seen: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    best: tuple[int, str] | None = None
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if seen[i, state] != (cost, audit):
            continue  # a better prefix came here meanwhile
        if i == n and state in goals and (best is None or (cost, audit) < best):
            best = (cost, audit)
        moves = [("I", i, _then(state, _wanted(state)), 5)]
        if i < n:
            initial, code = rows[i]
            moves.append(("D", i + 1, state, 2))
            if code != GONE:
                late = 5 * (code == CUT)
                moves += [("K", i + 1, _then(state, initial), late), ("R", i + 1, _then(state, _wanted(state)), 1 + late)]
        found = []
        for edit, j, after, price in moves:
            if after is None:
                continue
            made, least = (cost + price, audit + edit), cost + price + bound(j, after)
            if best is not None and (least > best[0] or (least == best[0] and made[1] > best[1][: len(made[1])])):
                continue
            if (j, after) in seen and seen[j, after] <= made:
                continue
            seen[j, after] = made
            found.append((least, edit, (j, after, *made)))
        stack += [x[2] for x in sorted(found, reverse=True)]
    return best


def apply(rows, audit: str):
    """(role, text, edit) of what an audit makes of rows (role, text), which are read one at a time."""
    state, at = START, 0
    for role, text in rows:
        while audit[at] == "I":
            yield (name := _NAMES[_wanted(state)]), b"", "I"
            state, at = _AFTER[name[0]], at + 1
        edit, at = audit[at], at + 1
        if edit == "D":
            continue
        role = role if edit == "K" else _NAMES[_wanted(state)]
        yield role, text, edit
        state = _AFTER[role[0]]
    for _ in audit[at:]:
        yield (name := _NAMES[_wanted(state)]), b"", "I"
        state = _AFTER[name[0]]


_NAMES = {"u": "user", "a": "assistant"}


def _faults(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored rows in order (c, t, role, text, __row), and of each (c, t, initial, __row, fault).

    The fault is blank, duplicate, truncated or null, the first that holds.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), filled("role").alias("role"), filled("text").alias("text"))
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    end = F.right(F.rtrim(F.col("text"), F.lit(_SPACE)), F.lit(1))
    rows = rows.withColumns({"h": F.unhex(F.md5(said.cast("binary"))), "end": end, "copy": F.monotonically_increasing_id()})
    order = [F.col("c").asc_nulls_first(), F.col("t").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("copy").asc()]
    rows = stage(running(rows, order, {}), "turns")
    first = rows.groupBy(F.col("c").alias("o"), F.col("h").alias("oh")).agg(F.min("__row").alias("first"))
    again = rows.select("c", "h", "__row").join(first, F.col("c").eqNullSafe(F.col("o")) & (F.col("h") == F.col("oh")) & (F.col("__row") > F.col("first")))
    again = stage(again.select(F.col("__row").alias("r")), "repeats")
    small = rows.select("c", "t", F.substring("role", 1, 1).alias("initial"), "end", "__row").join(again, F.col("__row") == F.col("r"), "left")
    fault = F.when(F.col("end") == "", "blank").when(F.col("r").isNotNull(), "duplicate").when(~F.col("end").isin(*_FULL_STOPS), "truncated")
    return rows, small.select("c", "t", "initial", "__row", fault.alias("fault"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_BLOCK = "struct<blank:long,duplicate:long,truncated:long,illegal:long,turns:long,t0:long,t1:long,r0:string,r1:string,entry:array<int>,exit:array<int>,cost:array<long>,audit:array<string>>"
_SUMMARY = "struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string>"


def _arrow(ddl: str) -> pa.DataType:
    return to_arrow_type(_parse_datatype_string(ddl))


def _blocks(small: DataFrame) -> DataFrame:
    """A row for each conversation and block of rows: counts, what its neighbours need, and the cheapest edits by states."""
    kind, kind_of_block = small.schema["c"].dataType.simpleString(), _arrow(_BLOCK)
    row = F.struct("__row", "t", "initial", "fault")
    packed = small.groupBy("c", F.floor(F.col("__row") / BLOCK).alias("g")).agg(F.sort_array(F.collect_list(row)).alias("rows"))  # BLOCK rows at most

    def run(batches):
        for batch in batches:
            made = []
            for g, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                faults, heads, turns = [r["fault"] for r in rows], [r["initial"] for r in rows], [r["t"] for r in rows if r["t"] is not None]
                coded = [(h, FREE if f is None else CUT if f == "truncated" else GONE) for h, f in zip(heads, faults, strict=True)]
                opens, ends = rows[0]["__row"] > g * BLOCK, rows[-1]["__row"] < g * BLOCK + BLOCK - 1  # else a neighbour may hold more of it
                ways = [(a, b, found) for a in ((START,) if opens else _REACHED) for b in ((DONE,) if ends else _REACHED[a]) if (found := cheapest(coded, a, _ENDS if ends else frozenset((b,)))) is not None]
                made.append({
                    "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"), "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(heads, heads[1:])),
                    "turns": len(set(turns)), "t0": min(turns, default=None), "t1": max(turns, default=None), "r0": heads[0], "r1": heads[-1],
                    "entry": [w[0] for w in ways], "exit": [w[1] for w in ways], "cost": [w[2][0] for w in ways], "audit": [w[2][1] for w in ways],
                })
            table = pa.table({"c": batch.column(0), "g": batch.column(1), "block": pa.array(made, kind_of_block)})
            yield from table.to_batches()

    return packed.mapInArrow(run, f"c {kind}, g long, block {_BLOCK}")


class _Conversation:
    """What is known of a conversation while its blocks come in order."""

    def __init__(self):
        self.live, self.done, self.base = {START: (0, "")}, [], 0
        self.counts, self.turns, self.t0, self.t1, self.role = dict.fromkeys(_COUNTS, 0), 0, None, None, None

    def add(self, b: dict) -> None:
        new: dict[int, tuple[int, str]] = {}
        for a, z, cost, audit in zip(b["entry"], b["exit"], b["cost"], b["audit"], strict=True):
            if a in self.live:
                way = (self.live[a][0] + cost, self.live[a][1] + audit)
                new[z] = min(way, new.get(z, way))
        shared = commonprefix([audit for _, audit in new.values()])
        self.done.append(shared)
        self.live = {z: (cost, audit[len(shared) :]) for z, (cost, audit) in new.items()}
        for c in _COUNTS:
            self.counts[c] += b[c]
        if self.role is not None:
            self.counts["illegal"] += self.role + b["r0"] not in ("su", "ua", "au")
        self.role = b["r1"]
        if b["turns"]:
            self.turns += b["turns"] - (self.t1 == b["t0"])
            self.t0, self.t1 = b["t0"] if self.t0 is None else self.t0, b["t1"]

    def summary(self) -> dict:
        cost, audit = min(v for z, v in self.live.items() if z in (START, ANSWER, DONE))
        gaps = 0 if self.t0 is None else self.t1 - self.t0 + 1 - self.turns
        return self.counts | {"gaps": gaps, "cost": cost, "audit": "".join(self.done) + audit}


def _groups(batches, key):
    """(conversation, its rows), the rows as they come; rows of a conversation follow each other."""
    rows = (r for batch in batches for a in range(0, len(batch), 256) for r in batch.slice(a, 256).to_pylist())
    held = next(rows, None)

    def of(now):
        nonlocal held
        while held is not None and held[key] == now:
            row, held = held, None
            yield row
            held = next(rows, None)

    while held is not None:
        now = held[key]
        group = of(now)
        yield now, group
        for _ in group:
            pass


def _batches(rows, schema: pa.Schema, most: int = 256, size: int = 1 << 24):
    """Record batches of dicts, of ``most`` rows and about ``size`` bytes of text."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row.get("text") or b"")
        if len(held) == most or n > size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _repaired(batches):
    """For each conversation a row with its summary, then its repaired turns."""
    for conv, rows in _groups(batches, "c"):
        known, first = _Conversation(), None
        for row in rows:
            if row["later"]:
                first = row
                break
            known.add(row["block"])
        summary = known.summary()
        yield {"conv_id": conv, "place": -1, "summary": summary}
        texts = ((r["role"], r["text"]) for r in chain([first], rows))
        for place, (role, text, edit) in enumerate(apply(texts, summary["audit"])):
            yield {"conv_id": conv, "place": place, "role": role, "text": text, "edit": edit}


def _mixed(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit, summary): of each conversation a row of place -1 with its summary, then its turns
    in order, all in one partition; texts are bytes."""
    rows, small = _faults(turns)
    kind, fields = rows.schema["c"].dataType.simpleString(), [("place", pa.int64()), ("role", pa.string()), ("text", pa.binary()), ("edit", pa.string()), ("summary", _arrow(_SUMMARY))]
    said = rows.select("c", F.lit(1).alias("later"), F.col("__row").alias("at"), "role", F.col("text").cast("binary").alias("text"))
    both = _blocks(small).select("c", F.lit(0).alias("later"), F.col("g").alias("at"), "block").unionByName(said, allowMissingColumns=True)
    both = both.repartition(F.col("c")).sortWithinPartitions(F.col("c").asc_nulls_first(), "later", "at")

    def run(batches):
        for first in batches:
            schema = pa.schema([("conv_id", first.schema.field("c").type), *fields])
            yield from _batches(_repaired(chain([first], batches)), schema)

    return both.mapInArrow(run, f"conv_id {kind}, place long, role string, text binary, edit string, summary {_SUMMARY}")


def repair(turns: DataFrame) -> DataFrame:
    """The repaired turns of (conv_id, turn, role, text): conv_id, place (from 0), role, text, edit (K, R or I)."""
    return _mixed(turns).where("place >= 0").select("conv_id", "place", "role", F.col("text").cast("string").alias("text"), "edit")


def summaries(turns: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    return _mixed(turns).where("place < 0").select("conv_id", "summary.*")


def digest(turns: DataFrame) -> DataFrame:
    """``summaries`` with repaired_sha256, of the repaired ``role:text`` joined by newlines."""
    mixed = _mixed(turns)
    kind = mixed.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for first in batches:
            schema = pa.schema([("conv_id", first.schema.field("conv_id").type), ("summary", first.schema.field("summary").type), ("repaired_sha256", pa.string())])
            yield from _batches(_digests(chain([first], batches)), schema)

    return mixed.mapInArrow(run, f"conv_id {kind}, summary {_SUMMARY}, repaired_sha256 string").select("conv_id", "summary.*", "repaired_sha256")


def _digests(batches):
    for conv, rows in _groups(batches, "conv_id"):
        summary, h = next(rows)["summary"], hashlib.sha256()
        for row in rows:
            h.update((b"\n" if row["place"] else b"") + row["role"].encode() + b":" + row["text"])
        yield {"conv_id": conv, "summary": summary, "repaired_sha256": h.hexdigest()}


def damaged(turns: DataFrame) -> DataFrame:
    """The given turns with faults put in by the checksum of their id and turn: of 20 rows one is lost, one emptied, one
    without full stops, one repeated and one said by the user."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(kind == 4, "user").otherwise(filled("role"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", times.alias("copy")).drop("copy")


def repaired_digest(turns: DataFrame) -> DataFrame:
    """The digest of the damaged turns, with a row for every conversation that was given."""
    made = digest(damaged(turns)).withColumnRenamed("conv_id", "o")
    out = turns.select("conv_id").distinct().join(made, F.col("conv_id").eqNullSafe(F.col("o")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(
        "conv_id", *[zero(c) for c in ("gaps", *_COUNTS, "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    )
