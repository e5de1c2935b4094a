"""Repair of conversation structure at the least cost (operator 12).

A conversation's role initials shall read `(s?(ua)+)?`. Its rows are kept (0), get the role user or
assistant (1), or are deleted (2); rows with an empty text may be inserted anywhere (5). Blank and
duplicate rows must go, and a truncated row that stays costs 5 more. Of the cheapest ways the one whose
edits' initials are least in ASCII order is taken.

The grammar is an automaton of four states. Rows are numbered over the whole table, and a
conversation is cut where its numbers pass a multiple of CHUNK, so that a task's share is bounded
whatever a conversation's length. Chunks are dealt by hash into batches; in each batch one recursive
query in DuckDB advances one turn of all its chunks at a time and keeps, for each state at a chunk's
start and each state reached, the least cost and audit. A conversation's chunks are then put together
in order, a row each. Equal rows of a turn travel as one row with a count. What remains sequential is
what the result asks for: the text of a repaired conversation is hashed as a stream, in order.

Edge cases: a null role or text counts as one space; rows go by turn, nulls first, equal turns by role
and then text (its first 48 characters, then its md5); a null conversation id is a conversation of its
own; an empty role has no initial, so that it may be kept anywhere; other roles go by their first
character; a conversation whose rows all go has an empty repaired text; an empty table gives an empty
result; columns beyond those named are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedforge.llm.common import checkpoint
from feedforge.operators.order import numbered

#: Rows that a chunk of a conversation has at most.
CHUNK = 256
#: Rows of a batch, about.
BATCH_ROWS = 8192

_BLANK = " \t\n\x0b\x0c\r"

#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the grammar: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
#: Classes of initials ('' is a role without one, '?' any other), and of faults.
INITIALS = ["s", "u", "a", "", "?"]
SOUND, MUST_GO, CUT = range(3)


def _after_inserts(state: int) -> list[tuple[int, str, int]]:
    """(state, edits, cost) after no, one or two inserted rows; more than two in a row are never cheapest."""
    out = [(state, "", 0)]
    for _ in range(2):
        at, edits, cost = out[-1]
        out.append((STEPS.get((at, "u"), STEPS.get((at, "a"))), edits + "I", cost + INSERT))
    return out


def moves() -> list[tuple[int, int, int, int, str]]:
    """(kind of a row, state, next state, cost, edits): the best way between two states over one row.

    A kind is 3 * the class of the initial + the fault. Edits end in the row's own, so none begins another.
    """
    best: dict[tuple[int, int, int], tuple[int, str]] = {}
    for k, initial in enumerate(INITIALS):
        for fault in (SOUND, MUST_GO, CUT):
            for state in range(4):
                for at, edits, cost in _after_inserts(state):
                    ways = [(at, DELETE, "D")]
                    if fault != MUST_GO:
                        extra = TRUNCATED if fault == CUT else 0
                        kept = at if initial == "" else STEPS.get((at, initial))
                        ways += [(kept, extra, "K")] if kept is not None else []
                        ways += [(STEPS[at, r], REROLE + extra, "R") for r in "ua" if (at, r) in STEPS]
                    for to, more, edit in ways:
                        key, new = (3 * k + fault, state, to), (cost + more, edits + edit)
                        best[key] = min(best.get(key, new), new)
    return [(*key, *value) for key, value in sorted(best.items())]


#: A turn of all chunks a step; a row's further copies are duplicates and go.
WALK = f"""
with recursive walk as (
  select chunk, state as start, state, 0 as i, {{'cost': 0::bigint, 'audit': ''}} as best from chunks, range(4) s(state) where not opens or state = {START}
  union all
  select w.chunk, w.start, m.target, w.i + 1, min({{'cost': w.best.cost + m.cost + {DELETE} * (t.copies - 1), 'audit': w.best.audit || m.edits || repeat('D', t.copies - 1)}})
  from walk w join turns t on t.chunk = w.chunk and t.i = w.i + 1 join moves m on m.kind = t.kind and m.state = w.state
  group by w.chunk, w.start, m.target, w.i
)
select chunk, start, state, best.cost as cost, best.audit as audit from walk join chunks using (chunk) where i = size order by chunk
"""

_PATHS = pa.list_(pa.struct([("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _walk(table: pa.Table, conv_type: pa.DataType) -> pa.Table:
    """A row for each chunk of the batch: counts, what its ends are, and its best way between any two states."""
    table = table.combine_chunks().sort_by("pos")
    col = lambda n: table.column(n).to_numpy(zero_copy_only=False)
    start = np.flatnonzero(np.concatenate(([True], (col("block")[1:] != col("block")[:-1]) | (col("first")[1:] != col("first")[:-1]))))
    size = np.diff(np.append(start, table.num_rows))
    chunk = np.repeat(np.arange(len(start)), size)
    initial, copies, blank, dup, cut = col("initial"), col("copies"), col("blank"), col("seen"), col("cut")
    gone = blank | dup
    fault = np.where(gone, MUST_GO, np.where(cut, CUT, SOUND))
    turns = pa.table({"chunk": chunk, "i": np.arange(len(chunk)) - start[chunk] + 1, "kind": 3 * initial + fault, "copies": copies})
    opens = col("pos")[start] == col("first")[start]
    chunks = pa.table({"chunk": np.arange(len(start)), "size": size, "opens": opens})
    table_of_moves = pa.table(dict(zip(("kind", "state", "target", "cost", "edits"), zip(*moves(), strict=True), strict=True)))
    with duckdb.connect(config={"threads": 1}) as db:
        for name, t in (("turns", turns), ("chunks", chunks), ("moves", table_of_moves)):
            db.register(name, t)
        ways = db.sql(WALK).to_arrow_table().combine_chunks()
    name = np.array(INITIALS, object)[initial]
    ill = np.array([0, *(not legal(a, b) for a, b in zip(name[:-1], name[1:], strict=True))])
    ill[start] = 0
    turn = table.column("turn").to_pylist()
    new = np.array([t is not None and (k == 0 or t != turn[k - 1]) for k, t in enumerate(turn)])
    new[start] = [turn[k] is not None for k in start.tolist()]
    sums = {
        "blank": np.where(blank, copies, 0), "duplicate": np.where(blank, 0, np.where(dup, copies, copies - 1)), "truncated": ~gone & cut,
        "illegal": ill + copies - 1, "turns": new,
    }
    at = np.searchsorted(ways.column("chunk").to_numpy(), np.arange(len(start) + 1))
    fields = [ways.column(n).combine_chunks() for n in ("start", "state", "cost", "audit")]
    paths = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([f.cast(t.type) for f, t in zip(fields, _PATHS.value_type, strict=True)], names=["start", "state", "cost", "audit"]))
    last = start + size - 1
    known = [[t for t in turn[a : b + 1] if t is not None] for a, b in zip(start.tolist(), last.tolist(), strict=True)]
    return pa.table({
        "conv": table.column("conv").take(pa.array(start)).cast(conv_type), "at": pa.array(col("pos")[start], pa.int64()),
        **{n: pa.array(np.add.reduceat(v.astype(np.int64), start), pa.int64()) for n, v in sums.items()},
        "head": pa.array(name[start].tolist()), "tail": pa.array(name[last].tolist()),
        "low": pa.array([k[0] if k else None for k in known], pa.int64()), "high": pa.array([k[-1] if k else None for k in known], pa.int64()), "paths": paths,
    })


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's chunks, in order, put together: each chunk's edits, and the first chunk's row has the counts of all."""
    schema: pa.Schema | None = None

    def finish(conv: object, chunks: list[dict], ways: dict) -> pa.RecordBatch:
        ends = []
        for state, (cost, audit, back) in ways.items():
            at, edits, more = next(x for x in _after_inserts(state) if x[0] in ENDS)
            ends.append((cost + more, audit + edits, edits, back))
        cost, audit, tail, back = min(ends, key=lambda e: e[:2])
        pieces = []
        while back is not None:
            piece, back = back
            pieces.append(piece)
        pieces = pieces[::-1]
        pieces[-1] += tail
        sums = {n: sum(c[n] for c in chunks) for n in _COUNTS}
        for a, b in zip(chunks[:-1], chunks[1:], strict=True):
            sums["illegal"] += not legal(a["tail"], b["head"])
            sums["turns"] -= b["low"] is not None and a["high"] == b["low"]
        lows, highs = ([c[n] for c in chunks if c[n] is not None] for n in ("low", "high"))
        gaps = max(highs) - min(lows) + 1 - sums.pop("turns") if lows else 0
        facts = {"gaps": gaps, **sums, "cost": cost, "audit": audit}
        rows = [{"conv": conv, "at": c["at"], "piece": p, "facts": None if k else facts} for k, (c, p) in enumerate(zip(chunks, pieces, strict=True))]
        return pa.RecordBatch.from_pylist(rows, schema)

    now, chunks, ways = None, [], {}
    for batch in batches:
        schema = schema or pa.schema([batch.schema.field("conv"), ("at", pa.int64()), ("piece", pa.string()), ("facts", _FACTS)])
        for row in batch.to_pylist():
            if chunks and row["conv"] != now:
                yield finish(now, chunks, ways)
                chunks = []
            if not chunks:
                now, ways = row["conv"], {START: (0, "", None)}
            after: dict[int, tuple] = {}
            for p in row.pop("paths"):
                if p["start"] in ways:
                    cost, audit, back = ways[p["start"]]
                    new = (cost + p["cost"], audit + p["audit"], (p["audit"], back))
                    if p["state"] not in after or new[:2] < after[p["state"]][:2]:
                        after[p["state"]] = new
            ways = after
            chunks.append(row)
    if chunks:
        yield finish(now, chunks, ways)


_FACTS = pa.struct([(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
_FACTS_SQL = "struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string>"
_NONE = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": ""}


class _Reader:
    """Applies a conversation's edits to its rows as they come."""

    def __init__(self) -> None:
        self.state, self.edits, self.next = START, "", 0

    def _to(self, role: str) -> None:
        self.state = STEPS.get((self.state, role[:1]), self.state)

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.next < len(self.edits) and self.edits[self.next] == "I":
            role = "assistant" if self.state == USER else "user"
            self._to(role)
            self.next += 1
            yield role, "", "I"

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str, str]]:
        """(role, text, edit) of the rows that stand where this one did, deleted ones aside."""
        yield from self.inserted()
        edit = self.edits[self.next]
        self.next += copies
        if edit != "D":
            role = role if edit == "K" else "assistant" if self.state == USER else "user"
            self._to(role)
            yield role, text, edit


def _repaired(batches: Iterator[pa.RecordBatch], rows: bool) -> Iterator[pa.RecordBatch]:
    """Streams sorted rows: each conversation's id, then for each chunk its edits and its turns."""
    reader, facts, now, digest, lines, seen, schema = _Reader(), _NONE, None, hashlib.sha256(), 0, False, None
    out: list[dict] = []

    def put(parts: Iterator[tuple[str, str, str]]) -> None:
        nonlocal lines
        for role, text, edit in parts:
            if rows:
                out.append({"conv": now, "place": lines, "role": role, "text": text, "edit": edit})
            else:
                digest.update(("\n" * (lines > 0) + f"{role}:{text}").encode())
            lines += 1

    def close() -> None:
        put(reader.inserted())
        if seen and not rows:
            out.append({"conv": now, **facts, "repaired_sha256": digest.hexdigest()})

    for batch in batches:
        given = [("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())] if rows else [*_FACTS, ("repaired_sha256", pa.string())]
        schema = pa.schema([batch.schema.field("conv"), *given])
        for conv, kind, role, text, copies, piece, new in zip(*(batch.column(n).to_pylist() for n in ("conv", "kind", "role", "text", "copies", "piece", "facts")), strict=True):
            if kind == 0:
                close()
                reader, facts, now, digest, lines, seen = _Reader(), _NONE, conv, hashlib.sha256(), 0, True
            elif kind == 1:
                put(reader.inserted())
                reader.edits, reader.next, facts = piece, 0, new or facts
            else:
                put(reader.row(role, text, copies))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows after damage, with times: how often each stands there, 0 for one that is dropped.

    A checksum of conversation and turn picks one in 20 to drop, empty, rob of its marks, repeat or give to the user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    pick = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    new_text = F.when(pick == 1, F.lit("")).when(pick == 2, F.translate(space(text), ".!?", "")).otherwise(space(text))
    times = F.when(pick == 3, 2).when(pick == 0, 0).otherwise(1)
    return turns.select(conv, turn, F.when(pick == 4, F.lit("user")).otherwise(space(role)).alias(role), new_text.alias(text), times.alias("times"))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: Column | None = None, rows: bool = False, chunk: int = CHUNK) -> DataFrame:
    """A row for each conversation: gaps, faults, cost, audit and a digest of its repaired rows.

    rows: the repaired rows themselves instead, as conversation, place, role, text and edit. times: how
    often each row stands in its conversation, 0 for rows that don't count but whose conversation does.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), (F.lit(1) if times is None else times).cast("long").alias("copies"))
    grouped = named.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    all_rows = checkpoint(grouped.withColumn("said", F.md5(F.concat("role", F.lit("\0"), "text"))))
    ids = all_rows.select("conv").distinct()
    order = F.struct("conv", "turn", "role", F.left("text", F.lit(48)), "said")
    placed = checkpoint(numbered(all_rows.filter("copies > 0"), order, "pos"))
    conv_type = dict(placed.dtypes)["conv"]

    last = F.right(F.rtrim("text", F.lit(_BLANK)), F.lit(1))
    letter = F.left("role", F.lit(1))
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS[:4])), letter) - 1, F.lit(-1))
    light = placed.select("conv", "turn", "pos", "said", "copies", F.when(initial < 0, INITIALS.index("?")).otherwise(initial).cast("int").alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    # the earliest of rows that say the same; positions follow the turns
    earliest = light.groupBy("conv", "said").agg(F.min("pos").alias("once"))
    firsts = light.groupBy("conv").agg(F.min("pos").alias("first"))
    key = lambda a, b: a.eqNullSafe(b)
    e, f = earliest.withColumnsRenamed({"conv": "c1", "said": "s1"}), firsts.withColumnRenamed("conv", "c2")
    known = light.join(e, (light["said"] == e["s1"]) & key(light["conv"], e["c1"])).join(f, key(light["conv"], f["c2"]))
    known = known.select("conv", "turn", "pos", "copies", "initial", "blank", "cut", (F.col("pos") > F.col("once")).alias("seen"), "first", F.expr(f"pos div {chunk}").alias("block"))
    n = -(-max(placed.count(), 1) // BATCH_ROWS)
    dealt = known.withColumn("batch", F.pmod(F.xxhash64("conv", "block"), F.lit(n)).cast("int"))
    counts = ", ".join(f"{c} long" for c in _COUNTS)

    def walk(table: pa.Table) -> pa.Table:
        return _walk(table, table.schema.field("conv").type)

    chunks = dealt.groupBy("batch").applyInArrow(walk, f"conv {conv_type}, at long, {counts}, head string, tail string, low long, high long, paths array<struct<start:int,state:int,cost:bigint,audit:string>>")
    ordered = chunks.repartition("conv").sortWithinPartitions("conv", "at")
    edits = ordered.mapInArrow(_fold, f"conv {conv_type}, at long, piece string, facts {_FACTS_SQL}")

    none = lambda t: F.lit(None).cast(t)
    parts = [
        ids.select("conv", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("kind"), none("string").alias("role"), none("string").alias("text"), none("long").alias("copies"), none("string").alias("piece"), none(_FACTS_SQL).alias("facts")),
        edits.select("conv", "at", F.lit(1).alias("kind"), none("string").alias("role"), none("string").alias("text"), none("long").alias("copies"), "piece", "facts"),
        placed.select("conv", F.col("pos").alias("at"), F.lit(2).alias("kind"), "role", "text", "copies", none("string").alias("piece"), none(_FACTS_SQL).alias("facts")),
    ]
    stream = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition("conv").sortWithinPartitions("conv", "at", "kind")
    if rows:
        return stream.mapInArrow(lambda b: _repaired(b, True), f"conv {conv_type}, place long, role string, text string, edit string").withColumnRenamed("conv", conv)
    schema = f"conv {conv_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return stream.mapInArrow(lambda b: _repaired(b, False), schema).withColumnRenamed("conv", conv)
