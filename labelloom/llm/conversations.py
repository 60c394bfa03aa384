"""Repair the structure of conversations: the cheapest edits that make the roles follow an optional system row and then
user and assistant in turn.

The edits are found by dynamic programming over four states (nothing yet, after system, after user, after assistant), and
no conversation has to be in one place for it:

1. Rows are put in order over the whole table and cut into blocks of ``BLOCK`` places. The rows that a block has of one conversation,
   as codes of a byte each, are a piece.
2. A piece's costs between any two states make a matrix of 16 numbers. One pass from the end over a conversation's matrices stores
   the vector of costs to the end, by state, at the piece borders: the checkpoints.
3. From the checkpoint at its end a piece recomputes its own vectors and walks forward along tight edits, for each state that
   it may be entered in. One pass over the pieces' exit states tells which of them it is.

With blocks of about the square root of a conversation's rows neither of the passes over a conversation holds more than a block does.
"""

from __future__ import annotations

from collections.abc import Iterator
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .base import in_order, staged

#: places of a block, as a power of two
BLOCK_BITS = 12
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SPACES = " \t\n\x0b\x0c\r"

# The contract's costs, and the roles that an edit may give.
COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 1, 2, 5, 5
ROLES = {"s": "system", "u": "user", "a": "assistant"}

_START, _S, _U, _A = range(4)
#: the role that must come next in a state (a system row may come first, too), and the state after it
_NEXT = {_START: ("u", _U), _S: ("u", _U), _U: ("a", _A), _A: ("u", _U)}
_NEVER = 1 << 40
#: costs of ending in a state: roles that are owed are inserted
_END = [0, 2 * COST_INSERT, COST_INSERT, 0]


def _options(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """For each state the (letter, cost, next state) that use up a row, letters ascending."""
    out = []
    for state in range(4):
        kept = [("D", COST_DELETE, state)]
        if fault not in (BLANK, DUPLICATE):
            more = COST_TRUNCATED if fault == TRUNCATED else 0
            role, after = _NEXT[state]
            if initial == role:
                kept.append(("K", more, after))
            elif initial == "s" and state == _START:
                kept.append(("K", more, _S))
            kept.append(("R", COST_REROLE + more, after))
        out.append(kept)
    return out


#: a row's code is a letter: its role's initial (or another) and its fault
INITIALS = "sua-"
OPTIONS = {chr(65 + 4 * i + fault): _options(x, fault) for i, x in enumerate(INITIALS) for fault in range(4)}


def code_of(initial: Column, fault: Column) -> Column:
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(F.lit(65) + kind * 4 + fault)


def _before(options: list, after: list[int]) -> list[int]:
    """Costs to the end before a row, from those after it."""
    v = [min(cost + after[to] for _, cost, to in some) for some in options]
    # inserts lead from START, S and A to U and from U to A
    v[_U] = min(v[_U], COST_INSERT + v[_A], 2 * COST_INSERT + v[_U])
    v[_START], v[_S], v[_A] = (min(v[s], COST_INSERT + v[_U]) for s in (_START, _S, _A))
    v[_U] = min(v[_U], COST_INSERT + v[_A])
    return v


def matrix(codes: str) -> list[int]:
    """The costs of a piece from state i to state j, at 4 i + j; inserts after its last row are not part of it."""
    columns = []
    for j in range(4):
        v = [0 if i == j else _NEVER for i in range(4)]
        for c in reversed(codes):
            v = _before(OPTIONS[c], v)
        columns.append(v)
    return [min(columns[j][i], _NEVER) for i in range(4) for j in range(4)]


def walks(codes: str, after: list[int], last: bool) -> tuple[list[int], list[str]]:
    """For each state at a piece's start the state at its end and the edits, ASCII-least among the cheapest.

    An I or R that gives the assistant's role is written as i or r.
    """
    vectors = [after]
    for c in reversed(codes):
        vectors.append(_before(OPTIONS[c], vectors[-1]))
    vectors.reverse()
    ends, edits = [], []
    for state in range(4):
        out = []
        for c, here, there in zip(codes, vectors, vectors[1:]):
            letter = "I"
            while letter == "I":
                letter, to = _least(OPTIONS[c][state], here, there, state)
                out.append(letter.lower() if state == _U and letter in "IR" else letter)
                state = to
        if last:
            out.append({_S: "Ii", _U: "i"}.get(state, ""))
        ends.append(state)
        edits.append("".join(out))
    return ends, edits


def _least(options: list, here: list[int], there: list[int], state: int) -> tuple[str, int]:
    """The first tight edit in the order of letters: D, I, K, R."""
    after = _NEXT[state][1]
    tight = [(letter, to) for letter, cost, to in options if cost + there[to] == here[state]]
    if COST_INSERT + here[after] == here[state]:
        tight.append(("I", after))
    return min(tight)


def _of(conv: str) -> Column:
    return F.coalesce(F.concat(F.lit("1"), F.col(conv).cast("string")), F.lit("0"))


def _rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """_c, turn, role, text, _place and _code of all rows, in order."""
    d = rows.select(_of(conv).alias("_c"), F.col(turn).cast("bigint").alias("turn"),
                    F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                    F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    trimmed = F.rtrim("text", F.lit(SPACES))
    d = d.withColumn("_same", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    d = d.withColumn("_blank", trimmed == "").withColumn("_cut", ~F.substring(trimmed, -1, 1).isin(".", "!", "?"))
    return in_order(d, "_c", F.col("turn").asc_nulls_first(), "role", "text")


def _coded(rows: DataFrame) -> DataFrame:
    """_c, _place, _code: the rows without their texts."""
    small = rows.select("_c", "_place", "_same", "_blank", "_cut", F.substring("role", 1, 1).alias("_initial"))
    first = small.groupBy("_c", "_same").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    d = small.join(first, ["_c", "_same"], "left")
    fault = F.when(F.col("_blank"), BLANK).when(F.col("_first") < F.col("_place"), DUPLICATE).when(F.col("_cut"), TRUNCATED).otherwise(0)
    return d.select("_c", "_place", code_of(F.col("_initial"), fault).alias("_code"))


def _pieces(coded: DataFrame) -> DataFrame:
    """_c, _first (place), codes and costs of all pieces; a piece has at most a block's rows, at consecutive places."""
    block = F.shiftright("_place", BLOCK_BITS).alias("_block")
    p = coded.groupBy("_c", block).agg(F.min("_place").alias("_first"), F.array_sort(F.collect_list(F.struct("_place", "_code"))).alias("_l"))

    @F.arrow_udf("array<bigint>")
    def costs(codes: pa.Array) -> pa.Array:
        return pa.array([matrix(c) for c in codes.to_pylist()], pa.list_(pa.int64()))

    p = p.select("_c", "_first", F.array_join(F.transform("_l", lambda x: x["_code"]), "").alias("codes"))
    return p.withColumn("costs", costs("codes"))


def _checkpoints(pieces: DataFrame) -> DataFrame:
    """_c, _first, after (costs to the end by state, at the piece's end) and whether it is the conversation's last piece."""
    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, v = None, _END
        for batch in batches:
            out, last = [], []
            for c, m in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                last.append(c != now)
                if c != now:
                    now, v = c, _END
                out.append(v)
                v = [min(m[4 * i + j] + v[j] for j in range(4)) for i in range(4)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64())), pa.array(last, pa.bool_())],
                                  names=["_c", "_first", "after", "last"])

    p = pieces.select("_c", "_first", "costs").repartition("_c").sortWithinPartitions("_c", F.desc("_first"))
    return p.mapInArrow(back, "_c string, _first bigint, after array<bigint>, last boolean")


def _entries(walked: DataFrame) -> DataFrame:
    """_c, _first, entry: the state that a piece is entered in."""
    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, _START
        for batch in batches:
            out = []
            for c, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if c != now:
                    now, state = c, _START
                out.append(state)
                state = ends[state]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=["_c", "_first", "entry"])

    p = walked.select("_c", "_first", "ends").repartition("_c").sortWithinPartitions("_c", "_first")
    return p.mapInArrow(ahead, "_c string, _first bigint, entry int")


def _edits(coded: DataFrame) -> DataFrame:
    """_c, _first, edits of every piece: for each row any inserts before it and its own letter; owed inserts at the very end."""
    pieces = staged(_pieces(coded))
    walked = pieces.select("_c", "_first", "codes").join(_checkpoints(pieces), ["_c", "_first"])

    @F.arrow_udf("struct<ends:array<int>, edits:array<string>>")
    def walk(codes: pa.Array, after: pa.Array, last: pa.Array) -> pa.Array:
        done = [walks(*x) for x in zip(codes.to_pylist(), after.to_pylist(), last.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([d[0] for d in done], pa.list_(pa.int32())),
                                           pa.array([d[1] for d in done], pa.list_(pa.string()))], names=["ends", "edits"])

    walked = staged(walked.select("_c", "_first", walk("codes", "after", "last").alias("_w")).select("_c", "_first", "_w.*"))
    return walked.join(_entries(walked), ["_c", "_first"]).select("_c", "_first", F.get("edits", F.col("entry")).alias("edits"))


def _split(edits: Column) -> Column:
    """The edits of each row of a piece."""
    return F.regexp_extract_all(edits, F.lit("[Ii]*[DKRr](?:[Ii]+$)?"), F.lit(0))


class Repair:
    """The edits for a table of conversations, worked out once; ``repaired`` and ``report`` read them.

    Rows of a conversation are taken by turn (NULL first), then role, then text. A NULL role or text counts as one space; NULL ids
    make one conversation. A row's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in
    the conversation), truncated (the last character that isn't white space is none of ``.!?``). Blank and duplicate rows are
    deleted. An empty table gives empty results; other columns are ignored, whatever their names.
    """

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.conv, self.source = conv, rows
        self.rows = _rows(rows, conv, turn, role, text)
        self.coded = staged(_coded(self.rows))
        self.edits = staged(_edits(self.coded))

    def repaired(self) -> DataFrame:
        """_c, place, nth, turn, role, text, edit: rows that are kept (K), get a new role (R) or are inserted (I: no text, the turn of
        the row that they come with). By (_c, place, nth) they are in order. A conversation's rows are dealt to many tasks.
        """
        per_row = self.edits.select("_first", F.posexplode(_split(F.col("edits"))).alias("_i", "_letters"))
        per_row = per_row.select((F.col("_first") + F.col("_i")).alias("_place"), "_letters")
        d = self.rows.select("_c", "_place", "turn", "role", "text").join(per_row, "_place")
        d = d.select("*", F.posexplode(F.filter(F.split("_letters", ""), lambda x: x != "")).alias("nth", "_x"))
        role = F.when(F.col("_x") == "K", F.col("role")).when(F.col("_x").isin("i", "r"), ROLES["a"]).otherwise(ROLES["u"])
        text = F.when(F.upper("_x") == "I", "").otherwise(F.col("text"))
        return d.filter("_x != 'D'").select("_c", F.col("_place").alias("place"), "nth", "turn", role.alias("role"), text.alias("text"),
                                            F.upper("_x").alias("edit"))

    def report(self, ids: DataFrame | None = None) -> DataFrame:
        """One row per id of the table (or of ``ids``, a table with the same id column): gaps, blank, duplicate, truncated, illegal, cost (bigint), audit and repaired_sha256 (string).

        Gaps: turns missing between the least and the greatest. Illegal: neighbouring rows whose roles' initials are none of su, ua
        and au. A SHA-256 can't be made of parts, so here a conversation's rows pass one task in order; it keeps none of them.
        """
        texts = self.rows.select("_c", "_place", F.lit(1).alias("_kind"), "turn", "role", "text")
        codes = self.coded.select("_c", "_place", F.lit(2).alias("_kind"), F.col("_code").alias("text"))
        edits = self.edits.select("_c", F.col("_first").alias("_place"), F.lit(0).alias("_kind"), F.col("edits").alias("text"))
        lines = texts.unionByName(edits, allowMissingColumns=True).unionByName(codes, allowMissingColumns=True)
        lines = lines.repartition("_c").sortWithinPartitions("_c", "_place", "_kind")
        counts = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
        found = lines.select("_c", "_kind", "turn", "role", "text").mapInArrow(_reports, f"_c string, {counts}")
        ids = (self.source if ids is None else ids).groupBy(_of(self.conv).alias("_c")).agg(F.first(self.conv, True).alias(self.conv))
        d = ids.join(found, "_c", "left")
        zero = {n.split()[0]: F.lit(0).cast("bigint") for n in counts.split(", ")}
        zero |= {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
        return d.select(self.conv, *(F.coalesce(n, v).alias(n) for n, v in zero.items()))


class _Report:
    """The counts and the digest of one conversation, row by row."""

    def __init__(self) -> None:
        self.faults = [0, 0, 0, 0]
        self.illegal = self.cost = self.turns = 0
        self.least = self.turn = self.initial = None
        self.audit: list[str] = []
        self.hash, self.any = hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def row(self, turn: int | None, role: str, text: str, edits: str, fault: int) -> None:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.faults[fault] += 1
        if turn is not None:
            self.turns += turn != self.turn
            self.least, self.turn = turn if self.least is None else self.least, turn
        self.audit.append(edits.upper())
        for x in edits:
            if x == "D":
                self.cost += COST_DELETE
                continue
            if x in "Ii":
                self.cost += COST_INSERT
                self.put(ROLES["a" if x == "i" else "u"], "")
                continue
            self.cost += (COST_TRUNCATED if fault == TRUNCATED else 0) + (COST_REROLE if x in "Rr" else 0)
            self.put(role if x == "K" else ROLES["a" if x == "r" else "u"], text)

    def values(self) -> list:
        gaps = 0 if self.turn is None else self.turn - self.least + 1 - self.turns
        return [gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()]


_REPORT = pa.schema([("_c", pa.string()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation and place: a piece's edits (kind 0) before its first row, each row (1) before its code (2)."""
    now, report, edits, row = None, _Report(), iter(()), ()
    for batch in batches:
        done = []
        for c, kind, turn, role, text in zip(*(x.to_pylist() for x in batch.columns)):
            if c != now:
                if now is not None:
                    done.append([now, *report.values()])
                now, report = c, _Report()
            if kind == 0:
                edits = iter(re.findall(r"[Ii]*[DKRr](?:[Ii]+$)?", text))
            elif kind == 1:
                row = (turn, role, text)
            else:
                report.row(*row, next(edits), (ord(text) - 65) % 4)
        if done:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*done), _REPORT)], schema=_REPORT)
    if now is not None:
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip([now, *report.values()], _REPORT)], schema=_REPORT)
