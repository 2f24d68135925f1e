"""Repair of the turn structure of conversations by lightest derivations.

What a repair can reach is a set of items: `("row", i)` says that row i is there, `("at", i, state)` that rows before i
are dealt with and the repaired part ends in `state` (nothing, system, user or assistant), `("end", state)` that all are.
Edits are weighted deductions over them, and an agenda pops items in the order of (cost, audit) until the wanted ones
are final (`lightest`). Appending an edit never lowers a value and keeps the order of two values of one item, which is
what makes the first popped value the best one: two audits of one item with the same cost deal with the same rows,
so neither continues the other.

A conversation of any length is cut into segments of bounded size, solved for every state they can be entered in, and
the segments' tables are joined in order. Copies of a row are one entry with a count, and whether a row was seen before
comes from an aggregate, so no task holds a whole conversation. Only the SHA-256 of a repaired conversation is
sequential by nature: its rows stream, sorted, through one task, which holds the audit and no texts.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections import defaultdict
from collections.abc import Callable, Hashable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from epochlens.session import cut, tune

#: Entries of a segment.
SEGMENT = 1_024
#: Costs of the edits, and of leaving a truncated row in place.
RENAME, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5

#: States: nothing yet, or the last role's initial. An order of roles is legal if each step is here and it ends as below.
STATES = "-sua"
STEPS = {"-": "su", "s": "u", "u": "a", "a": "u"}
ENDS = "-a"
ROLES = {"u": "user", "a": "assistant"}

_SPACE = " \t\n\x0b\x0c\r"

Value = tuple[int, str]
Item = Hashable
#: Antecedents, a function from their values to that of the conclusion, and the conclusion.
Deduction = tuple[tuple[Item, ...], Callable[..., Value], Item]


def lightest(axioms: Sequence[tuple[Item, Value]], deductions: Sequence[Deduction], goals: Sequence[Item]) -> dict[Item, Value]:
    """The least value of each goal that can be derived.

    Functions must be superior: never below any of their arguments, and monotone in each. An item is final when it
    is popped; a deduction fires when its last antecedent becomes final.
    """
    uses = defaultdict(list)
    for number, (needs, _, _) in enumerate(deductions):
        for item in needs:
            uses[item].append(number)
    missing = [len(needs) for needs, _, _ in deductions]
    final: dict[Item, Value] = {}
    wanted = set(goals)
    order = 0
    agenda: list[tuple[Value, int, Item]] = []
    for item, value in axioms:
        heapq.heappush(agenda, (value, order, item))
        order += 1
    while agenda and wanted:
        value, _, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        wanted.discard(item)
        for number in uses[item]:
            missing[number] -= 1
            needs, combine, conclusion = deductions[number]
            if not missing[number] and conclusion not in final:
                heapq.heappush(agenda, (combine(*[final[n] for n in needs]), order, conclusion))
                order += 1
    return {g: final[g] for g in goals if g in final}


def _edit(weight: int, letters: str) -> Callable[..., Value]:
    """Append edits; further antecedents (the row that is there) add nothing."""
    return lambda before, *_: (before[0] + weight, before[1] + letters)


def deductions(rows: Sequence[tuple[str, bool, bool, int]]) -> list[Deduction]:
    """All edits of rows (initial of the role, must go, truncated, copies).

    Copies after the first of a row must go. Deletions come before insertions in an audit of least letters, so the
    copies of a row are one step.
    """
    found: list[Deduction] = []
    for i, (initial, must_go, truncated, copies) in enumerate(rows):
        row = ("row", i)
        extra, tail = DELETE * (copies - 1), "D" * (copies - 1)
        for state in STATES:
            here = (("at", i, state), row)
            found.append((here, _edit(DELETE + extra, "D" + tail), ("at", i + 1, state)))
            if must_go:
                continue
            left = CUT_OFF * truncated + extra
            for step in STEPS[state]:
                if step == initial:
                    found.append((here, _edit(left, "K" + tail), ("at", i + 1, step)))
                if step in ROLES:
                    found.append((here, _edit(RENAME + left, "R" + tail), ("at", i + 1, step)))
    for i in range(len(rows) + 1):
        found += [((("at", i, state),), _edit(INSERT, "I"), ("at", i, step)) for state in STATES for step in STEPS[state] if step in ROLES]
    found += [((("at", len(rows), state),), _edit(0, ""), ("end", state)) for state in STATES]
    return found


def solved(rows: Sequence[tuple[str, bool, bool, int]], entries: str) -> dict[tuple[str, str], Value]:
    """The best value from each state of `entries` before the rows to each state after them."""
    steps = deductions(rows)
    there = [(("row", i), (0, "")) for i in range(len(rows))]
    table = {}
    for entry in entries:
        best = lightest([*there, (("at", 0, entry), (0, ""))], steps, [("end", s) for s in STATES])
        table |= {(entry, item[1]): value for item, value in best.items()}
    return table


class Fold:
    """Segments joined in order: the best value of each state so far. Letters that all of them share are set aside,
    so a step costs what the segment costs, not what the conversation does."""

    def __init__(self):
        self.best: dict[str, Value] = {"-": (0, "")}
        self.shared: list[str] = []

    def add(self, table: dict[tuple[str, str], Value]) -> None:
        joined: dict[str, Value] = {}
        for (entry, end), (cost, audit) in table.items():
            if entry in self.best:
                value = (self.best[entry][0] + cost, self.best[entry][1] + audit)
                joined[end] = min(joined.get(end, value), value)
        prefix = os.path.commonprefix([audit for _, audit in joined.values()])
        self.shared.append(prefix)
        self.best = {state: (cost, audit[len(prefix) :]) for state, (cost, audit) in joined.items()}

    def result(self) -> Value:
        cost, audit = min(self.best[s] for s in ENDS if s in self.best)
        return cost, "".join(self.shared) + audit


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that crc32 of `conv_id:turn` deals: of every 20 values, 0
    drops the row (no copies), 1 empties the text, 2 removes its full stops, exclamation and question marks, 3 repeats
    the row, 4 makes the role `user`. Nulls count as one space, but a null id or turn stays null."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    role = F.when(kind == 4, "user").otherwise(shown("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def _digest() -> F.Column:
    return F.unhex(F.sha2("text", 256))


def entries(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, blank, truncated, fresh, copies): the distinct rows of each conversation, without
    texts. `fresh` holds where the first row with this role and text is one of them."""
    core = F.rtrim(F.col("text"), F.lit(_SPACE))
    light = rows.where("copies > 0").select(
        "conv_id", "turn", "role", _digest().alias("digest"), (core == "").alias("blank"), (~F.right(core, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "copies"
    )
    distinct = light.groupBy("conv_id", "turn", "role", "digest", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = distinct.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.min(at).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    return distinct.join(seen, same).select("conv_id", "turn", "role", "digest", "blank", "truncated", F.col("turn").eqNullSafe(F.col("_first.turn")).alias("fresh"), "copies")


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_LEGAL = {"su", "ua", "au"}


def segments(found: DataFrame) -> DataFrame:
    """One row for each segment: counts, first and last turn and initial, and the table of `solved`, as lists.

    Entries are dealt out in ranges of their whole order, so the rows of one conversation spread over tasks.
    """
    kind = found.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, turn bigint, role string, digest binary, low bigint, high bigint, turns bigint, {', '.join(f'{c} bigint' for c in _COUNTS)}, "
        "first string, last string, starts array<string>, ends array<string>, costs array<bigint>, audits array<string>"
    )
    names = [f.split()[0] for f in schema.split(", ")]

    def segment(rows: list[dict], known_start: bool) -> pa.RecordBatch:
        counts = dict.fromkeys(_COUNTS, 0)
        shapes = []
        before = ""
        for r in rows:
            initial, copies = r["role"][:1], r["copies"]
            must_go = r["blank"] or not r["fresh"]
            if r["blank"]:
                counts["blank"] += copies
            else:
                counts["duplicate"] += copies - r["fresh"]
                counts["truncated"] += r["truncated"] and r["fresh"]
            counts["illegal"] += copies - 1 + (before != "" and before[1:] + initial not in _LEGAL)
            before = "." + initial
            shapes.append((initial, must_go, r["truncated"], copies))
        table = solved(shapes, "-" if known_start else STATES)
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        head = rows[0]
        values = [
            head["conv_id"], head["turn"], head["role"], head["digest"], min(turns, default=None), max(turns, default=None), len(set(turns)),
            *counts.values(), head["role"][:1], rows[-1]["role"][:1],
            [k[0] for k in table], [k[1] for k in table], [v[0] for v in table.values()], [v[1] for v in table.values()],
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    strings, longs = pa.list_(pa.string()), pa.list_(pa.int64())
    id_type: list[pa.DataType] = []
    types: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        inside = False  # whether a row of another conversation came before in this task
        continued = False  # whether the conversation of `rows` has an earlier segment here
        for batch in batches:
            if not types:
                id_type.append(batch.schema.field("conv_id").type)
                types.extend([id_type[0], pa.int64(), pa.string(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.string(), strings, strings, longs, strings])
            for r in batch.to_pylist():
                other = bool(rows) and rows[0]["conv_id"] != r["conv_id"]
                if other or len(rows) == SEGMENT:
                    yield segment(rows, inside and not continued)
                    rows, continued, inside = [], not other, inside or other
                rows.append(r)
        if rows:
            yield segment(rows, inside and not continued)

    order = ["conv_id", "turn", "role", "digest"]
    return found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _streamed(conversations: DataFrame) -> DataFrame:
    """The segments of each conversation and then its rows, in order, a conversation in one task."""
    rows = damaged(conversations)
    parts = cut(segments(entries(rows)))
    table = F.struct(*[c for c in parts.columns if c not in ("conv_id", "turn", "role", "digest")])
    heads = parts.select("conv_id", F.lit(0).alias("kind"), "turn", "role", "digest", F.lit(0).alias("copies"), F.lit("").alias("text"), table.alias("part"))
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest().alias("digest"), "copies", "text", F.lit(None).cast(heads.schema["part"].dataType).alias("part"))
    return heads.union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")


class _Conversation:
    """One conversation while its segments and rows go by."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.fold = Fold()
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = self.last = None
        self.turns = 0
        self.cost, self.audit, self.at, self.state = 0, None, 0, "-"
        self.hash, self.kept = hashlib.sha256(), 0

    def segment(self, p: dict) -> None:
        self.fold.add(dict(zip(zip(p["starts"], p["ends"], strict=True), zip(p["costs"], p["audits"], strict=True), strict=True)))
        for c in _COUNTS:
            self.counts[c] += p[c]
        self.counts["illegal"] += self.last is not None and self.last + p["first"] not in _LEGAL
        self.last = p["last"]
        if p["low"] is not None:
            self.turns += p["turns"] - (self.high == p["low"])
            self.low, self.high = p["low"] if self.low is None else self.low, p["high"]

    def edits(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str | None, str | None]]:
        """The edits up to and with those of a row, or with no copies the insertions after the last row: letter, and the
        role and text it leaves."""
        if self.audit is None:
            self.cost, self.audit = self.fold.result()
        rest = not copies
        while copies or (rest and self.at < len(self.audit)):
            letter = self.audit[self.at]
            self.at += 1
            copies -= letter != "I"
            if letter == "D":
                yield letter, None, None
                continue
            self.state = role[:1] if letter == "K" else next(s for s in STEPS[self.state] if s in ROLES)
            left = (role if letter == "K" else ROLES[self.state], "" if letter == "I" else text)
            self.hash.update(("\n" * bool(self.kept) + ":".join(left)).encode("utf-8", "surrogatepass"))
            self.kept += 1
            yield letter, *left

    def summary(self) -> list:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [self.conv_id, gaps, *self.counts.values(), self.cost, self.audit or "", self.hash.hexdigest()]


def _walked(conversations: DataFrame, schema: str, rows: bool) -> DataFrame:
    tune(conversations.sparkSession)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        types: list[pa.DataType] = []

        def done(c: _Conversation) -> list[list]:
            last = [[c.conv_id, i, *e] for i, e in enumerate(c.edits("", "", 0), c.at)]
            return last if rows else [c.summary()]

        def batch_of(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for batch in batches:
            if not types:
                own = batch.schema.field("conv_id").type
                types = [own, pa.int64(), pa.string(), pa.string(), pa.string()] if rows else [own, *[pa.int64()] * 6, pa.string(), pa.string()]
            out: list[list] = []
            for r in batch.to_pylist():
                if now is None or now.conv_id != r["conv_id"]:
                    out += done(now) if now else []
                    now = _Conversation(r["conv_id"])
                if r["kind"] == 0:
                    now.segment(r["part"])
                    continue
                for i, edit in enumerate(now.edits(r["role"], r["text"], r["copies"]) if r["copies"] else (), now.at):
                    if rows:
                        out.append([now.conv_id, i, *edit])
            if out:
                yield batch_of(out)
        if now and (out := done(now)):
            yield batch_of(out)

    return _streamed(conversations).mapInArrow(run, schema)


def repairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conv_id.

    Rows go by turn, null turns first; rows of one turn by role and then by the SHA-256 of their text. A null id is an
    id of its own. A conversation without rows after the damage has zeros, an empty audit and the hash of the empty
    string. Repeated rows are duplicates, texts of any length stream through, an empty table gives no rows, and
    further columns are ignored.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in ("gaps", *_COUNTS, "cost"))
    return _walked(conversations, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string", rows=False)


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): every edit of the repairs in order; role and text are those left, null where
    a row was deleted."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return _walked(conversations, f"conv_id {kind}, place bigint, edit string, role string, text string", rows=True)
