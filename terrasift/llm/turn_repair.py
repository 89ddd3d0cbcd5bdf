"""Conversation structure repair by weighted finite-state composition.

Three machines are composed: the conversation's rows as an acceptor (one arc a row), an edit transducer (keep, rerole,
delete, insert) and an acceptor of the role grammar ``(s?(ua)+)?``. The weights are pairs (cost, label string) in
lexicographic order, and the repair is the shortest path.

States of the composition, (row, inserts since the last row, grammar state), are made only as they are reached, in
topological order from the last row to the first: a label string may be a prefix of another, so strings keep their order
if a label is put before them, but not if one is put after. A string is its first label and the rank of its rest among
those of the next row, so a row costs the same however long the conversation is.
"""

from __future__ import annotations

import itertools
from functools import cache, lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm.store import keep, small_batches

ROLES = {"u": "user", "a": "assistant"}
#: States: nothing read, after s, after u, after a.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: A cheapest path passes no grammar state twice between two rows, as inserts cost something.
INSERTS = len(GRAMMAR) - 1
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAULTS = ("", "blank", "duplicate", "truncated")
BLANKS = " \t\n\x0b\x0c\r"
_LEGAL = ("su", "ua", "au")
_CHUNK = 8192


@cache
def edits(initial: str, fault: int) -> tuple[tuple[int, str, str], ...]:
    """The edit transducer's arcs over one row: (cost, label, role initial that it leaves, if any)."""
    arcs = [(DELETE, "D", "")]
    if FAULTS[fault] not in ("blank", "duplicate"):
        more = TRUNCATED if FAULTS[fault] == "truncated" else 0
        arcs += [(KEEP + more, "K", initial), *((REROLE + more, "R", r) for r in ROLES)]
    return tuple(arcs)


class _Weight(NamedTuple):
    """Of the best path on from a state; how: number of inserts, label, role initial that the row's edit leaves."""

    cost: int
    string: tuple
    how: tuple


def _with_inserts(best: dict[int, _Weight]) -> dict[int, _Weight]:
    """The best path on from each grammar state where inserts may come first."""
    for _ in range(INSERTS):
        longer = {}
        for q, arcs in enumerate(GRAMMAR):
            for r in ROLES:
                on = best.get(arcs.get(r))
                if on and (q not in longer or (on.cost + INSERT, ("I", on.string)) < longer[q][:2]):
                    longer[q] = _Weight(on.cost + INSERT, ("I", on.string), (on.how[0] + 1, *on.how[1:]))
        best = {q: min((w for w in (best.get(q), longer.get(q)) if w), key=lambda w: w[:2]) for q in best.keys() | longer.keys()}
    return best


def _ranked(best: dict[int, _Weight]) -> tuple[int, tuple, tuple]:
    """The least cost, (cost above it, rank of the string) of each grammar state, and how to go on."""
    least = min(w.cost for w in best.values())
    ranks = {s: i for i, s in enumerate(sorted({w.string for w in best.values()}))}
    return least, tuple((best[q].cost - least, ranks[best[q].string]) if q in best else None for q in range(len(GRAMMAR))), tuple(best[q].how if q in best else None for q in range(len(GRAMMAR)))


@cache
def _end() -> tuple[int, tuple, tuple]:
    return _ranked(_with_inserts({q: _Weight(0, ("",), (0, "", "")) for q in FINAL}))


@lru_cache(1 << 16)
def _row(initial: str, fault: int, after: tuple) -> tuple[int, tuple, tuple]:
    """From the weights behind a row those before it; conversations meet the same few cases again and again."""
    best: dict[int, _Weight] = {}
    for q, arcs in enumerate(GRAMMAR):
        for cost, label, out in edits(initial, fault):
            to = arcs.get(out) if out else q
            if to is not None and after[to]:
                w = _Weight(cost + after[to][0], (label, after[to][1]), (0, label, out))
                if q not in best or w[:2] < best[q][:2]:
                    best[q] = w
    return _ranked(_with_inserts(best))


def shortest_path(rows: list[tuple[str, int]]):
    """(cost, edits) of the cheapest repair of rows (role initial, fault); an edit is (label, role initial left or '').

    Of equally cheap ones that whose labels are least in ASCII order. Edits are an iterator.
    """
    cost, weights, how = _end()
    hows = [how]
    for initial, fault in reversed(rows):
        more, weights, how = _row(initial, fault, weights)
        cost += more
        hows.append(how)

    def path():
        q = 0
        for how in reversed(hows):
            inserts, label, out = how[q]
            for _ in range(inserts):
                [(r, q)] = [(r, to) for r, to in GRAMMAR[q].items() if r in ROLES]
                yield "I", r
            if label:
                q = GRAMMAR[q][out] if out else q
                yield label, out

    return cost + weights[0][0], path()


def numbered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Kept table (conv, pos, turn, role, text, fault) of all rows, in order of turn (nulls first), role, text.

    fault: place in FAULTS of a row's first fault. blank: only white space; duplicate: an earlier row of the conversation
    has the same role and text; truncated: the last character that isn't white space is not one of ``.!?``. Null roles and
    texts are one space each.
    """
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = conversations.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    by_turn = F.asc_nulls_first("turn")
    body = F.rtrim("text", F.lit(BLANKS))
    seen = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(by_turn)) > 1
    fault = F.when(body == "", 1).when(F.col("seen"), 2).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    rows = rows.withColumn("seen", seen).withColumn("fault", fault)
    # Of equal rows the first is the one that isn't seen before.
    pos = F.row_number().over(Window.partitionBy("conv").orderBy(by_turn, "role", "text", "seen")).cast("long") - 1
    return keep(rows.select("conv", pos.alias("pos"), "turn", "role", "text", "fault"))


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _repairs(kind: str):
    """Rows (conv, turn, initial, fault), in order -> the edits of each conversation, and a row without edit that has its report."""
    names = ["conv", "place", "pos", "edit", "role"]
    report = [x.split() for x in REPORT.split(", ")]
    fields = f"conv {kind}, place bigint, pos bigint, edit string, role string, {REPORT}"

    def run(batches):
        types = None

        def rows():
            nonlocal types
            for b in batches:
                types = types or b.schema.field(0).type
                yield from zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)

        def batch(edits, reports):
            n = len(edits) + len(reports)
            some = [*edits, *((*r[:1], None, None, None, None) for r in reports)]
            cols = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), (types, pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            empty = [None] * (n - len(reports))
            cols += [pa.array([*empty, *(r[i + 1] for r in reports)], pa.string() if t == "string" else pa.int64()) for i, (_, t) in enumerate(report)]
            return pa.RecordBatch.from_arrays(cols, names=[*names, *(x for x, _ in report)])

        edits, reports = [], []
        for conv, own in itertools.groupby(rows(), lambda r: r[0]):
            kinds, faults, illegal, turns, low, high, last, initial = [], [0] * len(FAULTS), 0, 0, None, None, None, None
            for _, turn, now, fault in own:
                illegal += initial is not None and initial + now not in _LEGAL
                initial = now
                if turn is not None:
                    turns += turn != last
                    low, high, last = turn if low is None else low, turn, turn
                faults[fault] += 1
                kinds.append((initial if initial in ("s", *ROLES) else "?", fault))
            cost, path = shortest_path(kinds)
            labels, pos = bytearray(), 0
            for place, (label, left) in enumerate(path):
                labels += label.encode()
                edits.append((conv, place, None if label == "I" else pos, label, ROLES[left] if label in "IR" else None))
                pos += label != "I"
                if len(edits) >= _CHUNK:
                    yield batch(edits, [])
                    edits = []
            gaps = 0 if low is None else min(high - low + 1 - turns, 2**63 - 1)
            reports.append((conv, gaps, *faults[1:], illegal, cost, labels.decode()))
            if len(reports) >= _CHUNK:
                yield batch(edits, reports)
                edits, reports = [], []
        if edits or reports:
            yield batch(edits, reports)

    return run, fields


class Repair(NamedTuple):
    #: conv, place, role, text, edit: the turns of the repaired conversations (K, R or I), and the deleted rows (D).
    turns: DataFrame
    #: conv, gaps, blank, duplicate, truncated, illegal, cost, audit: one row per conversation.
    report: DataFrame


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """The cheapest repair of each conversation: what is left starts with at most one system row and alternates user and assistant.

    Costs: keep 0, rerole to user or assistant 1, delete 2 (blank and duplicate rows have to go), insert an empty user or
    assistant row 5; a truncated row that stays 5 more. Ties go to the label string that is least in ASCII order. gaps:
    turns missing between the first and the last (0 if all are null). Null conv ids are one conversation; a role counts by
    its first letter, others than s, u, a fit nowhere; rows alike in turn go by role and text, and repeated rows are
    duplicates. Only the named columns are read, whatever else there is; an empty table gives empty ones.

    A conversation is the unit of work, but only its rows' places, role letters and faults are gathered, never its texts:
    texts of any length are joined to their edits.
    """
    small_batches(conversations)
    rows = numbered(conversations, conv, turn, role, text)
    light = rows.select("conv", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", "pos")
    run, fields = _repairs(dict(rows.dtypes)["conv"])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = keep(light.repartition(n, "conv").sortWithinPartitions("conv", "pos").select("conv", "turn", "initial", "fault").mapInArrow(run, fields))
    # Dealt by row, so that a long conversation's texts are spread over tasks.
    by_row = rows.select(F.col("conv").alias("c"), F.col("pos").alias("p"), F.col("role").alias("was"), "text")
    edits = made.filter("edit is not null").select("conv", "place", "pos", "edit", "role")
    turns = edits.join(by_row, F.col("conv").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")), "left")
    turns = turns.select("conv", "place", F.coalesce("role", "was").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")
    return Repair(turns, made.filter("edit is null").select("conv", *(x.split()[0] for x in REPORT.split(", "))))


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, chosen by crc32 of `conv:turn` modulo 20: 0 is dropped, 1 loses its text, 2 its ``.!?``, 3 comes
    twice, 4 becomes a user's. Nulls (but for the key and the turn themselves) are one space. Columns conv, turn, role, text."""
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), kind.alias("kind")).filter("kind <> 0")
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")
