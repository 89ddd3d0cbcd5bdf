import random
import re
import zlib

import pytest

from terrasift.llm import queries, turn_repair
from tests.oracle import compare


def cheapest(rows):
    """All edits of rows (initial, fault) that cost no more than to delete all, tried out: least (cost, labels)."""
    best = [(10**9, "")]

    def go(i, roles, cost, labels):
        if cost > min(best[0][0], 2 * len(rows)) or not re.fullmatch("s?(ua)*u?", roles):
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", roles):
                best[0] = min(best[0], (cost, labels))
        else:
            initial, fault = rows[i]
            go(i + 1, roles, cost + 2, labels + "D")
            if fault in (0, 3):
                more = 5 if fault == 3 else 0
                go(i + 1, roles + initial, cost + more, labels + "K")
                for r in "ua":
                    go(i + 1, roles + r, cost + more + 1, labels + "R")
        for r in "ua":
            go(i, roles + r, cost + 5, labels + "I")

    go(0, "", 0, "")
    return best[0]


def test_shortest_path_against_all_edits():
    r = random.Random(4)
    for _ in range(600):
        rows = [(r.choice("suuuaaa?"), r.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(r.randint(0, 7))]
        cost, path = turn_repair.shortest_path(rows)
        assert (cost, "".join(label for label, _ in path)) == cheapest(rows), rows


def test_costs_of_a_row():
    assert turn_repair.edits("u", 3) == ((2, "D", ""), (5, "K", "u"), (6, "R", "u"), (6, "R", "a"))
    assert turn_repair.edits("a", 1) == turn_repair.edits("a", 2) == ((2, "D", ""),)
    # A system row before an assistant is rather made the user than deleted.
    cost, path = turn_repair.shortest_path([("s", 0), ("a", 0), *[("u", 0), ("a", 0)] * 9])
    assert (cost, "".join(x for x, _ in path)) == (1, "R" + "K" * 19)


def test_inserts_against_all_edits(monkeypatch):
    """With dear deletions and reroles inserts are the way; ties between them too."""
    monkeypatch.setattr(turn_repair, "edits", lambda initial, fault: ((90, "D", ""), (0, "K", initial), (60, "R", "u"), (60, "R", "a")))
    turn_repair._row.cache_clear()
    try:
        for rows, want in (("uu", (10, "KIKI")), ("aa", (10, "IKIK")), ("s", (10, "KII")), ("su", (5, "KKI")), ("sa", (5, "KIK")), ("uau", (5, "KKKI")), ("", (0, ""))):
            cost, path = turn_repair.shortest_path([(x, 0) for x in rows])
            assert (cost, "".join(x for x, _ in path)) == want
    finally:
        turn_repair._row.cache_clear()


def test_long_conversation(spark):
    n = 30_000
    rows = [(1, i, ("user", "assistant")[i % 2], f"Said {i}.") for i in range(n)]
    del rows[n // 2]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = turn_repair.repair(df)
    [r] = done.report.collect()
    # One row is missing; the cheapest is to lose its partner too.
    assert (r.gaps, r.illegal, r.cost, len(r.audit), r.audit.count("D")) == (1, 1, 2, n - 1, 1)
    kept = [x.role for x in done.turns.filter("edit <> 'D'").orderBy("place").collect()]
    assert kept == ["user", "assistant"] * (len(kept) // 2)


SCHEMA = "conv_id long, turn long, role string, text string, pos int, fault string, edit string, conv string"


def test_odd_rows(spark):
    """Nulls anywhere, empty and repeated texts, ties of turns, unknown roles, names that clash with those inside."""
    rows = [
        (None, None, None, None), (None, None, None, None), (None, 2, "user", "Hello."), (None, 2, "assistant", "Hi!"),
        (1, 0, "system", "Be kind."), (1, 1, "user", "Why?\n\t "), (1, 1, "user", "Why?\n\t "), (1, 2, "assistant", "x" * 200_000 + "!"),
        (2, 5, "tool", "Result."), (2, 9, "User", "Yes."), (3, 0, "", ""), (4, None, "user", "So."), (4, None, "assistant", "So"), (4, None, "assistant", "So."),
    ]
    df = spark.createDataFrame([(*x, 7, "f", "e", "c") for x in rows], SCHEMA)
    done = turn_repair.repair(df)
    got = {r.conv: tuple(r[1:]) for r in done.report.collect()}
    # Rows of one turn go by role, assistant before user.
    assert got == {None: (0, 2, 0, 0, 2, 6, "DDRR"), 1: (0, 0, 1, 0, 1, 2, "KKDK"), 2: (3, 0, 0, 0, 1, 2, "RR"), 3: (0, 1, 0, 0, 0, 2, "D"), 4: (0, 0, 0, 1, 1, 4, "DRR")}
    turns = {(x.conv, x.place): (x.role, x.text, x.edit) for x in done.turns.collect()}
    assert turns[None, 2] == ("user", "Hi!", "R")
    assert turns[1, 3] == ("assistant", "x" * 200_000 + "!", "K")
    assert turns[2, 0] == ("user", "Result.", "R")
    assert turns[3, 0] == ("", "", "D")


def test_empty_table(spark):
    done = turn_repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert done.report.count() == 0 and done.turns.count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", f"No. {c}, {t}?") for c in range(30) for t in range(8)]
    df = spark.createDataFrame([*rows, (None, None, None, None)], "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in [*rows, (None, None, " ", " ")]:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        want += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    assert sorted(map(tuple, turn_repair.damage(df).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_query_on_odd_tables_against_sql(spark, tmp_path, seed):
    r = random.Random(seed)
    texts = ["Well.", "Well", "", " \n", "Yes!", "No?", "é.", None, "a.b", "..."]
    rows = [(r.choice([None, *range(40)]), r.choice([None, *range(6)]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), r.choice(texts)) for _ in range(260)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "c"))
    next((tmp_path / "c").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    assert compare(spark, str(tmp_path), queries.QUERIES["op13_structure_repair"], queries.ORACLE["op13_structure_repair"]) == ""
