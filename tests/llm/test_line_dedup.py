import random

from terrasift.llm import line_dedup


def brute(rows, k=3):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[d] = (None, 0, 0)
            continue
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - k + 1):
            w = tuple(lines[p : p + k])
            if not "".join(x.strip(" ") for x in w):
                continue
            if w in seen:
                gone.update(range(p, p + k))
            seen.add(w)
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = [(0, None), (1, ""), (2, "\n\n\n\n"), (3, "a\na\na\na\na"), (4, "a\na"), (5, " \n\n \nx\ny\nz\n")]
    rows += [(d, "\n".join(r.choice(["x", "y", "Z é", ""]) for _ in range(r.randint(1, 9)))) for d in range(6, 60)]
    df = spark.createDataFrame([(*x, "keep", 1) for x in rows], "doc_id long, text string, pos string, row int").repartition(4)
    got = {x.doc_id: (x.text, x.line_dedup.n_lines, x.line_dedup.n_removed) for x in line_dedup.dedup(df).collect()}
    assert got == brute(rows)


def test_repeated_rows_null_keys_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "p\nq\nr"), (2, "p\nq\nr\ns")], "doc_id long, text string")
    assert sorted((x.text, x.line_dedup.n_removed) for x in line_dedup.dedup(df).collect()) == [("a\nb\nc", 0), ("a\nb\nc", 0), ("p\nq\nr", 0), ("s", 3)]
    assert line_dedup.dedup(df.limit(0)).count() == 0
