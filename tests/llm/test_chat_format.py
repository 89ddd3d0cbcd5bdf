import hashlib

from pyspark.sql import functions as F

from terrasift.llm import chat_format as C
from terrasift.llm.queries import QUERIES


def test_parts_placeholders_and_reading_back(spark):
    rows = [
        (1, 0, "user", [("text", "a <turn:user>\n\\l </turn>\n", None, None, None, None, None), ("image", None, "s3://x", 1024, 600, None, None), ("text", "é", None, None, None, None, None)]),
        (1, 1, "assistant", [("text", "\\b<b>", None, None, None, None, None), ("audio", None, "y", None, None, 2.0, None), ("text", "end", None, None, None, None, None)]),
        (1, 2, None, None),
        (1, 3, "assistant", [("document", None, "z", None, None, None, 3), ("odd", "left out", None, None, None, None, None)]),
        (None, 0, "as<s", [("text", None, None, None, None, None, None)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>").repartition(3)
    out = C.format_chat(df)
    got = {r.conv_id: r for r in out.collect()}
    one = got[1]
    assert one.n_turns == 4 and [(a.kind, a.placeholder, a.ref, a.tokens) for a in one.attachments] == [("image", "<image:0.1>", "s3://x", 4 * 170), ("audio", "<audio:1.1>", "y", 50), ("document", "<document:3.0>", "z", 1800)]
    assert "".join(one.formatted[m.start : m.start + m["length"]] for m in one.loss_mask) == "\\bb\\lb\\gend"
    back = {r.conv_id: r for r in C.read_back(out).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", "a <turn:user>\n\\l </turn>\n<image:0.1>é"), ("assistant", "\\b<b><audio:1.1>end"), ("", ""), ("assistant", "<document:3.0>")]
    assert back[1].loss_text == "\\b<b>end" and [(t.role, t.text) for t in back[None].turns] == [("as<s", "")]
    assert C.format_chat(df.limit(0)).count() == 0


def test_query_against_plain_python(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    convs = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    convs[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for k, ts in convs.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        want[k] = (len(ts), sha("".join(f"{r}\n{t}\n" for r, t in ts)), len(loss), sha(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op7_chat_formatting"](spark, sf).collect()}
    assert got == want
    assert QUERIES["op7_chat_formatting"](spark, sf).filter(F.col("formatted_chars") <= 0).count() == 0
