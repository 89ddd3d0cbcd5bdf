"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is a list of parts: struct<kind, text, ref, width, height, seconds, pages>. The visitor takes each part by its
kind: text is escaped; image, audio and document leave an ordered placeholder ``<kind:turn.part>`` and a record of the
attachment with the tokens it expands to. The template is

    <turn:ROLE>\\n BODY </turn>\\n          (without the blanks)

Inside roles and texts, backslash, ``<`` and ``>`` are written ``\\b``, ``\\l`` and ``\\g``. No control string can then
occur in them, whatever they say, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
CLOSE = "</turn>\n"
#: Tokens: characters of text to one, tiles of images in pixels and tokens each, tokens a second of audio and a page.
CHARS_A_TOKEN, TILE, TILE_TOKENS, AUDIO_TOKENS, PAGE_TOKENS = 4, 512, 170, 25, 600


def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))


def escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    for plain, code in (("<", "\\l"), (">", "\\g"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _tokens(p: Column) -> Column:
    tiles = F.greatest(F.lit(1), F.ceil(F.coalesce(p.width, F.lit(1)) / TILE)) * F.greatest(F.lit(1), F.ceil(F.coalesce(p.height, F.lit(1)) / TILE))
    return (
        F.when(p.kind == "text", F.ceil(F.length(F.coalesce(p.text, F.lit(""))) / CHARS_A_TOKEN))
        .when(p.kind == "image", tiles * TILE_TOKENS)
        .when(p.kind == "audio", F.ceil(F.coalesce(p.seconds, F.lit(0.0)) * AUDIO_TOKENS))
        .when(p.kind == "document", F.greatest(F.lit(1), F.coalesce(p.pages, F.lit(1))) * PAGE_TOKENS)
        .otherwise(0)
        .cast("long")
    )


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, loss_mask, attachments, n_tokens.

    loss_mask: array<struct<turn, offset, start, length>>, the characters of `formatted` that are assistant text (offset
    counts from the turn's begin and start from that of `formatted`, both from 0; an assistant's placeholders lie outside). attachments: array<struct<turn, part, kind, placeholder, ref,
    tokens>> in order. turn and part count from 0 in order of rows. Rows are ordered by turn (nulls first); ties by role, then
    parts; repeated rows are turns of their own. Null texts and roles are empty, a null list of parts has none, parts of
    other kinds are left out. A null conv_id is a conversation of its own. Texts of any
    length are kept whole; only the named columns are read, whatever else there is. An empty table gives an empty result.
    """
    t = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.filter(F.coalesce(F.col(f"`{parts}`"), F.array().cast(f"array<{PART}>")), lambda p: p.kind.isin("text", "image", "audio", "document")).alias("parts"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    t = t.withColumn("i", F.row_number().over(order) - 1)
    place = lambda k: F.concat(F.lit("."), k.cast("string"), F.lit(">"))
    piece = lambda p, k: F.when(p.kind == "text", escape(p.text)).otherwise(F.concat(F.lit("<"), p.kind, F.lit(":"), F.col("i").cast("string"), place(k)))
    t = t.withColumn("pieces", F.transform("parts", piece))
    t = t.withColumn("head", F.concat(F.lit("<turn:"), escape(F.col("role")), F.lit(">\n")))
    t = t.withColumn("formatted", F.concat("head", F.array_join("pieces", ""), F.lit(CLOSE)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("begin", F.coalesce(F.sum(F.length("formatted")).over(before), F.lit(0)))
    # Ends of the pieces within the turn, as running sums.
    ends = F.aggregate("pieces", F.array(F.length("head").cast("int")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
    t = t.withColumn("ends", ends)
    spans = F.filter(F.transform("parts", lambda p, k: F.struct(F.col("i").alias("turn"), F.col("ends")[k].alias("offset"), (F.col("begin") + F.col("ends")[k]).alias("start"), (F.col("ends")[k + 1] - F.col("ends")[k]).alias("length"), (p.kind == "text").alias("text"))), lambda s: s.text)
    t = t.withColumn("mask", F.when(F.col("role") == "assistant", F.transform(spans, lambda s: F.struct(s.turn.alias("turn"), s.offset.alias("offset"), s.start.alias("start"), s["length"].alias("length")))))
    files = F.filter(F.transform("parts", lambda p, k: F.struct(F.col("i").alias("turn"), k.alias("part"), p.kind.alias("kind"), F.col("pieces")[k].alias("placeholder"), p.ref.alias("ref"), _tokens(p).alias("tokens"))), lambda f: f.kind != "text")
    t = t.withColumn("files", files).withColumn("tokens", F.aggregate(F.transform("parts", _tokens), F.lit(0).cast("long"), lambda a, x: a + x))
    rows = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "formatted", "mask", "files"))).alias("rows"), F.sum("tokens").alias("n_tokens"), F.count("*").alias("n_turns"))
    return rows.select(
        "conv_id",
        F.array_join(F.col("rows.formatted"), "").alias("formatted"),
        "n_turns",
        F.flatten(F.filter(F.col("rows.mask"), lambda m: m.isNotNull())).alias("loss_mask"),
        F.flatten(F.col("rows.files")).alias("attachments"),
        "n_tokens",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>> and loss_text, from `formatted` and `loss_mask` alone.

    Texts are unescaped; placeholders in them stay as they are. loss_text is all text under the mask, in order.
    """
    split = F.split("formatted", CLOSE)
    df = formatted.withColumn("_turns", F.slice(split, 1, F.size(split) - 1))
    head = lambda x: F.instr(x, F.lit(">\n"))
    role = lambda x: unescape(F.substr(x, F.lit(7), head(x) - 7))
    body = lambda x: unescape(F.substr(x, head(x) + 2))
    masked = lambda m: unescape(F.substr(F.col("_turns")[m.turn.cast("int")], m.offset + 1, m["length"]))
    return df.select("conv_id", *[c for c in formatted.columns if c not in ("conv_id", "formatted", "loss_mask", "turns", "loss_text")], F.transform("_turns", lambda x: F.struct(role(x).alias("role"), body(x).alias("text"))).alias("turns"), F.array_join(F.transform("loss_mask", masked), "").alias("loss_text"))
