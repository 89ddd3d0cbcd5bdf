"""Line dedup over overlapping windows of three lines.

Every three consecutive lines of a text are a window, known by two 64-bit hashes. The first occurrence of a window (least
key, then least line) stays; the lines of all later ones go, overlapping windows together. Windows are judged on the
input, not on what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.store import keep, sized, small_batches


def later_windows(documents: DataFrame, lines: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, rk, pos) of each window that occurred before; pos counts lines from 0. Windows of only blank lines don't count."""
    body = F.col(f"`{text}`")
    docs = documents.filter(body.isNotNull()).select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(F.col(f"`{key}`"), body).alias("rk"), F.split(body, "\n", -1).alias("lines"))
    docs = docs.filter(F.size("lines") >= lines)

    def window(i):
        own = [F.get("lines", i + k) for k in range(lines)]
        blank = F.concat_ws("", *(F.trim(x) for x in own)) == ""
        return F.when(~blank, F.struct(i.cast("int").alias("pos"), F.xxhash64(F.lit(1), *own).alias("h1"), F.xxhash64(F.lit(2), *own).alias("h2")))

    windows = docs.select("doc_id", "rk", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - lines), window)).alias("w"))
    windows = keep(windows.filter("w is not null").select("doc_id", "rk", "w.*"))
    place = F.struct("doc_id", "rk", "pos")
    # Written before it is joined back, so that the join can be split where a window is frequent.
    several = keep(windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c"))
    return windows.join(several, ["h1", "h2"]).filter(place != F.col("first")).select("doc_id", "rk", "pos")


def dedup(documents: DataFrame, lines: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """documents with later occurrences cut out of `text`, and a struct column `line_dedup`: n_lines, n_removed.

    Null texts have no lines and stay null; an empty text is one empty line; texts of fewer lines than a window are left
    alone, texts of any length are split whole. Rows that are alike in key and text count as one, so neither loses lines to the other. Other columns stay as
    they are, whatever their names; an empty table gives an empty result.
    """
    small_batches(documents)
    later = keep(later_windows(documents, lines, text, key).groupBy("doc_id", "rk").agg(F.collect_set("pos").alias("starts")))
    rk = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))
    others = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in documents.columns if c not in (text, key)))
    docs = documents.select(others.alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), rk.alias("rk"))
    joined = docs.join(sized(later).withColumnsRenamed({"doc_id": "_d", "rk": "_r"}), F.col("key").eqNullSafe(F.col("_d")) & (F.col("rk") == F.col("_r")), "left").select("row", "key", "text", "starts")

    def cut(batches):
        for batch in batches:
            for x in range(0, batch.num_rows, 1000):
                b = batch.slice(x, 1000)
                texts, n_lines, n_removed = [], [], []
                for t, starts in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                    n = 0 if t is None else t.count("\n") + 1
                    gone = np.zeros(n, bool)
                    if starts.is_valid:
                        s = starts.values.to_numpy()
                        for k in range(lines):
                            gone[s + k] = True
                        t = "\n".join(y for y, g in zip(t.split("\n"), gone.tolist(), strict=True) if not g)
                    texts.append(t)
                    n_lines.append(n)
                    n_removed.append(int(gone.sum()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=["row", "key", "text", "n_lines", "n_removed"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    out = joined.mapInArrow(cut, f"row {kinds['row']}, key {kinds['key']}, text string, n_lines bigint, n_removed bigint")
    named = {text: F.col("text"), key: F.col("key")}
    return out.select(*((named[c] if c in named else F.col("row").getField(c)).alias(c) for c in documents.columns), F.struct("n_lines", "n_removed").alias("line_dedup"))
