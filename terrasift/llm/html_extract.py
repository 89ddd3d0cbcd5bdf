"""Main text of web pages: leaf blocks labelled by a bidirectional LSTM over the whole page.

Every block is classified with the context of all others of its page, from hashed path and word vectors. The weights
come from terrasift.llm.html_train and are part of the package.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.block_lstm import BlockLabeller
from terrasift.llm.html_blocks import blocks
from terrasift.llm.store import small_batches

_loaded: list[BlockLabeller] = []


def labeller() -> BlockLabeller:
    if not _loaded:
        _loaded.append(BlockLabeller.load())
    return _loaded[0]


def main_texts(pages: list[str | None], threshold: float = 0.0) -> list[list[str]]:
    """The texts of each page's main blocks, in page order."""
    found = [blocks(p) for p in pages]
    return [[b.text for b, s in zip(own, score.tolist(), strict=True) if s > threshold] for own, score in zip(found, labeller().logits(found), strict=True)]


def extract(pages: DataFrame, html: str = "html", threshold: float = 0.0) -> DataFrame:
    """pages with a struct column `main`: text (blocks joined by newlines, empty if there are none), n_blocks.

    Null and empty pages have an empty text. Whole pages are read, of any length. Other columns stay as they are, whatever
    their names; repeated rows get equal results, an empty table an empty one.
    """
    small_batches(pages)
    others = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in pages.columns if c != html))
    docs = pages.select(others.alias("row"), F.col(f"`{html}`").alias("html"))

    def label(batches):
        for batch in batches:
            for x in range(0, batch.num_rows, 128):
                b = batch.slice(x, 128)
                found = main_texts(b.column(1).to_pylist(), threshold)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(["\n".join(t) for t in found], pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["row", "html", "text", "n_blocks"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.mapInArrow(label, f"{fields}, text string, n_blocks bigint")
    return out.select(*(F.col("html").alias(c) if c == html else F.col("row").getField(c).alias(c) for c in pages.columns), F.struct("text", "n_blocks").alias("main"))
