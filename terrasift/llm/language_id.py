"""Language identification by compression: a text's language is the one whose dictionary compresses it best.

For each language a raw-content Zstandard dictionary is made of labelled texts. A text is compressed with each of them,
long texts in parts of ``PART`` characters so that the dictionary, not the text itself, stays what helps; the smallest
total wins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm.store import small_batches

PART, LEVEL = 2000, 6


@dataclass
class Model:
    """Dictionaries by language, the most frequent first (which wins ties)."""

    dictionaries: dict[str, bytes]
    _coders: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "_coders": []}

    def _parts(self, text: str) -> list[bytes]:
        body = " " + text.lower() + " "
        return [body[a : a + PART].encode() for a in range(0, len(body), PART)]

    def gain(self, text: str) -> float:
        """The share by which the best dictionary makes a text smaller than it gets without one: about 0, or less, for a text in a
        language that none of them is of."""
        plain = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        alone = sum(len(plain.compress(p)) - 6 for p in self._parts(text))
        return float(1 - self.sizes(text).min() / max(alone, 1))

    def sizes(self, text: str) -> np.ndarray:
        if not self._coders:
            for d in self.dictionaries.values():
                made = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                made.precompute_compress(level=LEVEL)
                self._coders.append(zstandard.ZstdCompressor(dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False))
        parts = self._parts(text)
        return np.array([sum(len(c.compress(p)) - 6 for p in parts) for c in self._coders], np.float64)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): score is the share by which the second best is larger, 0 for `und`."""
        if not text or not self.dictionaries or not any(c.isalpha() for c in text):
            return "und", 0.0
        s = self.sizes(text)
        best = int(np.argmin(s))
        second = float(np.min(np.delete(s, best))) if len(s) > 1 else 2.0 * float(s[best])
        return list(self.dictionaries)[best], float(min(1.0, max(0.0, 1 - s[best] / max(second, 1.0))))


def held_out(key: str = "doc_id"):
    """Whether crc32 of the key as text is divisible by 5; false for null keys."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, texts: int = 150, chars: int = 1500, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Learn from rows that aren't held out and have text, key and label: a bounded sample of labelled rows.

    The bound: for each language `texts` parts of `chars` characters, chosen by a hash among all parts of about
    2 * `texts` different texts, which are chosen by a hash too; texts count whole, wherever a part stands. Repeated texts
    and parts are taken once, however often they occur. The languages are those that occur as labels, at most 1000 (else
    an error).
    """
    rows = documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).filter(~held_out("k") & F.col("k").isNotNull() & (F.trim("text") != "") & F.col("lang").isNotNull())
    by_text = rows.groupBy("lang", F.xxhash64("text")).agg(F.count("*").alias("n"))
    found = by_text.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).limit(1001).collect()
    counts, different = {r.lang: r.n for r in found}, {r.lang: r.texts for r in found}
    if len(counts) > 1000:
        raise ValueError("more than 1000 languages")
    if not counts:
        return Model({})
    order = sorted(counts, key=lambda x: (-counts[x], x))
    # A text is in the sample if its hash is in the lowest share that holds twice as many different texts as wanted.
    share = F.create_map(*(F.lit(x) for k in order for x in (k, min(1.0, 2 * texts / different[k]))))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.filter(place < share[F.col("lang")]).dropDuplicates(["lang", "text"])
    parts = picked.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{chars}}})"), F.lit(1))).alias("t")).filter(F.trim("t") != "").distinct()
    # Short rests of texts stand behind whole parts, so that what is taken has the most to offer.
    parts = parts.withColumn("whole", F.length("t") >= chars // 2).withColumn("p", F.xxhash64(F.lit(1), "t"))
    first = Window.partitionBy("lang").orderBy(F.desc("whole"), "p", "t")
    sample = parts.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= texts).select("lang", "i", "t").collect()
    chosen: dict[str, list] = {k: [] for k in order}
    for r in sorted(sample, key=lambda r: r.i):
        chosen[r.lang].append(r.t)
    # What stands last is nearest to the text that is compressed; the order within is that of the hash.
    return Model({k: " ".join(t.lower() for t in v).encode() for k, v in chosen.items() if v})


def identify(documents: DataFrame, model: Model, margin: float = 0.0, text: str = "text", gain: float | None = None) -> DataFrame:
    """documents with a struct column `language`: lang (`und` if rejected), score.

    Rejected: null texts, texts without letters, texts whose score is below `margin` and, with `gain`, those that the best
    dictionary gains less for than that share over none (languages that weren't learned). Texts of any length are read whole,
    part by part; ties go to the more frequent language. No other column is read, none is changed whatever its name; repeated rows get equal results, an empty table an empty one.
    """
    small_batches(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    others = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in documents.columns if c != text))
    docs = documents.select(others.alias("row"), F.col(f"`{text}`").alias("text"))

    def predict(batches):
        for batch in batches:
            for x in range(0, batch.num_rows, 1000):
                b = batch.slice(x, 1000)
                got = [shared.value.predict(t) for t in b.column(1).to_pylist()]
                if gain is not None:
                    got = [("und", s) if k != "und" and s >= margin and shared.value.gain(t) < gain else (k, s) for t, (k, s) in zip(b.column(1).to_pylist(), got, strict=True)]
                got = [(k, s) if s >= margin else ("und", s) for k, s in got]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["row", "text", "lang", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.mapInArrow(predict, f"{fields}, lang string, score double")
    return out.select(*(F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in documents.columns), F.struct("lang", "score").alias("language"))
