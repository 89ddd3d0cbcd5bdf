"""Extraction behind one interface: deterministic rules by default, any other extractor in its place.

An extractor turns a batch of inputs into answers; calls run in mapInPandas, with validation, bounded attempts and a log
row for each attempt. Nothing here needs a network.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The controlled vocabulary of the three label fields.
CATEGORIES = ("Unstable pre-event conditions", "Triggering Event", "Material Mobilization", "Favourable Topography", "Natural dam failure", "Sediment Surge", "Post-event redistribution", "Impact on permanent or temporary infrastructure", "Positive Impact on permanent or temporary infrastructure", "Changes in geomorphology", "Negative Impact on permanent or temporary infrastructure", "Alteration of channel dynamics", "unknown", "not applicable")
INTERACTIONS = ("Process-process", "Process-topography", "Process-structure", "Feedback", "unknown", "not applicable")
PHASES = ("Erosion", "Transportation", "Deposition", "Dysconnectivity", "unknown", "not applicable")


class Extractor(Protocol):
    def answer(self, texts: list[str], attempt: int) -> list[str | None]: ...


class RuleExtractor:
    """Answers by the first pattern that a text matches, else `unknown`."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = [(re.compile(p, re.I), a) for p, a in rules]

    def answer(self, texts, attempt):
        return [next((a for p, a in self.rules if p.search(t or "")), "unknown") for t in texts]


class GlossaryTranslator:
    """Words of a glossary replaced, the rest as it is."""

    def __init__(self, glossary: dict[str, str]):
        self.glossary = {k.lower(): v for k, v in glossary.items()}
        self.words = re.compile(r"\b(" + "|".join(map(re.escape, sorted(self.glossary, key=len, reverse=True))) + r")\b", re.I) if glossary else None

    def answer(self, texts, attempt):
        return [self.words.sub(lambda m: self.glossary[m[0].lower()], t) if self.words and t else t for t in texts]


PROCESS_RULES = [(r"erosion|erod|abtrag", "Erosion"), (r"deposit|ablager|aggrad", "Deposition"), (r"transport|debris flow|murgang|convey", "Transportation"), (r"block|dam|barrier|sperre", "Dysconnectivity")]

LOG = "key string, attempt int, outcome string, answer string, error string"


def call(df: DataFrame, key: str, text: str, extractor: Extractor, valid: Callable[[str | None], str | None], attempts: int = 3, batch: int = 64) -> DataFrame:
    """Attempt rows (key, attempt, outcome, answer, error). valid returns what is wrong with an answer, or None; what is wrong
    is asked again, up to `attempts` times. Batches keep order and never mix partitions."""

    def run(frames):
        for f in frames:
            rows = []
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                todo = list(zip(part[key].astype(str), part[text], strict=True))
                for n in range(1, attempts + 1):
                    if not todo:
                        break
                    answers, again = extractor.answer([t for _, t in todo], n), []
                    if len(answers) != len(todo):
                        answers = [None] * len(todo)
                    for (k, t), x in zip(todo, answers, strict=True):
                        problem = valid(x)
                        rows.append((k, n, "pass" if problem is None else "invalid", x, problem))
                        if problem is not None:
                            again.append((k, t))
                    todo = again
            yield pd.DataFrame(rows, columns=["key", "attempt", "outcome", "answer", "error"])

    return df.select(key, text).mapInPandas(run, LOG)


def one_of(values: tuple[str, ...]) -> Callable[[str | None], str | None]:
    return lambda x: None if x in values else f"not in the vocabulary: {x}"


def accepted(log: DataFrame) -> DataFrame:
    """key, answer, attempts: the passing attempt of each key; null where none passed."""
    return log.groupBy("key").agg(F.max(F.when(F.col("outcome") == "pass", F.col("answer"))).alias("answer"), F.max("attempt").alias("attempts"))


def resolve_boundaries(found: DataFrame) -> DataFrame:
    """doc, page, title, state of event boundaries found more than once (doc, page, title, confidence): the most confident
    wins, below 0.8 or with conflicting titles it goes to review."""
    key = F.lower(F.trim("title"))
    g = found.groupBy("doc", "page").agg(F.max_by("title", F.struct("confidence", "title")).alias("title"), F.max("confidence").alias("c"), F.countDistinct(key).alias("n"))
    return g.select("doc", "page", "title", F.when((F.col("n") > 1) | (F.col("c") < 0.8), "review").otherwise("accepted").alias("state"))
