"""Feature services as Spark data sources: a partition is a range of ids or a page, and its task asks for it.

The driver asks for a number only (how many, and the least and greatest id), never for ids or features. A service that
cuts an answer short is asked again from where it stopped, inside the same task; a lost task asks for its own range again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[dict], dict]
Parse = Callable[[dict], list[tuple]]


@dataclass
class Span(InputPartition):
    """Ids or places from `first` up to, but without, `last`."""

    first: int
    last: int


def ranged(url: str, fetch: Fetch, parse: Parse, where: str, bbox: tuple | None, batch: int, key: str) -> tuple[Callable[[], list[Span]], Callable[[Span], Iterator[tuple]]]:
    """A layer that is asked by conditions: about `batch` ids a task."""
    base = {"url": f"{url}/query", **({"geometry": list(bbox)} if bbox else {})}

    def spans() -> list[Span]:
        told = [{"statisticType": kind, "onStatisticField": key, "outStatisticFieldName": kind} for kind in ("min", "max", "count")]
        about = (fetch({**base, "where": where, "outStatistics": told}).get("features") or [{}])[0].get("attributes") or {}
        if not about.get("count"):
            return []
        low, high, tasks = int(about["min"]), int(about["max"]), -(-int(about["count"]) // batch)
        width = -(-(high - low + 1) // tasks)
        return [Span(a, min(a + width, high + 1)) for a in range(low, high + 1, width)]

    def rows(span: Span) -> Iterator[tuple]:
        own, seen = f"({where}) AND {key} >= {span.first} AND {key} < {span.last}", 0
        while True:
            answer = fetch({**base, "where": own, "outFields": "*", "orderByFields": key, "resultOffset": seen})
            found = answer.get("features", [])
            yield from parse(answer)
            seen += len(found)
            if not found or not answer.get("exceededTransferLimit"):
                return

    return spans, rows


def paged(url: str, layer: str, fetch: Fetch, parse: Parse, bbox: tuple | None, page: int) -> tuple[Callable[[], list[Span]], Callable[[Span], Iterator[tuple]]]:
    """A layer that is asked by places: `page` features a task."""
    base = {"url": url, "request": "GetFeature", "typeNames": layer, **({"bbox": list(bbox)} if bbox else {})}

    def spans() -> list[Span]:
        hits = int(fetch({**base, "resultType": "hits"})["numberMatched"])
        return [Span(k, min(k + page, hits)) for k in range(0, hits, page)]

    def rows(span: Span) -> Iterator[tuple]:
        at = span.first
        while at < span.last:
            answer = fetch({**base, "startIndex": at, "count": span.last - at})
            found = answer.get("features", [])
            yield from parse(answer)
            at += len(found)
            if not found:
                return

    return spans, rows


def load(spark: SparkSession, schema: str, spans: Callable[[], list[Span]], rows: Callable[[Span], Iterator[tuple]]) -> DataFrame:
    """The rows of all spans, through a data source of this call's own name; spans are asked for when the plan is made."""
    found = f"service_{uuid.uuid4().hex}"

    class Reader(DataSourceReader):
        def partitions(self):
            return spans() or [Span(0, 0)]

        def read(self, partition):
            return iter(()) if partition.first == partition.last else rows(partition)

    class Service(DataSource):
        @classmethod
        def name(cls):
            return found

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Service)
    return spark.read.format(found).load()
