"""Working tables in the folder that all executors share, and joins sized before they are broadcast."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.shared import shared_dir, small_batches  # noqa: F401

#: Rows and bytes (as compressed Parquet; twice as many in memory) up to which a side may be broadcast; beyond them the join
#: is a sort-merge join.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 16 << 20


def keep(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._terrasift_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by keep() that nothing lazy reads any more."""
    for t in tables:
        path = getattr(t, "_terrasift_path", None)
        if path:
            jvm, hadoop = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(hadoop).delete(p, True)


def _built(df: DataFrame) -> tuple[int, int]:
    """Rows of a table, and bytes of them as a broadcast join's hash table holds them."""
    size = F.lit(0).cast("long")
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        size = size + 8
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + 8 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) + 16
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            size = size + F.octet_length(F.to_json(F.struct(c)))
    # A row has a header and a slot in the table besides.
    r = df.agg(F.count("*"), F.coalesce(F.sum(size + 40), F.lit(0))).first()
    return r[0], r[1]


def sized(df: DataFrame) -> DataFrame:
    """A kept table, with a broadcast hint if it is within the bounds: its files, its rows, and what is built from them."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._terrasift_path)
    size = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    if size > BROADCAST_BYTES:
        return df
    rows, built = _built(df)
    if rows > BROADCAST_ROWS or built > 2 * BROADCAST_BYTES:
        return df
    out = F.broadcast(df)
    out._terrasift_path = df._terrasift_path
    return out


def tables_by_key(batches, keys: list[str]):
    """Arrow tables, one per key, of batches that are sorted by the (integer) keys; only one key's rows are gathered."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        at = np.stack([rest.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
        for a, b in zip([0, *cuts[:-1]], cuts, strict=True) if len(cuts) else ():
            yield rest.slice(a, b - a)
        if len(cuts):
            rest = rest.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root with i and j joined: for each place the least one that it reaches."""
    while len(i):
        now = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(now, i, low)
        np.minimum.at(now, j, low)
        np.minimum.at(now, root[i], low)
        np.minimum.at(now, root[j], low)
        now = now[now]
        if (now == root).all():
            return root
        root = now
    return root
