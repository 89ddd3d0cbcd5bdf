"""Writers: strict projections, gated exports, append logs, layers, GeoJSON, packages and bundles.

Spark's commit protocol makes each write all or nothing; a manifest that is written last publishes several together.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.functions import geometry as G
from terrasift.functions.text import shape_text

EXPORT = ("segment", "event", "process", "generalized_category", "interaction_type", "sediment_transport_phase")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through the store's own API: a temporary name, then a rename."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, part = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be written")


def write_files(files: DataFrame, folder: str) -> int:
    """Files (name, content binary) of a table, each written by the task that has its row; the number of files. A task that
    runs again writes the same names anew."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = f"{root.rstrip('/')}/{name}"
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(path) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return files.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Exactly these columns, in this order, with a header; a column that isn't there is an error."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def export_final(rows: DataFrame, evaluation: DataFrame, path: str) -> str:
    """Both forms of the final rows under a new version, then the manifest that names it. evaluation: revision, status; the
    newest must have passed."""
    newest = evaluation.orderBy(F.desc("revision")).first()
    if newest is None or newest.status != "pass":
        raise PermissionError("the current revision has not passed its evaluation")
    version = f"{path}/v-{newest.revision}-{uuid.uuid4().hex[:8]}"
    out = rows.select(*EXPORT)
    write_json(out, f"{version}/final_rows.json")
    write_csv(out, f"{version}/final_rows.csv", list(EXPORT))
    write_text(rows.sparkSession, f"{path}/manifest.json", json.dumps({"revision": int(newest.revision), "version": version.rpartition("/")[2]}))
    return version


def append_timing(spark: SparkSession, path: str, **fields) -> None:
    """One line, stamped with the time in UTC, as a new file of the log's folder."""
    row = spark.createDataFrame([(json.dumps(fields),)], "j string")
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in fields.items())
    row.select(F.current_timestamp().alias("ts"), F.from_json("j", schema).alias("f")).select("ts", "f.*").write.mode("append").json(path)


def layer(df: DataFrame, geom: str = "geom", order: str | None = None) -> DataFrame:
    """Rows with a geometry, numbered from 0 as fid_ (dense, by `order`, in one window over ids only), nested columns as JSON."""
    rows = df.filter(F.col(geom).isNotNull() & (F.octet_length(geom) > 9))
    nested = [f.name for f in rows.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    rows = rows.withColumns({c: F.to_json(c) for c in nested})
    order = order or rows.columns[0]
    return numbered(rows, order).withColumnRenamed("_n", "fid_")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Adds _n, dense from 0 in the order of a column, without gathering the rows: range-partitioned, numbered in each
    partition, and shifted by the sizes of the partitions before (one row a partition)."""
    parts = df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id())
    own = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("n")).withColumn("g", F.lit(0)).select("_p", before.alias("_before"))
    return own.join(F.broadcast(sizes), "_p").withColumn("_n", F.col("_before") + F.col("_k")).drop("_p", "_k", "_before")


@F.pandas_udf(T.StringType())
def geojson(geom: pd.Series) -> pd.Series:
    def one(data):
        if data is None:
            return None
        kind, parts = G.from_wkb(data)
        name = {"point": "Point", "line": "LineString", "polygon": "Polygon"}[kind]
        coords = [np.asarray(p).tolist() if kind != "polygon" else [np.asarray(r).tolist() for r in p] for p in parts]
        return json.dumps({"type": name, "coordinates": coords[0]} if len(parts) == 1 else {"type": "Multi" + name, "coordinates": coords})

    return pd.Series([one(x) for x in geom], dtype=object)


def write_geojson(df: DataFrame, path: str, geom: str = "geom") -> None:
    """One feature a line (GeoJSON text sequence), attributes as properties."""
    others = [c for c in df.columns if c != geom]
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*others), {"ignoreNullFields": "false"}), F.lit(',"geometry":'), F.coalesce(geojson(geom), F.lit("null")), F.lit("}"))
    df.select(feature.alias("value")).write.mode("overwrite").text(path)


def shape_table(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Renamed fields, as text of at most 254 bytes where they are text."""
    kinds = dict(df.dtypes)
    return df.select(*((shape_text(c) if kinds[c] == "string" else F.col(c)).alias(n[:10]) for c, n in fields.items()))


def inventory(spark: SparkSession, roles: dict[str, str]) -> DataFrame:
    """role, name, there: registered views against the wanted roles."""
    names = {t.name for t in spark.catalog.listTables()}
    return spark.createDataFrame([(r, n, n in names) for r, n in roles.items()], "role string, name string, there boolean")


def export_package(layers: dict[str, DataFrame], path: str, roles: dict[str, str]) -> None:
    """A folder of Parquet layers and, last, the manifest that makes it a package."""
    if missing := [r for r in ("catchment", "streams", "dem") if r not in roles.values()]:
        raise ValueError(f"roles missing: {missing}")
    for name, df in layers.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    first = next(iter(layers.values()))
    write_text(first.sparkSession, f"{path}/package.json", json.dumps({"layers": [{"name": n, "role": roles.get(n)} for n in layers]}))


def import_package(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The layers of a package by name, registered as views; required roles and unique names are checked."""
    text = "\n".join(r.value for r in spark.read.text(f"{path}/package.json").collect())
    layers = json.loads(text)["layers"]
    names = [x["name"] for x in layers]
    if len(set(names)) != len(names) or (missing := {"catchment", "streams", "dem"} - {x["role"] for x in layers}):
        raise ValueError(f"names repeat or roles are missing: {sorted(missing) if len(set(names)) == len(names) else names}")
    out = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    for n, df in out.items():
        df.createOrReplaceTempView(n)
    return out
