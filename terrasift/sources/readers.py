"""Readers: report files to chunks, tables, artifacts, logs, manifests, layers and zip bundles.

Files are listed and opened by Spark (binaryFile, text, csv, json), never by the driver's own file functions, so any store
works. Parsers run inside mapInArrow on the executors.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions.text import SPACES, normalize_text

CHUNK = "chunk_id string, document_id string, filename string, source_type string, page int, paragraph int, table_no int, table_path string, row_no int, cell_no int, text string"
SUFFIXES = ("docx", "pdf", "txt")
#: Fixed value: the namespace of word processing documents.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_FIELDS = [f.split()[0] for f in CHUNK.split(", ")]
_SPACE = re.compile("[" + SPACES + "]+")


def _clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of the folder's report files, not of folders below; none is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{%s}" % ",".join(SUFFIXES)).option("recursiveFileLookup", "false").load(folder)
    files = files.select("path", "length")
    if files.isEmpty():
        raise FileNotFoundError(f"no {', '.join(SUFFIXES)} files in {folder}")
    return files


def docx_blocks(data: bytes) -> list[dict]:
    """Paragraphs and table cells in document order; merged cells once; nested tables by their path."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out: list[dict] = []
    count = {"p": 0, "t": 0}

    def text_of(node) -> str:
        return _clean("".join((n.text or "") if n.tag == f"{_W}t" else " " if n.tag in (f"{_W}tab", f"{_W}br") else "" for n in node.iter()))

    def table(node, path: str) -> None:
        for r, row in enumerate(node.findall(f"{_W}tr"), 1):
            for c, cell in enumerate(row.findall(f"{_W}tc"), 1):
                merged = cell.find(f"{_W}tcPr/{_W}vMerge")
                if merged is not None and merged.get(f"{_W}val") != "restart":
                    continue
                text = " ".join(x for x in (text_of(p) for p in cell.findall(f"{_W}p")) if x)
                if text:
                    out.append({"table_no": int(path.split(".")[0]), "table_path": path, "row_no": r, "cell_no": c, "text": text})
                for k, inner in enumerate(cell.findall(f"{_W}tbl"), 1):
                    table(inner, f"{path}.{r}.{c}.{k}")

    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            count["p"] += 1
            if text := text_of(node):
                out.append({"paragraph": count["p"], "text": text})
        elif node.tag == f"{_W}tbl":
            count["t"] += 1
            table(node, str(count["t"]))
    return out


def pdf_pages(data: bytes) -> list[dict]:
    """One block a page; needs a PDF library, which is optional."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the pypdf package") from e
    pages = ((i, _clean(p.extract_text() or "")) for i, p in enumerate(PdfReader(io.BytesIO(data)).pages, 1))
    return [{"page": i, "text": t} for i, t in pages if t]


def txt_block(data: bytes) -> list[dict]:
    text = _clean(data.decode("utf-8-sig"))
    return [{"text": text}] if text else []


_PARSERS = {"docx": docx_blocks, "pdf": pdf_pages, "txt": txt_block}


def read_reports(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Chunks of all report files of a folder. Ids are the file's name and the block's number; documents without text are an
    error if no document has any."""
    discover(spark, folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{%s}" % ",".join(suffixes)).load(folder).select("path", "content")
    types = {"string": pa.string(), "int": pa.int32()}
    schema = [(n, types[t]) for n, t in (f.split() for f in CHUNK.split(", "))]

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = path.rpartition("/")[2]
                kind = name.rpartition(".")[2].lower()
                rows = [{"chunk_id": f"{name}#{i}", "document_id": name, "filename": name, "source_type": kind, **b} for i, b in enumerate(_PARSERS[kind](content), 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in schema], names=_FIELDS)

    return files.mapInArrow(parse, CHUNK)


def pages_from_chunks(chunks: DataFrame) -> DataFrame:
    """document_id, page_key, pos, text: chunks put together by page (or by themselves where there is none), newline-joined."""
    key = F.coalesce(F.col("page").cast("string"), F.col("chunk_id"))
    order = F.split_part("chunk_id", F.lit("#"), F.lit(-1)).cast("int")
    rows = chunks.select("document_id", key.alias("page_key"), order.alias("pos"), "text")
    grouped = rows.groupBy("document_id", "page_key").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return grouped.select("document_id", "page_key", "pos", F.array_join(F.col("t.text"), "\n").alias("text"))


#: Names of the columns of a segment table, by what their headers contain.
SEGMENT_COLUMNS = {"seg_id": "segment", "event": "event", "process": "process", "category": "categor", "interact": "interact", "phase": "phase"}


def read_segment_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table with a sniffed delimiter; headers are matched by what they contain, further columns go to the map
    `extra`. Values stay as they are, short rows are padded with empty text; repeated ids are an error."""
    head = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    if not head:
        raise ValueError("the table is empty")
    sep = max("\t,;|", key=head[0].value.count)
    raw = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", False).option("quote", '"').csv(path)
    named, rest = {}, []
    for c in raw.columns:
        name = next((k for k, part in SEGMENT_COLUMNS.items() if part in c.lower() and k not in named), None)
        if name:
            named[name] = c
        else:
            rest.append(c)
    if missing := [k for k in ("seg_id", "event", "process") if k not in named]:
        raise ValueError(f"columns missing: {missing}")
    own = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    extra = F.create_map(*(x for c in rest for x in (F.lit(c), own(c)))) if rest else F.create_map().cast("map<string,string>")
    out = raw.select(*((own(named[k]) if k in named else F.lit("")).alias(k) for k in SEGMENT_COLUMNS), extra.alias("extra"))
    again = out.groupBy("seg_id").agg(F.count("*").alias("n")).filter("n > 1").limit(5).collect()
    if again:
        raise ValueError(f"repeated ids: {sorted(r.seg_id for r in again)}")
    return out


def table_events(segments: DataFrame, order: str) -> DataFrame:
    """Distinct events in order of first sight: event, pos."""
    return segments.groupBy("event").agg(F.min(order).alias("pos"))


def choose_event(segments: DataFrame, event: str) -> DataFrame:
    """The rows of one event, whatever its case."""
    return segments.filter(F.lower("event") == event.lower())


def read_glossary(spark: SparkSession, path: str, columns: tuple[str, ...], rows: int | None = None) -> DataFrame:
    """A CSV whose header must be exactly `columns` (a byte order mark aside), of that many rows if given."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    if tuple(df.columns) != tuple(columns):
        raise ValueError(f"columns {df.columns} instead of {list(columns)}")
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{n} rows instead of {rows}")
    return df


TIMING = "ts timestamp, type string, stage string, task string, attempt int, outcome string, error string, elapsed_seconds double, retry_delay_seconds double, correction_round int"


def read_timings(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """An append log of JSON lines; a line that is cut off is skipped, or an error if strict."""
    return spark.read.schema(TIMING).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_artifact(spark: SparkSession, path: str, schema: str, default: list | None = None) -> DataFrame:
    """One JSON artifact; a missing one gives the default rows if there are any."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if default is not None and not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame(default, schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_manifests(spark: SparkSession, root: str, schema: str = "status string, current_stage string, created_at string") -> DataFrame:
    """One row per run folder with a manifest; unreadable ones are left out. Adds run, the folder's name."""
    df = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(f"{root}/*/manifest.json")
    run = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/manifest\\.json$", 1)
    return df.withColumn("run", run).filter("_bad is null").drop("_bad")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Entries of zip bundles: bundle, name, content. Names that lead out of the bundle are an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def entries(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for e in z.infolist():
                        if e.is_dir():
                            continue
                        if e.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", e.filename) or re.match(r"[A-Za-z]:", e.filename):
                            raise ValueError(f"unsafe name in {p}: {e.filename}")
                        yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([e.filename]), pa.array([z.read(e)], pa.binary())], names=["bundle", "name", "content"])

    return files.mapInArrow(entries, "bundle string, name string, content binary")


def import_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent import: incoming rows whose keys aren't there yet."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def first_nonblank(*names: str):
    """The first of the columns that has text."""
    return F.coalesce(*(F.nullif(F.trim(F.col(n)), F.lit("")) for n in names))


def flatten_outline(outline: DataFrame) -> DataFrame:
    """doc, level, title, page, place in preorder. outline: doc, node, parent (null at the top), pos, title, page.

    Levels are joined one after another; an outline is only a few deep.
    """
    roots = outline.filter("parent is null").select("doc", "node", F.lit(1).alias("level"), "title", "page", F.array(F.col("pos").cast("long")).alias("place"))
    out, front = roots, roots
    for _ in range(32):
        kids = outline.alias("o").join(front.alias("f"), (F.col("o.doc") == F.col("f.doc")) & (F.col("o.parent") == F.col("f.node")))
        front = kids.select("o.doc", "o.node", (F.col("f.level") + 1).alias("level"), "o.title", "o.page", F.concat("f.place", F.array(F.col("o.pos").cast("long"))).alias("place"))
        if front.isEmpty():
            break
        out = out.union(front)
    return out.select("doc", "level", "title", "page", "place")


def logo_filter(images: DataFrame, pages: int = 3) -> DataFrame:
    """Images (doc, page, digest, width, height) but for those on that many pages of a document."""
    often = images.groupBy("doc", "digest").agg(F.countDistinct("page").alias("n")).filter(F.col("n") >= pages)
    return images.join(often.select("doc", "digest"), ["doc", "digest"], "left_anti")


def normalized(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, normalize_text(column))
