"""Files to raw documents, on the executors; what cannot be read becomes a row of its own kind."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark import schema
from tallymark.functions import text
from tallymark.tables import numbered, settle

PARSED = "source_path string, source_format string, text string, tables array<array<array<string>>>, error string"
GLOB = "*.{docx,xlsx,pdf,DOCX,XLSX,PDF}"
#: Names that a task of a listing hands on at once.
LISTED = 10_000


def parse(name: str, content: bytes | None) -> tuple[str, str, list]:
    """(format, text, tables) of a file; ValueError for other formats and empty files."""
    from tallymark.sources.ooxml import docx, xlsx
    from tallymark.sources.pdf import pdf

    kind = name.rpartition(".")[2].lower()
    if kind not in schema.FORMATS:
        raise ValueError(f"unsupported format: .{kind}")
    if not content:
        raise ValueError("empty file")
    return kind, *{"docx": docx, "xlsx": xlsx, "pdf": pdf}[kind](content)


def _parsed(batches):
    shape = pa.schema([("source_path", pa.string()), ("source_format", pa.string()), ("text", pa.string()), ("tables", pa.list_(pa.list_(pa.list_(pa.string())))), ("error", pa.string())])
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                rows.append((path, *parse(path, content.as_py()), None))
            except Exception as e:  # noqa: BLE001
                rows.append((path, path.rpartition(".")[2].lower(), None, None, f"{type(e).__name__}: {e}"))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], shape.field(i).type) for i in range(5)], schema=shape)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of the documents of a folder, not of those below it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", "false").load(folder)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(name, length, modified) of all documents of a folder, empty ones too, which Spark's readers pass over.

    A listing of a folder is one call of its file system, as it is for Spark's own readers; it is made by a task and gives names only. Files are
    then looked up by as many tasks as there are shuffle partitions, each for its share of the names.
    """
    where = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1)

    def names(batches):
        from pyarrow import fs

        for batch in batches:
            system, base = fs.FileSystem.from_uri(where)
            found = system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if batch.num_rows else []
            kept = [x.base_name for x in found if x.type == fs.FileType.File and x.extension.lower() in schema.FORMATS]
            for i in range(0, max(1, len(kept)), LISTED):
                yield pa.RecordBatch.from_arrays([pa.array(kept[i : i + LISTED], pa.string())], ["name"])

    def looked_up(batches):
        from pyarrow import fs

        for batch in batches:
            system, base = fs.FileSystem.from_uri(where)
            found = system.get_file_info([f"{base}/{name}" for name in batch.column(0).to_pylist()])
            kept = [x for x in found if x.type == fs.FileType.File]  # what was there when it was listed may be gone
            yield pa.RecordBatch.from_arrays([pa.array([x.base_name for x in kept], pa.string()), pa.array([x.size for x in kept], pa.int64()), pa.array([x.mtime for x in kept], pa.timestamp("us", "UTC"))], ["name", "length", "modified"])

    return spark.range(1).mapInArrow(names, "name string").repartition("name").mapInArrow(looked_up, "name string, length bigint, modified timestamp")


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size_kb, modified, type) of a folder's documents, empty ones too; contents are not read."""
    return listed(spark, folder).select("name", text.rounded(F.col("length") / 1024, 1).alias("size_kb"), "modified", F.lower(F.substring_index("name", ".", -1)).alias("type"))


def scan(spark: SparkSession, folder: str, logical: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(RAW, errors) of a folder. RAW is numbered in the order of paths.

    Unreadable files, zero-length ones too, come as (source_path, error). ``logical`` replaces the
    folder in paths, so that ids do not depend on where files happened to lie. A folder that is
    missing or has no documents gives empty tables.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema.RAW), spark.createDataFrame([], "source_path string, error string")
    found = files(spark, folder)
    parsed = settle(found.select("path", "content").mapInArrow(_parsed, PARSED), "scan")
    path = F.col("source_path") if logical is None else F.concat(F.lit(logical.rstrip("/") + "/"), F.regexp_extract("source_path", r"([^/\\]*)$", 1))
    good = parsed.where("error is null").withColumn("source_path", path)
    placed = numbered(good, ["source_path"], "place").withColumn("doc_ord", F.col("place") - 1)
    raw = placed.select(text.content_hash(F.col("text"), F.col("source_path")).alias("doc_id"), "source_path", "source_format", "text", "tables", "doc_ord")
    empty = listed(spark, folder).where("length = 0").select(F.concat(F.lit(folder.rstrip("/") + "/"), "name").alias("source_path"), F.lit("empty file").alias("error"))
    return raw, parsed.where("error is not null").select("source_path", "error").unionByName(empty)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(shipment, name): the documents of a folder by the shipment that their names start with, or "ungrouped"."""
    names = catalogue(spark, folder).select("name")
    return names.select(F.coalesce(text.shipment_prefix(F.col("name")), F.lit("ungrouped")).alias("shipment"), "name")


def pick_shipment(listed: DataFrame, seed: int = 1) -> DataFrame:
    """The documents of one shipment of ``listing``, drawn by a keyed hash."""
    one = listed.select("shipment").distinct().orderBy(F.xxhash64(F.col("shipment"), F.lit(seed)), "shipment").limit(1)
    return listed.join(F.broadcast(one), "shipment", "left_semi")  # one row


def pick_documents(listed: DataFrame, count: int = 3, seed: int = 1) -> DataFrame:
    """So many documents of ``listing``, drawn by a keyed hash; all if there are fewer."""
    if count < 1:
        raise ValueError("at least one document is picked")
    return listed.orderBy(F.xxhash64(F.col("name"), F.lit(seed)), "name").limit(count)


def document(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One document by its file name; names that lead out of the folder raise ValueError."""
    if not name or os.path.basename(name) != name or name in (".", "..") or re.search(r"[\\\0*?\[{]", name):
        raise ValueError(f"not a file name: {name!r}")
    found = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{name}").select("path", "content")
    return found.mapInArrow(_parsed, PARSED)
