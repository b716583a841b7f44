"""Sinks: manifests, documents and sidecars as files, caches, histories, run dumps.

Tables are Parquet versions in a folder, one folder a version, so a reader never sees half of a write and a repeated write
changes nothing; documents are files that the executors write through the cluster's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "source string, status string, error string, output string, ocr_backend string, checksum string, duration_ms long, char_count long, mtime double"


def _path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _exists(spark: SparkSession, where: str) -> bool:
    path, system = _path(spark, where)
    return system.exists(path)


def write_text(spark: SparkSession, where: str, text: str, append: bool = False) -> None:
    """A small file written by the driver, through the file system that the path names."""
    path, system = _path(spark, where)
    before = read_text(spark, where) if append and system.exists(path) else ""
    out = system.create(path, True)
    out.write(bytearray((before + text).encode("utf-8")))
    out.close()


def read_text(spark: SparkSession, where: str) -> str:
    rows = spark.read.format("binaryFile").load(where).select("content").collect()  # one small file
    return bytes(rows[0][0]).decode("utf-8") if rows else ""


# -- tables that are replaced


def versions(spark: SparkSession, where: str) -> list[int]:
    """Numbers of a table's complete versions, in order."""
    if not _exists(spark, where):
        return []
    path, system = _path(spark, where)
    found = [s.getPath().getName() for s in system.listStatus(path)]
    done = [n for n in found if n.startswith("v") and n[1:].isdigit() and _exists(spark, f"{where}/{n}/_SUCCESS")]
    return sorted(int(n[1:]) for n in done)


def read_table(spark: SparkSession, where: str, schema: str) -> DataFrame:
    """The latest version; no rows where there is none."""
    numbers = versions(spark, where)
    return spark.read.schema(schema).parquet(f"{where}/v{numbers[-1]}") if numbers else spark.createDataFrame([], schema)


def replace_table(rows: DataFrame, where: str, keep: int = 2) -> None:
    """Write rows as the next version; older versions but the last ones go."""
    spark = rows.sparkSession
    numbers = versions(spark, where)
    rows.write.mode("overwrite").parquet(f"{where}/v{numbers[-1] + 1 if numbers else 1}")
    for old in versions(spark, where)[:-keep]:
        path, system = _path(spark, f"{where}/v{old}")
        system.delete(path, True)


def upsert(new: DataFrame, where: str, key: str, schema: str) -> None:
    """Rows of the table whose key new doesn't have, and new's: of several rows of new with one key the last by all columns."""
    spark = new.sparkSession
    columns = read_table(spark, where, schema).columns
    latest = new.select(*columns).groupBy(key).agg(F.max(F.struct(*[c for c in columns if c != key])).alias("r")).select(key, "r.*").select(*columns)
    replace_table(read_table(spark, where, schema).join(latest.select(key), key, "left_anti").select(*columns).unionByName(latest), where)


def record(new: DataFrame, where: str) -> None:
    """Upsert records (see RECORD; missing fields are null) into a manifest."""
    fields = {f.split(" ")[0]: f.split(" ")[1] for f in RECORD.split(", ")}
    upsert(new.select(*[(F.col(n) if n in new.columns else F.lit(None)).cast(t).alias(n) for n, t in fields.items()]), where, "source", RECORD)


def manifest(spark: SparkSession, where: str) -> DataFrame:
    return read_table(spark, where, RECORD)


def record_json() -> Column:
    """A manifest record as JSON; null fields are left out."""
    return F.to_json(F.struct(*[f.split(" ")[0] for f in RECORD.split(", ")]))


def export_manifest(rows: DataFrame, where: str) -> None:
    """Records as JSON lines, one a file, by source."""
    rows.select(record_json().alias("value")).write.mode("overwrite").text(where)


def import_manifest(spark: SparkSession, where: str) -> DataFrame:
    """Records from JSON lines: unknown keys go, lines that can't be read are left out; no rows where nothing is there."""
    if not _exists(spark, where):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(where).filter("source is not null")


def put_cache(texts: DataFrame, where: str) -> None:
    """Add texts (key, text) to a cache; blank ones are refused, and a key that is there keeps its text."""
    schema = "key string, text string"
    spark = texts.sparkSession
    old = read_table(spark, where, schema)
    fresh = texts.filter(F.trim("text") != "").groupBy("key").agg(F.min("text").alias("text")).join(old.select("key"), "key", "left_anti")
    replace_table(old.unionByName(fresh.select("key", "text")), where)


def cached(spark: SparkSession, where: str) -> DataFrame:
    return read_table(spark, where, "key string, text string")


PRICE = "model string, input_per_mtok double, output_per_mtok double"


def save_price(spark: SparkSession, where: str, model: str, input_per_mtok: float, output_per_mtok: float) -> None:
    if input_per_mtok < 0 or output_per_mtok < 0:
        raise ValueError("prices can't be negative")
    upsert(spark.createDataFrame([(model, float(input_per_mtok), float(output_per_mtok))], PRICE), where, "model", PRICE)


def prices(spark: SparkSession, where: str) -> DataFrame:
    return read_table(spark, where, PRICE)


# -- documents


def document_text(frontmatter: Column, banner: Column, body: Column) -> Column:
    """A Markdown file: frontmatter, the note on a partial conversion if there is one, the body."""
    return F.concat(F.coalesce(frontmatter, F.lit("")), F.lit("\n"), F.when(F.coalesce(banner, F.lit("")) != "", F.concat(banner, F.lit("\n"))).otherwise(""), F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+\z", ""), F.lit("\n"))


def sidecar(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sidecar): the chunks (key, chunk, heading, text, char_count) of each document as JSON, in order."""
    listed = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", "heading", "text", "char_count"))).alias("c"))
    return listed.select(key, F.to_json("c").alias("sidecar"))


def write_files(rows: DataFrame, folder: str, path: str = "path", text: str = "text") -> DataFrame:
    """Write each row's text to folder/path and return (path, bytes) of what was written.

    The executors write through pyarrow's file systems: to a name of its own first, which is then moved, so a task that
    runs twice leaves one whole file.  Paths that leave the folder are refused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import posixpath

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            names, sizes = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where = posixpath.normpath(posixpath.join(root, name or ""))
                if not where.startswith(root.rstrip("/") + "/"):
                    raise ValueError(f"{name} leaves {folder}")
                data = (content or "").encode("utf-8", "surrogatepass")
                system.create_dir(posixpath.dirname(where), recursive=True)
                part = f"{posixpath.dirname(where)}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(data)
                system.move(part, where)
                names.append(name)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return rows.select(F.col(path), F.col(text)).mapInArrow(run, "path string, bytes long")


# -- runs


def write_run(spark: SparkSession, folder: str, stamp: str, summary: dict, stages: list[dict], kept: int = 8) -> str:
    """A run's summary as run-<stamp>.json and latest.json, and a line in index.jsonl with its first stages."""
    name = f"run-{stamp}.json"
    text = json.dumps({"summary": summary, "stages": stages}, indent=2, sort_keys=True)
    write_text(spark, f"{folder}/{name}", text)
    write_text(spark, f"{folder}/latest.json", text)
    write_text(spark, f"{folder}/index.jsonl", json.dumps({"path": name, "summary": summary, "stages": stages[:kept]}, sort_keys=True) + "\n", append=True)
    return name
