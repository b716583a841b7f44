"""Files to Markdown: every converter on its own files, and a whole folder from scan to manifest.

A converter is a DataFrame of (path, md) from the files it takes; what none takes, or what comes out empty, has failed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import prose
from corpusloom.operators import chunking, parsers, planning, sheets, sinks, validation
from corpusloom.sources import files


def text_of(content: Column) -> Column:
    """UTF-8 text of a file, without a byte order mark; bytes that are none are replaced."""
    return F.regexp_replace(F.make_valid_utf8(F.coalesce(content, F.lit(b"")).cast("string")), "\\A\ufeff", "")


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("path", text_of(F.col("content")).alias("md"))


def _html(rows: DataFrame) -> DataFrame:
    return rows.select("path", parsers.to_markdown(text_of(F.col("content"))).alias("md"))


def _json(rows: DataFrame) -> DataFrame:
    return rows.select("path", parsers.pretty_json(text_of(F.col("content"))).alias("md"))


def _csv(rows: DataFrame) -> DataFrame:
    """Lines of comma-separated cells as a pipe table; quoted cells keep their commas."""
    lines = F.filter(F.split(text_of(F.col("content")), "\r?\n"), lambda l: F.trim(l) != "")
    cells = lambda l: F.transform(F.split(l, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda c: F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"')))
    return rows.select("path", sheets.markdown_table(F.transform(lines, cells)).alias("md"))


def _email(rows: DataFrame) -> DataFrame:
    heads = [F.concat(F.lit(f"**{label}:** "), F.col(c)) for label, c in (("From", "sender"), ("To", "recipient"), ("Date", "date"))]
    listed = F.when(F.size("attachments") > 0, F.concat(F.lit("\n\n**Attachments:** "), F.array_join("attachments", ", "))).otherwise("")
    return parsers.emails(rows).select("path", F.concat(F.lit("# "), F.col("subject"), F.lit("\n\n"), F.concat_ws("  \n", *heads), F.lit("\n\n"), F.trim("body"), listed).alias("md"))


def _books(rows: DataFrame) -> DataFrame:
    chapters = parsers.book_chapters(rows)
    whole = F.when((F.col("title") != "") & ~F.startswith("md", F.lit("#")), F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("md"))).otherwise(F.col("md"))
    listed = chapters.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chapter", whole.alias("m")))).alias("c"))
    return listed.select("path", F.array_join(F.filter(F.transform("c", lambda x: x["m"]), lambda m: m != ""), "\n\n").alias("md"))


def _scripts(rows: DataFrame) -> DataFrame:
    plain = rows.filter("suffix = '.m'")
    named = F.concat(F.lit("## "), files.name_of(F.col("path")), F.lit("\n\n"), parsers.script_block(text_of(F.col("content"))), F.lit("\n"))
    live = parsers.live_scripts(parsers.script_paragraphs(rows.filter("suffix = '.mlx'")))
    return plain.filter(F.trim(text_of(F.col("content"))) != "").select("path", named.alias("md")).unionByName(live)


def _workbooks(rows: DataFrame) -> DataFrame:
    return sheets.workbook_markdown(sheets.workbook_cells(rows), sheets.workbook_merges(rows)).withColumnRenamed("book", "path")


#: Converter of files.converter() -> function; the others need programs that are not here.
CONVERTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ereader": _books, "script": _scripts, "mind map": lambda rows: parsers.mind_maps(rows), "e-mail": _email, "json": _json, "spreadsheet": _workbooks,
    "html": _html, "csv": _csv, "text": _plain,
}


def routed(rows: DataFrame) -> DataFrame:
    """rows (path, suffix, content) with converter; what the generic one takes is told apart by suffix."""
    route = files.converter(F.col("suffix"), F.lit(False), F.col("suffix") == ".mlx")
    generic = F.when(F.col("suffix").isin(*files.WEB), "html").when(F.col("suffix") == ".csv", "csv").when(F.col("suffix").isin(".txt", ".md", ".xml"), "text").otherwise("generic")
    return rows.withColumn("converter", F.when(route == "generic", generic).otherwise(route))


def converted(rows: DataFrame) -> DataFrame:
    """(path, converter, md, error) of files (path, suffix, content): every file has a row, failed ones with the reason and no text."""
    work = routed(rows)
    done = reduce(DataFrame.unionByName, [convert(work.filter(F.col("converter") == name)).select("path", "md") for name, convert in CONVERTERS.items()])
    met = work.select("path", "converter").join(done, "path", "left")
    error = F.when(~F.col("converter").isin(*CONVERTERS), F.concat(F.lit("no converter for "), F.col("converter"))).when(F.coalesce(F.trim("md"), F.lit("")) == "", "nothing was extracted")
    return met.select("path", "converter", F.when(error.isNull(), F.col("md")).alias("md"), error.alias("error"))


def expanded(listing: DataFrame, scan: DataFrame) -> DataFrame:
    """(path, member, name, suffix, content) of a scan, archives replaced by their members; name is the path, or path/member."""
    held = listing.select("path", "content").join(scan.filter(~F.col("bundle")).select("path", "suffix"), "path")
    members = parsers.unzipped(held.filter(files.explodable(F.col("suffix")))).withColumnRenamed("content", "_inner")
    kept = files.with_members(held.select("path", "suffix"), members.withColumnRenamed("_inner", "content"))
    met = kept.join(held.select("path", "content"), "path").join(members, ["path", "member"], "left")
    name = F.when(F.col("member").isNull(), F.col("path")).otherwise(F.concat_ws("/", "path", "member"))
    return met.select("path", "member", name.alias("name"), "suffix", F.when(F.col("member").isNull(), F.col("content")).otherwise(F.col("_inner")).alias("content"))


def convert_folder(spark: SparkSession, source: str, output: str, force: bool = False, clean: bool = True, chunks: bool = False) -> DataFrame:
    """Convert a folder: scan, open archives, skip what is done, convert, clean, write Markdown, record in the manifest.

    Returns the run's records (source, status, error, output, converter, char_count).  Unchanged files (by checksum) that were
    converted are skipped unless force; a file that fails is recorded and stops nothing.
    """
    where = f"{output.rstrip('/')}/.manifest"
    listing = files.read_folder(spark, source)
    work = expanded(listing, files.scanned(listing, source, output)).withColumn("checksum", files.checksum(F.col("content")))
    outputs = planning.planned_outputs(work.select(files.relative_to(F.col("name"), source).alias("path"), F.col("name").alias("source"))).select("source", "output")
    work = work.join(outputs, work["name"] == outputs["source"]).select("source", "suffix", "content", "checksum", "output")
    before = sinks.manifest(spark, where).select("source", F.col("status").alias("old_status"), F.col("checksum").alias("old_checksum"))
    work = work.join(before, "source", "left")
    done = F.coalesce((F.col("old_status") == "ok") & (F.col("checksum") == F.col("old_checksum")), F.lit(False)) & ~F.lit(force)
    skipped = work.filter(done).select("source", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"), "output", F.lit(None).cast("string").alias("converter"), F.lit(None).cast("long").alias("char_count"))
    todo = work.filter(~done)
    made = converted(todo.select(F.col("source").alias("path"), "suffix", "content")).withColumnRenamed("path", "source")
    made = made.join(todo.select("source", "checksum", "output"), "source")
    if clean:
        made = validation.clean(made, "md").withColumn("md", F.col("out")).drop("out")
    made = made.persist()
    try:
        front = prose.frontmatter_block({"source": F.col("source"), "char_count": F.length("md")})
        texts = made.filter("error is null").select("output", sinks.document_text(front, F.lit(None), F.col("md")).alias("text"))
        sinks.write_files(texts, output, "output").count()
        if chunks:
            cut = sinks.sidecar(chunking.chunks(made.filter("error is null").select(F.xxhash64("source").alias("doc_id"), "md"), "md"))
            named = made.select(F.xxhash64("source").alias("doc_id"), F.regexp_replace("output", r"\.md$", ".chunks.json").alias("path"))
            sinks.write_files(cut.join(named, "doc_id").select("path", F.col("sidecar").alias("text")), output).count()
        records = made.select("source", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error", "output", "converter", F.length("md").cast("long").alias("char_count"), "checksum")
        sinks.record(records, where)
        run = records.drop("checksum").unionByName(skipped).collect()  # a row a file of this run
    finally:
        made.unpersist()
    return spark.createDataFrame(run, "source string, status string, error string, output string, converter string, char_count long")


def validate_folder(spark: SparkSession, output: str) -> DataFrame:
    """(path, rule, severity, detail, line) of all Markdown files below an output folder, in report order; links are checked against its files."""
    listing = files.read_folder(spark, output).withColumn("relative", files.relative_to(F.col("path"), output))
    docs = listing.filter(F.col("path").endswith(".md") & ~validation.skipped_outputs(F.col("relative")))
    rows = docs.select(F.col("relative").alias("doc_id"), text_of(F.col("content")).alias("md"))
    folder = rows.select("doc_id", files.folder_of(F.col("doc_id")).alias("folder"))
    # every file below a document's folder, by its path from there
    assets = folder.join(listing.select(F.col("relative").alias("asset")), F.startswith(F.col("asset"), F.when(F.col("folder") == "", "").otherwise(F.concat(F.col("folder"), F.lit("/")))) & (files.folder_of(F.col("asset")) != F.col("folder")))
    near = assets.select("doc_id", F.expr("substring(asset, if(folder = '', 0, length(folder) + 1) + 1)").alias("target"))
    return validation.in_report_order(validation.findings(rows, near).withColumnRenamed("doc_id", "path"))


def inspect_folder(spark: SparkSession, source: str) -> DataFrame:
    """(kind, files, bytes) of what a folder would convert, with a total (kind null)."""
    listing = files.read_folder(spark, source)
    rows = files.scanned(listing, source).join(listing.select("path", "length"), "path", "left")
    return rows.rollup(files.inspect_kind(F.col("suffix")).alias("kind")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
