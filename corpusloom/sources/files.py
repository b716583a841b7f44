"""Folder scans as DataFrames: what is listed, what is left out, what an entry is, and archives as their members.

Listings are rows (path, length, modified, content); content comes from Spark's binary file source, so only files that a
query looks into are read, by the executors.  Predicates are Columns over paths, so they also serve listings from elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import parsers

#: Folders that are never walked, bundles that are one document, and suffixes that are converted.
SKIPPED_FOLDERS = ("node_modules", "__pycache__", "venv", "__MACOSX")
BUNDLES = (".pages", ".key", ".numbers")
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".tif", ".tiff", ".heic", ".heif", ".svg")
WEB, BOOKS, MIND_MAPS = (".html", ".htm"), (".epub", ".fb2", ".mobi", ".azw", ".azw3"), (".xmind",)
OFFICE = (".docx", ".pptx", ".xlsx", ".xlsm", ".xls", ".odt", ".ods", ".odp", ".rtf", ".doc", ".ppt", *BUNDLES)
PLAIN = (".txt", ".csv", ".json", ".xml", ".md", ".eml", ".m", ".mlx", ".zip")
SUFFIXES = (".pdf", *IMAGES, *WEB, *BOOKS, *MIND_MAPS, *OFFICE, *PLAIN)
#: What shows that a folder or archive with a bundle's suffix is one.
BUNDLE_MARKS = ("Metadata", "Index", "Index.zip", "preview.pdf", "preview.jpg")
CHECKSUM_BYTES = 32_000_000


def read_folder(spark: SparkSession, *folders: str) -> DataFrame:
    """(path, length, modified, content) of every file below the folders (or of the files themselves).

    Spark leaves out names that begin with a dot or an underscore, and empty files.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(folders))
    return found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", F.col("modificationTime").alias("modified"), "content")


def own_suffix(path: Column) -> Column:
    """Lower-cased suffix of a path, with its dot; null without one."""
    return F.nullif(F.lower(F.regexp_extract(path, r"[^./][^/]*(\.[^./]+)$", 1)), F.lit(""))


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def stem_of(path: Column) -> Column:
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]+$", "")


def is_hidden(relative: Column) -> Column:
    return relative.rlike(r"(^|/)\.")


def in_skipped_folder(relative: Column, names: Iterable[str] = SKIPPED_FOLDERS) -> Column:
    return F.arrays_overlap(F.split(relative, "/"), F.array(*map(F.lit, names)))


def is_below(path: Column, folder: Column) -> Column:
    """Whether a path is a folder or lies below it."""
    return F.coalesce((path == folder) | F.startswith(path, F.concat(folder, F.lit("/"))), F.lit(False))


def bundle_of(path: Column) -> Column:
    """The outermost bundle folder that a path lies in; null outside."""
    suffixes = "|".join(s[1:] for s in BUNDLES)
    return F.nullif(F.regexp_extract(path, rf"(?i)^(.*?\.(?:{suffixes}))/", 1), F.lit(""))


def looks_like_bundle(members: Column) -> Column:
    """members: relative paths in a folder or archive."""
    tops = F.transform(members, lambda m: F.substring_index(m, "/", 1))
    return F.arrays_overlap(tops, F.array(*map(F.lit, BUNDLE_MARKS)))


def kept(relative: Column, suffix: Column, suffixes: Iterable[str] = SUFFIXES, markdown: bool = False) -> Column:
    """Whether an entry is converted at all; markdown: Markdown files are, too."""
    listed = suffix.isin(list(suffixes)) & (F.lit(markdown) | (suffix != ".md"))
    return F.coalesce(~is_hidden(relative) & ~in_skipped_folder(relative) & listed, F.lit(False))


def relative_to(path: Column, root: str) -> Column:
    return F.substring(path, len(root.rstrip("/")) + 2, 1 << 20)


def scanned(listing: DataFrame, root: str, output: str | None = None, suffixes: Iterable[str] = SUFFIXES, markdown: bool = False) -> DataFrame:
    """Files and bundles of a listing (path, content and others) below root that are converted: path, relative, suffix, bundle, by path.

    A bundle folder is one entry, with the size of its members; it must hold a bundle's marks.
    """
    rows = listing.filter(is_below(F.col("path"), F.lit(root.rstrip("/")))).withColumn("relative", relative_to(F.col("path"), root))
    if output:
        rows = rows.filter(~is_below(F.col("path"), F.lit(output.rstrip("/"))))
    rows = rows.withColumn("_bundle", bundle_of(F.col("path")))
    suffix = parsers.sniffed_suffix(F.col("content"), F.col("path")) if "content" in listing.columns else own_suffix(F.col("path"))
    files = rows.filter("_bundle is null").withColumn("suffix", suffix).filter(kept(F.col("relative"), F.col("suffix"), suffixes, markdown))
    files = files.select("path", "relative", "suffix", F.lit(False).alias("bundle"))
    inside = rows.filter("_bundle is not null").filter(~is_hidden(F.col("relative")) & ~in_skipped_folder(F.col("relative")))
    bundles = inside.groupBy(F.col("_bundle").alias("path")).agg(F.collect_set(F.substring_index(F.expr("substring(path, length(_bundle) + 2)"), "/", 1)).alias("members"))
    bundles = bundles.filter(looks_like_bundle(F.col("members"))).withColumn("suffix", own_suffix(F.col("path"))).filter(F.col("suffix").isin(list(suffixes)))
    bundles = bundles.select("path", relative_to(F.col("path"), root).alias("relative"), "suffix", F.lit(True).alias("bundle"))
    return files.unionByName(bundles).orderBy("path")


def selection(scans: list[DataFrame]) -> DataFrame:
    """Several scans as one: every path once, by path.  Rows of scans must have the same columns."""
    return reduce(DataFrame.unionByName, scans).dropDuplicates(["path"]).orderBy("path")


def checksum(content: Column, limit: int = CHECKSUM_BYTES) -> Column:
    """SHA-256 of a file's beginning: the bound is part of the format."""
    return F.sha2(F.substring(content, 1, limit), 256)


def bundle_checksums(members: DataFrame, limit: int = CHECKSUM_BYTES) -> DataFrame:
    """(bundle, checksum) from rows (bundle, relative, content): SHA-256 over name, zero byte, content and line end, by name.

    Members take part while there is room left; hidden ones and those that begin beyond the limit don't.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("bundle").orderBy("relative").rowsBetween(Window.unboundedPreceding, -1)
    rows = members.filter(~is_hidden(F.col("relative"))).withColumn("_before", F.coalesce(F.sum(F.octet_length("content")).over(order), F.lit(0)))
    rows = rows.filter(F.col("_before") < limit)
    line = F.concat(F.encode(F.col("relative"), "UTF-8"), F.unhex(F.lit("00")), F.substring(F.col("content"), F.lit(1), (F.lit(limit) - F.col("_before")).cast("int")), F.unhex(F.lit("0A")))
    listed = rows.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("relative", line.alias("line")))).alias("l"))
    return listed.select("bundle", F.sha2(F.aggregate("l", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["line"])), 256).alias("checksum"))


# -- archives


def explodable(suffix: Column) -> Column:
    """Whether an archive is opened up: a plain zip, not a document that happens to be one."""
    return F.coalesce(suffix == ".zip", F.lit(False))


def safe_member(member: Column) -> Column:
    """Whether a member stays below the folder it is unpacked to."""
    steps = F.split(F.replace(member, F.lit("\\"), F.lit("/")), "/")
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), lambda a, s: F.struct((a["now"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("now"), F.least(a["least"], a["now"] + F.when(s == "..", -1).otherwise(0)).alias("least")), lambda a: a["least"])
    return ~member.rlike(r"^([/\\]|[A-Za-z]:)") & (depth >= 0)


def with_members(files: DataFrame, members: DataFrame, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """files (path, suffix) with plain archives replaced by the members that are converted; an archive without any stays itself.

    members: (path, member, content) of the archives, from parsers.unzipped().  Result: path, member (null for a file), suffix.
    """
    rows = members.filter(safe_member(F.col("member"))).withColumn("suffix", parsers.sniffed_suffix(F.col("content"), F.col("member")))
    rows = rows.filter(kept(normalised(F.col("member")), F.col("suffix"), suffixes)).select("path", "member", "suffix")
    rows = rows.join(files.filter(explodable(F.col("suffix"))).select("path"), "path", "left_semi")
    rest = files.join(rows.select("path").distinct(), "path", "left_anti").select("path", F.lit(None).cast("string").alias("member"), "suffix")
    return rest.unionByName(rows)


# -- routing


def converter(suffix: Column, bundle: Column, live_script: Column) -> Column:
    """The converter that takes a file: the first that wants it."""
    return (
        F.when(suffix == ".numbers", "numbers").when(bundle | suffix.isin(".pages", ".key"), "bundle").when(suffix.isin(*BOOKS), "ereader")
        .when((suffix == ".m") | ((suffix == ".mlx") & live_script), "script").when(suffix.isin(*MIND_MAPS), "mind map").when(suffix == ".eml", "e-mail")
        .when(suffix.isin(".doc", ".xls", ".ppt", ".rtf", ".odt", ".ods", ".odp"), "legacy office").when(suffix == ".json", "json").when(suffix.isin(".xlsx", ".xlsm"), "spreadsheet")
        .when(suffix == ".pdf", "pdf").when(suffix.isin(*IMAGES), "image").otherwise("generic")
    )


def ereader(suffix: Column) -> Column:
    """Which kind of e-book a suffix is: epub, fb2, mobi, or null."""
    return F.when(suffix == ".epub", "epub").when(suffix == ".fb2", "fb2").when(suffix.isin(".mobi", ".azw", ".azw3"), "mobi")


def inspect_kind(suffix: Column) -> Column:
    """What an inspection counts a file as; a PDF is refined by its pages."""
    return F.when(suffix == ".pdf", "text").when(suffix.isin(*IMAGES), "image").when(suffix.isin(*OFFICE), "office").when(suffix.isin(*SUFFIXES), "text").otherwise("other")


def job_kind(suffix: Column) -> Column:
    kinds = (((".pdf",), "pdf"), (IMAGES, "image"), (WEB, "html"), (BOOKS, "ebook"), (MIND_MAPS, "mindmap"), (OFFICE, "office"), (SUFFIXES, "text"))
    return reduce(lambda a, k: a.when(suffix.isin(*k[0]), k[1]), kinds[1:], F.when(suffix.isin(*kinds[0][0]), kinds[0][1])).otherwise("other")


# -- paths


def source_relative(path: Column, roots: Column) -> Column:
    """A path relative to the first of the roots (an array) that it lies below; its name below none."""
    below = F.filter(F.transform(roots, lambda r: F.when(is_below(path, r) & (path != r), F.length(r))), lambda n: n.isNotNull())
    return F.when(F.size(below) > 0, F.substr(path, F.get(below, F.lit(0)) + 2)).otherwise(name_of(path))


OUTPUT_SUFFIX = "_markdown"


def default_output(path: Column, folder: Column) -> Column:
    """The sibling folder that output goes to: named after a folder, or after a file without its suffix."""
    return F.concat(F.regexp_replace(path, "[^/]*$", ""), F.when(folder, name_of(path)).otherwise(stem_of(path)), F.lit(OUTPUT_SUFFIX))


def common_folder(paths: Column) -> Column:
    """The longest path of whole steps that all paths (an array, not empty) begin with."""
    first = F.split(F.array_min(paths), "/")
    last = F.split(F.array_max(paths), "/")
    # of sorted paths the first and the last agree on what all agree on
    same = F.aggregate(F.zip_with(first, last, lambda a, b: a.eqNullSafe(b)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, x: F.struct((a["n"] + (a["go"] & x).cast("int")).alias("n"), (a["go"] & x).alias("go")), lambda a: a["n"])
    return F.array_join(F.slice(first, 1, same), "/")


def selection_output(paths: Column) -> Column:
    """Output folder of several paths (an array of two or more): named after their folder if all lie in it, else a plain one beside the first."""
    folder = common_folder(paths)
    siblings = F.forall(paths, lambda p: folder_of(p) == folder)
    return F.when(siblings, F.concat(folder, F.lit(OUTPUT_SUFFIX))).otherwise(F.concat(folder_of(F.get(paths, F.lit(0))), F.lit("/markdown")))


def output_for(path: Column, folder: Column, fixed: Column) -> Column:
    """The fixed output folder of the settings, if there is one, else the sibling folder."""
    return F.coalesce(F.nullif(F.trim(fixed), F.lit("")), default_output(path, folder))


def selection_id(paths: Column) -> Column:
    """A short id of a selection, whatever the order it is listed in."""
    return F.substring(F.sha1(F.array_join(F.array_sort(paths), "|")), 1, 16)


def allowed(path: Column, roots: Column) -> Column:
    """Whether a path lies at or below one of the roots."""
    return F.exists(roots, lambda r: is_below(path, r))


def normalised(path: Column) -> Column:
    """A path with its . and .. steps resolved."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(walked, "/"))


def asset_path(output: Column, name: Column) -> Column:
    """Where an asset that a document names lies; null if the name leaves the document's folder of assets."""
    folder = F.concat(folder_of(output), F.lit("/"), stem_of(output), F.lit("_assets"))
    found = normalised(F.concat(folder_of(output), F.lit("/"), name))
    return F.when(is_below(found, folder) & (found != folder), found)


def resolved_images(references: DataFrame, listing: DataFrame) -> DataFrame:
    """references (source, target) with path: the listed file that a target names, beside the source first, else as it stands."""
    paths = listing.select(F.col("path").alias("_path")).distinct()
    rows = references.withColumns({"_near": normalised(F.concat(folder_of(F.col("source")), F.lit("/"), F.col("target"))), "_as": normalised(F.col("target"))})
    near = rows.join(paths.withColumnRenamed("_path", "_a"), F.col("_near") == F.col("_a"), "left")
    both = near.join(paths.withColumnRenamed("_path", "_b"), (F.col("_as") == F.col("_b")) & F.col("target").startswith("/"), "left")
    return both.withColumn("path", F.coalesce("_a", "_b")).drop("_near", "_as", "_a", "_b")
