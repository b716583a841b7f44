"""Run summaries: spans of a tree added up, tools, timings, one row a file, and reports as text.

Traces are rows, not nested records: spans (source, span, parent, name, ms), notes (source, kind, confidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import planning

#: Rows, failures and stages of a report, stages of an index line.
FILE_ROWS, FAILURE_ROWS, STAGE_ROWS, INDEX_STAGES = 200, 50, 12, 8


def span_totals(spans: DataFrame, key: str = "source") -> DataFrame:
    """(key, name, ms): every span counts under its name, inside others or not, so a tree needs no walk."""
    return spans.groupBy(key, "name").agg(F.bround(F.sum("ms"), 4).alias("ms"))


def self_times(spans: DataFrame) -> DataFrame:
    """spans with self_ms: a span's time less that of the spans right inside it."""
    inner = spans.filter("parent is not null").groupBy("source", F.col("parent").alias("span")).agg(F.sum("ms").alias("_inner"))
    return spans.join(inner, ["source", "span"], "left").withColumn("self_ms", F.bround(F.col("ms") - F.coalesce("_inner", F.lit(0.0)), 4)).drop("_inner")


def stage_order(totals: DataFrame) -> DataFrame:
    """Stages (name, ms) that took time, the longest first."""
    return totals.groupBy("name").agg(F.bround(F.sum("ms"), 2).alias("ms")).filter("ms > 0").orderBy(F.desc("ms"), "name")


def tool_counts(notes: DataFrame, traces: DataFrame) -> DataFrame:
    """(tool, n, pct, first): notes by kind and converters, most used first, ties by where they are first seen.

    notes: (source, pos, kind); traces: (source, pos, converter); pos orders the run.
    """
    kinds = notes.filter(F.coalesce("kind", F.lit("")) != "").select("pos", F.col("kind").alias("tool"))
    converters = traces.filter("converter is not null").select("pos", F.concat(F.lit("converter."), F.col("converter")).alias("tool"))
    counts = kinds.unionByName(converters).groupBy("tool").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    total = counts.agg(F.sum("n").alias("_total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("tool", "n", F.bround(100.0 * F.col("n") / F.col("_total"), 1).alias("pct"), "first").orderBy(F.desc("n"), "first", "tool")


def file_rows(manifest: DataFrame, traces: DataFrame, notes: DataFrame) -> DataFrame:
    """One row a file: manifest (source, pos, status, chars, duration_ms) with its converter and reliability; failed first, slowest first, then as listed."""
    confidence = notes.filter("confidence is not null").groupBy("source").agg(F.avg("confidence").alias("confidence"))
    met = manifest.join(traces.groupBy("source").agg(F.max("converter").alias("converter")), "source", "left").join(confidence, "source", "left")
    rows = met.withColumn("reliability", planning.reliability(F.col("status"), F.col("chars"), F.col("confidence")))
    return rows.orderBy(F.col("status") != "failed", F.coalesce("duration_ms", F.lit(0)).desc(), "pos")


def run_summary(rows: DataFrame) -> DataFrame:
    """One row about file_rows(): counts, success rate, reliability, timings."""
    timed = F.when((F.col("status") != "skipped") & F.col("duration_ms").isNotNull(), F.col("duration_ms").cast("double"))
    ok, failed = F.count_if(F.col("status") == "ok"), F.count_if(F.col("status") == "failed")
    return rows.agg(
        ok.alias("converted"), failed.alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.bround(F.when(ok + failed > 0, ok / (ok + failed)).otherwise(1.0), 4).alias("success_rate"),
        F.bround(F.avg("reliability"), 3).alias("reliability"), F.count("reliability").alias("rated"),
        F.count(timed).alias("timed"), F.bround(F.coalesce(F.sum(timed), F.lit(0.0)), 2).alias("sum_ms"), F.bround(F.avg(timed), 2).alias("mean_ms"), F.bround(F.max(timed), 2).alias("max_ms"),
    )


# -- labels


def escaped(c: Column) -> Column:
    """For HTML text and attributes; null is nothing."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def duration_label(ms: Column) -> Column:
    return F.when(ms.isNull(), "—").when(ms >= 1000, F.format_string("%.2fs", ms / 1000)).otherwise(F.format_string("%.0fms", ms.cast("double")))


def percent_label(share: Column) -> Column:
    return F.when(share.isNull(), "—").otherwise(F.format_string("%.0f%%", share * 100))


def size_label(size: Column) -> Column:
    """Bytes with a unit of 1024."""
    units = ("B", "KB", "MB", "GB", "TB")
    step = F.least(F.lit(len(units) - 1), F.when(size >= 1, F.floor(F.log2(size.cast("double")) / 10)).otherwise(0))
    scaled = size / F.pow(F.lit(1024.0), step)
    return F.concat(F.when(step == 0, F.format_string("%.0f", scaled)).otherwise(F.format_string("%.1f", scaled)), F.lit(" "), F.element_at(F.array(*map(F.lit, units)), (step + 1).cast("int")))


def usd_label(usd: Column) -> Column:
    return F.when(usd.isNull(), "?").when((usd > 0) & (usd < 0.01), "<$0.01").otherwise(F.concat(F.lit("$"), F.format_string("%.2f", usd)))


def time_label(seconds: Column) -> Column:
    """Hours and minutes, minutes and seconds, or seconds."""
    whole = F.bround(seconds, 0).cast("long")
    return F.when(whole >= 3600, F.format_string("%d h %d min", F.floor(whole / 3600), F.floor(whole % 3600 / 60))).when(whole >= 60, F.format_string("%d min %d s", F.floor(whole / 60), whole % 60)).otherwise(F.format_string("%d s", whole))


def short_path(path: Column, output: Column) -> Column:
    """A path below the output folder, or its last three steps where it has more than four."""
    steps = F.split(path, "/")
    return F.when(F.startswith(path, output), F.regexp_replace(F.substr(path, F.length(output) + 1), "^/+", "")).when(F.size(steps) > 4, F.concat(F.lit("…/"), F.array_join(F.slice(steps, -3, 3), "/"))).otherwise(path)


def status_label(status: Column) -> Column:
    return F.when(status == "ok", "Exported").when(status == "failed", "Failed").when(status == "skipped", "Skipped").otherwise(status)


# -- reports


def report_html(summary: DataFrame, rows: DataFrame, stages: DataFrame, tools: DataFrame) -> str:
    """The report of a run.  Its tables hold a fixed number of rows, which is the feature; the counts cover everything."""
    import html

    one = summary.first().asDict()
    text = lambda v: "" if v is None else html.escape(str(v))
    table = lambda head, body: "<table><tr>" + "".join(f"<th>{h}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{text(v)}</td>" for v in r) + "</tr>" for r in body) + "</table>"
    listed = rows.select("source", status_label(F.col("status")), "converter", duration_label(F.col("duration_ms")), percent_label(F.col("reliability"))).limit(FILE_ROWS).collect()
    failures = rows.filter("status = 'failed'").select("source", "error").limit(FAILURE_ROWS).collect() if "error" in rows.columns else []
    parts = [
        "<h1>Conversion report</h1>", table(one.keys(), [one.values()]), "<h2>Tools</h2>", table(("tool", "n", "%"), tools.select("tool", "n", "pct").limit(STAGE_ROWS).collect()),
        "<h2>Stages</h2>", table(("stage", "time"), stages.select("name", duration_label(F.col("ms"))).limit(STAGE_ROWS).collect()), "<h2>Files</h2>", table(("file", "status", "converter", "time", "reliability"), listed),
    ]
    if failures:
        parts += ["<h2>Failures</h2>", table(("file", "error"), failures)]
    return "<!doctype html><meta charset='utf-8'><title>Conversion report</title>" + "".join(parts)


def validation_report(findings: DataFrame, path: str = "path") -> DataFrame:
    """(path, report): each document's findings as text, in report order, with its counts by severity."""
    line = F.concat(F.lit("- ["), F.col("severity"), F.lit("] "), F.col("rule"), F.when(F.col("line").isNotNull(), F.concat(F.lit(" (line "), F.col("line").cast("string"), F.lit(")"))).otherwise(""), F.lit(": "), F.col("detail"))
    listed = findings.groupBy(path).agg(F.array_sort(F.collect_list(F.struct("rule", F.coalesce("line", F.lit(-1)).alias("at"), "detail", line.alias("text")))).alias("l"), F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    head = F.concat(F.col(path).cast("string"), F.lit(": "), F.col("e").cast("string"), F.lit(" error(s), "), F.col("w").cast("string"), F.lit(" warning(s)\n"))
    return listed.select(path, F.concat(head, F.array_join(F.transform("l", lambda x: x["text"]), "\n")).alias("report"))


def review_queue(flags: DataFrame) -> DataFrame:
    """(path, section) from flags (path, page, quote, issue, suggestion): what to look at, by page."""
    line = F.concat(F.lit("- p. "), F.col("page").cast("string"), F.lit(': "'), F.col("quote"), F.lit('" — '), F.col("issue"), F.when(F.trim("suggestion") != "", F.concat(F.lit(" → "), F.col("suggestion"))).otherwise(""))
    listed = flags.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "quote", line.alias("line")))).alias("l"))
    return listed.select("path", F.concat(F.lit("## "), F.col("path"), F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("section"))
