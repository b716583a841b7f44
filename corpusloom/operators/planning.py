"""Manifest, output planning, cost and estimate operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds a page and a figure, by model kind; seconds of extraction and writing a page; lanes.
LOCAL_PAGE, LOCAL_FIGURE, REMOTE_PAGE, REMOTE_FIGURE, REMOTE_REVIEW, LOCAL_REVIEW, CPU_PAGE = 150.0, 40.0, 8.0, 5.0, 3.0, 5.0, 2.0
EXTRACT_PAGE, WRITE_PAGE, CLOUD_LANES, SAFETY = 0.1, 0.05, 4, 3.0
RESIDENT_FACTOR, HEADROOM_GB = 1.45, 3.0
#: File size in GB by billions of parameters, for models that aren't installed.
FALLBACK_GB = {3: 3.2, 4: 3.3, 7: 5.6, 32: 20.0, 72: 45.0}


def skip_decision(force: Column) -> Column:
    """Whether to skip a source, and why: conditions in their fixed order."""
    return (
        F.when(force, "forced")
        .when(~F.col("output_exists"), "no output")
        .when(F.col("old_status") == "failed", "failed before")
        .when(F.col("old_backend").isNotNull() & (F.col("backend") != F.col("old_backend")), "other backend")
        .when(F.col("old_checksum").isNotNull() & (F.col("checksum") != F.col("old_checksum")), "changed")
        .when(F.col("old_checksum").isNotNull(), "skip")
        .when(F.col("mtime") <= F.col("output_mtime"), "skip")
        .otherwise("newer")
    )


def planned_outputs(files: DataFrame) -> DataFrame:
    """files (path) with output: the suffix becomes .md, and stays in the name where several sources share a stem."""
    plain = F.regexp_replace("path", r"\.[^./]+$", ".md")
    shared = files.withColumn("plain", plain).groupBy("plain").agg(F.count("*").alias("sharing"))
    return files.withColumn("plain", plain).join(shared, "plain").withColumn("output", F.when(F.col("sharing") == 1, F.col("plain")).otherwise(F.concat(F.regexp_replace("path", r"\.[^./]+$", ""), F.lit("."), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), F.lit(".md"))))


def weight(vision_pages: Column, figures: Column, local: Column) -> Column:
    return vision_pages * F.when(local, LOCAL_PAGE).otherwise(REMOTE_PAGE) + figures * F.when(local, LOCAL_FIGURE).otherwise(4.0)


#: Fixed value: regions of a page that are kept.
FIGURES_PER_PAGE = 6
#: Sampled rows for each range of the full ordering.
RANGE_SAMPLE = 20


def order_by_cost(files: DataFrame) -> DataFrame:
    """Every file's place (from 1): files (path, weight) heaviest first, ties in discovery order, which goes by path; no weight counts as 0.

    A hashed sample gives bounds of ranges with about as many files each; a place is the rank inside its range plus
    the files of the ranges before, so no task sees all files.  Bounds are fixed before ranges are counted.
    """
    key = F.struct((-F.coalesce("weight", F.lit(0.0))).alias("w"), F.col("path").alias("p"))
    ranges = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, files.count() // (ranges * RANGE_SAMPLE))
    sample = sorted((r.k.w, r.k.p) for r in files.filter(F.pmod(F.xxhash64("path"), F.lit(every)) == 0).select(key.alias("k")).collect())
    bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    # the range is the number of bounds not above the file
    marks = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(p).alias("p")) for w, p in bounds])
    held = files.withColumn("_k", key)
    held = held.withColumn("_range", F.size(F.filter(marks, lambda b: b <= F.col("_k"))) if bounds else F.lit(0))
    before = held.groupBy("_range").count().withColumn("_before", F.sum("count").over(Window.orderBy("_range")) - F.col("count")).drop("count")  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_k"))
    return held.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn("place", (F.col("_before") + F.col("_inside")).cast("long")).drop("_k", "_range", "_before", "_inside")


def indexed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with name: each row's place from 0 by order, over as many tasks as there are partitions.

    Rows are sorted by ranges; a place is the one in the row's partition plus the rows of the partitions before.
    """
    ordered = rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    ordered = ordered.withColumns({"_p": F.shiftright("_id", 33), "_i": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")
    counts = ordered.groupBy("_p").agg(F.count("*").alias("_n"))  # a row a partition
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return ordered.join(F.broadcast(before), "_p").withColumn(name, (F.col("_i") + F.col("_before")).cast("long")).drop("_p", "_i", "_before")


def indexed_within(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with name: each row's place from 0 within key by order; a key with very many rows is sorted in many tasks."""
    placed = indexed(rows, [key, *order], name)
    first = placed.groupBy(key).agg(F.min(name).alias("_first"))
    met = placed.join(first, placed[key].eqNullSafe(first[key])).drop(first[key])
    return met.withColumn(name, F.col(name) - F.col("_first")).drop("_first")


def _earlier_max(tops: DataFrame, width: int) -> DataFrame:
    """(_s, _before) from rows (_s, _top): the largest value of all rows before, by groups of rows until one task holds them."""
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    if tops.count() <= width:
        return tops.select("_s", F.max("_top").over(before).alias("_before"))
    grouped = tops.withColumn("_g", F.floor(F.col("_s") / width))
    outer = _earlier_max(grouped.groupBy(F.col("_g").alias("_s")).agg(F.max("_top").alias("_top")), width).select(F.col("_s").alias("_g"), F.col("_before").alias("_outer"))
    inside = grouped.withColumn("_inside", F.max("_top").over(Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)))
    return inside.join(outer, "_g").select("_s", F.greatest("_inside", "_outer").alias("_before"))


def running_max(rows: DataFrame, order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """rows with name: the largest value up to and with the row, by a whole number order; nulls don't count.

    Stretches of numbers have their maxima, which are carried on over stretches of stretches until one task holds them.
    """
    rows = rows.withColumn("_s", F.floor(F.col(order) / width))
    tops = _earlier_max(rows.groupBy("_s").agg(F.max(value).alias("_top")), width)
    own = F.max(value).over(Window.partitionBy("_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(tops, "_s").withColumn(name, F.greatest("_own", "_before")).drop("_s", "_own", "_before")


def page_route(forced: Column, needs_ocr: Column, has_tables: Column) -> Column:
    """How a page is read: natively, by the text engine (its tables stay), or by the vision model."""
    return F.when(forced, "vision").when(~needs_ocr, "native").when(has_tables, "tesseract").otherwise("vision")


def pdf_kind(scanned: Column, pages: Column) -> Column:
    """A PDF counts as scanned if more than half of its pages are."""
    return F.when(scanned * 2 > pages, "scanned").otherwise("text")


def late_dropped(events: DataFrame, order: str, ts: str, late: str) -> DataFrame:
    """Events that aren't further behind the latest one before them than late (an interval)."""
    return running_max(events, order, ts, "_latest").filter(F.col(ts) >= F.col("_latest") - F.expr(f"INTERVAL {late}")).drop("_latest")


def fallback_steps(pages: DataFrame, key: str, order: list[str], count: str) -> DataFrame:
    """pages with delta: by how much a counter has risen since the page before; the first page's whole count."""
    w = Window.partitionBy(key).orderBy(*order)
    return pages.withColumn("delta", F.col(count) - F.coalesce(F.lag(count).over(w), F.lit(0)))


def timeout_budget(planned: Column, floor: Column) -> Column:
    """No floor, no budget."""
    return F.when(floor > 0, F.greatest(floor, planned * SAFETY))


def openai_image_tokens(w: Column, h: Column) -> Column:
    scale = F.least(F.lit(1.0), 2048 / w, 2048 / h)
    short = F.least(w * scale, h * scale)
    shrink = F.when(short > 768, 768 / short).otherwise(1.0)
    tiles = F.ceil(w * scale * shrink / 512) * F.ceil(h * scale * shrink / 512)
    return (tiles * 170 + 85).cast("long")


def patch_image_tokens(w: Column, h: Column, patch: int = 28) -> Column:
    """Sides in whole patches (half to even), the whole box scaled into the pixel limits."""
    least, most = 4.0 * patch * patch, 16384.0 * patch * patch
    side = lambda x: F.greatest(F.lit(float(patch)), F.bround(x / patch, 0) * patch)
    area = side(w) * side(h)
    down, up = F.sqrt(w * h / most), F.sqrt(least / (w * h))
    fit = lambda x: F.when(area > most, F.floor(x / down / patch) * patch).when(area < least, F.ceil(x * up / patch) * patch).otherwise(side(x))
    return (F.greatest(F.lit(patch), fit(w)) / patch * (F.greatest(F.lit(patch), fit(h)) / patch)).cast("long")


def stage_rows(work: DataFrame) -> DataFrame:
    """Stages of each scenario: work has scenario, pages, scanned, math_pages, figures, ocr, figure, review (kind of model) and prices."""
    seconds = lambda kind, n, local, cloud, cpu: F.when(F.col(kind) == "gpu", F.col(n) * local).when(F.col(kind) == "cloud", F.col(n) * cloud).when(F.col(kind) == "cpu", F.col(n) * cpu).otherwise(0.0)
    work = work.withColumn("review_pages", F.col("scanned") + F.col("math_pages"))
    stage = lambda name, kind, sec, usd: F.struct(F.lit(name).alias("stage"), kind.alias("kind"), sec.cast("double").alias("seconds"), usd.cast("double").alias("usd"))
    usd = lambda kind, n: F.when(F.col(kind) != "cloud", 0.0).when(F.col("price").isNull(), F.when(F.col(n) > 0, None).otherwise(0.0)).otherwise(F.col(n) * F.col("price"))
    stages = F.array(
        stage("extract", F.lit("cpu"), F.col("pages") * EXTRACT_PAGE, F.lit(0.0)),
        stage("ocr", F.col("ocr"), seconds("ocr", "scanned", LOCAL_PAGE, REMOTE_PAGE, CPU_PAGE), usd("ocr", "scanned")),
        stage("figures", F.col("figure"), seconds("figure", "figures", LOCAL_FIGURE, REMOTE_FIGURE, 0.0), usd("figure", "figures")),
        stage("review", F.col("review"), seconds("review", "review_pages", LOCAL_REVIEW, REMOTE_REVIEW, 0.0), usd("review", "review_pages")),
        stage("write", F.lit("cpu"), F.col("pages") * WRITE_PAGE, F.lit(0.0)),
    )
    return work.select("scenario", "workers", F.inline(stages))


def lanes(stages: DataFrame) -> DataFrame:
    """Seconds by lane, the longest lane, and a total price that one unknown stage makes unknown."""
    by = stages.groupBy("scenario", "workers").agg(*[F.sum(F.when(F.col("kind") == k, F.col("seconds")).otherwise(0.0)).alias(k) for k in ("gpu", "cloud", "cpu")], F.bool_or(F.col("usd").isNull()).alias("unknown"), F.sum(F.coalesce("usd", F.lit(0.0))).alias("paid"))
    t_cloud, t_cpu = F.col("cloud") / F.least(F.lit(CLOUD_LANES), F.greatest(F.lit(1), F.col("workers"))), F.col("cpu") / F.greatest(F.lit(1), F.col("workers"))
    total = F.greatest(F.col("gpu"), t_cloud, t_cpu)
    neck = F.when((total == F.col("gpu")) & (F.col("gpu") > 0), "gpu").when((total == t_cloud) & (F.col("cloud") > 0), "cloud").otherwise("cpu")
    return by.select("scenario", F.round("gpu", 6).alias("gpu_seconds"), F.round("cloud", 6).alias("cloud_seconds"), F.round("cpu", 6).alias("cpu_seconds"), F.round(total, 6).alias("total_seconds"), neck.alias("bottleneck"), F.round(F.when(F.col("unknown"), None).otherwise(F.col("paid")), 6).alias("total_usd"))


def reliability(status: Column, chars: Column, confidence: Column) -> Column:
    """0 to 1; null for skipped files."""
    return F.when(status == "skipped", None).when(status == "failed", 0.0).when(F.coalesce(chars, F.lit(0)) <= 0, 0.15).when(confidence.isNull(), 1.0).otherwise(F.bround(0.4 + 0.6 * F.greatest(F.lit(0.0), F.least(confidence, F.lit(100.0))) / 100, 3))


def resident_gb(file_gb: Column, params: Column) -> Column:
    """Memory of a loaded model by its file, or by its number of parameters; null if neither is known."""
    fallback = F.lit(None).cast("double")
    for p, gb in FALLBACK_GB.items():
        fallback = F.when(params == p, gb).otherwise(fallback)
    return F.bround(F.coalesce(file_gb, fallback) * RESIDENT_FACTOR, 2)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def fuzzy_score(q: str, id_: Column, name: Column, preferred: Column | None = None) -> Column:
    """Prefix, then place in the name, then in the id, then letters in order: null for no match; preferred ones get a little more."""
    more = F.lit(0.0) if preferred is None else F.when(preferred, 500.0).otherwise(0.0)
    return _fuzzy_tiers(q, id_, name) + more


def _fuzzy_tiers(q: str, id_: Column, name: Column) -> Column:
    q = q.lower()
    n, i = F.lower(name), F.lower(id_)
    # letters in order: a fold over the id's characters with the next letter wanted, the score and the run so far
    start = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("score"), F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(-1).alias("t"), F.lit("").alias("before"))
    wanted = F.lit(q)

    def step(a: Column, ch: Column) -> Column:
        t = a["t"] + 1
        hit = (a["k"] < len(q)) & (F.substr(wanted, a["k"] + 1, F.lit(1)) == ch)
        run = F.when(t == a["last"] + 1, a["run"] + 1).otherwise(0)
        edge = (t == 0) | a["before"].rlike(r"[/:_.\-]")
        gain = 1.0 + F.when(run > 0, run * 3.0).otherwise(0.0) + F.when(edge, 4.0).otherwise(0.0)
        return F.struct(F.when(hit, a["k"] + 1).otherwise(a["k"]).alias("k"), (a["score"] + F.when(hit, gain).otherwise(0.0)).alias("score"), F.when(hit, t).otherwise(a["last"]).alias("last"), F.when(hit, run).otherwise(a["run"]).alias("run"), t.alias("t"), ch.alias("before"))

    letters = F.aggregate(F.split(i, ""), start, step, lambda a: F.when(a["k"] == len(q), a["score"]))
    return F.when(n.startswith(q), 3e6 - F.length(name)).when(F.contains(n, wanted), 2e6 - (F.locate(q, n) - 1) * 1000 - F.length(name)).when(F.contains(i, wanted), 1e6 - (F.locate(q, i) - 1) * 1000 - F.length(id_)).otherwise(letters - F.length(id_) * 0.01)


def job_state(events: DataFrame) -> DataFrame:
    """The last event of each file decides its state: (job, file) with status, counts and seconds."""
    by = events.groupBy("job", "file").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("seconds"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_status"))
    return by


def running_cost(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("so_far", F.round(F.sum("value").over(w), 4))


def inspected(files: DataFrame, pages: DataFrame) -> DataFrame:
    """files (path) with pages, scanned, vision, maths, figures, chars and weight, from pages (path, needs_ocr, route, math, figures, chars).

    A file without pages counts as nothing, and costs nothing.
    """
    sums = pages.groupBy("path").agg(
        F.count("*").alias("pages"), F.count_if("needs_ocr").alias("scanned"), F.count_if(F.col("route") == "vision").alias("vision"), F.count_if("math").alias("maths"),
        F.sum(F.coalesce("figures", F.lit(0))).alias("figures"), F.sum(F.coalesce("chars", F.lit(0))).alias("chars"),
    )
    counts = ("pages", "scanned", "vision", "maths", "figures", "chars")
    rows = files.join(sums, "path", "left").fillna(0, list(counts))
    return rows.withColumns({"weight": weight(F.col("vision"), F.col("figures"), F.lit(False)), "kind": pdf_kind(F.col("scanned"), F.col("pages"))})


def native_pages(snapshots: DataFrame) -> DataFrame:
    """(doc, page, markdown) of the pages that need no OCR, from snapshots (doc, pages: list of (page, markdown, needs_ocr))."""
    return snapshots.select("doc", F.inline("pages")).filter(~F.col("needs_ocr")).select("doc", "page", "markdown")
