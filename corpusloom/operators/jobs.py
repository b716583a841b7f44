"""Jobs from their events: the state of each file, totals, outcomes, replay, retries, gauges.

Events are rows (job, seq, type, index, ...); seq orders the events of a job.  State is what the events say, computed by
aggregations that pick values by seq, so a job with very many events is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources import files as files_

#: Types of events, and the kinds of permits that are counted.
TYPES = ("job_started", "file_started", "page_started", "page_done", "file_done", "cost", "log", "job_done")
PERMITS = ("gpu", "cloud", "cpu")
EVENT = "job string, seq long, type string, index int, page int, status string, engine string, seconds double, usd double, unknown boolean, reason string, pages int, changes int, level string, message string, ts timestamp"


# -- events


def event(kind: str, **fields: Column) -> Column:
    """An event as a struct of all fields, those that aren't given null; the caller's job, seq and ts are columns."""
    if kind not in TYPES:
        raise ValueError(f"no events of type {kind}")
    given = {"type": F.lit(kind), **fields}
    out = []
    for field in EVENT.split(", "):
        name, type_ = field.split(" ")
        value = given.get(name, F.col(name) if name in ("job", "seq", "ts") else F.lit(None))
        out.append(value.cast(type_).alias(name))
    return F.struct(*out)


def file_started(index: Column, pages: Column) -> Column:
    return event("file_started", index=index, pages=pages)


def page_started(index: Column, page: Column, engine: Column) -> Column:
    return event("page_started", index=index, page=page, engine=engine)


def page_done(index: Column, page: Column, engine: Column, seconds: Column, changes: Column) -> Column:
    return event("page_done", index=index, page=page, engine=engine, seconds=seconds, changes=changes)


def file_done(index: Column, status: Column, seconds: Column, reason: Column) -> Column:
    return event("file_done", index=index, status=status, seconds=seconds, reason=reason)


def cost(usd: Column) -> Column:
    """What a call cost; null where it isn't known."""
    return event("cost", usd=usd, unknown=usd.isNull())


def log(level: Column, message: Column) -> Column:
    return event("log", level=level, message=message)


# -- state


def created(selection: DataFrame, output: Column) -> DataFrame:
    """The files of new jobs (job, path) before anything has run: index by path, kind, planned output, queued."""
    rows = selection.withColumn("index", F.row_number().over(Window.partitionBy("job").orderBy("path")) - 1)
    suffix = files_.own_suffix(F.col("path"))
    return rows.select("job", "index", "path", files_.job_kind(suffix).alias("kind"), F.concat(output, F.lit("/"), files_.stem_of(F.col("path")), F.lit(".md")).alias("output"), F.lit("queued").alias("status"))


def _last(value: Column, when: Column) -> Column:
    """The value of the last event for which it is told and the condition holds."""
    return F.max_by(F.when(when, value), F.when(when & value.isNotNull(), F.col("seq")))


def file_states(files: DataFrame, events: DataFrame) -> DataFrame:
    """files (job, index, kind) with status, seconds, reason, pages, engine, changes, as the events leave them.

    A status is the last one told.  An earlier reason goes with an ok; pages count for PDFs; the engine is the last that a
    page was done with, changes add up.  Events of files that a job doesn't have are left out, and so are events without index.
    """
    kind, seq = F.col("type"), F.col("seq")
    done = kind == "file_done"
    facts = events.filter("index is not null").groupBy("job", "index").agg(
        _last(F.col("status"), done).alias("status"), F.bround(_last(F.col("seconds"), done), 2).alias("seconds"), _last(F.col("reason"), done & (F.coalesce("reason", F.lit("")) != "")).alias("reason"),
        F.max(F.when(done & (F.coalesce("reason", F.lit("")) != ""), seq)).alias("_reason_at"), F.max(F.when(done & (F.col("status") == "ok") & (F.coalesce("reason", F.lit("")) == ""), seq)).alias("_ok_at"),
        _last(F.coalesce("pages", F.lit(0)), kind == "file_started").alias("pages"), F.max(F.when(kind == "file_started", seq)).alias("_started"), F.max(F.when(done, seq)).alias("_done"),
        _last(F.col("engine"), kind == "page_done").alias("engine"), F.coalesce(F.sum(F.when(kind == "page_done", F.coalesce("changes", F.lit(0)))), F.lit(0)).alias("changes"),
    )
    running = F.col("_started").isNotNull() & (F.coalesce("_done", F.lit(-1)) < F.col("_started"))
    status = F.when(running, "running").otherwise(F.coalesce("status", F.lit("queued")))
    reason = F.when(F.coalesce("_ok_at", F.lit(-1)) > F.coalesce("_reason_at", F.lit(-1)), None).otherwise(F.col("reason"))
    met = files.select("job", "index", "kind").join(facts, ["job", "index"], "left")
    return met.select("job", "index", "kind", status.alias("status"), "seconds", reason.alias("reason"), F.when(F.col("kind") == "pdf", F.col("pages")).alias("pages"), "engine", F.coalesce("changes", F.lit(0)).cast("long").alias("changes"))


def engine_used(kind: Column, engine: Column, model: Column, enabled: Column) -> Column:
    """What a file was read with: the engine told, else the job's model for what could need one, else none."""
    return F.coalesce(engine, F.when(kind.isin("pdf", "image") & enabled, model), F.lit("none"))


def outcome(cancelled: Column, failed: Column, warned: Column) -> Column:
    """Of what befell a file, what counts."""
    return F.when(cancelled, "cancelled").when(failed, "failed").when(warned, "warn").otherwise("ok")


def totals(states: DataFrame) -> DataFrame:
    """(job, ok, warn, failed, cancelled) from file_states()."""
    return states.groupBy("job").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warn", "failed", "cancelled")])


def money(events: DataFrame) -> DataFrame:
    """(job, usd): what a job's calls cost; null once one of them isn't known."""
    rows = events.filter("type = 'cost'").groupBy("job").agg(F.bool_or(F.coalesce("unknown", F.lit(False))).alias("u"), F.sum(F.coalesce("usd", F.lit(0.0))).alias("usd"))
    return rows.select("job", F.when(~F.col("u"), F.bround("usd", 4)).alias("usd"))


def recorded(events: DataFrame) -> DataFrame:
    """(job, index, fallbacks, first_reason, lost_pages): pages done by another engine than started, the first reason told, pages that lost structure."""
    rows = events.groupBy("job", "index", "page").agg(F.min_by("engine", F.when((F.col("type") == "page_started") & F.col("engine").isNotNull(), F.col("seq"))).alias("asked"), F.max_by("engine", F.when((F.col("type") == "page_done") & F.col("engine").isNotNull(), F.col("seq"))).alias("got"), F.min(F.when(F.coalesce("reason", F.lit("")) != "", F.struct("seq", "reason"))).alias("first"), F.bool_or(F.coalesce(F.col("message") == "structure lost", F.lit(False))).alias("lost"))
    by_file = rows.filter("index is not null").groupBy("job", "index").agg(F.count_if(F.col("asked").isNotNull() & F.col("got").isNotNull() & (F.col("asked") != F.col("got"))).alias("fallbacks"), F.min("first").alias("first"), F.array_sort(F.collect_set(F.when(F.col("lost"), F.col("page")))).alias("lost_pages"))
    return by_file.select("job", "index", "fallbacks", F.col("first.reason").alias("first_reason"), "lost_pages")


def recent(live: DataFrame, history: DataFrame, limit: int) -> DataFrame:
    """The latest jobs of both lists (job, started, finished, ...), the live one of a job first; newest by their end, else their start.

    A limit is the feature.  Jobs without either time come last, ties by id.
    """
    rows = live.withColumn("_live", F.lit(0)).unionByName(history.withColumn("_live", F.lit(1)))
    kept = rows.join(live.select("job").distinct().withColumn("_has", F.lit(True)), "job", "left").filter((F.col("_live") == 0) | F.col("_has").isNull()).drop("_live", "_has")
    return kept.orderBy(F.coalesce(F.col("finished").cast("string"), F.col("started").cast("string"), F.lit("")).desc(), "job").limit(limit)


def rehydrated(history: DataFrame) -> DataFrame:
    """Jobs from the history as they can be looked at again: those that ended, with nothing running or queued in them."""
    return history.filter(F.col("finished").isNotNull()).withColumn("status", F.when(F.col("status").isin("queued", "running"), "cancelled").otherwise(F.col("status")))


def replayed(events: DataFrame, since: Column) -> DataFrame:
    """The events that a subscriber who has seen seq since (null: none) still gets, in order."""
    return events.filter(F.col("seq") > F.coalesce(since, F.lit(-1))).orderBy("job", "seq")


def retry_refused(edited: Column, page: Column, confirmed: Column) -> Column:
    """Pages with edits that a retry would lose: the page's own, or all of the file's without a page; none if confirmed."""
    at_risk = F.when(page.isNull(), edited).otherwise(F.array_intersect(edited, F.array(page)))
    return F.when(confirmed, F.slice(edited, 1, 0)).otherwise(F.array_sort(F.coalesce(at_risk, F.slice(edited, 1, 0))))


def patched(pipelines: DataFrame, patches: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """pipelines (job, fields) with the fields that patches (job, fields) set."""
    p = patches.select("job", *[F.col(f).alias(f"_{f}") for f in fields])
    met = pipelines.join(p, "job", "left")
    return met.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in pipelines.columns])


# -- gauges


def active(events: DataFrame, key: str, order: list[str], step: str, stretch: int = 4096) -> DataFrame:
    """events with active: a running sum of step (+1 or -1) in key, by order, that never falls below 0.

    The sum without the floor, less its lowest value so far where that is negative.  Both are taken by stretches of rows
    first, so a key with very many events is summed in many tasks.
    """
    # stretches by ranges of the first order column's value, which is spread over the key's events
    rows = events.withColumn("_stretch", F.floor(F.col(order[0]).cast("double") / stretch))
    inside = Window.partitionBy(key, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(step).over(inside))
    rows = rows.withColumn("_low", F.min("_sum").over(inside))
    whole = rows.groupBy(key, "_stretch").agg(F.sum(step).alias("_all"), F.min("_sum").alias("_least"))
    before = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("_base", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    whole = whole.withColumn("_floor", F.least(F.lit(0), F.coalesce(F.min(F.col("_base") + F.col("_least")).over(before), F.lit(0))))
    met = rows.join(whole.select(key, "_stretch", "_base", "_floor"), [key, "_stretch"])
    total = F.col("_base") + F.col("_sum")
    return met.withColumn("active", (total - F.least(F.col("_floor"), F.col("_base") + F.col("_low"), F.lit(0))).cast("long")).drop("_stretch", "_sum", "_low", "_base", "_floor")


def permits(events: DataFrame) -> DataFrame:
    """(kind, seq, held, waiting) after every event of permits (kind, seq, action: wait, acquire, release)."""
    w = Window.partitionBy("kind").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    held = F.sum(F.when(F.col("action") == "acquire", 1).when(F.col("action") == "release", -1).otherwise(0)).over(w)
    waiting = F.sum(F.when(F.col("action") == "wait", 1).when(F.col("action") == "acquire", -1).otherwise(0)).over(w)
    return events.select("kind", "seq", held.alias("held"), F.greatest(F.lit(0), waiting).alias("waiting"))


def deadlines(submitted: DataFrame, workers: int) -> DataFrame:
    """submitted (file, at, budget, seconds) with deadline, timed_out, and whether the batch goes on: as many files may hang as there are workers."""
    rows = submitted.withColumn("deadline", F.col("at") + F.col("budget")).withColumn("timed_out", F.coalesce(F.col("seconds") > F.col("budget"), F.lit(False)))
    hung = F.sum(F.col("timed_out").cast("int")).over(Window.partitionBy("batch").orderBy("at", "file", "timed_out").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("goes_on", hung < workers)


# -- settings


def settings_problems(settings: DataFrame) -> DataFrame:
    """(id, problems) of settings (id, workers, dpi, min_confidence, output_mode, output_fixed): what doesn't go together."""
    checks = (
        (F.coalesce("workers", F.lit(0)) < 1, "workers must be 1 or more"),
        (~F.coalesce(F.col("dpi").between(72, 600), F.lit(False)), "dpi must be between 72 and 600"),
        (~F.coalesce(F.col("min_confidence").between(0, 100), F.lit(False)), "min_confidence must be between 0 and 100"),
        ((F.col("output_mode") == "fixed") & (F.trim(F.coalesce("output_fixed", F.lit(""))) == ""), "a fixed output needs a folder"),
        (~F.coalesce(F.col("output_mode").isin("sibling", "fixed"), F.lit(False)), "output_mode must be sibling or fixed"),
    )
    return settings.select("id", F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks])).alias("problems"))


def replaced_presets(builtin: DataFrame, wanted: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """What is stored when wanted (id, fields) becomes all presets: overrides of built-in ones where they differ, and the user's own.

    Presets that wanted doesn't name are gone: a built-in one is as built in again.
    """
    defaults = builtin.select("id", F.struct(*fields).alias("_default"))
    met = wanted.join(defaults, "id", "left").withColumn("own", F.col("_default").isNull())
    return met.filter(F.col("own") | ~F.struct(*fields).eqNullSafe(F.col("_default"))).select("id", *fields, "own")


def deleted_preset(presets: DataFrame, id_: str) -> DataFrame:
    """presets (id, own, ...) without the user's one of that id; built-in ones stay."""
    return presets.filter(~((F.col("id") == id_) & F.col("own")))
