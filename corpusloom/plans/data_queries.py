"""Manifest, planning, estimate, summary, event, HTML, table, geometry and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import jobs, parsers, planning, review, sheets
from corpusloom.plans.catalog import query
from corpusloom.sources.tables import table

SUFFIXES = "CASE WHEN doc_id % 3 = 0 THEN '.pdf' WHEN doc_id % 3 = 1 THEN '.docx' ELSE '.txt' END"
#: Documents as files of a tree: paths, checksum and size of the content; some stems are shared.
FILES = f"""files AS (SELECT doc_id, 'in/' || source || '/doc' || (doc_id // 2) || {SUFFIXES} AS path, sha256(text) AS checksum, n_chars,
    CAST(1 + n_chars // 1800 AS BIGINT) AS pages, CAST(CASE WHEN doc_id % 4 = 0 THEN 1 + n_chars // 1800 ELSE 0 END AS BIGINT) AS scanned, CAST(doc_id % 5 AS BIGINT) AS figures FROM documents)"""


def _files(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    suffix = F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".docx").otherwise(".txt")
    pages = F.floor(F.col("n_chars") / 1800) + 1
    return docs.select("doc_id", F.concat(F.lit("in/"), F.col("source"), F.lit("/doc"), F.floor(F.col("doc_id") / 2).cast("string"), suffix).alias("path"), F.sha2("text", 256).alias("checksum"), "n_chars", pages.alias("pages"), F.when(F.col("doc_id") % 4 == 0, pages).otherwise(0).alias("scanned"), (F.col("doc_id") % 5).alias("figures"))


@query("scan_manifest", f"WITH {FILES} SELECT path, checksum, regexp_extract(path, '(\\.[^./]+)$', 1) AS suffix, pages FROM files WHERE NOT regexp_matches(path, '(^|/)\\.')")
def scan_manifest(spark, sf_dir):
    files = _files(spark, sf_dir).filter(~F.col("path").rlike(r"(^|/)\."))
    return files.select("path", "checksum", F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("suffix"), "pages")


@query(
    "skip_plan",
    f"""WITH {FILES}, prior AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'failed' ELSE 'ok' END AS old_status, CASE WHEN quality = 0 THEN 'tesseract' ELSE 'hybrid' END AS old_backend FROM labels),
    met AS (SELECT path, doc_id, old_status, old_backend, checksum, CASE WHEN old_status IS NULL OR doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'stale' ELSE checksum END AS old_checksum FROM files LEFT JOIN prior USING (doc_id))
    SELECT decision, count(*) AS n FROM (SELECT CASE WHEN doc_id % 13 = 0 THEN 'no output' WHEN old_status = 'failed' THEN 'failed before' WHEN old_backend IS NOT NULL AND 'hybrid' <> old_backend THEN 'other backend'
      WHEN old_checksum IS NOT NULL AND checksum <> old_checksum THEN 'changed' WHEN old_checksum IS NOT NULL THEN 'skip' WHEN doc_id % 2 = 0 THEN 'skip' ELSE 'newer' END AS decision FROM met) GROUP BY decision""",
)
def skip_plan(spark, sf_dir):
    """Labels stand in for an earlier manifest; outputs and times by the id."""
    prior = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "failed").otherwise("ok").alias("old_status"), F.when(F.col("quality") == 0, "tesseract").otherwise("hybrid").alias("old_backend"))
    met = _files(spark, sf_dir).join(prior, "doc_id", "left")
    met = met.withColumns({"old_checksum": F.when(F.col("old_status").isNull() | (F.col("doc_id") % 7 == 0), None).when(F.col("doc_id") % 11 == 0, "stale").otherwise(F.col("checksum")), "output_exists": F.col("doc_id") % 13 != 0, "backend": F.lit("hybrid"), "mtime": F.col("doc_id") % 2, "output_mtime": F.lit(0)})
    return met.withColumn("decision", planning.skip_decision(F.lit(False))).groupBy("decision").agg(F.count("*").alias("n"))


@query("output_collisions", f"WITH {FILES}, p AS (SELECT path, regexp_replace(path, '\\.[^./]+$', '.md') AS plain FROM files) SELECT path, CASE WHEN count(*) OVER (PARTITION BY plain) = 1 THEN plain ELSE regexp_replace(path, '\\.[^./]+$', '') || '.' || regexp_extract(path, '\\.([^./]+)$', 1) || '.md' END AS output FROM p")
def output_collisions(spark, sf_dir):
    return planning.planned_outputs(_files(spark, sf_dir).select("path")).select("path", "output")


@query("dedupe_checksum", f"WITH {FILES} SELECT checksum, min(path) AS kept, count(*) AS copies FROM files GROUP BY checksum")
def dedupe_checksum(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("checksum").agg(F.min("path").alias("kept"), F.count("*").alias("copies"))


_WEIGHTS = "w AS (SELECT path, scanned * CAST(8 AS DOUBLE) + figures * CAST(4 AS DOUBLE) AS weight FROM files WHERE doc_id % 10 > 0)"


@query("lpt_order", f"WITH {FILES}, {_WEIGHTS} SELECT doc_id, coalesce(weight, 0) AS weight, row_number() OVER (ORDER BY coalesce(weight, 0) DESC, path, doc_id) AS place FROM files LEFT JOIN w USING (path)")
def lpt_order(spark, sf_dir):
    """The place of every file of the batch, heaviest first, ties in discovery order; a file without a weight counts as 0."""
    files = _files(spark, sf_dir)
    weights = files.filter("doc_id % 10 > 0").select("path", planning.weight(F.col("scanned"), F.col("figures"), F.lit(False)).alias("weight"))
    rows = files.select("doc_id", "path").join(weights, "path", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return planning.order_by_cost(rows).select("doc_id", "weight", "place")


@query("timeout_budget", f"WITH {FILES} SELECT doc_id, CASE WHEN doc_id % 9 > 0 THEN greatest(CAST(300 AS DOUBLE), (scanned * CAST(8 AS DOUBLE) + figures * CAST(4 AS DOUBLE)) * 3) END AS budget FROM files")
def timeout_budget(spark, sf_dir):
    files = _files(spark, sf_dir)
    floor = F.when(F.col("doc_id") % 9 > 0, 300.0).otherwise(0.0)
    return files.select("doc_id", planning.timeout_budget(planning.weight(F.col("scanned"), F.col("figures"), F.lit(False)), floor).alias("budget"))


@query("inspect_totals", f"WITH {FILES} SELECT suffix, count(*) AS files, sum(pages) AS pages, sum(scanned) AS scanned, sum(figures) AS figures, count(*) FILTER (WHERE scanned * 2 > pages) AS scans FROM (SELECT *, regexp_extract(path, '(\\.[^./]+)$', 1) AS suffix FROM files) GROUP BY ROLLUP (suffix)")
def inspect_totals(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("suffix", F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.rollup("suffix").agg(F.count("*").alias("files"), F.sum("pages").alias("pages"), F.sum("scanned").alias("scanned"), F.sum("figures").alias("figures"), F.count_if(F.col("scanned") * 2 > F.col("pages")).alias("scans"))


@query("page_routes", f"WITH {FILES} SELECT doc_id % 6 = 0 AS tables, route, count(*) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'vision' WHEN scanned = 0 THEN 'native' WHEN doc_id % 6 = 0 THEN 'tesseract' ELSE 'vision' END AS route FROM files) GROUP BY doc_id % 6 = 0, route")
def page_routes(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("tables", F.col("doc_id") % 6 == 0)
    route = planning.page_route(F.col("doc_id") % 17 == 0, F.col("scanned") > 0, F.col("tables"))
    return files.withColumn("route", route).groupBy("tables", "route").agg(F.count("*").alias("n"))


_SCENARIOS = (("now", "gpu", "gpu", "cloud", 4, 0.002), ("fast", "cpu", "none", "none", 4, 0.002), ("cloud", "cloud", "cloud", "cloud", 8, 0.002), ("unpriced", "cloud", "none", "gpu", 2, None))
_SCENARIO_SQL = "(VALUES " + ", ".join(f"('{s}', '{o}', '{f}', '{r}', {w}, {'NULL' if p is None else f'CAST({p} AS DOUBLE)'})" for s, o, f, r, w, p in _SCENARIOS) + ") AS s(scenario, ocr, figure, review, workers, price)"


def _stage_sql() -> str:
    sec = lambda k, n, g, c, u: f"CASE {k} WHEN 'gpu' THEN {n} * CAST({g} AS DOUBLE) WHEN 'cloud' THEN {n} * CAST({c} AS DOUBLE) WHEN 'cpu' THEN {n} * CAST({u} AS DOUBLE) ELSE 0 END"
    usd = lambda k, n: f"CASE WHEN {k} <> 'cloud' THEN CAST(0 AS DOUBLE) WHEN price IS NULL THEN CASE WHEN {n} > 0 THEN NULL ELSE CAST(0 AS DOUBLE) END ELSE {n} * price END"
    rows = [("extract", "'cpu'", "pages * CAST(0.1 AS DOUBLE)", "CAST(0 AS DOUBLE)"), ("ocr", "ocr", sec("ocr", "scanned", 150, 8, 2), usd("ocr", "scanned")), ("figures", "figure", sec("figure", "figures", 40, 5, 0), usd("figure", "figures")), ("review", "review", sec("review", "(scanned + math_pages)", 5, 3, 0), usd("review", "(scanned + math_pages)")), ("write", "'cpu'", "pages * CAST(0.05 AS DOUBLE)", "CAST(0 AS DOUBLE)")]
    return " UNION ALL ".join(f"SELECT scenario, workers, '{n}' AS stage, {k} AS kind, {s} AS seconds, {u} AS usd FROM work" for n, k, s, u in rows)


_WORK_SQL = f"WITH {FILES}, work AS (SELECT s.*, t.* FROM {_SCENARIO_SQL}, (SELECT sum(pages) AS pages, sum(scanned) AS scanned, sum(CASE WHEN doc_id % 10 = 0 THEN pages ELSE 0 END) AS math_pages, sum(figures) AS figures FROM files) t), stages AS ({_stage_sql()})"


def _work(spark, sf_dir) -> DataFrame:
    totals = _files(spark, sf_dir).agg(F.sum("pages").alias("pages"), F.sum("scanned").alias("scanned"), F.sum(F.when(F.col("doc_id") % 10 == 0, F.col("pages")).otherwise(0)).alias("math_pages"), F.sum("figures").alias("figures"))
    rows = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(o).alias("ocr"), F.lit(f).alias("figure"), F.lit(r).alias("review"), F.lit(w).alias("workers"), F.lit(p).cast("double").alias("price")) for s, o, f, r, w, p in _SCENARIOS])
    return totals.select("*", F.inline(rows))


@query("estimate_stages", f"{_WORK_SQL} SELECT scenario, stage, kind, round(seconds, 6) AS seconds, round(usd, 6) AS usd FROM stages")
def estimate_stages(spark, sf_dir):
    return planning.stage_rows(_work(spark, sf_dir)).select("scenario", "stage", "kind", F.round("seconds", 6).alias("seconds"), F.round("usd", 6).alias("usd"))


@query(
    "estimate_lanes",
    f"""{_WORK_SQL}, lane AS (SELECT scenario, workers, sum(CASE WHEN kind = 'gpu' THEN seconds ELSE 0 END) AS gpu, sum(CASE WHEN kind = 'cloud' THEN seconds ELSE 0 END) AS cloud, sum(CASE WHEN kind = 'cpu' THEN seconds ELSE 0 END) AS cpu, bool_or(usd IS NULL) AS unknown, sum(coalesce(usd, 0)) AS paid FROM stages GROUP BY scenario, workers),
    t AS (SELECT *, cloud / least(4, workers) AS t_cloud, cpu / workers AS t_cpu, greatest(gpu, cloud / least(4, workers), cpu / workers) AS total FROM lane)
    SELECT scenario, round(gpu, 6) AS gpu_seconds, round(cloud, 6) AS cloud_seconds, round(cpu, 6) AS cpu_seconds, round(total, 6) AS total_seconds,
      CASE WHEN total = gpu AND gpu > 0 THEN 'gpu' WHEN total = t_cloud AND cloud > 0 THEN 'cloud' ELSE 'cpu' END AS bottleneck, CASE WHEN unknown THEN NULL ELSE round(paid, 6) END AS total_usd FROM t""",
)
def estimate_lanes(spark, sf_dir):
    """Scenarios side by side: the alternatives are further rows, not a recursion."""
    return planning.lanes(planning.stage_rows(_work(spark, sf_dir)))


_SIZE = "SELECT p_partkey, CAST(p_size * 97 AS DOUBLE) AS w, CAST(50 + p_partkey % 4000 AS DOUBLE) AS h FROM part"


@query(
    "image_tokens",
    f"""WITH s AS ({_SIZE}), o AS (SELECT *, least(1.0, 2048 / w, 2048 / h) AS k FROM s), p AS (SELECT *, CASE WHEN least(w * k, h * k) > 768 THEN 768 / least(w * k, h * k) ELSE 1.0 END AS z,
      greatest(28.0, round_even(w / 28, 0) * 28) AS sw, greatest(28.0, round_even(h / 28, 0) * 28) AS sh FROM o),
    q AS (SELECT *, sw * sh AS area, sqrt(w * h / 12845056.0) AS dn, sqrt(3136.0 / (w * h)) AS up FROM p)
    SELECT p_partkey, CAST(ceil(w * k * z / 512) * ceil(h * k * z / 512) * 170 + 85 AS BIGINT) AS tiles,
      CAST(greatest(28, CASE WHEN area > 12845056 THEN floor(w / dn / 28) * 28 WHEN area < 3136 THEN ceil(w * up / 28) * 28 ELSE sw END) / 28 * (greatest(28, CASE WHEN area > 12845056 THEN floor(h / dn / 28) * 28 WHEN area < 3136 THEN ceil(h * up / 28) * 28 ELSE sh END) / 28) AS BIGINT) AS patches FROM q""",
)
def image_tokens(spark, sf_dir):
    w, h = (F.col("p_size") * 97).cast("double"), (F.col("p_partkey") % 4000 + 50).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", planning.openai_image_tokens(w, h).alias("tiles"), planning.patch_image_tokens(w, h).alias("patches"))


@query("gpu_fit", "WITH m AS (SELECT p_brand, min(p_size) AS params, max(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice / 100 END) AS file_gb FROM part GROUP BY p_brand), r AS (SELECT p_brand, round_even(coalesce(file_gb, CASE params WHEN 3 THEN 3.2 WHEN 4 THEN 3.3 WHEN 7 THEN 5.6 WHEN 32 THEN 20.0 WHEN 72 THEN 45.0 END) * 1.45, 2) AS gb FROM m) SELECT p_brand, gb, gb + 3 <= 36 AS fits FROM r")
def gpu_fit(spark, sf_dir):
    models = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("params"), F.max(F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") / 100)).alias("file_gb"))
    return models.withColumn("gb", planning.resident_gb(F.col("file_gb"), F.col("params"))).select("p_brand", "gb", (F.col("gb") + planning.HEADROOM_GB <= 36).alias("fits"))


# -- run summaries over events: a type is a status, a user is a file

_RUN = "runs AS (SELECT user_id, event_type, value, event_id, CASE WHEN event_id % 5 = 0 THEN 'skipped' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS status FROM events)"


def _runs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_id") % 5 == 0, "skipped").when(F.col("event_id") % 7 == 0, "failed").otherwise("ok"))


@query("run_summary", f"WITH {_RUN} SELECT count(*) AS files, count(*) FILTER (WHERE status = 'ok') AS converted, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, round(CASE WHEN count(*) FILTER (WHERE status <> 'skipped') > 0 THEN count(*) FILTER (WHERE status = 'ok') / count(*) FILTER (WHERE status <> 'skipped') ELSE 1 END, 9) AS success_rate, round(sum(value), 4) AS total_value FROM runs")
def run_summary(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    ok, tried = F.count_if(F.col("status") == "ok"), F.count_if(F.col("status") != "skipped")
    return runs.agg(F.count("*").alias("files"), ok.alias("converted"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.round(F.when(tried > 0, ok / tried).otherwise(1.0), 9).alias("success_rate"), F.round(F.sum("value"), 4).alias("total_value"))


@query("tool_share", "SELECT event_type AS tool, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY event_type")
def tool_share(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


@query("stage_totals", "SELECT event_type AS stage, round(sum(value), 4) AS ms, count(*) AS n FROM events WHERE value > 0 GROUP BY event_type")
def stage_totals(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("value > 0").groupBy(F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 4).alias("ms"), F.count("*").alias("n"))


@query("reliability", f"WITH {_RUN} SELECT event_id, CASE WHEN status = 'skipped' THEN NULL WHEN status = 'failed' THEN 0.0 WHEN event_id % 9 = 0 THEN 0.15 WHEN event_id % 4 = 0 THEN 1.0 ELSE round_even(0.4 + 0.6 * greatest(0.0, least(CAST(event_id % 101 AS DOUBLE), 100.0)) / 100, 3) END AS score FROM runs")
def reliability(spark, sf_dir):
    chars = F.when(F.col("event_id") % 9 == 0, 0).otherwise(100)
    confidence = F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 101).cast("double"))
    return _runs(spark, sf_dir).select("event_id", planning.reliability(F.col("status"), chars, confidence).alias("score"))


@query("job_state_fold", "SELECT CAST(user_id % 50 AS BIGINT) AS job, user_id AS file, arg_max(event_type, (ts, event_id)) AS status, count(*) AS events, round(sum(value), 4) AS seconds, arg_min(event_type, (ts, event_id)) AS first_status FROM events GROUP BY user_id % 50, user_id")
def job_state_fold(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumns({"job": F.col("user_id") % 50, "file": F.col("user_id")})
    return planning.job_state(events)


@query("running_cost", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS so_far FROM events")
def running_cost(spark, sf_dir):
    return planning.running_cost(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", "so_far")


@query("active_gauge", "WITH s AS (SELECT event_id, event_type, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM events), c AS (SELECT event_type, s - least(0, min(s) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS active FROM s) SELECT event_type, CAST(max(active) AS BIGINT) AS peak, CAST(min(active) AS BIGINT) AS floor FROM c GROUP BY event_type")
def active_gauge(spark, sf_dir):
    """How many were at work at most and at least, by type; never below 0."""
    events = table(spark, sf_dir, "events").withColumn("step", F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1))
    return jobs.active(events, "event_type", ["event_id"], "step").groupBy("event_type").agg(F.max("active").alias("peak"), F.min("active").alias("floor"))


@query("history_merge", "WITH live AS (SELECT user_id, max(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY user_id), hist AS (SELECT user_id, max(value) AS value FROM events WHERE event_id % 2 IS DISTINCT FROM 0 GROUP BY user_id) SELECT coalesce(live.user_id, hist.user_id) AS user_id, coalesce(live.value, hist.value) AS value, live.user_id IS NOT NULL AS is_live FROM live FULL JOIN hist ON live.user_id = hist.user_id")
def history_merge(spark, sf_dir):
    """Two job lists merged by id; the live one wins.  Every event is on one of the two."""
    events = table(spark, sf_dir, "events")
    live = events.filter("event_id % 2 = 0").groupBy("user_id").agg(F.max("value").alias("live_value")).withColumn("is_live", F.lit(True))
    hist = events.filter("NOT event_id % 2 <=> 0").groupBy("user_id").agg(F.max("value").alias("hist_value"))
    return live.join(hist, "user_id", "full").select("user_id", F.coalesce("live_value", "hist_value").alias("value"), F.coalesce("is_live", F.lit(False)).alias("is_live"))


@query("events_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    w = F.window("ts", "1 hour")
    return table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("events_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k")
def events_session(spark, sf_dir):
    w = F.session_window("ts", "30 minutes")
    return table(spark, sf_dir, "events").groupBy("user_id", w.alias("w")).agg(F.min("ts").alias("started"), F.count("*").alias("n")).select("user_id", "started", "n")


@query("late_drop", "SELECT event_type, count(*) AS n FROM (SELECT *, max(ts) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events) WHERE ts >= seen - INTERVAL '1 hour' GROUP BY event_type")
def late_drop(spark, sf_dir):
    """Events not over an hour behind the latest one before them."""
    return planning.late_dropped(table(spark, sf_dir, "events"), "event_id", "ts", "1 HOUR").groupBy("event_type").agg(F.count("*").alias("n"))


@query("props_extract", "SELECT event_id, json_extract_string(props, '$.' || k) AS v, k FROM events, (SELECT unnest(json_keys(props)) AS k, event_id AS e FROM events) WHERE e = event_id")
def props_extract(spark, sf_dir):
    props = F.from_json("props", "map<string, string>")
    return table(spark, sf_dir, "events").select("event_id", F.explode(props).alias("k", "v"))


@query("json_pretty", "SELECT event_id, '```json' || chr(10) || CASE WHEN len(json_keys(props)) = 0 THEN '{}' ELSE '{' || chr(10) || array_to_string(list_transform(json_keys(props), lambda k: '  \"' || k || '\": ' || CAST(json_extract(props, '$.' || k) AS VARCHAR)), ',' || chr(10)) || chr(10) || '}' END || chr(10) || '```' AS block FROM events")
def json_pretty(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", parsers.pretty_json("props").alias("block"))


# -- HTML

_STRIP = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>', '', 'g'), '(?is)<style.*?>.*?</style>', '', 'g'), '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</p\\s*>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"


@query("html_strip", f"SELECT page_id, md5(out) AS digest, CAST(length(out) AS INTEGER) AS chars FROM (SELECT page_id, regexp_replace({_STRIP}, '\\A\\s+|\\s+\\z', '', 'g') AS out FROM pages)")
def html_strip(spark, sf_dir):
    out = table(spark, sf_dir, "pages").select("page_id", parsers.html_stripped(F.col("html")).alias("out"))
    return out.select("page_id", F.md5(F.col("out").cast("binary")).alias("digest"), F.length("out").alias("chars"))


@query("html_title", "SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h[12][^>]*>(.*?)</h[12]>', 1), '<[^>]+>', '', 'g'), '\\A\\s+|\\s+\\z', '', 'g'), '') AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", parsers.html_heading(F.col("html")).alias("title"))


@query("html_links", "SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id, href")
def html_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('(?i)<a\\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("html_to_md")
def html_to_md(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", parsers.to_markdown("html").alias("md"))


@query("host_counts", "SELECT regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def host_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1).alias("host")).agg(F.count("*").alias("n"))


@query("conversation_merge", "WITH g AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS fresh FROM conversations), i AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT conv_id, CAST(island AS BIGINT) AS island, role, count(*) AS turns, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM i GROUP BY conv_id, island, role")
def conversation_merge(spark, sf_dir):
    """Neighbouring turns of one role become one block."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("fresh", F.when(F.col("role") == F.lag("role").over(order), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("conv_id", "island", "role").agg(F.count("*").alias("turns"), F.md5(texts.cast("binary")).alias("digest"))


# -- tables and geometry

_CELLS = "cells AS (SELECT l_orderkey AS table_id, l_linenumber AS r, 0 AS c, CAST(l_quantity AS BIGINT) || '' AS text FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 1, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 2, CASE WHEN l_partkey % 3 = 0 THEN 'a|b' ELSE '' END FROM lineitem)"


def _cells(spark, sf_dir) -> DataFrame:
    cells = F.array(F.struct(F.lit(0).alias("c"), F.col("l_quantity").cast("long").cast("string").alias("text")), F.struct(F.lit(1).alias("c"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("text")), F.struct(F.lit(2).alias("c"), F.when(F.col("l_partkey") % 3 == 0, "a|b").otherwise("").alias("text")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("r"), F.inline(cells))


@query("real_tables", f"WITH {_CELLS}, cols AS (SELECT table_id, c, count(*) FILTER (WHERE text <> '') AS filled, count(*) AS n, max(length(text)) AS longest FROM cells GROUP BY table_id, c) SELECT table_id, round(sum(filled) / sum(n), 9) AS fill, count(*) FILTER (WHERE filled >= 2) AS populated FROM cols GROUP BY table_id HAVING max(n) >= 2 AND sum(filled) / sum(n) >= 0.5 AND count(*) FILTER (WHERE filled >= 2) >= 2 AND max(longest) <= 200 AND table_id % 100 <= 80")
def real_tables(spark, sf_dir):
    """Tables worth keeping: enough rows, fill and populated columns, no cell that holds a paragraph, not the whole page."""
    cells = _cells(spark, sf_dir)
    areas = cells.select("table_id", (F.col("table_id") % 100 / 100.0).alias("ratio")).distinct()
    return sheets.real_tables(cells, areas).select("table_id", F.round("fill", 9).alias("fill"), "populated")


@query("gfm_table", f"WITH {_CELLS}, lines AS (SELECT table_id, r, list(text ORDER BY c, text) AS cells FROM cells GROUP BY table_id, r), n AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY r) AS i, max(len(cells)) OVER (PARTITION BY table_id) AS w FROM lines), p AS (SELECT *, list_concat(cells, list_transform(range(w - len(cells)), lambda x: '')) AS full_row FROM n) SELECT table_id, md5(string_agg('| ' || array_to_string(list_transform(full_row, lambda x: replace(x, '|', chr(92) || '|')), ' | ') || ' |' || CASE WHEN i = 1 THEN chr(10) || '| ' || array_to_string(list_transform(full_row, lambda x: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY r)) AS digest, count(*) AS rows FROM p GROUP BY table_id")
def gfm_table(spark, sf_dir):
    """Rows of cells as pipe tables: padded, with a rule under the first."""
    lines = _cells(spark, sf_dir).groupBy("table_id", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "text"))), lambda x: x["text"]).alias("cells"))
    rows = lines.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "cells"))), lambda x: x["cells"]).alias("rows"))
    return rows.select("table_id", F.md5(sheets.markdown_table(F.col("rows")).cast("binary")).alias("digest"), F.size("rows").cast("long").alias("rows"))


@query("span_containment", "WITH s AS (SELECT o_orderkey AS id, o_orderkey * 4 AS a, o_orderkey * 4 + o_custkey % 9 AS b FROM orders), t AS (SELECT l_orderkey * 4 + l_linenumber AS p, l_orderkey * 4 + l_linenumber + 1 AS q FROM lineitem) SELECT s.id, count(*) AS tokens FROM s JOIN t ON s.a <= t.p AND t.q <= s.b AND t.p // 16 BETWEEN s.a // 16 AND s.b // 16 GROUP BY s.id")
def span_containment(spark, sf_dir):
    """Tokens inside spans: a range join by bins of the start, spans in every bin they reach."""
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 4).alias("a"), (F.col("o_orderkey") * 4 + F.col("o_custkey") % 9).alias("b"))
    t = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 4 + F.col("l_linenumber")).alias("p"))
    s = s.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / 16), F.floor(F.col("b") / 16))))
    return s.join(t.withColumn("bin", F.floor(F.col("p") / 16)), "bin").filter("a <= p and p + 1 <= b").groupBy("id").agg(F.count("*").alias("tokens"))


@query("rect_overlap", "WITH b AS (SELECT p_partkey AS id, p_partkey % 100 * 10 AS x, p_partkey // 100 * 10 AS y, p_size AS w FROM part) SELECT a.id, count(*) AS n, CAST(sum((least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.w, b.y + b.w) - greatest(a.y, b.y))) AS BIGINT) AS area FROM b a JOIN b ON a.id <> b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.w AND b.y < a.y + a.w GROUP BY a.id")
def rect_overlap(spark, sf_dir):
    """Overlaps between rectangles: each is put into the grid squares it reaches, and a pair counts in the square of its overlap's corner."""
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100 * 10).alias("x"), (F.floor(F.col("p_partkey") / 100) * 10).alias("y"), F.col("p_size").alias("w"))
    cut = b.withColumn("gx", F.explode(F.sequence(F.floor(F.col("x") / 50), F.floor((F.col("x") + F.col("w")) / 50)))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("y") / 50), F.floor((F.col("y") + F.col("w")) / 50))))
    o = cut.select("gx", "gy", *[F.col(c).alias(f"o_{c}") for c in ("id", "x", "y", "w")])
    left, top = F.greatest("x", "o_x"), F.greatest("y", "o_y")
    right, low = F.least(F.col("x") + F.col("w"), F.col("o_x") + F.col("o_w")), F.least(F.col("y") + F.col("w"), F.col("o_y") + F.col("o_w"))
    met = cut.join(o, ["gx", "gy"]).filter((F.col("id") != F.col("o_id")) & (left < right) & (top < low) & (F.floor(left / 50) == F.col("gx")) & (F.floor(top / 50) == F.col("gy")))
    return met.groupBy("id").agg(F.count("*").alias("n"), F.sum((right - left) * (low - top)).cast("long").alias("area"))


@query("word_gaps", "WITH w AS (SELECT l_orderkey AS line, l_linenumber AS n, l_extendedprice AS x0, l_extendedprice + l_quantity AS x1 FROM lineitem) SELECT line, n, round(lead(x0) OVER (PARTITION BY line ORDER BY n, x0, x1) - x1, 4) AS gap FROM w")
def word_gaps(spark, sf_dir):
    order = Window.partitionBy("line").orderBy("n", "x0", "x1")
    w = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("x0"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("x1"))
    return w.select("line", "n", F.round(F.lead("x0").over(order) - F.col("x1"), 4).alias("gap"))


# -- ranking and merges

def _letters_sql(text: str, letters: str) -> str:
    """Score of letters that stand in a text in order, each at its first place after the one before; null if they don't."""
    places, before = [], "0"
    for ch in letters:
        before = f"({before} + nullif(instr(substr({text}, {before} + 1), '{ch}'), 0))"
        places.append(before)
    gain, run = [], "0"
    for i, at in enumerate(places):
        run = f"CASE WHEN {at} = {places[i - 1]} + 1 THEN {run} + 1 ELSE 0 END" if i else f"CASE WHEN {at} = 0 THEN 1 ELSE 0 END"
        edge = f"CASE WHEN {at} = 1 OR regexp_matches(substr({text}, {at} - 1, 1), '[/:_.\\-]') THEN 4.0 ELSE 0 END"
        gain.append(f"(1.0 + 3.0 * ({run}) + {edge})" if i else f"(1.0 + CASE WHEN {at} = 1 THEN 3.0 ELSE 0 END + {edge})")
    return " + ".join(gain) + f" + 0 * {places[-1]}"


def _fuzzy_sql(q: str, id_: str, name: str) -> str:
    return f"""CASE WHEN starts_with(lower({name}), '{q}') THEN 3e6 - length({name}) WHEN contains(lower({name}), '{q}') THEN 2e6 - (instr(lower({name}), '{q}') - 1) * 1000 - length({name}) WHEN contains(lower({id_}), '{q}') THEN 1e6 - (instr(lower({id_}), '{q}') - 1) * 1000 - length({id_})
      ELSE {_letters_sql(f"lower({id_})", q)} - length({id_}) * 0.01 END"""


@query("fuzzy_rank", f"WITH s AS (SELECT p_partkey, {_fuzzy_sql('ar', 'p_type', 'p_name')} + CASE WHEN p_partkey % 10 = 0 THEN 500 ELSE 0 END AS score FROM part) SELECT p_partkey, round(CAST(score AS DOUBLE), 6) AS score FROM s WHERE score IS NOT NULL")
def fuzzy_rank(spark, sf_dir):
    """All matches of two letters, in all four tiers, preferred ones a little higher."""
    scored = table(spark, sf_dir, "part").select("p_partkey", F.round(planning.fuzzy_score("ar", F.col("p_type"), F.col("p_name"), F.col("p_partkey") % 10 == 0), 6).alias("score"))
    return scored.filter("score is not null").orderBy(F.desc("score"), "p_partkey")


@query("fuzzy_letters", f"WITH s AS (SELECT p_partkey, {_fuzzy_sql('bd1', 'p_brand', 'p_name')} AS score FROM part) SELECT p_partkey, round(CAST(score AS DOUBLE), 6) AS score FROM s WHERE score IS NOT NULL")
def fuzzy_letters(spark, sf_dir):
    """Matches whose letters stand in the id in order."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(planning.fuzzy_score("bd1", F.col("p_brand"), F.col("p_name")), 6).alias("score")).filter("score is not null")


@query("preset_merge", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) UNION ALL SELECT s_suppkey, s_name FROM supplier")
def preset_merge(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return planning.upsert(old, new, "id")


@query("preset_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT s_suppkey FROM supplier")
def preset_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


@query("lru_keep", "SELECT user_id, max(ts) AS last_used FROM events GROUP BY user_id ORDER BY last_used DESC, user_id LIMIT 200")
def lru_keep(spark, sf_dir):
    """The two hundred folders used last: retention is the feature."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_used")).orderBy(F.desc("last_used"), "user_id").limit(200)


@query("regions_topk", "SELECT l_orderkey, l_linenumber, place FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY round_even(l_extendedprice, 1), round_even(l_quantity, 1), l_linenumber) AS place FROM lineitem) WHERE place <= 6")
def regions_topk(spark, sf_dir):
    """The first six regions of a page in reading order, which are all that a page has."""
    order = Window.partitionBy("l_orderkey").orderBy(F.bround("l_extendedprice", 1), F.bround("l_quantity", 1), "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(order).cast("long").alias("place")).filter(F.col("place") <= planning.FIGURES_PER_PAGE)


#: Reviews of a document's first line: as it is, its last letter changed, a line more, blank, two letters more.
_REVIEWED = "CASE doc_id % 5 WHEN 0 THEN t WHEN 1 THEN left(t, length(t) - 1) || '#' WHEN 2 THEN t || chr(10) || 'x' WHEN 3 THEN ' ' ELSE t || '##' END"
_LINE = "SELECT doc_id, left(split_part(text, chr(10), 1), 150) AS t FROM documents"


def _reviewed(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 150).alias("t"))
    return rows.withColumn("r", F.expr(_REVIEWED.replace("chr(10)", "char(10)")))


@query("light_proofreading", f"SELECT doc_id, CASE WHEN trim(t) = '' THEN false WHEN doc_id % 5 = 0 THEN true WHEN doc_id % 5 = 1 THEN right(t, 1) = '#' OR (trim(left(t, length(t) - 1) || '#') <> '' AND (length(t) - 1) / length(t) >= 0.97) WHEN doc_id % 5 = 4 THEN 2 * length(t) / (2 * length(t) + 2) >= 0.97 ELSE false END AS light FROM ({_LINE})")
def light_proofreading(spark, sf_dir):
    """Whether a review is a light edit: as many lines, and a matching-blocks ratio of 0.97 or more."""
    return _reviewed(spark, sf_dir).select("doc_id", review.is_light_proofreading("t", "r").alias("light"))


@query(
    "review_diff",
    "SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 2 END AS INTEGER) AS line, CASE doc_id % 4 WHEN 0 THEN 'two' WHEN 1 THEN 'three / four' ELSE '' END AS before, CASE doc_id % 4 WHEN 0 THEN 'TWO ' || doc_id WHEN 1 THEN '' ELSE 'new / more' END AS after FROM documents WHERE doc_id % 4 < 3",
)
def review_diff(spark, sf_dir):
    """Lines that a review has replaced, removed or added."""
    d = F.col("doc_id")
    reviewed = F.when(d % 4 == 0, F.concat(F.lit("one\nTWO "), d.cast("string"), F.lit("\nthree\nfour"))).when(d % 4 == 1, "one\ntwo").when(d % 4 == 2, "one\nnew\nmore\ntwo\nthree\nfour\n").otherwise("one\ntwo\nthree\nfour")
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(review.line_changes(F.lit("one\ntwo\nthree\nfour"), reviewed)))
