"""Estimates, models and memory, jobs and their events, run summaries and labels, over tables that stand for files and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import estimates, jobs, planning, sinks, summaries
from corpusloom.plans.catalog import query
from corpusloom.plans.data_queries import FILES, _files
from corpusloom.sources.tables import table


def values(spark, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(name: str, columns: str, rows: list[tuple]) -> str:
    """A fixed table as a common table expression."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def picked(listed: tuple[str | None, ...], number):
    """The entry of a fixed list that a number leads to, round and round."""
    return F.element_at(F.array(*[F.lit(x).cast("string") for x in listed]), (number % len(listed) + 1).cast("int"))


def sql_picked(listed: tuple[str | None, ...], number: str) -> str:
    return "[" + ", ".join("NULL" if x is None else "'" + x + "'" for x in listed) + f"][{number} % {len(listed)} + 1]"


# -- models

_MODELS = ("qwen2.5vl:32b", "ollama:qwen2.5vl:7b", "openai:gpt-4o", "tesseract", "gemma3:4b", "groq:llama", "cohere:c4", "", None, " anthropic:opus ")
_ID = "CASE WHEN trim(coalesce(m, '')) = '' OR split_part(trim(m), ':', 1) IN ('openai', 'anthropic', 'google', 'groq', 'mistral', 'openrouter', 'ollama', 'cohere', 'deepseek') THEN trim(coalesce(m, '')) ELSE 'ollama:' || trim(m) END"


@query(
    "model_ids",
    f"""WITH p AS (SELECT p_partkey, {sql_picked(_MODELS, 'p_partkey')} AS m FROM part), i AS (SELECT *, {_ID} AS id FROM p)
    SELECT p_partkey, id, nullif(split_part(id, ':', 1), '') AS provider, starts_with(id, 'ollama:') AND trim(m) <> 'tesseract' AS local, regexp_replace(id, '^ollama:', '') AS tag,
      CASE WHEN id = '' THEN 'none' WHEN trim(m) = 'tesseract' THEN 'cpu' WHEN starts_with(id, 'ollama:') THEN 'gpu' ELSE 'cloud' END AS kind,
      CAST(nullif(regexp_extract(lower(m), '(?:^|[^0-9])([0-9]+)b(?:[^0-9a-z]|$)', 1), '') AS INTEGER) AS params FROM i""",
)
def model_ids(spark, sf_dir):
    """Model names in one spelling, whose they are, and how large by name."""
    m = F.col("m")
    rows = table(spark, sf_dir, "part").select("p_partkey", picked(_MODELS, F.col("p_partkey")).alias("m"))
    return rows.select("p_partkey", estimates.model_id(m).alias("id"), estimates.provider(m).alias("provider"), estimates.is_local(m).alias("local"), estimates.tag(m).alias("tag"), estimates.stage_kind(m).alias("kind"), estimates.parameters(m).alias("params"))


_RAW = ("tesseract", "qwen2.5vl:7b", "llava", "openai:gpt-4o", "openai:new", "google:g", "cohere:c4")
_PRICES = [("openai:gpt-4o", 2.5, 10.0), ("openai:gpt-4o-mini", 0.15, 0.6), ("google:g", 1.0, 2.0)]


@query(
    "resolved_models",
    f"""WITH r AS (SELECT DISTINCT {sql_picked(_RAW, 'p_partkey')} AS raw FROM part) SELECT raw, CASE WHEN raw IN ('qwen2.5vl:7b', 'llava') THEN 'ollama:' || raw ELSE raw END AS id, CASE WHEN raw = 'tesseract' THEN 'cpu' WHEN raw IN ('qwen2.5vl:7b', 'llava') THEN 'local' ELSE 'cloud' END AS kind,
      CASE raw WHEN 'llava' THEN ['not_installed'] WHEN 'openai:new' THEN ['unknown_price'] WHEN 'google:g' THEN ['no_api_key'] WHEN 'cohere:c4' THEN ['unknown_provider'] ELSE [] END AS problems FROM r""",
)
def resolved_models(spark, sf_dir):
    """What stands in the way of a model that someone has typed in."""
    raw = table(spark, sf_dir, "part").select(picked(_RAW, F.col("p_partkey")).alias("raw")).distinct()
    return estimates.resolved(raw, values(spark, "tag string", [("qwen2.5vl:7b",)]), values(spark, "provider string", [("openai",)]), values(spark, "model string, input_per_mtok double, output_per_mtok double", _PRICES))


_PIPES = [
    ("one", "qwen2.5vl:7b", "ollama:qwen2.5vl:7b", None), ("two", "qwen2.5vl:32b", "qwen2.5vl:7b", "openai:gpt-4o"), ("three", "qwen2.5vl:32b", "gemma3:4b", "qwen2.5:72b"), ("cloud", "openai:gpt-4o", "openai:gpt-4o-mini", "anthropic:opus"),
    ("tight", "qwen2.5vl:32b", None, None), ("unknown", "mystery", "qwen2.5vl:7b", None),
]
_LOCAL = """t AS (SELECT pipeline, pos, stage, regexp_replace(m, '^ollama:', '') AS tag FROM (SELECT pipeline, 0 AS pos, 'ocr' AS stage, o AS m FROM p UNION ALL SELECT pipeline, 1, 'figures', f FROM p UNION ALL SELECT pipeline, 2, 'review', r FROM p) WHERE m IS NOT NULL AND NOT regexp_matches(m, '^(openai|anthropic):')),
    d AS (SELECT pipeline, tag, arg_min(stage, pos) AS stage, min(pos) AS pos FROM t GROUP BY pipeline, tag),
    g AS (SELECT *, round_even(coalesce(CASE WHEN tag = 'qwen2.5vl:7b' THEN 6.0 END, CASE regexp_extract(tag, '(?:^|[^0-9])([0-9]+)b$', 1) WHEN '3' THEN 3.2 WHEN '4' THEN 3.3 WHEN '7' THEN 5.6 WHEN '32' THEN 20.0 WHEN '72' THEN 45.0 END) * 1.45, 2) AS gb FROM d)"""


def _pipelines(spark) -> DataFrame:
    return values(spark, "pipeline string, ocr_model string, figure_model string, review_model string", _PIPES)


@query("local_models", f"WITH {sql_values('p', 'pipeline, o, f, r', _PIPES)}, {_LOCAL} SELECT pipeline, tag, stage, CAST(pos AS INTEGER) AS pos FROM d")
def local_models(spark, sf_dir):
    """The different local models of each pipeline, named by the stage that needs them first."""
    return estimates.local_models(_pipelines(spark))


@query(
    "gpu_state",
    f"""WITH {sql_values('p', 'pipeline, o, f, r', _PIPES)}, {_LOCAL}, s AS (SELECT pipeline, count(*) AS models, round_even(sum(coalesce(gb, 0)), 2) AS gb FROM g GROUP BY pipeline),
    a AS (SELECT p.pipeline, coalesce(models, 0) AS models, coalesce(gb, 0) AS resident_gb, round_even(31.5 - coalesce(gb, 0), 2) AS headroom_gb FROM p LEFT JOIN s USING (pipeline))
    SELECT pipeline, models, CAST(resident_gb AS DOUBLE) AS resident_gb, CAST(headroom_gb AS DOUBLE) AS headroom_gb, CASE WHEN models > 1 AND resident_gb > 31.5 THEN 'blocked' WHEN models > 0 AND headroom_gb < 3 THEN 'tight' ELSE 'fits' END AS verdict FROM a""",
)
def gpu_state(spark, sf_dir):
    """Whether a pipeline's local models fit on the GPU together."""
    return estimates.gpu_state(_pipelines(spark), values(spark, "tag string, file_gb double", [("qwen2.5vl:7b", 6.0)]), 31.5)


@query(
    "figure_models",
    "WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'openai:gpt-4o' ELSE 'qwen2.5vl:7b' END AS f, CASE WHEN p_partkey % 2 = 0 THEN 'gemma3:4b' END AS r, CAST(p_size AS DOUBLE) AS fg FROM part) SELECT p_partkey, CASE WHEN f = 'qwen2.5vl:7b' AND 29.0 + CASE WHEN r IS NOT NULL THEN 4.79 ELSE 0 END + fg > 48 THEN 'qwen2.5vl:32b' ELSE f END AS figure_model FROM x",
)
def figure_models(spark, sf_dir):
    """The model that figures really get where memory is short."""
    ocr, figure, review = F.lit("qwen2.5vl:32b"), F.when(F.col("p_partkey") % 5 == 0, "openai:gpt-4o").otherwise("qwen2.5vl:7b"), F.when(F.col("p_partkey") % 2 == 0, "gemma3:4b")
    got = estimates.effective_figure_model(ocr, figure, review, F.lit(29.0), F.col("p_size").cast("double"), F.lit(4.79), F.lit(48.0))
    return table(spark, sf_dir, "part").select("p_partkey", got.alias("figure_model"))


@query("gb_pairs", "WITH x AS (SELECT p_partkey, floor(p_retailprice) / 100 + 0.0003 AS a, floor(p_retailprice) / 100 + 0.0003 + (p_partkey % 5) * 0.0041 * (p_partkey % 3) AS b FROM part) SELECT p_partkey, CASE WHEN printf('%.0f', a) <> printf('%.0f', b) THEN [printf('%.0f', a), printf('%.0f', b)] WHEN printf('%.1f', a) <> printf('%.1f', b) THEN [replace(printf('%.1f', a), '.', ','), replace(printf('%.1f', b), '.', ',')] WHEN printf('%.2f', a) <> printf('%.2f', b) THEN [replace(printf('%.2f', a), '.', ','), replace(printf('%.2f', b), '.', ',')] ELSE ['≈ el límite', '≈ el límite'] END AS pair FROM x")
def gb_pairs(spark, sf_dir):
    """Two sizes with as many decimals as tell them apart."""
    a = F.floor("p_retailprice") / 100 + 0.0003  # away from halves, which engines round differently
    return table(spark, sf_dir, "part").select("p_partkey", estimates.gb_pair(a, a + (F.col("p_partkey") % 5) * 0.0041 * (F.col("p_partkey") % 3)).alias("pair"))


@query(
    "image_sizes",
    """WITH x AS (SELECT p_partkey, p_size * 20.0 AS w, 100.0 + p_partkey % 900 AS h FROM part), y AS (SELECT *, least(1.0, 2200.0 / greatest(w * 300 / 72, h * 300 / 72)) AS k, least(1.0, 1024.0 / greatest(w * 150 / 72, h * 150 / 72)) AS f FROM x)
    SELECT p_partkey, round(w * 300 / 72 * k, 6) AS page_w, round(h * 300 / 72 * k, 6) AS page_h, round(w * 150 / 72 * f, 6) AS figure_w, round(h * 150 / 72 * f, 6) AS figure_h FROM y""",
)
def image_sizes(spark, sf_dir):
    """Pixels that a page, and a figure of half its sides, are rendered at."""
    w, h = F.col("p_size") * 20.0, F.col("p_partkey") % 900 + 100.0
    rows = table(spark, sf_dir, "part").select("p_partkey", estimates.rendered(w, h, estimates.PAGE_PIXELS).alias("p"), estimates.rendered(w, h, estimates.FIGURE_PIXELS, estimates.FIGURE_SHARE).alias("f"))
    return rows.select("p_partkey", F.round("p.w", 6).alias("page_w"), F.round("p.h", 6).alias("page_h"), F.round("f.w", 6).alias("figure_w"), F.round("f.h", 6).alias("figure_h"))


@query("token_rules", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 765 WHEN 1 THEN 1369 END AS tokens, round(CASE WHEN p_partkey % 4 = 1 THEN p_size * 40.0 * 1369 / 4661 ELSE p_size * 40.0 * 1 END, 6) AS seconds FROM part")
def token_rules(spark, sf_dir):
    """Image tokens by provider, and a local model's seconds scaled by them."""
    model = picked(("openai:gpt-4o", "qwen2.5vl:7b", "llava:7b", "tesseract"), F.col("p_partkey"))
    side = F.lit(1024.0)
    return table(spark, sf_dir, "part").select("p_partkey", estimates.image_tokens(side, side, model).cast("int").alias("tokens"), F.round(estimates.local_seconds(F.lit(40.0), F.col("p_size"), side, side, model), 6).alias("seconds"))


@query("representative_files", f"WITH {FILES} SELECT split_part(path, '/', 2) AS selection, arg_min(path, doc_id) AS path FROM files WHERE path LIKE '%.pdf' AND scanned > 0 GROUP BY 1")
def representative_files(spark, sf_dir):
    """The file of a selection that image sizes are taken from."""
    rows = _files(spark, sf_dir).select(F.split("path", "/").getItem(1).alias("selection"), F.col("doc_id").alias("pos"), "path", F.col("scanned").alias("pages"))
    return estimates.representative(rows)


_CHOSEN = [("local", "qwen2.5vl:7b", "qwen2.5vl:7b", None, True, 4), ("hosted", "openai:gpt-4o", "openai:gpt-4o-mini", "openai:gpt-4o", True, 8), ("plain", "tesseract", None, None, False, 2), ("odd", "mistral:pixtral", "tesseract", "google:g", True, 3)]


def _estimate_sql() -> str:
    """Page of 612 by 792 points: 1700 by 2200 pixels and 792.7 by 1024 (figure, half the sides, shrunk)."""
    norm = lambda m: f"CASE WHEN {m} IS NULL OR {m} = '' OR {m} LIKE 'openai:%' OR {m} LIKE 'mistral:%' OR {m} LIKE 'google:%' THEN {m} ELSE 'ollama:' || {m} END"
    kind = lambda m: f"CASE WHEN coalesce({m}, '') = '' THEN 'none' WHEN {m} = 'tesseract' THEN 'cpu' WHEN {m} LIKE '%:%' AND split_part({m}, ':', 1) IN ('openai', 'mistral', 'google') THEN 'cloud' ELSE 'gpu' END"
    tokens = lambda m, tiles, patches: f"CASE WHEN {m} LIKE 'openai:%' THEN {tiles} WHEN {m} LIKE 'qwen2.5vl%' THEN {patches} END"
    stage = lambda name, m, n, tiles, patches, g, c, u, out: (
        f"SELECT pipeline, scenario, workers, '{name}' AS stage, {kind(m)} AS kind, CASE WHEN {n} <= 0 THEN 0 ELSE CASE {kind(m)} WHEN 'gpu' THEN {n} * CAST({g} AS DOUBLE) * coalesce(CAST({tokens(m, tiles, patches)} AS DOUBLE) / {tokens(m, 765, 4661)}, 1) WHEN 'cloud' THEN {n} * CAST({c} AS DOUBLE) WHEN 'cpu' THEN {n} * CAST({u} AS DOUBLE) ELSE 0 END END AS seconds, "
        f"CASE WHEN {kind(m)} = 'cloud' AND {n} > 0 THEN ({tokens(m, tiles, patches)} * {n} * pr.i + {n} * {out} * pr.o) / 1e6 ELSE 0 END AS usd FROM work LEFT JOIN pr ON pr.m = {m}"
    )
    return f"""WITH {FILES}, {sql_values('p', 'pipeline, o, f, r, d, workers', _CHOSEN)}, {sql_values('pr', 'm, i, o', _PRICES)},
    s AS (SELECT *, 'chosen' AS scenario FROM p UNION ALL SELECT pipeline, o, 'openai:gpt-4o-mini', r, d, workers, 'figure_model=openai:gpt-4o-mini' FROM p WHERE d AND coalesce({norm('f')}, '') <> 'openai:gpt-4o-mini'
      UNION ALL SELECT pipeline, 'openai:gpt-4o', f, r, d, workers, 'ocr_model=openai:gpt-4o' FROM p WHERE o <> 'openai:gpt-4o' UNION ALL SELECT pipeline, 'tesseract', f, r, d, workers, 'ocr_model=tesseract' FROM p WHERE o <> 'tesseract'),
    work AS (SELECT s.*, t.*, CASE WHEN d THEN t.figures ELSE 0 END AS nf, t.scanned + t.maths AS nr FROM s, (SELECT sum(pages) AS pages, sum(scanned) AS scanned, sum(CASE WHEN doc_id % 10 = 0 THEN pages ELSE 0 END) AS maths, sum(figures) AS figures FROM files) t),
    st AS (SELECT pipeline, scenario, workers, 'extract' AS stage, 'cpu' AS kind, CAST(pages * 0.1 AS DOUBLE) AS seconds, CAST(0 AS DOUBLE) AS usd FROM work UNION ALL SELECT pipeline, scenario, workers, 'write', 'cpu', CAST(pages * 0.05 AS DOUBLE), 0 FROM work
      UNION ALL {stage('ocr', 'work.o', 'scanned', 765, 4819, 150, 8, 2, 600)} UNION ALL {stage('figures', 'work.f', 'nf', 765, 1036, 40, 5, 0, 150)}
      UNION ALL SELECT pipeline, scenario, workers, 'review', {kind('work.r')}, CASE {kind('work.r')} WHEN 'gpu' THEN nr * 5.0 WHEN 'cloud' THEN nr * 3.0 ELSE 0 END, CASE WHEN {kind('work.r')} = 'cloud' AND nr > 0 THEN (nr * 500 * pr.i + nr * 500 * pr.o) / 1e6 ELSE 0 END FROM work LEFT JOIN pr ON pr.m = work.r)"""


def _estimate(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    totals = _files(spark, sf_dir).agg(F.sum("pages").alias("pages"), F.sum("scanned").alias("scanned"), F.sum(F.when(F.col("doc_id") % 10 == 0, F.col("pages")).otherwise(0)).alias("math_pages"), F.sum("figures").alias("figures"))
    chosen = values(spark, "pipeline string, ocr_model string, figure_model string, review_model string, describe_figures boolean, workers int", _CHOSEN)
    work = estimates.scenarios(chosen).crossJoin(F.broadcast(totals)).withColumns({"width_pt": F.lit(612.0), "height_pt": F.lit(792.0)})  # totals are one row
    return work, values(spark, sinks.PRICE, _PRICES)


@query("estimate_scenarios", f"{_estimate_sql()} SELECT pipeline, scenario, stage, kind, round(seconds, 4) AS seconds, round(usd, 6) AS usd FROM st")
def estimate_scenarios(spark, sf_dir):
    """Stages of every pipeline as chosen and with one model swapped: kind, seconds, price."""
    work, prices = _estimate(spark, sf_dir)
    return estimates.stages(work, prices).select("pipeline", "scenario", "stage", "kind", F.round("seconds", 4).alias("seconds"), F.round("usd", 6).alias("usd"))


@query(
    "estimate_alternatives",
    f"""{_estimate_sql()}, l AS (SELECT pipeline, scenario, workers, sum(CASE WHEN kind = 'gpu' THEN seconds ELSE 0 END) AS gpu, sum(CASE WHEN kind = 'cloud' THEN seconds ELSE 0 END) / least(4, workers) AS cloud, sum(CASE WHEN kind = 'cpu' THEN seconds ELSE 0 END) / workers AS cpu, bool_or(usd IS NULL) AS unknown, sum(usd) AS usd FROM st GROUP BY pipeline, scenario, workers)
    SELECT pipeline, scenario, round(greatest(gpu, cloud, cpu), 4) AS total_seconds, CASE WHEN gpu > 0 AND gpu >= cloud AND gpu >= cpu THEN 'gpu' WHEN cloud > 0 AND cloud >= cpu THEN 'cloud' ELSE 'cpu' END AS bottleneck, CASE WHEN NOT unknown THEN round(usd, 4) END AS total_usd FROM l""",
)
def estimate_alternatives(spark, sf_dir):
    """What else could be chosen, with time, bottleneck and price of each."""
    return estimates.alternatives(*_estimate(spark, sf_dir)).select("pipeline", "scenario", F.round("total_seconds", 4).alias("total_seconds"), "bottleneck", F.round("total_usd", 4).alias("total_usd"))


@query("plan_sentences", f"WITH {FILES}, t AS (SELECT split_part(path, '/', 2) AS source, count(*) AS n, sum(pages) AS pages, sum(scanned) AS vision, sum(figures) AS figures, sum(scanned * 8.0 + figures * 4.0) AS s FROM files GROUP BY 1) SELECT source, 'Plan: ' || n || ' file(s), ' || pages || ' page(s), ' || vision || ' needing the vision model' || CASE WHEN figures > 0 THEN ', ' || figures || ' figure(s) to describe' ELSE '' END || CASE WHEN s >= 60 THEN ' (~' || printf('%.0f', s / 60) || ' min of model time)' ELSE ' (<1 min)' END AS plan FROM t")
def plan_sentences(spark, sf_dir):
    """One line about the batch of each source."""
    rows = _files(spark, sf_dir).withColumn("w", planning.weight(F.col("scanned"), F.col("figures"), F.lit(False))).groupBy(F.split("path", "/").getItem(1).alias("source"))
    sums = rows.agg(F.count("*").alias("n"), F.sum("pages").alias("pages"), F.sum("scanned").alias("vision"), F.sum("figures").alias("figures"), F.sum("w").alias("s"))
    return sums.select("source", estimates.plan_sentence(F.col("n"), F.col("pages"), F.col("vision"), F.col("figures"), F.col("s")).alias("plan"))


@query("worker_counts", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE greatest(1, p_size - 10) END AS workers FROM part")
def worker_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", estimates.workers(F.col("p_size") - 10, picked(("llava:7b", "openai:gpt-4o", "tesseract"), F.col("p_partkey"))).alias("workers"))


# -- jobs: a user is a file of a job, its events tell what befell it

_KINDS = ("file_started", "page_started", "page_done", "file_done", "cost")
_STATUS = ("ok", "warn", "failed", "cancelled")
_EV = f"""ev AS (SELECT 'j' || user_id % 40 AS job, event_id AS seq, {sql_picked(_KINDS, 'event_id')} AS type, CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(user_id // 40 AS INTEGER) END AS index, CAST(event_id % 3 AS INTEGER) AS page, {sql_picked(_STATUS, 'event_id // 5')} AS status,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'e' || event_id % 4 END AS engine, value AS seconds, CASE WHEN event_id % 301 = 0 THEN NULL ELSE value / 100 END AS usd, CASE WHEN event_id // 5 % 3 = 0 THEN 'r' || event_id % 9 END AS reason, CAST(event_id % 30 AS INTEGER) AS pages, CAST(event_id % 4 AS INTEGER) AS changes, CASE WHEN event_id % 37 = 2 THEN 'structure lost' END AS message FROM events),
    fl AS (SELECT DISTINCT 'j' || user_id % 40 AS job, CAST(user_id // 40 AS INTEGER) AS index, CASE WHEN user_id % 3 = 0 THEN 'pdf' WHEN user_id % 3 = 1 THEN 'image' ELSE 'text' END AS kind FROM events)"""


def _events(spark, sf_dir) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    s = lambda c: c.cast("string")
    return e.select(
        F.concat(F.lit("j"), s(F.col("user_id") % 40)).alias("job"), n.alias("seq"), picked(_KINDS, n).alias("type"), F.when(n % 97 != 0, F.expr("cast(user_id div 40 as int)")).alias("index"), (n % 3).cast("int").alias("page"), picked(_STATUS, F.expr("event_id div 5")).alias("status"),
        F.when(n % 11 != 0, F.concat(F.lit("e"), s(n % 4))).alias("engine"), F.col("value").alias("seconds"), F.when(n % 301 != 0, F.col("value") / 100).alias("usd"), (n % 301 == 0).alias("unknown"), F.when(F.expr("event_id div 5") % 3 == 0, F.concat(F.lit("r"), s(n % 9))).alias("reason"),
        (n % 30).cast("int").alias("pages"), (n % 4).cast("int").alias("changes"), F.lit(None).cast("string").alias("level"), F.when(n % 37 == 2, "structure lost").alias("message"), "ts",
    )


def _job_files(spark, sf_dir) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("j"), (u % 40).cast("string")).alias("job"), F.expr("cast(user_id div 40 as int)").alias("index"), F.when(u % 3 == 0, "pdf").when(u % 3 == 1, "image").otherwise("text").alias("kind")).distinct()


_STATES = f"""WITH {_EV}, f AS (SELECT job, index, arg_max(status, seq) FILTER (type = 'file_done') AS st, arg_max(seconds, seq) FILTER (type = 'file_done' AND seconds IS NOT NULL) AS sec, arg_max(reason, seq) FILTER (type = 'file_done' AND reason IS NOT NULL) AS reason, max(seq) FILTER (type = 'file_done' AND reason IS NOT NULL) AS rat,
      max(seq) FILTER (type = 'file_done' AND status = 'ok' AND reason IS NULL) AS okat, arg_max(pages, seq) FILTER (type = 'file_started') AS pages, max(seq) FILTER (type = 'file_started') AS started, max(seq) FILTER (type = 'file_done') AS done, arg_max(engine, seq) FILTER (type = 'page_done' AND engine IS NOT NULL) AS engine, sum(changes) FILTER (type = 'page_done') AS changes FROM ev WHERE index IS NOT NULL GROUP BY job, index),
    states AS (SELECT job, index, kind, CASE WHEN started IS NOT NULL AND coalesce(done, -1) < started THEN 'running' ELSE coalesce(st, 'queued') END AS status, round_even(sec, 2) AS seconds, CASE WHEN coalesce(okat, -1) > coalesce(rat, -1) THEN NULL ELSE reason END AS reason, CASE WHEN kind = 'pdf' THEN pages END AS pages, engine, CAST(coalesce(changes, 0) AS BIGINT) AS changes FROM fl LEFT JOIN f USING (job, index))"""


@query("job_files", f"{_STATES} SELECT job, index, kind, status, seconds, reason, pages, engine, changes, coalesce(engine, CASE WHEN kind IN ('pdf', 'image') AND index % 2 = 0 THEN 'model' END, 'none') AS used FROM states")
def job_files(spark, sf_dir):
    """Every file's state as the events leave it, and the engine that counts."""
    states = jobs.file_states(_job_files(spark, sf_dir), _events(spark, sf_dir))
    return states.withColumn("used", jobs.engine_used(F.col("kind"), F.col("engine"), F.lit("model"), F.col("index") % 2 == 0))


@query("job_totals", f"{_STATES}, m AS (SELECT job, bool_or(usd IS NULL) AS unknown, sum(usd) AS usd FROM ev WHERE type = 'cost' GROUP BY job) SELECT job, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'warn') AS warn, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled, any_value(CASE WHEN NOT unknown THEN round(round_even(usd, 4), 3) END) AS usd FROM states LEFT JOIN m USING (job) GROUP BY job")
def job_totals(spark, sf_dir):
    """Files by outcome and money of every job; one unknown price makes the sum unknown."""
    events = _events(spark, sf_dir)
    money = jobs.money(events).withColumn("usd", F.round("usd", 3))
    return jobs.totals(jobs.file_states(_job_files(spark, sf_dir), events)).join(money, "job", "left")


@query(
    "job_fallbacks",
    f"""WITH {_EV}, pg AS (SELECT job, index, page, arg_min(engine, seq) FILTER (type = 'page_started' AND engine IS NOT NULL) AS asked, arg_max(engine, seq) FILTER (type = 'page_done' AND engine IS NOT NULL) AS got, bool_or(message = 'structure lost') AS lost FROM ev WHERE index IS NOT NULL GROUP BY job, index, page),
    r AS (SELECT job, index, arg_min(reason, seq) FILTER (reason IS NOT NULL) AS first_reason FROM ev WHERE index IS NOT NULL GROUP BY job, index)
    SELECT job, index, count(*) FILTER (asked IS NOT NULL AND got IS NOT NULL AND asked <> got) AS fallbacks, any_value(first_reason) AS first_reason, coalesce(list_sort(list(DISTINCT page) FILTER (lost)), []) AS lost_pages FROM pg JOIN r USING (job, index) GROUP BY job, index""",
)
def job_fallbacks(spark, sf_dir):
    """Pages done by another engine than asked, the first reason told, pages that lost their structure."""
    return jobs.recorded(_events(spark, sf_dir))


@query("job_replay", f"WITH {_EV} SELECT job, seq, type FROM ev WHERE seq > 500")
def job_replay(spark, sf_dir):
    """What a subscriber that has seen an event still gets."""
    return jobs.replayed(_events(spark, sf_dir), F.lit(500)).select("job", "seq", "type")


@query("event_log", "SELECT event_id AS seq, CASE event_id % 6 WHEN 0 THEN 'file_started' WHEN 1 THEN 'page_started' WHEN 2 THEN 'page_done' WHEN 3 THEN 'file_done' WHEN 4 THEN 'cost' ELSE 'log' END AS type, CASE WHEN event_id % 6 < 4 THEN CAST(user_id AS INTEGER) END AS index, CASE WHEN event_id % 6 IN (1, 2) THEN 7 END AS page, CASE WHEN event_id % 6 = 4 THEN event_id % 12 = 4 END AS unknown FROM events")
def event_log(spark, sf_dir):
    """Events as the engine emits them, one schema for all types."""
    e = table(spark, sf_dir, "events").withColumns({"job": F.lit("j"), "seq": F.col("event_id")})
    i, k = F.col("user_id"), F.col("event_id") % 6
    usd = F.when(F.col("event_id") % 12 != 4, F.col("value"))
    made = F.when(k == 0, jobs.file_started(i, F.lit(3))).when(k == 1, jobs.page_started(i, F.lit(7), F.lit("m"))).when(k == 2, jobs.page_done(i, F.lit(7), F.lit("m"), F.col("value"), F.lit(0))).when(k == 3, jobs.file_done(i, F.lit("ok"), F.col("value"), F.lit(None))).when(k == 4, jobs.cost(usd)).otherwise(jobs.log(F.lit("info"), F.lit("text")))
    return e.select(made.alias("e")).select("e.seq", "e.type", "e.index", "e.page", "e.unknown")


@query("job_outcomes", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'cancelled' WHEN p_partkey % 5 = 0 THEN 'failed' WHEN p_partkey % 2 = 0 THEN 'warn' ELSE 'ok' END AS outcome FROM part")
def job_outcomes(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", jobs.outcome(k % 7 == 0, k % 5 == 0, k % 2 == 0).alias("outcome"))


@query(
    "new_jobs",
    "SELECT 'j' || doc_id % 9 AS job, CAST(row_number() OVER (PARTITION BY doc_id % 9 ORDER BY '/in/f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.xmind' ELSE '.Txt' END) - 1 AS INTEGER) AS index, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'mindmap' ELSE 'text' END AS kind, '/out/f' || doc_id || '.md' AS output, 'queued' AS status FROM documents",
)
def new_jobs(spark, sf_dir):
    """The files of new jobs before anything has run."""
    d = F.col("doc_id")
    path = F.concat(F.lit("/in/f"), d.cast("string"), picked((".pdf", ".xmind", ".Txt"), d))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("j"), (d % 9).cast("string")).alias("job"), path.alias("path"))
    return jobs.created(rows, F.lit("/out")).drop("path")


@query("recent_jobs", "WITH h AS (SELECT o_orderkey AS job, o_orderdate AS started, CASE WHEN o_custkey % 5 > 0 THEN o_orderdate + INTERVAL 1 HOUR END AS finished FROM orders), l AS (SELECT job, started, CAST(NULL AS TIMESTAMP) AS finished FROM h WHERE job % 3 = 0) SELECT job, started, finished FROM (SELECT * FROM l UNION ALL SELECT * FROM h WHERE job NOT IN (SELECT job FROM l)) ORDER BY coalesce(finished, started) DESC, job LIMIT 50")
def recent_jobs(spark, sf_dir):
    """The fifty latest jobs; a live one hides its entry in the history."""
    history = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("started"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("finished"))
    live = history.filter("job % 3 = 0").withColumn("finished", F.lit(None).cast("timestamp"))
    return jobs.recent(live, history, 50)


@query("history_jobs", "SELECT o_orderkey AS job, CASE WHEN o_custkey % 4 IN (0, 1) THEN 'cancelled' ELSE 'done' END AS status FROM orders WHERE o_custkey % 5 > 0")
def history_jobs(spark, sf_dir):
    """Jobs from the history as they can be looked at again."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), picked(("running", "queued", "done", "done"), F.col("o_custkey")).alias("status"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderdate")).alias("finished"))
    return jobs.rehydrated(rows).select("job", "status")


@query("retry_guards", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [] WHEN p_partkey % 2 = 0 THEN [2, 5] WHEN p_size % 7 IN (2, 5) THEN [p_size % 7] ELSE [] END AS lost FROM part")
def retry_guards(spark, sf_dir):
    """Pages with edits that a retry would lose."""
    page = F.when(F.col("p_partkey") % 2 != 0, (F.col("p_size") % 7).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", jobs.retry_refused(F.array(F.lit(5), F.lit(2)), page, F.col("p_partkey") % 3 == 0).alias("lost"))


@query("patched_pipelines", "SELECT c_custkey AS job, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS ocr_model, c_name AS review_model FROM customer")
def patched_pipelines(spark, sf_dir):
    """Pipelines with the fields that a retry changes."""
    pipes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job"), F.col("c_mktsegment").alias("ocr_model"), F.col("c_name").alias("review_model"))
    patches = pipes.filter("job % 3 = 0").select("job", F.lit("new").alias("ocr_model"), F.lit(None).cast("string").alias("review_model"))
    return jobs.patched(pipes, patches, ("ocr_model", "review_model"))


_STEP = "CASE WHEN event_id % 3 = 0 THEN 1 ELSE -1 END"


@query(
    "clamped_gauge",
    f"""WITH s AS (SELECT event_id, event_type, sum({_STEP}) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)
    SELECT event_id, event_type, CAST(s - least(0, min(s) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS active FROM s""",
)
def clamped_gauge(spark, sf_dir):
    """How many are at work: a running sum that never falls below 0."""
    events = table(spark, sf_dir, "events").withColumn("step", F.expr(_STEP))
    return jobs.active(events, "event_type", ["event_id"], "step", 512).select("event_id", "event_type", "active")


_ACTION = "CASE event_id % 3 WHEN 0 THEN 'wait' WHEN 1 THEN 'acquire' ELSE 'release' END"


@query("permit_gauges", f"WITH e AS (SELECT user_id AS kind, event_id AS seq, {_ACTION} AS a FROM events) SELECT kind, seq, sum(CASE a WHEN 'acquire' THEN 1 WHEN 'release' THEN -1 ELSE 0 END) OVER w AS held, greatest(0, sum(CASE a WHEN 'wait' THEN 1 WHEN 'acquire' THEN -1 ELSE 0 END) OVER w) AS waiting FROM e WINDOW w AS (PARTITION BY kind ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def permit_gauges(spark, sf_dir):
    """Permits held and waited for after every event."""
    return jobs.permits(table(spark, sf_dir, "events").select(F.col("user_id").alias("kind"), F.col("event_id").alias("seq"), F.expr(_ACTION).alias("action")))


@query("file_deadlines", "WITH d AS (SELECT l_orderkey AS batch, l_linenumber * 1000000 + l_partkey AS file, CAST(l_linenumber * 10 AS DOUBLE) AS begun, CASE WHEN l_partkey % 5 > 0 THEN 25.0 END AS budget, l_quantity AS seconds FROM lineitem), t AS (SELECT *, coalesce(seconds > budget, false) AS timed_out FROM d) SELECT batch, file, begun + budget AS deadline, timed_out, sum(CAST(timed_out AS INTEGER)) OVER (PARTITION BY batch ORDER BY begun, file, timed_out ROWS UNBOUNDED PRECEDING) < 2 AS goes_on FROM t")
def file_deadlines(spark, sf_dir):
    """When a file's time is up, and whether the batch goes on with files that hang."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("file"), (F.col("l_linenumber") * 10).cast("double").alias("at"), F.when(F.col("l_partkey") % 5 > 0, 25.0).alias("budget"), F.col("l_quantity").alias("seconds"))
    return jobs.deadlines(rows, 2).select("batch", "file", "deadline", "timed_out", "goes_on")


@query(
    "settings_problems",
    "SELECT p_partkey AS id, list_filter([CASE WHEN p_size - 5 < 1 THEN 'workers must be 1 or more' END, CASE WHEN p_partkey % 700 NOT BETWEEN 72 AND 600 THEN 'dpi must be between 72 and 600' END, CASE WHEN p_partkey % 3 = 0 THEN 'min_confidence must be between 0 and 100' END, CASE WHEN p_partkey % 4 = 1 AND p_partkey % 2 = 1 AND p_partkey % 5 = 0 THEN 'a fixed output needs a folder' END, CASE WHEN p_partkey % 4 > 1 THEN 'output_mode must be sibling or fixed' END], lambda x: x IS NOT NULL) AS problems FROM part",
)
def settings_problems(spark, sf_dir):
    """What doesn't go together in settings."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), (F.col("p_size") - 5).alias("workers"), (k % 700).alias("dpi"), F.when(k % 3 != 0, 50).alias("min_confidence"), picked(("sibling", "fixed", "other", None), k).alias("output_mode"), F.when(k % 5 != 0, "/out").otherwise(" ").alias("output_fixed"))
    return jobs.settings_problems(rows)


@query("preset_replace", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'changed' END AS name, c_custkey > 100 AS own FROM customer WHERE c_custkey % 5 > 0 AND (c_custkey > 100 OR c_custkey % 2 = 1) AND c_custkey <> 131")
def preset_replace(spark, sf_dir):
    """All presets replaced: built-in ones are stored where they differ, the others are gone or the user's; then one is deleted."""
    base = table(spark, sf_dir, "customer")
    builtin = base.filter("c_custkey <= 100").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    wanted = base.filter("c_custkey % 5 > 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("changed").alias("name"))
    return jobs.deleted_preset(jobs.replaced_presets(builtin, wanted, ("name",)), 131)


@query("pipeline_equality", "SELECT p_partkey, p_partkey % 3 < 2 AS same FROM part")
def pipeline_equality(spark, sf_dir):
    """Pipelines that differ in the spelling of a model only are equal."""
    other = picked(("ollama:qwen2.5vl:7b", " qwen2.5vl:7b", "openai:gpt-4o"), F.col("p_partkey"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("qwen2.5vl:7b").alias("ocr_model"), other.alias("figure_model"))
    return rows.select("p_partkey", (estimates.normalised_pipeline(("ocr_model",))["ocr_model"] == estimates.normalised_pipeline(("figure_model",))["figure_model"]).alias("same"))


# -- summaries: a user is a source, its events are spans, notes and records

_TRACE = "ms AS (SELECT user_id AS source, event_id AS span, CASE WHEN event_id % 4 > 0 AND event_id > 4 THEN event_id - event_id % 4 END AS parent, event_type AS name, round(value, 2) AS ms FROM events)"


def _spans(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), n.alias("span"), F.when((n % 4 > 0) & (n > 4), n - n % 4).alias("parent"), F.col("event_type").alias("name"), F.round("value", 2).alias("ms"))


@query("span_tree", f"WITH {_TRACE}, i AS (SELECT source, parent AS span, sum(ms) AS inner_ms FROM ms WHERE parent IS NOT NULL GROUP BY source, parent) SELECT source, span, name, round(ms - coalesce(inner_ms, 0), 2) AS self_ms FROM ms LEFT JOIN i USING (source, span)")
def span_tree(spark, sf_dir):
    """Spans with the time that isn't that of spans inside them."""
    return summaries.self_times(_spans(spark, sf_dir)).select("source", "span", "name", F.round("self_ms", 2).alias("self_ms"))


@query("stage_order", f"WITH {_TRACE} SELECT name, round(sum(ms), 1) AS ms FROM ms GROUP BY name HAVING sum(ms) > 0")
def stage_order(spark, sf_dir):
    """Stages over all files, the longest first."""
    return summaries.stage_order(summaries.span_totals(_spans(spark, sf_dir))).select("name", F.round("ms", 1).alias("ms"))


_NOTES = "n AS (SELECT user_id AS source, event_id AS pos, CASE WHEN event_id % 4 > 0 THEN event_type ELSE '' END AS kind, CASE WHEN event_id % 3 = 0 THEN value END AS confidence FROM events), t AS (SELECT user_id AS source, min(event_id) AS pos, CASE WHEN user_id % 5 > 0 THEN 'c' || user_id % 4 END AS converter FROM events GROUP BY user_id)"


def _notes(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), n.alias("pos"), F.when(n % 4 > 0, F.col("event_type")).otherwise("").alias("kind"), F.when(n % 3 == 0, F.col("value")).alias("confidence"))


def _traces(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source")).agg(F.min("event_id").alias("pos")).withColumn("converter", F.when(F.col("source") % 5 > 0, F.concat(F.lit("c"), (F.col("source") % 4).cast("string"))))


@query("tool_counts", f"WITH {_NOTES}, a AS (SELECT kind AS tool, pos FROM n WHERE kind <> '' UNION ALL SELECT 'converter.' || converter, pos FROM t WHERE converter IS NOT NULL) SELECT tool, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct, min(pos) AS first FROM a GROUP BY tool")
def tool_counts(spark, sf_dir):
    """Tools that were used, notes and converters, most used first."""
    return summaries.tool_counts(_notes(spark, sf_dir), _traces(spark, sf_dir))


_RECORDS = f"""{_NOTES}, m AS (SELECT user_id AS source, min(event_id) AS pos, CASE WHEN user_id % 7 = 0 THEN 'failed' WHEN user_id % 5 = 0 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN user_id % 11 = 0 THEN 0 ELSE user_id END AS chars, CASE WHEN user_id % 9 > 0 THEN count(*) * 10 END AS duration_ms FROM events GROUP BY user_id),
    c AS (SELECT source, avg(confidence) AS c FROM n WHERE confidence IS NOT NULL GROUP BY source),
    r AS (SELECT m.*, t.converter, CASE WHEN status = 'skipped' THEN NULL WHEN status = 'failed' THEN 0.0 WHEN chars <= 0 THEN 0.15 WHEN c IS NULL THEN 1.0 ELSE round_even(0.4 + 0.6 * greatest(0.0, least(c, 100.0)) / 100, 3) END AS reliability FROM m LEFT JOIN t USING (source) LEFT JOIN c USING (source))"""


def _rows(spark, sf_dir) -> DataFrame:
    u = F.col("user_id")
    m = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("pos"), F.count("*").alias("n"))
    m = m.select(u.alias("source"), "pos", F.when(u % 7 == 0, "failed").when(u % 5 == 0, "skipped").otherwise("ok").alias("status"), F.when(u % 11 == 0, 0).otherwise(u).alias("chars"), F.when(u % 9 > 0, F.col("n") * 10).alias("duration_ms"))
    return summaries.file_rows(m, _traces(spark, sf_dir), _notes(spark, sf_dir))


@query("summary_rows", f"WITH {_RECORDS} SELECT source, status, converter, duration_ms, CAST(round(reliability, 2) AS DOUBLE) AS reliability FROM r")
def summary_rows(spark, sf_dir):
    """One row a file: record, converter, reliability; failed ones first."""
    return _rows(spark, sf_dir).select("source", "status", "converter", "duration_ms", F.round("reliability", 2).alias("reliability"))


@query("summary_page", f"WITH {_RECORDS} SELECT source, status FROM r ORDER BY status <> 'failed', coalesce(duration_ms, 0) DESC, pos LIMIT 200")
def summary_page(spark, sf_dir):
    """The files that a report shows: its first two hundred rows."""
    return _rows(spark, sf_dir).select("source", "status").limit(summaries.FILE_ROWS)


@query(
    "run_figures",
    f"""WITH {_RECORDS} SELECT count(*) FILTER (status = 'ok') AS converted, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, round(count(*) FILTER (status = 'ok') / count(*) FILTER (status <> 'skipped'), 4) AS success_rate, round(avg(reliability), 2) AS reliability, count(reliability) AS rated,
      count(duration_ms) FILTER (status <> 'skipped') AS timed, CAST(sum(duration_ms) FILTER (status <> 'skipped') AS DOUBLE) AS sum_ms, round(avg(duration_ms) FILTER (status <> 'skipped'), 2) AS mean_ms, CAST(max(duration_ms) FILTER (status <> 'skipped') AS DOUBLE) AS max_ms FROM r""",
)
def run_figures(spark, sf_dir):
    """A run in one row: outcomes, success rate, reliability, timings."""
    return summaries.run_summary(_rows(spark, sf_dir)).withColumn("reliability", F.round("reliability", 2))


_LABELS = (0, 5, 900, 1024, 1536, 999999, 1048576, 5368709120)


@query(
    "labels",
    f"""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size * 40 END AS ms, [{', '.join(map(str, _LABELS))}][p_partkey % {len(_LABELS)} + 1] AS b, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 6 = 1 THEN 0.004 ELSE p_size / 4.0 END AS usd, p_size * 97 AS s FROM part)
    SELECT p_partkey, CASE WHEN ms IS NULL THEN '—' WHEN ms >= 1000 THEN printf('%.2f', ms / 1000) || 's' ELSE CAST(ms AS VARCHAR) || 'ms' END AS took, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', b / 1024) || ' KB' WHEN b < 1073741824 THEN printf('%.1f', b / 1048576) || ' MB' ELSE printf('%.1f', b / 1073741824) || ' GB' END AS size,
      CASE WHEN usd IS NULL THEN '?' WHEN usd > 0 AND usd < 0.01 THEN '<$0.01' ELSE '$' || printf('%.2f', usd) END AS paid, CASE WHEN s >= 3600 THEN s // 3600 || ' h ' || s % 3600 // 60 || ' min' WHEN s >= 60 THEN s // 60 || ' min ' || s % 60 || ' s' ELSE s || ' s' END AS time,
      CASE WHEN p_partkey % 3 = 0 THEN '—' ELSE CAST(p_size * 2 AS VARCHAR) || '%' END AS rate FROM x JOIN part USING (p_partkey)""",
)
def labels(spark, sf_dir):
    """Times, sizes, prices and shares as people read them."""
    k = F.col("p_partkey")
    ms, size = F.when(k % 9 != 0, F.col("p_size") * 40), F.element_at(F.array(*[F.lit(x).cast("long") for x in _LABELS]), (k % len(_LABELS) + 1).cast("int"))
    usd = F.when(k % 6 == 0, None).when(k % 6 == 1, 0.004).otherwise(F.col("p_size") / 4.0)
    return table(spark, sf_dir, "part").select("p_partkey", summaries.duration_label(ms).alias("took"), summaries.size_label(size).alias("size"), summaries.usd_label(usd).alias("paid"), summaries.time_label(F.col("p_size") * 97).alias("time"), summaries.percent_label(F.when(k % 3 != 0, F.col("p_size") * 2 / 100)).alias("rate"))


@query("html_escapes", "SELECT doc_id, md5(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest, CASE WHEN doc_id % 3 = 0 THEN 'a/' || doc_id WHEN doc_id % 3 = 1 THEN '…/c/d/' || doc_id ELSE 'x/' || doc_id END AS short FROM (SELECT doc_id, '<a href=\"x\">&''' || text AS t FROM documents)")
def html_escapes(spark, sf_dir):
    """Text for HTML, and paths short enough for a report."""
    d = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/out/a/"), d)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/z/b/c/d/"), d)).otherwise(F.concat(F.lit("x/"), d))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(summaries.escaped(F.concat(F.lit("<a href=\"x\">&'"), F.col("text"))).cast("binary")).alias("digest"), summaries.short_path(path, F.lit("/out")).alias("short"))


@query("document_texts", "SELECT doc_id, md5('---' || chr(10) || 'source: \"a\"' || chr(10) || '---' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '> note' || chr(10) || chr(10) ELSE '' END || regexp_replace(text, '\\s+\\z', '') || chr(10)) AS digest FROM documents")
def document_texts(spark, sf_dir):
    """Documents as they are written: frontmatter, note, body."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(sinks.document_text(F.lit('---\nsource: "a"\n---\n'), F.when(F.col("doc_id") % 2 == 0, "> note\n"), F.col("text")).cast("binary")).alias("digest"))


# -- inspections and capabilities


@query(
    "inspect_files",
    """WITH pg AS (SELECT 'f' || l_orderkey AS path, l_partkey % 3 = 0 AS needs_ocr, CASE WHEN l_partkey % 3 = 0 AND l_suppkey % 2 = 0 THEN 'vision' ELSE 'native' END AS route, l_suppkey % 5 = 0 AS math, l_linenumber % 3 AS figures, l_partkey AS chars FROM lineitem),
    s AS (SELECT path, count(*) AS pages, count(*) FILTER (needs_ocr) AS scanned, count(*) FILTER (route = 'vision') AS vision, count(*) FILTER (math) AS maths, sum(figures) AS figures, sum(chars) AS chars FROM pg GROUP BY path)
    SELECT 'f' || o_orderkey AS path, coalesce(pages, 0) AS pages, coalesce(scanned, 0) AS scanned, coalesce(vision, 0) AS vision, coalesce(maths, 0) AS maths, CAST(coalesce(figures, 0) AS BIGINT) AS figures, CAST(coalesce(chars, 0) AS BIGINT) AS chars, CAST(coalesce(vision, 0) * 8.0 + coalesce(figures, 0) * 4.0 AS DOUBLE) AS weight, CASE WHEN coalesce(scanned, 0) * 2 > coalesce(pages, 0) THEN 'scanned' ELSE 'text' END AS kind FROM orders LEFT JOIN s ON s.path = 'f' || o_orderkey""",
)
def inspect_files(spark, sf_dir):
    """What every file of a batch holds and costs; files without pages count as nothing."""
    rows, p, s = table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_suppkey")
    name = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    pages = rows.select(name("l_orderkey").alias("path"), (p % 3 == 0).alias("needs_ocr"), F.when((p % 3 == 0) & (s % 2 == 0), "vision").otherwise("native").alias("route"), (s % 5 == 0).alias("math"), (F.col("l_linenumber") % 3).alias("figures"), p.alias("chars"))
    return planning.inspected(table(spark, sf_dir, "orders").select(name("o_orderkey").alias("path")), pages)


@query("native_pages", "SELECT conv_id AS doc, turn AS page, md5(text) AS digest FROM conversations WHERE turn % 3 > 0")
def native_pages(spark, sf_dir):
    """Pages that need no OCR, from the snapshots of their documents."""
    snapshots = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.collect_list(F.struct(F.col("turn").alias("page"), F.col("text").alias("markdown"), (F.col("turn") % 3 == 0).alias("needs_ocr"))).alias("pages"))
    return planning.native_pages(snapshots).select("doc", "page", F.md5(F.col("markdown").cast("binary")).alias("digest"))


@query("loaded_models", "SELECT p_partkey AS tag, EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey) AS loaded FROM part")
def loaded_models(spark, sf_dir):
    """Installed models, and whether each is loaded."""
    return estimates.loaded(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tag")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tag")))


@query("model_stages", "WITH m AS (SELECT DISTINCT p_brand AS model, p_brand LIKE '%1%' AS vision, p_brand LIKE '%2%' AS text FROM part UNION ALL SELECT 'tesseract', false, false) SELECT stage, list_sort(list(DISTINCT model)) AS models FROM (SELECT model, 'ocr' AS stage FROM m WHERE vision OR model = 'tesseract' UNION ALL SELECT model, 'figures' FROM m WHERE vision UNION ALL SELECT model, 'review' FROM m WHERE text) GROUP BY stage")
def model_stages(spark, sf_dir):
    """Which models can do what."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model")).distinct()
    models = brands.select("model", F.contains("model", F.lit("1")).alias("vision"), F.contains("model", F.lit("2")).alias("text"))
    return estimates.capabilities(models.unionByName(values(spark, "model string, vision boolean, text boolean", [("tesseract", False, False)])))
