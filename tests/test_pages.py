"""Figures, words and gauges against plain versions of the same rules; job states against events taken one by one."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import estimates, figures, jobs, pages, planning, review

R = random.Random(9)


def test_clusters_against_pairwise_union():
    for _ in range(200):
        boxes = []
        for _ in range(R.randrange(0, 12)):
            x, y = R.uniform(0, 300), R.uniform(0, 300)
            boxes.append(figures.Box(x, y, x + R.uniform(1, 60), y + R.uniform(1, 60)))
        want = list(boxes)
        while True:  # join any two that come within the gap, until none do
            pair = next(((a, b) for i, a in enumerate(want) for b in want[:i] if a.meets(b.grown(figures.GAP))), None)
            if pair is None:
                break
            want = [x for x in want if x not in pair] + [pair[0].joined(pair[1])]
        assert sorted(map(repr, figures.clusters(boxes))) == sorted(map(repr, want))


def test_figure_rules(spark):
    page = (600.0, 800.0)
    vector = lambda seq, x0, y0, x1, y1, filled=False: (1, seq, "vector", filled, x0, y0, x1, y1, *page)
    shapes = [vector(1, 100.0, 100.0, 180.0, 160.0), vector(2, 185.0, 100.0, 260.0, 200.0), vector(3, 0.0, 0.0, 600.0, 3.0), vector(4, 0.0, 0.0, 590.0, 790.0), vector(5, 400.0, 700.0, 420.0, 720.0), (1, 6, "raster", False, 100.0, 400.0, 200.0, 500.0, *page)]
    schema = "page long, seq int, kind string, filled boolean, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double"
    blocks = [(1, 1, "axis", 100.0, 205.0, 140.0, 215.0), (1, 2, "a" * 60, 100.0, 600.0, 500.0, 640.0), (1, 3, None, 0.0, 0.0, 1.0, 1.0)]
    texts = spark.createDataFrame(blocks, "page long, seq int, text string, x0 double, y0 double, x1 double, y1 double")
    got = [(r["index"], r.kind, r.x0, r.y0, r.x1, r.y1) for r in figures.figure_regions(spark.createDataFrame(shapes, schema), texts).collect()]
    # the two parts are one figure, with its label; the rule, the frame and the lone bullet are none; the image is one of its own
    assert got == [(1, "vector", 100.0, 100.0, 260.0, 215.0), (2, "raster", 100.0, 400.0, 200.0, 500.0)]
    themed = [vector(1, 0.0, 100.0, 590.0, 160.0, True), vector(2, 0.0, 150.0, 590.0, 260.0, True)]
    assert figures.figure_regions(spark.createDataFrame(themed, schema), texts).count() == 0
    over = [vector(1, 100.0, 590.0, 300.0, 650.0), vector(2, 100.0, 590.0, 480.0, 652.0)]
    assert figures.figure_regions(spark.createDataFrame(over, schema), texts).count() == 0  # prose lies under it


def test_figures_page_by_page_in_batches(spark):
    """Many pages take no call each, a page may go over several batches, and equal seq leaves nothing open."""
    schema = "page long, seq int, kind string, filled boolean, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double"
    image = lambda page, x: (page, 1, "raster", None, x, 100.0, x + 100.0, 200.0, 600.0, 800.0)
    chain = [0.0, 90.0, 180.0]  # the middle one joins both
    texts = spark.createDataFrame([(7, 1, "\u00a0axis\n", 0.0, 0.0, None, 1.0)], "page long, seq int, text string, x0 double, y0 double, x1 double, y1 double")
    pages = [None, *range(40)]
    asked = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for order in ((0, 1, 2), (0, 2, 1), (2, 0, 1)):
            shapes = spark.createDataFrame([image(p, chain[i]) for p in pages for i in order], schema).coalesce(1)
            found = figures.figure_regions(shapes, texts)
            got = sorted((tuple(r) for r in found.collect()), key=repr)
            assert got == sorted(((p, 1, "raster", 0.0, 100.0, 280.0, 200.0) for p in pages), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", asked)
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_rejoined_words(spark):
    rows, text = [], []
    for line in range(4):
        x = 0.0
        for i in range(8):
            rows.append((1, 0, line, x, line * 12.0, x + 10.0, line * 12.0 + 10.0, "ab"))
            x += 12.0 if i % 2 == 0 else 20.0
        text.append("abab abab abab abab")
    schema = "page int, block int, line int, x0 double, y0 double, x1 double, y1 double, word string"
    split = spark.createDataFrame(rows, schema)
    assert [(r.page, r.text) for r in pages.rejoined(split).collect()] == [(1, "\n".join(text))]
    even = split.withColumn("x0", F.col("x0") * 0 + F.row_number().over(jobs.Window.partitionBy("line").orderBy("x0")) * 20.0).withColumn("x1", F.col("x0") + 10.0)
    assert pages.rejoined(even).count() == 0
    assert pages.rejoined(split.limit(0)).count() == 0


def test_gauge_against_a_loop(spark):
    rows = [(R.choice("ab"), i * R.choice([1, 1, 1]), R.choice([1, -1, -1])) for i in range(700)]
    got = {r.seq: r.active for r in jobs.active(spark.createDataFrame(rows, "kind string, seq long, step int"), "kind", ["seq"], "step", 50).collect()}
    level = {"a": 0, "b": 0}
    for kind, seq, step in rows:
        level[kind] = max(0, level[kind] + step)
        assert got[seq] == level[kind]


def test_places_and_running_maxima(spark):
    rows = [(R.choice("abc"), R.randrange(1000), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = {r.i: r.n for r in planning.indexed_within(df, "k", ["v", "i"], "n").collect()}
    for k in "abc":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        assert all(got[r[2]] == n for n, r in enumerate(mine))
    sparse = [(i * 12 + R.randrange(12), None if i % 9 == 0 else R.randrange(1000)) for i in range(400)]
    best, want = None, {}
    for at, v in sorted(sparse):
        best = v if best is None else best if v is None else max(best, v)
        want[at] = best
    for width in (3, 50, 4096):  # stretches of stretches, stretches, one stretch
        found = planning.running_max(spark.createDataFrame(sparse, "at long, v int"), "at", "v", "m", width)
        assert {r["at"]: r.m for r in found.collect()} == want
    assert planning.indexed(df.limit(0), ["v"], "n").count() == 0


def test_states_against_events_one_by_one(spark):
    kinds, statuses = ("file_started", "page_done", "file_done"), ("ok", "warn", "failed")
    events = [("j", i, R.choice(kinds), R.randrange(4), 1, R.choice(statuses), R.choice([None, "e1", "e2"]), round(R.uniform(0, 9), 2), None, None, R.choice([None, None, "", "why"]), R.randrange(9), R.randrange(3), None, None, None) for i in range(160)]
    listed = spark.createDataFrame([("j", i, "pdf" if i % 2 else "text") for i in range(6)], "job string, index int, kind string")
    state = {i: {"status": "queued", "reason": None, "seconds": None, "pages": None, "engine": None, "changes": 0} for i in range(6)}
    for _, _, kind, i, _, status, engine, seconds, _, _, reason, n, changes, *_ in events:
        s = state[i]
        if kind == "file_started":
            s["pages"], s["status"] = n, "running"
        elif kind == "page_done":
            s["engine"] = engine or s["engine"]
            s["changes"] += changes
        else:
            s["status"], s["seconds"] = status, seconds
            s["reason"] = reason or (None if status == "ok" else s["reason"])
    got = {r["index"]: r for r in jobs.file_states(listed, spark.createDataFrame(events, jobs.EVENT)).collect()}
    for i, s in state.items():
        r = got[i]
        assert (r.status, r.reason, r.seconds, r.engine, r.changes) == (s["status"], s["reason"], s["seconds"], s["engine"], s["changes"]), i
        assert r.pages == (s["pages"] if i % 2 else None)


def test_event_types(spark):
    with pytest.raises(ValueError):
        jobs.event("nonsense")


def test_rewrites_keep_everything_else(spark):
    text = "sum µ0 and x² here"
    docs = spark.createDataFrame([(1, text), (2, "plain")], "page int, text string")
    spans = spark.createDataFrame([(1, 0, 4, 6), (1, 1, 11, 13)], "page int, span int, start int, end int")
    good = spark.createDataFrame([(1, 0, "$\\mu_{0}$"), (1, 1, "$x^{2}$")], "page int, span int, latex string")
    rows = {r.page: r for r in review.rewritten(docs, spans, good).collect()}
    assert rows[1].text == "sum $\\mu_{0}$ and $x^{2}$ here" and (rows[1].accepted, rows[1].rejected) == (2, 0) and rows[2].text == "plain"
    bad = spark.createDataFrame([(1, 0, "$\\mu_{1}$")], "page int, span int, latex string")
    assert review.rewritten(docs, spans, bad).filter("page = 1").first().text == f"sum µ0{review.MARKER} and x²{review.MARKER} here"
    assert review.rewritten(docs, spans.limit(0), good).filter("page = 1").first().text == text


def test_backoff():
    slept, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 4:
            raise ValueError("429")
        return "done"

    assert review.with_backoff(call, lambda e: "429" in str(e), sleep=slept.append) == "done" and slept == [2.0, 4.0, 8.0]
    with pytest.raises(ValueError):
        review.with_backoff(lambda: int("x"), lambda e: False, sleep=slept.append)
    with pytest.raises(ValueError):
        review.with_backoff(lambda: int("x"), lambda e: True, [0.0], slept.append)


def test_gpu_verdicts(spark):
    pipes = [("a", "ollama:x:32b", "y:7b", None), ("b", "openai:gpt-4o", None, None), ("c", "x:32b", "ollama:x:32b", "x:32b")]
    df = spark.createDataFrame(pipes, "pipeline string, ocr_model string, figure_model string, review_model string")
    none = spark.createDataFrame([], "tag string, file_gb double")
    got = {r.pipeline: (r.models, r.resident_gb, r.verdict) for r in estimates.gpu_state(df, none, 36.0).collect()}
    assert got == {"a": (2, 37.12, "blocked"), "b": (0, 0.0, "fits"), "c": (1, 29.0, "fits")}
    assert {r.verdict for r in estimates.gpu_state(df, none, 0.0).collect()} == {"fits"}
    assert {r.pipeline: r.verdict for r in estimates.gpu_state(df, none, 30.0).collect()}["c"] == "tight"
