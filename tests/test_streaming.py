"""The streaming twins against the batch results."""

from pyspark.sql import functions as F

from corpusloom.streaming import jobs


def test_states_and_windows(spark, sf, tmp_path):
    folder = str(tmp_path / "events")
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(folder)
    jobs.fold_into(jobs.event_stream(spark, folder, 1), str(tmp_path / "states"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.user_id, r.status, r.events) for r in jobs.folded(spark, str(tmp_path / "states")).collect()}
    want = {(r.user_id, r.status, r.events) for r in jobs.file_states(events).collect()}
    assert got == want
    q = jobs.tumbling(jobs.event_stream(spark, folder), late="4000 days").writeStream.format("memory").queryName("w").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").groupBy("start", "event_type").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == events.count()


def test_watched_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("1")
    seen = []
    for name in ("b.txt", "c.md"):
        jobs.watch_folder(spark, str(folder), lambda df, _: seen.extend(r.path.rpartition("/")[2] for r in df.select("path").collect()), str(tmp_path / "cp"), "*.txt").awaitTermination()
        (folder / name).write_text("2")
    assert sorted(seen) == ["a.txt", "b.txt"]


def test_job_states_from_a_stream(spark, tmp_path):
    import random

    from corpusloom.operators import jobs as batch

    r, folder = random.Random(4), str(tmp_path / "events")
    rows = [("j", i, r.choice(("file_started", "page_done", "file_done")), r.choice([0, 1, 2, None]), 1, r.choice(("ok", "failed")), r.choice((None, "e")), 1.5, None, None, r.choice((None, "why")), 3, 2, None, None, None) for i in range(60)]
    for at in range(0, 60, 20):
        jobs.append_events(spark.createDataFrame(rows[at : at + 20], batch.EVENT).coalesce(1), folder)
    q = jobs.state_stream(jobs.job_events(spark, folder, 1)).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    files = spark.createDataFrame([("j", i, "pdf") for i in range(3)], "job string, index int, kind string")
    want = {(x["index"], x.status, x.reason, x.engine, x.changes) for x in batch.file_states(files, spark.createDataFrame(rows, batch.EVENT)).collect()}
    got = {(x["index"], x.status, x.reason, x.engine, x.changes) for x in spark.table("states").collect()}
    assert want <= got  # the memory sink keeps every update
    seen = []
    jobs.subscribe(spark, folder, lambda df, _: seen.extend(x.seq for x in df.collect()), str(tmp_path / "cp2"), since=30).awaitTermination()
    assert sorted(seen) == list(range(31, 60))


def test_syncs(spark, tmp_path):
    seen, syncs = [], jobs.Syncs(spark)
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.txt").write_text("x")
        syncs.put(name, jobs.Sync(str(tmp_path / name), lambda df, _: seen.extend(x.path.rpartition("/")[2] for x in df.collect()), str(tmp_path / f"cp{name}"), enabled=name == "a"))
    syncs.start_all()
    syncs.wait()
    assert seen == ["1.txt"] and syncs.counts() == {"a": 1}
    (tmp_path / "a" / "2.txt").write_text("y")
    syncs.start("a")
    syncs.wait()
    assert seen == ["1.txt", "2.txt"] and syncs.counts() == {"a": 2}
    syncs.remove("a")
    syncs.stop_all()
    assert not syncs.running


def test_control(spark):
    control, log = jobs.Control(spark, "t"), []
    steps = {"one": lambda: log.append(1) or 1, "two": lambda: 1 / 0, "three": lambda: 3, "four": lambda: control.cancel(), "five": lambda: 5}
    control.skip("three")
    out = control.run(steps)
    assert out["one"] == ("ok", 1) and out["two"][0] == "failed" and out["three"][0] == "cancelled" and out["five"][0] == "cancelled"


def test_remembered_and_spans(spark):
    now, calls = [0.0], []
    held = jobs.Remembered(lambda: calls.append(1) or len(calls), 60, lambda: now[0])
    assert held.get() == held.get() == 1
    now[0] = 61
    assert held.get() == 2
    ticks = iter(range(100))
    spans = jobs.Spans("f", lambda: next(ticks))
    with spans.span("outer"):
        with spans.span("inner"):
            pass
    rows = {x.name: x for x in spans.table(spark).collect()}
    assert rows["inner"].parent == rows["outer"].span and rows["outer"].ms == 3000 and rows["inner"].ms == 1000
