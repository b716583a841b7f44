"""Jobs done whole: no place, side or row is left out."""

from pyspark.sql import functions as F

from corpusloom.functions import cleaning
from corpusloom.operators import planning
from corpusloom.plans import REGISTRY, text_queries


def test_every_file_has_its_place(spark):
    rows = [(f"in/{i * 37 % 500:03d}.pdf", None if i % 50 == 0 else float(i % 3)) for i in range(500)]
    files = spark.createDataFrame(rows, "path string, weight double")
    got = {r.path: r.place for r in planning.order_by_cost(files).collect()}
    want = sorted(rows, key=lambda r: (-(r[1] or 0.0), r[0]))
    assert got == {path: i + 1 for i, (path, _) in enumerate(want)}
    assert planning.order_by_cost(files.limit(0)).count() == 0


def test_lpt_order_drops_nothing(spark, sf):
    got = REGISTRY["lpt_order"].run(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count() > 100


def test_regions_up_to_the_cap(spark, sf):
    places = {r.place for r in REGISTRY["regions_topk"].run(spark, sf).select("place").distinct().collect()}
    assert places == {1, 2, 3, 4, 5, 6}


def test_empty_output_sees_every_document(spark, sf, monkeypatch):
    docs = spark.createDataFrame([(i, "tiny") for i in range(1, 10)], "doc_id long, md string")
    monkeypatch.setattr(text_queries, "_md", lambda *_: docs)
    assert sorted(r.doc_id for r in REGISTRY["validate_empty_output"].run(spark, sf).collect()) == [*range(-9, 0), *range(1, 10)]


def test_history_merge_takes_every_event(spark, tmp_path):
    rows = [(1, 10, 5.0), (2, 20, 1.0), (3, 20, 9.0), (5, 30, 7.0), (9, 30, 2.0), (None, 40, 3.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.user_id, r.value, r.is_live) for r in REGISTRY["history_merge"].run(spark, str(tmp_path)).collect()}
    assert got == {(10, 5.0, False), (20, 1.0, True), (30, 7.0, False), (40, 3.0, False)}


def test_no_length_cuts_a_page(spark):
    md = "".join(f"## Page {i}\nHeader\nbody {i}\n" for i in (1, 2, 3)) + "x\n" * 1_000_001 + "Header\nend"
    docs = spark.createDataFrame([(1, md)], "doc_id long, md string")
    assert docs.select(cleaning.without_running_headers(F.col("md")).alias("out")).first().out == md.replace("Header\n", "")
