"""Folders, archives and sinks on real files."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, parsers, review, sheets, sinks, summaries
from corpusloom.sources import files


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    for name, data in {
        "a.txt": b"plain", "b/c.TXT": b"plain", "b/.d/e.txt": b"plain", "node_modules/f.txt": b"plain", "note.md": b"plain", "pdf.bin": b"%PDF-1.7", "x.unknown": b"plain", "out/g.txt": b"plain",
        "Talk.key/Index/a.iwa": b"1", "Talk.key/preview.jpg": b"2", "Fake.key/readme.txt": b"3", "z.zip": archive(**{"in/m.txt": "m", "in/.n.txt": "n", "../o.txt": "o"}), "empty.zip": archive(**{"p.unknown": "p"}),
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return tmp_path


def test_scan(spark, folder):
    listing = files.read_folder(spark, str(folder))
    got = {(r.relative, r.suffix, r.bundle) for r in files.scanned(listing, str(folder), f"{folder}/out").collect()}
    assert got == {("a.txt", ".txt", False), ("b/c.TXT", ".txt", False), ("pdf.bin", ".pdf", False), ("z.zip", ".zip", False), ("empty.zip", ".zip", False), ("Talk.key", ".key", True)}
    with_notes = files.scanned(listing, str(folder), f"{folder}/out", markdown=True)
    assert ("note.md",) in {(r.relative,) for r in with_notes.collect()}
    paths = [r.path for r in files.scanned(listing, str(folder), f"{folder}/out").collect()]
    assert paths == sorted(paths)
    assert files.scanned(listing.limit(0), str(folder)).count() == 0


def test_zips_become_members(spark, folder):
    listing = files.read_folder(spark, str(folder))
    scan = files.scanned(listing, str(folder), f"{folder}/out")
    zips = listing.join(scan.filter(files.explodable(F.col("suffix"))).select("path"), "path")
    got = {(r.path.rpartition("/")[2], r.member, r.suffix) for r in files.with_members(scan.select("path", "suffix"), parsers.unzipped(zips)).collect()}
    assert ("z.zip", "in/m.txt", ".txt") in got and ("empty.zip", None, ".zip") in got
    assert not [g for g in got if g[0] == "z.zip" and g[1] != "in/m.txt"]


def test_selection_is_deduplicated(spark, folder):
    listing = files.read_folder(spark, str(folder))
    scans = [files.scanned(listing, str(folder)).select("path"), files.scanned(listing, f"{folder}/b").select("path")]
    paths = [r.path for r in files.selection(scans).collect()]
    assert len(paths) == len(set(paths)) and paths == sorted(paths)


def test_members_that_leave(spark):
    names = {"a/b": True, "../a": False, "a/../../b": False, "a/../b": True, "/a": False, "C:\\a": False, "a\\..\\..\\b": False, "./a": True, "a/./../b/..": True}
    rows = spark.createDataFrame([(n,) for n in names], "m string").select("m", files.safe_member(F.col("m")).alias("ok")).collect()
    assert {r.m: r.ok for r in rows} == names


def test_manifest(spark, tmp_path):
    where = str(tmp_path / "manifest")
    assert sinks.manifest(spark, where).count() == 0
    sinks.record(spark.createDataFrame([("a", "ok", 1), ("b", "failed", 2)], "source string, status string, char_count long"), where)
    sinks.record(spark.createDataFrame([("b", "ok", 3), ("c", "ok", 4)], "source string, status string, char_count long"), where)
    sinks.record(spark.createDataFrame([("c", "skipped", 4)], "source string, status string, char_count long"), where)
    got = {(r.source, r.status, r.char_count) for r in sinks.manifest(spark, where).collect()}
    assert got == {("a", "ok", 1), ("b", "ok", 3), ("c", "skipped", 4)}
    assert sinks.versions(spark, where) == [2, 3]  # older ones are gone
    sinks.export_manifest(sinks.manifest(spark, where), str(tmp_path / "json"))
    (tmp_path / "json" / "more.txt").write_text('{"source": "d", "surplus": 1}\n{broken\n')
    assert {r.source for r in sinks.import_manifest(spark, str(tmp_path / "json")).collect()} == {"a", "b", "c", "d"}
    assert sinks.import_manifest(spark, str(tmp_path / "nothing")).count() == 0


def test_cache_and_prices(spark, tmp_path):
    cache = str(tmp_path / "cache")
    sinks.put_cache(spark.createDataFrame([("k", "text"), ("l", " ")], "key string, text string"), cache)
    sinks.put_cache(spark.createDataFrame([("k", "other"), ("m", "more")], "key string, text string"), cache)
    assert {(r.key, r.text) for r in sinks.cached(spark, cache).collect()} == {("k", "text"), ("m", "more")}
    calls = spark.sparkContext.accumulator(0)

    def answer(content):
        calls.add(1)
        return content.decode().upper()

    images = spark.createDataFrame([(1, b"a"), (2, b"a"), (3, b"b")], "id int, content binary")
    first = review.answered(images, answer).select("id", "key", "text")
    read = first.collect()
    assert {(r.id, r.text) for r in read} == {(1, "A"), (2, "A"), (3, "B")} and calls.value == 2
    sinks.put_cache(spark.createDataFrame([(r.key, r.text) for r in read], "key string, text string"), cache)
    again = review.answered(images, answer, sinks.cached(spark, cache))
    assert {(r.id, r.text) for r in again.collect()} == {(1, "A"), (2, "A"), (3, "B")} and calls.value == 2
    prices = str(tmp_path / "prices")
    sinks.save_price(spark, prices, "m", 1, 2)
    sinks.save_price(spark, prices, "m", 3, 4)
    assert [tuple(r) for r in sinks.prices(spark, prices).collect()] == [("m", 3.0, 4.0)]
    with pytest.raises(ValueError):
        sinks.save_price(spark, prices, "m", -1, 0)


def test_documents_and_sidecars(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# T\n\none"), (2, None)], "doc_id long, md string")
    text = sinks.document_text(F.lit("---\na: 1\n---\n"), F.when(F.col("doc_id") == 2, "> note\n"), F.col("md"))
    rows = docs.select(F.format_string("sub/d%d.md", "doc_id").alias("path"), text.alias("text"))
    assert {(r.path, r.bytes) for r in sinks.write_files(rows, str(tmp_path)).collect()} == {("sub/d1.md", 23), ("sub/d2.md", 23)}
    assert (tmp_path / "sub/d1.md").read_text() == "---\na: 1\n---\n\n# T\n\none\n"
    assert (tmp_path / "sub/d2.md").read_text() == "---\na: 1\n---\n\n> note\n\n\n"
    side = sinks.sidecar(chunking.chunks(docs, "md"))
    assert [c["text"] for c in json.loads(side.filter("doc_id = 1").first().sidecar)] == ["# T\n\none"]
    with pytest.raises(Exception, match="leaves"):
        sinks.write_files(spark.createDataFrame([("../x", "y")], "path string, text string"), str(tmp_path / "sub")).collect()


def test_run_dump_and_report(spark, tmp_path):
    where = str(tmp_path / "runs")
    stages = [{"name": f"s{i}", "ms": i} for i in range(12)]
    for stamp in ("1", "2"):
        sinks.write_run(spark, where, stamp, {"converted": 1}, stages)
    lines = [json.loads(x) for x in sinks.read_text(spark, f"{where}/index.jsonl").splitlines()]
    assert [x["path"] for x in lines] == ["run-1.json", "run-2.json"] and len(lines[0]["stages"]) == 8
    assert json.loads(sinks.read_text(spark, f"{where}/latest.json")) == json.loads(sinks.read_text(spark, f"{where}/run-2.json"))
    manifest = spark.createDataFrame([("a<b", 1, "ok", 5, 10, None), ("c", 2, "failed", 0, 99, "no & no")], "source string, pos int, status string, chars int, duration_ms int, error string")
    traces = spark.createDataFrame([("a<b", 1, "pdf")], "source string, pos int, converter string")
    notes = spark.createDataFrame([("a<b", 1, "ocr", 80.0)], "source string, pos int, kind string, confidence double")
    rows = summaries.file_rows(manifest, traces, notes)
    assert [r.source for r in rows.collect()] == ["c", "a<b"]
    html = summaries.report_html(summaries.run_summary(rows), rows, spark.createDataFrame([("ocr", 5.0)], "name string, ms double"), summaries.tool_counts(notes, traces))
    assert "a&lt;b" in html and "no &amp; no" in html and "<b" not in html.replace("<body", "").replace("<br", "")


def test_workbook(spark):
    sheet = """<worksheet xmlns="urn:m"><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row>
      <row r="3"><c r="B3"><v>1.5</v></c><c r="C3"><f>SUM(B1:B2)</f><v>7</v></c><c r="AA3" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="B1:B2"/></mergeCells></worksheet>"""
    parts = {
        "xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<x><Relationship Id="r1" Target="worksheets/s.xml"/></x>',
        "xl/sharedStrings.xml": "<sst><si><t>he</t><t>ad</t></si></sst>", "xl/worksheets/s.xml": sheet,
    }
    books = spark.createDataFrame([("b.xlsx", archive(**parts)), ("bad.xlsx", b"no zip"), ("none.xlsx", None)], "path string, content binary")
    cells = sheets.workbook_cells(books)
    assert {(r.row, r.col, r.value) for r in cells.collect()} == {(1, 2, "head"), (1, 3, "in"), (3, 2, "1.5"), (3, 3, "7"), (3, 27, "True")}
    md = sheets.workbook_markdown(cells, sheets.workbook_merges(books)).first().md
    assert md.startswith("## Sheet: One\n| head | in |") and "\n| head |  |" in md and md.endswith("**Fórmulas:** `C3 = SUM(B1:B2)`")
    letters = spark.range(1, 16385, 37).select("id", sheets.column_letters(F.col("id").cast("int")).alias("l")).collect()
    for r in letters:
        assert sheets._number(r.l) == r.id
    wide = spark.createDataFrame([("b", "s", 0, 1, c, "x", None) for c in range(1, 40)], cells.schema)
    assert sheets.workbook_markdown(wide).first().md.startswith("## Sheet: s\n```csv\nx,x")
    assert sheets.workbook_markdown(wide.limit(0)).count() == 0


def test_whole_folder(spark, tmp_path):
    from corpusloom.operators import convert

    source, output = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for name, data in {
        "a.txt": b"\xef\xbb\xbfwater-\nmill", "b.html": b"<h1>T</h1><p>x</p>", "c.json": b'{"k": 1}', "d.csv": b'h,"i, j"\n1,2\n', "e.eml": b"From: a@x\nSubject: s\n\nhello", "f.m": b"x = 1", "g.txt": b"one", "g.html": b"<p>two</p>", "h.pdf": b"%PDF-1.4", "i.txt": b" ",
        "z.zip": archive(**{"m/n.txt": "inside"}),
    }.items():
        (source / name).write_bytes(data)
    rows = {r.source.removeprefix(f"{source}/"): r for r in convert.convert_folder(spark, str(source), str(output), chunks=True).collect()}
    assert {k for k, r in rows.items() if r.status == "failed"} == {"h.pdf", "i.txt"} and rows["h.pdf"].error == "no converter for pdf"
    read = lambda name: (output / name).read_text().split("---\n", 2)[2].strip()
    assert read("a.md") == "watermill" and read("b.md") == "# T\n\nx" and read("d.md") == "| h | i, j |\n| --- | --- |\n| 1 | 2 |" and read("z.zip/m/n.md") == "inside"
    assert read("g.txt.md") == "one" and read("g.html.md") == "two" and "```json" in read("c.md") and "hello" in read("e.md") and "matlab" in read("f.md")
    assert json.loads((output / "a.chunks.json").read_text())[0]["text"] == "watermill"
    (source / "a.txt").write_text("new")
    again = {r.source.removeprefix(f"{source}/"): r.status for r in convert.convert_folder(spark, str(source), str(output)).collect()}
    assert again["a.txt"] == "ok" and again["b.html"] == "skipped" and again["h.pdf"] == "failed" and again["z.zip/m/n.txt"] == "skipped"
    assert read("a.md") == "new"
    found = convert.validate_folder(spark, str(output)).collect()
    assert {(r.path, r.rule) for r in found} >= {("a.md", "empty_output")}
    (output / "pics").mkdir()
    (output / "pics" / "p.png").write_bytes(b"x")
    (output / "j.md").write_text("long enough to be no empty output ![x](pics/p.png) ![y](pics/q.png)")
    assert [r.detail for r in convert.validate_folder(spark, str(output)).collect() if r.path == "j.md"] == ["image target 'pics/q.png' does not exist"]
    totals = {r.kind: r.files for r in convert.inspect_folder(spark, str(source)).collect()}
    assert totals[None] == 11
