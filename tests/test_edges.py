"""Parser queries against their SQL where a document's head leaves nothing, and the operators' two ways with blanks at the ends."""

import io
import json
import zipfile

import duckdb
import pytest

from corpusloom.operators import parsers
from corpusloom.plans import REGISTRY

TEXTS = ["plain head of a document", "", "中文 — é\n", "   ", "a  b\n  c", "x" * 50, " élan vital ", "a é", "\n"]


def odd_rows(spark, tmp_path, name):
    """(from the query, from its SQL) over documents of which some have no ASCII letter, digit or word in their head."""
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = REGISTRY[name].run(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ", ".join(got.columns)
    return sorted(tuple(r) for r in got.collect()), sorted(con.sql(f"SELECT {columns} FROM ({REGISTRY[name].sql})").fetchall())


@pytest.mark.parametrize("name", ["live_scripts", "parse_books", "parse_emails", "parse_mind_maps"])
def test_heads_without_words(spark, tmp_path, name):
    got, want = odd_rows(spark, tmp_path, name)
    assert got == want and len(got) >= len(TEXTS)


def test_live_script_blanks(spark):
    rows = [("a.mlx", 0, False, " prose "), ("a.mlx", 1, False, "  "), ("a.mlx", 2, True, "x ")]
    paragraphs = spark.createDataFrame(rows, "path string, n int, code boolean, text string")
    assert parsers.live_scripts(paragraphs).first().md == "## a.mlx\n\nprose\n\n```matlab\nx\n```\n"
    assert parsers.live_scripts(paragraphs, as_is=True).first().md == "## a.mlx\n\n prose \n\n```matlab\nx\n```\n"


def test_mind_map_blanks(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.json", json.dumps([{"title": "S", "rootTopic": {"title": " r ", "children": {"attached": [{"title": " "}, {"title": "c "}]}}}]))
    files = spark.createDataFrame([("x.xmind", bytearray(out.getvalue()))], "path string, content binary")
    assert parsers.mind_maps(files).first().md == "## S\n\n- r\n  - c"
    assert parsers.mind_maps(files, as_is=True).first().md == "## S\n\n-  r \n  - c "


def test_empty_paragraphs_of_books():
    html = "<head><p></p></head><h1>T</h1><p> </p><p>a</p><p><br/></p><p>b&#3;</p><table><tr><td><p></p></td></tr></table><p><img src='i'/></p><p></p>"
    assert parsers.html_markdown(html) == "# T\n\na\n\nb\n\n|  |\n| --- |\n\n![](i)"
    assert parsers.html_markdown(html, as_is=True) == "# T\n\n\n\na\n\n\n\nb\n\n|  |\n| --- |\n\n![](i)\n\n"
    assert parsers.html_markdown("<p>a</p>", as_is=True) == "a" and parsers.html_markdown("<p>\x03</p>") == "\x03"


def test_email_blanks(spark):
    head = b"From: a@x\nSubject: s\nMIME-Version: 1.0\nContent-Type: "
    both = head + b'multipart/alternative; boundary="b"\n\n--b\nContent-Type: text/plain\n\n \n\n--b\nContent-Type: text/html\n\n<p> t </p>\n--b--\n'
    files = spark.createDataFrame([("a", head + b"text/plain\n\n x \n"), ("b", both)], "path string, content binary")
    assert {r.path: r.body for r in parsers.emails(files).collect()} == {"a": "x", "b": "t"}
    assert {r.path: r.body.rstrip("\n") for r in parsers.emails(files, as_is=True).collect()} == {"a": " x ", "b": " t "}
