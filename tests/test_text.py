"""Cleaning, chunking, mathematics and parsers against inputs with known results."""

import io
import itertools
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import cleaning as C
from corpusloom.functions import prose as P
from corpusloom.operators import chunking, parsers, review


def one(spark, text, change):
    return spark.createDataFrame([(text,)], "t string").select(change(F.col("t")).alias("o")).first()[0]


@pytest.mark.parametrize(
    "text, change, want",
    [
        ("caf\u00c3\u00a9 \u0093x\u0094", C.mojibake, 'caf\u00e9 "x"'),
        ("\x1dora \x00y\x01\x07", C.ligatures, "flora {y}"),
        ("\ufb01n", C.ligatures, "fin"),
        ("a\r\nb", C.ligatures, "afl\nb"),
        ("n\u00b4umero se\u02dcnal", C.pdf_artifacts, "n\u00famero se\u00f1al"),
        ("water-\nmill", C.dehyphenated, "watermill"),
        ("\\[ x \\] and \\(y\\)", C.latex, "$$x$$ and $y$"),
        ("```\n\\[ x \\]\n```\n\\section{ A }", C.latex, "```\n\\[ x \\]\n```\n# A"),
        ("\\subsection{A}\n\\subsubsection*{B}", C.latex, "## A\n### B"),
        ("\\begin{align}\na\n\\end{align}", C.latex, "\n$$\na\n$$\n"),
        ("\\begin{align}x\\end{equation}\\end{align} \\[ \\]", C.latex, "\n$$\nx\\end{equation}\n$$\n $$$$"),
        ("| a |\n```\n| b |\n```\n| c |\n", C.repaired_tables, "| a |\n| --- |\n```\n| b |\n```\n| c |\n| --- |\n"),
        ("```\nx\n| y |", C.repaired_tables, "```\nx\n| y |"),
        (None, C.cleaned, None),
        ("", C.cleaned, ""),
        ("a\nb\n\n# h\nc", C.reflowed, "a b\n\n# h\nc"),
        ("a\n```\nx\ny\n```\nb\nc", C.reflowed, "a\n```\nx\ny\n```\nb c"),
        ("- a\n- b\nc\nd", C.reflowed, "- a\n- b\nc d"),
        ("a\n3/12\nb", C.without_page_numbers, "a\nb"),
        ("", C.reflowed, ""),
        (None, C.mojibake, None),
    ],
)
def test_cleaning(spark, text, change, want):
    assert one(spark, text, change) == want


def test_running_headers(spark):
    md = "".join(f"## Page {i}\nHeader\nbody {i}\n{i}/3\n" for i in (1, 2, 3))
    docs = spark.createDataFrame([(1, md), (2, "no pages\nHeader")], "doc_id long, md string")
    out = {r.doc_id: r.out for r in docs.select("doc_id", C.without_running_headers(F.col("md")).alias("out")).collect()}
    assert out == {1: "## Page 1\nbody 1\n## Page 2\nbody 2\n## Page 3\nbody 3\n", 2: "no pages\nHeader"}


def test_tables(spark):
    md = ["| a | b |\n| 1 | 2 |", "|  |  |\n| --- | --- |\n| h | k |\n| 1 | 2 |", "```\n| x |\n```", "| a |\n| --- |\n| 1 |"]
    docs = spark.createDataFrame(list(enumerate(md)), "doc_id long, md string")
    out = {r.doc_id: r.o for r in docs.select("doc_id", C.repaired_tables(F.col("md")).alias("o")).collect()}
    assert out == {0: "| a | b |\n| --- | --- |\n| 1 | 2 |", 1: "| h | k |\n| --- | --- |\n| 1 | 2 |", 2: md[2], 3: md[3]}


def test_language(spark):
    texts = ["the cat and the dog of this house are on the mat with a hat as it was by the door for us to see", "el gato y la casa de los reyes que en un lugar con una puerta para la noche por la calle como el sol", "short", None]
    got = [r.language for r in P.with_language(spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string"), "t").orderBy("doc_id").collect()]
    assert got == ["en", "es", None, None]


def test_math_spans():
    assert P.Spans("let \u03b2 + 7 stand").rows() == [(0, 4, 9, "\u03b2 + 7", False)]
    assert P.Spans("line 4 of a poem").rows() == [] and P.Spans("line 4 of a poem").density() == 0
    assert P.Spans("k1 2 m3").rows()[0][4]
    assert P.Spans("").rows() == [] and P.Spans(None).density() == 0


def test_math_spans_one_by_one():
    """Against the rule taken token by token, each decision counting for the next."""
    symbol, short = (re.compile(x) for x in (P.MATH_SYMBOL, P.MATH_CANDIDATE))
    random_ = random.Random(3)
    for _ in range(3000):
        tokens = [random_.choice(["x", "s2", "12", "\u221a", "a=b", "word", "n1", "7", "_", "ab12", "\u03b1"]) for _ in range(random_.randrange(0, 14))]
        flags, maybe = [bool(symbol.search(t)) for t in tokens], [bool(short.match(t)) for t in tokens]
        for i, t in enumerate(tokens):
            near = range(max(0, i - 2), min(len(tokens), i + 3))
            flags[i] = flags[i] or maybe[i] and (any(flags[j] for j in near) or sum(maybe[j] for j in near) > 2)
        found = P.Spans(" ".join(tokens))
        assert found.inside.tolist() == flags
        groups = [[i for i, _ in g] for on, g in itertools.groupby(enumerate(flags), key=lambda x: x[1]) if on]
        lost = [any(tokens[i] == "\u221a" for i in g) or len(g) > 1 and sum(maybe[i] for i in g) >= max(2, len(g) - 1) for g in groups]
        assert [(r[3], r[4]) for r in found.rows()] == [(" ".join(tokens[i] for i in g), x) for g, x in zip(groups, lost)]


def test_chunks():
    text = "pre\n\n## A\n" + "x" * 30 + "\n\n| a |\n| b |\n\n" + "y" * 120
    got = list(chunking.chunks_of(text, 60, 10))
    assert got[0] == ("", "pre")
    assert any("| a |\n| b |" in c for _, c in got)
    assert all(len(c) <= 60 for _, c in got)
    whole = "".join(c.removeprefix("## A\n\n") for h, c in got if "y" in c)
    assert whole.count("y") >= 120
    with pytest.raises(ValueError):
        list(chunking.windows_of("abc", 5, 5))


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_parsers(spark):
    mail = b"From: a@x\nTo: b@y\nSubject: s\nContent-Type: text/plain\n\nhello"
    zipped = archive(**{"a/b.txt": b"1", "../evil": b"2", ".hidden": b"3"})
    mind = archive(**{"content.json": json.dumps([{"title": "S", "rootTopic": {"title": "r", "notes": {"plain": {"content": "n"}}, "children": {"attached": [{"title": "c"}]}}}])})
    files = spark.createDataFrame([("m.eml", mail), ("z.zip", zipped), ("x.xmind", mind), ("p.bin", b"%PDF-1.4"), ("n.txt", None)], "path string, content binary")
    kinds = {r.path: r.k for r in files.select("path", parsers.sniffed_suffix(F.col("content"), F.col("path")).alias("k")).collect()}
    assert kinds == {"m.eml": ".eml", "z.zip": ".zip", "x.xmind": ".xmind", "p.bin": ".pdf", "n.txt": ".txt"}
    assert [(r.member, bytes(r.content)) for r in parsers.unzipped(files.filter("path = 'z.zip'")).collect()] == [("a/b.txt", b"1")]
    got = parsers.emails(files.filter("path = 'm.eml'")).first()
    assert (got.sender, got.subject, got.body) == ("a@x", "s", "hello")
    assert parsers.mind_maps(files.filter("path = 'x.xmind'")).first().md == "## S\n\n- r\n  > n\n  - c"
    fb2 = b"<FictionBook><body><section><title><p>T</p></title><p>one</p><section><p>two</p></section></section></body></FictionBook>"
    book = spark.createDataFrame([("b.fb2", fb2)], "path string, content binary")
    assert [(r.chapter, r.title, r.md) for r in parsers.book_chapters(book).collect()] == [(0, "T", "one"), (1, "", "two")]
    assert one(spark, "a = '```'", parsers.script_block).startswith("````matlab\n")


def test_html():
    got = parsers.html_markdown("<h1>T</h1><p>a <b>b</b> <a href='u'>l</a></p><ul><li>x<li>y</ul><table><tr><th>h</th></tr><tr><td>1|2</td></tr></table><script>no</script>")
    assert got == "# T\n\na **b** [l](u)\n\n- x\n- y\n\n| h |\n| --- |\n| 1\\|2 |"


def test_review():
    assert review.similar("a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s u")
    assert not review.similar("one\ntwo", "one two")
    assert not review.similar("", "") and not review.similar("a", " ")
    assert review.salvaged_objects('x [{"quote": "a"}, {"quote": "b"}, {"quo') == [{"quote": "a"}, {"quote": "b"}]
