"""File-content parsers: type sniffing, archives, e-mail, mind maps, e-books, scripts, JSON and HTML, as Columns or Arrow functions."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from email.parser import BytesParser
from email.policy import EmailPolicy
from functools import lru_cache
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Leading bytes by suffix.
MAGIC = ((".pdf", "25504446"), (".png", "89504E470D0A1A0A"), (".jpg", "FFD8FF"), (".tiff", "49492A00"), (".tiff", "4D4D002A"))


def sniffed_suffix(content: Column, path: Column) -> Column:
    """Suffix by leading bytes, else by the archive's members, else the path's own."""
    prefix = F.substring(content, 1, 8192)
    text = F.lower(F.ltrim(F.decode(F.substring(content, 1, 4096), "ISO-8859-1")))
    own = F.nullif(F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)), F.lit(""))
    found = F.when(F.lit(False), F.lit(""))
    for suffix, magic in MAGIC:
        found = found.when(F.startswith(prefix, F.unhex(F.lit(magic))), suffix)
    found = found.when(F.decode(F.substring(content, 5, 4), "ISO-8859-1").eqNullSafe("ftyp") & F.decode(F.substring(content, 9, 8), "ISO-8859-1").rlike("heic|heif|mif1|msf1"), ".heic")
    found = found.when(F.startswith(prefix, F.unhex(F.lit("504B0304"))), F.coalesce(archive_suffix(content), own))
    found = found.when(text.rlike(r"^(<!doctype html|<html)"), ".html").when(text.rlike(r"^(from|received|subject):|\n(from|received|subject):"), ".eml")
    return F.coalesce(found, own)


@F.pandas_udf(T.StringType())
def archive_suffix(content: pd.Series) -> pd.Series:
    """Suffix of a zip by the names in its directory; null for a broken one."""

    def one(data: bytes | None) -> str | None:
        try:
            names = zipfile.ZipFile(io.BytesIO(data or b"")).namelist()
        except zipfile.BadZipFile:
            return None
        for suffix, mark in ((".mlx", "matlab/document.xml"), (".docx", "word/"), (".xlsx", "xl/"), (".pptx", "ppt/"), (".xmind", "content.json"), (".epub", "META-INF/container.xml"), (".pages", "Index/Document.iwa")):
            if any(n.startswith(mark) for n in names):
                return suffix
        return ".zip"

    return content.map(one)


def _rows(schema: str, columns: list[str], expand: Callable[..., Iterator[tuple]], types: list[pa.DataType]):
    """mapInArrow function that turns each input row into rows of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for args in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in expand(*args)]
            data = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(data, types, strict=True)], names=columns)

    return run, schema


def unzipped(files: DataFrame) -> DataFrame:
    """(path, member, content): members of plain archives; names that leave the archive, folders and hidden parts are refused."""

    def expand(path: str, content: bytes) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content or b""))
        except zipfile.BadZipFile:
            return
        for info in archive.infolist():
            parts = info.filename.replace("\\", "/").split("/")
            if info.is_dir() or info.filename.startswith("/") or ".." in parts or any(p.startswith(".") for p in parts):
                continue
            yield path, info.filename, archive.read(info)

    run, schema = _rows("path string, member string, content binary", ["path", "member", "content"], expand, [pa.string(), pa.string(), pa.binary()])
    return files.select("path", "content").mapInArrow(run, schema)


class _Headers(EmailPolicy):
    """The default policy, which reads a header anew at every look at it, with the last ones kept."""

    @lru_cache(1024)  # noqa: B019
    def header_fetch_parse(self, name, value):
        return super().header_fetch_parse(name, value)


_HEADERS = _Headers()


def emails(files: DataFrame, as_is: bool = False) -> DataFrame:
    """(path, sender, recipient, subject, date, body, attachments): plain text bodies first, else stripped HTML.

    Bodies lose the blanks and line ends at their ends, unless as_is; blank ones count for nothing.
    """
    ended = (lambda t: t if t.strip() else "") if as_is else str.strip

    def expand(path: str, content: bytes) -> Iterator[tuple]:
        msg = BytesParser(policy=_HEADERS).parsebytes(content or b"")
        parts = [p for p in msg.walk() if not p.is_multipart() and p.get_content_disposition() != "attachment"]
        texts = {kind: [p.get_content() for p in parts if p.get_content_type() == kind] for kind in ("text/plain", "text/html")}
        body = "\n\n".join(map(ended, texts["text/plain"])) or "\n\n".join(ended(html_text(t, as_is)) for t in texts["text/html"])
        names = [p.get_filename() for p in msg.walk() if p.get_content_disposition() == "attachment" and p.get_filename()]
        yield (path, *(str(msg.get(h, "")) for h in ("From", "To", "Subject", "Date")), body, names)

    run, schema = _rows("path string, sender string, recipient string, subject string, date string, body string, attachments array<string>", ["path", "sender", "recipient", "subject", "date", "body", "attachments"], expand, [pa.string()] * 6 + [pa.list_(pa.string())])
    return files.select("path", "content").mapInArrow(run, schema)


def outline(topic: dict, depth: int = 0, deepest: int = 32, as_is: bool = False) -> Iterator[str]:
    """A topic tree as list lines, parents first; notes become quotes, blank titles go."""
    if depth > deepest:
        return
    title = str(topic.get("title") or "")
    if title.strip():
        yield "  " * depth + f"- {title if as_is else title.strip()}"
    note = ((topic.get("notes") or {}).get("plain") or {}).get("content")
    for line in (note or "").strip().splitlines():
        yield "  " * (depth + 1) + f"> {line.strip()}"
    children = topic.get("children") or {}
    for kind in ("attached", "detached"):
        for child in children.get(kind) or []:
            yield from outline(child, depth + 1, deepest, as_is)


def mind_maps(files: DataFrame, as_is: bool = False) -> DataFrame:
    """(path, md) of mind-map archives with a JSON content; titles lose the blanks at their ends, unless as_is."""

    def expand(path: str, content: bytes) -> Iterator[tuple]:
        try:
            sheets = json.loads(zipfile.ZipFile(io.BytesIO(content or b"")).read("content.json"))
        except (zipfile.BadZipFile, KeyError, ValueError):
            return
        lines = [line for s in sheets for line in [f"## {s.get('title') or 'Sheet'}", "", *outline(s.get("rootTopic") or {}, as_is=as_is), ""]]
        yield path, "\n".join(lines).strip("\n" if as_is else None)

    run, schema = _rows("path string, md string", ["path", "md"], expand, [pa.string(), pa.string()])
    return files.select("path", "content").mapInArrow(run, schema)


def book_chapters(files: DataFrame, as_is: bool = False) -> DataFrame:
    """(path, chapter, title, md) of e-books: EPUB in spine order, FB2 sections parents first.

    Empty paragraphs of FB2 keep their place, those of EPUB only if as_is.
    """

    def expand(path: str, content: bytes) -> Iterator[tuple]:
        data = content or b""
        try:
            if data[:2] == b"PK":
                yield from ((path, i, t, m) for i, (t, m) in enumerate(_epub(zipfile.ZipFile(io.BytesIO(data)), as_is)))
            else:
                yield from ((path, i, t, m) for i, (t, m) in enumerate(_fb2(ElementTree.fromstring(data))))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return

    run, schema = _rows("path string, chapter int, title string, md string", ["path", "chapter", "title", "md"], expand, [pa.string(), pa.int32(), pa.string(), pa.string()])
    return files.select("path", "content").mapInArrow(run, schema)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _epub(book: zipfile.ZipFile, as_is: bool = False) -> Iterator[tuple[str, str]]:
    rootfile = next(e.get("full-path") for e in ElementTree.fromstring(book.read("META-INF/container.xml")).iter() if _local(e.tag) == "rootfile")
    package = ElementTree.fromstring(book.read(rootfile))
    base = rootfile.rpartition("/")[0]
    items = {e.get("id"): e.get("href") for e in package.iter() if _local(e.tag) == "item"}
    for ref in (e.get("idref") for e in package.iter() if _local(e.tag) == "itemref"):
        if ref in items:
            html = book.read(f"{base}/{items[ref]}".lstrip("/")).decode("utf-8", "replace")
            yield html_title(html), html_markdown(html, as_is)


def _fb2(root: ElementTree.Element) -> Iterator[tuple[str, str]]:
    def sections(e: ElementTree.Element) -> Iterator[tuple[str, str]]:
        text = lambda x: " ".join("".join(x.itertext()).split())
        yield next((text(c) for c in e if _local(c.tag) == "title"), ""), "\n\n".join(text(c) for c in e if _local(c.tag) == "p")
        for c in e:
            if _local(c.tag) == "section":
                yield from sections(c)

    for body in (e for e in root if _local(e.tag) == "body"):
        for s in (c for c in body if _local(c.tag) == "section"):
            yield from sections(s)


def script_block(code: Column, language: str = "matlab") -> Column:
    """Code as one fenced block; the fence is longer than any run of backticks inside."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(code, F.lit("(`+)"), F.lit(1)), F.length)), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    return F.concat(fence, F.lit(f"{language}\n"), F.regexp_replace(code, r"\s+\z", ""), F.lit("\n"), fence)


@F.pandas_udf(T.StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """JSON as an indented fenced block with its keys' order; what isn't JSON stays as it is."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return "```json\n" + json.dumps(json.loads(t.lstrip("\ufeff")), indent=2, ensure_ascii=False) + "\n```"
        except ValueError:
            return t

    return text.map(one)


#: What leaves no text at all, and what a tag stands for in text.
SILENT = ("script", "style")
BREAKS = (("br", "\n"), ("/p", "\n\n"))


def html_stripped(c: Column) -> Column:
    """HTML as text: scripts and styles go with what they hold, breaks become line ends, other tags go; entities stay."""
    for name in SILENT:
        c = F.regexp_replace(c, f"(?is)<{name}.*?>.*?</{name}>", "")
    for tag, by in BREAKS:
        c = F.regexp_replace(c, rf"(?i)<{tag}\s*/?>", by)
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), "\n\n\n+", "\n\n"), r"\A\s+|\s+\z", ""))


def html_heading(c: Column) -> Column:
    """Text of the first heading of level one or two that is closed; null without one."""
    after = F.split(c, "(?i)<h[12][^>]*>", 2)
    inside = F.when(F.size(after) > 1, F.get(F.split(F.get(after, F.lit(1)), "(?i)</h[12]>", 2), F.lit(0)))
    closed = F.get(after, F.lit(1)).rlike("(?i)</h[12]>")
    return F.nullif(F.regexp_replace(F.regexp_replace(F.when(closed, inside), "<[^>]+>", ""), r"\A\s+|\s+\z", ""), F.lit(""))


class _Text(HTMLParser):
    """The text of an HTML document, entities as they are; and that of its first heading of level one or two."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.silent: str | None = None
        self.heading: list[str] | None = None
        self.title: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent = tag
        elif tag == "br":
            self._text("\n")
        elif tag in ("h1", "h2") and self.title is None:
            self.heading = []

    def handle_endtag(self, tag):
        if tag == self.silent:
            self.silent = None
        elif tag == "p":
            self._text("\n\n")
        elif tag in ("h1", "h2") and self.heading is not None:
            self.title, self.heading = " ".join("".join(self.heading).split()), None

    def _text(self, text):
        if self.silent is None:
            self.out.append(text)
            if self.heading is not None:
                self.heading.append(text)

    handle_data = _text

    def handle_entityref(self, name):
        self._text(f"&{name};")

    def handle_charref(self, name):
        self._text(f"&#{name};")


def _read_html(html: str) -> _Text:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return parser


#: Holds the place of an empty paragraph until blank lines are settled: no character of XML.
HELD = "\x03"


class _Markdown(HTMLParser):
    """A subset of HTML as Markdown: headings, paragraphs, lists, links, images, emphasis, code, tables."""

    _SKIP = {"script", "style", "head", "template"}
    _BLOCK = {"p", "div", "section", "article", "header", "footer", "nav", "main", "aside", "ul", "ol", "table", "blockquote", "form", "figure"}

    def __init__(self, as_is: bool = False):
        super().__init__(convert_charrefs=True)
        self.as_is = as_is
        self.paragraph: int | None = None
        self.out: list[str] = []
        self.skipped = 0
        self.lists: list[list] = []
        self.links: list[str] = []
        self.cells: list[str] | None = None
        self.rows = 0
        self.code = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self._SKIP:
            self.skipped += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in self._BLOCK:
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])
            self.rows = 0 if tag == "table" else self.rows
            self.out.append("\n\n")
            self.paragraph = len(self.out) if tag == "p" else None
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "br":
            self.out.append("\n")
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "pre":
            self.code = True
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.code:
            self.out.append("`")
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th"):
            self.out.append("\x02")

    def handle_endtag(self, tag):
        if tag in self._SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n\n")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "pre":
            self.code = False
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.code:
            self.out.append("`")
        elif tag in ("td", "th") and self.cells is not None and "\x02" in self.out:
            at = len(self.out) - 1 - self.out[::-1].index("\x02")
            self.cells.append(" ".join("".join(self.out[at + 1 :]).split()).replace("|", "\\|"))
            del self.out[at:]
        elif tag == "tr" and self.cells is not None:
            if self.cells:
                self.out.append("\n| " + " | ".join(self.cells) + " |")
                if self.rows == 0:
                    self.out.append("\n|" + " --- |" * len(self.cells))
                self.rows += 1
            self.cells = None
        elif tag in self._BLOCK or tag[:1] == "h" and tag[1:].isdigit():
            if tag == "p" and self.as_is and not self.skipped and self.paragraph is not None and not "".join(self.out[self.paragraph :]).strip():
                self.out.append(HELD)
            self.paragraph = None
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.skipped:
            return
        if self.code:
            self.out.append(data)
            return
        fresh = not self.out or self.out[-1][-1:] in ("\n", " ")
        core = " ".join(data.split())
        if core:
            self.out.append(" " * (data[0].isspace() and not fresh) + core + " " * data[-1].isspace())
        elif data and not fresh:
            self.out.append(" ")


def html_markdown(html: str, as_is: bool = False) -> str:
    """A subset of HTML as Markdown; as_is: an empty paragraph is a block like others, between blank lines."""
    import re

    parser = _Markdown(as_is)
    parser.feed((html or "").replace(HELD, "") if as_is else html or "")
    parser.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(parser.out).replace("\x02", ""))
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    return text.replace(HELD, "") if as_is else text


def html_text(html: str, as_is: bool = False) -> str:
    text = "".join(_read_html(html).out)
    return text if as_is else text.strip()


def html_title(html: str) -> str:
    return _read_html(html).title or ""


@F.pandas_udf(T.StringType())
def to_markdown(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else html_markdown(h))


#: Where a live script keeps its paragraphs.
LIVE_SCRIPT = "matlab/document.xml"


def script_paragraphs(files: DataFrame) -> DataFrame:
    """(path, n, code, text): the paragraphs of live scripts (path, content) in order; what is no live script has none."""

    def expand(path: str, content: bytes) -> Iterator[tuple]:
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content or b"")).read(LIVE_SCRIPT))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return
        for n, paragraph in enumerate(x for x in root.iter() if _local(x.tag) == "p"):
            styles = [v for s in paragraph.iter() if _local(s.tag) == "pStyle" for k, v in s.attrib.items() if _local(k) == "val"]
            yield path, n, bool(styles) and styles[0].lower() == "code", "".join(t.text or "" for t in paragraph.iter() if _local(t.tag) == "t")

    run, schema = _rows("path string, n int, code boolean, text string", ["path", "n", "code", "text"], expand, [pa.string(), pa.int32(), pa.bool_(), pa.string()])
    return files.select("path", "content").mapInArrow(run, schema)


def live_scripts(paragraphs: DataFrame, as_is: bool = False) -> DataFrame:
    """(path, md) from script_paragraphs(): neighbouring code paragraphs are one fenced block, prose stands between.

    Islands of code by a running count of the other paragraphs.  Blank prose goes; other prose loses the blanks at its
    ends, unless as_is.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("n")
    rows = paragraphs.withColumn("_island", F.when(F.col("code"), F.sum((~F.col("code")).cast("int")).over(w)).otherwise(-1 - F.col("n")))
    blocks = rows.groupBy("path", "_island", "code").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("n", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["text"]), "\n")
    block = F.when(F.col("code"), script_block(text)).otherwise(text if as_is else F.trim(text))
    listed = blocks.withColumn("b", block).filter("trim(b) <> ''").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "b"))).alias("b"))
    return listed.select("path", F.concat(F.lit("## "), F.regexp_extract("path", "([^/]*)$", 1), F.lit("\n\n"), F.array_join(F.transform("b", lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("md"))
