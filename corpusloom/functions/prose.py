"""Language, frontmatter, token and mathematics functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.cleaning import once

#: Function words that tell Spanish and English.
SPANISH = ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "para", "con", "por", "como", "más", "pero", "este", "esta", "también", "porque")
ENGLISH = ("the", "and", "of", "to", "in", "a", "is", "that", "for", "on", "with", "as", "this", "are", "was", "be", "by", "from", "or", "an")
#: Characters that make a token mathematical, and short tokens that may be.
MATH_SYMBOL = "[\u0370-\u03ff\u1f00-\u1fff\u2070-\u209f\u00b2\u00b3\u00b9\u221a\u00b1\u00b7\u00d7\u00f7\u2264\u2265\u2260\u221e\u2211\u222b\u00af\u2212+=^_{}\\\\]"
MATH_CANDIDATE = "^(?:[A-Za-z\u0370-\u03ff\u1f00-\u1fff]{1,3}[0-9]{1,2}|[0-9]{1,2})$"
#: White space of a token's ends, Unicode's and the four separators that Python counts in.
SPACE = "\\s\u000b\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN, SYMBOL, CANDIDATE = re.compile(r"\S+"), re.compile(MATH_SYMBOL), re.compile(MATH_CANDIDATE)
#: Characters that the language is told from: a longer text is told by its beginning, which is the feature.
SAMPLE_CHARS = 4000


def prose_only(c: Column) -> Column:
    """Without fenced code, links, mathematics and LaTeX commands."""
    for pattern in (r"(?s)```.*?```", r"!?\[[^\]]*\]\([^)]*\)", r"(?s)\$\$.+?\$\$|\$[^$\n]+\$", r"\\[A-Za-z]+"):
        c = F.regexp_replace(c, pattern, " ")
    return c


def language_hits(c: Column) -> Column:
    """(n, es, en): tokens among the first characters of the prose, and function words of both languages among them."""
    tokens = F.regexp_extract_all(F.lower(F.substring(prose_only(F.coalesce(c, F.lit(""))), 1, SAMPLE_CHARS)), F.lit("([A-Za-zÁÉÍÓÚÜÑáéíóúüñ']+)"), F.lit(1))
    hits = lambda t, listed: F.size(F.filter(t, lambda w: w.isin(list(listed))))
    return once(tokens, lambda t: F.struct(F.size(t).alias("n"), hits(t, SPANISH).alias("es"), hits(t, ENGLISH).alias("en")))


def _guess(h: Column) -> Column:
    return F.when(h["n"] < 20, None).when((h["es"] >= h["en"] * 1.2) & (h["es"] >= 4), "es").when((h["en"] >= h["es"] * 1.2) & (h["en"] >= 4), "en")


def language(c: Column) -> Column:
    """es, en, or null for too little signal, told from a text's first 4,000 characters of prose."""
    return once(language_hits(c), _guess)


def with_language(df: DataFrame, text: str) -> DataFrame:
    """df with es, en (hits among the first characters' tokens) and language: es, en or null for too little signal."""
    df = df.withColumn("_hits", language_hits(F.col(text)))
    return df.withColumns({"es": F.col("_hits.es"), "en": F.col("_hits.en"), "language": _guess(F.col("_hits"))}).drop("_hits")


#: A document's frontmatter.
FRONTMATTER = r"(?s)\A---\n.*?\n---\n?"


def with_frontmatter(df: DataFrame, text: str = "md") -> DataFrame:
    """block, body, language and title (first level-one heading) of a document."""
    df = df.withColumn("block", F.regexp_extract(text, FRONTMATTER, 0))
    df = df.withColumn("body", F.col(text).substr(F.length("block") + 1, F.length(text)))
    return df.withColumn("language", F.nullif(F.regexp_extract("block", r'(?m)^language: "?([a-z]+)', 1), F.lit(""))).withColumn("title", F.nullif(F.regexp_extract(text, "(?m)^# (.+)$", 1), F.lit("")))


def yaml_scalar(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def frontmatter_block(fields: dict[str, Column]) -> Column:
    """A YAML block; null fields are left out, numbers stand plain."""
    lines = [F.concat(F.lit(f"{k}: "), yaml_scalar(v) if k != "char_count" else v.cast("string")) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("((?U)\\w+)"), F.lit(1))


def short_token_ratio(c: Column) -> Column:
    """Share of tokens of up to four characters; null below twenty tokens."""
    t = F.regexp_extract_all(c, F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1))
    return F.when(F.size(t) >= 20, F.size(F.filter(t, lambda x: F.length(x) <= 4)) / F.size(t))


def ranked_within(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, first, last): the ranks from 0 that each distinct value holds within key.

    Values are counted first, so the window runs over distinct values, however hot a key is, and no run is spelled out.
    """
    counts = df.groupBy(key, value).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(key).orderBy(value)
    runs = counts.withColumn("_end", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.select(key, value, (F.col("_end") - F.col("_c")).alias("first"), (F.col("_end") - 1).alias("last"))


def math_tokens(df: DataFrame, text: str) -> DataFrame:
    df = df.withColumn("_t", F.regexp_extract_all(text, F.lit("(\\S+)"), F.lit(1)))
    return df.withColumns({"tokens": F.size("_t"), "symbols": F.size(F.filter("_t", lambda t: t.rlike(MATH_SYMBOL))), "candidates": F.size(F.filter("_t", lambda t: t.rlike(MATH_CANDIDATE)))}).drop("_t")


class Spans:
    """The runs of mathematical tokens of one text.

    A token with a symbol is mathematical.  A candidate becomes so if a symbol stands in the window to its right, if the
    window around it holds three candidates, or if a mathematical token stands in the window to its left; the last rule
    carries on to the right.  Candidates and symbols whose distances stay within the window make an island, and from
    the first token of an island that is mathematical by itself, all of the island is.
    """

    def __init__(self, text: str, window: int = 2):
        self.text = text or ""
        found = [(m.start(), m.end()) for m in TOKEN.finditer(self.text)]
        self.begin, self.end = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        n = len(found)
        listed = [self.text[a:b] for a, b in found]
        symbol = np.fromiter((SYMBOL.search(t) is not None for t in listed), bool, n)
        short = np.fromiter((CANDIDATE.fullmatch(t) is not None for t in listed), bool, n)
        padded = np.concatenate([np.zeros(window, np.int64), short, np.zeros(window, np.int64)])
        crowd = sum(padded[k : k + n] for k in range(2 * window + 1))
        ahead = np.concatenate([symbol, np.zeros(window, bool)])
        ahead = np.logical_or.reduce([ahead[k : k + n] for k in range(window + 1)]) if n else symbol
        alone = symbol | (short & (ahead | (crowd >= 3)))
        self.inside = self._carried(np.flatnonzero(alone | short), alone, window)
        self._runs(short, np.fromiter((t == "√" for t in listed), bool, n))

    @staticmethod
    def _carried(concerned: np.ndarray, alone: np.ndarray, window: int) -> np.ndarray:
        """Of the concerned tokens, those from the first of their island that stands alone on."""
        inside = np.zeros(len(alone), bool)
        if len(concerned):
            island = np.concatenate([[0], np.cumsum(np.diff(concerned) > window)])
            first = np.full(island[-1] + 1, len(alone))
            np.minimum.at(first, island[alone[concerned]], concerned[alone[concerned]])
            inside[concerned[concerned >= first[island]]] = True
        return inside

    def _runs(self, short: np.ndarray, root: np.ndarray) -> None:
        edge = np.diff(np.concatenate([[0], self.inside.astype(np.int8), [0]]))
        self.first, self.last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        total = lambda x: np.concatenate([[0], np.cumsum(x)])[self.last + 1] - np.concatenate([[0], np.cumsum(x)])[self.first]
        size, bits = self.last - self.first + 1, total(short)
        # a bare root sign has lost what stood under it; so has a run of two or more that is all candidates but one
        self.lost = (total(root) > 0) | ((size > 1) & (bits > 1) & (bits >= size - 1))

    def rows(self) -> list[tuple[int, int, int, str, bool]]:
        a, b = self.begin[self.first].tolist(), self.end[self.last].tolist()
        return [(i, s, e, self.text[s:e], bool(x)) for i, (s, e, x) in enumerate(zip(a, b, self.lost, strict=True))]

    def density(self) -> float:
        return round(float(self.inside.mean()), 9) if len(self.inside) else 0.0


def _some_mathematics(text: str) -> Column:
    """Whether a text can have a span at all: others needn't go to Python."""
    return F.col(text).rlike(MATH_SYMBOL) | F.col(text).rlike(f"(?<![^{SPACE}])(?:[A-Za-zͰ-Ͽἀ-῿]{{1,3}})?[0-9]{{1,2}}(?![^{SPACE}])")


def math_spans(df: DataFrame, text: str) -> DataFrame:
    """(doc_id, span, start, end, text, structure_lost) of every document with spans; a null text has none."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *r) for i, t in enumerate(batch.column(1).to_pylist()) for r in Spans(t).rows()]
            whose, *columns = zip(*rows, strict=True) if rows else [()] * 6
            types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose, pa.int64())), *map(pa.array, columns, types)], names=["doc_id", "span", "start", "end", "text", "structure_lost"])

    return df.filter(_some_mathematics(text)).select("doc_id", text).mapInArrow(run, f"doc_id {kind}, span int, start int, end int, text string, structure_lost boolean")


def math_density(df: DataFrame, text: str) -> DataFrame:
    """(doc_id, density, structure_lost) of every document: share of tokens inside spans, and whether a span lost its structure.

    One pass over the rows, without a join; a null text, or one without tokens, has density 0.
    """
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Spans(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.density() for f in found], pa.float64()), pa.array([bool(f.lost.any()) for f in found], pa.bool_())], names=["doc_id", "density", "structure_lost"])

    return df.select("doc_id", F.when(_some_mathematics(text), F.col(text)).alias("_text")).mapInArrow(run, f"doc_id {kind}, density double, structure_lost boolean")


def wants_math_format(density: Column, reviewer: Column, least: float = 0.08) -> Column:
    """Whether a page goes to the reviewer for its mathematics."""
    return F.coalesce((density >= least) & reviewer, F.lit(False))


def token_offsets(df: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """(key, n, start, end, token) of all tokens of every document, in order; a null text has none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(i, n, m.start(), m.end(), m.group()) for i, t in enumerate(part.column(1).to_pylist()) for n, m in enumerate(TOKEN.finditer(t or ""))]
                whose, *columns = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(whose, pa.int64())), *map(pa.array, columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=[key, "n", "start", "end", "token"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n int, start int, end int, token string")


def now_iso() -> Column:
    """The time of the query as ISO 8601 in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
