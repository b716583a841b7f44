"""Review of transcriptions: how much a reviewed text differs, what a model's answer is worth, which rewrites are taken.

Model calls themselves are a function that the caller passes to answered(); everything around them is here.
"""

from __future__ import annotations

import difflib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.cleaning import once, stripped

SIMILARITY = 0.97
#: Fixed value: what is put behind a formula whose rewrite was not taken.
MARKER = " <!-- revisar: fórmula -->"
# types as objects: executors import this module, and have no session to parse a type's name
_CHANGES = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))
_FLAGS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("quote", "issue", "suggestion")]))


# -- how much a text differs


def _lines(text: str) -> list[str]:
    return text.strip().splitlines()


def similar(a: str, b: str) -> bool:
    """As many lines that aren't blank, and a matching-blocks ratio of 0.97 or more; a blank text is like nothing.

    The two quick ratios are upper bounds; the ratio itself takes time with the square of the texts' length.
    """
    if not a.strip() or not b.strip() or len([x for x in _lines(a) if x.strip()]) != len([x for x in _lines(b) if x.strip()]):
        return False
    matcher = difflib.SequenceMatcher(None, a, b)
    return matcher.real_quick_ratio() >= SIMILARITY and matcher.quick_ratio() >= SIMILARITY and matcher.ratio() >= SIMILARITY


@F.pandas_udf(T.BooleanType())
def is_light_proofreading(original: pd.Series, reviewed: pd.Series) -> pd.Series:
    return pd.Series([similar(a or "", b or "") for a, b in zip(original, reviewed, strict=True)])


@F.pandas_udf(_CHANGES)
def line_changes(original: pd.Series, reviewed: pd.Series) -> pd.Series:
    """Lines replaced, removed or added: the line in the original (from 1), and both sides, their lines joined by slashes."""

    def one(a: str, b: str) -> list[dict]:
        x, y = _lines(a), _lines(b)
        joined = lambda part: " / ".join(part).strip()
        return [{"line": i + 1, "before": joined(x[i:j]), "after": joined(y[k:m])} for op, i, j, k, m in difflib.SequenceMatcher(None, x, y).get_opcodes() if op != "equal"]

    return pd.Series([one(a or "", b or "") for a, b in zip(original, reviewed, strict=True)])


def change_notes(changes: Column, width: int = 110) -> Column:
    """One line for each of line_changes()."""
    return F.transform(changes, lambda c: F.concat(F.substring(c["before"], 1, width), F.lit("  ->  "), F.substring(c["after"], 1, width)))


def proofread(pages: DataFrame) -> DataFrame:
    """pages (original, reviewed, ...) with text (the review where it is a light one, else the original) and changes."""
    light = pages.withColumn("light", is_light_proofreading("original", "reviewed"))
    return light.withColumn("text", F.when(F.col("light"), F.col("reviewed")).otherwise(F.col("original"))).withColumn("changes", F.when(F.col("light"), line_changes("original", "reviewed")))


# -- answers


def unwrapped(text: Column) -> Column:
    """An answer without the code fence that encloses all of it; fences inside, or at one end only, stay."""

    def inner(t: Column) -> Column:
        body = F.regexp_extract(t, r"(?s)\A```[^\n]*\n(.*)\n[ \t]*```[^\n]*\z", 1)
        whole = t.rlike(r"(?s)\A```[^\n]*\n(.*\n)?[ \t]*```[^\n]*\z") & ~body.rlike(r"(?m)^\s*```")
        return F.when(whole, stripped(body)).otherwise(t)

    return once(stripped(F.coalesce(text, F.lit(""))), inner)


def section_body(section: Column) -> Column:
    """A section without its heading."""
    return F.regexp_replace(section, r"\A#+[^\n]*\n?", "")


def salvaged_objects(reply: str) -> list[dict]:
    """Whole JSON objects in a reply: the array in it, or as many objects as are complete."""
    found, decoder, at = [], json.JSONDecoder(), reply.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(reply, at)
        except ValueError:
            end = at + 1
        else:
            found.append(value)
        at = reply.find("{", end)
    return found


@F.pandas_udf(_FLAGS)
def judge_flags(reply: pd.Series) -> pd.Series:
    return reply.map(lambda r: [{k: str(o.get(k) or "") for k in ("quote", "issue", "suggestion")} for o in salvaged_objects(r or "")])


def flags(replies: DataFrame) -> DataFrame:
    """(path, page, quote, issue, suggestion) from a judge's replies (path, page, reply): flags without a quote don't count."""
    rows = replies.select("path", "page", F.explode(judge_flags("reply")).alias("f")).select("path", "page", "f.*")
    return rows.filter(F.trim("quote") != "")


def judged_sections(documents: DataFrame, least: int = 20) -> DataFrame:
    """(path, page, body): the pages of documents (path, md) that a judge is asked about, those with enough text."""
    parts = F.split("md", r"(?m)^(?=## Page \d)", -1)
    rows = documents.select("path", F.explode(parts).alias("part")).withColumn("page", F.regexp_extract("part", r"\A## Page (\d+)", 1).try_cast("int"))
    return rows.withColumn("body", stripped(section_body(F.col("part")))).filter(F.col("page").isNotNull() & (F.length("body") >= least)).select("path", "page", "body")


# -- rewrites of formulas

#: Greek letters and the commands for them.
GREEK = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "phi": "φ",
    "omega": "ω", "Delta": "Δ", "Sigma": "Σ", "Omega": "Ω",
}
#: Commands that spell a word out; raised and lowered digits, and the digits they are.
WORDS = ("sin", "cos", "tan", "log", "ln", "exp", "lim", "min", "max", "sup", "inf", "det", "dim", "gcd", "mod", "arg", "ker", "deg")
SMALL_DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉"


def spelled(text: Column) -> Column:
    """Sorted words and numbers of a formula as it stands on a page, Greek letters by name."""
    for name, letter in GREEK.items():
        text = F.replace(text, F.lit(letter), F.lit(f" {name} "))
    text = F.translate(F.replace(text, F.lit("µ"), F.lit(" mu ")), SMALL_DIGITS, "0123456789" * 2)
    return F.array_sort(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+|[0-9]+)"), F.lit(1)))


def spelled_latex(latex: Column) -> Column:
    """spelled() of LaTeX: commands for Greek letters and for words count as these, others not at all."""
    named = F.regexp_replace(latex, rf"\\({'|'.join([*GREEK, *WORDS])})(?![A-Za-z])", " $1 ")
    return F.array_sort(F.regexp_extract_all(F.lower(F.regexp_replace(named, r"\\[A-Za-z]+", " ")), F.lit("([a-z]+|[0-9]+)"), F.lit(1)))


def rewritten(pages: DataFrame, spans: DataFrame, rewrites: DataFrame) -> DataFrame:
    """(page, text, accepted, rejected): pages (page, text) with the rewrites (page, span, latex) of spans (page, span, start, end).

    A rewrite is taken if it has the same words and numbers as the span, however often each; other spans get a marker behind.
    """
    met = spans.join(rewrites, ["page", "span"], "left").join(pages.select("page", F.col("text").alias("_text")), "page")
    own = F.expr("substring(_text, start + 1, end - start)")
    good = F.coalesce((F.coalesce("latex", F.lit("")) != "") & (spelled(own) == spelled_latex(F.col("latex"))), F.lit(False))
    met = met.withColumn("good", good).withColumn("put", F.when(F.col("good"), F.col("latex")).otherwise(F.concat(own, F.lit(MARKER))))
    listed = met.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("start", "end", "put"))).alias("s"), F.count_if("good").alias("accepted"), F.count_if(~F.col("good")).alias("rejected"))
    rows = pages.join(listed, "page", "left")
    # the text up to each span, what stands for the span, and the text after the last one
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("s", i - 1)["end"])
    piece = lambda x, i: F.concat(F.substr("text", begin(i) + 1, x["start"] - begin(i)), x["put"])
    put = F.concat(F.array_join(F.transform("s", piece), ""), F.substr("text", F.element_at("s", -1)["end"] + 1))
    return rows.select("page", F.when(F.col("s").isNull(), F.col("text")).otherwise(put).alias("text"), F.coalesce("accepted", F.lit(0)).cast("long").alias("accepted"), F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected"))


# -- what a model is asked


def latex_commands(text: Column) -> Column:
    """Names of the LaTeX commands inside mathematics, sorted, each once."""
    maths = F.regexp_extract_all(text, F.lit(r"(?s)(\$\$.+?\$\$|\$[^$\n]+\$)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(maths, lambda m: F.regexp_extract_all(m, F.lit(r"\\([A-Za-z]+)"), F.lit(1))))))


def review_request(text: Column) -> Column:
    """A text to proofread, with the commands it uses where it uses any."""
    hint = once(latex_commands(text), lambda c: F.when(F.size(c) > 0, F.concat(F.lit("\n\nLaTeX commands in this text: "), F.array_join(F.transform(c, lambda x: F.concat(F.lit("\\"), x)), ", "), F.lit(". Write those that don't exist with \\operatorname and keep the others."))).otherwise(""))
    return F.concat(F.lit("Text to proofread:\n\n"), text, hint)


def language_request(language: Column) -> Column:
    """In which language a caption is wanted."""
    return F.when(language == "es", "Responde en español.").when(language == "en", "Answer in English.").otherwise("Answer in the language of the page.")


# -- errors and repeated calls


def error_class(message: Column) -> Column:
    """What a failed call's message says: quota (never tried again), rate, malformed, connection, or other."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(m.rlike("insufficient_quota|exceeded your current quota|credit balance|billing"), "quota").when(F.contains(m, F.lit("429")) | F.contains(m, F.lit("rate limit")), "rate")
        .when(F.contains(m, F.lit("invalid response from")) | (F.contains(m, F.lit("validation error")) & F.contains(m, F.lit("chatcompletion"))), "malformed").when(F.contains(m, F.lit("connection error")), "connection").otherwise("other")
    )


def is_retried(kind: Column) -> Column:
    return kind.isin("rate", "malformed")


def soft_failure(kind: Column, local: Column, model: Column) -> Column:
    """The warning that a job carries for a call that was left out; null where the failure is the call's own."""
    return F.when(local & (kind == "connection"), F.concat(F.lit("no connection to "), model)).when(~local & (kind == "quota"), F.concat(F.lit("no credit left for "), model))


def waits(attempts: int = 5, first: float = 2.0) -> list[float]:
    """Seconds before each further attempt: doubled every time."""
    return [first * 2**i for i in range(attempts)]


def with_backoff(call: Callable[[], object], again: Callable[[Exception], bool], pauses: list[float] | None = None, sleep: Callable[[float], None] = time.sleep):
    """call(), tried again after each pause while it fails in a way that is worth it."""
    for pause in waits() if pauses is None else pauses:
        try:
            return call()
        except Exception as failure:
            if not again(failure):
                raise
            sleep(pause)
    return call()


def answered(images: DataFrame, answer: Callable[[bytes], str], cache: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """images (content, ...) with key and text: each different content is answered once, and not at all where the cache has a text.

    cache: (key, text); an empty text counts as missing.  A failed call leaves the text null.
    """
    keyed = images.withColumn("key", F.sha2(F.concat(F.encode(F.lit(prefix), "UTF-8"), F.col("content")), 256))
    known = keyed.limit(0).select("key", F.lit("").alias("text")) if cache is None else cache.filter(F.trim("text") != "").groupBy("key").agg(F.min("text").alias("text"))
    wanted = keyed.groupBy("key").agg(F.first("content").alias("content")).join(known, "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            for content in batch.column(1).to_pylist():
                try:
                    out.append(answer(content))
                except Exception:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "text"])

    return keyed.join(known.unionByName(wanted.select("key", "content").mapInArrow(run, "key string, text string")), "key", "left")
