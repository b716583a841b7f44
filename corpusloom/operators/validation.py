"""Document cleaning as a whole, and the validator's rules as DataFrames of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import cleaning as C
from corpusloom.functions.prose import FRONTMATTER, language

#: LaTeX markup that must not be left over.
LATEX_MARKS = ("\\[", "\\]", "\\(", "\\)", "\\begin{equation}", "\\section{", "\\subsection{", "\\textbf{")
ORPHAN_ACCENT = "[A-Za-z][\u00b4\u02dc\u00a8\u02c6\u02c7\u02da]|[\u00b4\u02dc\u00a8\u02c6\u02c7\u02da][A-Za-z]"
SCRAMBLED_TOKENS, SCRAMBLED_SHARE, EMPTY_CHARS = 25, 0.6, 20



def page_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n, line, page): lines with the number of page headings so far, computed inside each document."""
    parts = docs.select("doc_id", F.posexplode(C.pages_of(F.col("md"))).alias("page", "part"))
    return parts.select("doc_id", "page", F.posexplode(F.split(F.regexp_replace("part", "\n$", ""), "\n", -1)).alias("n", "line"))


def pages(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, page, part): page sections from 1, their printed numbers, and their text after "## Page "."""
    parts = F.split(F.concat(F.lit("\n"), F.col("md")), "\n## Page ", -1)
    rows = docs.select("doc_id", F.posexplode(parts).alias("pos", "part")).filter("pos > 0")
    return rows.select("doc_id", "pos", F.regexp_extract("part", "^([0-9]+)", 1).try_cast("int").alias("page"), "part")


def clean(docs: DataFrame, text: str = "md") -> DataFrame:
    """docs with out (in place of a column of that name): all cleaning steps in their order; a null text stays null."""
    return docs.withColumn("out", C.cleaned(F.col(text)))


# -- rules: each is a list of findings of one text, so that all of them take one look at each document

FINDING = "array<struct<rule: string, severity: string, detail: string, line: int>>"


def _found(rule: str, severity: str, detail: Column, line: Column | None = None) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.alias("detail"), (F.lit(None) if line is None else line).cast("int").alias("line"))


def _none() -> Column:
    return F.array().cast(FINDING)


def _if(condition: Column, finding: Column) -> Column:
    return F.when(condition, F.array(finding)).otherwise(_none())


def occurrences(text: Column, part: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def line_at(head: Column) -> Column:
    """Line of what follows head."""
    return (occurrences(head, F.lit("\n")) + 1).cast("int")


def line_of(text: Column, part: Column) -> Column:
    """Line of the first occurrence of part."""
    return line_at(F.left(text, F.instr(text, part) - 1))


def line_of_match(text: Column, pattern: str) -> Column:
    """Line of the first match."""
    return line_at(F.get(F.split(text, pattern, 2), F.lit(0)))


#: A fenced block: its first line, what it encloses, and its last line, which begins with the same mark, or the text's end.
FENCED = r"(?ms)(^[ \t]*(```|~~~)[^\n]*$)(.*?)(^[ \t]*\2[^\n]*$|\z)"


def without_code(text: Column) -> Column:
    """Fenced lines blanked, their number kept; a fence closes at a line with the mark that opened it."""
    part = lambda block, n: F.regexp_extract(block, FENCED, n)
    blank = lambda block: F.concat(part(block, 1), F.regexp_replace(part(block, 3), r"[^\n]", ""), part(block, 4))
    return F.when(text.rlike("```|~~~"), C.rebuilt(text, FENCED, lambda x: x, blank)).otherwise(text)


def incomplete(text: Column) -> Column:
    return _if(text.rlike(r"(?m)^> \*\*INCOMPLETO:\*\*"), _found("incomplete_conversion", "error", F.lit("conversion stopped early; re-run to finish the missing pages")))


def control_chars(text: Column) -> Column:
    codes = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("([\\x00-\\x08\\x0b-\\x1f])"), F.lit(1))))
    name = lambda ch: F.when(F.ascii(ch) == 0, "NUL").otherwise(F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(ch)), 4, "0")))
    each = F.transform(codes, lambda ch: _found("control_chars", "error", F.concat(name(ch), F.lit(" control character appears "), occurrences(text, ch).cast("string"), F.lit(" time(s)"))))
    return F.when(text.rlike("[\\x00-\\x08\\x0b-\\x1f]"), each).otherwise(_none())


def latex_delimiters(free: Column) -> Column:
    """free: a text without_code()."""
    marks = F.filter(F.array(*map(F.lit, LATEX_MARKS)), lambda m: F.contains(free, m))
    each = F.transform(marks, lambda m: _found("latex_delimiters", "error", F.concat(F.lit("leftover LaTeX markup '"), m, F.lit("' ("), occurrences(free, m).cast("string"), F.lit(" occurrence(s))")), line_of(free, m)))
    return F.when(F.contains(free, F.lit("\\")), each).otherwise(_none())


def environments(free: Column) -> Column:
    """(env, begins, ends) of every environment whose sides differ in number."""
    sides = lambda all_: F.transform(F.array_sort(F.array_distinct(F.transform(all_, lambda m: F.substring_index(m, "{", -1)))), lambda env: F.struct(env.alias("env"), F.size(F.filter(all_, lambda m: m == F.concat(F.lit("begin{"), env))).alias("begins"), F.size(F.filter(all_, lambda m: m == F.concat(F.lit("end{"), env))).alias("ends")))
    return F.filter(C.once(F.regexp_extract_all(free, F.lit(r"\\((?:begin|end)\{\w+)\}"), F.lit(1)), sides), lambda x: x["begins"] != x["ends"])


def unbalanced_math(free: Column) -> Column:
    dollars = occurrences(free, F.lit("$$"))
    odd = _if(dollars % 2 == 1, _found("unbalanced_math", "error", F.concat(F.lit("odd number of '$$' delimiters ("), dollars.cast("string"), F.lit(")")), line_of(free, F.lit("$$"))))
    first = lambda env: F.least(*[F.when(F.instr(free, F.concat(F.lit(side), env, F.lit("}"))) > 0, F.instr(free, F.concat(F.lit(side), env, F.lit("}")))) for side in ("\\begin{", "\\end{")])
    detail = lambda x: F.concat(F.lit("\\begin{"), x["env"], F.lit("} ("), x["begins"].cast("string"), F.lit(") does not match \\end{"), x["env"], F.lit("} ("), x["ends"].cast("string"), F.lit(")"))
    sides = F.transform(environments(free), lambda x: _found("unbalanced_math", "error", detail(x), line_at(F.left(free, first(x["env"]) - 1))))
    return F.when(F.contains(free, F.lit("$$")) | F.contains(free, F.lit("\\")), F.concat(odd, sides)).otherwise(_none())


def scrambled_share(part: Column) -> Column:
    """(tokens, singles): words of a text, and those of one character."""
    return C.once(F.regexp_extract_all(part, F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1)), lambda t: F.struct(F.size(t).alias("tokens"), F.size(F.filter(t, lambda w: F.length(w) == 1)).alias("singles")))


def is_scrambled(part: Column) -> Column:
    return C.once(scrambled_share(part), lambda s: (s["tokens"] >= SCRAMBLED_TOKENS) & (s["singles"] > SCRAMBLED_SHARE * s["tokens"]))


PAGE = r"(?m)^(?=## Page \d)"


def scrambled(text: Column) -> Column:
    def pages(parts: Column) -> Column:
        number = lambda p: F.regexp_extract(p, r"\A## Page (\d+)", 1)
        hits = F.filter(F.transform(parts, lambda p, i: F.when(number(p) != "", F.when(is_scrambled(F.regexp_replace(p, r"\A## Page \d+", "")), i))), lambda i: i.isNotNull())
        finding = lambda i: _found("scrambled_text", "warning", F.concat(F.lit("page "), number(F.get(parts, i)), F.lit(" text looks scrambled")), line_at(F.array_join(F.slice(parts, 1, i), "")))
        return F.transform(hits, finding)

    return C.once(F.split(text, PAGE, -1), pages)


def orphan_accents(text: Column) -> Column:
    detail = F.concat(F.regexp_count(text, F.lit(ORPHAN_ACCENT)).cast("string"), F.lit(" orphan accent glyph(s) next to a letter (e.g. '"), F.regexp_substr(text, F.lit(ORPHAN_ACCENT)), F.lit("')"))
    return _if(text.rlike(ORPHAN_ACCENT), _found("orphan_accents", "warning", detail, line_of_match(text, ORPHAN_ACCENT)))


def body_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(text, FRONTMATTER, ""), r"\A\s+|\s+\z", ""))


def empty_output(text: Column) -> Column:
    return C.once(body_chars(text), lambda n: _if(n < EMPTY_CHARS, _found("empty_output", "warning", F.concat(F.lit("body has only "), n.cast("string"), F.lit(" character(s) after frontmatter")))))


IMAGE_LINK = r"!\[[^\]]*\]\(([^)]+)\)"


def link_target(link: Column) -> Column:
    """The file that an image link's inside names: without title, brackets and white space; null for web and data addresses and for nothing."""
    untitled = C.once(F.trim(link), lambda x: F.when(F.contains(x, F.lit(' "')), F.substring_index(x, ' "', 1)).otherwise(F.substring_index(x, " '", 1)))
    return C.once(F.regexp_replace(F.trim(untitled), "^[<>]+|[<>]+$", ""), lambda x: F.when((x != "") & ~x.rlike("^(?:https?://|data:)"), x))


def missing_assets(text: Column, there: Column) -> Column:
    """Image links whose target is not among there, the files around the document."""

    def checked(links: Column, between: Column) -> Column:
        missing = F.filter(F.transform(links, lambda l, i: F.struct(link_target(l).alias("target"), i.alias("i"))), lambda x: x["target"].isNotNull() & ~F.array_contains(there, x["target"]))
        # what stands before link i: as many stretches between links, and as many lines inside the links before
        lines = lambda i: F.aggregate(F.concat(F.slice(between, 1, i + 1), F.slice(links, 1, i)), F.lit(1).cast("long"), lambda n, part: n + occurrences(part, F.lit("\n")))
        return F.transform(missing, lambda x: _found("missing_figure_assets", "warning", F.concat(F.lit("image target '"), x["target"], F.lit("' does not exist")), lines(x["i"])))

    each = C.once(F.regexp_extract_all(text, F.lit(IMAGE_LINK), F.lit(1)), lambda links: C.once(F.split(text, IMAGE_LINK, -1), lambda between: checked(links, between)))
    return F.when(F.contains(text, F.lit("![")), each).otherwise(_none())


CAPTION = r"(?m)^> \*\*Figura.*$"


def language_mismatch(text: Column) -> Column:
    """Captions of figures in another language than the frontmatter says."""
    said = F.lower(F.regexp_extract(F.regexp_extract(text, FRONTMATTER, 0), r'(?m)^language:\s*"?([A-Za-z]{2})"?\s*$', 1))

    def checked(said: Column, captions: Column, between: Column) -> Column:
        told = F.transform(captions, lambda c, i: F.struct(language(c).alias("told"), i.alias("i")))
        lines = lambda i: F.aggregate(F.slice(between, 1, i + 1), F.lit(1).cast("long"), lambda n, part: n + occurrences(part, F.lit("\n")))
        detail = lambda x: F.concat(F.lit("frontmatter declares language '"), said, F.lit("' but a figure caption looks like '"), x["told"], F.lit("'"))
        return F.transform(F.filter(told, lambda x: x["told"].isNotNull() & (x["told"] != said)), lambda x: _found("language_mismatch", "warning", detail(x), lines(x["i"])))

    each = C.once(said, lambda s: C.once(F.regexp_extract_all(text, F.lit(CAPTION), F.lit(0)), lambda c: C.once(F.split(text, CAPTION, -1), lambda b: checked(s, c, b))))
    return F.when(text.rlike(r"\A---\n") & text.rlike(CAPTION), F.when(said != "", each).otherwise(_none())).otherwise(_none())


def findings_of(text: Column, there: Column | None = None) -> Column:
    """All rules over one text; there: files around the document, without it the rule on image links isn't tried."""

    def rules(t: Column) -> Column:
        listed = [incomplete(t), control_chars(t), C.once(without_code(t), lambda free: F.concat(latex_delimiters(free), unbalanced_math(free))), scrambled(t), orphan_accents(t), empty_output(t), language_mismatch(t)]
        return F.concat(*listed, *([] if there is None else [missing_assets(t, there)]))

    return C.once(F.coalesce(text, F.lit("")), rules)


def findings(docs: DataFrame, assets: DataFrame | None = None, text: str = "md", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, rule, severity, detail, line) of all rules in one look at each document.

    assets: (doc_id, target), the files around each document; without it the rule on image links isn't tried.
    A null text counts as empty.
    """
    there = None
    if assets is not None:
        listed = assets.groupBy("doc_id").agg(F.collect_set("target").alias("_there"))
        docs, there = docs.join(listed, "doc_id", "left"), F.coalesce("_there", F.array().cast("array<string>"))
    rows = docs.select("doc_id", *keep, findings_of(F.col(text), there).alias("_f"))
    return rows.select("doc_id", *keep, F.explode_outer("_f").alias("f")).filter("f is not null").select("doc_id", *keep, "f.*")


def in_report_order(found: DataFrame, path: str = "path") -> DataFrame:
    """Findings by path, rule, line (those without first) and detail."""
    return found.orderBy(path, "rule", F.coalesce("line", F.lit(-1)), "detail")


def skipped_outputs(path: Column, reports: tuple[str, ...] = ("report",)) -> Column:
    """Whether the validator leaves a path below its root out: hidden parts, and the reports that the engine writes itself."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return path.rlike(r"(^|/)\.") | reduce(lambda a, b: a | b, [name.startswith(r) for r in reports])


def skipped_by_judge(path: Column) -> Column:
    """Whether the judge leaves a path out: hidden parts, and its own queue."""
    return path.rlike(r"(^|/)\.") | (F.regexp_extract(path, "([^/]*)$", 1) == "review-queue.md")
