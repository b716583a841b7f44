"""Cleaning, page, validation, language and mathematics queries over Markdown documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import cleaning as C
from corpusloom.functions import prose as P
from corpusloom.operators import chunking, validation
from corpusloom.plans.catalog import query
from corpusloom.sources.tables import MD_DOCS, duck_text, markdown_documents, table

WITH = f"WITH {MD_DOCS}"


def _md(spark, sf_dir) -> DataFrame:
    return markdown_documents(spark, sf_dir)


def _changed(df: DataFrame, after: Column) -> DataFrame:
    """doc_id, digest of the changed text and whether it changed."""
    df = df.withColumn("out", after)
    return df.select("doc_id", F.md5(F.col("out").cast("binary")).alias("digest"), (F.col("out") != F.col("md")).alias("changed"))


def _changed_sql(expr: str) -> str:
    return f"{WITH} SELECT doc_id, md5(out) AS digest, out <> md AS changed FROM (SELECT doc_id, md, {expr} AS out FROM md_docs)"


def _sql_replaced(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {duck_text(a)}, {duck_text(b)})"
    return expr


def _sql_ligatures(expr: str) -> str:
    controls = "[\\x00-\\x08\\x0b-\\x1f\\x7f]"
    return _sql_replaced(f"regexp_replace({_sql_replaced(expr, C.CONTROL_CODES)}, '{controls}', '', 'g')", C.LIGATURES)


def _sql_accents(expr: str) -> str:
    for spacing, combining in C.ACCENTS:
        expr = f"regexp_replace({expr}, {duck_text(spacing)} || '([A-Za-z])', '\\1' || {duck_text(combining)}, 'g')"
    for spacing, combining in C.ACCENTS:
        expr = f"regexp_replace({expr}, '([A-Za-z])' || {duck_text(spacing)}, '\\1' || {duck_text(combining)}, 'g')"
    return expr


@query("clean_mojibake", _changed_sql(_sql_replaced("md", C.MOJIBAKE + C.C1_QUOTES)))
def clean_mojibake(spark, sf_dir):
    return _changed(_md(spark, sf_dir), C.mojibake(F.col("md")))


@query("clean_ligatures", _changed_sql(_sql_ligatures("md")))
def clean_ligatures(spark, sf_dir):
    return _changed(_md(spark, sf_dir), C.ligatures(F.col("md")))


@query("clean_accents", _changed_sql(f"nfc_normalize({_sql_accents(_sql_ligatures('md'))})"))
def clean_accents(spark, sf_dir):
    """Ligatures and control codes first: accents are composed in what they leave."""
    return _changed(_md(spark, sf_dir), C.pdf_artifacts(F.col("md")))


_LATEX_SQL = "seg"
for _env in C.ENVIRONMENTS:
    _quoted = _env.replace("*", "\\*")
    _LATEX_SQL = f"regexp_replace({_LATEX_SQL}, '(?s)\\\\begin\\{{{_quoted}\\}}\\s*(.+?)\\s*\\\\end\\{{{_quoted}\\}}', chr(10) || '$$' || chr(10) || '\\1' || chr(10) || '$$' || chr(10), 'g')"
_LATEX_SQL = f"regexp_replace({_LATEX_SQL}, '(?s)\\\\\\[\\s*(.+?)\\s*\\\\\\]', '$$\\1$$', 'g')"
_LATEX_SQL = f"regexp_replace({_LATEX_SQL}, '(?s)\\\\\\(\\s*(.+?)\\s*\\\\\\)', '$\\1$', 'g')"
for _command, _mark in C.SECTIONS:
    _LATEX_SQL = f"regexp_replace({_LATEX_SQL}, '(?m)^[ \\t]*\\\\{_command}\\*?\\{{\\s*([^}}]*?)\\s*\\}}[ \\t]*$', '{_mark} \\1', 'g')"
_LATEX_SQL = f"regexp_replace(regexp_replace({_LATEX_SQL}, '\\\\textbf\\{{([^}}]*)\\}}', '**\\1**', 'g'), '\\\\textit\\{{([^}}]*)\\}}', '*\\1*', 'g')"


def _latex_ctes(source: str, name: str) -> str:
    """name (doc_id, md): LaTeX rewritten outside fences."""
    return f"""{name}_cut AS (SELECT doc_id, md, regexp_extract_all(md, '(?s)```.*?```') AS fences,
      string_split(regexp_replace(md, '(?s)```.*?```', chr(1) || chr(2), 'g'), chr(1) || chr(2)) AS segs FROM {source}),
    {name} AS (SELECT doc_id, CASE WHEN contains(md, chr(92)) THEN array_to_string(list_transform(range(len(segs)), lambda i: list_transform([segs[i + 1]], lambda seg: {_LATEX_SQL})[1] || coalesce(fences[i + 1], '')), '') ELSE md END AS md FROM {name}_cut)"""


def _digest_sql(ctes: str, name: str) -> str:
    return f"{WITH}, {ctes} SELECT doc_id, md5({name}.md) AS digest, {name}.md <> md_docs.md AS changed FROM {name} JOIN md_docs USING (doc_id)"


def _lines_cte(source: str, name: str) -> str:
    """name (doc_id, n, l, free): lines; free outside fences and no fence mark."""
    return f"""{name}_l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS l, generate_subscripts(string_split(md, chr(10)), 1) AS n FROM {source}),
    {name}_m AS (SELECT *, regexp_matches(l, '^[ \\t]*```') AS mark FROM {name}_l),
    {name} AS (SELECT doc_id, n, l, NOT mark AND coalesce(sum(CAST(mark AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n), 0) % 2 = 0 AS free FROM {name}_m)"""


def _reflow_ctes(source: str, name: str) -> str:
    return f"""{_lines_cte(source, name + "_x")},
    {name}_p AS (SELECT doc_id, n, l, free AND l <> '' AND NOT regexp_matches(ltrim(l, ' ' || chr(9)), '^[#|]') AND NOT regexp_matches(l, '{C.LIST_ITEM}') AS prose FROM {name}_x),
    {name}_g AS (SELECT doc_id, n, CASE WHEN n = 1 THEN '' WHEN prose AND lag(prose) OVER (PARTITION BY doc_id ORDER BY n) THEN ' ' ELSE chr(10) END || CASE WHEN prose THEN regexp_replace(l, '^\\s+|\\s+$', '', 'g') ELSE l END AS l FROM {name}_p),
    {name} AS (SELECT doc_id, string_agg(l, '' ORDER BY n) AS md FROM {name}_g GROUP BY doc_id)"""


_PAGE_LINE = "regexp_matches(trim(l, ' ' || chr(9) || chr(13)), '^(Page [0-9]+ of [0-9]+|- [0-9]+ -|[0-9]+/[0-9]+)$')"


def _headers_ctes(source: str, name: str) -> str:
    return f"""{name}_l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS l, generate_subscripts(string_split(md, chr(10)), 1) AS n FROM {source}),
    {name}_p AS (SELECT *, trim(l, ' ' || chr(9) || chr(13)) AS t, regexp_matches(l, '^## Page\\b') AS head, sum(CAST(regexp_matches(l, '^## Page\\b') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n) AS page FROM {name}_l),
    {name}_r AS (SELECT doc_id, t FROM {name}_p WHERE page > 0 AND NOT head AND length(t) BETWEEN 1 AND {C.HEADER_CHARS} AND NOT starts_with(t, '#') GROUP BY doc_id, t HAVING count(DISTINCT page) >= {C.HEADER_PAGES}),
    {name}_k AS (SELECT p.doc_id, n, l, head, page, pages FROM (SELECT *, max(page) OVER (PARTITION BY doc_id) AS pages FROM {name}_p) p LEFT JOIN {name}_r r ON p.doc_id = r.doc_id AND p.t = r.t WHERE page = 0 OR head OR r.t IS NULL),
    {name}_j AS (SELECT doc_id, pages, string_agg(l, chr(10) ORDER BY n) AS md FROM {name}_k WHERE head OR (page = 0 AND pages > 0) OR NOT {_PAGE_LINE} GROUP BY doc_id, pages),
    {name} AS (SELECT j.doc_id, CASE WHEN pages = 0 THEN j.md ELSE regexp_replace(j.md, '\\n+\\z', '') || CASE WHEN s.md LIKE '%' || chr(10) THEN chr(10) ELSE '' END END AS md FROM {name}_j j JOIN {source} s USING (doc_id))"""


def _tables_ctes(source: str, name: str) -> str:
    rule = "'| ' || array_to_string(list_transform(string_split(regexp_replace(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), '^\\|+|\\|+$', '', 'g'), '|'), lambda c: '---'), ' | ') || ' |'"
    return f"""{_lines_cte(source, name + "_x")},
    {name}_t AS (SELECT *, free AND starts_with(ltrim(l, ' ' || chr(9)), '|') AS t FROM {name}_x),
    {name}_w AS (SELECT *, t AND NOT coalesce(lag(t) OVER w, false) AS first, coalesce(lead(t) OVER w, false) AND regexp_matches(lead(l) OVER w, '{C.SEPARATOR}') AS ruled, NOT regexp_matches(l, '[^\\s|]') AS blank, coalesce(lead(t, 2) OVER w, false) AS third FROM {name}_t WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    {name}_q AS (SELECT *, first AND ruled AND blank AND third AS up FROM {name}_w),
    {name}_s AS (SELECT *, coalesce(lag(up) OVER w, false) AS up1, coalesce(lag(up, 2) OVER w, false) AS up2 FROM {name}_q WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    {name} AS (SELECT doc_id, string_agg(CASE WHEN (first AND NOT ruled) OR up2 THEN l || chr(10) || {rule} ELSE l END, chr(10) ORDER BY n) AS md FROM {name}_s WHERE NOT up AND NOT up1 GROUP BY doc_id)"""


@query("clean_latex", _digest_sql(_latex_ctes("md_docs", "done"), "done"))
def clean_latex(spark, sf_dir):
    return _changed(_md(spark, sf_dir), C.latex(F.col("md")))


@query("clean_dehyphenate", _changed_sql("regexp_replace(md, '([A-Za-z])-\\n([A-Za-z])', '\\1\\2', 'g')"))
def clean_dehyphenate(spark, sf_dir):
    return _changed(_md(spark, sf_dir), C.dehyphenated(F.col("md")))


@query("clean_reflow", _digest_sql(_reflow_ctes("md_docs", "done"), "done"))
def clean_reflow(spark, sf_dir):
    return _changed(_md(spark, sf_dir), C.reflowed(F.col("md")))


@query("clean_page_numbers", _changed_sql("array_to_string(list_filter(string_split(md, chr(10)), lambda l: NOT regexp_matches(trim(l, ' ' || chr(9) || chr(13)), '^(Page [0-9]+ of [0-9]+|- [0-9]+ -|[0-9]+/[0-9]+)$')), chr(10))"))
def clean_page_numbers(spark, sf_dir):
    return _changed(_md(spark, sf_dir), C.without_page_numbers(F.col("md")))


@query("clean_running_headers", _digest_sql(_headers_ctes("md_docs", "done"), "done"))
def clean_running_headers(spark, sf_dir):
    return _changed(_md(spark, sf_dir), C.without_running_headers(F.col("md")))


@query(
    "running_headers",
    f"""{WITH}, lines AS (
      SELECT doc_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS n FROM md_docs),
    paged AS (SELECT doc_id, trim(line, ' ' || chr(9) || chr(13)) AS line, line AS raw, sum(CASE WHEN regexp_matches(line, '^## Page\\b') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS page FROM lines)
    SELECT doc_id, line, count(DISTINCT page) AS pages FROM paged
    WHERE page > 0 AND length(line) BETWEEN 1 AND 80 AND NOT starts_with(line, '#') GROUP BY doc_id, line HAVING count(DISTINCT page) >= 3""",
)
def running_headers(spark, sf_dir):
    """Short lines repeated on three pages or more."""
    lines = validation.page_lines(_md(spark, sf_dir)).filter("page > 0").select("doc_id", "page", C.stripped(F.col("line")).alias("line"))
    lines = lines.filter((F.length("line").between(1, 80)) & ~F.col("line").startswith("#"))
    return lines.groupBy("doc_id", "line").agg(F.countDistinct("page").alias("pages")).filter("pages >= 3")


@query("clean_tables", _digest_sql(_tables_ctes("md_docs", "done"), "done"))
def clean_tables(spark, sf_dir):
    return _changed(_md(spark, sf_dir), C.repaired_tables(F.col("md")))


_ALL_SQL = ", ".join(
    [
        f"c1 AS (SELECT doc_id, nfc_normalize({_sql_accents(_sql_ligatures('md'))}) AS md FROM md_docs)",
        _latex_ctes("c1", "c2"),
        f"c3 AS (SELECT doc_id, regexp_replace({_sql_replaced('md', C.MOJIBAKE + C.C1_QUOTES)}, '([A-Za-z])-\\n([A-Za-z])', '\\1\\2', 'g') AS md FROM c2)",
        _reflow_ctes("c3", "c4"),
        _headers_ctes("c4", "c5"),
        _tables_ctes("c5", "c6"),
    ]
)


@query("clean_all", _digest_sql(_ALL_SQL, "c6"))
def clean_all(spark, sf_dir):
    return _changed(_md(spark, sf_dir), C.cleaned(F.col("md")))


_PAGES_SQL = f"""{WITH}, cut AS (SELECT doc_id, string_split(chr(10) || md, chr(10) || '## Page ') AS parts FROM md_docs),
    pages AS (SELECT doc_id, unnest(parts[2:]) AS part, generate_subscripts(parts[2:], 1) AS pos FROM cut)"""


@query("page_sections", f"{_PAGES_SQL} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(regexp_extract(part, '^([0-9]+)', 1) AS INTEGER) AS page, CAST(length(part) AS INTEGER) AS chars, CAST(lead(CAST(regexp_extract(part, '^([0-9]+)', 1) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS next_page FROM pages")
def page_sections(spark, sf_dir):
    """Sections of pages with the following page's number."""
    pages = validation.pages(_md(spark, sf_dir))
    order = Window.partitionBy("doc_id").orderBy("pos")
    return pages.select("doc_id", "pos", "page", F.length("part").alias("chars"), F.lead("page").over(order).alias("next_page"))


@query("page_slice", f"{_PAGES_SQL} SELECT doc_id, CAST(pos AS INTEGER) AS page, md5(part) AS digest, CAST(total AS BIGINT) AS total FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM pages) WHERE pos = 2")
def page_slice(spark, sf_dir):
    """Page 2 of each document, with the number of pages."""
    pages = validation.pages(_md(spark, sf_dir)).withColumn("total", F.count("*").over(Window.partitionBy("doc_id")))
    return pages.filter("pos = 2").select("doc_id", F.col("pos").alias("page"), F.md5(F.col("part").cast("binary")).alias("digest"), "total")


@query(
    "frontmatter",
    f"""{WITH}, fm AS (SELECT doc_id, md, regexp_extract(md, '(?s)\\A---\\n.*?\\n---\\n?') AS block FROM md_docs)
    SELECT doc_id, CAST(length(block) AS INTEGER) AS block_chars, CAST(length(md) - length(block) AS INTEGER) AS body_chars,
      nullif(regexp_extract(block, '(?m)^language: "?([a-z]+)', 1), '') AS language, nullif(regexp_extract(md, '(?m)^# (.+)$', 1), '') AS title FROM fm""",
)
def frontmatter(spark, sf_dir):
    return P.with_frontmatter(_md(spark, sf_dir)).select("doc_id", F.length("block").alias("block_chars"), F.length("body").alias("body_chars"), "language", "title")


@query(
    "frontmatter_build",
    """SELECT doc_id, '---' || chr(10) || 'source: "' || replace(replace('docs/' || doc_id || '.txt', chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' || chr(10)
      || CASE WHEN lang IS NULL THEN '' ELSE 'language: "' || lang || '"' || chr(10) END || 'char_count: ' || n_chars || chr(10) || '---' || chr(10) AS block FROM documents""",
)
def frontmatter_build(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", P.frontmatter_block({"source": F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")), "language": F.col("lang"), "char_count": F.col("n_chars")}).alias("block"))


# -- validator

_FREE = f"""{WITH}, lined AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS n FROM md_docs),
    fenced AS (SELECT *, sum(CASE WHEN starts_with(trim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM lined),
    free AS (SELECT doc_id, array_to_string(list(CASE WHEN k % 2 = 1 AND NOT starts_with(trim(line), '```') THEN '' ELSE line END ORDER BY n), chr(10)) AS md FROM fenced GROUP BY doc_id)"""


def _rule(spark, sf_dir, rule) -> DataFrame:
    """(doc_id, detail, line) of one rule; rule: text -> list of findings."""
    rows = _md(spark, sf_dir).select("doc_id", F.explode(rule(F.col("md"))).alias("f"))
    return rows.select("doc_id", "f.detail", "f.line")


def _line_sql(text: str, before: str) -> str:
    """Line of what follows the first so many characters."""
    return f"CAST(length(left({text}, {before})) - length(replace(left({text}, {before}), chr(10), '')) + 1 AS INTEGER)"


def _words_sql(listed: tuple[str, ...]) -> str:
    return "[" + ", ".join(duck_text(w) for w in listed) + "]"


_MARKS = "(VALUES ('\\['), ('\\]'), ('\\('), ('\\)'), ('\\begin{equation}'), ('\\section{'), ('\\subsection{'), ('\\textbf{')) AS m(label)"
_ACCENT_SQL = " || ".join(duck_text(a) for a in ("´", "˜", "¨", "ˆ", "ˇ", "˚"))
_ORPHAN = f"('[A-Za-z][' || {_ACCENT_SQL} || ']|[' || {_ACCENT_SQL} || '][A-Za-z]')"
_LINK = "'!\\[[^\\]]*\\]\\(([^)]+)\\)'"
_CAPTION = "'(?m)^> \\*\\*Figura.*$'"
_STRIPPED = "regexp_replace(regexp_replace(md, '(?s)\\A---\\n.*?\\n---\\n?', ''), '\\A\\s+|\\s+\\z', '', 'g')"
_NEWLINES = "lambda x: length(x) - length(replace(x, chr(10), ''))"
_HITS = "CASE WHEN n < 20 THEN NULL WHEN es >= en * 1.2 AND es >= 4 THEN 'es' WHEN en >= es * 1.2 AND en >= 4 THEN 'en' END"
_FIRST_ENV = "least(CASE WHEN b > 0 THEN instr(md, '\\begin{' || env || '}') END, CASE WHEN e > 0 THEN instr(md, '\\end{' || env || '}') END) - 1"

#: Rule -> (severity, SELECT of doc_id, detail and line from md_docs, and free, where fenced lines are blank).
_RULES = {
    "incomplete_conversion": ("error", "SELECT doc_id, 'conversion stopped early; re-run to finish the missing pages' AS detail, CAST(NULL AS INTEGER) AS line FROM md_docs WHERE regexp_matches(md, '(?m)^> \\*\\*INCOMPLETO:\\*\\*')"),
    "control_chars": ("error", "SELECT doc_id, CASE WHEN unicode(ch) = 0 THEN 'NUL' ELSE format('U+{:04X}', unicode(ch)) END || ' control character appears ' || count(*) || ' time(s)' AS detail, CAST(NULL AS INTEGER) AS line FROM (SELECT doc_id, unnest(regexp_extract_all(md, '[\\x00-\\x08\\x0b-\\x1f]')) AS ch FROM md_docs) GROUP BY doc_id, ch"),
    "latex_delimiters": ("error", f"SELECT doc_id, 'leftover LaTeX markup ''' || label || ''' (' || (length(md) - length(replace(md, label, ''))) // length(label) || ' occurrence(s))' AS detail, {_line_sql('md', 'instr(md, label) - 1')} AS line FROM free, {_MARKS} WHERE contains(md, label)"),
    "unbalanced_math": (
        "error",
        f"""SELECT doc_id, 'odd number of ''$$'' delimiters (' || n || ')' AS detail, {_line_sql('md', "instr(md, '$$') - 1")} AS line FROM (SELECT *, (length(md) - length(replace(md, '$$', ''))) // 2 AS n FROM free) WHERE n % 2 = 1
      UNION ALL SELECT doc_id, '\\begin{{' || env || '}} (' || b || ') does not match \\end{{' || env || '}} (' || e || ')', {_line_sql('md', _FIRST_ENV)} FROM (
        SELECT doc_id, env, sum(b) AS b, sum(e) AS e FROM (SELECT doc_id, unnest(regexp_extract_all(md, '\\\\begin\\{{(\\w+)\\}}', 1)) AS env, 1 AS b, 0 AS e FROM free UNION ALL SELECT doc_id, unnest(regexp_extract_all(md, '\\\\end\\{{(\\w+)\\}}', 1)), 0, 1 FROM free) GROUP BY doc_id, env HAVING sum(b) <> sum(e)) JOIN free USING (doc_id)""",
    ),
    "scrambled_text": (
        "warning",
        f"""SELECT doc_id, 'page ' || regexp_extract(part, '^([0-9]+)', 1) || ' text looks scrambled' AS detail, CAST(lines + 1 AS INTEGER) AS line FROM (
        SELECT *, regexp_extract_all(regexp_replace(part, '^[0-9]+', ''), '[\\p{{L}}\\p{{N}}_]+') AS t, first_lines + coalesce(sum(1 + length(part) - length(replace(part, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lines FROM (
          SELECT doc_id, unnest(parts[2:]) AS part, generate_subscripts(parts[2:], 1) AS pos, length(parts[1]) - length(replace(parts[1], chr(10), '')) AS first_lines FROM (SELECT doc_id, string_split(chr(10) || md, chr(10) || '## Page ') AS parts FROM md_docs)))
      WHERE len(t) >= {validation.SCRAMBLED_TOKENS} AND len(list_filter(t, lambda x: length(x) = 1)) > {validation.SCRAMBLED_SHARE} * len(t)""",
    ),
    "orphan_accents": ("warning", f"SELECT doc_id, len(regexp_extract_all(md, {_ORPHAN})) || ' orphan accent glyph(s) next to a letter (e.g. ''' || regexp_extract(md, {_ORPHAN}) || ''')' AS detail, {_line_sql('md', f'length(string_split_regex(md, {_ORPHAN})[1])')} AS line FROM md_docs WHERE regexp_matches(md, {_ORPHAN})"),
    "empty_output": ("warning", f"SELECT doc_id, 'body has only ' || length({_STRIPPED}) || ' character(s) after frontmatter' AS detail, CAST(NULL AS INTEGER) AS line FROM md_docs WHERE length({_STRIPPED}) < {validation.EMPTY_CHARS}"),
    "language_mismatch": (
        "warning",
        f"""SELECT doc_id, 'frontmatter declares language ''' || said || ''' but a figure caption looks like ''' || told || '''' AS detail, CAST(1 + list_sum(list_transform(string_split_regex(md, {_CAPTION})[1:i], {_NEWLINES})) AS INTEGER) AS line FROM (
        SELECT *, {_HITS} AS told FROM (
          SELECT *, len(t) AS n, len(list_filter(t, lambda x: list_contains({_words_sql(P.SPANISH)}, x))) AS es, len(list_filter(t, lambda x: list_contains({_words_sql(P.ENGLISH)}, x))) AS en FROM (
            SELECT doc_id, md, said, i, regexp_extract_all(lower(caption), '[a-záéíóúüñ'']+') AS t FROM (
              SELECT doc_id, md, lower(regexp_extract(regexp_extract(md, '(?s)\\A---\\n.*?\\n---\\n?'), '(?m)^language: "?([A-Za-z]{{2}})"?$', 1)) AS said, unnest(regexp_extract_all(md, {_CAPTION})) AS caption, generate_subscripts(regexp_extract_all(md, {_CAPTION}), 1) AS i FROM md_docs)
            WHERE said <> ''))) WHERE told <> said""",
    ),
    "missing_figure_assets": (
        "warning",
        f"""SELECT doc_id, 'image target ''' || target || ''' does not exist' AS detail, CAST(1 + list_sum(list_transform(string_split_regex(md, {_LINK})[1:i], {_NEWLINES})) AS INTEGER) AS line FROM (
        SELECT doc_id, md, unnest(regexp_extract_all(md, {_LINK}, 1)) AS target, generate_subscripts(regexp_extract_all(md, {_LINK}, 1), 1) AS i FROM md_docs) WHERE NOT (doc_id % 24 = 7 AND target = 'assets/fig.png')""",
    ),
}


def _rule_sql(rule: str) -> str:
    return f"{_FREE} {_RULES[rule][1]}"


@query("validate_incomplete", _rule_sql("incomplete_conversion"))
def validate_incomplete(spark, sf_dir):
    return _rule(spark, sf_dir, validation.incomplete)


@query("validate_control_chars", _rule_sql("control_chars"))
def validate_control_chars(spark, sf_dir):
    return _rule(spark, sf_dir, validation.control_chars)


@query("validate_latex_delimiters", _rule_sql("latex_delimiters"))
def validate_latex_delimiters(spark, sf_dir):
    return _rule(spark, sf_dir, lambda t: C.once(validation.without_code(t), validation.latex_delimiters))


@query("validate_unbalanced_math", _rule_sql("unbalanced_math"))
def validate_unbalanced_math(spark, sf_dir):
    return _rule(spark, sf_dir, lambda t: C.once(validation.without_code(t), validation.unbalanced_math))


@query("validate_scrambled", _rule_sql("scrambled_text"))
def validate_scrambled(spark, sf_dir):
    return _rule(spark, sf_dir, validation.scrambled)


@query(
    "scrambled_pages",
    f"""{_PAGES_SQL}, tok AS (SELECT doc_id, CAST(regexp_extract(part, '^([0-9]+)', 1) AS INTEGER) AS page, regexp_extract_all(regexp_replace(part, '^[0-9]+', ''), '[\\p{{L}}\\p{{N}}_]+') AS toks FROM pages)
    SELECT doc_id, page, CAST(len(toks) AS INTEGER) AS tokens, CAST(len(list_filter(toks, lambda t: length(t) = 1)) AS INTEGER) AS singles FROM tok WHERE len(toks) >= 25 AND len(list_filter(toks, lambda t: length(t) = 1)) > 0.6 * len(toks)""",
)
def scrambled_pages(spark, sf_dir):
    """Pages that look scrambled, with their words and those of one character."""
    rows = validation.pages(_md(spark, sf_dir)).withColumn("s", validation.scrambled_share(F.regexp_replace("part", "^[0-9]+", "")))
    return rows.select("doc_id", "page", "s.*").filter(f"tokens >= {validation.SCRAMBLED_TOKENS} and singles > {validation.SCRAMBLED_SHARE} * tokens")


@query("validate_orphan_accents", _rule_sql("orphan_accents"))
def validate_orphan_accents(spark, sf_dir):
    return _rule(spark, sf_dir, validation.orphan_accents)


@query(
    "validate_empty_output",
    f"{WITH}, all_docs AS (SELECT doc_id, md FROM md_docs UNION ALL SELECT -doc_id, 'short ' || doc_id FROM md_docs) SELECT doc_id, 'body has only ' || length({_STRIPPED}) || ' character(s) after frontmatter' AS detail, CAST(NULL AS INTEGER) AS line FROM all_docs WHERE length({_STRIPPED}) < {validation.EMPTY_CHARS}",
)
def validate_empty_output(spark, sf_dir):
    """The rule over all documents and, as none of them is empty, a short one beside each."""
    docs = _md(spark, sf_dir)
    short = docs.select((-F.col("doc_id")).alias("doc_id"), F.concat(F.lit("short "), F.col("doc_id").cast("string")).alias("md"))
    rows = docs.unionByName(short).select("doc_id", F.explode(validation.empty_output(F.col("md"))).alias("f"))
    return rows.select("doc_id", "f.detail", "f.line")


def _assets(spark, sf_dir) -> DataFrame:
    """Files around the documents: some have the figure they link to."""
    return _md(spark, sf_dir).filter("doc_id % 24 = 7").select("doc_id", F.lit("assets/fig.png").alias("target"))


@query("validate_missing_assets", _rule_sql("missing_figure_assets"))
def validate_missing_assets(spark, sf_dir):
    found = validation.findings(_md(spark, sf_dir), _assets(spark, sf_dir))
    return found.filter("rule = 'missing_figure_assets'").select("doc_id", "detail", "line")


@query("validate_language", _rule_sql("language_mismatch"))
def validate_language(spark, sf_dir):
    return _rule(spark, sf_dir, validation.language_mismatch)


_FOUND = f"{_FREE}, found AS (" + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule, '{severity}' AS severity, detail, line FROM ({sql})" for r, (severity, sql) in _RULES.items()) + ")"


@query("validate_findings", f"{_FOUND} SELECT doc_id, rule, severity, detail, line FROM found")
def validate_findings(spark, sf_dir):
    """Findings of all rules."""
    return validation.findings(_md(spark, sf_dir), _assets(spark, sf_dir))


@query("topk_findings", f"{_FOUND} SELECT doc_id, count(*) AS findings, count(*) FILTER (severity = 'error') AS errors FROM found GROUP BY doc_id ORDER BY findings DESC, doc_id LIMIT 20")
def topk_findings(spark, sf_dir):
    """The twenty documents with most findings."""
    found = validation.findings(_md(spark, sf_dir), _assets(spark, sf_dir))
    return found.groupBy("doc_id").agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "error").alias("errors")).orderBy(F.desc("findings"), "doc_id").limit(20)


@query("validate_report", f"{_FOUND} SELECT severity, rule, count(*) AS findings, count(DISTINCT doc_id) AS docs FROM found GROUP BY ROLLUP (severity, rule)")
def validate_report(spark, sf_dir):
    """Findings by severity and rule, with subtotals."""
    found = validation.findings(_md(spark, sf_dir), _assets(spark, sf_dir))
    return found.rollup("severity", "rule").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("docs")).select("severity", "rule", "findings", "docs")


# -- language, scrambling, mathematics

_PROSE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '(?s)```.*?```', ' ', 'g'), '!?\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '(?s)\\$\\$.+?\\$\\$|\\$[^$\\n]+\\$', ' ', 'g'), '\\\\[A-Za-z]+', ' ', 'g')"


_LANG_SQL = f"""tok AS (SELECT doc_id, regexp_extract_all(lower(left(out, 4000)), '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ'']+') AS t FROM (SELECT doc_id, {_PROSE} AS out FROM md_docs)),
    hits AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: list_contains({_words_sql(P.SPANISH)}, x))) AS es, len(list_filter(t, lambda x: list_contains({_words_sql(P.ENGLISH)}, x))) AS en FROM tok),
    guess AS (SELECT doc_id, es, en, CASE WHEN n < 20 THEN NULL WHEN es >= en * 1.2 AND es >= 4 THEN 'es' WHEN en >= es * 1.2 AND en >= 4 THEN 'en' END AS language FROM hits)"""


@query("language_guess", f"{WITH}, {_LANG_SQL} SELECT doc_id, CAST(es AS INTEGER) AS es, CAST(en AS INTEGER) AS en, language FROM guess")
def language_guess(spark, sf_dir):
    return P.with_language(_md(spark, sf_dir), "md").select("doc_id", "es", "en", "language")


@query("language_confusion", f"{WITH}, {_LANG_SQL} SELECT lang, language, count(*) AS n FROM guess JOIN documents USING (doc_id) GROUP BY lang, language")
def language_confusion(spark, sf_dir):
    guess = P.with_language(_md(spark, sf_dir), "md").select("doc_id", "language")
    return guess.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang", "language").agg(F.count("*").alias("n"))


@query("short_token_ratio", "WITH tok AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS t FROM documents) SELECT doc_id, CASE WHEN len(t) >= 20 THEN round(len(list_filter(t, lambda x: length(x) <= 4)) / len(t), 9) END AS ratio FROM tok")
def short_token_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(P.short_token_ratio(F.col("text")), 9).alias("ratio"))


@query("quantile_rank", "WITH q AS (SELECT lang, list(n_chars ORDER BY n_chars) AS v FROM documents GROUP BY lang) SELECT lang, v[least(CAST(floor(len(v) * 0.5) AS BIGINT), len(v) - 1) + 1] AS p50, v[least(CAST(floor(len(v) * 0.9) AS BIGINT), len(v) - 1) + 1] AS p90 FROM q")
def quantile_rank(spark, sf_dir):
    """Nearest-rank quantiles by index, without collecting a group: the value whose ranks hold the wanted one is kept."""
    docs = table(spark, sf_dir, "documents")
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"))
    met = P.ranked_within(docs.select("lang", "n_chars"), "lang", "n_chars").join(counts, "lang")
    at = lambda q: F.least(F.floor(F.col("n") * q), F.col("n") - 1)
    held = lambda q: F.max(F.when(at(q).between(F.col("first"), F.col("last")), F.col("n_chars")))
    return met.groupBy("lang").agg(held(0.5).alias("p50"), held(0.9).alias("p90"))


_SYMBOL = "[Ͱ-Ͽἀ-῿⁰-₟²³¹√±·×÷≤≥≠∞∑∫¯−+=^_{}\\\\]"


@query("math_symbols", f"{WITH}, tok AS (SELECT doc_id, regexp_extract_all(md, '\\S+') AS t FROM md_docs) SELECT doc_id, CAST(len(t) AS INTEGER) AS tokens, CAST(len(list_filter(t, lambda x: regexp_matches(x, '{_SYMBOL}'))) AS INTEGER) AS symbols, CAST(len(list_filter(t, lambda x: regexp_matches(x, '^([A-Za-zͰ-Ͽἀ-῿]{{1,3}}[0-9]{{1,2}}|[0-9]{{1,2}})$'))) AS INTEGER) AS candidates FROM tok")
def math_symbols(spark, sf_dir):
    return P.math_tokens(_md(spark, sf_dir), "md").select("doc_id", "tokens", "symbols", "candidates")


_SPACE = "\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_SPANS = f"""{WITH}, raw AS (SELECT doc_id, unnest(regexp_extract_all(md, '[^{_SPACE}]+|[{_SPACE}]+')) AS t, generate_subscripts(regexp_extract_all(md, '[^{_SPACE}]+|[{_SPACE}]+'), 1) AS k FROM md_docs),
    placed AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM raw),
    tok AS (SELECT doc_id, t, b, b + length(t) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, regexp_matches(t, '{_SYMBOL}') AS sym, regexp_matches(t, '^([A-Za-zͰ-Ͽἀ-῿]{{1,3}}[0-9]{{1,2}}|[0-9]{{1,2}})$') AS cand FROM placed WHERE NOT regexp_matches(t, '^[{_SPACE}]')),
    alone AS (SELECT *, sym OR (cand AND (bool_or(sym) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) OR sum(CAST(cand AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) >= 3)) AS alone FROM tok),
    gaps AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 2 THEN 0 ELSE 1 END AS gap FROM alone WHERE alone OR cand),
    islands AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM gaps),
    flagged AS (SELECT * FROM (SELECT *, min(CASE WHEN alone THEN i END) OVER (PARTITION BY doc_id, island) AS first FROM islands) WHERE i >= first),
    runs AS (SELECT doc_id, min(b) AS b, max(e) AS e, count(*) AS n, sum(CAST(cand AS INTEGER)) AS short, bool_or(t = '√') AS root FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM flagged) GROUP BY doc_id, run),
    spans AS (SELECT doc_id, b, e, root OR (n >= 2 AND short >= 2 AND short >= n - 1) AS structure_lost FROM runs)"""


@query("token_offsets", f"{_SPANS} SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, CAST(b AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", t AS token FROM tok")
def token_offsets(spark, sf_dir):
    """Tokens with where they stand."""
    return P.token_offsets(_md(spark, sf_dir), "md")


@query("math_spans", f"{_SPANS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS INTEGER) AS span, CAST(b AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", md[b + 1:e] AS text, structure_lost FROM spans JOIN md_docs USING (doc_id)")
def math_spans(spark, sf_dir):
    return P.math_spans(_md(spark, sf_dir), "md")


@query(
    "math_density",
    f"""{_SPANS}, tokens AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id), inside AS (SELECT doc_id, count(*) AS n FROM flagged GROUP BY doc_id), lost AS (SELECT doc_id, bool_or(structure_lost) AS lost FROM spans GROUP BY doc_id)
    SELECT md_docs.doc_id, round(coalesce(inside.n, 0) / tokens.n, 9) AS density, coalesce(lost, false) AS structure_lost FROM md_docs LEFT JOIN tokens ON tokens.doc_id = md_docs.doc_id LEFT JOIN inside ON inside.doc_id = md_docs.doc_id LEFT JOIN lost ON lost.doc_id = md_docs.doc_id""",
)
def math_density(spark, sf_dir):
    return P.math_density(_md(spark, sf_dir), "md")


#: White space at both ends, as the chunker strips it.
def _bare(x: str) -> str:
    return f"regexp_replace({x}, '\\A[\\s\\x0b\\x1c-\\x1f]+|[\\s\\x0b\\x1c-\\x1f]+\\z', '', 'g')"


_MAX, _OVER = chunking.MAX_CHARS, chunking.OVERLAP
#: Sections, their blocks (runs of table lines, runs of other lines between empty ones), and the packing as a walk over a section's blocks.
_CHUNKS = f"""{WITH.replace("WITH ", "WITH RECURSIVE ", 1)},
    cut AS (SELECT doc_id, unnest(string_split(chr(10) || md, chr(10) || '## ')) AS part, generate_subscripts(string_split(chr(10) || md, chr(10) || '## '), 1) AS s FROM md_docs),
    lines AS (SELECT doc_id, s, part, string_split_regex(part, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e]') AS ls FROM cut WHERE {_bare('part')} <> ''),
    sec AS (SELECT doc_id, s, CASE WHEN s = 1 THEN '' ELSE {_bare('ls[1]')} END AS heading, CASE WHEN s = 1 THEN {_bare('part')} ELSE {_bare("array_to_string(ls[2:], chr(10))")} END AS body FROM lines),
    pre AS (SELECT *, CASE WHEN heading = '' THEN '' ELSE '## ' || heading || chr(10) || chr(10) END AS prefix FROM sec),
    bl AS (SELECT doc_id, s, unnest(string_split_regex(body, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e]')) AS l, generate_subscripts(string_split_regex(body, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e]'), 1) AS n FROM pre WHERE length({_bare('prefix || body')}) > {_MAX}),
    kinds AS (SELECT *, CASE WHEN starts_with({_bare('l')}, '|') AND contains(substr({_bare('l')}, 2), '|') THEN 2 WHEN {_bare('l')} = '' THEN 0 ELSE 1 END AS kind FROM bl),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, s ORDER BY n) AS run FROM (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY doc_id, s ORDER BY n) THEN 0 ELSE 1 END AS fresh FROM kinds)),
    blocks AS (SELECT doc_id, s, kind, {_bare("string_agg(l, chr(10) ORDER BY n)")} AS block, row_number() OVER (PARTITION BY doc_id, s ORDER BY run) AS k FROM runs WHERE kind > 0 GROUP BY doc_id, s, run, kind),
    walk AS (
      SELECT doc_id, s, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS held, CAST([] AS VARCHAR[]) AS out FROM (SELECT DISTINCT doc_id, s FROM blocks)
      UNION ALL
      SELECT w.doc_id, w.s, b.k, CASE WHEN fits THEN coalesce(w.held || chr(10) || chr(10), '') || b.block WHEN b.kind = 2 OR length(p.prefix) + length(b.block) > {_MAX} THEN NULL ELSE b.block END,
        CASE WHEN fits THEN [] ELSE list_concat(CASE WHEN w.held IS NULL THEN [] ELSE [{_bare('p.prefix || w.held')}] END, CASE WHEN b.kind = 2 THEN [p.prefix || b.block] WHEN length(p.prefix) + length(b.block) <= {_MAX} THEN []
          ELSE list_transform(range(CAST(ceil(greatest(0, length(b.block) - ({_MAX} - length(p.prefix))) / ({_MAX} - length(p.prefix) - {_OVER})) AS BIGINT) + 1), lambda i: {_bare(f"p.prefix || substr(b.block, CAST(i * ({_MAX} - length(p.prefix) - {_OVER}) AS BIGINT) + 1, {_MAX} - length(p.prefix))")}) END) END
      FROM (SELECT w.*, length(p.prefix) + coalesce(length(w.held) + 2, 0) + length(b.block) <= {_MAX} AS fits FROM walk w JOIN blocks b ON b.doc_id = w.doc_id AND b.s = w.s AND b.k = w.k + 1 JOIN pre p ON p.doc_id = w.doc_id AND p.s = w.s) w
      JOIN blocks b ON b.doc_id = w.doc_id AND b.s = w.s AND b.k = w.k + 1 JOIN pre p ON p.doc_id = w.doc_id AND p.s = w.s),
    made AS (SELECT doc_id, s, k * 1000000 + i AS place, heading, text FROM (SELECT w.doc_id, w.s, w.k, unnest(out) AS text, generate_subscripts(out, 1) AS i FROM walk w) JOIN pre USING (doc_id, s)
      UNION ALL SELECT w.doc_id, w.s, (w.k + 1) * 1000000, heading, {_bare('prefix || held')} FROM (SELECT *, max(k) OVER (PARTITION BY doc_id, s) AS last FROM walk) w JOIN pre p ON p.doc_id = w.doc_id AND p.s = w.s WHERE k = last AND held IS NOT NULL
      UNION ALL SELECT doc_id, s, 0, heading, {_bare('prefix || body')} FROM pre WHERE length({_bare('prefix || body')}) <= {_MAX}),
    chunked AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, place) - 1 AS INTEGER) AS chunk, heading, text, CAST(length(text) AS INTEGER) AS char_count FROM made)"""


@query("chunks", f"{_CHUNKS} SELECT doc_id, chunk, heading, text, char_count FROM chunked")
def chunks(spark, sf_dir):
    return chunking.chunks(_md(spark, sf_dir), "md")


@query("chunk_stats", f"{_CHUNKS} SELECT doc_id, count(*) AS n_chunks, max(char_count) AS longest, CAST(sum(char_count) AS BIGINT) AS chars FROM chunked GROUP BY doc_id")
def chunk_stats(spark, sf_dir):
    made = chunking.chunks(_md(spark, sf_dir), "md")
    return made.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("char_count").alias("longest"), F.sum("char_count").alias("chars"))
