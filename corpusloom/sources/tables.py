"""The driver's tables, and Markdown documents with defects derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Text that comes before and after a document whose id leaves the remainder: (modulus, remainder, text).
BEFORE = (
    (14, 9, '---\nsource: "scan"\nlanguage: "en"\n---\n'),
    (13, 8, "> **INCOMPLETO:** partial conversion\n\n"),
)
AFTER = (
    (2, 0, "\n\n| name | value |\n| a | 1 |\n| b | 2 |"),
    (15, 10, "\n\n|  |  |\n| --- | --- |\n| h1 | h2 |\n| x | y |"),
    (3, 0, "\n\nhy-\nphen and well-\nknown words"),
    (7, 0, "\n\n```\nx = \\[ y \\]\n```\n\nleft \\[ a + b \\] and \\(c\\) \\textbf{bold}\n\\section{Intro}"),
    (11, 6, "\n\n\\begin{pmatrix} 1 $$"),
    (6, 1, "\n\ncaf\u00c3\u00a9 don\u00e2\u0080\u0099t \u00c2\u00b0C \u0093q\u0094"),
    (8, 3, "\n\n\ufb01nd \ufb02ow"),
    (9, 4, "\n\n\x1dora \x00y\x01"),
    (10, 5, "\n\nn\u00b4umero se\u02dcnal"),
    (12, 7, "\n\n![fig](assets/fig.png)"),
    (16, 11, "\n\n\u03b1 \u03b2 s2 1 n1 \u221a 2 = x_1"),
    (7, 2, "\n\n> **Figura (descripción generada):** el gráfico de la función que se muestra en la página con los ejes y los valores de cada serie para una muestra"),
    (17, 3, "\n\n### OCR\n\na b c d e f g h i j k l m n o p q r s t u v w x y z a b c"),
)
HEADER = "ACME Quarterly Notes\n"


def _on(doc_id: Column, modulus: int, remainder: int, text: str) -> Column:
    return F.when(doc_id % modulus == remainder, F.lit(text)).otherwise(F.lit(""))


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, md): pages of three lines with headings, running headers, page numbers and, by remainders of the id, defects."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    page = lambda p: F.concat(F.lit("## Page "), (p + 1).cast("string"), F.lit("\n"), _on(F.col("doc_id"), 4, 0, HEADER), F.array_join(F.slice("lines", 3 * p + 1, F.lit(3)), "\n"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\n"), (p + 1).cast("string"), F.lit("/12"))).otherwise(F.lit("")))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") + 2) / 3).cast("int") - 1), page)
    parts = [*[_on(F.col("doc_id"), *d) for d in BEFORE], F.array_join(pages, "\n\n"), *[_on(F.col("doc_id"), *d) for d in AFTER]]
    return docs.select("doc_id", F.concat(*parts).alias("md"))


def duck_text(text: str) -> str:
    """A string as a DuckDB expression; characters outside printable ASCII by number."""
    parts, plain = [], ""
    for ch in text:
        if " " <= ch <= "~":
            plain += ch.replace("'", "''")
        else:
            if plain:
                parts.append(f"'{plain}'")
            plain = ""
            parts.append(f"chr({ord(ch)})")
    if plain:
        parts.append(f"'{plain}'")
    return "(" + " || ".join(parts or ["''"]) + ")"


def _duck_on(modulus: int, remainder: int, text: str) -> str:
    return f"(CASE WHEN doc_id % {modulus} = {remainder} THEN {duck_text(text)} ELSE '' END)"


#: The same documents for DuckDB, as a common table expression.
MD_DOCS = f"""md_docs AS (
  SELECT doc_id, {" || ".join(_duck_on(*d) for d in BEFORE)} || array_to_string(list_transform(range((len(lines) + 2) // 3),
    lambda p: '## Page ' || (p + 1) || chr(10) || {_duck_on(4, 0, HEADER)} || array_to_string(lines[3 * p + 1 : 3 * p + 3], chr(10))
      || (CASE WHEN doc_id % 5 = 0 THEN chr(10) || (p + 1) || '/12' ELSE '' END)), chr(10) || chr(10)) || {" || ".join(_duck_on(*d) for d in AFTER)} AS md
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
)"""
