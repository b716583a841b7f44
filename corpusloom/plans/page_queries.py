"""OCR policy, page text and composition, figure geometry, review and mathematics, over pages derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import prose
from corpusloom.operators import figures, pages, review, summaries, validation
from corpusloom.plans.catalog import query
from corpusloom.sources.tables import table

# -- OCR policy: line items are pages, some with nothing read, little confidence or much ink

_OCR = """p AS (SELECT l_orderkey AS doc, l_linenumber AS page, CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'two words' WHEN 2 THEN 'a b c d e f g h i j k l m n o p q r s t u v w x y z' ELSE 'the order holds nine words and a few more' END AS text,
    CAST(l_suppkey % 101 AS DOUBLE) AS confidence, (l_partkey % 30) / 100.0 AS dark, ['native', 'tesseract', 'vision'][l_suppkey % 3 + 1] AS route, l_orderkey % 13 = 0 AS forced FROM lineitem),
    t AS (SELECT *, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS w FROM p), s AS (SELECT *, len(w) >= 25 AND len(list_filter(w, lambda x: length(x) = 1)) > 0.6 * len(w) AS jumble FROM t)"""


def _ocr_pages(spark, sf_dir) -> DataFrame:
    rows, k = table(spark, sf_dir, "lineitem"), F.col("l_partkey") % 5
    text = F.when(k == 0, "").when(k == 1, "two words").when(k == 2, "a b c d e f g h i j k l m n o p q r s t u v w x y z").otherwise("the order holds nine words and a few more")
    return rows.select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), text.alias("text"), (F.col("l_suppkey") % 101).cast("double").alias("confidence"), (F.col("l_partkey") % 30 / 100.0).alias("dark"),
        F.element_at(F.array(*map(F.lit, ("native", "tesseract", "vision"))), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("route"), (F.col("l_orderkey") % 13 == 0).alias("forced"),
    )


@query(
    "ocr_policy",
    f"""WITH {_OCR} SELECT doc, page, (len(w) < 8 AND dark >= 0.12) OR text = '' OR confidence < 60 OR jumble AS needs_vision, route <> 'tesseract' AND (forced OR jumble) AS force_vision,
      CASE WHEN route = 'vision' AND page % 2 = 0 THEN 'tesseract' ELSE route END AS route, length(text) < 50 OR jumble AS fallback FROM s""",
)
def ocr_policy(spark, sf_dir):
    """Which pages the vision model reads again, which skip the text engine, which route ruled pages take."""
    rows = _ocr_pages(spark, sf_dir)
    text, jumble = F.col("text"), validation.is_scrambled(F.col("text"))
    return rows.select(
        "doc", "page", pages.needs_vision(text, F.col("confidence"), F.col("dark"), F.lit(60.0)).alias("needs_vision"), pages.force_vision(F.col("route"), jumble, F.col("forced")).alias("force_vision"),
        pages.effective_route(F.col("route"), F.col("page") % 2 == 0).alias("route"), pages.wants_fallback(text).alias("fallback"),
    )


@query("ocr_choice", f"WITH {_OCR} SELECT engine, count(*) AS n FROM (SELECT CASE WHEN (forced OR (len(w) < 8 AND dark >= 0.12) OR text = '' OR confidence < 60 OR jumble) AND page % 3 > 0 THEN 'vision' ELSE 'tesseract' END AS engine FROM s) GROUP BY engine")
def ocr_choice(spark, sf_dir):
    """The engine whose reading of a page is taken."""
    chosen = pages.ocr_choice(F.col("text"), F.col("confidence"), F.col("dark"), F.lit(60.0), F.col("forced"), F.when(F.col("page") % 3 > 0, "seen").otherwise(" "))
    return _ocr_pages(spark, sf_dir).withColumn("c", chosen).groupBy("c.engine").agg(F.count("*").alias("n"))


@query("word_confidence", "SELECT l_orderkey AS page, string_agg(word, ' ' ORDER BY n, word) AS text, round(avg(confidence), 9) AS confidence FROM (SELECT l_orderkey, l_linenumber AS n, CASE WHEN l_partkey % 4 = 0 THEN ' ' ELSE 'w' || l_partkey END AS word, CAST(l_suppkey % 100 - 1 AS DOUBLE) AS confidence FROM lineitem) WHERE confidence >= 0 AND trim(word) <> '' GROUP BY l_orderkey")
def word_confidence(spark, sf_dir):
    """A page's words and their mean confidence; what has none, or is blank, doesn't count."""
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.when(F.col("l_partkey") % 4 == 0, " ").otherwise(F.concat(F.lit("w"), F.col("l_partkey").cast("string"))).alias("word"), (F.col("l_suppkey") % 100 - 1).cast("double").alias("confidence"))
    return pages.word_confidence(words).withColumn("confidence", F.round("confidence", 9))


@query("dark_ratio", "SELECT l_orderkey AS image, round(sum(CASE WHEN l_partkey % 256 < 160 THEN l_quantity ELSE 0 END) / sum(l_quantity), 9) AS dark FROM lineitem GROUP BY l_orderkey")
def dark_ratio(spark, sf_dir):
    """Share of dark pixels from a histogram of greys."""
    histogram = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 256).alias("grey"), F.col("l_quantity").alias("n"))
    return pages.dark_ratio(histogram).withColumn("dark", F.round("dark", 9))


_PIXEL = "(doc_id % 3 = 0 AND (x % 7 = 0 OR y % 7 = 0)) OR (doc_id % 3 = 1 AND y % 7 = 0)"


@query(
    "ruled_grids",
    f"""WITH px AS (SELECT doc_id AS page, x, y, {_PIXEL} AS dark FROM documents, range(20) a(x), range(20) b(y)),
    ax AS (SELECT page, 'x' AS axis, x AS pos, sum(CAST(dark AS INTEGER)) AS d, count(*) AS n FROM px GROUP BY page, x UNION ALL SELECT page, 'y', y, sum(CAST(dark AS INTEGER)), count(*) FROM px GROUP BY page, y),
    h AS (SELECT page, axis, count(*) FILTER (d >= n * 0.55) AS hits, max(pos) FILTER (d >= n * 0.55) - min(pos) FILTER (d >= n * 0.55) AS span FROM ax GROUP BY page, axis)
    SELECT page, count(*) FILTER (hits >= 3 AND span >= greatest(2, (hits - 1) * 2)) = 2 AS ruled FROM h GROUP BY page""",
)
def ruled_grids(spark, sf_dir):
    """Pages that show a ruled grid, by dark lines on both axes of sampled pixels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("x"))
    px = docs.select("doc_id", "x", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("y")).withColumn("v", F.when(F.expr(_PIXEL), 0).otherwise(255))
    return pages.ruled_grids(px.select(F.col("doc_id").alias("page"), "x", "y", F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b")))


# -- words and blocks

_WORDS = """w AS (SELECT doc_id AS page, (i - 1) // 8 AS block, 0 AS line, ((i - 1) % 8) * 20.0 + (CASE WHEN doc_id % 2 = 0 AND i % 2 = 0 THEN -8.0 ELSE 0.0 END) AS x0, ((i - 1) // 8) * 12.0 AS y0, word, i FROM (
      SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) AS i FROM documents)),
    b AS (SELECT *, x0 + 10.0 AS x1, y0 + 10.0 AS y1 FROM w), g AS (SELECT *, lead(word) OVER l AS nxt, (lead(x0) OVER l - x1) / 10.0 AS gap FROM b WINDOW l AS (PARTITION BY page, block, line ORDER BY x0, word))"""


def _words(spark, sf_dir) -> DataFrame:
    listed = F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("i", "word")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), listed)
    x0 = (F.col("i") % 8) * 20.0 + F.when((F.col("page") % 2 == 0) & (F.col("i") % 2 == 1), -8.0).otherwise(0.0)
    rows = rows.select("page", F.floor(F.col("i") / 8).alias("block"), F.lit(0).alias("line"), x0.alias("x0"), (F.floor(F.col("i") / 8) * 12.0).alias("y0"), "word")
    return rows.withColumns({"x1": F.col("x0") + 10.0, "y1": F.col("y0") + 10.0})


@query(
    "rejoined_pages",
    f"""WITH {_WORDS}, gs AS (SELECT page, list(gap ORDER BY gap) AS s, count(gap) AS n FROM g WHERE gap IS NOT NULL GROUP BY page),
    q AS (SELECT page, s[least(CAST(floor(n * 0.2) AS BIGINT), n - 1) + 1] AS narrow, s[least(CAST(floor(n * 0.35) AS BIGINT), n - 1) + 1] AS low, s[least(CAST(floor(n * 0.8) AS BIGINT), n - 1) + 1] AS wide, n FROM gs),
    lim AS (SELECT page, (low + wide) / 2 AS lim FROM q WHERE n >= 12 AND narrow > 0 AND wide / narrow >= 1.3),
    j AS (SELECT g.page, block, x0, y0, word || CASE WHEN nxt IS NULL THEN '' WHEN gap < lim AND length(word) <= 5 AND length(nxt) <= 5 THEN '' ELSE ' ' END AS piece, word FROM g JOIN lim USING (page)),
    l AS (SELECT page, block, min(y0) AS y, min(x0) AS x, string_agg(piece, '' ORDER BY x0, word) AS t FROM j GROUP BY page, block)
    SELECT page, md5(string_agg(t, chr(10) ORDER BY y, x, block)) AS digest FROM l GROUP BY page""",
)
def rejoined_pages(spark, sf_dir):
    """Pages whose words are split inside, put together by the two kinds of gaps."""
    return pages.rejoined(_words(spark, sf_dir)).select("page", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("reading_order", "SELECT l_orderkey AS page, string_agg(t, chr(10) ORDER BY y, x, t) AS text FROM (SELECT l_orderkey, round_even(l_extendedprice / 100, 1) AS y, round_even(l_quantity, 1) AS x, CASE WHEN l_partkey % 6 = 0 THEN '' ELSE 'b' || l_partkey END AS t FROM lineitem) WHERE t <> '' GROUP BY l_orderkey")
def reading_order(spark, sf_dir):
    """Text blocks from top to bottom and left to right."""
    text = F.when(F.col("l_partkey") % 6 == 0, "  ").otherwise(F.concat(F.lit(" b"), F.col("l_partkey").cast("string"), F.lit("\n")))
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("x0"), (F.col("l_extendedprice") / 100).alias("y0"), text.alias("text"))
    return pages.reading_order(blocks)


@query("table_order", "SELECT l_orderkey AS page, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY round_even(l_extendedprice, 1), round_even(l_quantity + l_linenumber / 8.0, 1)) AS INTEGER) AS place FROM lineitem")
def table_order(spark, sf_dir):
    """Tables of a page by their place on it."""
    tables = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", F.col("l_extendedprice").alias("y0"), (F.col("l_quantity") + F.col("l_linenumber") / 8.0).alias("x0"))
    return pages.table_order(tables).select("page", "l_linenumber", "place")


@query("native_text", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'repaired' WHEN length(regexp_replace(left(text, 60), '^\\s+|\\s+$', '', 'g')) >= 50 AND doc_id % 4 = 1 THEN 'ordered' WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 50 THEN 'plain' ELSE 'none' END AS chosen FROM documents")
def native_text(spark, sf_dir):
    """The first of a page's readings that is long enough."""
    long = F.rpad(F.lit("repaired"), 60, "x")
    k, text = F.col("doc_id") % 4, F.col("text")
    got = pages.native_text(F.when(k == 0, long), F.when(k == 1, F.substring(text, 1, 60)).otherwise("short"), text)
    docs = table(spark, sf_dir, "documents").withColumn("got", got)
    chosen = F.when(F.col("got") == long, "repaired").when(F.col("got") == "", "none").when((k == 1) & (F.length("got") <= 60) & (F.length(F.trim(text)) > 60), "ordered")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return docs.select("doc_id", F.coalesce(chosen, F.when((k == 1) & (F.col("got") == strip(F.substring(text, 1, 60))), "ordered"), F.lit("plain")).alias("chosen"))


@query("fragment_gate", "WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS words, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS w FROM documents) SELECT doc_id, words >= 12 AND len(w) >= 20 AND len(list_filter(w, lambda x: length(x) <= 4)) / len(w) >= 0.8 AS fragmented FROM t")
def fragment_gate(spark, sf_dir):
    """Pages that are worth a repair: enough words, most of them short."""
    words = F.regexp_count("text", F.lit("\\S+"))
    return table(spark, sf_dir, "documents").select("doc_id", pages.looks_fragmented(words, prose.short_token_ratio(F.col("text"))).alias("fragmented"))


@query("math_format_gate", "SELECT p_partkey, p_size / 100.0 >= 0.08 AND p_partkey % 3 > 0 AS wanted FROM part")
def math_format_gate(spark, sf_dir):
    """Pages that go to the reviewer for their mathematics."""
    return table(spark, sf_dir, "part").select("p_partkey", prose.wants_math_format(F.col("p_size") / 100.0, F.col("p_partkey") % 3 > 0).alias("wanted"))


# -- composition

_CONV = "c AS (SELECT conv_id AS doc, turn AS page, text FROM conversations)"


@query("ocr_documents", f"WITH {_CONV} SELECT doc, md5(CASE WHEN doc % 4 = 0 THEN '' ELSE 'base ' || doc || chr(10) || chr(10) END || string_agg('## Page ' || page || chr(10) || chr(10) || '### OCR' || chr(10) || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY page)) AS digest FROM c GROUP BY doc")
def ocr_documents(spark, sf_dir):
    """Documents with the pages that OCR has read after them."""
    read = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    docs = read.select("doc").distinct().withColumn("md", F.when(F.col("doc") % 4 > 0, F.concat(F.lit("base "), F.col("doc").cast("string"), F.lit("\n"))))
    return pages.with_ocr(docs, read).select("doc", F.md5(F.col("md").cast("binary")).alias("digest"))


@query("page_contexts", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '## Page 3' || chr(10) || chr(10) || 'native' || chr(10) || chr(10) END AS prefix, CASE WHEN doc_id % 5 = 0 OR doc_id % 3 > 0 THEN '' ELSE '### Figura 3.1' || chr(10) || 'tail ' || doc_id END AS tail FROM documents")
def page_contexts(spark, sf_dir):
    """What stands around a page's OCR text, which a retry keeps."""
    tail = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n\n### Figura 3.1\ntail "), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise("")
    body = F.when(F.col("doc_id") % 5 == 0, F.lit("## Page 3\n\nnative only")).otherwise(F.concat(F.lit("## Page 3\n\nnative\n\n### OCR\n\nread text\nmore"), tail))
    return table(spark, sf_dir, "documents").select("doc_id", pages.page_context(body).alias("c")).select("doc_id", "c.prefix", "c.tail")


@query(
    "figure_documents",
    """WITH b AS (SELECT conv_id AS doc, turn AS page, CASE WHEN turn % 2 = 1 AND conv_id % 5 > 0 THEN chr(10) || chr(10) || '### Figura ' || turn || '.1' || chr(10) || chr(10) || '![Figura p' || turn || '-1](a/f' || turn || '.png)'
        || CASE WHEN turn % 4 = 1 THEN chr(10) || chr(10) || '> **Figura (descripción generada):** plot' ELSE '' END || chr(10) || chr(10) ELSE chr(10) END AS put FROM conversations)
    SELECT doc, md5('head' || chr(10) || string_agg('## Page ' || page || chr(10) || 'text' || put, '' ORDER BY page)) AS digest FROM b GROUP BY doc""",
)
def figure_documents(spark, sf_dir):
    """Documents with their figures' blocks at the end of the pages they are on."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"))
    parts = turns.select("doc", (F.col("page") + 1).alias("pos"), "page", F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\ntext\n")).alias("part"))
    head = turns.select("doc").distinct().select("doc", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("page"), F.lit("head\n").alias("part"))
    some = turns.filter("page % 2 = 1 and doc % 5 > 0")
    path = F.concat(F.lit("a/f"), F.col("page").cast("string"), F.lit(".png"))
    blocks = some.select("doc", "page", F.lit(1).alias("index"), pages.figure_block(F.col("page"), F.lit(1), path, F.when(F.col("page") % 4 == 1, "plot")).alias("block"))
    return pages.with_figures(parts.unionByName(head), blocks).select("doc", F.md5(F.col("md").cast("binary")).alias("digest"))


@query("figures_without_pages", "SELECT n_nationkey AS doc, 'plain text' || chr(10) || chr(10) || '### Figura 1.1' || chr(10) || chr(10) || '![Figura p1-1](x.png)' || chr(10) || chr(10) || '### Figura 2.1' || chr(10) || chr(10) || '![Figura p2-1](x.png)' || chr(10) AS md FROM nation")
def figures_without_pages(spark, sf_dir):
    """A document without pages gets all figures at its end."""
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc"))
    parts = docs.select("doc", F.lit(0).alias("pos"), F.lit(None).cast("int").alias("page"), F.lit("plain text\n").alias("part"))
    blocks = docs.select("doc", F.explode(F.array(F.lit(2), F.lit(1))).alias("page")).select("doc", "page", F.lit(1).alias("index"), pages.figure_block(F.col("page"), F.lit(1), F.lit("x.png"), F.lit(None).cast("string")).alias("block"))
    return pages.with_figures(parts, blocks)


@query("asset_index", "SELECT l_orderkey AS doc, '## Embedded images' || chr(10) || chr(10) || string_agg('- Page ' || page || ': ![img' || l_linenumber || '](a/img' || l_linenumber || '.png)', chr(10) ORDER BY page, 'a/img' || l_linenumber || '.png') || chr(10) AS section FROM (SELECT *, l_partkey % 5 AS page FROM lineitem) GROUP BY l_orderkey")
def asset_index(spark, sf_dir):
    """The list of a document's images, by page and path."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 5).alias("page"), F.concat(F.lit("a/img"), F.col("l_linenumber").cast("string"), F.lit(".png")).alias("path"))
    return pages.asset_index(rows)


@query("enriched_images", "SELECT doc_id AS doc, 'a ![x](1.png)' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '> said ' || doc_id || chr(10) || '> more' || chr(10) ELSE '' END || ' b ![y](2.png) c' AS md FROM documents")
def enriched_images(spark, sf_dir):
    """Images with what OCR or a caption says about them behind the link."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"))
    described = docs.filter("doc % 2 = 0").select("doc", F.lit("1.png").alias("target"), F.concat(F.lit("said "), F.col("doc").cast("string"), F.lit("\nmore\n")).alias("text")).unionByName(docs.select("doc", F.lit("2.png").alias("target"), F.lit(" ").alias("text")))
    return pages.enriched_images(docs.withColumn("md", F.lit("a ![x](1.png) b ![y](2.png) c")), described)


@query("incomplete_banners", "SELECT p_partkey, '> **INCOMPLETO:** la conversión de `' || p_name || '` se detuvo' || CASE WHEN p_partkey % 4 > 0 THEN ' tras agotar su presupuesto de ' || CAST(p_size AS VARCHAR) || ' min' ELSE '' END || ', así que faltan páginas al final.' || chr(10) AS banner FROM part")
def incomplete_banners(spark, sf_dir):
    """The note at the head of a partial conversion."""
    return table(spark, sf_dir, "part").select("p_partkey", pages.incomplete_banner(F.col("p_name"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_size") * 60.0)).alias("banner"))


@query(
    "edited_frontmatter",
    "SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN 'no block' ELSE '---' || chr(10) || 'converted_at: \"now\"' || chr(10) || 'char_count: ' || length(regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g')) || chr(10) || '---' || chr(10) || text END) AS digest FROM documents",
)
def edited_frontmatter(spark, sf_dir):
    """Frontmatter brought up to date after an edit."""
    md = F.when(F.col("doc_id") % 4 == 0, "no block").otherwise(F.concat(F.lit('---\nconverted_at: "then"\nchar_count: 1\n---\n'), F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(pages.refreshed_frontmatter(md, F.lit("now")).cast("binary")).alias("digest"))


# -- figures: line items are shapes of a page of 600 by 800 points

_SHAPES = """shapes AS (SELECT l_orderkey AS page, l_linenumber AS seq, CASE WHEN l_partkey % 4 = 0 THEN 'raster' ELSE 'vector' END AS kind, l_partkey % 3 = 0 AS filled, CAST(l_suppkey % 500 AS DOUBLE) AS x0, CAST(l_partkey % 700 AS DOUBLE) AS y0,
    l_suppkey % 500 + l_quantity * 3 AS x1, l_partkey % 700 + l_quantity * 2.5 AS y1, 600.0 AS page_w, 800.0 AS page_h FROM lineitem)"""
_BLOCKS = "blocks AS (SELECT o_orderkey AS page, o_custkey AS seq, CAST(o_custkey % 400 AS DOUBLE) AS x0, CAST(o_custkey % 600 AS DOUBLE) AS y0, o_custkey % 400 + 180.0 AS x1, o_custkey % 600 + 90.0 AS y1, CASE WHEN o_custkey % 3 = 0 THEN 'axis' ELSE rpad('prose', 40 + CAST(o_custkey % 200 AS INTEGER), 'x') END AS text FROM orders)"


def _shapes(spark, sf_dir) -> DataFrame:
    rows, s, p = table(spark, sf_dir, "lineitem"), F.col("l_suppkey") % 500, F.col("l_partkey") % 700
    return rows.select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("seq"), F.when(F.col("l_partkey") % 4 == 0, "raster").otherwise("vector").alias("kind"), (F.col("l_partkey") % 3 == 0).alias("filled"), s.cast("double").alias("x0"), p.cast("double").alias("y0"),
        (s + F.col("l_quantity") * 3).alias("x1"), (p + F.col("l_quantity") * 2.5).alias("y1"), F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"),
    )


def _blocks(spark, sf_dir) -> DataFrame:
    k = F.col("o_custkey")
    text = F.when(k % 3 == 0, "axis").otherwise(F.rpad(F.lit("prose"), (k % 200 + 40).cast("int"), F.lit("x")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), k.alias("seq"), (k % 400).cast("double").alias("x0"), (k % 600).cast("double").alias("y0"), (k % 400 + 180.0).alias("x1"), (k % 600 + 90.0).alias("y1"), text.alias("text"))


@query("figure_candidates", f"WITH {_SHAPES} SELECT page, seq, kind FROM shapes WHERE x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) / (page_w * page_h) <= 0.85 AND ((kind = 'vector' AND x1 - x0 >= 4 AND y1 - y0 >= 4) OR (kind = 'raster' AND x1 - x0 >= 60 AND y1 - y0 >= 60))")
def figure_candidates(spark, sf_dir):
    """Shapes that may belong to figures: no rules, no whole pages, no small images."""
    return figures.candidates(_shapes(spark, sf_dir)).select("page", "seq", "kind")


@query(
    "figure_text",
    f"""WITH {_SHAPES}, {_BLOCKS}, o AS (SELECT s.page, s.seq, greatest(0, least(s.x1, b.x1) - greatest(s.x0, b.x0)) * greatest(0, least(s.y1, b.y1) - greatest(s.y0, b.y0)) AS over, (b.x1 - b.x0) * (b.y1 - b.y0) AS area, length(b.text) AS n FROM shapes s JOIN blocks b ON s.page = b.page AND length(b.text) >= 40),
    t AS (SELECT page, seq, sum(over) AS over, sum(floor(n * least(1.0, over / area))) AS chars FROM o WHERE over > 0 GROUP BY page, seq)
    SELECT s.page, s.seq, round(coalesce(t.over, 0) / ((x1 - x0) * (y1 - y0)), 9) AS covered, CAST(coalesce(t.chars, 0) AS BIGINT) AS chars FROM shapes s LEFT JOIN t USING (page, seq) WHERE x1 > x0 AND y1 > y0""",
)
def figure_text(spark, sf_dir):
    """How much prose lies under a region."""
    regions = _shapes(spark, sf_dir).filter("x1 > x0 and y1 > y0").withColumnRenamed("seq", "region")
    return figures.text_coverage(regions, _blocks(spark, sf_dir)).select("page", F.col("region").alias("seq"), F.round("covered", 9).alias("covered"), "chars")


@query("tiny_images", "SELECT p_partkey, p_size * 3 < 64 AND p_partkey % 100 < 64 AS tiny FROM part")
def tiny_images(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", figures.is_tiny_image(F.col("p_size") * 3, F.col("p_partkey") % 100).alias("tiny"))


@query("figure_regions")
def figure_regions(spark, sf_dir):
    """Figures of every page: clusters of shapes that pass all tests, with their labels, and images."""
    return figures.figure_regions(_shapes(spark, sf_dir), _blocks(spark, sf_dir))


# -- review

_FENCE = "chr(96) || chr(96) || chr(96)"


@query("unwrapped_answers", f"SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN t WHEN 1 THEN {_FENCE} || chr(10) || t WHEN 2 THEN {_FENCE} || chr(10) || t || chr(10) || {_FENCE} || 'py' || chr(10) || 'x' || chr(10) || {_FENCE} ELSE t END) AS digest FROM (SELECT doc_id, regexp_replace(left(text, 100), '\\A\\s+|\\s+\\z', '', 'g') AS t FROM documents)")
def unwrapped_answers(spark, sf_dir):
    """Answers without the fence around all of them."""
    t = F.regexp_replace(F.substring("text", 1, 100), r"\A\s+|\s+\z", "")
    k, fence = F.col("doc_id") % 4, F.lit("```")
    raw = F.when(k == 0, F.concat(F.lit(" ```markdown\n"), t, F.lit("\n```\n"))).when(k == 1, F.concat(fence, F.lit("\n"), t)).when(k == 2, F.concat(fence, F.lit("\n"), t, F.lit("\n```py\nx\n```"))).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(review.unwrapped(raw).cast("binary")).alias("digest"))


@query("judged_sections", "WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'short' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS body FROM conversations) SELECT conv_id AS path, CAST(turn AS INTEGER) AS page, md5(body) AS digest FROM s WHERE length(body) >= 20")
def judged_sections(spark, sf_dir):
    """Pages that a judge is asked about, without their headings."""
    part = F.concat(F.lit("## Page "), F.col("turn").cast("string"), F.lit("\n\n"), F.when(F.col("turn") % 3 == 0, "short").otherwise(F.col("text")), F.lit("\n"))
    docs = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("path")).agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("p"))
    found = review.judged_sections(docs.select("path", F.concat(F.lit("intro\n"), F.array_join(F.transform("p", lambda x: x["p"]), "")).alias("md")))
    return found.select("path", "page", F.md5(F.col("body").cast("binary")).alias("digest"))


_REPLY = "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 1 ELSE 2 END AS n FROM documents WHERE doc_id % 4 <> 2"


@query("judge_flags", f"SELECT doc_id AS path, CAST(1 AS INTEGER) AS page, 'q' || i || ' ' || doc_id AS quote, 'why' AS issue, CASE WHEN i = 1 THEN 'fix' ELSE '' END AS suggestion FROM ({_REPLY}), range(1, 3) r(i) WHERE i <= n")
def judge_flags(spark, sf_dir):
    """Flags from a judge's replies: arrays amid prose, cut off ones, none at all."""
    d, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    one = F.concat(F.lit('{"quote": "q1 '), d, F.lit('", "issue": "why", "suggestion": "fix"}'))
    two = F.concat(F.lit('{"quote": "q2 '), d, F.lit('", "issue": "why"}'))
    reply = F.when(k == 0, F.concat(F.lit("Here: ["), one, F.lit(", "), two, F.lit("] done"))).when(k == 1, F.concat(F.lit("["), one, F.lit(","), two, F.lit(', {"quote": "cut'))).when(k == 2, "nothing to say").otherwise(F.concat(one, F.lit(' {"quote": " ", "issue": "x"}')))
    return review.flags(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("page"), reply.alias("reply")))


@query(
    "span_rewrites",
    "SELECT doc_id AS page, CASE doc_id % 4 WHEN 0 THEN 'let $\\mu_0 = 3$ and x2 <!-- revisar: fórmula --> end' WHEN 1 THEN 'let µ0 = 3 <!-- revisar: fórmula --> and $x^2$ end' WHEN 2 THEN 'let µ0 = 3 <!-- revisar: fórmula --> and x2 <!-- revisar: fórmula --> end' ELSE 'let µ0 = 3 and x2 end' END AS text, CAST(CASE WHEN doc_id % 4 IN (0, 1) THEN 1 ELSE 0 END AS BIGINT) AS accepted, CAST(CASE doc_id % 4 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS BIGINT) AS rejected FROM documents",
)
def span_rewrites(spark, sf_dir):
    """Rewrites of formulas that keep every word and number; the other spans are marked."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.lit("let µ0 = 3 and x2 end").alias("text"))
    span = lambda i, s, e: F.struct(F.lit(i).alias("span"), F.lit(s).alias("start"), F.lit(e).alias("end"))
    spans = docs.filter("page % 4 < 3").select("page", F.inline(F.array(span(0, 4, 10), span(1, 15, 17))))
    first = docs.filter("page % 4 < 3").select("page", F.lit(0).alias("span"), F.when(F.col("page") % 4 == 0, "$\\mu_0 = 3$").otherwise("$\\mu_0 = 4$").alias("latex"))
    second = docs.filter("page % 4 in (1, 2)").select("page", F.lit(1).alias("span"), F.when(F.col("page") % 4 == 1, "$x^2$").otherwise("$x^{22}$").alias("latex"))
    return review.rewritten(docs, spans, first.unionByName(second))


@query(
    "review_requests",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Text to proofread:' || chr(10) || chr(10) || 'a $\\frac{1}{2}$ and $$\\alpha \\beta$$ \\gamma' || chr(10) || chr(10) || 'LaTeX commands in this text: \\alpha, \\beta, \\frac. Write those that don''t exist with \\operatorname and keep the others.' ELSE 'Text to proofread:' || chr(10) || chr(10) || 'plain' END AS request, CASE lang WHEN 'es' THEN 'Responde en español.' WHEN 'en' THEN 'Answer in English.' ELSE 'Answer in the language of the page.' END AS language FROM documents",
)
def review_requests(spark, sf_dir):
    """What a reviewer is asked, and the language that a caption is wanted in."""
    text = F.when(F.col("doc_id") % 2 == 0, "a $\\frac{1}{2}$ and $$\\alpha \\beta$$ \\gamma").otherwise("plain")
    return table(spark, sf_dir, "documents").select("doc_id", review.review_request(text).alias("request"), review.language_request(F.col("lang")).alias("language"))


_ERRORS = ("HTTP 429 too many requests", "Rate limit reached", "insufficient_quota: 429", "Invalid response from model", "validation error for ChatCompletion", "Connection error.", "bad request")


@query(
    "error_classes",
    f"""WITH e AS (SELECT event_id, [{', '.join(repr(e) for e in _ERRORS)}][event_id % 7 + 1] AS m, event_id % 2 = 0 AS local FROM events),
    k AS (SELECT *, CASE WHEN m LIKE 'insufficient%' THEN 'quota' WHEN m LIKE '%429%' OR m LIKE 'Rate%' THEN 'rate' WHEN m LIKE 'Invalid%' OR m LIKE 'validation%' THEN 'malformed' WHEN m LIKE 'Connection%' THEN 'connection' ELSE 'other' END AS kind FROM e)
    SELECT kind, local, kind IN ('rate', 'malformed') AS again, CASE WHEN local AND kind = 'connection' THEN 'no connection to m' WHEN NOT local AND kind = 'quota' THEN 'no credit left for m' END AS warning, count(*) AS n FROM k GROUP BY ALL""",
)
def error_classes(spark, sf_dir):
    """Failed calls: which are tried again, which become a warning."""
    message = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(review.error_class(message).alias("kind"), (F.col("event_id") % 2 == 0).alias("local"))
    return rows.groupBy("kind", "local", review.is_retried(F.col("kind")).alias("again"), review.soft_failure(F.col("kind"), F.col("local"), F.lit("m")).alias("warning")).agg(F.count("*").alias("n"))


@query("answered_images", "SELECT doc_id, sha256('ocr' || doc_id % 50) AS key, CASE WHEN doc_id % 50 % 4 = 0 THEN 'cached' WHEN doc_id % 50 % 7 = 3 THEN NULL ELSE upper('ocr' || doc_id % 50) END AS text FROM documents")
def answered_images(spark, sf_dir):
    """Texts of images: from the cache, else answered once for all images of the same content; a failed call leaves none."""
    def answer(content: bytes) -> str:
        if int(content) % 7 == 3:
            raise ValueError("no answer")
        return f"OCR{content.decode()}"

    images = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).cast("string").cast("binary").alias("content"))
    keys = images.select(F.sha2(F.concat(F.lit("ocr").cast("binary"), F.col("content")), 256).alias("key"), (F.col("doc_id") % 50).alias("n")).distinct()
    cache = keys.filter("n % 4 in (0, 1)").select("key", F.when(F.col("n") % 4 == 0, "cached").otherwise(" ").alias("text"))
    return review.answered(images, answer, cache, "ocr").select("doc_id", "key", "text")


# -- reports


@query(
    "validation_texts",
    "WITH f AS (SELECT p_brand AS path, ['a_rule', 'b_rule'][p_partkey % 2 + 1] AS rule, ['error', 'warning'][p_partkey % 2 + 1] AS severity, 'd' || p_partkey AS detail, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size AS INTEGER) END AS line FROM part) SELECT path, path || ': ' || count(*) FILTER (severity = 'error') || ' error(s), ' || count(*) FILTER (severity = 'warning') || ' warning(s)' || chr(10) || string_agg('- [' || severity || '] ' || rule || CASE WHEN line IS NOT NULL THEN ' (line ' || line || ')' ELSE '' END || ': ' || detail, chr(10) ORDER BY rule, coalesce(line, -1), detail) AS report FROM f GROUP BY path",
)
def validation_texts(spark, sf_dir):
    """Each document's findings as text, in report order."""
    k = F.col("p_partkey")
    found = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.when(k % 2 == 0, "a_rule").otherwise("b_rule").alias("rule"), F.when(k % 2 == 0, "error").otherwise("warning").alias("severity"), F.concat(F.lit("d"), k.cast("string")).alias("detail"), F.when(k % 3 > 0, F.col("p_size").cast("int")).alias("line"))
    return summaries.validation_report(found)


@query("review_sections", "SELECT p_brand AS path, '## ' || p_brand || chr(10) || chr(10) || string_agg('- p. ' || p_size || ': \"q' || p_partkey || '\" — odd' || CASE WHEN p_partkey % 2 = 0 THEN ' → fix' ELSE '' END, chr(10) ORDER BY p_size, 'q' || p_partkey) AS section FROM part GROUP BY p_brand")
def review_sections(spark, sf_dir):
    """The queue of what a judge has flagged, by document and page."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_size").alias("page"), F.concat(F.lit("q"), k.cast("string")).alias("quote"), F.lit("odd").alias("issue"), F.when(k % 2 == 0, "fix").otherwise(" ").alias("suggestion"))
    return summaries.review_queue(rows)


@query("skipped_outputs", "SELECT doc_id, doc_id % 4 IN (0, 1) AS validator, doc_id % 4 IN (0, 2) AS judge FROM documents")
def skipped_outputs(spark, sf_dir):
    """Files of an output folder that validator and judge leave out."""
    path = F.element_at(F.array(*map(F.lit, (".cache/a.md", "sub/report.md", "sub/review-queue.md", "a/b.md"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", validation.skipped_outputs(path).alias("validator"), validation.skipped_by_judge(path).alias("judge"))
