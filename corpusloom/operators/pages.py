"""Pages of scanned and native documents: OCR policy, which text a page gets, word repair, reading order, composition.

Inputs are what renderers and OCR engines give out: pages, words and blocks with places, confidences, pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.cleaning import once, stripped
from corpusloom.operators.validation import is_scrambled

#: Characters a native page must have; a nearly wordless page is one of few words, an inky one has this share of dark pixels.
MIN_CHARS, FEW_WORDS, INKY, DARK = 50, 8, 0.12, 160
#: Words and share of short tokens from which a page may be in fragments, widest piece joined, gaps of two kinds.
FRAGMENT_WORDS, FRAGMENT_SHARE, FRAGMENT_PIECE, FRAGMENT_RATIO = 12, 0.80, 5, 1.30
#: A ruled page's dark samples, share of a line that is dark, lines on each axis.
RULE_DARK, RULE_SHARE, RULE_LINES = 200, 0.55, 3


# -- OCR policy


def effective_route(route: Column, ruled: Column) -> Column:
    """A page for the vision model goes to the text engine where it shows a ruled grid."""
    return F.when((route == "vision") & F.coalesce(ruled, F.lit(False)), "tesseract").otherwise(route)


def wants_fallback(text: Column) -> Column:
    """Whether a native page is too short or too scrambled to stand."""
    return once(stripped(F.coalesce(text, F.lit(""))), lambda t: (F.length(t) < MIN_CHARS) | is_scrambled(t))


def needs_vision(text: Column, confidence: Column, dark: Column, least: Column) -> Column:
    """Whether a page read by the text engine goes to the vision model: wordless ink, nothing read, little confidence, or a jumble."""
    read = F.coalesce(text, F.lit(""))
    words = F.size(F.regexp_extract_all(read, F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1)))
    return F.coalesce((words < FEW_WORDS) & (dark >= INKY), F.lit(False)) | (stripped(read) == "") | F.coalesce(confidence < least, F.lit(False)) | is_scrambled(read)


def force_vision(route: Column, scrambled: Column, forced: Column) -> Column:
    """Whether a page skips the text engine: asked for, or scrambled, but never on its own route."""
    return (F.coalesce(route, F.lit("")) != "tesseract") & (forced | scrambled)


def ocr_choice(engine_text: Column, confidence: Column, dark: Column, least: Column, forced: Column, vision_text: Column) -> Column:
    """(engine, text) of a page or image: the text engine's reading, unless forced or doubtful and the vision model has read something."""
    wanted = forced | needs_vision(engine_text, confidence, dark, least)
    seen = stripped(F.coalesce(vision_text, F.lit(""))) != ""
    return F.when(wanted & seen, F.struct(F.lit("vision").alias("engine"), stripped(vision_text).alias("text"))).otherwise(F.struct(F.lit("tesseract").alias("engine"), stripped(F.coalesce(engine_text, F.lit(""))).alias("text")))


def word_confidence(words: DataFrame) -> DataFrame:
    """(page, text, confidence) from an engine's words (page, n, word, confidence): words without one, or blank, don't count."""
    real = words.filter((F.col("confidence") >= 0) & (F.trim("word") != ""))
    listed = real.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"), F.avg("confidence").alias("confidence"))
    return listed.select("page", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"), "confidence")


def dark_ratio(histogram: DataFrame) -> DataFrame:
    """(image, dark) from rows (image, grey, n): share of pixels darker than ink."""
    sums = histogram.groupBy("image").agg(F.sum(F.when(F.col("grey") < DARK, F.col("n")).otherwise(0)).alias("d"), F.sum("n").alias("n"))
    return sums.select("image", F.when(F.col("n") > 0, F.col("d") / F.col("n")).otherwise(0.0).alias("dark"))


def ruled_grids(samples: DataFrame) -> DataFrame:
    """(page, ruled) from sampled pixels (page, x, y, r, g, b): dark lines on both axes, apart from each other.

    Samples are counted by row and by column; a page has as many rows as its samples have values of y.
    """
    dark = samples.withColumn("dark", (F.greatest("r", "g", "b") < RULE_DARK).cast("int"))
    axes = dark.select("page", F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("at")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("at")))).alias("a"), "dark").select("page", "a.*", "dark")
    lines = axes.groupBy("page", "axis", "at").agg(F.sum("dark").alias("d"), F.count("*").alias("n"))
    hits = lines.groupBy("page", "axis").agg(F.count_if(F.col("d") >= F.col("n") * RULE_SHARE).alias("hits"), F.min(F.when(F.col("d") >= F.col("n") * RULE_SHARE, F.col("at"))).alias("first"), F.max(F.when(F.col("d") >= F.col("n") * RULE_SHARE, F.col("at"))).alias("last"))
    spread = (F.col("hits") >= RULE_LINES) & (F.col("last") - F.col("first") >= F.greatest(F.lit(2), (F.col("hits") - 1) * 2))
    return hits.groupBy("page").agg((F.count_if(F.coalesce(spread, F.lit(False))) == 2).alias("ruled"))


# -- words and blocks


def word_lines(words: DataFrame) -> DataFrame:
    """words (page, block, line, x0, y0, x1, y1, word) with gap: the way to the next word of the line, in heights of the word; null at its end."""
    w = Window.partitionBy("page", "block", "line").orderBy("x0", "word")
    height = F.col("y1") - F.col("y0")
    return words.withColumns({"next": F.lead("word").over(w), "gap": F.when(height > 0, (F.lead("x0").over(w) - F.col("x1")) / height)})


def gap_threshold(gaps: Column) -> Column:
    """The gap below which pieces belong together, from a page's gaps (an array): null if they are of one kind."""
    at = lambda s, q: F.get(s, F.least(F.floor(F.size(s) * q), F.size(s) - 1).cast("int"))
    two = lambda s: F.when((F.size(s) >= FRAGMENT_WORDS) & (at(s, 0.2) > 0) & (at(s, 0.8) / at(s, 0.2) >= FRAGMENT_RATIO), (at(s, 0.35) + at(s, 0.8)) / 2)
    return once(F.array_sort(gaps), two)


def rejoined(words: DataFrame) -> DataFrame:
    """(page, text): pages whose words were split inside, put together again; pages with one kind of gap have no row.

    Only spaces go: two short pieces with a narrow gap are one word.  Lines go by their first word's place.
    """
    placed = word_lines(words)
    limits = placed.groupBy("page").agg(gap_threshold(F.collect_list("gap")).alias("limit")).filter("limit is not null")
    met = placed.join(limits, "page")
    short = (F.length("word") <= FRAGMENT_PIECE) & (F.length("next") <= FRAGMENT_PIECE)
    after = F.when(F.col("next").isNull(), "").when((F.col("gap") < F.col("limit")) & short, "").otherwise(" ")
    pieces = met.groupBy("page", "block", "line").agg(F.array_sort(F.collect_list(F.struct("x0", "word", "y0", F.concat("word", after).alias("piece")))).alias("w"))
    lines = pieces.select("page", F.struct(F.get("w", F.lit(0))["y0"].alias("y"), F.get("w", F.lit(0))["x0"].alias("x"), "block", "line", F.array_join(F.transform("w", lambda p: p["piece"]), "").alias("text")).alias("l"))
    text = lines.groupBy("page").agg(F.array_sort(F.collect_list("l")).alias("l")).select("page", stripped(F.array_join(F.transform("l", lambda x: x["text"]), "\n")).alias("text"))
    return text.filter("text <> ''")


def looks_fragmented(words: Column, short_share: Column) -> Column:
    """Whether a page with so many words and such a share of short tokens is worth the repair."""
    return F.coalesce((words >= FRAGMENT_WORDS) & (short_share >= FRAGMENT_SHARE), F.lit(False))


def reading_order(blocks: DataFrame) -> DataFrame:
    """(page, text) from text blocks (page, x0, y0, text): from top to bottom and left to right by tenths of a point; blank ones don't count."""
    place = F.struct(F.bround("y0", 1).alias("y"), F.bround("x0", 1).alias("x"), stripped(F.col("text")).alias("t"))
    listed = blocks.filter(stripped(F.col("text")) != "").groupBy("page").agg(F.array_sort(F.collect_list(place)).alias("b"))
    return listed.select("page", F.array_join(F.transform("b", lambda x: x["t"]), "\n").alias("text"))


def table_order(tables: DataFrame) -> DataFrame:
    """tables (page, x0, y0, ...) with place: their order on the page, by tenths of a point."""
    return tables.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(F.bround("y0", 1), F.bround("x0", 1))))


def native_text(repaired: Column, ordered: Column, plain: Column, least: int = MIN_CHARS) -> Column:
    """The first of a page's readings that is long enough, else nothing."""
    enough = lambda c: once(stripped(F.coalesce(c, F.lit(""))), lambda t: F.when(F.length(t) >= least, t))
    return F.coalesce(enough(repaired), enough(ordered), enough(plain), F.lit(""))


# -- composition


def ocr_section(page: Column, text: Column) -> Column:
    return F.concat(F.lit("## Page "), page.cast("string"), F.lit("\n\n### OCR\n\n"), stripped(text))


def with_ocr(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """documents (doc, md) with OCR pages (doc, page, text) after them, by page; a document without text consists of them."""
    body = pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", ocr_section(F.col("page"), F.col("text")).alias("s")))).alias("_s"))
    body = body.select("doc", F.array_join(F.transform("_s", lambda x: x["s"]), "\n\n").alias("_ocr"))
    base = stripped(F.coalesce("md", F.lit("")))
    return documents.join(body, "doc", "left").withColumn("md", F.when(F.col("_ocr").isNull(), F.coalesce("md", F.lit(""))).otherwise(F.concat(base, F.when(base != "", "\n\n").otherwise(""), F.col("_ocr")))).drop("_ocr")


def composed(pages: DataFrame, read: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc, md, from_ocr, with_table) from native pages (doc, page, text), read ones (doc, page, text) and tables (doc, page, table).

    A page that was read replaces the native one, and its tables too.
    """
    met = pages.join(read.withColumnRenamed("text", "_read"), ["doc", "page"], "left").join(tables.join(read, ["doc", "page"], "left_anti"), ["doc", "page"], "left")
    line = F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n"), F.coalesce("_read", "text"), F.coalesce(F.concat(F.lit("\n"), "table"), F.lit("")))
    listed = met.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", line.alias("line")))).alias("l"), F.count("_read").alias("from_ocr"), F.count("table").alias("with_table"))
    return listed.select("doc", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("md"), "from_ocr", "with_table")


def spliced(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc, md): documents from their pages (doc, page, text) with the pages that edits (doc, page, edited) replaces; empty edits count."""
    met = pages.join(edits, ["doc", "page"], "left")
    line = F.concat(F.lit("## Page "), F.when(F.col("edited").isNotNull(), F.concat(F.col("page").cast("string"), F.lit("\n"), F.col("edited"))).otherwise(F.col("text")))
    listed = met.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", line.alias("line")))).alias("l"))
    return listed.select("doc", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("md"))


def page_context(section: Column) -> Column:
    """(prefix, tail) around a page's OCR text: what stands before its heading, and from the next heading on."""
    cut = r"(?sm)\A(.*?)^### OCR\b[^\n]*\n(.*)\z"
    after = F.regexp_extract(section, cut, 2)
    tail = F.regexp_replace(F.regexp_extract(after, r"(?sm)^(#{1,6} .*)\z", 1), r"\s+\z", "")
    return F.when(section.rlike(r"(?m)^### OCR\b"), F.struct(F.regexp_extract(section, cut, 1).alias("prefix"), tail.alias("tail"))).otherwise(F.struct(F.lit("").alias("prefix"), F.lit("").alias("tail")))


def figure_block(page: Column, index: Column, path: Column, description: Column) -> Column:
    """Heading, image and, where there is one, the quoted description of a figure."""
    n = page.cast("string"), index.cast("string")
    image = F.concat(F.lit("![Figura p"), n[0], F.lit("-"), n[1], F.lit("]("), path, F.lit(")"))
    said = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("> **Figura (descripción generada):** "), description))
    return F.concat_ws("\n\n", F.concat(F.lit("### Figura "), n[0], F.lit("."), n[1]), image, said)


def with_figures(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, md): documents from their parts (doc, pos, page, part), figure blocks (doc, page, index, block) at the end of their pages.

    The part without a page number is what stands before the first page.  A document without pages gets all blocks at its end.
    """
    held = blocks.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("index", "block"))).alias("_b"))
    held = held.withColumn("_b", F.array_join(F.transform("_b", lambda x: x["block"]), "\n\n"))
    placed = sections.join(held, ["doc", "page"], "left").withColumn("_t", F.when(F.col("_b").isNotNull(), F.concat(F.regexp_replace("part", r"\s+\z", ""), F.lit("\n\n"), F.col("_b"), F.lit("\n\n"))).otherwise(F.col("part")))
    text = placed.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "_t"))).alias("_p"), F.max("page").alias("_pages"))
    everything = held.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "_b"))).alias("_all"))
    joined = F.array_join(F.transform("_p", lambda x: x["_t"]), "")
    extra = F.array_join(F.transform("_all", lambda x: x["_b"]), "\n\n")
    whole = F.when(F.col("_pages").isNull() & F.col("_all").isNotNull(), F.concat(F.regexp_replace(joined, r"\s+\z", ""), F.lit("\n\n"), extra, F.lit("\n"))).otherwise(joined)
    return text.join(everything, "doc", "left").select("doc", whole.alias("md"))


def asset_index(assets: DataFrame) -> DataFrame:
    """(doc, section): a list of the images found in a document, from rows (doc, page, path), path relative to the output, by page and path."""
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"(?<=.)\.[^.]+$", "")
    line = F.concat(F.lit("- Page "), F.col("page").cast("string"), F.lit(": !["), stem, F.lit("]("), F.col("path"), F.lit(")"))
    listed = assets.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "path", line.alias("line")))).alias("l"))
    return listed.select("doc", F.concat(F.lit("## Embedded images\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("section"))


def enriched_images(documents: DataFrame, described: DataFrame) -> DataFrame:
    """documents (doc, md) with a quoted block behind each image link whose target is described: described has (doc, target, text)."""
    link = r"!\[[^\]]*\]\(([^)]+)\)"
    said = described.filter(F.trim("text") != "").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("target", "text"))).alias("_said"))

    def rebuilt(md: Column) -> Column:
        between, links = F.split(md, link, -1), F.regexp_extract_all(md, F.lit(f"({link})"), F.lit(1))
        block = lambda l: once(F.element_at("_said", F.regexp_extract(l, link, 1)), lambda t: F.concat(l, F.when(t.isNotNull(), F.concat(F.lit("\n\n> "), F.replace(stripped(t), F.lit("\n"), F.lit("\n> ")), F.lit("\n"))).otherwise("")))
        return F.array_join(F.flatten(F.zip_with(between, F.transform(links, block), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")

    met = documents.join(said, "doc", "left")
    return met.withColumn("md", F.when(F.col("_said").isNull(), F.col("md")).otherwise(once(F.col("md"), rebuilt))).drop("_said")


def incomplete_banner(name: Column, budget: Column) -> Column:
    """The note at the head of a document whose conversion ran out of time; budget: seconds, null without one."""
    limit = F.when(F.coalesce(budget, F.lit(0.0)) > 0, F.concat(F.lit(" tras agotar su presupuesto de "), F.format_string("%.0f", budget / 60), F.lit(" min"))).otherwise("")
    return F.concat(F.lit("> **INCOMPLETO:** la conversión de `"), name, F.lit("` se detuvo"), limit, F.lit(", así que faltan páginas al final.\n"))


def refreshed_frontmatter(md: Column, now: Column) -> Column:
    """An edited document with its frontmatter's time and number of characters brought up to date; one without frontmatter as it is."""
    from corpusloom.functions.prose import FRONTMATTER

    def fresh(block: Column, body: Column) -> Column:
        timed = F.regexp_replace(block, r"(?m)^converted_at:.*$", F.concat(F.lit('converted_at: "'), now, F.lit('"')))
        return F.concat(F.regexp_replace(timed, r"(?m)^char_count:.*$", F.concat(F.lit("char_count: "), F.length(stripped(body)).cast("string"))), body)

    return once(F.coalesce(md, F.lit("")), lambda t: once(F.regexp_extract(t, FRONTMATTER, 0), lambda b: F.when(b == "", t).otherwise(fresh(b, F.substr(t, F.length(b) + 1)))))
