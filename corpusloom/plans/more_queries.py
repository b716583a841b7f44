"""Routing, composition, rendering, lookup and job queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import cleaning as C
from corpusloom.operators import estimates, pages, parsers, planning, sinks, validation
from corpusloom.plans.catalog import query
from corpusloom.plans.data_queries import FILES, _files
from corpusloom.plans.text_queries import _PAGES_SQL
from corpusloom.sources import files
from corpusloom.sources.tables import MD_DOCS, markdown_documents, table

WITH = f"WITH {MD_DOCS}"


def joined(order: str, value: str, by: str):
    """Values of a group in an order, as one string."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), by)


@query("type_sniff", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.jpg' WHEN 3 THEN '.html' WHEN 4 THEN '.eml' ELSE '.txt' END AS suffix FROM documents")
def type_sniff(spark, sf_dir):
    """Suffixes by leading bytes that stand before each text, whatever the name says."""
    heads = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in ("255044462D312E34", "89504E470D0A1A0A", "FFD8FFE0", "3C21444F43545950452068746D6C3E", "46726F6D3A20610A", "")]), (F.col("doc_id") % 6 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(heads, F.col("text").cast("binary")).alias("content"), F.lit("in/x.txt").alias("path"))
    return files.select("doc_id", parsers.sniffed_suffix(F.col("content"), F.col("path")).alias("suffix"))


@query("script_fence", "SELECT doc_id, md5(f || 'matlab' || chr(10) || regexp_replace(code, '\\s+\\z', '') || chr(10) || f) AS digest FROM (SELECT doc_id, code, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(code, '`+'), lambda x: length(x))), 0) + 1)) AS f FROM (SELECT doc_id, text || repeat('`', CAST(doc_id % 6 AS INTEGER)) || ' end' AS code FROM documents))")
def script_fence(spark, sf_dir):
    code = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int")), F.lit(" end")).alias("code"))
    return code.select("doc_id", F.md5(parsers.script_block(F.col("code")).cast("binary")).alias("digest"))


@query("file_kinds", f"WITH {FILES} SELECT kind, count(*) AS files, sum(pages) AS pages FROM (SELECT pages, CASE WHEN path LIKE '%.pdf' AND scanned * 2 > pages THEN 'scanned' WHEN path LIKE '%.pdf' THEN 'text' WHEN path LIKE '%.docx' THEN 'office' ELSE 'other' END AS kind FROM files) GROUP BY kind")
def file_kinds(spark, sf_dir):
    suffix = files.own_suffix(F.col("path"))
    kind = F.when(suffix == ".pdf", planning.pdf_kind(F.col("scanned"), F.col("pages"))).when(suffix == ".txt", "other").otherwise(files.inspect_kind(suffix))
    return _files(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.sum("pages").alias("pages"))


@query("file_index", f"WITH {FILES} SELECT doc_id, row_number() OVER (PARTITION BY regexp_extract(path, '^in/([^/]+)', 1) ORDER BY path, doc_id) - 1 AS idx FROM files")
def file_index(spark, sf_dir):
    """Place of each file in its folder before any reordering, however many files a folder holds."""
    rows = _files(spark, sf_dir).withColumn("folder", F.regexp_extract("path", "^in/([^/]+)", 1))
    return planning.indexed_within(rows, "folder", ["path", "doc_id"], "idx").select("doc_id", "idx")


@query("cache_lookup", "WITH cache AS (SELECT sha256('v1:' || text) AS k, min(doc_id) AS first_doc FROM documents WHERE doc_id % 2 = 0 AND text <> '' GROUP BY 1) SELECT doc_id, first_doc FROM documents LEFT JOIN cache ON sha256('v1:' || text) = k")
def cache_lookup(spark, sf_dir):
    """Results remembered by the content's hash; empty results are no results."""
    docs = table(spark, sf_dir, "documents").withColumn("k", F.sha2(F.concat(F.lit("v1:"), "text"), 256))
    cache = docs.filter("doc_id % 2 = 0 and text <> ''").groupBy("k").agg(F.min("doc_id").alias("first_doc"))
    return docs.join(cache, "k", "left").select("doc_id", "first_doc")


@query("latex_commands", f"{WITH} SELECT doc_id, list_sort(list_distinct(regexp_extract_all(md, '\\\\[A-Za-z]+'))) AS commands FROM md_docs WHERE contains(md, chr(92))")
def latex_commands(spark, sf_dir):
    docs = markdown_documents(spark, sf_dir).filter(F.contains("md", F.lit("\\")))
    return docs.select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all("md", F.lit(r"(\\[A-Za-z]+)"), F.lit(1)))).alias("commands"))


@query("image_links_dropped", f"{WITH} SELECT doc_id, CAST(length(md) - length(regexp_replace(md, '!\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')) AS INTEGER) AS removed FROM md_docs WHERE regexp_matches(md, '!\\[([^\\]]*)\\]\\([^)]*\\)')")
def image_links_dropped(spark, sf_dir):
    """Image links give way to their alternative text."""
    link = r"!\[([^\]]*)\]\([^)]*\)"
    docs = markdown_documents(spark, sf_dir).filter(F.col("md").rlike(link))
    return docs.select("doc_id", (F.length("md") - F.length(F.regexp_replace("md", link, "$1"))).alias("removed"))


@query("usable_text", f"{WITH} SELECT regexp_replace(regexp_replace(md, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\A\\s+|\\s+\\z', '', 'g') <> '' AS usable, count(*) AS n FROM md_docs GROUP BY 1")
def usable_text(spark, sf_dir):
    docs = markdown_documents(spark, sf_dir)
    return docs.groupBy((C.stripped(F.regexp_replace("md", r"!\[[^\]]*\]\([^)]*\)", "")) != "").alias("usable")).agg(F.count("*").alias("n"))


@query(
    "figure_blocks",
    f"""{_PAGES_SQL}, figs AS (SELECT doc_id, 1 + doc_id % 3 AS page, string_agg('### Figure ' || (1 + doc_id % 3) || '.' || i, chr(10) || chr(10) ORDER BY i) AS block, count(*) AS n FROM documents, range(1, 4) r(i) WHERE i <= 1 + doc_id % 3 GROUP BY doc_id)
    SELECT p.doc_id, CAST(p.pos AS INTEGER) AS page, md5(part || coalesce(chr(10) || chr(10) || block, '')) AS digest, coalesce(n, 0) AS figures FROM pages p LEFT JOIN figs f ON p.doc_id = f.doc_id AND p.pos = f.page""",
)
def figure_blocks(spark, sf_dir):
    """Figure blocks appended to the pages they belong to."""
    figs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3 + 1).alias("page")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("page"))))
    figs = figs.withColumn("line", F.format_string("### Figure %d.%d", F.col("page"), F.col("i"))).groupBy("doc_id", F.col("page").alias("pos")).agg(joined("i", "line", "\n\n").alias("block"), F.count("*").alias("n"))
    met = validation.pages(markdown_documents(spark, sf_dir)).join(figs, ["doc_id", "pos"], "left")
    return met.select("doc_id", F.col("pos").alias("page"), F.md5(F.concat("part", F.coalesce(F.concat(F.lit("\n\n"), "block"), F.lit(""))).cast("binary")).alias("digest"), F.coalesce("n", F.lit(0)).alias("figures"))


@query(
    "compose_pages",
    f"""{_PAGES_SQL}, ocr AS (SELECT doc_id, pos AS page, 'ocr ' || pos AS t FROM pages WHERE (doc_id + pos) % 4 = 0), tab AS (SELECT doc_id, pos AS page, '| t |' AS t FROM pages WHERE pos % 2 = 0)
    SELECT p.doc_id, md5(string_agg('## Page ' || p.pos || chr(10) || coalesce(o.t, p.part) || CASE WHEN t.t IS NULL OR o.t IS NOT NULL THEN '' ELSE chr(10) || t.t END, chr(10) ORDER BY p.pos)) AS digest, count(o.t) AS from_ocr, count(CASE WHEN o.t IS NULL THEN t.t END) AS with_table
    FROM pages p LEFT JOIN ocr o ON p.doc_id = o.doc_id AND p.pos = o.page LEFT JOIN tab t ON p.doc_id = t.doc_id AND p.pos = t.page GROUP BY p.doc_id""",
)
def compose_pages(spark, sf_dir):
    """Pages from recognised text where there is some, else native text with the page's tables."""
    native = validation.pages(markdown_documents(spark, sf_dir)).select(F.col("doc_id").alias("doc"), F.col("pos").alias("page"), F.col("part").alias("text"))
    read = native.filter("(doc + page) % 4 = 0").select("doc", "page", F.format_string("ocr %d", F.col("page")).alias("text"))
    tables = native.filter("page % 2 = 0").select("doc", "page", F.lit("| t |").alias("table"))
    return pages.composed(native, read, tables).select(F.col("doc").alias("doc_id"), F.md5(F.col("md").cast("binary")).alias("digest"), "from_ocr", "with_table")


@query("page_splice", f"{_PAGES_SQL} SELECT doc_id, md5(string_agg('## Page ' || CASE WHEN pos = 1 THEN '1' || chr(10) || 'edited' ELSE part END, chr(10) ORDER BY pos)) AS digest FROM pages GROUP BY doc_id")
def page_splice(spark, sf_dir):
    """One page replaced, the others as they were."""
    parts = validation.pages(markdown_documents(spark, sf_dir)).select(F.col("doc_id").alias("doc"), F.col("pos").alias("page"), F.col("part").alias("text"))
    edits = parts.filter("page = 1").select("doc", "page", F.lit("edited").alias("edited"))
    return pages.spliced(parts, edits).select(F.col("doc").alias("doc_id"), F.md5(F.col("md").cast("binary")).alias("digest"))


@query("ocr_sections", f"{_PAGES_SQL} SELECT doc_id, CAST(min(pos) AS INTEGER) AS first_page, count(DISTINCT pos) AS pages FROM pages WHERE contains(part, chr(10) || '### OCR') GROUP BY doc_id")
def ocr_sections(spark, sf_dir):
    """Pages with a recognised-text section."""
    pages = validation.pages(markdown_documents(spark, sf_dir)).filter(F.contains("part", F.lit("\n### OCR")))
    return pages.groupBy("doc_id").agg(F.min("pos").alias("first_page"), F.countDistinct("pos").alias("pages"))


@query("price_lookup", "SELECT p_partkey, CASE WHEN s_acctbal IS NOT NULL AND p_partkey % 4 = 0 THEN 'manual' WHEN c_acctbal IS NOT NULL THEN 'catalog' ELSE 'unknown' END AS origin, round(CASE WHEN s_acctbal IS NOT NULL AND p_partkey % 4 = 0 THEN s_acctbal ELSE c_acctbal END, 4) AS price FROM part LEFT JOIN supplier ON s_suppkey = p_partkey LEFT JOIN customer ON c_custkey = p_partkey AND c_custkey % 5 > 0")
def price_lookup(spark, sf_dir):
    """Manual prices first, then the catalogue's, else unknown: unknown is null, not zero."""
    name = lambda c: F.concat(F.lit("openai:m"), c.cast("string"))
    priced = lambda df, key, usd: df.select(name(F.col(key)).alias("model"), F.col(usd).alias("input_per_mtok"), F.lit(0.0).alias("output_per_mtok"))
    manual = priced(table(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0"), "s_suppkey", "s_acctbal")
    catalog = priced(table(spark, sf_dir, "customer").filter("c_custkey % 5 > 0"), "c_custkey", "c_acctbal")
    models = table(spark, sf_dir, "part").select("p_partkey", name(F.col("p_partkey")).alias("model"), F.lit(1e6).alias("tokens_in"), F.lit(1e6).alias("tokens_out"))
    both = estimates.price(models, manual, catalog).join(manual.select("model", F.lit("manual").alias("m")), "model", "left")
    return both.select("p_partkey", F.coalesce("m", F.when(F.col("usd").isNotNull(), "catalog").otherwise("unknown")).alias("origin"), F.round("usd", 4).alias("price"))


@query("allowed_models", "SELECT p_partkey FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size > 45) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey)")
def allowed_models(spark, sf_dir):
    """Catalogue rows of allowed providers that nobody else sells: a semi join and an anti join."""
    part = table(spark, sf_dir, "part")
    allowed = part.filter("p_size > 45").select("p_brand").distinct()
    sold = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"))
    return part.join(allowed, "p_brand", "left_semi").join(sold, "p_partkey", "left_anti").select("p_partkey")


@query("job_counters", "SELECT user_id % 50 AS job, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE value IS NULL) AS unknown, count(*) AS n, bool_or(value > 90) AS any_high FROM events GROUP BY 1")
def job_counters(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("job")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("value").isNull()).alias("unknown"), F.count("*").alias("n"), F.bool_or(F.col("value") > 90).alias("any_high"))


@query("fallback_delta", "WITH c AS (SELECT event_id, user_id, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events) SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS delta FROM c")
def fallback_delta(spark, sf_dir):
    """Fallbacks of each page, from a counter that runs over the pages of a file."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = table(spark, sf_dir, "events").withColumn("n", F.sum(F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)).over(order))
    return planning.fallback_steps(counted, "user_id", ["ts", "event_id"], "n").select("event_id", "delta")


@query("review_queue", f"{_PAGES_SQL} SELECT doc_id, md5(string_agg('- page ' || pos || ': ' || length(part), chr(10) ORDER BY pos)) AS digest, count(*) AS flags FROM pages WHERE length(part) > 400 GROUP BY doc_id")
def review_queue(spark, sf_dir):
    """Flags of each document as a list in page order."""
    flags = validation.pages(markdown_documents(spark, sf_dir)).filter(F.length("part") > 400).withColumn("line", F.format_string("- page %d: %d", F.col("pos"), F.length("part")))
    return flags.groupBy("doc_id").agg(F.md5(joined("pos", "line", "\n").cast("binary")).alias("digest"), F.count("*").alias("flags"))


@query("manifest_json", f"WITH {FILES} SELECT path, '{{\"source\":\"' || path || '\",\"status\":\"ok\",\"output\":\"out/' || doc_id || '.md\",\"checksum\":\"' || checksum || '\",\"char_count\":' || n_chars || '}}' AS record FROM files")
def manifest_json(spark, sf_dir):
    """Manifest records as JSON, one a file: the map of a run is the table of its records; null fields are left out."""
    files_ = _files(spark, sf_dir)
    fields = {"source": F.col("path"), "status": F.lit("ok"), "output": F.concat(F.lit("out/"), F.col("doc_id").cast("string"), F.lit(".md")), "checksum": F.col("checksum"), "char_count": F.col("n_chars")}
    types = {f.split(" ")[0]: f.split(" ")[1] for f in sinks.RECORD.split(", ")}
    rows = files_.select("path", *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])
    return rows.select("path", sinks.record_json().alias("record"))


@query("manifest_load", f"WITH {FILES} SELECT path, checksum, n_chars AS char_count, doc_id % 10 = 0 AS broken FROM files WHERE doc_id % 10 > 0 UNION ALL SELECT path, NULL, NULL, true FROM files WHERE doc_id % 10 = 0")
def manifest_load(spark, sf_dir):
    """Records read back: unknown keys go, what can't be read is empty."""
    files = _files(spark, sf_dir)
    text = F.when(F.col("doc_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("checksum", F.col("n_chars").alias("char_count"), F.lit(1).alias("surplus"))))
    read = files.select("path", "doc_id", F.from_json(text, "checksum string, char_count long").alias("r"))
    return read.select("path", "r.checksum", "r.char_count", (F.col("doc_id") % 10 == 0).alias("broken"))


@query("chunk_sidecars", "SELECT conv_id AS doc_id, '[' || string_agg('{\"chunk\":' || turn || ',\"heading\":\"' || role || '\",\"text\":\"t' || turn || '\",\"char_count\":' || length(text) || '}', ',' ORDER BY turn) || ']' AS sidecar FROM conversations GROUP BY conv_id")
def chunk_sidecars(spark, sf_dir):
    """The chunks of each document as JSON, in order."""
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), F.col("role").alias("heading"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("text"), F.length("text").alias("char_count"))
    return sinks.sidecar(chunks)


@query("benchmark_overlap", "WITH b AS (SELECT DISTINCT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS w FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS w FROM documents) SELECT item_id, count(*) AS pairs, count(DISTINCT doc_id) AS docs FROM b JOIN d USING (w) WHERE length(w) > 9 GROUP BY item_id")
def benchmark_overlap(spark, sf_dir):
    """Long words that benchmark items share with documents: each word's documents are counted before it meets the items.

    The pairs of an item and a document are counted once for the items' words, which are few and kept to a checked size.
    """
    words = lambda df, key: df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1)))).alias("w")).filter(F.length("w") > 9)
    items = words(table(spark, sf_dir, "benchmark"), "item_id")
    listed = items.groupBy("w").agg(F.collect_set("item_id").alias("items"))  # as many rows as the items have long words
    hits = words(table(spark, sf_dir, "documents"), "doc_id").join(listed, "w")  # a document's word meets one row
    # per document first: an item counts once for the document, however many words they share
    by_doc = hits.select("doc_id", F.explode("items").alias("item_id")).groupBy("item_id", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy("item_id").agg(F.sum("n").alias("pairs"), F.count("*").alias("docs"))


@query("common_folder", f"WITH {FILES} SELECT source, min(path)[1:1] AS first, CAST(len(string_split(min(path), '/')) - 1 AS INTEGER) AS depth FROM files JOIN documents USING (doc_id) GROUP BY source")
def common_folder(spark, sf_dir):
    """Deepest folder that all paths of a source share: the shared start of the smallest and the largest path."""
    files = _files(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    ends = files.groupBy("source").agg(F.min("path").alias("a"), F.max("path").alias("b"))
    ends = ends.withColumns({"a": F.split("a", "/"), "b": F.split("b", "/")})
    shared = F.aggregate(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), F.struct(F.lit(True).alias("same"), F.lit(0).alias("n")), lambda s, e: F.struct((s["same"] & e).alias("same"), (s["n"] + (s["same"] & e).cast("int")).alias("n")), lambda s: s["n"])
    return ends.select("source", F.substring(F.element_at("a", 1), 1, 1).alias("first"), shared.alias("depth"))
