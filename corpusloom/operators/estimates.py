"""What a conversion would take: sizes of rendered images, models and their memory, prices, and what-if alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.cleaning import once
from corpusloom.operators import planning

#: Providers of hosted models, the local one; resolution, longest sides of page and figure, a figure's share of the page.
CLOUD = ("openai", "anthropic", "google", "groq", "mistral", "openrouter")
KNOWN = (*CLOUD, "ollama", "cohere", "deepseek")
LOCAL = "ollama"
DPI, PAGE_PIXELS, FIGURE_PIXELS, FIGURE_SHARE = 300, 2200, 1024, 0.5
#: The page that local rates were measured on, tokens that come out of a page, a figure and a review page.
REFERENCE = (2200.0, 1650.0)
PAGE_TOKENS, FIGURE_TOKENS, REVIEW_TOKENS = 600, 150, 500
#: What is offered instead of the chosen models.
ALTERNATIVES = (("figure_model", "openai:gpt-4o-mini"), ("ocr_model", "openai:gpt-4o"), ("ocr_model", "tesseract"))
LOCAL_LIMIT_SHARE, TIGHT_GB = 0.75, 3.0


# -- models


def model_id(model: Column) -> Column:
    """provider:model; a bare name, or one whose prefix is no provider, is a local model's."""
    return once(F.trim(F.coalesce(model, F.lit(""))), lambda m: F.when((m == "") | F.substring_index(m, ":", 1).isin(*KNOWN), m).otherwise(F.concat(F.lit(f"{LOCAL}:"), m)))


def provider(model: Column) -> Column:
    return F.nullif(F.substring_index(model_id(model), ":", 1), F.lit(""))


def is_local(model: Column) -> Column:
    return F.coalesce((provider(model) == LOCAL) & (F.trim(model) != "tesseract"), F.lit(False))


def tag(model: Column) -> Column:
    """A local model's bare name."""
    return F.regexp_replace(model_id(model), f"^{LOCAL}:", "")


def stage_kind(model: Column) -> Column:
    """none, cpu, gpu or cloud."""
    return F.when(F.trim(F.coalesce(model, F.lit(""))) == "", "none").when(F.trim(model) == "tesseract", "cpu").when(is_local(model), "gpu").otherwise("cloud")


def parameters(model: Column) -> Column:
    """Billions of parameters in a model's name; null where it doesn't say."""
    return F.nullif(F.regexp_extract(F.lower(model), "(?<![0-9])([0-9]+)b(?![0-9a-z])", 1), F.lit("")).cast("int")


def memory_gb(model: Column, file_gb: Column) -> Column:
    """What a model takes on the GPU: nothing for hosted ones; by its file, else by its name, else 0."""
    return F.when(is_local(model), F.coalesce(planning.resident_gb(file_gb, parameters(model)), F.lit(0.0))).otherwise(0.0)


def resolved(models: DataFrame, installed: DataFrame, keys: DataFrame, prices: DataFrame) -> DataFrame:
    """models (raw) with id, kind and problems: installed (tag), keys (provider), prices (model) say what there is."""
    rows = models.withColumns({"id": F.when(F.trim("raw") == "tesseract", "tesseract").otherwise(model_id(F.col("raw"))), "_provider": provider(F.col("raw")), "_tag": tag(F.col("raw"))})
    rows = rows.join(installed.select(F.col("tag").alias("_tag"), F.lit(True).alias("_installed")).distinct(), "_tag", "left")
    rows = rows.join(keys.select(F.col("provider").alias("_provider"), F.lit(True).alias("_key")).distinct(), "_provider", "left")
    rows = rows.join(prices.select(F.col("model").alias("id"), F.lit(True).alias("_price")).distinct(), "id", "left")
    kind = F.when(F.col("id") == "tesseract", "cpu").when(F.col("_provider") == LOCAL, "local").otherwise("cloud")
    listed = F.array_compact(F.array(
        F.when((kind == "local") & F.col("_installed").isNull(), "not_installed"),
        F.when((kind == "cloud") & ~F.coalesce(F.col("_provider").isin(*CLOUD), F.lit(False)), "unknown_provider"),
        F.when((kind == "cloud") & F.col("_provider").isin(*CLOUD) & F.col("_key").isNull(), "no_api_key"),
        F.when((kind == "cloud") & F.col("_provider").isin(*CLOUD) & F.col("_price").isNull(), "unknown_price"),
    ))
    return rows.select("raw", "id", kind.alias("kind"), listed.alias("problems"))


def normalised_pipeline(fields: tuple[str, ...] = ("ocr_model", "figure_model", "review_model")) -> Column:
    """The models of a pipeline as one comparable value: spellings of the same model are equal."""
    return F.struct(*[F.when(F.col(f).isNotNull(), model_id(F.col(f))).alias(f) for f in fields])


# -- images


def rendered(width_pt: Column, height_pt: Column, longest: int, share: float = 1.0, dpi: int = DPI) -> Column:
    """(w, h) in pixels of a box in points (or a share of it on both sides), shrunk to the longest side."""
    w, h = width_pt * (share * dpi / 72), height_pt * (share * dpi / 72)
    shrink = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(w, h))
    return F.struct((w * shrink).alias("w"), (h * shrink).alias("h"))


def image_tokens(w: Column, h: Column, model: Column) -> Column:
    """Tokens of an image by its provider's rule; null where none is known, or without an area."""
    patches = F.lower(model_id(model)).rlike("qwen2[._]?5[-_]?vl")
    return F.when((w > 0) & (h > 0), F.when(provider(model) == "openai", planning.openai_image_tokens(w, h)).when(patches, planning.patch_image_tokens(w, h)))


def local_seconds(rate: Column, count: Column, w: Column, h: Column, model: Column) -> Column:
    """Seconds of a local model for so many images, scaled by their tokens against the page that rates were measured on."""
    of_page = image_tokens(F.lit(REFERENCE[0]), F.lit(REFERENCE[1]), model)
    return F.when(count <= 0, 0.0).otherwise(count * rate * F.coalesce(image_tokens(w, h, model) / of_page, F.lit(1.0)))


def representative(files: DataFrame) -> DataFrame:
    """(selection, path): of each selection's files (selection, pos, path, pages) the first PDF with pages."""
    some = files.filter((F.col("pages") > 0) & F.lower("path").endswith(".pdf"))
    return some.groupBy("selection").agg(F.min_by("path", "pos").alias("path"))


# -- prices


def price(models: DataFrame, manual: DataFrame, catalog: DataFrame) -> DataFrame:
    """models (model, tokens_in, tokens_out, ...) with usd: the manual price first, then the catalog's, null where neither is known.

    Prices: (model, input_per_mtok, output_per_mtok).
    """
    named = lambda df, p: df.select(model_id(F.col("model")).alias("_id"), F.col("input_per_mtok").alias(f"{p}_in"), F.col("output_per_mtok").alias(f"{p}_out"))
    met = models.withColumn("_id", model_id(F.col("model"))).join(named(manual, "_m"), "_id", "left").join(named(catalog, "_c"), "_id", "left")
    usd = lambda p: (F.col("tokens_in") * F.col(f"{p}_in") + F.col("tokens_out") * F.col(f"{p}_out")) / 1e6
    return met.withColumn("usd", F.coalesce(usd("_m"), usd("_c"))).drop("_id", "_m_in", "_m_out", "_c_in", "_c_out")


# -- memory


def local_models(pipelines: DataFrame) -> DataFrame:
    """(pipeline, stage, tag): the different local models of each pipeline (pipeline, ocr_model, figure_model, review_model), named by the first stage."""
    stages = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(s).alias("stage"), F.col(c).alias("model")) for i, (s, c) in enumerate((("ocr", "ocr_model"), ("figures", "figure_model"), ("review", "review_model")))])
    rows = pipelines.select("pipeline", F.inline(stages)).filter(is_local(F.col("model"))).withColumn("tag", tag(F.col("model")))
    return rows.groupBy("pipeline", "tag").agg(F.min_by("stage", "pos").alias("stage"), F.min("pos").alias("pos"))


def gpu_state(pipelines: DataFrame, installed: DataFrame, limit_gb: float) -> DataFrame:
    """(pipeline, models, resident_gb, headroom_gb, verdict): blocked, tight or fits, for installed models (tag, file_gb).

    Only two models or more can be blocked; a limit of 0 stands for a machine without one.
    """
    held = local_models(pipelines).join(installed, "tag", "left").withColumn("gb", memory_gb(F.col("tag"), F.col("file_gb")))
    sums = held.groupBy("pipeline").agg(F.count("*").alias("models"), F.bround(F.sum("gb"), 2).alias("resident_gb"))
    rows = pipelines.select("pipeline").join(sums, "pipeline", "left").fillna({"models": 0, "resident_gb": 0.0})
    rows = rows.withColumn("headroom_gb", F.bround(F.lit(limit_gb) - F.col("resident_gb"), 2))
    verdict = F.when((F.col("models") > 1) & (F.lit(limit_gb) > 0) & (F.col("resident_gb") > limit_gb), "blocked").when((F.col("models") > 0) & (F.lit(limit_gb) > 0) & (F.col("headroom_gb") < TIGHT_GB), "tight").otherwise("fits")
    return rows.withColumn("verdict", verdict)


def effective_figure_model(ocr: Column, figure: Column, review: Column, ocr_gb: Column, figure_gb: Column, review_gb: Column, limit_gb: Column) -> Column:
    """The model that figures really get: the page's, where another local one would not fit beside it (and a local reviewer)."""
    apart = is_local(figure) & is_local(ocr) & (tag(figure) != tag(ocr))
    others = ocr_gb + F.when(is_local(review) & (tag(review) != tag(ocr)), review_gb).otherwise(0.0)
    return F.when(F.coalesce(apart & (limit_gb > 0) & (others + figure_gb > limit_gb), F.lit(False)), ocr).otherwise(figure)


def gb_pair(a: Column, b: Column) -> Column:
    """Two sizes as text with as many decimals, up to two, as tell them apart; both the same note where none do."""
    text = lambda x, d: F.replace(F.format_string(f"%.{d}f", x), F.lit("."), F.lit(","))
    pair = lambda d: F.array(text(a, d), text(b, d))
    differ = lambda d: text(a, d) != text(b, d)
    return F.when(differ(0), pair(0)).when(differ(1), pair(1)).when(differ(2), pair(2)).otherwise(F.array(F.lit("≈ el límite"), F.lit("≈ el límite")))


# -- estimates


def scenarios(pipelines: DataFrame) -> DataFrame:
    """pipelines (pipeline, ocr_model, figure_model, review_model, describe_figures, ...) and what could be chosen instead.

    Every row has scenario: 'chosen', or the field and model that are swapped; swaps that change nothing are left out.
    """
    options = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("model")), *[F.struct(F.lit(f).alias("field"), F.lit(m).alias("model")) for f, m in ALTERNATIVES])
    rows = pipelines.select("*", F.explode(options).alias("_o"))
    current = F.when(F.col("_o.field") == "figure_model", F.col("figure_model")).otherwise(F.col("ocr_model"))
    same = model_id(F.coalesce(current, F.lit(""))) == model_id(F.col("_o.model"))
    rows = rows.filter(F.col("_o.field").isNull() | (~same & ((F.col("_o.field") != "figure_model") | F.col("describe_figures"))))
    rows = rows.withColumn("scenario", F.when(F.col("_o.field").isNull(), "chosen").otherwise(F.concat_ws("=", "_o.field", "_o.model")))
    for field in ("ocr_model", "figure_model"):
        rows = rows.withColumn(field, F.when(F.col("_o.field") == field, F.col("_o.model")).otherwise(F.col(field)))
    return rows.drop("_o")


def stages(work: DataFrame, prices: DataFrame) -> DataFrame:
    """(pipeline, scenario, workers, stage, model, kind, seconds, usd) of scenarios with their work.

    work: scenarios() with pages, scanned, math_pages, figures, and the size of a page in points (width_pt, height_pt), null if
    unknown.  usd is 0 where nothing is paid, and null where the price can't be known.  prices: (model, input_per_mtok, output_per_mtok).
    """
    work = work.withColumns({"_page": rendered(F.col("width_pt"), F.col("height_pt"), PAGE_PIXELS), "_figure": rendered(F.col("width_pt"), F.col("height_pt"), FIGURE_PIXELS, FIGURE_SHARE)})
    work = work.withColumn("_figures", F.when(F.col("describe_figures"), F.col("figures")).otherwise(0)).withColumn("_review", F.col("scanned") + F.col("math_pages"))
    none = F.lit(None).cast("string")

    def image(name: str, model: str, count: str, size: str, local: float, cloud: float, cpu: float, tokens: int) -> Column:
        kind = stage_kind(F.col(model))
        seconds = F.when(F.col(count) <= 0, 0.0).when(kind == "gpu", local_seconds(F.lit(local), F.col(count), F.col(f"{size}.w"), F.col(f"{size}.h"), F.col(model))).when(kind == "cloud", F.col(count) * cloud).when(kind == "cpu", F.col(count) * cpu).otherwise(0.0)
        each = image_tokens(F.col(f"{size}.w"), F.col(f"{size}.h"), F.col(model))
        paid = (kind == "cloud") & (F.col(count) > 0)
        return F.struct(F.lit(name).alias("stage"), F.col(model).alias("model"), kind.alias("kind"), seconds.alias("seconds"), paid.alias("paid"), (each * F.col(count)).cast("double").alias("tokens_in"), (F.col(count) * tokens).cast("double").alias("tokens_out"))

    def plain(name: str, seconds: Column) -> Column:
        return F.struct(F.lit(name).alias("stage"), none.alias("model"), F.lit("cpu").alias("kind"), seconds.alias("seconds"), F.lit(False).alias("paid"), F.lit(None).cast("double").alias("tokens_in"), F.lit(None).cast("double").alias("tokens_out"))

    kind = stage_kind(F.col("review_model"))
    review = F.struct(F.lit("review").alias("stage"), F.col("review_model").alias("model"), kind.alias("kind"), F.when(kind == "gpu", F.col("_review") * planning.LOCAL_REVIEW).when(kind == "cloud", F.col("_review") * planning.REMOTE_REVIEW).otherwise(0.0).alias("seconds"), ((kind == "cloud") & (F.col("_review") > 0)).alias("paid"), (F.col("_review") * REVIEW_TOKENS).cast("double").alias("tokens_in"), (F.col("_review") * REVIEW_TOKENS).cast("double").alias("tokens_out"))
    listed = F.array(
        plain("extract", (F.col("pages") * planning.EXTRACT_PAGE).cast("double")),
        image("ocr", "ocr_model", "scanned", "_page", planning.LOCAL_PAGE, planning.REMOTE_PAGE, planning.CPU_PAGE, PAGE_TOKENS),
        image("figures", "figure_model", "_figures", "_figure", planning.LOCAL_FIGURE, planning.REMOTE_FIGURE, 0.0, FIGURE_TOKENS),
        review,
        plain("write", (F.col("pages") * planning.WRITE_PAGE).cast("double")),
    )
    rows = work.select("pipeline", "scenario", "workers", F.inline(listed))
    priced = price(rows, prices.limit(0), prices)
    return priced.withColumn("usd", F.when(F.col("paid"), F.col("usd")).otherwise(0.0)).drop("paid", "tokens_in", "tokens_out")


def alternatives(work: DataFrame, prices: DataFrame) -> DataFrame:
    """(pipeline, scenario, total_seconds, bottleneck, total_usd) of every scenario of work, see stages()."""
    rows = stages(work, prices).withColumn("scenario", F.concat_ws("\t", "pipeline", "scenario"))
    done = planning.lanes(rows)
    return done.select(F.split("scenario", "\t").getItem(0).alias("pipeline"), F.split("scenario", "\t").getItem(1).alias("scenario"), "total_seconds", "bottleneck", "total_usd")


def plan_sentence(files: Column, pages: Column, vision: Column, figures: Column, seconds: Column) -> Column:
    """One line about a planned batch."""
    parts = F.concat_ws(", ", F.concat(files.cast("string"), F.lit(" file(s)")), F.concat(pages.cast("string"), F.lit(" page(s)")), F.concat(vision.cast("string"), F.lit(" needing the vision model")), F.when(figures > 0, F.concat(figures.cast("string"), F.lit(" figure(s) to describe"))))
    time = F.when(seconds >= 60, F.concat(F.lit("~"), F.format_string("%.0f", seconds / 60), F.lit(" min of model time"))).otherwise("<1 min")
    return F.concat(F.lit("Plan: "), parts, F.lit(" ("), time, F.lit(")"))


def workers(configured: Column, model: Column) -> Column:
    """Files at a time: a local vision model serves one request, so one."""
    return F.when(is_local(model), 1).otherwise(F.greatest(F.lit(1), configured))


def loaded(installed: DataFrame, running: DataFrame) -> DataFrame:
    """installed (tag, ...) with loaded: whether the model is among the running ones (tag)."""
    return installed.join(running.select("tag", F.lit(True).alias("loaded")).distinct(), "tag", "left").withColumn("loaded", F.coalesce("loaded", F.lit(False)))


def capabilities(models: DataFrame) -> DataFrame:
    """(stage, models): what can read pages, describe figures and review, from models (model, vision, text), by name."""
    stages = F.array(F.when(F.col("vision") | (F.col("model") == "tesseract"), "ocr"), F.when(F.col("vision"), "figures"), F.when(F.col("text"), "review"))
    rows = models.select("model", F.explode(F.array_compact(stages)).alias("stage"))
    return rows.groupBy("stage").agg(F.array_sort(F.collect_set("model")).alias("models"))
