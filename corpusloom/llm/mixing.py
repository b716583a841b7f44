"""Mixing sources to target weights.

Each source's words stand in one long row (documents in a hashed order), cut into blocks of a
fixed number of words: 64, and fewer for a source of under 128 * 64 words, so that every target can be
met to about a hundredth.  Words left over go to the first blocks, one each.  The mix is a number of output shards of a fixed number of slots.  Each
shard draws a multinomial count of slots for every source, with the sources' open slots as weights, so
that the last shard ends on the targets.  Shards are drawn in stretches: a first draw deals the slots of
whole stretches, and the shards of each stretch are then drawn in a task of their own.  Slot i of
a source is mapped through a pseudorandom permutation of that source's block indices (a
Feistel network over index bits, a new key per pass), and slots meet blocks by a join on the
index.  A pass uses each block once; targets stop at three times the source, so no block, and no
document, is used more than three times.

Nulls: a null text has size 0.  A null source is a source of its own and comes last.  Repeated
rows are laid out one after the other and may be taken differently; the rows as a whole agree
between runs.  Null ids take part.  Documents of size 0 are returned with nothing taken; empty sources
have target 0.  Texts of any length are counted and cut whole.  Ties (equal ids, equal texts) stay in the order
of their hashes.  An empty table gives no rows.  Other columns are not looked at (documents_of() carries
the documents' own).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import WORD_PATTERN, checkpoint, table, text_keys

#: Words in a block at most, blocks that a source should have, slots in an output shard, shards of a stretch, passes over a source at most, seed of every draw.
BLOCK = 64
LEAST_BLOCKS = 128
SHARD = 8192
STRETCH = 1024
PASSES = 3
SEED = 20
#: Rows that one bucket of the running totals should hold, copies of a row that are laid out together and cut together.
BUCKET_ROWS = 1000
COPIES = 4096
TAKEN_TOGETHER = 64


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, rank, source_size) from rows (source, size): ranks from 0 by code point, null last.

    The sources are sorted over as many tasks as there are partitions; a row's rank is its place in its partition and
    the rows of the partitions before.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = by_source.orderBy(F.col("source").isNull(), "source").withColumn("_id", F.monotonically_increasing_id())
    ordered = checkpoint(ordered.select("source", "source_size", F.shiftright("_id", 33).alias("_p"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_i")))
    counts = sorted((r[0], r[1]) for r in ordered.groupBy("_p").count().collect())  # a row for each partition
    before, offsets = 0, []
    for part, n in counts:
        offsets += [F.lit(part), F.lit(before)]
        before += n
    rank = F.col("_i") + (F.element_at(F.create_map(*offsets), F.col("_p")) if offsets else F.lit(0))
    return ordered.select("source", rank.cast("long").alias("rank"), "source_size")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = PASSES) -> DataFrame:
    """(source, rank, source_size, target) from rows (source, size).

    Weights go round by the sources' order (code points, null last).  A target stops at most times
    its source's size and the excess is reshared by weight until none is above: each round stops the
    sources whose share is too large and raises the level for the others, a sum over all sources.
    """
    rows = ranked_sources(sizes)
    rows = rows.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    room = F.col("source_size") * most
    total, level, stopped = rows.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        # a source that has stopped stays so: the level only rises
        full = F.col("w") * level >= room
        n, taken, w = rows.agg(F.count_if(full), F.sum(F.when(full, room)), F.sum(F.when(~full, F.col("w")))).first()
        if n == stopped or not w:
            break
        stopped, level = n, (total - (taken or 0)) / w
    return rows.select("source", "rank", "source_size", F.least(room.cast("double"), F.col("w") * level).alias("target"))


def laid_out(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows (doc_id, source, size, t1, t2, rank, ...) with copy, and start: the words before it in its source's row.

    Equal rows are one group with a number of copies, cut into bundles; running totals go by buckets, so neither a hot
    source nor a hot document meets in one task.
    """
    buckets = max(1, n_rows // BUCKET_ROWS)
    same = [c for c in rows.columns]
    rows = rows.groupBy(*same).agg(F.count("*").alias("_all"))
    rows = rows.withColumn("bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_all") - 1) / COPIES))))
    rows = rows.withColumn("copies", F.least(F.lit(COPIES), F.col("_all") - F.col("bundle") * COPIES)).drop("_all")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "_t1", "_t2", "bundle"), F.lit(buckets)))
    words = F.col("size") * F.col("copies")
    totals = rows.groupBy("rank", "bucket").agg(F.sum(words).alias("words"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("rank", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("rank", "bucket").orderBy("_t1", "_t2", "doc_id", "size", "bundle").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(totals, ["rank", "bucket"])
    rows = rows.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    start = F.col("offset") + F.col("inside") + F.col("_c") * F.col("size")
    return rows.withColumns({"start": start, "copy": F.col("bundle") * COPIES + F.col("_c")}).drop("copies", "bucket", "bundle", "offset", "inside", "_c")


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1, applied to index: four Feistel rounds, walked until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([SEED, key]).integers(1, 1 << 63, 4, dtype=np.uint64)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(31)) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def draw(rng: np.random.Generator, open_: np.ndarray, slots: int) -> np.ndarray:
    """How many of so many slots each source fills: a multinomial draw by the open slots; what is above them is drawn again."""
    if slots >= open_.sum():
        return open_.copy()
    out = np.zeros(len(open_), np.int64)
    while (short := slots - int(out.sum())) > 0:
        left = open_ - out
        out = np.minimum(out + rng.multinomial(short, left / left.sum()), open_)
    return out


def stretch_draws(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(stretch, ranks, n_blocks, firsts, counts): for every stretch of shards the first slot and the slots of each source.

    plan: (rank, n_slots, n_blocks), a row a source, read by one task: as many numbers as there are sources and stretches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*([c.to_numpy() for c in b.columns] for b in batches), strict=True)]
        if not columns:
            return
        order = np.argsort(columns[0])
        ranks, open_, blocks = (c[order].astype(np.int64) for c in columns)
        first, stretch, rng = np.zeros(len(ranks), np.int64), 0, np.random.default_rng([seed, 0])
        while open_.sum() > 0:
            n = draw(rng, open_, STRETCH * SHARD)
            yield pa.RecordBatch.from_arrays([pa.array([stretch], pa.int64()), *[pa.array([c.tolist()], pa.list_(pa.int64())) for c in (ranks, blocks, first, n)]], names=["stretch", "ranks", "n_blocks", "firsts", "counts"])
            open_, first, stretch = open_ - n, first + n, stretch + 1

    return plan.select("rank", "n_slots", "n_blocks").coalesce(1).mapInArrow(run, "stretch long, ranks array<long>, n_blocks array<long>, firsts array<long>, counts array<long>")


def shard_draws(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(rank, n_blocks, shard, first, n): the slots that each source fills in each shard, a multinomial draw a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stretch, ranks, blocks, first, open_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ranks, blocks, first, open_ = (np.array(x, np.int64) for x in (ranks, blocks, first, open_))
                rng, shard = np.random.default_rng([seed, 1, stretch]), stretch * STRETCH
                while open_.sum() > 0:
                    n = draw(rng, open_, SHARD)
                    some = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (ranks, blocks, np.full(len(n), shard, np.int64), first, n)], names=["rank", "n_blocks", "shard", "first", "n"])
                    open_, first, shard = open_ - n, first + n, shard + 1

    return stretch_draws(plan, seed).repartition("stretch").mapInArrow(run, "rank long, n_blocks long, shard long, first long, n long")


def drawn_blocks(draws: DataFrame) -> DataFrame:
    """(rank, shard, slot, pass, block): every slot with the block it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rank, blocks, shard, first, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slot = np.arange(first, first + n)
                turn, index = np.divmod(slot, blocks)
                for t in np.unique(turn):
                    index[turn == t] = permuted(index[turn == t], blocks, rank * 1000 + int(t))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, rank)), pa.array(np.full(n, shard)), pa.array(slot), pa.array(turn), pa.array(index)], names=["rank", "shard", "slot", "pass", "block"])

    return draws.repartition("rank", "shard").mapInArrow(run, "rank long, shard long, slot long, pass long, block long")


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per stretch of a document and block it lies in: the document's keys, from and to (its own words), times (the block's slots in the mix)."""
    sized = checkpoint(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *text_keys()))
    widest = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / LEAST_BLOCKS)))
    goals = targets(sized).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / widest)).cast("long"))
    # the first "wider" blocks have a word more than width
    goals = checkpoint(goals.withColumn("width", F.expr("source_size div n_blocks")).withColumn("wider", F.col("source_size") - F.col("n_blocks") * F.col("width")))
    n_rows = sized.count()
    n_blocks = F.col("n_blocks")
    # blocks to take: the target in blocks of the source's mean length, never more than the passes hold
    slots = F.least(F.round(F.col("target") * n_blocks / F.col("source_size")).cast("long"), n_blocks * PASSES)
    plan = goals.filter("source_size > 0").select("rank", "n_blocks", slots.alias("n_slots"))
    times = drawn_blocks(shard_draws(plan)).groupBy("rank", "block").agg(F.count("*").alias("times"))
    known = sized.join(goals, sized.source.eqNullSafe(goals.source)).drop(goals.source)
    rows = laid_out(known, n_rows)
    rows = rows.withColumn("last", F.greatest(F.col("start"), F.col("start") + F.col("size") - 1))
    block_of = lambda at: F.expr(f"if({at} < wider * (width + 1), {at} div (width + 1), wider + ({at} - wider * (width + 1)) div greatest(width, 1L))")
    rows = rows.withColumn("block", F.explode(F.sequence(block_of("start"), block_of("last"))))
    # the planner sees the drawn blocks come from a few rows and would broadcast them; they grow with the corpus
    met = rows.join(times.hint("merge"), ["rank", "block"], "left")
    begin = F.col("block") * F.col("width") + F.least("block", "wider") - F.col("start")
    end = begin + F.col("width") + (F.col("block") < F.col("wider")).cast("long")
    return met.select("doc_id", "_t1", "_t2", "source", "rank", "copy", "start", "size", "source_size", "target", F.greatest(F.lit(0), begin).alias("from"), F.least(F.col("size"), end).alias("to"), F.coalesce("times", F.lit(0)).alias("times"))


def taken_words(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs."""
    keys = ["rank", "start", "doc_id", "_t1", "_t2", "copy", "size", "source_size", "target"]
    return mix(docs).groupBy(*keys).agg(F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


_WORD = re.compile(WORD_PATTERN)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of [from, to) spans with the white space inside each; neighbouring spans are one, others are joined by a line end."""
    joined: list[list[int]] = []
    for s, e in sorted(spans):
        if joined and joined[-1][1] == s:
            joined[-1][1] = e
        elif e > s:
            joined.append([s, e])
    places = [m.span() for m in _WORD.finditer(text)]
    if len(joined) == 1 and joined[0] == [0, len(places)]:
        return text
    return "\n".join(text[places[s][0] : places[e - 1][1]] for s, e in joined)


def documents_of(docs: DataFrame) -> DataFrame:
    """The mix as documents, with all columns of docs: for each pass a row with the words that the pass takes of the document."""
    pieces = mix(docs).filter("times > 0 and to > from").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    spans = pieces.groupBy("doc_id", "_t1", "_t2", "source", "copy", "turn").agg(F.collect_list(F.struct(F.col("from").alias("f"), F.col("to").alias("t"))).alias("spans"))
    # a row of a repeated document holds the takes of so many of its copies
    per_doc = spans.groupBy("doc_id", "_t1", "_t2", "source", F.floor(F.col("copy") / TAKEN_TOGETHER).alias("part")).agg(F.collect_list("spans").alias("takes")).drop("part")
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    # the other columns travel as one struct, so none of them can clash with those added here
    keyed = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), *text_keys())
    one = Window.partitionBy("_t1", "_t2", "doc_id", "source").orderBy(F.lit(1))
    keyed = keyed.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    p = per_doc.select(*[F.col(c).alias(f"p{c}") for c in per_doc.columns])
    met = keyed.join(p, (F.col("_t1") == F.col("p_t1")) & (F.col("_t2") == F.col("p_t2")) & F.col("doc_id").eqNullSafe(F.col("pdoc_id")) & F.col("source").eqNullSafe(F.col("psource")))
    made = T.StructType([met.schema["_row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, takes = part.column(1).to_pylist(), part.column(2).to_pylist()
                rows, out = [], []
                for i, (text, ways) in enumerate(zip(texts, takes, strict=True)):
                    for way in ways:
                        rows.append(i)
                        out.append(cut_words(text or "", [(x["f"], x["t"]) for x in way]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["_row", "text", "n_chars"])

    mixed = met.select("_row", "text", "ptakes").mapInArrow(run, made)
    return mixed.select(*[F.col(f"_row.`{c}`") if c in rest else F.col(c) for c in docs.columns])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))
