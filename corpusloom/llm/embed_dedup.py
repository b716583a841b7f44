"""Embedding near-dedup by collision-counting projections.

Equal vectors of a label are one class with a weight.  Classes are dealt to blocks by the signs of a
few random projections, in several tables, so that a pair at the threshold meets in one of them with the
same high probability whatever the label's size; each label has signs and tables of its own.  In a block, unit
vectors are sorted along many more random lines.  A window centred on a query along each line collides with what
lies near it.  The block is swept in the order of its widest line, in bands that a pair at the threshold leaves with
a probability of 6e-5; inside a band collisions are counted line by line, and pairs that can't reach the wanted count
any more are dropped half-way.  That count is the largest one that pairs at the threshold reach with the target
recall (binomial); pairs that reach it are verified by their cosine.

A block above its size is cut into a grid of parts, every two of which meet once.  A pair that shares
several tables counts in the first.  Blocks give link counts and spanning links; components are joined
afterwards, so no list of pairs exists anywhere.

Vectors that are null, zero, or hold null or non-finite components, and rows without label, link with
nothing: n_links 0, their own component, kept.  Repeated rows link with each other.  A null id takes
part but can't name a component (component_id is the smallest id that isn't null).  Vectors of a label
with different sizes don't link.  Ties in id: every row with the component's id is kept.  Further columns, whatever
their names, aren't looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpoint, discard, stash, table
from corpusloom.llm.components import connected_components
from corpusloom.llm.topk import usable

THRESHOLD = 0.98
#: Rows of a block (and of a grid part), signs in a key at least, lines, those after which hopeless pairs go, half a window and half
#: a band in deviations of a pair at the threshold, recalls aimed at.
BLOCK = 2048
LEAST_SIGNS = 4
LINES = 24
DENSE = 12
WINDOW = 2.0
BAND = 4.0
LINE_RECALL = 0.9995
TABLE_RECALL = 0.997
SEED = 8


def needed_collisions(lines: int = LINES, window: float = WINDOW, recall: float = LINE_RECALL) -> int:
    """Collisions that a pair at the threshold reaches with at least this probability."""
    p, total = math.erf(window / math.sqrt(2)), 0.0
    for c in range(lines, 0, -1):
        total += math.comb(lines, c) * p**c * (1 - p) ** (lines - c)
        if total >= recall:
            return c
    return 1


def signs_for(classes: Column) -> Column:
    """Signs in a label's keys, for a label of so many classes: buckets of an even spread hold a block."""
    return F.greatest(F.lit(LEAST_SIGNS), F.ceil(F.log2(classes / BLOCK))).cast("int")


def tables_for(signs: int, threshold: float = THRESHOLD) -> int:
    """Tables in which a pair at the threshold meets with the target recall."""
    meet = (1 - math.acos(threshold) / math.pi) ** signs
    return math.ceil(math.log(1 - TABLE_RECALL) / math.log(1 - meet))


def directions(n: int, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng([SEED, seed, size]).standard_normal((n, size))


def collisions(lines: np.ndarray, half: float, band: float, part: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, k) that collide on enough lines; part: only pairs of different parts count."""
    n, need = len(lines), needed_collisions()
    wide = int(np.argmax(lines.std(axis=0)))
    by = np.argsort(lines[:, wide], kind="stable")
    lines = lines[by]
    narrow = np.uint16 if n < 60000 else np.int64
    rank, low, high = (np.empty(lines.shape, narrow) for _ in range(3))
    for j in range(LINES):
        order = np.argsort(lines[:, j], kind="stable")
        rank[order, j] = np.arange(n)
        along = lines[order, j]
        low[:, j] = np.searchsorted(along, lines[:, j] - half, side="left")
        high[:, j] = np.searchsorted(along, lines[:, j] + half, side="right")
    reach = np.searchsorted(lines[:, wide], lines[:, wide] + band, side="right")
    at = 0
    while at < n:
        end = min(n, at + max(1, (1 << 21) // max(1, int(reach[at]) - at)))
        far = int(reach[end - 1])
        count = np.zeros((end - at, far - at), np.uint8)
        for j in range(DENSE):
            # rank within [low, high): one comparison, as unsigned differences wrap
            count += (rank[None, at:far, j] - low[at:end, None, j]).astype(narrow) < (high[at:end, None, j] - low[at:end, None, j])
        i, k = np.nonzero(count >= need - (LINES - DENSE))
        total = count[i, k].astype(np.int64)
        i, k = i + at, k + at
        keep = (i < k) & (lines[k, wide] - lines[i, wide] <= band)
        if part is not None:
            keep &= part[by[i]] != part[by[k]]
        i, k, total = i[keep], k[keep], total[keep]
        for j in range(DENSE, LINES):
            total += (rank[k, j] >= low[i, j]) & (rank[k, j] < high[i, j])
            keep = total >= need - (LINES - 1 - j)
            i, k, total = i[keep], k[keep], total[keep]
        yield by[i], by[k]
        at = end


def block_links(x: np.ndarray, weight: np.ndarray, codes: np.ndarray, part: np.ndarray, at: int, cross: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each row's links in this block, root of each row): pairs of the block whose cosine reaches the threshold.

    codes: each row's key in every table, at: this block's table; cross: only pairs of different parts count.
    """
    n = len(x)
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    lines = (x / length[:, None]) @ directions(LINES, x.shape[1], 1).T
    spread = math.sqrt(2 - 2 * threshold)
    root, links = np.arange(n), np.zeros(n, np.int64)
    firsts, seconds = [], []
    for i, k in collisions(lines, WINDOW * spread, BAND * spread, part if cross else None):
        if at and len(i):
            fresh = ~(codes[i, :at] == codes[k, :at]).any(axis=1)  # a pair counts in the first table it shares
            i, k = i[fresh], k[fresh]
        for a in range(0, len(i), 1 << 16):
            p, q = i[a : a + (1 << 16)], k[a : a + (1 << 16)]
            near = np.einsum("ij,ij->i", x[p], x[q]) / (length[p] * length[q]) >= threshold
            p, q = p[near], q[near]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            firsts.append(p.astype(np.int32))
            seconds.append(q.astype(np.int32))
    if firsts:
        p, q = np.concatenate(firsts), np.concatenate(seconds)
        while True:  # smallest row reachable, by rounds of hooking and shortcuts
            a, b = root[p], root[q]
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    return links, root


def _vectors(batch: pa.RecordBatch, name: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """All components of a list column, and where each row's begin (and the last one's end)."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])


#: Columns that name a block: label and size, table, key, parts of the grid.
NAMES = ("l", "t", "key", "i", "j")


def _blocks(threshold: float):
    """Rows (block's names, c, weight, part, keys, embedding) sorted by block -> (c, links, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        last = None

        def out() -> pa.RecordBatch:
            c, weight, part, codes, x = (np.concatenate(y) for y in zip(*held, strict=True))
            held.clear()
            _, t, _, i, j = last
            links, root = block_links(x, weight, codes, part, int(t), i != j, threshold)
            some = (links > 0) | (root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(c[some]), pa.array(links[some]), pa.array(c[root][some])], names=["c", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([column_numbers(batch, n) for n in NAMES], axis=1)
            c, weight, part = (column_numbers(batch, n) for n in ("c", "weight", "part"))
            (x, at), (codes, code_at) = _vectors(batch), _vectors(batch, "keys")
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if last is not None and held and tuple(names[s]) != last:
                    yield out()
                last = tuple(names[s])
                held.append((c[s:e], weight[s:e], part[s:e], codes[code_at[s] : code_at[e]].reshape(e - s, -1), x[at[s] : at[e]].reshape(e - s, -1)))
        if held:
            yield out()

    return run


def column_numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def keys(x: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """(rows, tables): the signs of each table's projections as a number."""
    bits = (x @ directions(signs * tables, x.shape[1], 2).T >= 0).reshape(len(x), tables, signs)
    return bits @ (1 << np.arange(signs, dtype=np.int64))


def _table_keys(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, at), signs = _vectors(batch), column_numbers(batch, "signs")
            found: list[list[int]] = [[]] * batch.num_rows
            sizes = np.diff(at)
            for size, s in {*zip(sizes.tolist(), signs.tolist(), strict=True)}:
                mine = np.flatnonzero((sizes == size) & (signs == s))
                for row, k in zip(mine.tolist(), keys(x[at[mine][:, None] + np.arange(size)], s, tables_for(s, threshold)).tolist(), strict=True):
                    found[row] = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    return run


def linked(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label)."""
    nonzero = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding", "label", F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(7), "label", "embedding").alias("h2"), F.coalesce(usable() & nonzero & F.col("label").isNotNull(), F.lit(False)).alias("ok"))
    classes = rows.filter("ok").groupBy("h1", "h2").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first_id"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    classes = stash(classes.withColumns({"c": F.monotonically_increasing_id(), "size": F.size("embedding")}))
    labels = stash(classes.groupBy("label", "size").agg(signs_for(F.count("*")).alias("signs")).withColumn("l", F.monotonically_increasing_id()))
    mine = classes.join(labels, ["label", "size"]).select("l", "signs", "c", "weight", "embedding")
    keyed = stash(mine.mapInArrow(_table_keys(threshold), ", ".join(f"{n} {t}" for n, t in mine.dtypes) + ", keys array<long>"))
    # written down, so that the join has a shuffle of its own on both sides and adaptive execution can split a hot bucket
    buckets = stash(keyed.select("l", F.posexplode("keys").alias("t", "key")).groupBy("l", "t", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    met = keyed.select("l", "c", "weight", "embedding", "keys", F.posexplode("keys").alias("t", "key")).join(buckets, ["l", "t", "key"])
    n_parts = F.ceil(F.col("n") / (2 * BLOCK)).cast("long")
    met = met.withColumn("part", F.pmod(F.xxhash64("c"), n_parts))
    grid = F.transform(F.sequence(F.lit(0).cast("long"), n_parts - 1), lambda p: F.struct(F.least("part", p).alias("i"), F.greatest("part", p).alias("j")))
    met = met.withColumn("g", F.explode(grid)).select("l", "t", "key", "g.i", "g.j", "c", "weight", "part", "keys", "embedding")
    parts = stash(met.repartition(*NAMES).sortWithinPartitions(*NAMES, "c").mapInArrow(_blocks(threshold), "c long, links long, root long"))
    discard(keyed, buckets, labels)
    links = parts.groupBy("c").agg(F.sum("links").alias("links"))
    roots = connected_components(parts.select(F.col("c").alias("a"), F.col("root").alias("b")))
    named = classes.select("h1", "h2", "c", "weight", "first_id").join(links, "c", "left").join(roots.withColumnRenamed("node", "c"), "c", "left")
    named = checkpoint(named.select("h1", "h2", "first_id", F.coalesce("root", "c").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    ids = checkpoint(named.groupBy("root").agg(F.min("first_id").alias("id")))
    named = named.join(ids, "root").select("h1", "h2", "n_links", "id", F.lit(True).alias("ok"))
    met = rows.select("vec_id", "h1", "h2", "ok").join(named, ["h1", "h2", "ok"], "left")
    component = F.when(F.col("ok"), F.col("id")).otherwise(F.col("vec_id"))
    return met.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op8_embed_dedup(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))


#: Every pair of a label compared; equal to the search where that finds all pairs, as it does on small tables.
OP8_SQL = f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
    coalesce(label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings
), good AS (SELECT r, vec_id, label, len(e) AS size, list_resize(e, (SELECT max(len(e)) FROM v WHERE ok), 0.0) AS e FROM v WHERE ok),
links AS (SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND a.size = b.size AND a.r <> b.r WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= {THRESHOLD}),
reach(a, b) AS (SELECT r, r FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
counted AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN named USING (r) LEFT JOIN counted USING (r)
"""
