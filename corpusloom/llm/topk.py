"""Exact top-k search by inner product.

Vectors are rotated by the right singular vectors of the whole table (from its second-moment matrix, summed
on the executors), so the leading coordinates carry most of every product.  A block of candidates is gone
through by descending length: products are added up a few coordinates at a time, after each step the
Cauchy-Schwarz bound on the rest (the lengths of both remainders) drops candidates that cannot reach a
query's k-th best, and a query stops at the first candidate whose length times the query's is too small.
Survivors are scored exactly in integers.

Before blocks are copied, each query has a floor: the k-th best of a fixed number of the table's longest
vectors and of a fixed number of others.  Floor by query length is how long a candidate must be to matter;
queries are put into blocks by that length, and a block of candidates goes to those query blocks only that its
longest vector can reach.  Pairs of blocks meet by an equi-join on both numbers, so no task holds more than one
block of each and no number is hot; the best k of each pair are merged by a partial top-k.

Every row is a query or a candidate of its own: repeated ids are separate rows, and a query leaves out
its own row only.  Vectors that are null, empty, or hold null or non-finite components take no part.  Shorter
vectors count as filled up with zeros.  Zero vectors take part, and so do null ids (as candidates: vec_id null;
as queries where the condition says so).  Ties go to the smaller id, null last.  Components stop at the range of
long integers.  Products below 2**53 are summed as doubles, which is exact; larger ones as whole numbers
without limit, and a score stops at the range of long integers.  Further columns aren't looked at; an empty
table, or one without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpoint, table

K = 5
SCALE = 256
#: Rows of a candidate block and of a query block, rows looked at together, coordinates added at a time.
ROWS = 8192
QUERIES = 4096
STRIP = 1024
STEP = 16
#: Ranges that lengths are cut into, vectors besides the longest that set the first floors.
RANGES = 64
PROBES = 2048
EXACT = 2.0**53
_LAST = np.iinfo(np.int64).max


def usable(embedding: str = "embedding") -> Column:
    e = F.col(embedding)
    return e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v: array of whole doubles): floor(scale * x), x as double."""
    rows = vectors.filter(usable())
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column, size: int) -> np.ndarray:
    """(rows, size) from a list column, shorter vectors filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == size).all():
        return flat.reshape(len(column), size)
    out = np.zeros((len(column), size))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def second_moments(rows: DataFrame, size: int, fold: int = 32) -> np.ndarray:
    """Sum of x xT over all rows: a packed matrix per task, added up in two steps; one matrix reaches the driver."""

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            x = _matrix(b.column(0), size)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size)
        for b in batches:
            for m in b.column(0):
                total += np.frombuffer(m.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = rows.select("v").mapInArrow(of_rows, "m binary")
    got = parts.repartition(fold).mapInArrow(added, "m binary").coalesce(1).mapInArrow(added, "m binary").collect()
    return sum(np.frombuffer(r[0]) for r in got).reshape(size, size)


def rotation(moments: np.ndarray) -> np.ndarray:
    """Right singular vectors, largest singular value first."""
    values, vectors = np.linalg.eigh(moments)
    return vectors[:, np.argsort(-values)]


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as int64; those that doubles can't hold are summed without limit and stop at the range."""
    far = np.sqrt((q * q).sum(axis=1).max(initial=0)) * np.sqrt((x * x).sum(axis=1).max(initial=0))
    if far < EXACT / 2:
        return (q @ x.T).astype(np.int64)
    out = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    return np.clip(out, -_LAST - 1, _LAST).astype(np.int64)


def best_in_block(q_rows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query's place, candidate's row, id, score) of each query's best k in a block; floor: what a score must reach."""
    x_len = np.sqrt((x * x).sum(axis=1))
    order = np.argsort(-x_len, kind="stable")
    rows, ids, x, x_len = rows[order], ids[order], x[order], x_len[order]
    qr, xr = q @ turn, x @ turn
    q_len = np.sqrt((q * q).sum(axis=1))
    slack = 1e-9 * (1 + q_len.max(initial=0) * x_len.max(initial=0)) + 0.25  # scores are whole numbers: rounding never drops an equal one
    cuts = range(0, q.shape[1], STEP)
    q_rest = [np.sqrt(np.maximum(0, (qr[:, c + STEP :] ** 2).sum(axis=1))) for c in cuts]
    x_rest = [np.sqrt(np.maximum(0, (xr[:, c + STEP :] ** 2).sum(axis=1))) for c in cuts]
    need = floor.astype(np.float64).copy()
    best = np.full((len(q), k), -_LAST - 1, np.int64)
    best_ids, best_rows = np.full((len(q), k), _LAST), np.full((len(q), k), -1, np.int64)
    for at in range(0, len(x), STRIP):
        end = min(at + STRIP, len(x))
        live = np.flatnonzero(q_len * x_len[at] + slack >= need)  # x_len[at] is the longest from here on
        if not len(live):
            break
        # partial sums, a few coordinates at a time; candidates and queries whose bounds all fall short go
        part = np.zeros((len(live), end - at))
        keep = np.arange(end - at)
        for i, c in enumerate(cuts):
            part += qr[live, c : c + STEP] @ xr[at:end][keep, c : c + STEP].T
            good = part + q_rest[i][live][:, None] * x_rest[i][at:end][keep][None, :] + slack >= need[live][:, None]
            among, columns = good.any(axis=1), good.any(axis=0)
            if not among.all() or not columns.all():
                part, live, keep = part[np.ix_(among, columns)], live[among], keep[columns]
            if not len(live):
                break
        if not len(live):
            continue
        exact = exact_scores(q[live], x[at:end][keep])
        names = np.broadcast_to(rows[at:end][keep], exact.shape)
        taken = names != q_rows[live][:, None]
        exact = np.where(taken, exact, -_LAST - 1)
        scores = np.concatenate([best[live], exact], axis=1)
        found = np.concatenate([best_ids[live], np.broadcast_to(ids[at:end][keep], exact.shape)], axis=1)
        whose = np.concatenate([best_rows[live], np.where(taken, names, -1)], axis=1)
        by = np.lexsort((whose, found, whose < 0, ~scores), axis=1)[:, :k]
        best[live], best_ids[live], best_rows[live] = (np.take_along_axis(y, by, 1) for y in (scores, found, whose))
        need = np.maximum(need, np.where(best_rows[:, -1] >= 0, best[:, -1], -np.inf))
    real = best_rows >= 0
    return np.nonzero(real)[0], best_rows[real], best_ids[real], best[real]


def _ranges(rows: DataFrame, value: Column, n: int, per_block: int) -> tuple[Column, dict[int, int]]:
    """(range number of a row, blocks of each range): ranges of equal counts of falling value, at most RANGES."""
    wanted = min(RANGES, max(1, -(-n // per_block)))
    marks = rows.select(value.alias("l")).approxQuantile("l", [i / wanted for i in range(1, wanted)], 0.001) if wanted > 1 else []
    place = F.lit(0)
    for m in sorted(set(marks)):
        place = place + (value < m).cast("int")
    counts = {r[0]: r[1] for r in rows.groupBy(place.alias("p")).count().collect()}  # a row a range
    return place, {p: -(-c // per_block) for p, c in counts.items()}


def top_k(vectors: DataFrame, asked: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, v) that asked selects, its k best of all other rows."""
    rows = checkpoint(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").withColumn("row", F.monotonically_increasing_id()))
    spark = rows.sparkSession
    n, size = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], result)
    turn = rotation(second_moments(rows, size))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    longest = rows.orderBy(length.desc(), "row").limit(64 * k)
    probes = longest.unionByName(rows.orderBy(F.xxhash64(F.lit(6), "row"), "row").limit(PROBES)).distinct().collect()  # a fixed number of rows
    probe_rows, probe = np.array([r["row"] for r in probes]), np.array([[*r["v"], *[0.0] * (size - len(r["v"]))] for r in probes])

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                own, q = part.column(0).to_numpy(), _matrix(part.column(2), size)
                known = np.where(probe_rows[None, :] == own[:, None], -np.inf, q @ probe.T)
                q_len = np.sqrt((q * q).sum(axis=1))
                # a double product may be off in its last places: a floor is never above the true k-th best
                floor = np.sort(known, axis=1)[:, -k] - 1e-9 * (1 + q_len * np.abs(probe).max(initial=0) * size) if known.shape[1] >= k else np.full(len(q), -np.inf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(floor <= 0.25, 0.0, np.where(q_len > 0, (floor - 0.25) / q_len * (1 - 1e-6), 0.0))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(floor), pa.array(reach)], names=["row", "vec_id", "v", "floor", "reach"])

    queries = checkpoint(rows.filter(asked).select("row", "vec_id", "v").mapInArrow(floors, "row long, vec_id long, v array<double>, floor double, reach double"))
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], result)
    # queries by falling reach: the last ranges take every candidate, the first only long ones
    q_place, q_blocks = _ranges(queries, F.col("reach"), n_queries, QUERIES)
    queries = queries.withColumn("range", q_place)
    queries = queries.withColumn("qblock", F.col("range") * (1 << 32) + F.pmod(F.xxhash64("row"), F.element_at(F.create_map(*[F.lit(x) for p in q_blocks.items() for x in p]), F.col("range"))))
    least = {r[0]: r[1] for r in queries.groupBy("range").agg(F.min("reach")).collect()}  # a row a range
    c_place, c_blocks = _ranges(rows, length, n, ROWS)
    candidates = rows.withColumn("_p", c_place).withColumn("cblock", F.col("_p") * (1 << 32) + F.pmod(F.xxhash64("row"), F.element_at(F.create_map(*[F.lit(x) for p in c_blocks.items() for x in p]), F.col("_p"))))
    reached = candidates.groupBy("cblock").agg(F.max(length).alias("longest"))
    none = F.array().cast("array<long>")
    wanted = F.concat(*[F.when(F.col("longest") >= least[p], F.sequence(F.lit(p << 32).cast("long"), F.lit((p << 32) + m - 1).cast("long"))).otherwise(none) for p, m in sorted(q_blocks.items())])
    # (cblock, qblock): the pairs of blocks that can hold a result; one row for thousands of vectors
    pairs = checkpoint(reached.select("cblock", F.explode(wanted).alias("qblock")))
    left = candidates.join(pairs, "cblock").select("cblock", "qblock", "row", "vec_id", "v")
    right = queries.join(pairs.withColumnRenamed("qblock", "_q"), F.col("qblock") == F.col("_q")).select("cblock", "qblock", "row", "vec_id", "v", "floor")

    def meet(met: pa.Table, asking: pa.Table) -> pa.Table:
        out = []
        if met.num_rows and asking.num_rows:
            q_rows, rows_ = asking["row"].to_numpy(), met["row"].to_numpy()
            ids = met["vec_id"].combine_chunks()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            filled = ids.fill_null(_LAST).to_numpy()
            at, row, found, score = best_in_block(q_rows, _matrix(asking["v"], size), rows_, filled, _matrix(met["v"], size), turn, k, asking["floor"].to_numpy())
            nulls = np.isin(row, rows_[~known])
            out = [pa.array(q_rows[at]), asking["vec_id"].combine_chunks().take(pa.array(at)), pa.array(found, mask=nulls), pa.array(score)]
        return pa.table(out or [[], [], [], []], schema=pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    partial = left.groupBy("cblock", "qblock").cogroup(right.groupBy("cblock", "qblock")).applyInArrow(meet, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH good AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), filled AS (
  SELECT vec_id, n, list_resize(v, (SELECT max(len(v)) FROM good), 0.0) AS v FROM good
), pairs AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM filled q JOIN filled c ON q.vec_id % 50 = 0 AND q.n <> c.n
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
