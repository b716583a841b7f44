"""Suffix-array dedup: remove bytes covered by a long string that starts more than once in the corpus.

Suffixes that share length bytes must meet, but the corpus does not fit one suffix array.  So
strings of that length (windows) are dealt out by what they hold:

1. Each window has an anchor: the 32 bytes in it with the smallest hash.  Equal windows have equal
   anchors, so an anchor that occurs once in the corpus settles all its windows.
2. Around anchors that repeat, windows are split by their distance to the anchor, and the bytes that
   all windows of a part share are the part's key.  A key that occurs once is settled as well.
3. What is left goes through the suffix array, its transform and the interval expansion of suffix_array.py,
   which alone decide what repeats: one segment of each kind, weighted by its copies, so exact copies take the same
   way.  Neighbouring segments that are the only kind of their keys go in as one.  A key with very many different
   segments is dealt out again by single windows, told apart by two hashes; those go through the suffix array as well.

Texts are known by a 128-bit key of their bytes, so copies share their results.  Tables between the
phases are written to the shared checkpoint folder.

Nulls: a null text is empty.  Null ids, repeated rows, ties and further columns stay as they are; a repeated
row counts as another occurrence.  Texts shorter than the length
hold no window and are kept whole; texts of any length are read whole.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import discard, release, small_batches, stash, table, text_keys, trimmed
from corpusloom.llm.suffix_array import repeated_starts

LENGTH = 200
ANCHOR = 32
PARTS = 4
#: Bytes of text hashed at a time, bytes of segments in one suffix array, windows of neighbouring segments joined at most,
#: different segments of a key above which it is dealt out again.
STEP = 1 << 19
ARRAY_BYTES = 1 << 20
JOINED = 1 << 17
MOST_SEGMENTS = 20_000

_BASE, _OTHER_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size, both = max(n, STEP + (1 << 17)), []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any substring of a byte array, from running sums of a polynomial."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        self.up, self.down = _tables(len(data) + 1, base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def each(self, size: int) -> np.ndarray:
        """Of the size bytes at every position."""
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width neighbours."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def first_least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every width neighbours, the leftmost of equal ones.

    The place is carried in the low bits; where values differ in those bits only, the window is looked at again.
    """
    bits = int(len(x)).bit_length()
    low = np.uint64((1 << bits) - 1)
    best = (_least((x & ~low) | np.arange(len(x), dtype=np.uint64), width) & low).astype(np.int64)
    for i in np.flatnonzero(x[best] != _least(x, width)).tolist():
        best[i] = i + int(np.argmin(x[i : i + width]))

    return best


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, key, first window, windows, anchor's distance from the first window) for all anchors of the texts."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    begins = np.cumsum(sizes) - sizes
    hashed = Hashes(data).each(ANCHOR)
    best = first_least(hashed, length - ANCHOR + 1)
    edge = np.zeros(len(best) + 1, np.int64)
    some = sizes >= length
    edge[begins[some]] += 1
    np.add.at(edge, (begins + sizes - length + 1)[some], -1)
    window = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    best = best[window]
    new = np.ones(len(window), bool)
    new[1:] = (best[1:] != best[:-1]) | (window[1:] != window[:-1] + 1)
    run = np.flatnonzero(new)
    first, at = window[run], best[run]
    owner = np.searchsorted(begins, first, side="right") - 1
    return owner, hashed[at].view(np.int64), first - begins[owner], np.diff(np.append(run, len(window))), at - first


def split_parts(first: np.ndarray, windows: np.ndarray, distance: np.ndarray, width: int, length: int) -> tuple[np.ndarray, ...]:
    """Cut runs of windows into parts of width distances to the anchor.

    (run, first window, windows, distance of the first window, core's start and end): the core is what all
    windows at the part's distances share.
    """
    nearest = (distance - windows + 1) // width
    count = distance // width - nearest + 1
    run = np.repeat(np.arange(len(first)), count)
    part = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + nearest[run]
    place = first[run] + distance[run]  # of the anchor
    begin = np.maximum(first[run], place - (part + 1) * width + 1)
    end = np.minimum(first[run] + windows[run] - 1, place - part * width)
    return run, begin, end - begin + 1, place - begin, place - part * width, place - (part + 1) * width + 1 + length


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [b or b"" for b in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], names=list(columns))


def _find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = _numbers(batch, "_t1"), _numbers(batch, "_t2")
            _, index, times = np.unique(np.stack([t1, t2], axis=1), axis=0, return_index=True, return_counts=True)  # copies are looked at once
            texts = _texts(batch)
            group: list[int] = []
            total = 0
            for i in range(len(index)):
                group.append(i)
                total += len(texts[index[i]])
                if total >= STEP or i + 1 == len(index):
                    who = np.array(group)
                    owner, key, first, windows, distance = anchors([texts[index[g]] for g in group], length)
                    who = who[owner]
                    yield _batch(a=key, t1=t1[index[who]], t2=t2[index[who]], first=first.astype(np.int32), windows=windows.astype(np.int32), distance=distance.astype(np.int32), m=times[who].astype(np.int32))
                    group, total = [], 0

    return run


def _rows_of_equal(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """(row, copies) for runs of rows with one text; rows come sorted by text, so copies stand together."""
    t1, t2 = _numbers(batch, "_t1"), _numbers(batch, "_t2")
    new = np.ones(len(t1), bool)
    new[1:] = (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])
    run = np.flatnonzero(new)
    yield from zip(run.tolist(), np.diff(np.append(run, len(t1))).tolist(), strict=True)


def _structs(batch: pa.RecordBatch, name: str, row: int) -> list[np.ndarray]:
    """Fields of the structs in row's list."""
    column = batch.column(batch.schema.get_field_index(name))
    values = column.slice(row, 1).flatten()
    return [f.to_numpy(zero_copy_only=False) for f in values.flatten()]


def _find_parts(length: int):
    width = -(-(length - ANCHOR + 1) // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2, texts = _numbers(batch, "_t1"), _numbers(batch, "_t2"), _texts(batch)
            for row, copies in _rows_of_equal(batch):
                first, windows, distance = (x.astype(np.int64) for x in _structs(batch, "found", row))
                hashes = Hashes(np.frombuffer(texts[row], np.uint8))
                _, begin, count, far, core, core_end = split_parts(first, windows, distance, width, length)
                key = hashes.of(core, core_end) + (far // width).astype(np.uint64) * np.uint64(_BASE)
                shape = (far * 1024 + count).astype(np.uint64)
                segment = _mixed(hashes.of(begin, begin + count - 1 + length) + shape * np.uint64(_BASE))
                n = len(key)
                yield _batch(q=key.view(np.int64), sg=segment.view(np.int64), t1=np.full(n, t1[row]), t2=np.full(n, t2[row]), first=begin.astype(np.int32), windows=count.astype(np.int32), m=np.full(n, copies, np.int32))

    return run


def _joined(first: np.ndarray, windows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Places in the sorted segments of a text at which a new stretch begins: neighbours that are the only kind of their keys are one."""
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1] + windows[:-1]) | (kinds[1:] > 1) | (kinds[:-1] > 1) | (first[1:] // JOINED != first[:-1] // JOINED)
    return np.flatnonzero(new)


def _fetch(length: int):
    """Lists of segments with their texts -> rows for the suffix array: the bytes, and the segments (q, sg, at, windows) in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            for row, _ in _rows_of_equal(batch):
                found = _structs(batch, "found", row)
                by = np.argsort(found[3], kind="stable")
                q, sg, m, first, windows, kinds = (x[by] for x in found)
                first, windows = first.astype(np.int64), windows.astype(np.int64)
                new = _joined(first, windows, kinds)
                last = np.append(new[1:], len(q)) - 1
                data = [texts[row][f:e] for f, e in zip(first[new].tolist(), (first[last] + windows[last] - 1 + length).tolist(), strict=True)]
                at = first - np.repeat(first[new], np.diff(np.append(new, len(q))))
                inside = pa.StructArray.from_arrays([pa.array(q), pa.array(sg), pa.array(at), pa.array(windows)], ["q", "sg", "at", "windows"])
                yield _batch(q=q[new], sg=sg[new], m=np.minimum.reduceat(m, new), data=pa.array(data, pa.binary()), inside=pa.ListArray.from_arrays(pa.array(np.append(new, len(q)), pa.int32()), inside))

    return run


def _single_windows(length: int):
    """Each window of a segment by itself: its two hashes and its place in the text and in the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2, texts = _numbers(batch, "_t1"), _numbers(batch, "_t2"), _texts(batch)
            for row, _ in _rows_of_equal(batch):
                q, sg, m, first, windows, _ = _structs(batch, "found", row)
                data = np.frombuffer(texts[row], np.uint8)
                who = np.repeat(np.arange(len(q)), windows)
                at = np.arange(len(who)) - np.repeat(np.cumsum(windows) - windows, windows)
                start = first[who].astype(np.int64) + at
                one, other = (Hashes(data, base).of(start, start + length).view(np.int64) for base in (_BASE, _OTHER_BASE))
                n = len(who)
                yield _batch(w=one, w2=other, t1=np.full(n, t1[row]), t2=np.full(n, t2[row]), start=start.astype(np.int32), q=q[who], sg=sg[who], at=at.astype(np.int32), m=m[who])

    return run


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive numbers: (first, count)."""
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] != starts[:-1] + 1
    run = np.flatnonzero(new)
    return starts[run], np.diff(np.append(run, len(starts)))


def _expand(length: int):
    """Rows sorted by key -> ranges of repeated windows of each segment; keys are never split between two suffix arrays."""

    def ranges(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list({(r[0], r[1]): r for r in rows}.values())
        found = repeated_starts([r[3] for r in rows], np.array([r[2] for r in rows]), length)
        out: list[tuple[np.ndarray, ...]] = []
        for (_, _, _, _, inside), starts in zip(rows, found, strict=True):
            q, sg, at, windows = inside
            low, high = np.searchsorted(starts, at), np.searchsorted(starts, at + windows)
            whole = high - low == windows
            out.append((q[whole], sg[whole], np.zeros(int(whole.sum()), np.int64), windows[whole]))
            for i in np.flatnonzero(~whole & (high > low)).tolist():
                a, n = _ranges(starts[low[i] : high[i]] - at[i])
                out.append((np.full(len(a), q[i]), np.full(len(a), sg[i]), a, n))
        if out:
            q, sg, at, n = (np.concatenate(x) for x in zip(*out, strict=True))
            yield _batch(q=q, sg=sg, at=at.astype(np.int32), n=n.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            q, sg, m, data = (batch.column(i).to_pylist() for i in range(4))
            for i, key in enumerate(q):
                if size >= ARRAY_BYTES and key != rows[-1][0]:
                    yield from ranges(rows)
                    rows, size = [], 0
                rows.append((key, sg[i], m[i], data[i], _structs(batch, "inside", i)))
                size += len(data[i])
        if rows:
            yield from ranges(rows)

    return run


def _by_text(rows: DataFrame, fields: list[str], unique: bool) -> DataFrame:
    collect = F.collect_set if unique else F.collect_list
    return rows.groupBy("t1", "t2").agg(collect(F.struct(*fields)).alias("found"))


def _with_text(texts: DataFrame, found: DataFrame) -> DataFrame:
    """texts joined with lists of places, rows of one text together."""
    met = texts.join(found, (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2"))).select("_t1", "_t2", "text", "found")
    return met.sortWithinPartitions("_t1", "_t2")


def _expanded(texts: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """(q, sg, at, n): the ranges of repeated windows in segments open_ (q, sg, m, t1, t2, first, windows, kinds)."""
    rows = _with_text(texts, _by_text(open_, ["q", "sg", "m", "first", "windows", "kinds"], unique=False))
    rows = rows.mapInArrow(trimmed(_fetch(length)), "q long, sg long, m long, data binary, inside array<struct<q: long, sg: long, at: long, windows: long>>")
    return rows.repartition("q").sortWithinPartitions("q", "sg").mapInArrow(trimmed(_expand(length)), "q long, sg long, at int, n int")


def _open(segments: DataFrame) -> DataFrame:
    """The segments (q, sg, m, at) whose key occurs more than once, with the number of kinds of the key, written down.

    segments is written down too, and goes; so do the shuffles that led here.
    """
    segments = stash(segments.select("q", "sg", "m", "at"))
    release(segments.sparkSession)
    keys = stash(segments.groupBy("q").agg(F.sum("m").alias("total"), F.count("*").alias("kinds")).filter("total > 1").drop("total"))
    found = stash(segments.join(keys, "q").select("q", "sg", "m", "at.*", "kinds"))
    discard(segments, keys)
    release(found.sparkSession)
    return found


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(t1, t2, found: list of (first, n)): for texts with any, the runs of window starts that repeat in the corpus."""
    if length < 2 * ANCHOR:
        raise ValueError(f"strings of at least {2 * ANCHOR} bytes can be looked for")
    small_batches(docs.sparkSession)
    texts = docs.filter(F.octet_length("text") >= length).select(*text_keys(), "text")
    rows = stash(texts.mapInArrow(trimmed(_find_anchors(length)), "a long, t1 long, t2 long, first int, windows int, distance int, m int"))
    # written down, so that the join has a shuffle of its own on both sides and adaptive execution can split a hot key
    again = stash(rows.groupBy("a").agg(F.sum("m").alias("n")).filter("n > 1").select("a"))
    found = _by_text(rows.join(again, "a"), ["first", "windows", "distance"], unique=True)
    parts = stash(_with_text(texts, found).mapInArrow(trimmed(_find_parts(length)), "q long, sg long, t1 long, t2 long, first int, windows int, m int"))
    discard(rows, again)
    release(docs.sparkSession)

    open_ = _open(parts.groupBy("q", "sg").agg(F.sum("m").alias("m"), F.min(F.struct("t1", "t2", "first", "windows")).alias("at")))
    repeats = _expanded(texts, open_.filter(f"kinds <= {MOST_SEGMENTS}"), length)
    many = open_.filter(f"kinds > {MOST_SEGMENTS}")
    if many.limit(1).count():
        alone = _with_text(texts, _by_text(many, ["q", "sg", "m", "first", "windows", "kinds"], unique=False))
        alone = stash(alone.mapInArrow(trimmed(_single_windows(length)), "w long, w2 long, t1 long, t2 long, start int, q long, sg long, at int, m long"))
        single = alone.groupBy(F.col("w").alias("q"), F.col("w2").alias("sg")).agg(F.sum("m").alias("m"), F.min(F.struct("t1", "t2", F.col("start").alias("first"), F.lit(1).alias("windows"))).alias("at"))
        apart = _open(single)
        twice = stash(_expanded(texts, apart, length).select(F.col("q").alias("w"), F.col("sg").alias("w2")))
        discard(apart)
        repeats = repeats.unionByName(alone.join(twice, ["w", "w2"]).select("q", "sg", "at", F.lit(1).alias("n")).distinct())
    repeats = stash(repeats)
    discard(open_)
    release(docs.sparkSession)

    spans = parts.select("q", "sg", "t1", "t2", "first").join(repeats, ["q", "sg"])
    return _by_text(spans.select("t1", "t2", (F.col("first") + F.col("at")).alias("first"), "n"), ["first", "n"], unique=True)


def covered(first: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes (begin, end) covered by windows at first .. first + n - 1."""
    by = np.argsort(first, kind="stable")
    begin, end = first[by].astype(np.int64), np.maximum.accumulate((first + n - 1 + length)[by].astype(np.int64))
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    run = np.flatnonzero(new)
    return begin[run], end[np.append(run[1:], len(begin)) - 1]


def kept_bytes(data: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    out, at = [], 0
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        out.append(data[at:b])
        at = e
    return b"".join([*out, data[at:]])


def _partial_end(piece: bytes) -> int:
    """Bytes at the end of a piece that begin a character without ending it."""
    for back in range(1, min(3, len(piece)) + 1):
        b = piece[-back]
        if b & 0xC0 != 0x80:
            return back if back < (4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1) else 0
    return 0


def kept_characters(data: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    """kept_bytes without the parts of characters that a cut has left; everything away from the cuts stays."""
    out, at = [], 0
    for b, e in zip([*begin.tolist(), len(data)], [*end.tolist(), None], strict=True):
        start = at
        while at and start < min(b, at + 3) and data[start] & 0xC0 == 0x80:
            start += 1
        piece = data[start:b]
        out.append(piece[: len(piece) - (_partial_end(piece) if e is not None else 0)])
        at = e
    return b"".join(out)


def remove_repeats(docs: DataFrame, length: int = LENGTH, columns: tuple[str, ...] = ("doc_id",), characters: bool = False) -> DataFrame:
    """columns of every row of docs, with kept (the remaining bytes; with characters, only whole ones at the cuts), n_bytes, n_removed, n_spans and removed (list of (begin, end))."""
    found = repeated_spans(docs, length)
    rows = docs.select(*columns, *text_keys(), F.coalesce("text", F.lit("")).cast("binary").alias("_data"))
    met = rows.join(found, (rows["_t1"] == found["t1"]) & (rows["_t2"] == found["t2"]), "left").select(*columns, "_data", "found")
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts, has = _texts(batch, "_data"), batch.column(width + 1).is_valid().to_pylist()
                kept, removed, spans = [], [], []
                for row, data in enumerate(texts):
                    if has[row]:
                        begin, end = covered(*_structs(batch, "found", row), length)
                        kept.append((kept_characters if characters else kept_bytes)(data, begin, end))
                        spans.append([{"begin": b, "end": e} for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
                        removed.append(int((end - begin).sum()))
                    else:
                        kept.append(data)
                        spans.append([])
                        removed.append(0)
                out = {n: batch.column(i) for i, n in enumerate(columns)}
                yield _batch(**out, kept=pa.array(kept, pa.binary()), n_bytes=pa.array(map(len, texts), pa.int64()), n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(map(len, spans), pa.int64()), removed=pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))))

    span = T.StructType([T.StructField(n, T.LongType()) for n in ("begin", "end")])
    made = [T.StructField("kept", T.BinaryType()), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("removed", T.ArrayType(span))]
    return met.mapInArrow(trimmed(run), T.StructType([*[T.StructField(c, met.schema[c].dataType) for c in columns], *made]))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

#: The same by counting every string of 200 bytes: as hexadecimal text, two digits a byte.
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS k FROM (SELECT r, h, unnest(range(length(h) // 2 - {LENGTH - 1})) AS i FROM d)),
starts AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
fresh AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM starts),
runs AS (SELECT r, min(i) AS b, max(i) + {LENGTH} AS e FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM fresh) GROUP BY r, run),
sides AS (SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS before FROM runs),
kept AS (SELECT r, sum(e - b) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) || any_value(substr(h, 2 * last + 1)) AS rest
  FROM sides JOIN (SELECT r, max(e) AS last FROM runs GROUP BY r) USING (r) JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by counting every window; for tests."""
    from collections import Counter

    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out
