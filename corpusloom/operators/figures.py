"""Figures on pages, from drawing and text geometry: which rectangles are candidates, how they cluster, what a cluster must be.

Single tests are Columns and joins; the clustering, where a rectangle takes in what it touches and the result depends on the
order of drawing, runs page by page over Arrow batches.  A page's shapes are bounded by the page, not by the corpus.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, in points and shares: flat shapes, whole pages, sides of a figure, gaps that merge, reach of labels, prose blocks.
HAIRLINE, PAGE_SHARE, LEAST_SIDE, GAP, LABEL_REACH, PROSE_CHARS = 4.0, 0.85, 60.0, 12.0, 24.0, 40
#: Parts of a drawing, its wide and filled shares, its prose, figures of a page; tiny images.
LEAST_PARTS, WIDE, MOST_WIDE, MOST_FILLED, MOST_TEXT, MOST_CHARS, MOST_FIGURES, TINY = 2, 0.8, 0.3, 0.95, 0.45, 300, 6, 64


def width(prefix: str = "") -> Column:
    return F.col(f"{prefix}x1") - F.col(f"{prefix}x0")


def height(prefix: str = "") -> Column:
    return F.col(f"{prefix}y1") - F.col(f"{prefix}y0")


def is_hairline() -> Column:
    return (width() < HAIRLINE) | (height() < HAIRLINE)


def covers_page() -> Column:
    """For rows with the page's sides as page_w and page_h."""
    area = F.col("page_w") * F.col("page_h")
    return F.coalesce(F.when(area > 0, width() * height() / area > PAGE_SHARE), F.lit(False))


def is_tiny_image(w: Column, h: Column, least: int = TINY) -> Column:
    return (w < least) & (h < least)


def candidates(shapes: DataFrame) -> DataFrame:
    """Shapes (page, seq, kind: vector or raster, x0, y0, x1, y1, page_w, page_h, ...) that may belong to figures."""
    some = (width() > 0) & (height() > 0) & ~covers_page()
    vector = (F.col("kind") == "vector") & ~is_hairline()
    raster = (F.col("kind") == "raster") & (width() >= LEAST_SIDE) & (height() >= LEAST_SIDE)
    return shapes.filter(some & (vector | raster))


def text_coverage(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """regions (page, region, x0, y0, x1, y1) with covered (share of the area under prose) and chars (of prose inside, by share of block)."""
    prose = blocks.filter(F.length(F.trim("text")) >= PROSE_CHARS).select("page", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")], F.length(F.trim("text")).alias("n"))
    w = F.greatest(F.lit(0.0), F.least("x1", "b_x1") - F.greatest("x0", "b_x0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "b_y1") - F.greatest("y0", "b_y0"))
    met = regions.join(prose, "page").withColumn("over", w * h).filter("over > 0")
    share = F.least(F.lit(1.0), F.col("over") / (width("b_") * height("b_")))
    sums = met.groupBy("page", "region").agg(F.sum("over").alias("over"), F.sum(F.floor(F.col("n") * share)).alias("chars"))
    area = width() * height()
    full = regions.join(sums, ["page", "region"], "left")
    return full.withColumn("covered", F.when(area <= 0, 1.0).otherwise(F.coalesce("over", F.lit(0.0)) / area)).withColumn("chars", F.when(area <= 0, 0).otherwise(F.coalesce("chars", F.lit(0))).cast("long")).drop("over")


class Box(NamedTuple):
    x0: float
    y0: float
    x1: float
    y1: float

    def grown(self, by: float) -> Box:
        return Box(self.x0 - by, self.y0 - by, self.x1 + by, self.y1 + by)

    def meets(self, other: Box) -> bool:
        return min(self.x1, other.x1) > max(self.x0, other.x0) and min(self.y1, other.y1) > max(self.y0, other.y0)

    def joined(self, other: Box) -> Box:
        return Box(min(self.x0, other.x0), min(self.y0, other.y0), max(self.x1, other.x1), max(self.y1, other.y1))

    def overlap(self, other: Box) -> float:
        return max(0.0, min(self.x1, other.x1) - max(self.x0, other.x0)) * max(0.0, min(self.y1, other.y1) - max(self.y0, other.y0))

    @property
    def area(self) -> float:
        return max(0.0, self.x1 - self.x0) * max(0.0, self.y1 - self.y0)


def clusters(boxes: list[Box], gap: float = GAP) -> list[Box]:
    """Bounding boxes of what touches or comes within the gap, until nothing does any more."""
    settled, waiting = [], deque(boxes)
    while waiting:
        box = waiting.popleft()
        reach = box.grown(gap)
        near = [s for s in settled if s.meets(reach)]
        if near:
            # what is taken in may bring the box next to others: it is looked at again
            settled = [s for s in settled if s not in near]
            for s in near:
                box = box.joined(s)
            waiting.append(box)
        else:
            settled.append(box)
    return settled


def page_figures(vector: list[tuple[bool, Box]], raster: list[Box], texts: list[tuple[int, Box]], page: Box) -> list[tuple[Box, str]]:
    """(box, kind) of a page's figures in reading order; vector: (filled, Box) and raster in drawing order, texts: (characters, Box)."""
    whole = lambda b: page.area > 0 and b.area / page.area > PAGE_SHARE
    found: list[tuple[Box, str]] = []
    for box in clusters([b for _, b in vector]) if len(vector) >= LEAST_PARTS else ():
        if min(box.x1 - box.x0, box.y1 - box.y0) < LEAST_SIDE:
            continue
        parts = [(f, b) for f, b in vector if b.meets(box)]
        if len(parts) < LEAST_PARTS or whole(box):
            continue
        if sum(b.x1 - b.x0 >= WIDE * (page.x1 - page.x0) for _, b in parts) > MOST_WIDE * len(parts) or sum(f for f, _ in parts) > MOST_FILLED * len(parts):
            continue
        under = [(n, b, b.overlap(box)) for n, b in texts if n >= PROSE_CHARS and b.overlap(box) > 0]
        if sum(o for *_, o in under) > MOST_TEXT * box.area or sum(int(n * min(1.0, o / b.area)) for n, b, o in under) > MOST_CHARS:
            continue
        reach, grown = box.grown(LABEL_REACH), box
        for label in (b for n, b in texts if 0 < n < PROSE_CHARS and b.area > 0):
            if label.meets(reach) and not whole(grown.joined(label)):
                grown = grown.joined(label)
        found.append((grown, "vector"))
    for box in raster:
        host = next((i for i, (b, _) in enumerate(found) if b.meets(box) and not whole(b.joined(box))), None)
        if host is None:
            found.append((box, "raster"))
        else:
            found[host] = (found[host][0].joined(box), "mixed" if found[host][1] == "vector" else found[host][1])
    return sorted(found, key=lambda f: (round(f[0].y0, 1), round(f[0].x0, 1)))[:MOST_FIGURES]


#: Codes of what lies on a page, as pages are dealt out: plain and filled shapes, images, text blocks.
PLAIN, FILLED, IMAGE, TEXT = range(4)
#: What str.strip takes off, which is more than trim does.
_BLANK = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_BOX, _SIDES = ("x0", "y0", "x1", "y1"), ("page_w", "page_h")


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of figure_regions() from rows (page, code, n, box, sides) that come page by page; a page may go over several batches."""
    values = lambda c: c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist()
    rows = (row for batch in batches for row in zip(*map(values, batch.columns), strict=True))
    for key, of in groupby(rows, itemgetter(0)):
        vector, raster, texts, sides = [], [], [], None
        for _, code, n, x0, y0, x1, y1, w, h in of:
            if code == TEXT:
                texts.append((n, Box(x0, y0, x1, y1)))
                continue
            sides = sides or (w, h)
            if code == IMAGE:
                raster.append(Box(x0, y0, x1, y1))
            else:
                vector.append((code == FILLED, Box(x0, y0, x1, y1)))
        if raster or len(vector) >= LEAST_PARTS:
            for i, (b, kind) in enumerate(page_figures(vector, raster, texts, Box(0.0, 0.0, *sides)), 1):
                yield key, i, kind, *b


def figure_regions(shapes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page, index, kind, x0, y0, x1, y1) of every page's figures, from candidates() and text blocks (page, seq, text, x0, y0, x1, y1).

    Pages are dealt out whole.  Null texts count as blank; shapes and blocks go by seq, ties by kind, filling and box.
    """
    names = ("page", "index", "kind", *_BOX)
    types = (pa.int64(), pa.int32(), pa.string(), *[pa.float64()] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in _found(batches):
            rows.append(row)
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    page, box, nan = F.col("page").cast("long").alias("page"), [F.col(c).cast("double").alias(c) for c in _BOX], F.lit(float("nan"))
    code = F.when(F.col("kind") == "raster", IMAGE).when(F.col("filled"), FILLED).otherwise(PLAIN)
    drawn = candidates(shapes).select(page, code.alias("code"), F.lit(0).alias("n"), *box, *[F.coalesce(F.col(c).cast("double"), nan).alias(c) for c in _SIDES], F.col("seq").alias("shape"), F.lit(None).alias("block"))
    n = F.length(F.btrim("text", F.lit(_BLANK))).alias("n")
    # blank blocks and blocks without a place change nothing
    text = blocks.select(page, F.lit(TEXT).alias("code"), n, *box, *[nan.alias(c) for c in _SIDES], F.lit(None).alias("shape"), F.col("seq").alias("block")).filter(F.col("n") > 0).dropna(subset=list(_BOX))
    dealt = drawn.unionByName(text).repartition("page").sortWithinPartitions("page", F.col("code") == TEXT, F.asc_nulls_last("shape"), F.asc_nulls_last("block"), "code", *_BOX, "n")
    return dealt.select("page", "code", "n", *_BOX, *_SIDES).mapInArrow(run, "page long, index int, kind string, x0 double, y0 double, x1 double, y1 double")
