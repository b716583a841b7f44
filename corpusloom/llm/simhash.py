"""SimHash near-dedup with bit-sliced comparison.

Fingerprints of whole texts are compared in exact candidate buckets: the 64 bits are cut
into blocks, and two fingerprints within the radius agree on some set of blocks (pigeonhole),
so a bucket per set loses no link.  Inside a bucket, bit planes stand vertically (bit j of 64
fingerprints in one machine word), carry-save counters add the differing bits of 64 pairs at
once, and words all of whose lanes exceed the radius are abandoned.

Nulls: a null text has no words (fingerprint zero, linked like any other).  Null ids take part;
a component's id is the smallest id that is not null (null if there is none).  Repeated rows and
equal fingerprints are one class before anything is compared.  An empty table gives no rows.
Columns other than doc_id and text are not looked at.  Texts of any length are read whole; ties in doc_id
(several rows of the smallest id) leave keep_one() one row of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpoint, column_values, small_batches, text_keys, trimmed
from corpusloom.llm.components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Members of a bucket that one comparison block may hold; larger buckets are cut into a grid of blocks.
BLOCK = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text as an unsigned 64-bit integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() folds A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64, len(words) - k + 1)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The word whose bits are set in over half of h."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.array([fingerprint(t) for t in column_values(batch, "text")], np.uint64)
        keep = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "text"]
        names = [f.name for f in batch.schema if f.name != "text"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(fp.view(np.int64))], names=[*names, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, fp): the text's 128-bit key and its signed 64-bit fingerprint."""
    small_batches(docs.sparkSession)
    base = docs.select("doc_id", *text_keys(), "text")
    kind = dict(base.dtypes)["doc_id"]
    return base.mapInArrow(trimmed(_fingerprints), f"doc_id {kind}, _t1 long, _t2 long, fp long")


def block_sets(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """(blocks, blocks that must agree) for n fingerprints: more bits in a key as n grows.  Every choice is exact."""
    for need, most in ((1, 20_000), (2, 100_000_000), (3, 20_000_000_000)):
        if n <= most:
            return radius + need, need
    return radius + 4, 4


def masks(blocks: int, need: int) -> list[int]:
    """Bit masks, one per set of agreeing blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(one[i] for i in c) for c in combinations(range(blocks), need)]


def bit_planes(words: np.ndarray) -> np.ndarray:
    """uint64[64, ceil(n / 64)]: row j holds bit j of each word, 64 words to a lane word."""
    n = -(-len(words) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(words)] = words
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, radius: int = RADIUS, against=None) -> np.ndarray:
    """Lanes (packed like a plane) in which at most radius of the planes' bits are set.

    against: a fingerprint that every lane is compared with (its one bits turn their planes over), or a function
    (plane's number, lane words) -> words that the planes are compared with; the planes themselves stay as they are.
    Carry-save counters of three bits and a sticky overflow; every eighth plane, lane words
    in which every lane exceeds the radius are abandoned.
    """
    if radius > 6:
        raise ValueError("the three-bit counter holds a radius of up to 6")
    width = planes.shape[1]
    alive: np.ndarray | None = None
    ones, twos, fours, over = (np.zeros(width, np.uint64) for _ in range(4))
    for j in range(64):
        x = planes[j] if alive is None else planes[j, alive]
        if callable(against):
            x = x ^ against(j, alive)
        elif against is not None and int(against) >> j & 1:
            x = ~x
        c1 = ones & x
        ones = ones ^ x
        c2 = twos & c1
        twos = twos ^ c1
        over |= fours & c2
        fours = fours ^ c2
        if j % 8 == 7:
            live = _exceeds(ones, twos, fours, over, radius) != _ALL
            if not live.all():
                alive = np.flatnonzero(live) if alive is None else alive[live]
                ones, twos, fours, over = (y[live] for y in (ones, twos, fours, over))
                if not len(alive):
                    break
    out = np.zeros(width, np.uint64)
    out[slice(None) if alive is None else alive] = ~_exceeds(ones, twos, fours, over, radius)
    return out


def _exceeds(ones, twos, fours, over, radius: int) -> np.ndarray:
    """Lanes whose counter is above radius."""
    bits = (ones, twos, fours)
    more, equal = np.zeros_like(ones), np.full_like(ones, 0xFFFFFFFFFFFFFFFF)
    for b in (2, 1, 0):
        if radius >> b & 1:
            equal &= bits[b]
        else:
            more |= equal & bits[b]
            equal &= ~bits[b]
    return more | over


def _lanes(packed: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(packed.view(np.uint8), bitorder="little")[:n].astype(bool)


def star_links(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that span the components of one bucket: each member joins the one it was reached from.

    Every member is compared with those not reached yet, so a tight group of m costs about m comparisons.  The bucket's
    planes are stored once; reached lanes are masked out, and the planes are packed anew when half of them are.
    """
    left, links, queue = members, [], []
    planes = bit_planes(left)
    live = np.ones(len(left), bool)
    waiting, at_lane = len(left), 0
    while waiting or queue:
        if not queue:
            at_lane += int(np.argmax(live[at_lane:]))
            queue.append(left[at_lane])
            live[at_lane] = False
            waiting -= 1
        if not waiting:
            break
        at = queue.pop()
        near = np.flatnonzero(_lanes(within(planes, radius, at), len(left)) & live)
        if len(near):
            links += [(int(x), int(at)) for x in left[near]]
            queue += list(left[near])
            live[near] = False
            waiting -= len(near)
            if 2 * waiting < len(left) and len(left) > 64:
                left = left[live]
                planes, live, at_lane = bit_planes(left), np.ones(len(left), bool), 0
    return links


def pair_links(groups: list[np.ndarray], radius: int = RADIUS) -> np.ndarray:
    """All links inside many small buckets (up to 64 members), whose members stand side by side in the planes' lanes.

    Lane i meets lane i + s: the planes are compared with themselves moved on by s lanes, for every s that fits into a
    bucket.  Larger buckets come first, so the lanes that a distance s concerns are the first ones.
    """
    groups = sorted(groups, key=len, reverse=True)
    sizes = np.array([len(g) for g in groups])
    words = np.concatenate(groups)
    after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))  # members from here to the bucket's end
    planes = np.concatenate([bit_planes(words), np.zeros((64, 1), np.uint64)], axis=1)
    lanes = np.cumsum(sizes)
    found = []
    for s in range(1, int(sizes[0])):
        n = int(lanes[np.searchsorted(-sizes, -s) - 1])  # lanes of buckets with more than s members
        width = -(-n // 64)
        up, down = np.uint64(s), np.uint64(64 - s)

        def moved(j: int, alive: np.ndarray | None, width: int = width, up: np.uint64 = up, down: np.uint64 = down) -> np.ndarray:
            here, following = (planes[j, :width], planes[j, 1 : width + 1]) if alive is None else (planes[j, alive], planes[j, alive + 1])
            return here >> up | following << down

        near = np.flatnonzero(_lanes(within(planes[:, :width], radius, moved), n) & (after[:n] > s))
        found.append(np.stack([words[near], words[near + s]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.uint64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp) sorted by bucket -> links (a, b)."""
    rest_b, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(b: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        small, out, pairs = [], [], 0
        cuts = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]]) if len(b) else np.zeros(1, int)
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            members = np.unique(f[s:e]).view(np.uint64)
            if len(members) > 48:
                out += star_links(members)
            elif len(members) > 1:
                small.append(members)
                pairs += len(members) ** 2
            if small and (pairs > 1 << 20 or e == len(b)):
                out += pair_links(small).tolist()
                small, pairs = [], 0
        got = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    for batch in batches:
        b = np.concatenate([rest_b, batch.column(0).to_numpy(zero_copy_only=False)])
        f = np.concatenate([rest_f, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(b):
            continue
        cut = int(np.searchsorted(b != b[-1], False)) if (b[0] == b[-1]) else int(np.flatnonzero(b != b[-1])[-1]) + 1
        if cut:
            yield links(b[:cut], f[:cut])
        rest_b, rest_f = b[cut:], f[cut:]
    yield links(rest_b, rest_f)


def fingerprint_links(classes: DataFrame, n: int, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that span the components of the distinct fingerprints in column fp."""
    tables = masks(*block_sets(n, radius))
    signed = [m - (1 << 64) if m >> 63 else m for m in tables]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    rows = classes.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = rows.join(sizes, ["t", "key"])  # a fingerprint alone in its bucket has no one to meet
    # a bucket above the block size becomes a grid: part i meets part j in one block, for all i <= j
    parts = F.ceil(F.col("n") / block).cast("long")
    own = F.pmod(F.xxhash64("fp"), parts)
    grid = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda p: F.struct(F.least(own, p).alias("i"), F.greatest(own, p).alias("j")))
    met = met.withColumn("g", F.explode(F.when(F.col("n") <= block, F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))).otherwise(grid)))
    met = met.select(F.xxhash64("t", "key", "g.i", "g.j").alias("bucket"), "fp")
    return met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_compare), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, _t1, _t2, fp, root, component_id) for every row of docs; root is the component's smallest fingerprint."""
    prints = checkpoint(fingerprints(docs))
    classes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    nodes = connected_components(fingerprint_links(classes, classes.count(), radius))
    rooted = classes.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    # written down, so that the join has a shuffle of its own on both sides and a component with many members splits
    ids = checkpoint(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    rooted = checkpoint(rooted.join(ids, "root").select("fp", "root", "component_id"))
    return prints.join(rooted, "fp")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without near-duplicates: of each component one row with the smallest id stays, with all its columns."""
    found = near_duplicates(docs, radius)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "_t1", "_t2")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("_id"), F.col("k._t1").alias("_k1"), F.col("k._t2").alias("_k2"))
    # the row travels as one struct, so no column of docs can clash with those added here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *text_keys(), F.col("doc_id").alias("_own"))
    rows = rows.join(kept, (rows._t1 == kept._k1) & (rows._t2 == kept._k2) & rows._own.eqNullSafe(kept._id), "left_semi")
    order = Window.partitionBy("_t1", "_t2", "_own").orderBy(F.lit(1))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("_row.*")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: doc_id, fingerprint as 16 hex digits, component_id."""
    from corpusloom.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
