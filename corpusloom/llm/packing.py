"""Token-id output: documents packed into fixed-length rows by best-fit decreasing.

Texts become token ids (a public byte-level vocabulary, whose path is a parameter), each document
closed by an end mark.  Documents longer than a row are split, losing nothing.  Pieces, longest first, go into
the open row with the least room that still holds them; a segment tree over the possible
rooms finds it in a few steps.  Each packed row has its ids padded to the row length, the
cumulative lengths of its segments, positions that start anew with each segment, and which part
of which document each segment is.

Documents are dealt to stretches by a hash of id and text, so many that a stretch has about a million tokens, and
lie in a stretch in the order of their ids and hashes: the rows depend on the documents alone, not on how they are
partitioned.  Memory is bounded whatever a partition's size, as a stretch that grows beyond its share is packed in parts.

Nulls: a null text is empty and, like an empty text, becomes a segment with the end mark alone.
Null ids stay null in the list of ids.  Repeated rows are packed as often as they occur.  Ties: pieces of one length go in
the order of their documents, and of rows with the same room the one opened or filled last is taken.  Texts of any length are
split without loss.  Further columns aren't looked at.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small_batches, table, text_keys, trimmed

LENGTH = 2048
END = 50256
PAD = 50256
#: Tokens that are packed together, and bytes of text a token has about.
STRETCH = 1_000_000
TOKEN_BYTES = 4


class Rooms:
    """Segment tree over rooms 0 .. most: how many open rows have that room, and the least room that is enough."""

    def __init__(self, most: int):
        self.size = 1 << max(1, most.bit_length())
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the row with the least room of at least need; it is taken out."""
        i = need + self.size
        if not self.count[i]:
            # up to the first ancestor with something to the right, then down its left edge
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, row


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of item numbers: items by falling size, each into the fullest row that holds it."""
    rooms, rows = Rooms(length), []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[item])
        if found is None:
            found = (length, len(rows))
            rows.append([])
        room, row = found
        rows[row].append(item)
        if room > sizes[item]:
            rooms.add(room - sizes[item], row)
    return rows


@cache
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    return tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_ids(text: str | None, path: str) -> np.ndarray:
    return np.array(encoder(path).encode_ordinary(text or ""), np.uint32)


def packed_rows(ids: list[int | None], tokens: list[np.ndarray], length: int, pad: int) -> pa.RecordBatch:
    """One stretch of documents as packed rows."""
    pieces = [(d, s, min(s + length, len(t))) for d, t in enumerate(tokens) for s in range(0, len(t), length)]
    rows = best_fit([e - s for _, s, e in pieces], length)
    matrix = np.full((len(rows), length), pad, "<u4")
    positions = np.zeros((len(rows), length), "<u4")
    ends, docs, starts = [], [], []
    for r, items in enumerate(rows):
        at, cumulative = 0, [0]
        for d, s, e in (pieces[i] for i in items):
            matrix[r, at : at + e - s] = tokens[d][s:e]
            positions[r, at : at + e - s] = np.arange(e - s)
            at += e - s
            cumulative.append(at)
        ends.append(cumulative)
        docs.append([ids[pieces[i][0]] for i in items])
        starts.append([pieces[i][1] for i in items])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([m.tobytes() for m in matrix], pa.binary()), pa.array([p.tobytes() for p in positions], pa.binary()),
            pa.array(ends, pa.list_(pa.int32())), pa.array(docs, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64())),
        ],
        names=["ids", "positions", "cu_seqlens", "doc_ids", "starts"],
    )


SCHEMA = "ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, pad: int = PAD, stretch: int = STRETCH) -> DataFrame:
    """Packed rows of docs (doc_id, text).  ids and positions: length little-endian unsigned 32-bit integers."""
    where = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        held, last = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for place, doc, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if tokens and (place != last or held >= 2 * stretch):
                        yield from slices(packed_rows(ids, tokens, length, pad))
                        ids, tokens, held = [], [], 0
                    last = place
                    ids.append(doc)
                    tokens.append(np.append(token_ids(text, where), np.uint32(end)))
                    held += len(tokens[-1])
        if tokens:
            yield from slices(packed_rows(ids, tokens, length, pad))

    def slices(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, rows.num_rows, 512):
            yield rows.slice(at, 512)

    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    stretches = max(1, -(-size // (TOKEN_BYTES * stretch)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_keys())
    rows = rows.withColumn("stretch", F.pmod(F.xxhash64("doc_id", "_t1", "_t2"), F.lit(stretches)))
    rows = rows.repartition("stretch").sortWithinPartitions("stretch", "doc_id", "_t1", "_t2")
    return rows.select("stretch", "doc_id", "text").mapInArrow(trimmed(run), SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet files: the columns ids and positions are the rows of the matrices."""
    packed.write.mode("error").parquet(path)


PARTS = "part string, rows long, length long"


def write_binary(packed: DataFrame, folder: str) -> DataFrame:
    """Packed rows as plain arrays, and the parts that were written: (part, rows, length), also kept as folder/parts.

    A part has four files of little-endian unsigned 32-bit integers: NAME.ids and NAME.positions are matrices of rows by
    length, NAME.lengths has the cumulative lengths of all rows' segments one after the other, NAME.segments how many each
    row has.  Tasks write through the file system that the folder names, under names of their own; parts that the table
    doesn't list are leftovers of tasks that ran twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        name, rows, length = f"part-{uuid.uuid4().hex}", 0, 0
        system.create_dir(root, recursive=True)
        streams = {k: None for k in ("ids", "positions", "lengths", "segments")}
        for batch in batches:
            if not batch.num_rows:
                continue
            if streams["ids"] is None:
                streams = {k: system.open_output_stream(f"{root}/{name}.{k}") for k in streams}
            for kind in ("ids", "positions"):
                for cell in batch.column(batch.schema.get_field_index(kind)):
                    streams[kind].write(cell.as_buffer())
                    length = len(cell.as_buffer()) // 4
            ends = batch.column(batch.schema.get_field_index("cu_seqlens"))
            streams["lengths"].write(ends.flatten().to_numpy().astype("<u4").tobytes())
            streams["segments"].write((np.diff(ends.offsets.to_numpy()) - 1).astype("<u4").tobytes())
            rows += batch.num_rows
        for stream in streams.values():
            if stream is not None:
                stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([name] if rows else [], pa.string()), pa.array([rows] if rows else [], pa.int64()), pa.array([length] if rows else [], pa.int64())], names=["part", "rows", "length"])

    packed.mapInArrow(run, PARTS).write.mode("error").parquet(f"{folder}/parts")
    return packed.sparkSession.read.schema(PARTS).parquet(f"{folder}/parts")


def read_binary(folder: str, part: str, length: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(ids, positions, cumulative lengths by row) of one part of write_binary()."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)

    def numbers(kind: str) -> np.ndarray:
        with system.open_input_stream(f"{root}/{part}.{kind}") as f:
            return np.frombuffer(f.read(), "<u4")

    segments = numbers("segments").astype(np.int64)
    ends = np.split(numbers("lengths"), np.cumsum(segments + 1)[:-1])
    return numbers("ids").reshape(-1, length), numbers("positions").reshape(-1, length), ends


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """The packed rows, with digests in place of the matrices."""
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select(
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"), F.element_at("cu_seqlens", -1).alias("n_tokens"),
        F.size("doc_ids").alias("n_segments"), "cu_seqlens", "doc_ids", "starts",
    )
