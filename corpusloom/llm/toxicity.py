"""Toxicity: a convolutional text classifier in numpy.

Words are hashed to embeddings, each with its beginnings and ends; filters of several widths slide over a text, each keeps its
largest value in the text, and a logistic layer reads those.  Words seen in few training texts
share one embedding, so rare words can't be learnt by heart.  Convolution is linear, so for scoring
every (embedding, filter tap) product is tabulated once and a text costs gathers, sums and a maximum.

Thresholds are calibrated by language on training rows that fitting has not used.  The language is
told from the text by its function words, never read from a column; a score is the logit moved so
that its language's threshold comes to 0.7.

Fitting takes a bounded sample of labelled rows, chosen by a hash of the id, to one executor; the
fitted model (a few MB at most) is shared with the scoring tasks.  Scoring sees every row.

Nulls: null and empty texts are scored like a text without words.  Null labels don't teach, nor do rows
with a null id; the query's held_out is false for them, as their remainder is null.  Repeated rows score alike, ties in
the sample's order go by id, text and label,
texts of any length are scored whole, further columns are carried by score(), an empty table gives
no rows.  With labels of one class only, every score is that class's share, smoothed.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name, small_batches, table, trimmed

BUCKETS = 1 << 15
#: Buckets of a word at most: itself, six beginnings, two ends.
PARTS = 9
DIMENSIONS = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Labelled rows and bytes of text that fitting takes at most, and training texts a word must be in to have its own embedding.
SAMPLE = 6000
SAMPLE_BYTES = 192 << 20
LEAST_TEXTS = 3
STEPS = 1000
BATCH = 64
SCALE = 0.6
#: Words a worker remembers between batches.
REMEMBERED = 120_000
SEED = 4
DECISION = 0.7

#: Common function words by language, for telling the language of a text.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on with as be by this are from at or an not have which",
    "fr": "le la les de des du et un une en dans que qui pour est par sur au aux avec ce ne pas elle il",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an",
    "es": "el la los las de del y en que un una por con para es se no al lo su como más o pero sus",
}
LANGUAGES = (*FUNCTION_WORDS, "other")

_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and bytes above ASCII."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


def parts_of(word: bytes) -> list[int]:
    """Buckets of a word and of its beginnings and ends: inflected and compounded words share their stems' buckets."""
    crc, n = zlib.crc32, len(word)
    out = [crc(word) % (BUCKETS - 2) + 2]
    out += [crc(word[:k], k) % (BUCKETS - 2) + 2 for k in range(3, min(n, 9))]
    out += [crc(word[-k:], 64 + k) % (BUCKETS - 2) + 2 for k in (4, 6) if k < n]
    return out


class Words(dict):
    """Word -> row number; new words get the next one (row 0 is padding)."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        self.new.append(word)
        return n


def part_table(listed: list[bytes]) -> np.ndarray:
    """uint16[words, PARTS]: every word's buckets, filled up with 0; a stretch at a time, as lists of numbers are large."""
    out = np.zeros((len(listed), PARTS), np.uint16)
    for at in range(0, len(listed), 4096):
        rows = [parts_of(w) for w in listed[at : at + 4096]]
        out[at : at + len(rows)] = [r + [0] * (PARTS - len(r)) for r in rows]
    return out


@cache
def function_words() -> dict[bytes, int]:
    """Word -> bits of the languages that have it."""
    out: dict[bytes, int] = {}
    for i, listed in enumerate(FUNCTION_WORDS.values()):
        for w in listed.split():
            out[w.encode()] = out.get(w.encode(), 0) | 1 << i
    return out


def sequences(texts: list[str | None], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words as row numbers, each text followed by the padding the widest filter needs, and where each begins."""
    pad = [0] * max(WIDTHS)
    row: list[int] = []
    begins = []
    for t in texts:
        begins.append(len(row))
        row += map(known.__getitem__, words(t))
        row += pad
    return np.array(row, np.int32), np.array(begins, np.int64)


def crossing(begins: np.ndarray, n: int, width: int) -> np.ndarray:
    """Places whose filter of this width would reach into the next text: the last ones of each text's padding."""
    ends = np.append(begins[1:], n)
    return (ends[:, None] - np.arange(1, width)[None, :]).ravel()


class Model:
    """Parameters: embedding E, filters W[width] (width, DIMENSIONS, FILTERS), their offsets, output layer, thresholds by language."""

    def __init__(self, **parts: np.ndarray):
        self.parts = parts
        self.known = Words()
        self.taps: np.ndarray | None = None

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **self.parts)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as z:
            return Model(**{k: z[k] for k in z.files})

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words as rows of self.taps: every filter tap's product with the word's embedding, then its languages' votes."""
        p = self.parts
        if self.taps is None or len(self.known) > REMEMBERED:
            self.known = Words()
            self.buckets = (p["E"][p["own"]] @ np.concatenate([p[f"W{w}"][k] for w in WIDTHS for k in range(w)], axis=1)).astype(np.float32)
            self.taps = np.zeros((1, self.buckets.shape[1] + len(FUNCTION_WORDS)), np.float32)
        row, begins = sequences(texts, self.known)
        if new := self.known.new:
            found = part_table(new)
            taps = np.concatenate([self.buckets[found[i : i + 2048]].sum(axis=1) for i in range(0, len(new), 2048)])
            taps *= (SCALE / np.sqrt((found > 0).sum(axis=1)))[:, None]
            bits = np.array([function_words().get(w, 0) for w in new])
            votes = bits[:, None] >> np.arange(len(FUNCTION_WORDS)) & 1
            need, filled = len(self.known) + 1, len(self.known) + 1 - len(new)
            if need > len(self.taps):
                self.taps = np.concatenate([self.taps, np.zeros((max(need, 2 * len(self.taps)) - len(self.taps), self.taps.shape[1]), np.float32)])
            self.taps[filled:need] = np.concatenate([taps, votes], axis=1)
            self.known.new = []
        return row, begins

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logit of each text, and its language as an index into LANGUAGES: most function words; "other" if there are none."""
        p, (row, begins) = self.parts, self.rows(texts)
        out, at = [], 0
        for w in WIDTHS:
            total = self.taps[:, at : at + FILTERS][row]
            for k in range(1, w):
                total[:-k] += self.taps[:, at + k * FILTERS : at + (k + 1) * FILTERS][row[k:]]
            at += w * FILTERS
            total[crossing(begins, len(row), w)] = -np.inf
            out.append(np.maximum.reduceat(total, begins, axis=0))
        votes = np.add.reduceat(self.taps[:, at:][row], begins, axis=0)
        lang = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(FUNCTION_WORDS))
        # summed row by row, not by a matrix product, whose rounding would hang on the other texts of the batch
        return (np.maximum(np.concatenate(out, axis=1) + p["b"], 0) * p["v"]).sum(axis=1) + p["c"], lang

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z, lang = self.logits(texts)
        moved = z - self.parts["thresholds"][lang] + np.log(DECISION / (1 - DECISION))
        return 1 / (1 + np.exp(-np.clip(moved.astype(np.float64), -40, 40)))


def fit(texts: list[str | None], labels: np.ndarray, seed: int = SEED) -> Model:
    """Fit on four fifths of the texts, calibrate thresholds on the rest."""
    rng = np.random.default_rng(seed)
    known = Words()
    row, begins = sequences(texts, known)
    docs = [d[: len(d) - max(WIDTHS)] for d in np.split(row, begins[1:])] if len(texts) else []
    held = np.arange(len(docs)) % 5 == 0 if len(docs) >= 50 else np.zeros(len(docs), bool)
    found = part_table(known.new)
    # a bucket counts once a text; buckets of few texts share row 1 of the embedding
    seen = np.zeros(BUCKETS, np.int64)
    for d in (d for d, h in zip(docs, held, strict=True) if not h and len(d)):
        seen[np.unique(found[np.unique(d) - 1])] += 1
    own = np.arange(BUCKETS)
    own[seen < LEAST_TEXTS] = 1
    own[0] = 0
    p: dict[str, np.ndarray] = {"own": own, "E": rng.normal(0, 0.3, (BUCKETS, DIMENSIONS)).astype(np.float32)}
    for w in WIDTHS:
        p[f"W{w}"] = rng.normal(0, 0.4, (w, DIMENSIONS, FILTERS)).astype(np.float32)
    n_features = FILTERS * len(WIDTHS)
    p["b"], p["v"], p["c"] = np.zeros(n_features, np.float32), rng.normal(0, 0.2, n_features).astype(np.float32), np.zeros(1, np.float32)
    p["thresholds"] = np.zeros(len(LANGUAGES), np.float32)
    if not 0 < labels.sum() < len(labels):
        share = (labels.sum() + 1) / (len(labels) + 2)
        p["v"][:] = 0
        p["c"][:] = np.log(share / (1 - share))
        p["thresholds"][:] = np.log(DECISION / (1 - DECISION))
        return Model(**p)

    # word -> its buckets; bucket 0 stays zero
    table_ = np.zeros((len(found) + 1, PARTS), np.uint16)
    table_[1:] = own[found]
    scale = np.ones(len(found) + 1, np.float32)
    scale[1:] = SCALE / np.sqrt((found > 0).sum(axis=1))
    del found
    p["E"][0] = 0
    classes = [np.flatnonzero(~held & (labels == y)) for y in (0, 1)]
    if not all(map(len, classes)):
        classes = [np.flatnonzero(~held)] * 2
    adam = {k: (np.zeros_like(p[k]), np.zeros_like(p[k])) for k in p if p[k].dtype == np.float32 and k != "thresholds"}
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(c, BATCH // 2) for c in classes])  # both classes alike; thresholds are calibrated below
        for k, g in _gradients(p, [docs[i] for i in pick], labels[pick], table_, scale).items():
            m, v = adam[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p[k] -= 0.02 * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    model = Model(**p)
    check = held if held.any() else ~held
    z, lang = model.logits([t for t, h in zip(texts, check, strict=True) if h])
    p["thresholds"] = thresholds(z, lang, labels[check]).astype(np.float32)
    return Model(**p)


def _gradients(p: dict[str, np.ndarray], docs: list[np.ndarray], y: np.ndarray, table_: np.ndarray, scale: np.ndarray) -> dict[str, np.ndarray]:
    pad = np.zeros(max(WIDTHS), np.int32)
    row = np.concatenate([x for d in docs for x in (d, pad)])
    sizes = np.array([len(d) + len(pad) for d in docs])
    begins = np.cumsum(sizes) - sizes
    used, place_of = np.unique(row, return_inverse=True)
    e = (p["E"][table_[used]].sum(axis=1) * scale[used][:, None])[place_of]
    longer = np.concatenate([e, np.zeros((max(WIDTHS), DIMENSIONS), np.float32)])
    best, tops = [], []
    for w in WIDTHS:
        value = sum(longer[k : k + len(e)] @ p[f"W{w}"][k] for k in range(w))
        value[crossing(begins, len(e), w)] = -np.inf
        top = np.maximum.reduceat(value, begins, axis=0)
        place = np.where(value == np.repeat(top, sizes, axis=0), np.arange(len(e))[:, None], len(e))
        best.append(np.minimum.reduceat(place, begins, axis=0))  # the first place of each maximum
        tops.append(top)
    pooled = np.concatenate(tops, axis=1) + p["b"]
    active = np.maximum(pooled, 0)
    z = active @ p["v"] + p["c"]
    dz = ((1 / (1 + np.exp(-z)) - y) / len(docs)).astype(np.float32)
    out = {"v": active.T @ dz + 1e-4 * p["v"], "c": dz.sum(keepdims=True)}
    dp = dz[:, None] * p["v"] * (pooled > 0)
    out["b"] = dp.sum(axis=0)
    ge, longer_row = np.zeros_like(p["E"]), np.concatenate([row, pad])
    for i, w in enumerate(WIDTHS):
        d, g = dp[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(p[f"W{w}"])
        for k in range(w):
            at = best[i] + k
            g[k] = np.einsum("nfd,nf->df", longer[at], d)
            word = longer_row[at].ravel()
            de = (d[:, :, None] * p[f"W{w}"][k].T[None]).reshape(-1, DIMENSIONS) * scale[word][:, None]
            np.add.at(ge, table_[word], de[:, None, :])
        out[f"W{w}"] = g + 1e-4 * p[f"W{w}"]
    ge[0] = 0
    out["E"] = ge
    return out


def thresholds(z: np.ndarray, lang: np.ndarray, y: np.ndarray, least: int = 8) -> np.ndarray:
    """By language, the logit that parts the classes with the fewest weighted errors; few examples fall back to all languages'."""

    def best(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(z)
        z, y = z[order], y[order]
        missed = np.concatenate([[0], np.cumsum(y)])  # toxic below the cut
        false = (1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y)])
        cost = missed + false
        good = np.flatnonzero(cost == cost.min())
        i = good[len(good) // 2]
        low, high = (z[i - 1] if i else z[0] - 1), (z[i] if i < len(z) else z[-1] + 1)
        return float(low + high) / 2

    out = np.full(len(LANGUAGES), best(z, y) if 0 < y.sum() < len(y) else 0.0)
    for i in range(len(LANGUAGES)):
        mine = lang == i
        if min(y[mine].sum(), (1 - y[mine]).sum()) >= least:
            out[i] = best(z[mine], y[mine])
    return out


@lru_cache(maxsize=1)
def _model(data: bytes) -> Model:
    return Model.from_bytes(data)


def forget() -> None:
    """Let go of the words remembered by this worker."""
    _model.cache_clear()


def train(docs: DataFrame, labels: DataFrame, target: str, fitter: Callable[[list, np.ndarray], bytes], sample: int = SAMPLE) -> bytes:
    """Fit in one task on at most sample labelled rows; labels: doc_id and target.  Rows are chosen by a hash of the id."""
    small_batches(docs.sparkSession)
    labels = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(target).alias("label"))
    chosen = labels.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "label").limit(sample)
    # the sample is bounded by its row count, so its side may be broadcast to the documents
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "text", "label").limit(2 * sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str | None] = []
        y: list[int] = []
        room = SAMPLE_BYTES
        for b in batches:
            for text, label in zip(*(c.to_pylist() for c in b.columns), strict=True):
                room -= len((text or "").encode("utf-8", "surrogatepass"))
                if room >= 0:  # whole texts, until the first that would go beyond the bound
                    texts.append(text)
                    y.append(label)
        yield pa.RecordBatch.from_arrays([pa.array([fitter(texts, np.array(y, np.int64))], pa.binary())], names=["model"])

    got = rows.select("text", "label").coalesce(1).mapInArrow(trimmed(run), "model binary").collect()
    return bytes(got[0][0]) if got else fitter([], np.zeros(0, np.int64))


def _fit_bytes(texts: list[str | None], labels: np.ndarray) -> bytes:
    return fit(texts, labels).to_bytes()


def score(docs: DataFrame, model: bytes, scorer: Callable[[bytes, list], np.ndarray] | None = None, name: str = "score") -> DataFrame:
    """docs with the score as a column of that name, which docs must not have; every other column is carried through."""
    if free_name(docs, name) != name:
        raise ValueError(f"docs has a column {name} of its own: name the score otherwise")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorer = scorer or (lambda data, texts: _model(data).scores(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scored(batches)
        finally:
            forget()  # workers outlive tasks, and memory is theirs and the other stages'

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer(shared.value, part.column(at).to_pylist()), pa.float64())], names=[*part.schema.names, name])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(trimmed(run), f"{fields}, `{name}` double")


def remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def toxic_model(spark, sf_dir: str) -> bytes:
    labels = table(spark, sf_dir, "labels").filter(remainder(3) != 1)
    return train(table(spark, sf_dir, "documents"), labels, "toxic", _fit_bytes)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, toxic_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"))
