"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

A text becomes a row of statistics (lengths, shares of character classes, repetition, function words),
each put through a logarithm, standardised and clipped.  Both classes get a mean and a covariance shrunk
towards the pooled diagonal, by the amount that does best on rows put aside.  The score comes from the
difference of the two Mahalanobis log-densities, with the covariances' Cholesky factors inverted once,
through a logistic curve fitted to the rows put aside.

Fitting takes a bounded sample of labelled rows; scoring sees every row and whole texts.

Nulls: null and empty texts have all-zero counts and get that row's score.  Null labels don't teach.
A null id never teaches, and held_out is false for it.  Repeated rows score alike, ties in the sample's order go
by id, text and label, texts of any length are scored whole, further columns are
carried through, an empty table gives no rows.  With labels of one class only, every score is that
class's share, smoothed.
"""

from __future__ import annotations

import io
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.llm.toxicity import function_words, remainder, score, train

SAMPLE = 8000
DECISION = 0.3
CLIP = 4.0
SHRINKAGES = (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)

#: Character classes by byte.
_CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".?;:",
    "comma": b",",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@^~+=<>_\\/`{}[]",
    "quote": b"\"'()-",
    "wide": bytes(range(128, 256)),
    "control": bytes([*range(0, 9), *range(14, 32), 127]),
}
_MATRIX = np.zeros((256, len(_CLASSES)), np.float64)
for _i, _c in enumerate(_CLASSES.values()):
    _MATRIX[list(_c), _i] = 1


def statistics(text: str | None) -> np.ndarray:
    """The text's row of transformed statistics."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _MATRIX / max(n, 1)
    words = data.lower().split()
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    different = set(words)
    known = function_words()
    common = sum(map(known.__contains__, words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_words, n_lines = max(len(words), 1), max(len(lines), 1)
    plain = sum(map(bytes.isalpha, different)) / max(len(different), 1)
    extra = [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), np.log1p(sizes.mean()), np.log1p(sizes.std()), np.log1p(sizes.max()),
        _logit(len(different) / n_words, n_words), _logit(common / n_words, n_words), _logit(len(set(lines)) / n_lines, n_lines),
        _logit(plain, len(different)), np.log1p(n / n_lines), np.log1p(max(map(len, lines), default=0)),
    ]
    return np.concatenate([np.log(share + 1e-3), extra])


def _logit(share: float, n: int) -> float:
    share = (share * n + 0.5) / (n + 1)
    return float(np.log(share / (1 - share)))


class Model:
    """Standardisation, class means, inverted Cholesky factors and log-determinants, logistic curve."""

    def __init__(self, **parts: np.ndarray):
        self.parts = parts

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **self.parts)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as z:
            return Model(**{k: z[k] for k in z.files})

    def differences(self, rows: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        p = self.parts
        x = np.clip((rows - p["mean"]) / p["spread"], -CLIP, CLIP)
        out = np.zeros(len(x))
        for c, sign in ((1, 1), (0, -1)):
            y = (x - p["centres"][c]) @ p["whiten"][c].T
            out += sign * (-0.5 * np.einsum("ij,ij->i", y, y) - p["half_logdet"][c])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        d = self.differences(np.stack([statistics(t) for t in texts]))
        a, b = self.parts["curve"]
        return 1 / (1 + np.exp(-np.clip(a * d + b, -40, 40)))


def fit(texts: list[str | None], labels: np.ndarray) -> Model:
    rows = np.stack([statistics(t) for t in texts]) if texts else np.zeros((0, len(statistics(""))))
    d = rows.shape[1]
    if min(labels.sum(), len(labels) - labels.sum()) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(mean=np.zeros(d), spread=np.ones(d), centres=np.zeros((2, d)), whiten=np.stack([np.eye(d)] * 2), half_logdet=np.zeros(2), curve=np.array([0.0, np.log(share / (1 - share))]))
    aside = np.arange(len(rows)) % 4 == 0
    if len(rows) < 40 or min(labels[~aside].sum(), (1 - labels[~aside]).sum()) < 2 or not 0 < labels[aside].sum() < aside.sum():
        aside = np.zeros(len(rows), bool)
    check = aside if aside.any() else ~aside
    best: tuple[float, Model] | None = None
    for shrink in SHRINKAGES:
        model = discriminant(rows[~aside], labels[~aside], shrink)
        z = model.differences(rows[check])
        curve = logistic(z, labels[check])
        t = np.clip(curve[0] * z + curve[1], -30, 30)
        loss = float(np.mean(np.logaddexp(0, t) - labels[check] * t))
        if best is None or loss < best[0]:
            model.parts["curve"] = curve
            best = (loss, model)
    return best[1]


def discriminant(rows: np.ndarray, labels: np.ndarray, shrink: float) -> Model:
    mean, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-3
    x = np.clip((rows - mean) / spread, -CLIP, CLIP)
    centres = np.stack([x[labels == c].mean(axis=0) for c in (0, 1)])
    pooled = ((x - centres[labels]) ** 2).mean(axis=0) + 0.05
    whiten, half = [], []
    for c in (0, 1):
        y = x[labels == c] - centres[c]
        own = shrink + (1 - shrink) * min(1.0, len(pooled) / (2 * len(y)))  # small classes lean on the pooled diagonal
        factor = np.linalg.cholesky((1 - own) * (y.T @ y / len(y)) + own * np.diag(pooled))
        whiten.append(np.linalg.inv(factor))
        half.append(np.log(np.diag(factor)).sum())
    return Model(mean=mean, spread=spread, centres=centres, whiten=np.stack(whiten), half_logdet=np.array(half), curve=np.array([1.0, 0.0]))


def logistic(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and offset by Newton steps, slightly ridged; targets are smoothed by the class sizes."""
    n1, n0 = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = np.abs(z).mean() + 1e-9
    x = np.stack([z / scale, np.ones_like(z)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - goal) + 1e-3 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.linalg.solve(h, g)
    return np.array([max(w[0], 0) / scale, w[1]])


@lru_cache(maxsize=1)
def _model(data: bytes) -> Model:
    return Model.from_bytes(data)


def _fit_bytes(texts: list[str | None], labels: np.ndarray) -> bytes:
    return fit(texts, labels).to_bytes()


def _score_bytes(data: bytes, texts: list[str | None]) -> np.ndarray:
    return _model(data).scores(texts)


def quality_model(spark, sf_dir: str) -> bytes:
    labels = table(spark, sf_dir, "labels").filter(remainder(5) != 0)
    return train(table(spark, sf_dir, "documents"), labels, "quality", _fit_bytes, SAMPLE)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, quality_model(spark, sf_dir), _score_bytes)
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"))
